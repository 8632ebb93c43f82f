"""Upkeep, record checks, reports, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from screenwright import schemas
from screenwright.operators import analytics as A
from screenwright.operators import maintenance as M
from screenwright.operators import quality as Q
from screenwright.operators import prepare as P
from screenwright.plans.upkeep import maintain
from screenwright.sources import tables as S
from verification.bindings import ALIASES

POLICY = schemas.POLICIES
AUDIT = schemas.AUDIT


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def policies(spark):
    return spark.createDataFrame([
        (1, "9", "*", "a,b", False, False, False, True, "x"),
        (2, "9", "*", "a,b", False, False, False, True, "other text"),
        (3, "9", "*", "a,b", False, False, None, True, "null flag"),
        (4, "9", "*", "a,b", False, False, None, True, "null flag"),
        (5, "9", "*", "*", False, True, False, False, "broad"),
        (6, "9", "*", "*", True, False, False, False, "allow all"),
        (7, "telecomm-user", "u", "c", False, False, False, False, ""),
    ], POLICY)


def test_policy_clean_up(spark, policies):
    assert [r.id for r in M.drop_duplicate_policies(policies).orderBy("id").collect()] == [1, 3, 4, 5, 6, 7]
    assert [r.id for r in M.drop_broad_policies(policies).orderBy("id").collect()] == [1, 2, 3, 4, 6, 7]
    assert M.delete_policies(policies, spark.createDataFrame([(1,), (99,)], "id int")).count() == 6


def test_appended_policies_get_the_next_ids(spark, policies):
    new = policies.filter("id < 3").withColumn("seq", F.col("id") * 10).drop("id")
    assert [r.id for r in M.append_policies(policies, new).orderBy("id").collect()][-2:] == [8, 18]
    assert M.append_policies(policies, new.limit(0)).count() == 7


def test_upsert_takes_the_last_change_and_keeps_other_columns(spark):
    users = spark.createDataFrame([("a", "A", "USER", 1, None), ("b", "B", "ADMIN", None, None)], schemas.USERS)
    users = users.withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    changes = spark.createDataFrame(
        [("a", "A1", "USER", 2, 1), ("a", "A2", "ADMIN", None, 2), ("c", "C", "USER", 3, 3)],
        "user_id string, display_name string, role string, org_id int, seq int")
    got = {r.user_id: r for r in M.upsert_users(users, changes).collect()}
    assert (got["a"].display_name, got["a"].role, got["a"].org_id) == ("A2", "ADMIN", None)
    assert got["a"].created_at is not None and got["c"].created_at is None and got["b"].role == "ADMIN"


def audit_row(id, prompt, action, used=0, saved=0, cu=0.0, cs=0.0, user="u"):
    return (id, user, "t", "b", prompt, prompt, "NONE", 0, "NONE", action, "", None, used, saved, cu, cs, None)


def test_backfill_touches_only_rows_without_usage(spark):
    audit = spark.createDataFrame([
        audit_row("1", "x" * 10, "BLOCK"), audit_row("2", "x" * 10, "ALLOW"), audit_row("3", "x" * 10, None),
        audit_row("4", None, "ALLOW"), audit_row("5", "x", "ALLOW", used=5, cu=0.1),
    ], AUDIT)
    got = {r.id: (r.tokens_used, r.tokens_saved, round(r.cost_used, 8), round(r.cost_saved, 8))
           for r in M.backfill_usage(audit).collect()}
    assert got == {"1": (0, 302, 0.0, 0.002114), "2": (302, 0, 0.002114, 0.0), "3": (0, 0, 0.0, 0.0),
                   "4": (0, 0, 0.0, 0.0), "5": (5, 0, 0.1, 0.0)}


def test_maintenance_twice_changes_nothing_more(spark, policies):
    users = spark.createDataFrame([("101", "x", "USER", 101, None), ("software-user", "s", "USER", None, None)],
                                  schemas.USERS)
    orgs = spark.createDataFrame([(101, "Telecomm")], schemas.ORGANIZATIONS)
    audit = spark.createDataFrame([audit_row("1", "hello", "ALLOW", user="Telecomm")], AUDIT).drop("browser_name")
    seeds = {"organizations": spark.createDataFrame([(101, "New name"), (102, "Software")], schemas.ORGANIZATIONS),
             "users": spark.createDataFrame([("admin-user", "Admin", "ADMIN", None, None)], schemas.USERS),
             "policies": policies.filter("id = 6")}
    old = policies.withColumnRenamed("critical_col", "critial_col")
    once = maintain(audit, users, orgs, old, seeds, ALIASES)
    assert rows(once["organizations"]) == [(101, "Telecomm"), (102, "Software")]
    assert {r.user_id: (r.display_name, r.org_id) for r in once["users"].collect()} == {
        "software-user": ("Software", 102), "admin-user": ("Admin", None)}
    assert sorted(r.id for r in once["policies"].collect()) == [1, 3, 4, 6, 7]
    assert once["audit"].select("user_id", "browser_name").collect() == [("101", "Unknown")]
    twice = maintain(once["audit"], once["users"], once["organizations"], once["policies"], seeds, ALIASES)
    for name in once:
        columns = sorted(once[name].columns)
        assert rows(once[name].select(columns)) == rows(twice[name].select(columns)), name


def test_reports_on_an_empty_table(spark):
    empty = spark.createDataFrame([], AUDIT)
    only = A.risk_summary(empty).first()
    assert (only.totalPrompts, only.blockedPrompts, only.tokensUsed, only.costUsed, only.blockRate) == (0, 0, 0, 0.0, "0%")


def test_block_rate_rounds_half_up(spark):
    audit = spark.createDataFrame(
        [audit_row(str(i), "x", "BLOCK" if i == 0 else "ALLOW") for i in range(8)], AUDIT)
    assert A.risk_summary(audit).first().blockRate == "13%"  # 12.5


def test_report_ids():
    assert A.report_ids("telecomm-user", ALIASES) == ["Telecomm", "101"]
    assert A.report_ids("102", ALIASES) == ["Software", "102"]
    assert A.report_ids("other", ALIASES) == ["other"] and A.report_ids("102") == ["102"]
    for missing in (None, "", "  "):
        with pytest.raises(ValueError):
            A.required_ids(missing)


def test_newest_first_puts_rows_without_a_time_on_top(spark):
    audit = spark.createDataFrame([audit_row("1", "x", "ALLOW"), audit_row("2", "x", "ALLOW")], AUDIT).withColumn(
        "created_at", F.when(F.col("id") == "1", F.lit("2024-01-01").cast("timestamp")))
    assert [r.id for r in A.recent_logs(audit).collect()] == ["2", "1"]


def test_record_checks_split_rows(spark):
    raw = spark.sql("""SELECT * FROM VALUES ('u', NULL, 'admin', '7'), (' ', 'x', 'USER', '1'), ('v', 'V', 'boss', 'x')
        AS t(userId, displayName, role, orgId)""")
    good, bad = Q.check_users(raw)
    assert rows(good) == [("u", "u", "admin", 7), ("v", "V", "USER", None)]
    assert [r.error for r in bad.collect()] == ["userId is required"]
    raw = spark.sql("SELECT * FROM VALUES ('1', 'a'), ('x', 'b'), (NULL, 'c'), ('2', ' ') AS t(orgId, orgName)")
    good, bad = Q.check_organizations(raw)
    assert rows(good) == [(1, "a")] and bad.count() == 3


def test_alert_defaults_for_missing_fields(spark):
    got = Q.normalize_alerts(spark.createDataFrame([("X",), (None,)], "type string").coalesce(1)).collect()
    assert [tuple(r) for r in got] == [("X", "unknown", "No message", "N/A"), ("UNKNOWN", "unknown", "No message", "N/A")]


def test_browser_and_tool_order(spark):
    df = spark.createDataFrame([
        ("https://openai.claude.ai/x", "Mozilla Chrome/1 Safari/5 Edg/1", False), ("https://x.com", "Chrome/1", True),
        (None, None, None), ("https://claude.ai/?u=chatgpt", "Safari/1", None)], "url string, ua string, brave boolean").coalesce(1)
    got = P.with_browser(P.with_tool(df), "ua", "brave").select("tool", "browser_name").collect()
    assert [tuple(r) for r in got] == [("ChatGPT", "Edge"), ("Grok", "Brave"), ("Unknown", "Unknown"), ("Claude", "Safari")]


def test_dimensions_and_audit_round_trip(spark, tmp_path, policies):
    users = spark.createDataFrame([("a", "A", "USER", 1, None)], schemas.USERS)
    orgs = spark.createDataFrame([(1, "One")], schemas.ORGANIZATIONS)
    from screenwright.plans.screening import Dimensions
    S.write_dims(Dimensions(users, orgs, policies), str(tmp_path / "dims"))
    back = S.read_dims(spark, str(tmp_path / "dims"))
    assert rows(back.users) == rows(users) and rows(back.policies) == rows(policies)
    audit = spark.createDataFrame([audit_row("1", "x", "ALLOW")], AUDIT).withColumn(
        "created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for _ in range(2):
        S.write_audit(audit, str(tmp_path / "audit"))
    again = S.read_audit(spark, str(tmp_path / "audit"))
    assert again.count() == 1  # repeating a write adds nothing
    later = audit.withColumn("id", F.lit("2")).withColumn("created_at", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    undated = later.withColumns({"id": F.lit("3"), "created_at": F.lit(None).cast("timestamp")})
    for _ in range(2):
        S.write_audit(audit.unionByName(later).unionByName(undated), str(tmp_path / "audit"))
    assert sorted(r.id for r in again.sparkSession.read.schema("id string").parquet(str(tmp_path / "audit")).collect()) == [
        "1", "2", "3"]
    assert len(list((tmp_path / "audit" / "audit_date=2024-01-02").glob("*.parquet"))) == 1
    plan = again.filter("audit_date = date'2024-01-02'").select("action")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(audit_date" in plan and "original_prompt" not in plan


def test_prompts_from_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"request_id": "1", "prompt": "hi", "testing": true}\n{"request_id": "2"}\n')
    got = S.read_prompts(spark, str(tmp_path), "json").orderBy("request_id").collect()
    assert [(r.request_id, r.prompt, r.testing) for r in got] == [("1", "hi", True), ("2", None, None)]


def test_audit_folder_of_a_file_stream_is_refused(spark, tmp_path):
    audit = spark.createDataFrame([audit_row("1", "x", "ALLOW")], AUDIT)
    (tmp_path / "audit" / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(ValueError, match="file stream"):
        S.write_audit(audit, str(tmp_path / "audit"))


def test_policies_of_an_account(spark, policies):
    users = spark.createDataFrame([("kim", "K", "USER", 9, None), ("lee", "L", "USER", None, None)], schemas.USERS)
    assert [r.id for r in A.policy_list(policies, "kim", users).collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in A.policy_list(policies, "9", users).collect()] == [1, 2, 3, 4, 5, 6]
    assert A.policy_list(policies, "lee", users).count() == A.policy_list(policies, "none", users).count() == 0
    assert [r.id for r in A.policy_list(policies, "telecomm-user", users).collect()] == [7]
    assert A.policy_list(policies, " ", users).count() == 7
