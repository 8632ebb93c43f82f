"""One entry per operator: a Spark query over the given tables and, beside it, the SQL that has to give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.text import contains_any, first_match, is_blank, normalise, regex
from screenwright.functions.detections import first_keyword
from screenwright.functions.tokens import cost, count_tokens, response_tokens
from screenwright.operators import aliases as L
from screenwright.operators import analytics as A
from screenwright.operators import maintenance as M
from screenwright.operators import prepare as P
from screenwright.operators import quality as Q
from screenwright.operators import rollup as U
from screenwright.operators.audit import storable
from screenwright.operators.detectors import CORE, EXTRA, add_text_columns, detect, jwt_claims
from screenwright.operators.org_policy import detect_org_keywords
from screenwright.operators.scoring import (
    combine,
    enforce,
    explode_detections,
    hits_per_detector,
    observe_hits,
    observed_hits,
    placeholder,
    response,
)
from screenwright.plans.screening import Options, audit, screen
from screenwright.plans.upkeep import maintain
from screenwright.schemas import AUDIT as AUDIT_SCHEMA
from screenwright.schemas import HEARTBEATS_NORMAL, conform_audit
from screenwright.sources.tables import (
    append_screened,
    read_audit,
    read_checked,
    read_dims,
    read_prompts,
    read_prompts_checked,
    read_prompts_stream,
    write_audit,
    write_checked,
    write_dims,
)
from screenwright.streaming import jobs as R
from verification import bindings as B
from verification import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def over(base: str, select: str) -> str:
    return f"WITH {base}\n{select}"


BASE = B.base_sql()
SCORED = O.screening()
SCORED_ALL = O.screening("extended")
AUDIT = O.auditing()


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def shown(detections: str | Column) -> Column:
    return F.array_join(F.transform(detections, lambda d: F.concat_ws(
        "|", d["risk_type"], d["score"].cast("string"), d["description"], d["matched_value"])), " ;; ")


def scored(spark: SparkSession, sf: str, profile: str = "core", **options) -> DataFrame:
    return screen(B.requests(spark, sf), B.dims(spark, sf), Options(profile=profile, aliases=B.ALIASES, **options))


def audited(spark: SparkSession, sf: str) -> DataFrame:
    return audit(B.requests(spark, sf), B.dims(spark, sf), Options(aliases=B.ALIASES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the session; a temporary one only on a local master, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The test data has times without a zone.
LOCAL_AUDIT = AUDIT_SCHEMA.replace("created_at timestamp", "created_at timestamp_ntz")
AUDIT_TABLES: dict[tuple[str, str], str] = {}


def audit_table(spark: SparkSession, sf: str) -> DataFrame:
    """The audit rows of all requests as a written table, as reports find it. Written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in AUDIT_TABLES:
        path = shared_folder(spark, "audit")
        write_audit(audited(spark, sf), path)
        AUDIT_TABLES[key] = path
    return read_audit(spark, AUDIT_TABLES[key], LOCAL_AUDIT)


def written_requests(spark: SparkSession, sf: str, fmt: str = "parquet") -> str:
    """All requests as files of the documented schema, for the registered readers."""
    path = shared_folder(spark, "requests")
    B.requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.format(fmt).save(path)
    return path


# Sources and sinks.

@query("s1_prompt_ingest", over(BASE, f"""
SELECT request_id, user_id, sub_user, tool, browser_name, testing, CAST(length(prompt) AS INT) AS chars,
  {stamp_sql('ts')} AS ts FROM requests"""))
def prompt_ingest(spark, sf):
    return read_prompts(spark, written_requests(spark, sf)).select(
        "request_id", "user_id", "sub_user", "tool", "browser_name", "testing", F.length("prompt").alias("chars"),
        stamp("ts").alias("ts"))


@query("s2_stream_ingest", over(BASE, f"""
SELECT request_id, user_id, sub_user, tool, browser_name, testing, CAST(length(prompt) AS INT) AS chars,
  {stamp_sql('ts')} AS ts FROM requests"""))
def stream_ingest(spark, sf):
    path = shared_folder(spark, "ingested")
    read_prompts_stream(spark, written_requests(spark, sf, "json"), files_per_batch=4).writeStream.format("parquet").option(
        "path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return read_prompts(spark, f"{path}/rows").select(
        "request_id", "user_id", "sub_user", "tool", "browser_name", "testing", F.length("prompt").alias("chars"),
        stamp("ts").alias("ts"))


@query("s3_audit_sink", over(AUDIT, """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS audit_date, action, count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens
FROM audit GROUP BY ALL"""))
def audit_sink(spark, sf):
    # Written twice: the second time adds nothing.
    path, rows = shared_folder(spark, "audit"), audit_table(spark, sf).drop("audit_date")
    for _ in range(2):
        write_audit(rows, path)
    return read_audit(spark, path, LOCAL_AUDIT).groupBy(F.col("audit_date").cast("string").alias("audit_date"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_used").alias("tokens"))


@query("s4_dimensions", over(BASE, """
SELECT 'user' AS kind, user_id AS key, display_name AS label, CAST(org_id AS VARCHAR) AS extra FROM users
UNION ALL SELECT 'organization', CAST(org_id AS VARCHAR), org_name, NULL FROM organizations
UNION ALL SELECT 'policy', CAST(id AS VARCHAR), keyword_list, user_id || '/' || sub_user FROM policies"""))
def dimensions(spark, sf):
    path = shared_folder(spark, "dims")
    write_dims(B.dims(spark, sf), path)
    d = read_dims(spark, path)
    return d.users.select(
        F.lit("user").alias("kind"), F.col("user_id").alias("key"), F.col("display_name").alias("label"),
        F.col("org_id").cast("string").alias("extra"),
    ).unionAll(d.organizations.select(
        F.lit("organization"), F.col("org_id").cast("string"), "org_name", F.lit(None).cast("string"),
    )).unionAll(d.policies.select(
        F.lit("policy"), F.col("id").cast("string"), "keyword_list", F.concat_ws("/", "user_id", "sub_user")))


@query("s5_alert_ingest", over(BASE, """
SELECT event_id, coalesce(type, 'UNKNOWN') AS type, coalesce(userId, 'unknown') AS "userId",
  coalesce(message, 'No message') AS message, coalesce(timestamp, 'N/A') AS timestamp FROM alerts"""))
def alert_ingest(spark, sf):
    return Q.normalize_alerts(B.read(spark, sf, "events").selectExpr(*B.ALERTS))


LABEL_SQL = """CASE WHEN lower(sub) = 'telecomm-user' THEN 'Telecomm' WHEN lower(sub) = 'software-user' THEN 'Software'
  WHEN uid = '101' OR lower(uid) = 'telecomm' OR uid = 'telecomm-user' THEN 'Telecomm'
  WHEN uid = '102' OR lower(uid) = 'software' OR uid = 'software-user' THEN 'Software' ELSE uid END"""
BEATS_SQL = f"""{BASE}, beats AS (
  SELECT event_id, uid AS "userId", sub AS "subUser", browser AS "browserName", {LABEL_SQL} AS org_label, ts FROM (
    SELECT event_id, coalesce(userId, 'unknown') AS uid,
      CASE WHEN subUser IS NULL OR {O.trim('subUser')} = '' THEN 'unknown' ELSE subUser END AS sub,
      coalesce(browserName, 'Unknown') AS browser, ts FROM heartbeats))"""


def beats(spark, sf):
    return Q.normalize_heartbeats(B.read(spark, sf, "events").selectExpr(*B.HEARTBEATS), B.ALIASES)


@query("s6_heartbeat_ingest", over(BEATS_SQL, f"SELECT * REPLACE ({stamp_sql('ts')} AS ts) FROM beats"))
def heartbeat_ingest(spark, sf):
    return beats(spark, sf).withColumn("ts", stamp("ts"))


def hosts_sql(host: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({host}, '{p}')" for p in parts) + f" THEN '{tool}'"
                     for parts, tool in C.TOOL_HOSTS)
    return f"CASE {whens} ELSE 'Unknown' END"


@query("s7_tool_from_url", over(BASE, f"""
SELECT page_id, {hosts_sql("split_part(split_part(url, '://', 2), '/', 1)")} AS tool FROM visits"""))
def tool_from_url(spark, sf):
    return P.with_tool(B.visits(spark, sf)).select("page_id", "tool")


@query("s8_browser_from_agent", over(BASE, """
SELECT page_id, CASE WHEN is_brave THEN 'Brave' WHEN contains(user_agent, 'Edg/') THEN 'Edge'
  WHEN contains(user_agent, 'OPR/') OR contains(user_agent, 'Opera') THEN 'Opera'
  WHEN contains(user_agent, 'Firefox/') THEN 'Firefox'
  WHEN contains(user_agent, 'Safari/') AND NOT contains(user_agent, 'Chrome') THEN 'Safari'
  WHEN contains(user_agent, 'Chrome/') THEN 'Chrome' ELSE 'Unknown' END AS browser_name FROM visits"""))
def browser_from_agent(spark, sf):
    return P.with_browser(B.visits(spark, sf), is_brave="is_brave").select("page_id", "browser_name")


# Preparation.

@query("p1_blank_prompts", over(BASE, f"SELECT request_id, {O.blank('prompt')} AS blank FROM requests"))
def blank_prompts(spark, sf):
    return B.requests(spark, sf).select("request_id", is_blank(F.col("prompt")).alias("blank"))


@query("p2_submitted_prompts", over(BASE, f"SELECT request_id FROM requests WHERE length({O.trim('prompt')}) >= 3"))
def submitted_prompts(spark, sf):
    return P.submitted(B.requests(spark, sf)).select("request_id")


@query("p3_normalise", over(BASE, f"SELECT request_id, {O.NORM} AS norm FROM requests"))
def normalised(spark, sf):
    return B.requests(spark, sf).select("request_id", normalise(F.col("prompt")).alias("norm"))


@query("p4_sub_user", over(BASE, f"SELECT request_id, {O.SUB} AS sub_user FROM requests"))
def sub_user(spark, sf):
    return B.requests(spark, sf).select("request_id", P.default_sub_user(F.col("sub_user")).alias("sub_user"))


@query("p5a_canonical_user", over(BASE, f"SELECT request_id, {O.canonical(O.SUB)} AS user_id FROM requests"))
def canonical_user(spark, sf):
    return P.prepare_requests(B.requests(spark, sf), B.ALIASES).select("request_id", "user_id")


@query("p5b_heartbeat_label", over(BEATS_SQL, "SELECT event_id, org_label FROM beats"))
def heartbeat_label(spark, sf):
    return beats(spark, sf).select("event_id", "org_label")


ANALYTICS_SQL = """CASE WHEN user_id = '101' OR lower(user_id) IN ('telecomm', 'telecomm-user') THEN 'Telecomm'
  WHEN user_id = '102' OR lower(user_id) IN ('software', 'software-user') THEN 'Software' ELSE user_id END"""


@query("p5c_analytics_id", over(BASE, f"SELECT request_id, {ANALYTICS_SQL} AS resolved FROM requests"))
def analytics_id(spark, sf):
    return B.requests(spark, sf).select("request_id", P.analytics_id(F.col("user_id"), B.ALIASES).alias("resolved"))


@query("p5d_alternate_id", over(BASE, """
SELECT request_id, CASE lower(user_id) WHEN 'software' THEN '102' WHEN 'telecomm' THEN '101' ELSE user_id END AS alternate
FROM requests"""))
def alternate_id(spark, sf):
    return B.requests(spark, sf).select("request_id", P.alternate_id(F.col("user_id"), B.ALIASES).alias("alternate"))


@query("p5e_display_label", over(BASE, """
SELECT request_id, coalesce(o.org_name, r.user_id) AS display_label
FROM requests r LEFT JOIN organizations o ON r.user_id = CAST(o.org_id AS VARCHAR)"""))
def display_label(spark, sf):
    return P.with_display_label(B.requests(spark, sf), B.organizations(spark, sf)).select("request_id", "display_label")


ORG_KEY_SQL = f"""
SELECT r.request_id, CASE WHEN {O.blank('r.user_id')} @EXTRA@ THEN r.user_id
  ELSE coalesce(CAST(u.org_id AS VARCHAR), r.user_id) END AS org_key
FROM requests r LEFT JOIN users u ON r.user_id = u.user_id"""


@query("p6a_org_key", over(BASE, ORG_KEY_SQL.replace("@EXTRA@", "")))
def org_key(spark, sf):
    return P.with_org_key(B.requests(spark, sf), B.users(spark, sf), salt_by="request_id").select("request_id", "org_key")


@query("p6b_admin_org_key", over(BASE, ORG_KEY_SQL.replace("@EXTRA@", "OR regexp_matches(r.user_id, '^[0-9]+$')")))
def admin_org_key(spark, sf):
    return P.with_org_key(B.requests(spark, sf), B.users(spark, sf), numeric_as_is=True, salt_by="request_id").select(
        "request_id", "org_key")


@query("p7_score_once", over(SCORED, f"SELECT request_id, risk_score, action, {O.shown('detections')} AS detections FROM scored"))
def score_once(spark, sf):
    reused = screen(B.requests(spark, sf), B.dims(spark, sf), Options(aliases=B.ALIASES), reuse=True)
    return reused.select("request_id", "risk_score", "action", shown("detections").alias("detections"))


@query("p8_storable", over(BASE, """
SELECT request_id FROM requests WHERE NOT (testing AND lower(coalesce(tool, 'Unknown')) = 'dashboardtest')"""))
def storable_requests(spark, sf):
    return storable(B.requests(spark, sf)).select("request_id")


@query("p9_audit_defaults", over(AUDIT, """
SELECT id, user_id, tool, browser_name, highest_risk_type, risk_level, action FROM audit"""))
def audit_defaults(spark, sf):
    return audited(spark, sf).select("id", "user_id", "tool", "browser_name", "highest_risk_type", "risk_level", "action")


INT_SQL = "CASE WHEN regexp_matches({0}, '^[+-]?[0-9]+$') THEN TRY_CAST({0} AS INT) END"


@query("p10_user_quality", over(BASE, f"""
SELECT userId AS user_id, coalesce(displayName, userId) AS display_name,
  CASE WHEN upper(role) IN ('ADMIN', 'USER') THEN role ELSE 'USER' END AS role, {INT_SQL.format('orgId')} AS org_id,
  NULL AS error FROM raw_users WHERE NOT {O.blank('userId')}
UNION ALL SELECT userId, displayName, role, NULL, 'userId is required' FROM raw_users WHERE {O.blank('userId')}"""))
def user_quality(spark, sf):
    good, bad = Q.check_users(B.read(spark, sf, "customer").selectExpr(*B.RAW_USERS))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select(
        F.col("userId").alias("user_id"), F.col("displayName").alias("display_name"), "role",
        F.lit(None).cast("int").alias("org_id"), "error"))


ORG_ERROR_SQL = f"""CASE WHEN orgId IS NULL OR {O.blank('orgName')} THEN 'orgId and orgName are required'
  WHEN {INT_SQL.format('orgId')} IS NULL THEN 'orgId is not a number' END"""


@query("p11_organization_quality", over(BASE, f"""
SELECT CASE WHEN {ORG_ERROR_SQL} IS NULL THEN orgId END AS org_id, orgName AS org_name, {ORG_ERROR_SQL} AS error
FROM raw_organizations"""))
def organization_quality(spark, sf):
    good, bad = Q.check_organizations(B.read(spark, sf, "supplier").selectExpr(*B.RAW_ORGANIZATIONS))
    return good.select(F.col("org_id").cast("string"), "org_name", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.lit(None).cast("string").alias("org_id"), F.col("orgName").alias("org_name"), "error"))


POLICY_ERROR_SQL = f"""CASE WHEN {O.blank('p.userId')} THEN 'userId is required'
  WHEN {O.blank('p.subUser')} THEN 'subUser is required' WHEN {O.blank('p.keywordList')} THEN 'keywordList is required' END"""
GOOD_POLICIES_SQL = f"""
SELECT p.seq, CASE WHEN regexp_matches(p.userId, '^[0-9]+$') THEN p.userId
    ELSE coalesce(CAST(u.org_id AS VARCHAR), p.userId) END AS user_id,
  p.subUser AS sub_user, p.keywordList AS keyword_list, coalesce(p.allowCol, false) AS allow_col,
  coalesce(p.redactedCol, false) AS redacted_col, coalesce(p.criticalCol, false) OR coalesce(p.critialCol, false) AS critical_col,
  coalesce(p.blockCol, false) AS block_col, coalesce(p.promptCol, '') AS prompt_col
FROM raw_policies p LEFT JOIN users u ON p.userId = u.user_id WHERE {POLICY_ERROR_SQL} IS NULL"""


@query("p12_policy_quality", over(BASE, f"""
SELECT *, NULL AS error FROM ({GOOD_POLICIES_SQL})
UNION ALL SELECT seq, userId, subUser, keywordList, NULL, NULL, NULL, NULL, NULL, {POLICY_ERROR_SQL}
FROM raw_policies p WHERE {POLICY_ERROR_SQL} IS NOT NULL"""))
def policy_quality(spark, sf):
    good, bad = Q.check_policies(B.read(spark, sf, "supplier").selectExpr(*B.RAW_POLICIES), B.users(spark, sf))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select(
        "seq", F.col("userId").alias("user_id"), F.col("subUser").alias("sub_user"),
        F.col("keywordList").alias("keyword_list"), "error"), allowMissingColumns=True)


# Shared parts of the detectors.

TEXTS = f"{BASE}, texts AS ({O.texts('requests')})"


@query("x1_inquiry", over(TEXTS, "SELECT request_id, inquiry, personal_inquiry FROM texts"))
def inquiry(spark, sf):
    t = add_text_columns(B.requests(spark, sf))
    return t.select("request_id", F.col("_inquiry").alias("inquiry"), F.col("_personal_inquiry").alias("personal_inquiry"))


@query("x2_any_keyword", over(TEXTS, f"SELECT request_id, {O.has('norm', C.HEALTH_TOPIC)} AS hit FROM texts"))
def any_keyword(spark, sf):
    return add_text_columns(B.requests(spark, sf)).select(
        "request_id", contains_any(F.col("_norm"), C.HEALTH_TOPIC).alias("hit"))


@query("x3_first_keyword", over(TEXTS, f"""
SELECT request_id, list_filter({O.words(C.HEALTH_PERSONAL)}, lambda w: contains(norm, w))[1] AS word FROM texts"""))
def keyword_in_list_order(spark, sf):
    return add_text_columns(B.requests(spark, sf)).select(
        "request_id", first_keyword(F.col("_norm"), C.HEALTH_PERSONAL).alias("word"))


@query("x4_first_match", over(BASE, f"""
SELECT request_id, coalesce(regexp_extract(prompt, {O.quote(C.EMAIL_PATTERN)}), '') AS matched FROM requests
WHERE prompt IS NOT NULL"""))
def first_matches(spark, sf):
    return B.requests(spark, sf).filter(F.col("prompt").isNotNull()).select(
        "request_id", first_match(F.col("prompt"), C.EMAIL_PATTERN, ("@",)).alias("matched"))


@query("x5_all_matches", over(TEXTS, f"""
SELECT request_id, unnest(regexp_extract_all(folded, {O.quote(C.IPV4_PATTERN)})) AS matched FROM texts"""))
def every_match(spark, sf):
    return B.requests(spark, sf).select("request_id", F.explode(
        F.regexp_extract_all("prompt", F.lit(regex(C.IPV4_PATTERN)), F.lit(0))).alias("matched"))


@query("x6_direct_before_intent", over(f"{TEXTS}, found AS ({O.found(['crypto'])})", """
SELECT CASE WHEN len(direct_crypto) > 0 THEN 'direct' WHEN len(found_crypto) > 0 THEN 'intent' ELSE 'none' END AS layer,
  count(*) AS n FROM found GROUP BY ALL"""))
def direct_before_intent(spark, sf):
    d = F.get("detections", F.lit(0))["description"]
    layer = F.when(d.startswith("L1"), "direct").when(d.startswith("L2"), "intent").otherwise("none")
    return detect(B.requests(spark, sf), "crypto").groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


HITS_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}' AS detector, CAST(coalesce(sum(len(found_{n})), 0) AS BIGINT) AS detections, "
    f"count(*) FILTER (WHERE len(found_{n}) > 0) AS prompts FROM found_org_too" for n in (*CORE, "org", *EXTRA))


@query("x8_detector_hits", over(SCORED_ALL, f"SELECT * FROM ({HITS_SQL}) WHERE detections > 0"))
def detector_hits(spark, sf):
    return hits_per_detector(scored(spark, sf, "extended"))


# Detectors.

D_NUMBERS = {"injection": 1, "secret": 2, "personal": 3, "health": 4, "code": 5, "keyword": 6, "crypto": 8, "network": 9,
             "jwt": 10, "database": 11, "cloud": 12}


def detector_query(name: str) -> Query:
    def run(spark, sf):
        return detect(B.requests(spark, sf), name).select("request_id", shown("detections").alias("detections"))

    return run


for _name, _number in D_NUMBERS.items():
    query(f"d{_number}_detect_{_name}", over(
        f"{TEXTS}, found AS ({O.found([_name])})",
        f"SELECT request_id, {O.shown(f'found_{_name}')} AS detections FROM found"))(detector_query(_name))


@query("d5_code_in_pages", over(
    f"pages_texts AS ({O.texts('(SELECT page_id, html AS prompt FROM pages)')}), "
    f"found AS ({O.found(['code'], 'pages_texts')})",
    f"SELECT page_id, {O.shown('found_code')} AS detections FROM found"))
def code_in_pages(spark, sf):
    return detect(B.read(spark, sf, "pages"), "code", "html").select("page_id", shown("detections").alias("detections"))


@query("d10b_jwt_claims", over(BASE, f"""
SELECT event_id, {O.claims("rtrim(translate(to_base64(encode(body)), '+/', '-_'), '=')")} AS description
FROM (SELECT event_id, '{{"sub": "u' || CAST(user_id AS VARCHAR) || '", "email":' || event_type || '@x, "iss" : "' || event_type || '"}}' AS body
      FROM events)"""))
def claims(spark, sf):
    body = F.concat(
        F.lit('{"sub": "u'), F.col("user_id").cast("string"), F.lit('", "email":'), F.col("event_type"), F.lit('@x, "iss" : "'),
        F.col("event_type"), F.lit('"}'))
    payload = F.rtrim(F.translate(F.base64(body.cast("binary")), "+/", "-_"), F.lit("="))
    return B.read(spark, sf, "events").select("event_id", jwt_claims(payload).alias("description"))


def org_query(plan: str) -> Query:
    def run(spark, sf):
        keyed = P.with_org_key(P.prepare_requests(B.requests(spark, sf), B.ALIASES), B.users(spark, sf), salt_by="request_id")
        found = detect_org_keywords(add_text_columns(keyed), B.policies(spark, sf), plan=plan)
        return found.select("request_id", "org_key", shown("_found_org").alias("detections"))

    return run


ORG_SQL = over(SCORED, f"SELECT request_id, org_key, {O.shown('found_org')} AS detections FROM found_org_too")
query("d7_org_keywords", ORG_SQL)(org_query("broadcast"))
query("d7_org_keywords_by_join", ORG_SQL)(org_query("join"))


# One organisation whose policies hold all words of all documents as keywords; every user turn of a conversation is its own.
HUGE_POLICIES = [
    "CAST(doc_id + 1 AS INT) AS id", "'huge' AS user_id",
    f"{B.pick(('*', 'user1', 'unknown', 'USER2'), 'doc_id')} AS sub_user", "replace(text, ' ', ',') AS keyword_list",
    "doc_id % 211 = 105 AS allow_col", "doc_id % 3 = 0 AS redacted_col", "doc_id % 4 = 1 AS critical_col",
    "doc_id % 5 = 2 AS block_col",
]
HUGE_SQL = over(f"""
policies AS (SELECT {', '.join(HUGE_POLICIES)} FROM documents),
turns AS (SELECT *, 'huge' AS org_key FROM (SELECT {', '.join(B.turn_requests(True))} FROM conversations WHERE role = 'user')),
texts AS ({O.texts('turns')}),
{O.ORG_HITS},
found_org_too AS ({O.org_found('texts')})""", f"""
SELECT request_id, CAST(len(found_org) AS INT) AS n_found, sha256({O.shown('found_org')}) AS found FROM found_org_too""")


def huge_query(plan: str) -> Query:
    def run(spark, sf):
        turns = B.read(spark, sf, "conversations").where("role = 'user'").selectExpr(*B.turn_requests(False))
        table = B.read(spark, sf, "documents").selectExpr(*HUGE_POLICIES)
        keyed = add_text_columns(turns.repartition(spark.sparkContext.defaultParallelism).withColumn("org_key", F.lit("huge")))
        found = detect_org_keywords(keyed, table, plan=plan)
        return found.select("request_id", F.size("_found_org").alias("n_found"), F.sha2(shown("_found_org"), 256).alias("found"))

    return run


query("d7_huge_organization_by_chunks", HUGE_SQL)(huge_query("join"))


# Combination, score, decision, redaction.

@query("c1_detections", over(SCORED_ALL, """
SELECT request_id, CAST(ord - 1 AS INT) AS ord, d.t AS risk_type, d.s AS score, d.d AS description, d.m AS matched_value
FROM (SELECT request_id, unnest(detections) AS d, generate_subscripts(detections, 1) AS ord FROM scored)"""))
def detections(spark, sf):
    return explode_detections(scored(spark, sf, "extended"), ["request_id"]).drop("detector")


def score_query(name: str, columns: str, profile: str = "core") -> None:
    fields = [c.strip() for c in columns.split(",")]

    def run(spark, sf):
        return scored(spark, sf, profile).select(*fields)

    query(name, over(SCORED if profile == "core" else SCORED_ALL, f"SELECT {columns} FROM scored"))(run)


score_query("c2_total_score", "request_id, risk_score")
score_query("c3_highest_risk_type", "request_id, highest_risk_type")
score_query("c4_risk_level", "request_id, risk_level")
score_query("c5_action", "request_id, action")
score_query("c6_reason", "request_id, action_reason")
score_query("c7_redacted", "request_id, action, redacted_prompt")
score_query("c7_redacted_extended", "request_id, risk_score, highest_risk_type, action, redacted_prompt", "extended")


@query("c8_placeholder", over(SCORED_ALL, f"""
SELECT DISTINCT risk_type, {O.placeholder('risk_type')} AS placeholder
FROM (SELECT unnest(detections).t AS risk_type FROM scored)"""))
def placeholders(spark, sf):
    found = scored(spark, sf, "extended").select(F.explode("detections.risk_type").alias("risk_type")).distinct()
    return found.select("risk_type", placeholder(F.col("risk_type")).alias("placeholder"))


@query("c9_response", over(SCORED, """
SELECT request_id, action, action_reason AS reason, redacted_prompt AS "redactedPrompt", risk_score AS "riskScore",
  risk_level AS "riskLevel" FROM scored"""))
def responses(spark, sf):
    return response(scored(spark, sf), ["request_id"])


@query("c10_forwarded", over(SCORED, """
SELECT request_id, CASE action WHEN 'BLOCK' THEN NULL
  WHEN 'REDACT' THEN CASE WHEN coalesce(redacted_prompt, '') = '' THEN prompt ELSE redacted_prompt END
  ELSE prompt END AS forwarded_prompt FROM scored"""))
def forwarded(spark, sf):
    return enforce(scored(spark, sf)).select("request_id", "forwarded_prompt")


# Tokens and cost.

@query("t1_tokens", over(BASE, f"SELECT request_id, {O.tokens('prompt')} AS tokens FROM requests"))
def token_count(spark, sf):
    return B.requests(spark, sf).select("request_id", count_tokens(F.col("prompt")).alias("tokens"))


@query("t2_response_tokens", over(BASE, f"SELECT request_id, {O.answer('prompt')} AS tokens FROM requests"))
def response_estimate(spark, sf):
    return B.requests(spark, sf).select("request_id", response_tokens(F.col("prompt")).alias("tokens"))


@query("t3_cost", over(BASE, f"""
SELECT request_id, {O.cost("coalesce(tool, '')", "tin", "tout")} AS cost
FROM (SELECT *, {O.tokens('prompt')} AS tin, {O.answer('prompt')} AS tout FROM requests)"""))
def cost_estimate(spark, sf):
    sized = B.requests(spark, sf).withColumns({
        "tin": count_tokens(F.col("prompt")), "tout": response_tokens(F.col("prompt"))})
    return sized.select("request_id", cost(F.col("tool"), F.col("tin"), F.col("tout")).alias("cost"))


@query("t4_usage", over(AUDIT, "SELECT id, action, tokens_used, tokens_saved, cost_used, cost_saved FROM audit"))
def usage(spark, sf):
    return audited(spark, sf).select("id", "action", "tokens_used", "tokens_saved", "cost_used", "cost_saved")


@query("t5_audit_row", over(AUDIT, f"SELECT * REPLACE ({stamp_sql('created_at')} AS created_at) FROM audit"))
def audit_row(spark, sf):
    return audited(spark, sf).withColumn("created_at", stamp("created_at"))


# Reports.

def report_query(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    query(name, over(AUDIT, sql))(lambda spark, sf: run(audit_table(spark, sf)))


def sum_sql(column: str) -> str:
    return f"CAST(coalesce(sum(CAST(round({column}, 8) AS DECIMAL(28, 8))), 0) AS DOUBLE)"


SUMMARY_SQL = "count(*) AS \"totalPrompts\", " + ", ".join(
    f"count(*) FILTER (WHERE action = '{action}') AS \"{name}\"" for name, action in A.ACTIONS) + (
    ", CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS \"tokensUsed\", "
    "CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS \"tokensSaved\", "
    f"{sum_sql('cost_used')} AS \"costUsed\", {sum_sql('cost_saved')} AS \"costSaved\"")


def log_sql(fields=tuple(A.LOG_FIELDS)) -> str:
    return ", ".join(
        f"{stamp_sql(A.LOG_FIELDS[f]) if f == 'timestamp' else A.LOG_FIELDS[f]} AS \"{f}\"" for f in fields)


def stamped(logs: DataFrame) -> DataFrame:
    return logs.withColumn("timestamp", stamp("timestamp"))


report_query("a1_total", "SELECT count(*) AS total FROM audit", A.total_count)
report_query("a2_blocked", "SELECT count(*) AS total FROM audit WHERE action = 'BLOCK'",
             lambda a: A.count_for_action(a, "BLOCK"))
report_query("a3_by_tool", "SELECT tool, count(*) AS count FROM audit GROUP BY tool ORDER BY count DESC, tool",
             A.count_by_tool)
report_query("a4_by_risk_type", "SELECT highest_risk_type AS \"riskType\", count(*) AS count FROM audit GROUP BY 1",
             A.count_by_risk_type)
report_query("a5_top_users", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE action = 'BLOCK') AS blocked FROM audit
GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10""", A.top_users)
report_query("a6_summary", f"SELECT {SUMMARY_SQL} FROM audit", A.summary)
report_query("a7_risk_summary", f"""
SELECT *, CASE WHEN "totalPrompts" > 0 THEN CAST(CAST(floor("blockedPrompts" / "totalPrompts" * 100 + 0.5) AS BIGINT) AS VARCHAR)
  || '%' ELSE '0%' END AS "blockRate" FROM (SELECT {SUMMARY_SQL} FROM audit)""", A.risk_summary)
report_query("a8_user_stats", f"SELECT {SUMMARY_SQL} FROM audit WHERE user_id IN ('Telecomm', '101')",
             lambda a: A.user_stats(a, "telecomm-user", B.ALIASES))
report_query("a9_recent_logs", f"SELECT {log_sql()} FROM audit", lambda a: stamped(A.recent_logs(a)))
report_query("a10_used_logs", f"SELECT {log_sql(A.TOKEN_LOG_FIELDS)} FROM audit WHERE tokens_used > 0",
             lambda a: stamped(A.token_logs(a, "used")))
report_query("a11_used_logs_by_user", f"""
SELECT {log_sql(A.TOKEN_LOG_FIELDS)} FROM audit WHERE tokens_used > 0 AND user_id IN ('Software', '102')""",
             lambda a: stamped(A.token_logs(a, "used", A.report_ids("software", B.ALIASES))))
report_query("a12_saved_logs", f"SELECT {log_sql(A.TOKEN_LOG_FIELDS)} FROM audit WHERE tokens_saved > 0",
             lambda a: stamped(A.token_logs(a, "saved")))
report_query("a13_saved_logs_by_user", f"""
SELECT {log_sql(A.TOKEN_LOG_FIELDS)} FROM audit WHERE tokens_saved > 0 AND user_id IN ('Software', '102')""",
             lambda a: stamped(A.token_logs(a, "saved", A.report_ids("102", B.ALIASES))))
TOTALS_SQL = """SELECT "tokensUsed" AS "totalTokensUsed", "costUsed" AS "totalCostUsed", "tokensSaved" AS "totalTokensSaved",
  "costSaved" AS "totalCostSaved" FROM (SELECT {0} FROM audit{1})"""
report_query("a14_token_report", TOTALS_SQL.format(SUMMARY_SQL, ""), lambda a: A.token_report(a, "ALL")["totals"])
report_query("a14_token_report_by_user", TOTALS_SQL.format(SUMMARY_SQL, " WHERE user_id IN ('Telecomm', '101')"),
             lambda a: A.token_report(a, "101", B.ALIASES)["totals"])
report_query("a15_my_prompts", f"SELECT {log_sql()} FROM audit WHERE user_id IN ('Telecomm', '101')",
             lambda a: stamped(A.my_prompts(a, "telecomm", B.ALIASES)))


@query("a16_user_list", over(BASE, "SELECT user_id, display_name, role FROM users"))
def user_list(spark, sf):
    return A.user_list(B.users(spark, sf))


@query("a17_organization_list", over(BASE, "SELECT org_id, org_name FROM organizations ORDER BY org_id"))
def organization_list(spark, sf):
    return A.organization_list(B.organizations(spark, sf))


@query("a17_organization_by_id", over(BASE, "SELECT org_id, org_name FROM organizations WHERE org_id = 102"))
def organization_by_id(spark, sf):
    return A.organization_list(B.organizations(spark, sf), 102)


@query("a18_policy_list", over(BASE, "SELECT * FROM policies"))
def policy_list(spark, sf):
    return A.policy_list(B.policies(spark, sf))


@query("a18_policies_of_org", over(BASE, "SELECT * FROM policies WHERE user_id = '102'"))
def policies_of_org(spark, sf):
    return A.policy_list(B.policies(spark, sf), "102")


@query("a18_policies_of_account", over(BASE, """
SELECT * FROM policies WHERE user_id = (SELECT CAST(org_id AS VARCHAR) FROM users WHERE user_id = 'c5')"""))
def policies_of_account(spark, sf):
    return A.policy_list(B.policies(spark, sf), "c5", B.users(spark, sf))


ROLE_SQL = """
SELECT r.*, coalesce(u.role, 'USER') AS role, u.user_id IS NOT NULL AS exists
FROM ({0}) r LEFT JOIN (SELECT * FROM users WHERE user_id <> 'anonymous-user') u ON r.user_id = u.user_id"""


@query("a19_role_lookup", over(BASE, ROLE_SQL.format("SELECT request_id, user_id FROM requests")))
def role_lookup(spark, sf):
    return A.role_lookup(B.requests(spark, sf).select("request_id", "user_id"), B.users(spark, sf))


def removals(spark, sf):
    return B.read(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'error' THEN 'uninstall' ELSE 'disable' END AS request_type",
        "CASE WHEN user_id % 6 = 0 THEN 'admin-user' WHEN user_id % 6 = 1 THEN 'anonymous-user' "
        "ELSE 'c' || CAST(user_id AS STRING) END AS user_id", "ts")


REMOVALS_SQL = ROLE_SQL.format("""SELECT CASE WHEN event_type = 'error' THEN 'uninstall' ELSE 'disable' END AS request_type,
  CASE WHEN user_id % 6 = 0 THEN 'admin-user' WHEN user_id % 6 = 1 THEN 'anonymous-user'
  ELSE 'c' || CAST(user_id AS VARCHAR) END AS user_id, ts FROM events""")


@query("a20_removal_decisions", over(BASE, f"""
SELECT request_type, user_id, exists AND role = 'ADMIN' AS allowed, {stamp_sql('ts')} AS ts FROM ({REMOVALS_SQL})"""))
def removal_decisions(spark, sf):
    return A.authorize_removal(removals(spark, sf), B.users(spark, sf))[0].withColumn("ts", stamp("ts"))


@query("a20_tamper_alerts", over(BASE, f"""
SELECT CASE request_type WHEN 'uninstall' THEN 'REMOVE_ATTEMPT' ELSE 'DISABLE_ATTEMPT' END AS type, user_id AS "userId",
  'User "' || user_id || '" tried to ' || CASE request_type WHEN 'uninstall' THEN 'remove' ELSE 'disable' END
  || ' the extension!' AS message, {stamp_sql('ts')} AS timestamp FROM ({REMOVALS_SQL}) WHERE NOT (exists AND role = 'ADMIN')"""))
def tamper_alerts(spark, sf):
    return A.authorize_removal(removals(spark, sf), B.users(spark, sf))[1].withColumn("timestamp", stamp("timestamp"))


@query("a21_table_counts", over(BASE, """
SELECT 'organizations' AS "table", count(*) AS rows FROM organizations UNION ALL SELECT 'users', count(*) FROM users
UNION ALL SELECT 'policies', count(*) FROM policies"""))
def table_counts(spark, sf):
    d = B.dims(spark, sf)
    return A.table_counts(d.users, d.organizations, d.policies)


@query("j1_users_with_organizations", over(BASE, """
SELECT u.user_id, u.display_name, u.role, u.org_id, o.org_name FROM users u LEFT JOIN organizations o USING (org_id)"""))
def users_with_organizations(spark, sf):
    return A.users_with_organizations(B.users(spark, sf), B.organizations(spark, sf))


# Upkeep.

USER_CHANGES = [
    "CASE WHEN c_custkey % 3 = 0 THEN 'n' || CAST(CAST(floor(c_custkey / 2) AS INT) AS STRING) "
    "ELSE 'c' || CAST(c_custkey % 700 AS STRING) END AS user_id",
    "c_name AS display_name", "c_mktsegment AS role", "CAST(c_nationkey AS INT) AS org_id", "c_custkey AS seq",
]


@query("m1_upsert_users", over(f"""{BASE}, changes AS (SELECT {', '.join(USER_CHANGES)} FROM customer),
  last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)""", """
SELECT user_id, display_name, role, org_id FROM last
UNION ALL SELECT user_id, display_name, role, org_id FROM users WHERE user_id NOT IN (SELECT user_id FROM last)"""))
def upsert_users(spark, sf):
    return M.upsert_users(B.users(spark, sf), B.read(spark, sf, "customer").selectExpr(*USER_CHANGES))


ORG_CHANGES = ["CAST(100 + s_nationkey AS INT) AS org_id", "s_name AS org_name", "s_suppkey AS seq"]


@query("m2_upsert_organizations", over(f"""{BASE}, changes AS (SELECT {', '.join(ORG_CHANGES)} FROM supplier),
  last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) = 1)""", """
SELECT org_id, org_name FROM last
UNION ALL SELECT org_id, org_name FROM organizations WHERE org_id NOT IN (SELECT org_id FROM last)"""))
def upsert_organizations(spark, sf):
    return M.upsert_organizations(B.organizations(spark, sf), B.read(spark, sf, "supplier").selectExpr(*ORG_CHANGES))


SEEDS = [*B.POLICIES]
SEEDS[2] = "CASE WHEN s_suppkey % 3 = 0 THEN 'seeded' ELSE " + B.POLICIES[2].rsplit(" AS ", 1)[0] + " END AS sub_user"
SEEDS[0] = "CAST(s_suppkey + 1000000 AS INT) AS id"
SEEDS[8] = "'seed ' || CAST(s_suppkey % 5 AS STRING) AS prompt_col"
SEEDS.append("s_suppkey AS seq")


@query("m3_insert_absent_policies", over(f"""{BASE}, seeds AS (SELECT {', '.join(SEEDS)} FROM supplier),
  new AS (SELECT * FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM policies p
      WHERE p.user_id = s.user_id AND p.sub_user = s.sub_user AND p.keyword_list = s.keyword_list)
    QUALIFY row_number() OVER (PARTITION BY user_id, sub_user, keyword_list ORDER BY seq) = 1)""", """
SELECT id, user_id, sub_user, keyword_list, allow_col, redacted_col, critical_col, block_col, prompt_col FROM policies
UNION ALL SELECT CAST((SELECT max(id) FROM policies) + seq - (SELECT min(seq) FROM new) + 1 AS INT), user_id, sub_user,
  keyword_list, allow_col, redacted_col, critical_col, block_col, prompt_col FROM new"""))
def insert_absent_policies(spark, sf):
    return M.insert_absent(B.policies(spark, sf), B.read(spark, sf, "supplier").selectExpr(*SEEDS),
                           ["user_id", "sub_user", "keyword_list"], "seq", "id")


@query("m4_insert_absent_users", over(f"""{BASE}, changes AS (SELECT {', '.join(USER_CHANGES)} FROM customer),
  first AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1)""", """
SELECT user_id, display_name, role, org_id FROM users
UNION ALL SELECT user_id, display_name, role, org_id FROM first WHERE user_id NOT IN (SELECT user_id FROM users)"""))
def insert_absent_users(spark, sf):
    changes = B.read(spark, sf, "customer").selectExpr(*USER_CHANGES)
    return M.insert_absent(B.users(spark, sf), changes, ["user_id"], "seq")


@query("m4_insert_absent_organizations", over(f"""{BASE}, changes AS (SELECT {', '.join(ORG_CHANGES)} FROM supplier),
  first AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY seq) = 1)""", """
SELECT org_id, org_name FROM organizations
UNION ALL SELECT org_id, org_name FROM first WHERE org_id NOT IN (SELECT org_id FROM organizations)"""))
def insert_absent_organizations(spark, sf):
    return M.insert_absent(B.organizations(spark, sf), B.read(spark, sf, "supplier").selectExpr(*ORG_CHANGES),
                           ["org_id"], "seq")


@query("m5_append_policies", over(f"{BASE}, good AS ({GOOD_POLICIES_SQL})", """
SELECT id, user_id, sub_user, keyword_list, allow_col, redacted_col, critical_col, block_col, prompt_col FROM policies
UNION ALL SELECT CAST((SELECT max(id) FROM policies) + seq - (SELECT min(seq) FROM good) + 1 AS INT), user_id, sub_user,
  keyword_list, allow_col, redacted_col, critical_col, block_col, prompt_col FROM good"""))
def append_policies(spark, sf):
    good, _bad = Q.check_policies(B.read(spark, sf, "supplier").selectExpr(*B.RAW_POLICIES), B.users(spark, sf))
    return M.append_policies(B.policies(spark, sf), good)


@query("m6_delete_policies", over(BASE, """
SELECT * FROM policies WHERE id NOT IN (SELECT CAST(n_nationkey * 3 AS INT) FROM nation)"""))
def delete_policies(spark, sf):
    return M.delete_policies(B.policies(spark, sf), B.read(spark, sf, "nation").selectExpr(
        "CAST(n_nationkey * 3 AS INT) AS id"))


COPIES = "id + 1000000 * (1 + id % 2) AS id"


def with_copies(spark, sf):
    base = B.policies(spark, sf)
    copies = base.selectExpr(COPIES, *[c for c in base.columns if c not in ("id", "prompt_col")], "'copy' AS prompt_col")
    return base.unionByName(copies)


COPIES_SQL = f"""{BASE}, copied AS (SELECT * FROM policies UNION ALL SELECT {COPIES}, user_id, sub_user, keyword_list, allow_col,
  redacted_col, critical_col, block_col, 'copy' FROM policies)"""


@query("m7_drop_duplicate_policies", over(COPIES_SQL, """
SELECT * FROM copied a WHERE NOT EXISTS (SELECT 1 FROM copied b WHERE a.id > b.id AND a.user_id = b.user_id
  AND a.sub_user = b.sub_user AND a.keyword_list = b.keyword_list AND a.block_col = b.block_col
  AND a.critical_col = b.critical_col AND a.redacted_col = b.redacted_col AND a.allow_col = b.allow_col)"""))
def drop_duplicate_policies(spark, sf):
    return M.drop_duplicate_policies(with_copies(spark, sf))


@query("m8_drop_broad_policies", over(BASE, """
SELECT * FROM policies WHERE coalesce(NOT (keyword_list = '*' AND (block_col OR critical_col OR redacted_col)), true)"""))
def drop_broad_policies(spark, sf):
    return M.drop_broad_policies(B.policies(spark, sf))


LEGACY = [
    "'d' || CAST(doc_id AS STRING) AS id",
    "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS original_prompt",
    "CASE doc_id % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN NULL ELSE 'ALLOW' END AS action",
    "CAST(CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS INT) AS tokens_used",
    "CAST(CASE WHEN doc_id % 7 = 0 THEN 9 ELSE 0 END AS INT) AS tokens_saved",
    "CAST(CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS cost_used", "CAST(0 AS DOUBLE) AS cost_saved",
]


@query("m9_backfill_usage", over(f"""legacy AS (SELECT {', '.join(LEGACY)} FROM documents),
  step AS (SELECT id, action, cost_used, cost_saved,
    CASE WHEN tokens_used = 0 AND tokens_saved = 0 AND action <> 'BLOCK' AND original_prompt IS NOT NULL
      THEN length(original_prompt) // 4 + 300 ELSE tokens_used END AS tokens_used,
    CASE WHEN tokens_used = 0 AND tokens_saved = 0 AND action = 'BLOCK' AND original_prompt IS NOT NULL
      THEN length(original_prompt) // 4 + 300 ELSE tokens_saved END AS tokens_saved FROM legacy)""", """
SELECT id, CAST(tokens_used AS INT) AS tokens_used, CAST(tokens_saved AS INT) AS tokens_saved,
  CASE WHEN cost_used = 0 AND cost_saved = 0 AND action <> 'BLOCK' THEN CAST(tokens_used AS DOUBLE) * CAST('7e-06' AS DOUBLE)
    ELSE cost_used END AS cost_used,
  CASE WHEN cost_used = 0 AND cost_saved = 0 AND action = 'BLOCK' THEN CAST(tokens_saved AS DOUBLE) * CAST('7e-06' AS DOUBLE)
    ELSE cost_saved END AS cost_saved FROM step"""))
def backfill_usage(spark, sf):
    return M.backfill_usage(B.read(spark, sf, "documents").selectExpr(*LEGACY)).drop("original_prompt", "action")


@query("m10_rekey_audit", over(AUDIT, """
SELECT id, CASE WHEN user_id IN ('telecomm-user', 'Telecomm') THEN '101' WHEN user_id IN ('software-user', 'Software')
  THEN '102' ELSE user_id END AS user_id FROM audit"""))
def rekey_audit(spark, sf):
    return M.rekey_audit(audit_table(spark, sf), B.ALIASES).select("id", "user_id")


@query("m11_rekey_policies", over(BASE, """
SELECT id, CASE WHEN id % 10 = 3 THEN '101' ELSE user_id END AS user_id FROM policies"""))
def rekey_policies(spark, sf):
    old = B.policies(spark, sf).withColumn(
        "user_id", F.when(F.col("id") % 10 == 3, "telecomm-user").otherwise(F.col("user_id")))
    return M.rekey_policies(old, B.ALIASES).select("id", "user_id")


@query("m12_repair_users", over(BASE, """
SELECT user_id, CASE user_id WHEN 'telecomm-user' THEN 'Telecomm' WHEN 'software-user' THEN 'Software' ELSE display_name END
  AS display_name, role, CASE WHEN user_id = 'telecomm-user' THEN coalesce(org_id, 101)
  WHEN user_id = 'software-user' THEN coalesce(org_id, 102) ELSE org_id END AS org_id
FROM users WHERE user_id NOT IN ('101', '102')"""))
def repair_users(spark, sf):
    return M.repair_users(B.users(spark, sf), B.ALIASES)


@query("m13_conform_schema", over(BASE, """
SELECT CAST(doc_id AS VARCHAR) AS id, 'Unknown' AS browser_name, 0 AS tokens_used, 0 AS tokens_saved,
  CAST(0 AS DOUBLE) AS cost_used, CAST(0 AS DOUBLE) AS cost_saved FROM documents"""))
def conform_schema(spark, sf):
    old = B.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return conform_audit(old)


LEGACY_USER = "CASE doc_id % 3 WHEN 0 THEN 'telecomm-user' WHEN 1 THEN 'Software' ELSE 'c1' END AS user_id"
POLICY_FIELDS = ("user_id", "sub_user", "keyword_list", "allow_col", "redacted_col", "critical_col", "block_col", "prompt_col")
SHOWN_POLICY = ", ".join(f"CAST({c} AS STRING)" for c in POLICY_FIELDS)
# Per table: its key, the other columns as one text, and for audit rows the cost.
MAINTAINED = {
    "audit": ["id AS key", "concat_ws('|', user_id, CAST(tokens_used AS STRING), CAST(tokens_saved AS STRING)) AS detail",
              "cost_used + cost_saved AS cost"],
    "users": ["user_id AS key", "concat_ws('|', display_name, role, CAST(org_id AS STRING)) AS detail",
              "CAST(NULL AS DOUBLE) AS cost"],
    "organizations": ["CAST(org_id AS STRING) AS key", "org_name AS detail", "CAST(NULL AS DOUBLE) AS cost"],
    "policies": ["CAST(id AS STRING) AS key", f"concat_ws('|', {SHOWN_POLICY}) AS detail", "CAST(NULL AS DOUBLE) AS cost"],
}


@query("m_maintain_all", over(f"""{COPIES_SQL}, seeds AS (SELECT {', '.join(SEEDS)} FROM supplier),
  new AS (SELECT * FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM copied p
      WHERE p.user_id = s.user_id AND p.sub_user = s.sub_user AND p.keyword_list = s.keyword_list)
    QUALIFY row_number() OVER (PARTITION BY user_id, sub_user, keyword_list ORDER BY seq) = 1),
  grown AS (SELECT id, {', '.join(POLICY_FIELDS)} FROM copied UNION ALL
    SELECT CAST((SELECT max(id) FROM copied) + seq - (SELECT min(seq) FROM new) + 1 AS INT), {', '.join(POLICY_FIELDS)} FROM new),
  single AS (SELECT * FROM grown a WHERE NOT EXISTS (
    SELECT 1 FROM grown b WHERE a.id > b.id AND a.user_id = b.user_id AND a.sub_user = b.sub_user
    AND a.keyword_list = b.keyword_list AND a.block_col = b.block_col AND a.critical_col = b.critical_col
    AND a.redacted_col = b.redacted_col AND a.allow_col = b.allow_col)),
  new_policies AS (SELECT * FROM single
    WHERE coalesce(NOT (keyword_list = '*' AND (block_col OR critical_col OR redacted_col)), true)),
  new_organizations AS ({ORACLE['m4_insert_absent_organizations']}),
  new_users AS (SELECT user_id, CASE user_id WHEN 'telecomm-user' THEN 'Telecomm' WHEN 'software-user' THEN 'Software'
      ELSE display_name END AS display_name, role, CASE WHEN user_id = 'telecomm-user' THEN coalesce(org_id, 101)
      WHEN user_id = 'software-user' THEN coalesce(org_id, 102) ELSE org_id END AS org_id
    FROM ({ORACLE['m4_insert_absent_users']}) WHERE user_id NOT IN ('101', '102')),
  new_audit AS (SELECT m.*, CASE k.user_id WHEN 'telecomm-user' THEN '101' WHEN 'Software' THEN '102' ELSE k.user_id END AS user_id
    FROM ({ORACLE['m9_backfill_usage']}) m
    JOIN (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, {LEGACY_USER} FROM documents) k USING (id))""",
    " UNION ALL ".join(f"SELECT '{name}' AS \"table\", {', '.join(columns)} FROM new_{name}"
                       for name, columns in MAINTAINED.items())))
def maintain_all(spark, sf):
    supplier = B.read(spark, sf, "supplier")
    kept = maintain(
        B.read(spark, sf, "documents").selectExpr(*LEGACY, LEGACY_USER), B.users(spark, sf), B.organizations(spark, sf),
        with_copies(spark, sf).withColumnRenamed("critical_col", "critial_col"),
        {"users": B.read(spark, sf, "customer").selectExpr(*USER_CHANGES), "organizations": supplier.selectExpr(*ORG_CHANGES),
         "policies": supplier.selectExpr(*SEEDS)}, B.ALIASES)
    rows = [kept[name].selectExpr(f"'{name}' AS table", *columns) for name, columns in MAINTAINED.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# Streams. The streaming queries run until the input is used up and are compared with the same rules in batch.

def streamed(spark: SparkSession, sf: str, plan: str) -> DataFrame:
    """All requests screened as a stream, started twice, and the same rows appended by a batch job afterwards."""
    path, source = shared_folder(spark, "stream"), written_requests(spark, sf)
    options = Options(aliases=B.ALIASES, policy_plan=plan)
    for _ in range(2):
        R.screen_stream(read_prompts_stream(spark, source, "parquet"), B.dims(spark, sf), f"{path}/audit",
                        checkpoint=f"{path}/checkpoint", options=options, availableNow=True).awaitTermination()
    append_screened(read_prompts(spark, source), B.dims(spark, sf), f"{path}/audit", options)
    return read_audit(spark, f"{path}/audit").select(
        "id", "user_id", "risk_score", "action", "tokens_used", "tokens_saved", stamp("created_at").alias("created_at"))


STREAMED_SQL = over(AUDIT, f"""
SELECT id, user_id, risk_score, action, tokens_used, tokens_saved, {stamp_sql('created_at')} AS created_at FROM audit""")
query("r1_stream_screening", STREAMED_SQL)(lambda spark, sf: streamed(spark, sf, "auto"))
query("r1_stream_screening_by_join", STREAMED_SQL)(lambda spark, sf: streamed(spark, sf, "join"))


SPLIT = "2024-01-15 00:00:00"


@query("r2_stream_suppress_repeats", f"""
WITH RECURSIVE requests AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, CAST(user_id % 5 AS VARCHAR) AS user_id, md5(event_type) AS key, ts
  FROM events UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR), 'late', coalesce(md5(text), '-'), TIMESTAMP '2024-01-01 00:00:00' FROM documents),
firsts AS (SELECT user_id, key, ts, min(request_id) AS request_id FROM requests GROUP BY ALL),
chain AS (SELECT user_id, key, min(ts) AS ts FROM firsts GROUP BY ALL
  UNION ALL SELECT c.user_id, c.key, min(f.ts) FROM chain c JOIN firsts f
    ON f.user_id = c.user_id AND f.key = c.key AND f.ts >= c.ts + INTERVAL 5 MINUTES GROUP BY c.user_id, c.key, c.ts)
SELECT request_id, user_id, {stamp_sql('ts')} AS ts FROM chain JOIN firsts USING (user_id, key, ts)""")
def stream_suppress_repeats(spark, sf):
    """Events as repeats; a second run brings later events and, far behind them, prompts never seen before."""
    path = shared_folder(spark, "repeats")
    events = B.read(spark, sf, "events").selectExpr(
        "'e' || CAST(event_id AS STRING) AS request_id", "CAST(user_id % 5 AS STRING) AS user_id", "event_type AS prompt",
        "CAST(ts AS TIMESTAMP) AS ts")
    late = B.read(spark, sf, "documents").selectExpr(
        "'d' || CAST(doc_id AS STRING) AS request_id", "'late' AS user_id", "text AS prompt",
        "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    split = F.lit(SPLIT).cast("timestamp")
    for rows in (events.where(F.col("ts") < split), events.where(F.col("ts") >= split).unionByName(late)):
        rows.write.mode("append").parquet(f"{path}/in")
        R.suppress_repeats(read_prompts_stream(spark, f"{path}/in", "parquet")).writeStream.format("parquet").option(
            "path", f"{path}/kept").option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return read_prompts(spark, f"{path}/kept").select("request_id", "user_id", stamp("ts").alias("ts"))


@query("r3_running_counters", over(AUDIT, """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE action = 'BLOCK') AS blocked,
  count(*) FILTER (WHERE action = 'REDACT') AS redacted, count(*) FILTER (WHERE action = 'ALERT') AS alerted,
  count(*) FILTER (WHERE action NOT IN ('BLOCK', 'REDACT', 'ALERT')) AS allowed FROM audit GROUP BY user_id"""))
def running_counters(spark, sf):
    return R.running_counters(audit_table(spark, sf))


NOW = "2024-01-30 23:00:00"


@query("r4_liveness", over(BEATS_SQL, f"""
SELECT org_label, "subUser", "browserName", {stamp_sql('max(ts)')} AS last_seen,
  TIMESTAMP '{NOW}' - max(ts) > INTERVAL 90 SECONDS AS stale FROM beats GROUP BY ALL"""))
def liveness(spark, sf):
    return R.with_liveness(R.last_seen(beats(spark, sf)), NOW).withColumn("last_seen", stamp("last_seen"))


@query("r5_windowed_actions", over(AUDIT, f"""
SELECT {stamp_sql('w')} AS window_start, {stamp_sql('w + INTERVAL 5 MINUTES')} AS window_end, action, count(*) AS prompts
FROM (SELECT time_bucket(INTERVAL '5 minutes', created_at) AS w, action FROM audit) GROUP BY ALL"""))
def windowed_actions(spark, sf):
    return R.windowed_actions(audit_table(spark, sf)).withColumns({
        "window_start": stamp("window_start"), "window_end": stamp("window_end")})


CHANGES_SPLIT = "2024-01-15 00:00:00"


@query("r4_liveness_changes", over(BEATS_SQL, f"""
SELECT org_label, "subUser", "browserName", {stamp_sql('changed_at')} AS changed_at, change FROM (
  WITH told AS (
    SELECT DISTINCT org_label, "subUser", "browserName", ts FROM beats),
  near AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after, max(ts) OVER () AS newest FROM told
    WINDOW w AS (PARTITION BY org_label, "subUser", "browserName" ORDER BY ts))
  SELECT *, ts AS changed_at, 'live' AS change FROM near WHERE before IS NULL OR ts - before > INTERVAL 90 SECONDS
  UNION ALL SELECT *, ts + INTERVAL 90 SECONDS AS changed_at, 'stale' AS change FROM near
  WHERE after - ts > INTERVAL 90 SECONDS OR (after IS NULL AND ts + INTERVAL 90 SECONDS < newest - INTERVAL 1 MINUTE))"""))
def liveness_changes(spark, sf):
    """Heartbeats in two runs of one stream, by time; what fell silent is reported by timers."""
    path, source = shared_folder(spark, "liveness"), beats(spark, sf).select(
        "org_label", "subUser", "browserName", F.col("ts").cast("timestamp").alias("ts"))
    split = F.lit(CHANGES_SPLIT).cast("timestamp")
    for rows in (source.where(F.col("ts") < split), source.where(F.col("ts") >= split)):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(HEARTBEATS_NORMAL).parquet(f"{path}/in")
        R.liveness_changes(stream).writeStream.format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{HEARTBEATS_NORMAL.replace('ts timestamp', 'changed_at timestamp')}, change string").parquet(
        f"{path}/out").withColumn("changed_at", stamp("changed_at"))


@query("r1_stream_repeated_batch", STREAMED_SQL)
def stream_repeated_batch(spark, sf):
    """The driver is lost before the sink and the stream note that a batch is written: it comes again, and nothing is written
    twice."""
    path, source = shared_folder(spark, "stream"), written_requests(spark, sf)

    def run():
        R.screen_stream(read_prompts_stream(spark, source, "parquet"), B.dims(spark, sf), f"{path}/audit",
                        checkpoint=f"{path}/checkpoint", options=Options(aliases=B.ALIASES), availableNow=True).awaitTermination()

    run()
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for lost in ("commits/0", "sink/written-0"):
        assert files.delete(place(f"{path}/checkpoint/{lost}"), False)
    run()
    return read_audit(spark, f"{path}/audit").select(
        "id", "user_id", "risk_score", "action", "tokens_used", "tokens_saved", stamp("created_at").alias("created_at"))


@query("x8_detector_hits_observed", ORACLE["x8_detector_hits"])
def detector_hits_observed(spark, sf):
    """Counted while the rows are screened and written, without a second pass."""
    seen = Observation("hits")
    rows = observe_hits(scored(spark, sf, "extended"), (*CORE, "org", *EXTRA), seen)
    rows.select("request_id", "risk_score", "action").write.parquet(shared_folder(spark, "screened"))
    return spark.createDataFrame(observed_hits(seen.get), "detector string, detections bigint, prompts bigint")


@query("s1_malformed_requests", over(BASE, f"""
, lines AS (SELECT request_id, CAST(hash(request_id) AS VARCHAR) AS h, ts, length(prompt) AS chars,
    CASE WHEN request_id LIKE 'd%' THEN CAST(substr(request_id, 2) AS BIGINT) % 5 ELSE 9 END AS kind FROM requests)
SELECT CASE WHEN kind < 2 THEN 'malformed' ELSE 'sound' END AS side, count(*) AS n,
  CAST(sum(CASE WHEN kind >= 2 THEN coalesce(chars, 0) END) AS BIGINT) AS chars FROM lines GROUP BY ALL""".replace(chr(10) + ", lines", ", lines")))
def malformed_requests(spark, sf):
    """Requests as JSON lines, of which two fifths of the documents' are cut off or hold a time that is none."""
    path = shared_folder(spark, "lines")
    rows = B.requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    line = F.to_json(F.struct(*rows.columns))
    kind = F.when(F.startswith("request_id", F.lit("d")), F.substring("request_id", 2, 20).cast("bigint") % 5).otherwise(9)
    broken = F.when(kind == 0, F.substring(line, 1, 40)).when(kind == 1, F.regexp_replace(line, '"ts":"[^"]*"', '"ts":"no time"')).otherwise(line)
    rows.select(broken.alias("value")).write.text(f"{path}/in")
    write_checked(read_prompts_checked(spark, f"{path}/in"), f"{path}/out")
    sound, malformed = read_checked(spark, f"{path}/out")
    return sound.select(F.lit("sound").alias("side"), F.length("prompt").alias("c")).unionByName(
        malformed.select(F.lit("malformed").alias("side"), F.lit(None).cast("int").alias("c"))).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("side") == "sound", F.coalesce("c", F.lit(0)))).alias("chars"))


@query("s1_failed_open", over(BASE, """SELECT 'ALLOW' AS action, count(*) AS n FROM requests
WHERE request_id LIKE 'd%' AND CAST(substr(request_id, 2) AS BIGINT) % 5 = 0"""))
def failed_open(spark, sf):
    """Requests of which nothing can be read are let through, as those that could not be scored are."""
    path = shared_folder(spark, "lines")
    rows = B.requests(spark, sf).where("request_id LIKE 'd%' AND CAST(substr(request_id, 2) AS BIGINT) % 5 = 0")
    rows.select(F.substring(F.to_json(F.struct("request_id", "prompt")), 1, 12).alias("value")).write.text(path)
    return screen(read_prompts_checked(spark, path).drop("_corrupt_record"), B.dims(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# Reports from daily sums: three batches add their rows, and what was added is compacted.

ROLLUPS: dict[tuple[str, str], str] = {}


def rollup_table(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in ROLLUPS:
        path, rows = shared_folder(spark, "rollup"), audit_table(spark, sf)
        for k in range(3):
            U.add_to_rollup(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), f"{path}/added")
        U.compact(spark, f"{path}/added", f"{path}/days")
        ROLLUPS[key] = f"{path}/days"
    return U.read_rollup(spark, ROLLUPS[key])


for _name, _report in {
    "a1_total": U.total_count, "a2_blocked": lambda r: U.count_for_action(r, "BLOCK"), "a3_by_tool": U.count_by_tool,
    "a4_by_risk_type": U.count_by_risk_type, "a5_top_users": U.top_users, "a6_summary": U.summary,
    "a7_risk_summary": U.risk_summary, "a8_user_stats": lambda r: U.user_stats(r, "telecomm-user", B.ALIASES),
}.items():
    query(f"{_name}_from_rollup", ORACLE[_name])(lambda spark, sf, report=_report: report(rollup_table(spark, sf)))


@query("a6_summary_of_period", over(AUDIT, f"""
SELECT {SUMMARY_SQL} FROM audit WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at < TIMESTAMP '2024-01-04 00:00:00'"""))
def summary_of_period(spark, sf):
    rollup_table(spark, sf)
    path = ROLLUPS[spark.sparkContext.applicationId, sf]
    return U.summary(U.read_rollup(spark, path, date(2024, 1, 2), date(2024, 1, 3)))


# Organisation aliases as a table: one organisation an order, some of which share a name; the first in order counts.

FIRMS = ["CAST(o_orderkey AS INT) AS seq", "CAST(200000 + o_orderkey AS STRING) AS org_id",
         "'Firm ' || CAST(o_orderkey % 6000 AS STRING) AS org_name", "'firm-' || CAST(o_orderkey AS STRING) || '-User' AS slug"]
CALLERS = ["CAST(o_orderkey AS STRING) AS caller",
           "CASE o_orderkey % 9 WHEN 0 THEN CAST(200000 + o_orderkey AS STRING) WHEN 1 THEN 'FIRM ' || CAST(o_orderkey % 7000 AS STRING) "
           "WHEN 2 THEN 'firm-' || CAST(o_orderkey AS STRING) || '-User' WHEN 3 THEN 'FIRM-' || CAST(o_orderkey AS STRING) || '-user' "
           "WHEN 4 THEN 'Firm ' || CAST(o_orderkey % 6000 AS STRING) WHEN 5 THEN NULL WHEN 6 THEN ' ' WHEN 7 THEN 'anonymous-user' "
           "ELSE 'somebody' END AS user_id",
           "CASE o_orderkey % 5 WHEN 0 THEN 'FIRM-' || CAST(o_orderkey % 4000 AS STRING) || '-USER' WHEN 1 THEN NULL ELSE 'user1' END AS sub_user"]


def firms(spark: SparkSession, sf: str) -> DataFrame:
    return L.alias_index(B.read(spark, sf, "orders").selectExpr(*FIRMS))


def callers(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "orders").selectExpr(*CALLERS)


def met_sql(name: str, *tests: tuple[str, str]) -> str:
    """The first organisation that one of some equalities finds, as a table of (caller, org_id, org_name)."""
    found = " UNION ALL ".join(f"SELECT caller, seq, org_id, org_name FROM callers c JOIN firms f ON {a} = {b}" for a, b in tests)
    return f"{name} AS (SELECT caller, arg_min(org_id, seq) AS org_id, arg_min(org_name, seq) AS org_name FROM ({found}) GROUP BY caller)"


FIRMS_SQL = (f"firms AS (SELECT {', '.join(FIRMS)} FROM orders), callers AS (SELECT {', '.join(CALLERS)} FROM orders)")
ID, NAME, SLUG = ("user_id", "org_id"), ("lower(user_id)", "lower(org_name)"), ("lower(user_id)", "lower(slug)")
SUB_SLUG = ("lower(sub_user)", "lower(slug)")


def table_queries(name: str, sql: str, run: Callable[..., DataFrame]) -> None:
    """The same with the table broadcast and shuffled."""
    for suffix, small in (("", True), ("_shuffled", False)):
        query(f"{name}_by_table{suffix}", f"WITH {FIRMS_SQL}, {sql}")(
            lambda spark, sf, small=small: run(callers(spark, sf), firms(spark, sf), small=small))


table_queries("p5a_canonical_user", met_sql("met", ID, NAME, SLUG, SUB_SLUG) + f"""
SELECT caller, coalesce(org_name, CASE WHEN user_id IS NULL OR {O.trim('user_id')} = '' THEN 'anonymous-user' ELSE user_id END) AS user_id
FROM callers LEFT JOIN met USING (caller)""", lambda c, i, small: L.canonical_user_by_table(c, i, small).select("caller", "user_id"))
table_queries("p5b_heartbeat_label", met_sql("by_sub", SUB_SLUG) + ", " + met_sql("by_user", ID, NAME, ("user_id", "slug")) + """
SELECT caller, coalesce(s.org_name, u.org_name, user_id) AS org_label
FROM callers LEFT JOIN by_sub s USING (caller) LEFT JOIN by_user u USING (caller)""",
              lambda c, i, small: L.heartbeat_label_by_table(c, i, "org_label", "user_id", "sub_user", small).select("caller", "org_label"))
table_queries("p5c_analytics_id", met_sql("met", ID, NAME, SLUG) + """
SELECT caller, coalesce(org_name, user_id) AS resolved FROM callers LEFT JOIN met USING (caller)""",
              lambda c, i, small: L.analytics_id_by_table(c, i, "resolved", small=small).select("caller", "resolved"))
table_queries("p5d_alternate_id", met_sql("met", NAME) + """
SELECT caller, coalesce(org_id, user_id) AS alternate FROM callers LEFT JOIN met USING (caller)""",
              lambda c, i, small: L.alternate_id_by_table(c, i, "alternate", small=small).select("caller", "alternate"))
table_queries("m10_rekey_audit", met_sql("met", ("user_id", "slug"), ("user_id", "org_name")) + """
SELECT caller, coalesce(org_id, user_id) AS user_id FROM callers LEFT JOIN met USING (caller)""",
              lambda c, i, small: L.rekey_audit_by_table(c, i, small).select("caller", "user_id"))
table_queries("m11_rekey_policies", met_sql("met", ("user_id", "slug")) + """
SELECT caller, coalesce(org_id, user_id) AS user_id FROM callers LEFT JOIN met USING (caller)""",
              lambda c, i, small: L.rekey_policies_by_table(c, i, small).select("caller", "user_id"))
