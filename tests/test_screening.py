"""Policies, score, redaction, usage and the whole job, against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.text import normalise, utf16_length
from screenwright.functions.tokens import cost, count_tokens, response_tokens
from screenwright.operators import lookups
from screenwright.operators.detectors import add_text_columns
from screenwright.operators import org_policy
from screenwright.operators.org_policy import detect_org_keywords
from screenwright.operators.scoring import decide, redact, top_risk_type, total_score
from screenwright.operators.prepare import with_org_key
from screenwright.plans import screening
from screenwright.plans.screening import Dimensions, Options, audit, screen
from screenwright.schemas import AUDIT_COLUMNS, POLICIES, PROMPTS, USERS
from screenwright.sources.tables import read_prompts
from verification.bindings import ALIASES

P = "id int, user_id string, sub_user string, keyword_list string, allow_col boolean, redacted_col boolean, critical_col boolean, block_col boolean, prompt_col string"


def norm(text):
    lowered = "".join(c for c in (text or "").lower() if c not in ".-_*/|\\+=[]{}()")
    return " ".join(lowered.replace("\x0b", " ").split())


def org_hits(prompt, sub, policies):
    """The policy rules, one request at a time."""
    found, low, n = [], prompt.lower(), norm(prompt)
    for p in sorted(policies, key=lambda p: p[0]):
        _id, _org, p_sub, words, allow, redacted, critical, block, _ = p
        if p_sub != "*" and p_sub.lower() != sub.lower():
            continue
        for word in (w.strip() for w in words.split(",")):
            if not word:
                continue
            needle = word.lower().replace(" ", "").replace("-", "").replace("_", "")
            if word == "*" or word.lower() in low or needle in n:
                if allow:
                    return found, True
                score = 100 if block else 55 if critical else 75 if redacted else 0
                if score:
                    found.append((score, word))
                break
    return found, False


@pytest.fixture(scope="module")
def policy_case():
    rng = random.Random(7)
    words = ["alpha", "be ta", "ga-mma", "-", "*", "de_lta", " ", "Epsilon", "zz"]
    policies = [
        (i, str(rng.choice([1, 2, 3])), rng.choice(["*", "user1", "USER2"]), ",".join(rng.choices(words, k=3)),
         rng.random() < 0.15, rng.choice([True, False, None]), rng.choice([True, False, None]),
         rng.random() < 0.3, "") for i in range(1, 31)]
    texts = ["alpha beta", "be ta gamma", "GA-MMA here", "nothing", "delta epsilon", "d-e-l-t-a"]
    prompts = [(f"r{i}", str(rng.choice([1, 2, 3, 4])), rng.choice(["user1", "user2", "other"]), rng.choice(texts))
               for i in range(60)]
    return policies, prompts


@pytest.mark.parametrize("plan", ["broadcast", "join"])
def test_policies_match_the_rules_in_both_plans(spark, policy_case, plan):
    policies, prompts = policy_case
    df = spark.createDataFrame(prompts, "request_id string, org_key string, sub_user string, prompt string").coalesce(2)
    table = spark.createDataFrame(policies, P).coalesce(2)
    got = {r.request_id: r._found_org for r in detect_org_keywords(add_text_columns(df), table, plan=plan).collect()}
    assert len(got) == len(prompts)
    for request_id, org, sub, text in prompts:
        hits, stopped = org_hits(text, sub, [p for p in policies if p[1] == org])
        direct = [(d.score, d.matched_value) for d in got[request_id] if d.description.startswith("L1")]
        assert direct == hits, (request_id, org, sub, text)
        if hits and not stopped:
            assert len(got[request_id]) == len(hits)


def test_a_text_meets_only_the_bands_before_its_stop(spark, monkeypatch):
    """Bands rise with the ids of policies, so keywords far behind a stop are not compared with the text."""
    monkeypatch.setattr(org_policy, "CHUNK_WORDS", 10)
    policies = spark.range(200).selectExpr("CAST(id AS INT) AS id", "'7' AS user_id", "'*' AS sub_user", "concat('alpha,w', id) AS keyword_list",
                                           "id = 20 AS allow_col", "true AS redacted_col", "false AS critical_col", "false AS block_col").coalesce(1)
    cleaned = org_policy.clean_policies(policies)
    placed = cleaned.join(org_policy.bands(cleaned), "org_key").select("id", org_policy.band_of(F.col("id")).alias("band")).orderBy("id").collect()
    assert [r.band for r in placed] == sorted(r.band for r in placed) and len({r.band for r in placed}) > 20
    assert max(r.id for r in placed if r.band <= placed[20].band) < 40
    df = add_text_columns(spark.createDataFrame([("7", "u", "the alpha w150 plan")], "org_key string, sub_user string, prompt string").coalesce(1))
    found = detect_org_keywords(df, policies, plan="join").first()._found_org
    assert found == detect_org_keywords(df, policies, plan="broadcast").first()._found_org and len(found) == 20


def test_an_organisation_in_chunks_gives_the_same(spark, policy_case, monkeypatch):
    """Every organisation of more than three keywords is cut; nulls, blanks and repeated texts included."""
    policies, prompts = policy_case
    prompts = [*prompts, *(("again" + p[0], *p[1:]) for p in prompts), ("n1", None, "user1", "alpha"), ("n2", "1", None, "alpha"),
               ("n3", "1", "user1", None), ("n4", "1", "user1", " "), ("n5", "none", "user1", "alpha")]
    df = add_text_columns(spark.createDataFrame(prompts, "request_id string, org_key string, sub_user string, prompt string"))
    table = spark.createDataFrame([*policies, (999, "2", "*", None, False, False, False, True, "")], P)
    want = detect_org_keywords(df, table, plan="broadcast").select("request_id", "_found_org").collect()
    monkeypatch.setattr(org_policy, "CHUNK_WORDS", 3)
    large = org_policy.large_organisations(org_policy.clean_policies(table)).collect()
    assert large and max(r._chunks for r in large) > 2
    got = detect_org_keywords(df, table, plan="join").select("request_id", "_found_org").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("small", [True, False])
def test_keywords_are_found_by_equal_pieces(spark, small):
    """What ``held`` finds is what a comparison of all texts with all keywords finds, long tokens and long parts included."""
    rng = random.Random(3)
    syllables = ["a", "th", "é", "on", "ß", "x-y", "_", ".", "-", "漢字", "\t", " ", "  ", "*", "in", "(z)"]
    prompts = ["".join(rng.choices(syllables, k=rng.randint(1, 30))) for _ in range(60)]
    prompts += ["A" * 200 + "needle" + "B" * 200, "pre" + "longer-part-than-a-piece" * 3, "one two\nthree", "d-e-l-t-a"]
    words = {"".join(rng.choices(syllables, k=rng.randint(1, 4))).strip().lower() for _ in range(300)} - {""}
    words |= {"*", "-", "aneedleb", "longer-part-than-a-piece", "longer-part-than-a-pieces", "two\nthree", "two three", "delta", "a" * 60, "b" * 201}
    df = add_text_columns(spark.createDataFrame([(f"t{i}", "1", "u", p) for i, p in enumerate(prompts)], "_text string, org_key string, sub_user string, prompt string"))
    listed = spark.createDataFrame([("1", w) for w in sorted(words)], "org_key string, lower string")
    got = org_policy.held(df.select("_text", "org_key", "sub_user", "_lower", "_norm"), listed, small).collect()
    needles = {w: w.replace(" ", "").replace("-", "").replace("_", "") for w in words}
    texts = {r._text: (r._lower, r._norm) for r in df.collect()}
    want = {(t, w) for t, (low, n) in texts.items() for w in words if w == "*" or w in low or needles[w] in n}
    assert {(r._text, r.lower) for r in got} == want and len(got) == len(want) > 500


def test_keywords_behind_others_they_hold_are_left_out(spark):
    """The comparisons of a huge organisation's keywords are few: those that cannot be the first one found are not looked for."""
    keywords = "in,inside,And,and,an,a-b,ab,a b," + ",".join(f"within{i}" for i in range(500))
    table = spark.createDataFrame([(1, "1", "*", keywords, False, True, False, False, "")], P)
    cleaned = org_policy.clean_policies(table).withColumn("_band", F.lit(0))
    assert [(r.pos, r.word) for r in org_policy.spread_words(cleaned).orderBy("pos").collect()] == [
        (0, "in"), (2, "And"), (4, "an"), (5, "a-b"), (6, "ab"), (7, "a b")]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_rounds_and_late_stops_give_the_same(spark, monkeypatch, rows):
    """Stops in several rounds, early and late ones, texts without a stop, long policies; words broadcast or not."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcde" for b in "xyz"] + ["by-c", "DZ_ax", "-", "a x"]
    policies = [(i, org, rng.choice(["*", "user1", "USER2"]), ",".join(rng.choices(words, k=rng.randint(1, 6))), rng.random() < 0.15,
                 rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3, "") for i in range(1, 121) for org in ("1", "2")]
    policies += [(i, "3", "*", ",".join(rng.choices(words, k=4)), False, True, False, False, "") for i in range(1, 21)]
    prompts = [(f"r{i}", rng.choice(["1", "2", "3"]), rng.choice(["user1", "user2", "other"]), " ".join(rng.choices([*words, "qq"], k=rng.randint(1, 3))))
               for i in range(80)] + [("none", "1", "other", "qq")]
    df = add_text_columns(spark.createDataFrame(prompts, "request_id string, org_key string, sub_user string, prompt string"))
    table = spark.createDataFrame(policies, P)
    want = detect_org_keywords(df, table, plan="broadcast").select("request_id", "_found_org").collect()
    for name, value in (("CHUNK_WORDS", 20), ("ROUND_WORDS", 2), ("EARLY", 0.5), ("MET_ROWS", rows), ("HEADS", 16)):
        monkeypatch.setattr(org_policy, name, value)
    got = detect_org_keywords(df, table, plan="join").select("request_id", "_found_org").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and max(len(r._found_org) for r in want) > 3


def test_policies_need_an_organisation_and_a_sub_user(spark):
    df = spark.createDataFrame([("a", None, "u", "alpha"), ("b", "1", None, "alpha")],
                               "request_id string, org_key string, sub_user string, prompt string")
    table = spark.createDataFrame([(1, "1", "*", "alpha", False, False, False, True, "")], P)
    for plan in ("broadcast", "join"):
        rows = detect_org_keywords(add_text_columns(df), table, plan=plan).collect()
        assert [r._found_org for r in rows] == [[], []]


@pytest.mark.parametrize("plan", ["broadcast", "join"])
def test_policies_need_no_request_id(spark, plan):
    """Null and repeated ids: every request is judged by its own text."""
    df = spark.createDataFrame([(None, "1", "u", "alpha"), (None, "1", "u", "calm"), ("a", "1", "u", "alpha"), ("a", "1", "u", "calm")],
                               "request_id string, org_key string, sub_user string, prompt string")
    table = spark.createDataFrame([(1, "1", "*", "alpha", False, False, False, True, "")], P)
    rows = detect_org_keywords(add_text_columns(df), table, plan=plan).collect()
    assert sorted((r.prompt, len(r._found_org)) for r in rows) == [("alpha", 1), ("alpha", 1), ("calm", 0), ("calm", 0)]


def test_broadcast_refuses_large_policies(spark, monkeypatch):
    monkeypatch.setattr("screenwright.operators.org_policy.POLICY_ROWS", 0)
    df = spark.createDataFrame([("a", "1", "u", "alpha")], "request_id string, org_key string, sub_user string, prompt string")
    table = spark.createDataFrame([(1, "1", "*", "alpha", False, False, False, True, "")], P)
    with pytest.raises(ValueError, match="too large"):
        detect_org_keywords(add_text_columns(df), table, plan="broadcast")
    assert len(detect_org_keywords(add_text_columns(df), table).first()._found_org) == 1


def test_large_lookup_is_salted_and_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").cast("string").alias("rid"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"))
    dim = spark.range(400).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).union(
        spark.sql("select 'hot', -1L"))
    small = lookups.lookup_join(df, dim, ["k"], "rid")
    monkeypatch.setattr(lookups, "is_small", lambda dim: False)
    large = lookups.lookup_join(df, dim, ["k"], "rid")
    hot = {r.k: r._buckets for r in lookups.hot_keys(df, ["k"]).collect()}
    # Quarters of a mean partition of 8: the key holds 167 of 500 rows, null 67.
    assert hot == {"hot": 11, None: 5}
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_is_small_measures_rows_and_text(spark):
    dim = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert lookups.is_small(dim)
    assert not lookups.is_small(dim, max_rows=99)
    assert not lookups.is_small(dim, max_bytes=50_000)


def found(spark, rows):
    items = ", ".join(f"named_struct('detector','d','risk_type','{t}','score',{s},'description','','matched_value',{m})"
                      for t, s, m in rows)
    return spark.sql(f"SELECT array({items}) AS detections, 'a.b and a.b and c' AS prompt")


def test_ties_go_to_the_first_detection(spark):
    df = found(spark, [("PII", 70, "'a.b'"), ("PHI", 70, "'c'"), ("SECRET", 20, "'x'")])
    assert df.select(total_score(F.col("detections")), top_risk_type(F.col("detections"))).first()[:] == (70, "PII")


def test_redaction_follows_the_order_and_stops_at_a_wildcard(spark):
    df = found(spark, [("PII", 70, "'a.b'"), ("KEYWORD", 60, "'PII'"), ("PHI", 70, "' '"), ("PHI", 70, "NULL")])
    assert df.select(redact(F.col("prompt"), F.col("detections"))).first()[0] == (
        "[REDACTED-[REDACTED]] and [REDACTED-[REDACTED]] and c")
    df = found(spark, [("PII", 70, "'a.b'"), ("ORG_KEYWORD", 75, "'*'")])
    assert df.select(redact(F.col("prompt"), F.col("detections"))).first()[0] == "[REDACTED-ORG]"
    df = found(spark, [("PII", 70, "'not there'")])
    assert df.select(redact(F.col("prompt"), F.col("detections"))).first()[0] == "a.b and a.b and c"


def test_bands(spark):
    scores = spark.createDataFrame([(s,) for s in (0, 1, 39, 40, 59, 60, 79, 80, 100, None)], "s int").coalesce(1)
    assert [r[0] for r in scores.select(decide(F.col("s"))).collect()] == [
        "ALLOW", "ALLOW", "ALLOW", "ALERT", "ALERT", "REDACT", "REDACT", "BLOCK", "BLOCK", "ALLOW"]


def expected_answer(text):
    if not (text or "").strip():
        return 100
    low, size = text.lower(), -(-len(text) // 4)
    e = max(300, size * 3)
    if any(w in low for w in C.LONG_FORM):
        e = max(1200, e * 2)
    if any(w in low for w in C.CODE_FORM):
        e = max(600, e + 400)
    if any(w in low for w in C.SHORT_FORM):
        e = min(e, max(150, size // 2))
    for phrase, tokens in C.WORD_COUNT_TOKENS:
        if phrase in low:
            e = tokens
    return min(4000, max(100, e))


def test_token_estimates(spark):
    texts = ["", " ", "hi", "x" * 401, "write an essay with code", "summarize " + "y" * 5000, "fix the class",
             "500 words or 1000 words", "an article " + "z" * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", response_tokens(F.col("t")).alias("answer"), count_tokens(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.answer == expected_answer(r.t), r.t[:30]
        assert r.n == (0 if not r.t.strip() else -(-len(r.t) // 4))
    assert df.select(utf16_length(F.lit("a\U0001f600"))).first()[0] == 3
    money = spark.sql("SELECT explode(array('ChatGPT', 'my-claude', null, 'Grok', 'DeepSeek x')) AS tool")
    got = [round(r[0], 10) for r in money.select(cost(F.col("tool"), F.lit(1_000_000), F.lit(1_000_000))).collect()]
    assert got == [12.5, 18.0, 15.0, 12.0, 0.42]


def test_normalise_agrees_with_plain_python(spark):
    texts = ["A.b-C_(d)", " x \t\n y\x0b\x0cz ", "a  -  b", "\x01\x02edge\x03", "ÉTÉ [1]{2}=+|\\/*", None, "tab\r\nend "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(normalise(F.col("t"))).collect()]
    want = [norm(t).strip("".join(map(chr, range(33)))) for t in texts]
    assert got == want


@pytest.fixture(scope="module")
def tables(spark):
    requests = [
        ("1", "101", None, "ChatGPT", None, "my ssn 123-45-6789 mail a@example.com", False),
        ("2", "kim", "user1", None, "Edge", "the alpha plan", False),
        ("3", " ", "anonymous-sub", "DashboardTest", None, "hello there", True),
        ("4", "kim", "user1", "Claude", "Edge", "the alpha plan", True),
        ("5", None, "SOFTWARE-user", "grok", "Edge", None, False),
    ] + [(f"h{i}", "kim", "user1", "Claude", None, "the alpha plan", False) for i in range(40)]
    df = spark.createDataFrame([(*r, None) for r in requests], PROMPTS).coalesce(2)
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    users = spark.createDataFrame([("kim", "Kim", "USER", 7, None)], USERS)
    orgs = spark.createDataFrame([(7, "Seven"), (101, "Telecomm")], "org_id int, org_name string")
    policies = spark.createDataFrame([(1, "7", "*", "alpha", False, True, False, False, ""),
                                      (2, "101", "*", "ssn", False, False, False, True, "")], POLICIES)
    return df, Dimensions(users, orgs, policies)


def test_screening_end_to_end(spark, tables):
    rows = {r.request_id: r for r in screen(*tables, Options(aliases=ALIASES)).collect()}
    assert rows["1"].user_id == "Telecomm" and rows["1"].action == "REDACT"
    assert rows["1"].redacted_prompt == "my ssn [REDACTED-PII] mail [REDACTED-PII]"
    assert (rows["2"].action, rows["2"].highest_risk_type, rows["2"].redacted_prompt) == (
        "REDACT", "ORG_KEYWORD", "the [REDACTED-ORG] plan")
    assert rows["3"].user_id == "anonymous-user" and rows["3"].sub_user == "unknown"
    assert (rows["5"].user_id, rows["5"].action, rows["5"].detections) == ("Software", "ALLOW", [])
    by_name = {r.request_id: r for r in screen(*tables, Options(org_key_mode="by_name", aliases=ALIASES)).collect()}
    assert by_name["1"].action == "BLOCK" and by_name["1"].highest_risk_type == "ORG_KEYWORD"


def test_audit_rows(spark, tables):
    rows = audit(*tables)
    assert tuple(rows.columns) == AUDIT_COLUMNS
    got = {r.original_prompt: r for r in rows.collect()}
    assert rows.count() == 44 and "hello there" not in got
    redacted = got["my ssn 123-45-6789 mail a@example.com"]
    original = count = -(-len("my ssn 123-45-6789 mail a@example.com") // 4) + 300
    assert redacted.tokens_used + redacted.tokens_saved >= original and count > 0
    assert got[None].tokens_used == 100


def test_reuse_gives_the_same_rows_and_moves_prompts_once(spark, tables):
    requests, dims = tables
    # Many copies of one prompt, so that its digest is spread over buckets.
    copies = requests.where("prompt like 'my ssn%'").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(200))))
    requests = requests.unionByName(copies.withColumn("request_id", F.concat("request_id", F.lit("-"), "_n")).drop("_n"))
    columns = ["request_id", "risk_score", "action", "redacted_prompt", "detections"]
    plain = sorted(map(str, screen(requests, dims).select(columns).collect()))
    reused = screen(requests, dims, reuse=True).select(columns)
    plan = reused._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Window [" in line for line in plan) == 2
    assert sum("Exchange hashpartitioning(_key" in line and "_salt" in line for line in plan) == 1
    assert sorted(map(str, reused.collect())) == plain


def test_dimensions_are_measured_once(spark, tables, monkeypatch):
    requests, dims = tables
    dims = screening.Dimensions(dims.users, dims.organizations, dims.policies)
    measured = []
    monkeypatch.setattr("screenwright.operators.prepare.is_small", lambda *a: measured.append("users") or True)
    monkeypatch.setattr("screenwright.operators.org_policy.is_small", lambda *a: measured.append("policies") or True)
    screen(requests, dims), screen(requests, dims)
    assert sorted(measured) == ["policies", "users"]


def test_a_user_of_several_organisations_does_not_multiply_requests(spark):
    users = spark.createDataFrame([("u", 7), ("u", 5), ("u", None)], "user_id string, org_id bigint")
    out = with_org_key(spark.createDataFrame([("u",)], "user_id string"), users).collect()
    assert [tuple(r) for r in out] == [("u", "5")]


def test_a_filter_on_the_result_does_not_screen_twice(spark, tables):
    plan = audit(*tables).filter("tokens_saved > 0 AND action = 'REDACT' AND user_id = 'kim'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(C.INJECTION_PATTERNS[1]) == 1


def test_a_condition_on_requests_reaches_the_reader(spark, tables, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    requests, dims = tables
    requests.write.parquet(str(tmp_path / "requests"))
    source = read_prompts(spark, str(tmp_path / "requests"))
    some = audit(source, dims, where="ts >= timestamp'2024-01-01 00:00:00' AND user_id = 'kim'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(user_id,kim)" in plan
    assert some.count() == 42
    assert audit(source, dims, where=F.col("ts") > "2024-01-02").count() == 0


def test_no_aliases_are_built_in(spark, tables):
    rows = {r.request_id: r.user_id for r in screen(*tables).collect()}
    assert (rows["1"], rows["5"]) == ("101", "anonymous-user")


def exchanged(df) -> list[list[str]]:
    """The columns that each shuffle of a plan carries."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            out.append([node.output().apply(i).name() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_screening_moves_no_prompts_and_runs_no_python(spark, tables):
    plan = screen(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "prompt" not in line
    for node in exchanged(screen(*tables)):
        assert not any(column.startswith(("prompt", "_lower", "_norm")) for column in node), node  # users and policies only


def test_admin_org_key_leaves_numbers_alone(spark, tables):
    _, dims = tables
    ids = spark.createDataFrame([("kim",), ("7",), (" ",), (None,), ("none",)], "user_id string").coalesce(1)
    got = [r.org_key for r in with_org_key(ids, dims.users, numeric_as_is=True).collect()]
    assert got == ["7", "7", " ", None, "none"]
