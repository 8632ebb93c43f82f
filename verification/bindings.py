"""Requests, users, organisations, policies, alerts and heartbeats derived from the given tables.

Every derived table is described once, as SQL expressions that mean the same in both engines; Spark selects them from
its DataFrames and the comparison SQL from its views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenwright.plans.screening import Dimensions
from verification.golden import EDGE_PROMPTS, GOLDEN_PROMPTS

TOOLS = ("ChatGPT", "Claude", "Gemini", "Grok", "DeepSeek", "Copilot", "DashboardTest", "dashboardtest", None)
BROWSERS = ("Chrome", "Edge", None, "Brave")
KEYWORD_LISTS = (
    "thet, ,confidential,secret", "ción,zung", "sim_card,msisdn", "de la,le la", "password,token,api_key", "qqqq,*",
    "Shingle,ANDER", "a-b, ,x_y,the of", "und der", "nda,internal", "breach,attack,exploit", "*", "-,zzz", "qzqz",
)
HOSTS = (
    "chat.openai.com", "chatgpt.com", "gemini.google.com", "copilot.microsoft.com", "claude.ai",
    "www.perplexity.ai", "chat.deepseek.com", "grok.com", "x.com", "openai.claude.example.com", "example.org",
)
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (X11; Linux) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 OPR/106.0",
    "Opera/9.80 (X11; Linux)",
    "Mozilla/5.0 (X11; Linux; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh) AppleWebKit/605.1 Version/17.0 Safari/605.1",
    "Mozilla/5.0 (X11; Linux) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "curl/8.0",
)


# Organisation ids with their name and the account slug that stands for them, as the fixed cases have them.
ALIASES = (("101", "Telecomm", "telecomm-user"), ("102", "Software", "software-user"))


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    """Element of a literal list by a number expression, as a CASE."""
    whens = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {whens} END"


def minutes(n: str, start: str, duck: bool) -> str:
    if duck:
        return f"TIMESTAMP '{start}' + to_minutes(CAST({n} AS BIGINT))"
    return f"timestampadd(MINUTE, CAST({n} AS INT), TIMESTAMP_NTZ '{start}')"


def request_columns(key: str, n: str, text: str, duck: bool) -> list[str]:
    user = (
        f"CASE ({n}) % 12 WHEN 0 THEN '101' WHEN 1 THEN 'telecomm' WHEN 2 THEN 'SOFTWARE-user' WHEN 3 THEN NULL "
        f"WHEN 4 THEN '   ' WHEN 5 THEN 'anonymous-user' WHEN 6 THEN CAST(102 + ({n}) % 7 AS STRING) "
        f"WHEN 7 THEN ' c1 ' ELSE 'c' || CAST(({n}) AS STRING) END"
    )
    subs = ("user1", "USER2", None, "anonymous-sub", " ", "Telecomm-User", "user2")
    return [
        f"{key} AS request_id", f"{user} AS user_id", f"{pick(subs, f'({n}) + 3')} AS sub_user",
        f"{pick(TOOLS, n)} AS tool", f"{pick(BROWSERS, n)} AS browser_name", f"{text} AS prompt",
        f"({n}) % 2 = 0 AS testing", f"{minutes(n, '2024-01-01 00:00:00', duck)} AS ts",
    ]


def document_requests(duck: bool) -> list[str]:
    return request_columns("'d' || CAST(doc_id AS STRING)", "doc_id", "text", duck)


def turn_requests(duck: bool) -> list[str]:
    return request_columns("'t' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)", "conv_id * 31 + turn", "text",
                           duck)


def case_requests(duck: bool) -> list[str]:
    return request_columns("'g' || case_id", "n", "text", duck)


def cases() -> list[tuple[str, int, str | None]]:
    golden = [(case_id, prompt) for case_id, _documented, _score, prompt in GOLDEN_PROMPTS]
    edges = [(f"E{i}", prompt) for i, prompt in enumerate(EDGE_PROMPTS)]
    return [(case_id, n, prompt) for n, (case_id, prompt) in enumerate(golden + edges)]


USERS = [
    "'c' || CAST(c_custkey AS STRING) AS user_id", "c_name AS display_name",
    "CASE c_custkey % 40 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'admin' ELSE 'USER' END AS role",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(101 + floor(c_custkey / 120) AS INT) END AS org_id",
]
ACCOUNTS = (
    ("admin-user", "Admin", "ADMIN", None), ("telecomm-user", "T", "USER", 101), ("software-user", "S", "USER", None),
    ("101", "Old", "USER", 101), ("anonymous-user", "Anon", "ADMIN", 101),
)
# Organisations have eight policies each. By the organisation's number the first one allows everything, one in the
# middle allows something, or none allows anything.
ORG = "CAST(floor(s_suppkey / 8) AS INT)"
POLICIES = [
    "CAST(s_suppkey + 1 AS INT) AS id", f"CAST(101 + {ORG} AS STRING) AS user_id",
    f"{pick(('*', 'user1', 'USER2', 'unknown', '*', 'User2', 'user1', 'unknown'), 's_suppkey')} AS sub_user",
    f"CASE WHEN s_suppkey % 8 = 0 AND {ORG} % 3 = 0 THEN '*' ELSE {pick(KEYWORD_LISTS, f'{ORG} + s_suppkey')} END "
    "AS keyword_list",
    f"(s_suppkey % 8 = 0 AND {ORG} % 3 = 0) OR (s_suppkey % 8 = 4 AND {ORG} % 3 = 1) AS allow_col",
    "s_suppkey % 3 = 0 AS redacted_col",
    "CASE WHEN s_suppkey % 11 = 5 THEN NULL ELSE s_suppkey % 4 = 1 END AS critical_col",
    "s_suppkey % 5 = 2 AS block_col", "'policy ' || CAST(s_suppkey AS STRING) AS prompt_col",
]
ORGANIZATIONS = (
    f"CAST(101 + {ORG} AS INT) AS org_id",
    f"CASE {ORG} WHEN 0 THEN 'Telecomm' WHEN 1 THEN 'Software' ELSE 'Org ' || CAST({ORG} AS STRING) END AS org_name",
)
HEARTBEATS = [
    "event_id",
    "CASE user_id % 9 WHEN 0 THEN '101' WHEN 1 THEN 'telecomm-user' WHEN 2 THEN 'Telecomm-User' WHEN 3 THEN 'software' "
    "WHEN 4 THEN NULL ELSE 'c' || CAST(user_id AS STRING) END AS userId",
    "CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'SOFTWARE-user' WHEN 3 THEN 'telecomm-user' "
    "ELSE 'user1' END AS subUser",
    f"{pick(BROWSERS, 'event_id')} AS browserName", "ts",
]
ALERTS = [
    "event_id",
    "CASE event_type WHEN 'error' THEN 'REMOVE_ATTEMPT' WHEN 'click' THEN 'DISABLE_ATTEMPT' ELSE NULL END AS type",
    "CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'c' || CAST(user_id AS STRING) END AS userId",
    "CASE WHEN event_type = 'view' THEN NULL ELSE event_type || ' by ' || CAST(user_id AS STRING) END AS message",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS timestamp",
]
PAGES = [
    "page_id", f"'https://' || {pick(HOSTS, 'page_id')} || '/' || CAST(page_id AS STRING) AS url",
    f"{pick(AGENTS, 'page_id')} AS user_agent", "page_id % 13 = 5 AS is_brave",
]
RAW_USERS = [
    "CASE c_custkey % 10 WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE 'c' || CAST(c_custkey AS STRING) END AS userId",
    "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS displayName",
    "CASE c_custkey % 5 WHEN 0 THEN 'Admin' WHEN 1 THEN 'user' WHEN 2 THEN NULL WHEN 3 THEN 'root' ELSE 'ADMIN' END "
    "AS role",
    "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'x1' WHEN 2 THEN ' ' WHEN 3 THEN '99999999999' "
    "ELSE CAST(101 + c_nationkey AS STRING) END AS orgId",
]
RAW_ORGANIZATIONS = [
    "CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(200 + s_suppkey AS STRING) END AS orgId",
    "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE s_name END AS orgName",
]
RAW_POLICIES = [
    "s_suppkey AS seq",
    "CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN CAST(100 + s_suppkey AS STRING) "
    "ELSE 'c' || CAST(s_suppkey AS STRING) END AS userId",
    "CASE s_suppkey % 8 WHEN 7 THEN NULL ELSE 'user1' END AS subUser",
    "CASE s_suppkey % 9 WHEN 8 THEN ' ' ELSE 'alpha,beta' END AS keywordList",
    "s_suppkey % 2 = 0 AS blockCol", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 3 = 1 END AS criticalCol",
    "s_suppkey % 4 = 3 AS critialCol", "CASE WHEN s_suppkey % 5 = 0 THEN true END AS redactedCol",
    "s_suppkey % 6 = 0 AS allowCol", "CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS promptCol",
]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def case_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cases(), "case_id string, n bigint, text string").coalesce(1)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, all user turns of conversations and the golden and edge cases.

    The test tables are one file each, which one task would read; only such small inputs are dealt out to all cores.
    """
    documents = read(spark, sf, "documents").selectExpr(*document_requests(False))
    turns = read(spark, sf, "conversations").filter("role = 'user'").selectExpr(*turn_requests(False))
    rows = documents.unionByName(turns).unionByName(case_rows(spark).selectExpr(*case_requests(False)))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def users(spark: SparkSession, sf: str) -> DataFrame:
    accounts = spark.createDataFrame(ACCOUNTS, "user_id string, display_name string, role string, org_id int").coalesce(1)
    return read(spark, sf, "customer").selectExpr(*USERS).unionByName(accounts)


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").selectExpr(*ORGANIZATIONS).distinct()


def policies(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").selectExpr(*POLICIES)


def dims(spark: SparkSession, sf: str) -> Dimensions:
    return Dimensions(users(spark, sf), organizations(spark, sf), policies(spark, sf))


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").selectExpr(*PAGES)


def base_sql() -> str:
    """The same tables as common table expressions."""
    values = ",\n".join(f"({quote(c)}, CAST({n} AS BIGINT), {quote(t)})" for c, n, t in cases())
    accounts = ", ".join(
        f"({quote(u)}, {quote(d)}, {quote(r)}, CAST({'NULL' if o is None else o} AS INT))" for u, d, r, o in ACCOUNTS)
    return f"""
cases(case_id, n, text) AS (VALUES {values}),
requests AS (
  SELECT {', '.join(document_requests(True))} FROM documents
  UNION ALL SELECT {', '.join(turn_requests(True))} FROM conversations WHERE role = 'user'
  UNION ALL SELECT {', '.join(case_requests(True))} FROM cases),
users AS (
  SELECT {', '.join(USERS)} FROM customer
  UNION ALL SELECT * FROM (VALUES {accounts}) AS a(user_id, display_name, role, org_id)),
organizations AS (SELECT DISTINCT {', '.join(ORGANIZATIONS)} FROM supplier),
policies AS (SELECT {', '.join(POLICIES)} FROM supplier),
visits AS (SELECT {', '.join(PAGES)} FROM pages),
heartbeats AS (SELECT {', '.join(HEARTBEATS)} FROM events),
alerts AS (SELECT {', '.join(ALERTS)} FROM events),
raw_users AS (SELECT {', '.join(RAW_USERS)} FROM customer),
raw_organizations AS (SELECT {', '.join(RAW_ORGANIZATIONS)} FROM supplier),
raw_policies AS (SELECT {', '.join(RAW_POLICIES)} FROM supplier)"""
