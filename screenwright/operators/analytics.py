"""Reports over the audit table, users, organisations and policies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.tokens import exact_sum
from screenwright.operators.lookups import lookup_join

ACTIONS = (("blockedPrompts", "BLOCK"), ("redactedPrompts", "REDACT"), ("alertedPrompts", "ALERT"),
           ("allowedPrompts", "ALLOW"))
LOG_FIELDS = {
    "id": "id", "userId": "user_id", "tool": "tool", "browserName": "browser_name",
    "originalPrompt": "original_prompt", "redactedPrompt": "redacted_prompt",
    "highestRiskType": "highest_risk_type", "riskScore": "risk_score", "riskLevel": "risk_level",
    "action": "action", "actionReason": "action_reason", "tokensUsed": "tokens_used",
    "tokensSaved": "tokens_saved", "costUsed": "cost_used", "costSaved": "cost_saved", "timestamp": "created_at",
}
TOKEN_LOG_FIELDS = tuple(f for f in LOG_FIELDS if f not in ("highestRiskType", "riskScore", "riskLevel"))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def total_count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("total"))


def count_for_action(audit: DataFrame, action: str) -> DataFrame:
    return audit.filter(F.col("action") == action).agg(F.count(F.lit(1)).alias("total"))


def count_by_tool(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tool").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tool")


def count_by_risk_type(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.col("highest_risk_type").alias("riskType")).agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "riskType")


def top_users(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("action") == "BLOCK").alias("blocked"),
    ).orderBy(F.desc("total"), "user_id").limit(n)


def summary(audit: DataFrame) -> DataFrame:
    """All counters and sums in one pass; zeros for an empty table."""
    return audit.agg(
        F.count(F.lit(1)).alias("totalPrompts"),
        *[count_if(F.col("action") == action).alias(name) for name, action in ACTIONS],
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokensUsed"),
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokensSaved"),
        exact_sum(F.col("cost_used")).alias("costUsed"),
        exact_sum(F.col("cost_saved")).alias("costSaved"),
    )


def risk_summary(audit: DataFrame) -> DataFrame:
    return with_block_rate(summary(audit))


def with_block_rate(totals: DataFrame) -> DataFrame:
    """A summary with the share of blocked prompts, rounded half up to whole percent."""
    percent = F.floor(F.try_divide(F.col("blockedPrompts").cast("double"), F.col("totalPrompts")) * 100 + F.lit(0.5))
    return totals.withColumn(
        "blockRate",
        F.when(F.col("totalPrompts") > 0, F.concat(percent.cast("bigint").cast("string"), F.lit("%"))).otherwise("0%"))


def report_ids(user_id: str | None, aliases=()) -> list[str] | None:
    """Ids a report for ``user_id`` matches: its canonical name and the alternate id. None stands for everyone."""
    if user_id is None:
        return None
    resolved = alternate = user_id
    for org_id, name, slug in aliases:
        if user_id == org_id or user_id.lower() in (name.lower(), slug.lower()):
            resolved = name
            break
    for org_id, name, _slug in aliases:
        if resolved.lower() == name.lower():
            alternate = org_id
            break
    else:
        alternate = resolved
    return [resolved] if resolved == alternate else [resolved, alternate]


def required_ids(user_id: str | None, aliases=()) -> list[str]:
    if user_id is None or not user_id.strip():
        raise ValueError("userId is required")
    return report_ids(user_id, aliases)


def of_user(audit: DataFrame, ids: list[str]) -> DataFrame:
    return audit.filter(F.col("user_id").isin(ids))


def user_stats(audit: DataFrame, user_id: str | None, aliases=()) -> DataFrame:
    return summary(of_user(audit, required_ids(user_id, aliases)))


def newest_first(logs: DataFrame) -> DataFrame:
    """Latest first, rows without a time on top; the id makes the order total and keeps equal times splittable."""
    return logs.orderBy(F.desc_nulls_first("timestamp"), "id")


def log_projection(audit: DataFrame, fields=tuple(LOG_FIELDS)) -> DataFrame:
    return audit.select(*[F.col(LOG_FIELDS[f]).alias(f) for f in fields])


def recent_logs(audit: DataFrame) -> DataFrame:
    return newest_first(log_projection(audit))


def token_logs(audit: DataFrame, kind: str, ids: list[str] | None = None) -> DataFrame:
    """Rows that used (``kind="used"``) or saved (``"saved"``) tokens, for everyone or for some ids."""
    rows = audit.filter(F.col({"used": "tokens_used", "saved": "tokens_saved"}[kind]) > 0)
    if ids is not None:
        rows = of_user(rows, ids)
    return newest_first(log_projection(rows, TOKEN_LOG_FIELDS))


def token_report(audit: DataFrame, user_id: str | None = None, aliases=()) -> dict[str, DataFrame]:
    """Totals and both logs, for everyone (no id, an empty one or ``ALL``) or one user."""
    ids = None if not user_id or user_id == "ALL" else report_ids(user_id, aliases)
    scope = audit if ids is None else of_user(audit, ids)
    totals = summary(scope).select(
        F.col("tokensUsed").alias("totalTokensUsed"), F.col("costUsed").alias("totalCostUsed"),
        F.col("tokensSaved").alias("totalTokensSaved"), F.col("costSaved").alias("totalCostSaved"))
    return {"totals": totals, "usedLogs": token_logs(audit, "used", ids), "savedLogs": token_logs(audit, "saved", ids)}


def my_prompts(audit: DataFrame, user_id: str | None, aliases=()) -> DataFrame:
    return recent_logs(of_user(audit, required_ids(user_id, aliases)))


def user_list(users: DataFrame) -> DataFrame:
    return users.select("user_id", "display_name", "role").orderBy(F.desc_nulls_first("role"), "user_id")


def users_with_organizations(users: DataFrame, organizations: DataFrame) -> DataFrame:
    joined = lookup_join(users, organizations, ["org_id"], "user_id")
    return joined.select("user_id", "display_name", "role", "org_id", "org_name").orderBy(
        F.desc_nulls_first("role"), "user_id")


def organization_list(organizations: DataFrame, org_id: int | None = None) -> DataFrame:
    rows = organizations if org_id is None else organizations.filter(F.col("org_id") == org_id)
    return rows.select("org_id", "org_name").orderBy("org_id")


def policy_list(policies: DataFrame, user_id: str | None = None, users: DataFrame | None = None) -> DataFrame:
    """All policies, or those of one organisation key or, given ``users``, of an account's organisation.

    An all-digit id is an organisation. An account that is unknown or has no organisation stands for itself. Should an
    account occur more than once, its lowest organisation counts.
    """
    if user_id is None or not user_id.strip():
        return policies.orderBy("user_id", "sub_user", "id")
    key = F.lit(user_id)
    if users is not None and not re.fullmatch(r"[0-9]+", user_id):
        org = users.filter(F.col("user_id") == user_id).agg(F.min("org_id").cast("string").alias("_org"))
        # One row, so the join repeats nothing.
        policies = policies.join(F.broadcast(org), F.col("user_id") == F.coalesce("_org", key)).drop("_org")
    else:
        policies = policies.filter(F.col("user_id") == key)
    return policies.orderBy("sub_user", "id")


def role_lookup(ids: DataFrame, users: DataFrame, user_id: str = "user_id") -> DataFrame:
    """Role of each id; unknown, blank and anonymous ids are plain users that do not exist."""
    known = users.filter((F.col("user_id") != "anonymous-user") & F.col("user_id").rlike(r"\S")).select(
        F.col("user_id").alias(user_id), F.coalesce("role", F.lit("USER")).alias("_role"))
    joined = lookup_join(ids, known, [user_id])
    return joined.withColumns({
        "role": F.coalesce("_role", F.lit("USER")), "exists": F.col("_role").isNotNull(),
    }).drop("_role")


def authorize_removal(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests to remove or disable the client into decisions and alerts.

    Only the exact role ADMIN is allowed; everyone else produces an alert.
    """
    decided = role_lookup(requests, users).withColumn("allowed", F.col("exists") & (F.col("role") == "ADMIN"))
    removal = F.col("request_type") == "uninstall"
    verb = F.when(removal, "remove").otherwise("disable")
    alerts = decided.filter(~F.col("allowed")).select(
        F.when(removal, "REMOVE_ATTEMPT").otherwise("DISABLE_ATTEMPT").alias("type"),
        F.col("user_id").alias("userId"),
        F.concat(F.lit('User "'), F.col("user_id"), F.lit('" tried to '), verb, F.lit(" the extension!")).alias("message"),
        F.col("ts").alias("timestamp"),
    )
    return decided.select("request_type", "user_id", "ts", "allowed"), alerts


def table_counts(users: DataFrame, organizations: DataFrame, policies: DataFrame) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, t in (("organizations", organizations), ("users", users), ("policies", policies))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
