"""The audit row of a screened request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.text import is_blank, java_trim, settled
from screenwright.functions.tokens import cost, count_tokens, response_tokens
from screenwright.schemas import AUDIT_COLUMNS


def storable(df: DataFrame) -> DataFrame:
    """Leave out test traffic of the dashboard; other test traffic is kept."""
    dashboard = F.coalesce(F.col("testing"), F.lit(False)) & (
        F.lower(F.coalesce(F.col("tool"), F.lit("Unknown"))) == "dashboardtest")
    return df.filter(~dashboard)


def audit_user(user_id: Column) -> Column:
    return F.when(is_blank(user_id), "anonymous-user").otherwise(java_trim(user_id))


def with_usage(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Add tokens and cost, split into used and saved by the action."""
    tool = F.coalesce(F.col("tool"), F.lit("Unknown"))
    redacted = F.col("action") == "REDACT"
    # Only a redacted prompt has a second text to estimate.
    df = df.withColumns({
        "_in": count_tokens(F.col(prompt)),
        "_out": response_tokens(F.col(prompt)),
        "_in_red": F.when(redacted, count_tokens(F.col("redacted_prompt"))),
        "_out_red": F.when(redacted, response_tokens(F.col("redacted_prompt"))),
    })
    df = df.withColumns({
        "_tokens": F.col("_in") + F.col("_out"),
        "_cost": cost(tool, F.col("_in"), F.col("_out")),
        "_tokens_red": F.col("_in_red") + F.col("_out_red"),
        "_cost_red": cost(tool, F.col("_in_red"), F.col("_out_red")),
    })

    def split(total: str, after: str, zero) -> tuple[Column, Column]:
        used = F.when(F.col("action") == "BLOCK", zero).when(redacted, F.col(after)).otherwise(F.col(total))
        saved = (F.when(F.col("action") == "BLOCK", F.col(total))
                 .when(redacted, F.greatest(zero, F.col(total) - F.col(after))).otherwise(zero))
        return used, saved

    tokens_used, tokens_saved = split("_tokens", "_tokens_red", F.lit(0))
    cost_used, cost_saved = split("_cost", "_cost_red", F.lit(0.0))
    return df.withColumns({
        "tokens_used": settled(tokens_used), "tokens_saved": settled(tokens_saved),
        "cost_used": settled(cost_used), "cost_saved": settled(cost_saved),
    }).drop("_in", "_out", "_in_red", "_out_red", "_tokens", "_cost", "_tokens_red", "_cost_red")


def audit_id(prompt: str = "prompt") -> Column:
    """Hash of the key of a prepared request; without a key it is known by its user, sub-user, tool, prompt and time."""
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-"))
             for c in ("user_id", "sub_user", "tool", prompt, "ts")]
    unnamed = F.concat(F.lit("request|"), F.concat_ws("|", *parts))
    return F.sha2(F.coalesce(F.col("request_id").cast("string"), unnamed), 256)


def audit_rows(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Audit rows of screened requests.

    The id (``audit_id``) is a hash of the request and the time is that of the request, so that a repeated run gives equal
    rows.
    """
    return with_usage(storable(df), prompt).select(
        audit_id(prompt).alias("id"),
        audit_user(F.col("user_id")).alias("user_id"),
        F.coalesce("tool", F.lit("Unknown")).alias("tool"),
        F.coalesce("browser_name", F.lit("Unknown")).alias("browser_name"),
        F.col(prompt).alias("original_prompt"),
        "redacted_prompt",
        F.coalesce("highest_risk_type", F.lit("NONE")).alias("highest_risk_type"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("NONE")).alias("risk_level"),
        F.coalesce("action", F.lit("ALLOW")).alias("action"),
        "action_reason",
        F.lit(None).cast("bigint").alias("processing_time_ms"),
        "tokens_used",
        "tokens_saved",
        "cost_used",
        "cost_saved",
        F.col("ts").alias("created_at"),
    ).select(*AUDIT_COLUMNS)
