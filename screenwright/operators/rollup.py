"""Daily sums of the audit table that batches add to and reports merge.

A row holds counts and exact sums of one (day, user, tool, risk type, action). Batches append their own rows; rows of one
key add up, so a report reads a few numbers a key and day instead of all prompts, and a period reads its days only.
``compact`` replaces the rows of some days by one a key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright.operators.analytics import ACTIONS, of_user, required_ids, with_block_rate

KEYS = ("audit_date", "user_id", "tool", "highest_risk_type", "action")
ROLLUP = ("user_id string, tool string, highest_risk_type string, action string, prompts bigint, tokens_used bigint, "
          "tokens_saved bigint, cost_used decimal(38,8), cost_saved decimal(38,8), audit_date date")
_SUMS = ("prompts", "tokens_used", "tokens_saved", "cost_used", "cost_saved")


def daily(audit: DataFrame) -> DataFrame:
    """The sums of some audit rows. Every row counts, also those without a time, whose day is null."""
    money = {c: F.coalesce(F.sum(F.round(c, 8).cast("decimal(28,8)")), F.lit(0)).cast("decimal(38,8)").alias(c)
             for c in ("cost_used", "cost_saved")}
    return audit.withColumn("audit_date", F.to_date("created_at")).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("prompts"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tokens_used", "tokens_saved")), *money.values())


def merged(rollup: DataFrame) -> DataFrame:
    """One row a key."""
    return rollup.groupBy(*KEYS).agg(*(F.sum(c).cast(rollup.schema[c].dataType).alias(c) for c in _SUMS))


def add_to_rollup(audit: DataFrame, path: str) -> None:
    """Append the sums of a batch. The batch has to be new: sums, unlike audit rows, cannot tell what they hold.

    The sums are gathered by day as audit rows are; no task adds up those of all days."""
    daily(audit).hint("rebalance", "audit_date").write.mode("append").partitionBy("audit_date").parquet(path)


def read_rollup(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The sums of a period, both days included; other days are not read. Without a limit rows without a day count too."""
    rows = spark.read.schema(ROLLUP).parquet(path)
    if first is not None:
        rows = rows.where(F.col("audit_date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("audit_date") <= F.lit(last))


def compact(spark: SparkSession, path: str, to: str, first: date | None = None, last: date | None = None) -> None:
    """Write the sums of a period with one row a key to another folder, replacing the days that occur there."""
    merged(read_rollup(spark, path, first, last)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("audit_date").parquet(to)


def _sum(column: str, condition: Column | None = None) -> Column:
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def total_count(rollup: DataFrame) -> DataFrame:
    return rollup.agg(_sum("prompts").alias("total"))


def count_for_action(rollup: DataFrame, action: str) -> DataFrame:
    return rollup.agg(_sum("prompts", F.col("action") == action).alias("total"))


def count_by_tool(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("tool").agg(_sum("prompts").alias("count")).orderBy(F.desc("count"), "tool")


def count_by_risk_type(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(F.col("highest_risk_type").alias("riskType")).agg(_sum("prompts").alias("count")).orderBy(
        F.desc("count"), "riskType")


def top_users(rollup: DataFrame, n: int = 10) -> DataFrame:
    return rollup.groupBy("user_id").agg(
        _sum("prompts").alias("total"), _sum("prompts", F.col("action") == "BLOCK").alias("blocked"),
    ).orderBy(F.desc("total"), "user_id").limit(n)


def summary(rollup: DataFrame) -> DataFrame:
    """All counters and sums; zeros for an empty table."""
    return rollup.agg(
        _sum("prompts").alias("totalPrompts"),
        *(_sum("prompts", F.col("action") == action).alias(name) for name, action in ACTIONS),
        _sum("tokens_used").alias("tokensUsed"), _sum("tokens_saved").alias("tokensSaved"),
        F.coalesce(F.sum("cost_used"), F.lit(0)).cast("double").alias("costUsed"),
        F.coalesce(F.sum("cost_saved"), F.lit(0)).cast("double").alias("costSaved"))


def risk_summary(rollup: DataFrame) -> DataFrame:
    return with_block_rate(summary(rollup))


def user_stats(rollup: DataFrame, user_id: str | None, aliases=()) -> DataFrame:
    return summary(of_user(rollup, required_ids(user_id, aliases)))
