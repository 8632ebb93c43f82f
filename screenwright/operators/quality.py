"""Checks and defaults for incoming records. Rejected rows are returned beside the accepted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.text import is_blank, java_trim
from screenwright.operators.prepare import heartbeat_label, with_org_key


def split_by(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("error", error)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def first_error(*checks: tuple[Column, str]) -> Column:
    chain = None
    for bad, message in checks:
        chain = F.when(bad, message) if chain is None else chain.when(bad, message)
    return chain


def as_int(text: Column) -> Column:
    """Integer of a string of digits with an optional sign, null for anything else."""
    value = text.cast("string")
    return F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast("int"))


def check_users(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users from (userId, displayName, role, orgId): an id is required, the rest is defaulted."""
    good, bad = split_by(raw, first_error((is_blank(F.col("userId")), "userId is required")))
    return good.select(
        F.col("userId").alias("user_id"),
        F.coalesce("displayName", "userId").alias("display_name"),
        F.when(F.upper("role").isin("ADMIN", "USER"), F.col("role")).otherwise("USER").alias("role"),
        as_int(F.col("orgId")).alias("org_id"),
    ), bad


def check_organizations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organisations from (orgId, orgName): both are required and the id has to be a number."""
    error = first_error(
        (F.col("orgId").isNull() | is_blank(F.col("orgName")), "orgId and orgName are required"),
        (as_int(F.col("orgId")).isNull(), "orgId is not a number"),
    )
    good, bad = split_by(raw, error)
    return good.select(as_int(F.col("orgId")).alias("org_id"), F.col("orgName").alias("org_name")), bad


def check_policies(raw: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Policies from request bodies. The misspelt flag name of older clients is accepted too."""
    error = first_error(
        (is_blank(F.col("userId")), "userId is required"),
        (is_blank(F.col("subUser")), "subUser is required"),
        (is_blank(F.col("keywordList")), "keywordList is required"),
    )
    good, bad = split_by(raw, error)
    keyed = with_org_key(good.withColumn("user_id", F.col("userId")), users, numeric_as_is=True)

    def flag(*names: str) -> Column:
        present = [F.coalesce(F.col(n), F.lit(False)) for n in names if n in raw.columns]
        result = F.lit(False)
        for p in present:
            result = result | p
        return result

    return keyed.select(
        F.col("org_key").alias("user_id"),
        F.col("subUser").alias("sub_user"),
        F.col("keywordList").alias("keyword_list"),
        flag("allowCol").alias("allow_col"),
        flag("redactedCol").alias("redacted_col"),
        flag("criticalCol", "critialCol").alias("critical_col"),
        flag("blockCol").alias("block_col"),
        F.coalesce("promptCol", F.lit("")).alias("prompt_col"),
        *[c for c in ("seq",) if c in raw.columns],
    ), bad


def normalize_alerts(df: DataFrame) -> DataFrame:
    """Defaults for tamper alerts. A field that is missing altogether counts as null."""
    defaults = {"type": "UNKNOWN", "userId": "unknown", "message": "No message", "timestamp": "N/A"}
    present = {n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string") for n in defaults}
    rest = [c for c in df.columns if c not in defaults]
    return df.select(*rest, *[F.coalesce(present[n], F.lit(d)).alias(n) for n, d in defaults.items()])


def normalize_heartbeats(df: DataFrame, aliases=()) -> DataFrame:
    """Defaults for heartbeats, and the organisation label they are shown under."""
    sub = F.when(F.col("subUser").isNull() | (java_trim(F.col("subUser")) == ""), "unknown").otherwise(F.col("subUser"))
    df = df.withColumns({
        "userId": F.coalesce("userId", F.lit("unknown")),
        "subUser": sub,
        "browserName": F.coalesce("browserName", F.lit("Unknown")),
    })
    return df.withColumn("org_label", heartbeat_label(F.col("userId"), F.col("subUser"), aliases))
