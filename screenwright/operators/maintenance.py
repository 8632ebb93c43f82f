"""Upkeep of the tables: upserts, repairs, backfills and clean-up. Every step maps a table to its next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values of the backfill: tokens assumed for an answer and the blended price of a token in US dollars.
LEGACY_RESPONSE_TOKENS = 300
LEGACY_TOKEN_PRICE = 0.000007


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last change per key. An aggregate, so that repeated keys are reduced before they are moved."""
    columns = [c for c in changes.columns if c not in (key, seq)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def upsert(target: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of ``target`` with the same key or are added.

    Columns only the target has keep their value on an update and are null on an insert.
    """
    if seq is not None:
        changes = latest(changes, key, seq)
    updates = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates], F.lit(True).alias("_changed"))
    joined = target.join(marked, key, "full_outer")
    return joined.select(*[
        F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in target.columns
    ])


def upsert_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(users, changes, "user_id", "seq")


def upsert_organizations(organizations: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(organizations, changes, "org_id", "seq")


def insert_absent(target: DataFrame, candidates: DataFrame, keys: list[str], seq: str | None = None,
                  number: str | None = None) -> DataFrame:
    """Add candidates whose key the target does not have; existing rows are never changed.

    Of candidates with one key the first by ``seq`` wins; without it, or in a tie, the smallest by all columns. With
    ``number``, that column of new rows follows the target's highest in the order of ``seq``, as ``append_policies`` does.
    """
    others = [c for c in candidates.columns if c not in keys and c != seq]
    order = F.struct(*([F.col(seq).alias("_seq")] if seq else []), *others)
    first = candidates.groupBy(*keys).agg(F.min(order).alias("_first")).select(*keys, "_first.*")
    new = first.join(target.select(*keys).distinct(), keys, "left_anti")
    if number:
        new = append_numbers(target, new.drop(number), number, "_seq")
    return target.unionByName(new.drop("_seq"), allowMissingColumns=True).select(*target.columns)


def append_numbers(target: DataFrame, new: DataFrame, number: str, seq: str) -> DataFrame:
    """Number ``new`` after the highest of ``target``; two numbers are fetched, and no row has to see another one."""
    highest = target.agg(F.max(number)).first()[0] or 0
    first = new.agg(F.min(seq)).first()[0] or 0
    return new.withColumn(number, (F.lit(highest - first + 1) + F.col(seq)).cast("int"))


def append_policies(policies: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Append policies with ids that follow the highest one in the order of ``seq``.

    ``seq`` is the arrival number of a row. Ids grow with it and are unique; like those of a database sequence they
    have gaps where it has. Only two numbers are fetched, and no row has to see another one.
    """
    return policies.unionByName(append_numbers(policies, new, "id", seq).select(*policies.columns))


def delete_policies(policies: DataFrame, ids: DataFrame) -> DataFrame:
    return policies.join(ids.select("id").distinct(), "id", "left_anti").select(*policies.columns)


DUPLICATE_KEY = ("user_id", "sub_user", "keyword_list", "block_col", "critical_col", "redacted_col", "allow_col")


def drop_duplicate_policies(policies: DataFrame) -> DataFrame:
    """Keep the lowest id of equal policies; the description does not count.

    A row with a null in a compared column equals nothing and stays. The rest is reduced by an aggregate, which keeps
    one row per group while reading, so that many copies of one policy do not gather in one place.
    """
    incomparable = F.lit(False)
    for c in DUPLICATE_KEY:
        incomparable = incomparable | F.col(c).isNull()
    rest = [c for c in policies.columns if c not in DUPLICATE_KEY]
    kept = policies.filter(~incomparable).groupBy(*DUPLICATE_KEY).agg(
        F.min_by(F.struct(*rest), "id").alias("_first")
    ).select(*DUPLICATE_KEY, *[F.col(f"_first.{c}").alias(c) for c in rest])
    return kept.select(*policies.columns).unionByName(policies.filter(incomparable))


def drop_broad_policies(policies: DataFrame) -> DataFrame:
    """Remove policies that block, alert or redact every prompt."""
    acts = [F.coalesce(F.col(c), F.lit(False)) for c in ("block_col", "critical_col", "redacted_col")]
    broad = (F.col("keyword_list") == "*") & (acts[0] | acts[1] | acts[2])
    return policies.filter(~F.coalesce(broad, F.lit(False)))


def backfill_usage(audit: DataFrame) -> DataFrame:
    """Estimate tokens, then cost, of old rows that have neither. Rows without an action or a prompt stay as they are."""
    blocked, open_ = F.col("action") == "BLOCK", F.col("action") != "BLOCK"
    estimate = (F.floor(F.length("original_prompt") / F.lit(4)) + LEGACY_RESPONSE_TOKENS).cast("int")
    no_tokens = (F.col("tokens_used") == 0) & (F.col("tokens_saved") == 0) & F.col("original_prompt").isNotNull()
    audit = audit.withColumns({
        "tokens_used": F.when(no_tokens & open_, estimate).otherwise(F.col("tokens_used")),
        "tokens_saved": F.when(no_tokens & blocked, estimate).otherwise(F.col("tokens_saved")),
    })
    no_cost = (F.col("cost_used") == 0) & (F.col("cost_saved") == 0)

    def priced(tokens: str) -> Column:
        return F.col(tokens) * F.lit(LEGACY_TOKEN_PRICE)

    return audit.withColumns({
        "cost_used": F.when(no_cost & open_, priced("tokens_used")).otherwise(F.col("cost_used")),
        "cost_saved": F.when(no_cost & blocked, priced("tokens_saved")).otherwise(F.col("cost_saved")),
    })


def rekey(df: DataFrame, mapping: list[tuple[str, str]], column: str = "user_id") -> DataFrame:
    """Replace old ids by new ones; ids not in the mapping stay."""
    chain = F.col(column)
    for old, new in reversed(mapping):
        chain = F.when(F.col(column) == old, new).otherwise(chain)
    return df.withColumn(column, chain)


def rekey_audit(audit: DataFrame, aliases=()) -> DataFrame:
    """Account slugs and organisation names become organisation ids."""
    return rekey(audit, [(old, org) for org, name, slug in aliases for old in (slug, name)])


def rekey_policies(policies: DataFrame, aliases=()) -> DataFrame:
    """Account slugs become organisation ids."""
    return rekey(policies, [(slug, org) for org, _name, slug in aliases])


def repair_users(users: DataFrame, aliases=()) -> DataFrame:
    """Remove users whose id is an organisation id; name known accounts after their organisation and attach them."""
    name, org = F.col("display_name"), F.col("org_id")
    for org_id, org_name, slug in aliases:
        known = F.col("user_id") == slug
        name = F.when(known, org_name).otherwise(name)
        org = F.when(known & F.col("org_id").isNull(), int(org_id)).otherwise(org)
    kept = users.filter(F.col("user_id").isNull() | ~F.col("user_id").isin([o for o, _n, _s in aliases]))
    return kept.withColumns({"display_name": name, "org_id": org.cast("int")})
