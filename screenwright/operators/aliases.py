"""Organisations that go by several names, as a table of any size.

The names of an organisation (id, name, account slug) are compared exactly or ignoring case, as each use demands, and
where several organisations share a name the first in order counts. ``alias_index`` folds the table to one row for each
(kind, key), so that a look-up is an equality and no expression grows with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.text import java_trim
from screenwright.operators.lookups import is_small, lookup_join

ORGANISATIONS = "seq int, org_id string, org_name string, slug string"
#: A probe is the kind of name and the value that is looked up. ``=`` compares exactly, ``~`` ignores case.
Probe = tuple[str, Column]
KINDS = {"id=": ("org_id", False), "name=": ("org_name", False), "name~": ("org_name", True),
         "slug=": ("slug", False), "slug~": ("slug", True)}


def alias_index(organisations: DataFrame) -> DataFrame:
    """(kind, key, found): for each kind of name and each key the first organisation in order of ``seq``.

    Each kind is a part of its own, so that a look-up by some kinds works out no others.
    """
    found = F.struct("seq", "org_id", "org_name")
    parts = [organisations.select(F.lit(kind).alias("kind"), (F.lower(field) if folded else F.col(field)).alias("key"), found.alias("found"))
             for kind, (field, folded) in KINDS.items()]
    return reduce(DataFrame.unionByName, parts).where("key IS NOT NULL").groupBy("kind", "key").agg(F.min("found").alias("found"))


def index_small(index: DataFrame, *kinds: str) -> bool:
    """Whether the rows of these kinds may be broadcast."""
    return is_small(index.where(F.col("kind").isin(*kinds)).select("kind", "key", "found.org_id", "found.org_name"))


def key_of(probe: Probe) -> Column:
    kind, value = probe
    return F.lower(value) if KINDS[kind][1] else value


def resolve(df: DataFrame, index: DataFrame, probes: list[Probe], to: str, small: bool | None = None) -> DataFrame:
    """Add ``to``: the organisation that the first in order of all that a probe meets; null if none does.

    A small index is broadcast once a probe and ``df`` is not moved. Above the bound a batch looks every distinct set of
    keys up once, however often it occurs, and joins the outcome; a stream shuffles once a probe, hot keys in buckets.
    The kinds that are probed are measured; ``small=True`` asks for the broadcast but does not lift the bound, as the
    driver has to hold what it sends. ``small=False`` never broadcasts.
    """
    kinds = sorted({kind for kind, _ in probes})
    small = small is not False and index_small(index, *kinds)
    keys = [f"_key{i}" for i in range(len(probes))]
    keyed = df.withColumns({k: key_of(p) for k, p in zip(keys, probes, strict=True)})
    if not small and not df.isStreaming:
        digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.sha2(k, 256), F.lit("-")) for k in keys)), 256)
        keyed = keyed.withColumn("_keys", digest)
        named = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(k).alias("key")) for k, (kind, _) in zip(keys, probes, strict=True)))
        each = keyed.select("_keys", *keys).distinct().select("_keys", F.explode(F.array_distinct(named)).alias("n")).where("n.key IS NOT NULL")
        met = each.select("_keys", "n.kind", "n.key").join(index.where(F.col("kind").isin(*kinds)), ["kind", "key"]).groupBy("_keys").agg(F.min("found").alias(to))
        return lookup_join(keyed.drop(*keys), met, ["_keys"], small=False).drop("_keys")
    for i, (kind, _) in enumerate(probes):
        part = index.where(F.col("kind") == kind).select(F.col("key").alias(keys[i]), F.col("found").alias(f"_found{i}"))
        keyed = lookup_join(keyed, part, [keys[i]], small=small)
    found = [f"_found{i}" for i in range(len(probes))]
    first = F.array_min(F.array(*found))  # skips nulls
    return keyed.withColumn(to, first).drop(*keys, *found)


def canonical_user_by_table(df: DataFrame, index: DataFrame, small: bool | None = None) -> DataFrame:
    """``user_id`` as requests are stored: the name of the organisation that the user or the sub-user stands for."""
    user, sub = F.col("user_id"), F.col("sub_user")
    out = resolve(df, index, [("id=", user), ("name~", user), ("slug~", user), ("slug~", sub)], "_org", small)
    unnamed = user.isNull() | (java_trim(user) == "") | (user == "anonymous-user")
    return out.withColumn("user_id", F.coalesce("_org.org_name", F.when(unnamed, "anonymous-user").otherwise(user))).select(*df.columns)


def heartbeat_label_by_table(df: DataFrame, index: DataFrame, to: str = "org_label", user_id: str = "userId",
                             sub_user: str = "subUser", small: bool | None = None) -> DataFrame:
    """Label of a heartbeat: the sub-user's account counts before the user; the user's account is compared exactly."""
    user = F.col(user_id)
    out = resolve(df, index, [("slug~", F.col(sub_user))], "_by_sub", small)
    out = resolve(out, index, [("id=", user), ("name~", user), ("slug=", user)], "_by_user", small)
    return out.withColumn(to, F.coalesce("_by_sub.org_name", "_by_user.org_name", user)).drop("_by_sub", "_by_user")


def analytics_id_by_table(df: DataFrame, index: DataFrame, to: str, user_id: str = "user_id", small: bool | None = None) -> DataFrame:
    """Canonical id for report filters; null stays null."""
    user = F.col(user_id)
    out = resolve(df, index, [("id=", user), ("name~", user), ("slug~", user)], "_org", small)
    return out.withColumn(to, F.coalesce("_org.org_name", user)).drop("_org")


def alternate_id_by_table(df: DataFrame, index: DataFrame, to: str, user_id: str = "user_id", small: bool | None = None) -> DataFrame:
    """Organisation id for an organisation name, otherwise the id itself."""
    out = resolve(df, index, [("name~", F.col(user_id))], "_org", small)
    return out.withColumn(to, F.coalesce("_org.org_id", F.col(user_id))).drop("_org")


def rekey_audit_by_table(audit: DataFrame, index: DataFrame, small: bool | None = None) -> DataFrame:
    """Account slugs and organisation names become organisation ids."""
    return _rekeyed(audit, index, ("slug=", "name="), small)


def rekey_policies_by_table(policies: DataFrame, index: DataFrame, small: bool | None = None) -> DataFrame:
    """Account slugs become organisation ids."""
    return _rekeyed(policies, index, ("slug=",), small)


def _rekeyed(df: DataFrame, index: DataFrame, kinds: tuple[str, ...], small: bool | None) -> DataFrame:
    out = resolve(df, index, [(kind, F.col("user_id")) for kind in kinds], "_org", small)
    return out.withColumn("user_id", F.coalesce("_org.org_id", "user_id")).select(*df.columns)
