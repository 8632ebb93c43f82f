"""Request preparation: defaults, identities, tool and browser names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.text import is_blank, java_trim
from screenwright.operators.lookups import is_small, lookup_join


def host_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def tool_of(host: Column) -> Column:
    """Tool name by host name; the first entry of the catalogue that fits wins."""
    chain = None
    for parts, tool in C.TOOL_HOSTS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(host, F.lit(part))
        chain = F.when(hit, tool) if chain is None else chain.when(hit, tool)
    return chain.otherwise("Unknown")


def with_tool(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("tool", tool_of(host_of(F.col(url))))


def browser_of(user_agent: Column, is_brave: Column | None = None) -> Column:
    """Browser by user agent. Brave sends the user agent of Chrome, so it has to be told apart by a flag."""

    def has(part: str) -> Column:
        return F.contains(user_agent, F.lit(part))

    brave = F.lit(False) if is_brave is None else F.coalesce(is_brave, F.lit(False))
    return (
        F.when(brave, "Brave")
        .when(has("Edg/"), "Edge")
        .when(has("OPR/") | has("Opera"), "Opera")
        .when(has("Firefox/"), "Firefox")
        .when(has("Safari/") & ~has("Chrome"), "Safari")
        .when(has("Chrome/"), "Chrome")
        .otherwise("Unknown")
    )


def with_browser(df: DataFrame, user_agent: str = "user_agent", is_brave: str | None = None) -> DataFrame:
    return df.withColumn("browser_name", browser_of(F.col(user_agent), F.col(is_brave) if is_brave else None))


def submitted(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Client-side filter: a prompt of fewer than three characters is never sent."""
    return df.filter(F.length(java_trim(F.col(prompt))) >= 3)


def default_sub_user(sub_user: Column) -> Column:
    trimmed_empty = sub_user.isNull() | (java_trim(sub_user) == "")
    return F.when(trimmed_empty | (sub_user == "anonymous-sub"), "unknown").otherwise(sub_user)


def alias_expression(value: Column, aliases: Sequence[tuple[str, str, str]], kinds: dict[str, str]) -> Column:
    """Name of the organisation an id stands for, null if it stands for none.

    ``aliases`` holds (organisation id, name, account slug). ``kinds`` says per field whether it is compared exactly
    or ignoring case.
    """
    chain = F.lit(None).cast("string")
    for org_id, name, slug in reversed(aliases):
        hit = F.lit(False)
        for field, text in (("id", org_id), ("name", name), ("slug", slug)):
            if field in kinds:
                one = value == text if kinds[field] == "exact" else F.lower(value) == text.lower()
                hit = hit | one
        chain = F.when(hit, name).otherwise(chain)
    return chain


def canonical_user(user_id: Column, sub_user: Column, aliases=()) -> Column:
    """User id under which a request is stored: the organisation name where id or sub-user stands for one."""
    unnamed = user_id.isNull() | (java_trim(user_id) == "") | (user_id == "anonymous-user")
    chain = F.when(unnamed, "anonymous-user").otherwise(user_id)
    for org_id, name, slug in reversed(aliases):
        hit = (F.coalesce(user_id == org_id, F.lit(False))
               | F.coalesce(F.lower(user_id).isin(name.lower(), slug.lower()), F.lit(False))
               | F.coalesce(F.lower(sub_user) == slug.lower(), F.lit(False)))
        chain = F.when(hit, name).otherwise(chain)
    return chain


def heartbeat_label(user_id: Column, sub_user: Column, aliases=()) -> Column:
    """Label of a heartbeat. The account slug is compared exactly here, and the sub-user's slug overrides, last first."""
    by_user = alias_expression(user_id, aliases, {"id": "exact", "name": "ignore", "slug": "exact"})
    by_sub = alias_expression(sub_user, aliases, {"slug": "ignore"})
    return F.coalesce(by_sub, by_user, user_id)


def analytics_id(user_id: Column, aliases=()) -> Column:
    """Canonical id for report filters; null stays null."""
    kinds = {"id": "exact", "name": "ignore", "slug": "ignore"}
    return F.coalesce(alias_expression(user_id, aliases, kinds), user_id)


def alternate_id(user_id: Column, aliases=()) -> Column:
    """Organisation id for an organisation name, otherwise the id itself; reports match either."""
    chain = user_id
    for org_id, name, _slug in reversed(aliases):
        chain = F.when(F.lower(user_id) == name.lower(), org_id).otherwise(chain)
    return chain


def with_display_label(df: DataFrame, organizations: DataFrame, user_id: str = "user_id") -> DataFrame:
    """Show the organisation name for a numeric organisation id, otherwise the id."""
    names = organizations.select(F.col("org_id").cast("string").alias(user_id), F.col("org_name").alias("_label"))
    joined = lookup_join(df, names, [user_id])
    return joined.withColumn("display_label", F.coalesce("_label", user_id)).drop("_label")


def prepare_requests(df: DataFrame, aliases=()) -> DataFrame:
    """Apply the sub-user default, then the canonical user id, which looks at the defaulted sub-user.

    ``aliases`` are (organisation id, name, account slug); none are built in.
    """
    df = df.withColumn("sub_user", default_sub_user(F.col("sub_user")))
    return df.withColumn("user_id", canonical_user(F.col("user_id"), F.col("sub_user"), aliases))


def organisations_of_users(users: DataFrame) -> DataFrame:
    """The users that have an organisation, one row each: of a repeated user the smallest organisation id counts."""
    return users.filter(F.col("org_id").isNotNull()).groupBy("user_id").agg(
        F.min("org_id").cast("string").alias("_org"))


def users_small(users: DataFrame) -> bool:
    """Whether the organisations of the users can be broadcast; the raw table is measured, which may stop early."""
    return is_small(users.select("user_id", "org_id"))


def with_org_key(
    df: DataFrame,
    users: DataFrame,
    organizations: DataFrame | None = None,
    mode: str = "by_user",
    numeric_as_is: bool = False,
    salt_by: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add ``org_key``: the organisation of the user, or the id itself where the user is unknown or has none.

    ``numeric_as_is`` leaves an all-digit id alone without a look-up. ``mode="by_name"`` also resolves an organisation
    name, which canonical user ids often are. ``small`` is the outcome of ``users_small`` where it is
    known.
    """
    small = users_small(users) if small is None else small
    out = lookup_join(df, organisations_of_users(users), ["user_id"], salt_by, small=small)
    key = F.coalesce("_org", "user_id")
    if mode == "by_name":
        if organizations is None:
            raise ValueError("by_name needs the organisations")
        named = organizations.groupBy(F.col("org_name").alias("user_id")).agg(
            F.min("org_id").cast("string").alias("_named"))
        out = lookup_join(out, named, ["user_id"], salt_by)
        key = F.coalesce("_org", "_named", "user_id")
    elif mode != "by_user":
        raise ValueError(f"unknown organisation key mode {mode!r}")
    blank = is_blank(F.col("user_id"))
    if numeric_as_is:
        blank = blank | F.col("user_id").rlike(r"^[0-9]+\z")
    out = out.withColumn("org_key", F.when(blank, F.col("user_id")).otherwise(key))
    return out.drop("_org", "_named")
