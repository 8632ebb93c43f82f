"""Table upkeep in the order the steps depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

from screenwright.operators import maintenance as M
from screenwright.schemas import conform_audit, conform_policies, conform_users


def maintain(
    audit: DataFrame,
    users: DataFrame,
    organizations: DataFrame,
    policies: DataFrame,
    seeds: dict[str, DataFrame] | None = None,
    aliases=(),
) -> dict[str, DataFrame]:
    """Next version of all four tables.

    Seeds are added where absent before ids are changed, so that a second run finds them and adds nothing. Clean-up of
    policies comes last. Of seeds with one key the first by ``seq`` wins, where they have it. The flag column is renamed before policies are read, because the steps need its new name.
    """
    seeds = seeds or {}
    order = {k: "seq" if "seq" in v.columns else None for k, v in seeds.items()}
    audit, users, policies = conform_audit(audit), conform_users(users), conform_policies(policies)
    if "organizations" in seeds:
        organizations = M.insert_absent(organizations, seeds["organizations"], ["org_id"], order["organizations"])
    if "users" in seeds:
        users = M.insert_absent(users, seeds["users"], ["user_id"], order["users"])
    users = M.repair_users(users, aliases)
    policies = M.rekey_policies(policies, aliases)
    if "policies" in seeds:
        policies = M.insert_absent(policies, seeds["policies"], ["user_id", "sub_user", "keyword_list"],
                                   order["policies"], "id" if order["policies"] else None)
    audit = M.rekey_audit(M.backfill_usage(audit), aliases)
    policies = M.drop_broad_policies(M.drop_duplicate_policies(policies))
    return {"audit": audit, "users": users, "organizations": organizations, "policies": policies}
