"""The screening job: requests in, decisions or audit rows out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwright.operators.audit import audit_rows
from screenwright.operators.detectors import CORE, EXTRA, TEXT_COLUMNS, run_detectors
from screenwright.operators.lookups import bucket, hot_keys, row_digest
from screenwright.operators.org_policy import detect_org_keywords, policies_small
from screenwright.operators.prepare import prepare_requests, users_small, with_org_key
from screenwright.operators.scoring import combine, with_decision

PROFILES = {"core": CORE, "extended": CORE + EXTRA}


@dataclass(frozen=True)
class Options:
    """``profile``: the detectors of the live path, or all. ``match_mode``: how keywords of several words are looked
    for (``compact`` or ``spaced``). ``org_key_mode``: whether organisation names are resolved (``by_user`` or
    ``by_name``). ``policy_plan``: ``auto``, ``broadcast`` or ``join``."""

    profile: str = "core"
    match_mode: str = "compact"
    org_key_mode: str = "by_user"
    policy_plan: str = "auto"
    aliases: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Dimensions:
    """The tables that requests are looked up in. Users and policies are measured at the first use; make new
    ``Dimensions`` where they may have grown past the bound of a broadcast since."""

    users: DataFrame
    organizations: DataFrame
    policies: DataFrame

    @cached_property
    def users_small(self) -> bool:
        return users_small(self.users)

    @cached_property
    def policies_small(self) -> bool:
        return policies_small(self.policies)


def find(df: DataFrame, dims: Dimensions, options: Options) -> DataFrame:
    """Add ``detections`` to prepared requests with an ``org_key``."""
    names = PROFILES[options.profile]
    df = run_detectors(df, names, mode=options.match_mode)
    small = options.policy_plan != "join" and dims.policies_small
    df = detect_org_keywords(df, dims.policies, mode=options.match_mode, plan=options.policy_plan, small=small)
    ordered = (*CORE, "org", *names[len(CORE):])
    return combine(df, ordered).drop(*TEXT_COLUMNS)


def screen(requests: DataFrame, dims: Dimensions, options: Options | None = None, reuse: bool = False,
           where: Column | str | None = None) -> DataFrame:
    """Requests with detections, score, decision and redacted prompt.

    ``where`` is a condition on columns of the requests as they come. It is applied before anything else and so reaches
    the reader; a filter on the result does not.

    Without ``reuse`` this is one pass over the requests that moves no prompt between executors, provided the
    dimensions are small. ``reuse`` screens each distinct (organisation, sub-user, prompt) once; it pays where many
    requests repeat a prompt, at the price of moving the prompts once. It needs a batch.
    """
    options = options or Options()
    requests = requests if where is None else requests.where(where)
    prepared = prepare_requests(requests, options.aliases)
    keyed = with_org_key(prepared, dims.users, dims.organizations, options.org_key_mode, salt_by="request_id",
                         small=dims.users_small)
    found = reuse_detections(keyed, dims, options) if reuse else find(keyed, dims, options)
    return with_decision(found.drop("org_key"))


def reuse_detections(keyed: DataFrame, dims: Dimensions, options: Options) -> DataFrame:
    """Screen distinct prompts and give their detections to the others.

    Requests are gathered by a digest of what decides, with hot digests spread over buckets. In each bucket the first
    request keeps its prompt and is screened; the others have none while detectors run and take over its detections.
    Both steps use the same partitioning, so prompts cross one shuffle and nothing is joined back.
    """
    # The digest tells null from empty, and the separator cannot occur in its hexadecimal parts.
    parts = [F.coalesce(F.sha2(F.col(c), 256), F.lit("-")) for c in ("org_key", "sub_user", "prompt")]
    keyed = keyed.withColumn("_key", F.sha2(F.concat_ws("|", *parts), 256))
    spread = keyed.join(F.broadcast(hot_keys(keyed.select("_key"), ["_key"])), "_key", "left").withColumn(
        "_salt", bucket(row_digest(keyed), F.coalesce("_buckets", F.lit(1)))).drop("_buckets")
    same = Window.partitionBy("_key", "_salt")
    gathered = spread.withColumn("_first", F.row_number().over(same.orderBy("_salt")) == 1)
    bare = gathered.withColumns({"_prompt": F.col("prompt"), "prompt": F.when(F.col("_first"), F.col("prompt"))})
    found = F.first(F.when(F.col("_first"), F.col("detections")), ignorenulls=True).over(same)
    return find(bare, dims, options).withColumns({"detections": found, "prompt": F.col("_prompt")}).drop(
        "_prompt", "_key", "_salt", "_first")


def audit(requests: DataFrame, dims: Dimensions, options: Options | None = None, reuse: bool = False,
          where: Column | str | None = None) -> DataFrame:
    """Audit rows of requests; ``where`` as in ``screen``."""
    return audit_rows(screen(requests, dims, options, reuse, where))
