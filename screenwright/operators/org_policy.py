"""Keyword policies of organisations.

Policies of an organisation are looked at in id order. A policy applies to all sub-users (``*``) or to one. The first
of its keywords found in the prompt decides: an allow policy stops the search and discards what would follow, others
report the keyword. Without a report, or after a stop, the intent layer runs.

The policy table is folded to one row per organisation and looked up. Below a measured bound that is a broadcast and
prompts are not moved; above it, prompts meet the folded rows in one salted join. Either way every prompt is judged by
the same expressions in its own row, so the plans agree, need no request id and run in streams as well.

An organisation of more than ``CHUNK_WORDS`` keywords does not travel in one row where policies are not broadcast, and its
keywords are not tried one by one. A keyword's longest part without white space lies inside one token of a text, so the
start of that part (``key_grams``) is among the short pieces of the text's tokens (``token_grams``): texts and distinct
keywords meet by equal pieces, and only pairs that met are compared. Each distinct text first looks for the policies that
allow, which gives its stop, then for the others up to the stop, in bands by policy id. A keyword that holds an earlier one of
its policy can never be the first found and is left out. Texts without a stop meet all policies, apart from the others.
Requests take the merged hits by the digest of what decides them. This needs a batch (a stream judges its micro-batches, see
``screen_stream``) and takes the ids of an organisation's policies to be unique.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from screenwright import catalogue as C
from screenwright.functions.detections import (
    DETECTIONS_TYPE,
    any_needle,
    finding,
    first_of,
    no_detections,
)
from screenwright.functions.reuse import built_once
from screenwright.functions.text import Words, is_blank, java_trim, let
from screenwright.operators.lookups import BROADCAST_BYTES, is_small, lookup_join, shuffle_partitions

POLICY_ROWS = 100_000
# A folded keyword stands in its row as written, lowered and as a needle.
POLICY_BYTES = BROADCAST_BYTES // 4
# Keywords in one row, about; an organisation with more is a large one.
CHUNK_WORDS = 20_000
# Ranges of policy ids that a large organisation's keywords are cut into, at most.
BANDS = 256
# Characters of the longest piece that texts and keywords meet by, and of the windows that long tokens are cut into.
GRAM, WINDOW = 16, 48
# The first keywords of a policy that hold none of the very first, which later ones that hold them are dropped for.
HEADS = 256
# Policies with so many keywords are read anew by each step instead of being kept, and so many keywords that can come first
# are broadcast.
KEPT_WORDS = 5_000_000
MET_ROWS = 100_000
# Policies that allow are looked at in rounds by id: first about so many keywords, then each time eight times as many. A text
# that has its stop leaves.
ROUND_WORDS = 50_000
ROUNDS = 8
# The share of the texts with a stop that meet policies up to the last stop among them; the others are few and have later ones.
EARLY = 0.95
# What splits a text into tokens: all white space that normalising makes a space of.
BREAKS = r"[\t-\r ]"
ALLOWS = "effect = 'allow'"


def effect(allow: Column, block: Column, critical: Column, redact: Column) -> Column:
    """What a matching policy does; the order is the precedence when several flags are set."""
    return (
        F.when(allow, "allow").when(block, "block").when(critical, "critical").when(redact, "redact").otherwise("none")
    )


def clean_policies(policies: DataFrame) -> DataFrame:
    """One row per policy: organisation key, lowered sub-user, effect and the list of cleaned keywords."""
    flags = [F.coalesce(c, F.lit(False)) for c in ("allow_col", "block_col", "critical_col", "redacted_col")]
    commas = F.octet_length("keyword_list") - F.octet_length(F.replace("keyword_list", F.lit(","), F.lit("")))
    return policies.select(
        F.col("user_id").alias("org_key"),
        "id",
        F.lower("sub_user").alias("policy_sub_user"),
        effect(*flags).alias("effect"),
        listed_words("keyword_list").alias("words"),
        "keyword_list",
        # Counted without a look at the keywords, blank ones included.
        F.coalesce(commas + 1, F.lit(0)).cast("bigint").alias("listed"),
    )


def listed_words(keyword_list: str) -> Column:
    words = F.filter(F.transform(F.split(keyword_list, ","), java_trim), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(
        w.alias("word"),
        F.lower(w).alias("lower"),
        needle_of(F.lower(w)).alias("needle"),
    ))


def needle_of(lower: Column) -> Column:
    return F.translate(lower, " -_", "")


def word_hit(word: Column, lower: Column, norm: Column) -> Column:
    return (word["word"] == "*") | F.contains(lower, word["lower"]) | F.contains(norm, word["needle"])


def hit_detection(kind: Column, word: Column, org_key: Column) -> Column:
    detail = F.concat(org_key, F.lit(']: "'), word, F.lit('"'))
    return first_of(*[(kind == key, finding("org", key, word, detail)) for key in ("block", "critical", "redact")])


@built_once
def org_signals(mode: str, worded: bool) -> Column:
    """What the intent layer looks for; ``worded`` frames have ``_words``."""
    norm, words = F.col("_norm"), Words(F.col("_words")) if worded else None
    return F.struct(*(any_needle(norm, listed, " ", mode, words).alias(name) for name, listed in (
        ("circumvention", C.ORG_CIRCUMVENTION), ("data", C.ORG_DATA), ("sharing", C.ORG_SHARING))))


def org_intent(prompt: Column, inquiry: Column) -> Column:
    s = F.col("_org_signals")
    return F.when(inquiry, F.array(finding("org", "inquiry"))).otherwise(first_of(
        (s["circumvention"], finding("org", "circumvention", prompt)),
        (s["data"] & s["sharing"], finding("org", "sharing", prompt)),
        (s["data"], finding("org", "data", prompt)),
    ))


def with_direct_hits(df: DataFrame, policies: DataFrame, small: bool) -> DataFrame:
    """Add ``_hits`` (detections before any stop) and ``_stopped``; ``small`` policies are broadcast."""
    matched, stop, hits = hit_columns()
    cleaned = clean_policies(policies)
    large = None if small or df.isStreaming else large_organisations(cleaned)
    if large is not None:
        cleaned = cleaned.join(large, "org_key", "left_anti")
    folded = cleaned.groupBy("org_key").agg(
        F.array_sort(F.collect_list(F.struct("id", "policy_sub_user", "effect", "words"))).alias("_policies"))
    joined = lookup_join(df, folded, ["org_key"], small=small).withColumn("_matched", matched).drop("_policies")
    if large is not None:
        joined = with_chunked_matches(joined, df, clean_policies(policies), large)
    return joined.withColumn("_stop", stop).withColumns({"_stopped": F.col("_stop") > 0, "_hits": hits}).drop(
        "_matched", "_stop")


def large_organisations(cleaned: DataFrame) -> DataFrame | None:
    """(org_key, _chunks) of the organisations whose keywords do not go into one row; None if there are none.

    Each has more than ``CHUNK_WORDS`` keywords, so they are few, and are kept as rows instead of being counted anew.
    """
    large = cleaned.groupBy("org_key").agg(F.ceil(F.sum("listed") / CHUNK_WORDS).cast("int").alias("_chunks")).where(
        "org_key IS NOT NULL AND _chunks > 1")
    rows = large.collect()
    return kept_rows(large, rows) if rows else None


def kept_rows(of: DataFrame, rows: list) -> DataFrame:
    return of.sparkSession.createDataFrame(rows, of.schema).coalesce(1)


def with_chunked_matches(joined: DataFrame, df: DataFrame, cleaned: DataFrame, large: DataFrame) -> DataFrame:
    """Set ``_matched`` of the requests of large organisations: first the stop of each text, then what comes before it."""
    # What decides, told apart by digest; the separator cannot occur in the hexadecimal parts.
    parts = [F.coalesce(F.sha2(F.col(c), 256), F.lit("-")) for c in ("org_key", "sub_user", "_lower", "_norm")]
    digest = F.unhex(F.sha2(F.concat_ws("|", *parts), 256))
    texts = lookup_join(df.select("org_key", "sub_user", "_lower", "_norm"), large, ["org_key"]).where("_chunks IS NOT NULL")
    # Nothing is reported of these, see ``found_org``.
    texts = texts.where(F.col("sub_user").isNotNull() & ~is_blank(F.col("_lower")))
    texts = texts.withColumn("_text", digest).drop("_chunks").dropDuplicates(["_text"])
    # Their keywords are made out later, of the policies that are needed.
    policies = cleaned.drop("words").join(F.broadcast(large.select("org_key")), "org_key", "left_semi")
    # Policies without their keywords, which are counted more than once.
    bare = kept(policies.select("org_key", "id", "effect", "listed"))

    texts = kept(texts)
    texts = kept(texts.join(stops_in_rounds(texts, policies.where(ALLOWS), bare.where(ALLOWS)), "_text", "left"))
    others = before_stops(texts, policies.where(f"NOT {ALLOWS}"), bare.where(f"NOT {ALLOWS}"))
    at_stop = texts.select("_text", F.explode("_at_stop").alias("p"), F.lit("").alias("word"))
    for part in others:
        at_stop = at_stop.unionByName(part)
    found = at_stop.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("p", "word"))).alias("_found"))
    of_large = F.transform("_found", lambda m: F.struct(m["p"]["effect"].alias("effect"), m["word"].alias("word")))

    keyed = lookup_join(joined, large, ["org_key"]).withColumn("_text", F.when(F.col("_chunks").isNotNull(), digest))
    return lookup_join(keyed, found, ["_text"], small=False).withColumn("_matched", F.coalesce(of_large, "_matched")).drop(
        "_text", "_chunks", "_found")


def text_partitions(df: DataFrame) -> int:
    return max(shuffle_partitions(df), df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    """``df``, worked out once and kept below ``spark.checkpoint.dir``, on a local master without it by Spark itself.

    Without a place to keep it, what uses it works it out anew. Spark deletes what is no longer referred to, below the
    folder where ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is not None:
        return df.checkpoint()
    return df.localCheckpoint() if context.master.startswith("local[") or context.master == "local" else df


def stops_in_rounds(texts: DataFrame, policies: DataFrame, bare: DataFrame) -> DataFrame:
    """``stops`` of the policies by rising id, so that texts do not meet those far behind their stop."""
    shares = bare.groupBy("org_key").agg(F.sum("listed").alias("n"), F.percentile_approx("id", [8.0 ** -j for j in range(ROUNDS)]).alias("cuts"))
    steps = {r["org_key"]: (max(0, min(ROUNDS - 1, math.ceil(math.log(max(r["n"], 1) / ROUND_WORDS, 8)))), r["cuts"]) for r in shares.collect()}
    schema = StructType([bare.schema["org_key"], *(StructField(c, bare.schema["id"].dataType) for c in ("_after", "_upto"))])
    found = []
    for k in range(1 + max((n for n, _ in steps.values()), default=0)):
        # The last round of an organisation takes all the rest, policies without an id too.
        ranges = [(org, cuts[n - k + 1] if k and cuts else None, cuts[n - k] if n > k and cuts else None)
                  for org, (n, cuts) in steps.items() if n >= k]
        now = F.broadcast(texts.sparkSession.createDataFrame(ranges, schema).coalesce(1))

        def of_round(rows: DataFrame) -> DataFrame:
            return rows.join(now, "org_key").where("(_upto IS NULL OR id <= _upto) AND (_after IS NULL OR id > _after OR id IS NULL)").drop(
                "_after", "_upto")

        found.append(kept(stops(texts, of_round(policies), of_round(bare))))
        texts = texts.join(found[-1], "_text", "left_anti")
        if texts.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def stops(texts: DataFrame, policies: DataFrame, bare: DataFrame) -> DataFrame:
    """(_text, _stop_id, _at_stop): the smallest id of the policies that texts meet, and the policies of that id."""
    words, small = measured_words(policies.withColumn("_band", F.lit(0)), bare)
    # Of each keyword only the first policy for a sub-user can be a stop.
    first = words.groupBy("org_key", "lower", F.col("p.policy_sub_user").alias("policy_sub_user")).agg(F.min("p.id").alias("id"))
    met = joined_with(held(texts, words, small), first, ["org_key", "lower"], small).where(applies("policy_sub_user"))
    least = met.groupBy("_text", "policy_sub_user").agg(F.min("id").alias("id"))
    policy = F.struct("id", "policy_sub_user", F.lit("allow").alias("effect"))
    return least.groupBy("_text").agg(F.min("id").alias("_stop_id"), F.collect_list(policy).alias("_least")).select(
        "_text", "_stop_id", F.filter("_least", lambda p: p["id"].eqNullSafe(F.col("_stop_id"))).alias("_at_stop"))


def before_stops(texts: DataFrame, policies: DataFrame, bare: DataFrame) -> list[DataFrame]:
    """(_text, p, word) of texts with a stop, up to it, and of those without one, where there are such."""
    reach = texts.groupBy("org_key").agg(F.percentile_approx("_stop_id", EARLY).alias("_most"), F.max("_stop_id").alias("_last"),
                                         F.count_if(F.col("_stop_id").isNull()).alias("_open"))
    rows = reach.collect()
    reach = F.broadcast(kept_rows(reach, rows))
    texts, found = texts.join(reach, "org_key"), []

    def up_to(last: str, some: DataFrame) -> DataFrame:
        def near(rows: DataFrame) -> DataFrame:
            return rows.join(reach, "org_key").where(F.col("id") <= F.col(last)).drop("_most", "_last", "_open")

        edges = F.broadcast(bands(near(bare)))
        banded = near(policies).join(edges, "org_key").withColumn("_band", band_of(F.col("id"))).drop("_edges")
        return words_met(some.join(edges, "org_key").withColumn("_reach", band_of(F.col("_stop_id"))).drop("_edges"), banded, near(bare))

    def all_of(rows: DataFrame) -> DataFrame:
        return rows.join(reach.where("_open > 0"), "org_key", "left_semi").withColumn("_band", F.lit(0))

    if any(r["_last"] is not None for r in rows):
        found.append(up_to("_most", texts.where("_stop_id <= _most")))
    if any(r["_last"] is not None and r["_last"] > r["_most"] for r in rows):
        found.append(up_to("_last", texts.where("_stop_id > _most")))
    if any(r["_open"] for r in rows):
        found.append(words_met(texts.where("_stop_id IS NULL").withColumn("_reach", F.lit(0)), all_of(policies), all_of(bare)))
    return found


def bands(policies: DataFrame) -> DataFrame:
    """(org_key, _edges): the ids that end a band of an organisation's policies, about one band a chunk, ``BANDS`` at most."""
    cut = policies.groupBy("org_key").agg(
        F.greatest(F.lit(1), F.floor(F.lit(BANDS) / F.ceil((F.sum("listed") + 1) / CHUNK_WORDS))).cast("int").alias("step"),
        F.percentile_approx("id", [k / BANDS for k in range(1, BANDS)]).alias("cuts"))
    return cut.select("org_key", F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % F.col("step") == 0)).alias("_edges"))


def band_of(policy_id: Column) -> Column:
    """The band of an id; it never falls as ids rise."""
    return F.coalesce(F.size(F.filter("_edges", lambda e: e < policy_id)), F.lit(0))


def words_met(texts: DataFrame, policies: DataFrame, bare: DataFrame) -> DataFrame:
    """(_text, p, word): the first keyword of each policy that texts hold, up to ``_stop_id`` where there is one.

    ``policies`` have a ``_band``, and texts the last band that they ``_reach``, so what comes after a stop costs little.
    """
    words, small = measured_words(policies, bare)
    first = words.groupBy("org_key", "lower", "_band", "p").agg(F.min("pos").alias("pos"))
    met = held(texts, words, small).withColumn("_band", F.explode(F.sequence(F.lit(0), "_reach")))
    met = joined_with(met, first, ["org_key", "lower", "_band"], small).where(
        applies("p.policy_sub_user") & (F.col("_stop_id").isNull() | (F.col("p.id") <= F.col("_stop_id"))))
    # Numbers are reduced without a sort; the keyword is looked up by its position.
    found = met.groupBy("_text", "org_key", "p").agg(F.min("pos").alias("pos"))
    at = words.groupBy("org_key", "p", "pos").agg(F.min("word").alias("word"))
    return joined_with(found, at, ["org_key", "p", "pos"], small).select("_text", "p", "word")


def joined_with(df: DataFrame, words: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return df.join(F.broadcast(words) if small else words, keys)


def applies(policy_sub_user: str) -> Column:
    return (F.col(policy_sub_user) == "*") | (F.col(policy_sub_user) == F.lower("sub_user"))


def measured_words(policies: DataFrame, bare: DataFrame) -> tuple[DataFrame, bool]:
    """``spread_words``, and whether they are few enough to be broadcast. They are kept unless the keywords are many.

    ``bare`` are the same policies without keywords.
    """
    if (bare.agg(F.sum("listed")).first()[0] or 0) > KEPT_WORDS:
        return spread_words(policies), False
    # Policies that are read together may be next to each other.
    words = kept(spread_words(policies.repartition(text_partitions(policies), "org_key", "id")))
    return words, is_small(words, MET_ROWS)


def spread_words(policies: DataFrame) -> DataFrame:
    """(org_key, _band, p, pos, word, lower): the keywords of policies that can be the first one found.

    A text that holds a keyword holds whatever lies in it, so one that holds an earlier keyword of its policy is left out. It is
    compared with ``HEADS`` early keywords, as more would cost long policies their square.
    """
    def without(words: Column, heads: Column) -> Column:
        return let(heads, lambda heads: F.filter(words, lambda w: ~F.exists(
            heads, lambda h: (h["pos"] < w["pos"]) & F.contains(w["lower"], h["lower"]) & F.contains(w["needle"], h["needle"]))))

    def free(words: Column) -> Column:
        early = without(F.slice(words, 1, 4 * HEADS), F.slice(words, 1, HEADS // 8))
        return without(words, F.slice(early, 1, HEADS))

    placed = F.transform(listed_words("keyword_list"), lambda w, i: F.struct(
        i.alias("pos"), w["word"].alias("word"), w["lower"].alias("lower"), w["needle"].alias("needle")))
    policy = F.struct("id", "policy_sub_user", "effect").alias("p")
    return policies.select("org_key", "_band", policy, F.explode(let(placed, free)).alias("w")).select("org_key", "_band", "p", "w.pos", "w.word", "w.lower")


def held(texts: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """Texts without their text, a row for each distinct keyword (``lower``) that they hold; ``small`` words are broadcast."""
    # What follows stays where its text is, as long as the words are broadcast.
    texts = texts.repartition(text_partitions(texts), "_text")
    lower, needle = F.col("lower"), needle_of(F.col("lower"))
    keys = words.select("org_key", "lower").distinct().select("org_key", "lower", F.explode(key_grams(lower, needle)).alias("_gram"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split("_lower", BREAKS), F.split("_norm", BREAKS)))
    tokens = texts.select("_text", "org_key", F.explode(tokens).alias("_token"))
    gram = F.explode(token_grams(F.col("_token"))).alias("_gram")
    if small:
        pairs = tokens.select("_text", "org_key", gram).join(F.broadcast(keys), ["org_key", "_gram"])
    else:
        distinct = tokens.select("org_key", "_token").distinct().select("org_key", "_token", gram)
        of_tokens = distinct.join(keys, ["org_key", "_gram"]).select("org_key", "_token", "lower").distinct()
        pairs = lookup_join(tokens, of_tokens, ["org_key", "_token"], salt_by="_text", how="inner", small=False).repartition(
            text_partitions(texts), "_text")
    pairs = pairs.select("_text", "lower").distinct()
    # Whole in one piece, and nothing is lost by normalising: texts that meet it hold it.
    sure = (lower == needle) & (F.length(lower) <= GRAM) & ~lower.rlike(BREAKS) & (lower != "*")
    word = F.struct(lower.alias("word"), lower.alias("lower"), needle.alias("needle"))
    return pairs.join(texts.hint("shuffle_hash"), "_text").where(
        sure | word_hit(word, F.col("_lower"), F.col("_norm"))).drop("_lower", "_norm", "_at_stop")


def key_grams(lower: Column, needle: Column) -> Column:
    """The pieces of a keyword of which a text that holds it has one: starts of the longest parts of both its forms.

    What every text holds has the empty piece, which every text has.
    """
    def start(form: Column) -> Column:
        longest = F.array_max(F.transform(F.split(form, BREAKS), lambda part: F.struct(F.length(part).alias("n"), part.alias("part"))))
        return F.substring(longest["part"], 1, GRAM)

    starts = F.filter(F.array(start(lower), start(needle)), lambda part: part != "")
    return F.when((lower == "*") | (needle == ""), F.array(F.lit(""))).otherwise(F.array_distinct(starts))


def token_grams(token: Column) -> Column:
    """The pieces of a token of up to ``GRAM`` characters; the empty one of an empty token.

    A long token is cut into windows that lap over, so that its cost does not grow with its square.
    """
    def pieces(window: Column) -> Column:
        n = F.length(window)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(WINDOW))), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(n - i + 1, F.lit(GRAM))), lambda size: F.substring(window, i, size))))

    def lapping(cut: Column) -> Column:
        return F.transform(cut, lambda part, i: F.concat(part, F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, GRAM - 1)))

    cut = F.regexp_extract_all(token, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
    windows = F.when(F.length(token) <= WINDOW, F.array(token)).otherwise(let(cut, lapping))
    return F.when(token == "", F.array(F.lit(""))).otherwise(F.flatten(F.transform(windows, pieces)))


@built_once
def hit_columns() -> tuple[Column, Column, Column]:
    """The policies that match, the position of the first that stops the search (0: none), and the detections."""
    lower, norm, sub = F.col("_lower"), F.col("_norm"), F.lower("sub_user")
    applicable = F.filter("_policies", lambda p: (p["policy_sub_user"] == "*") | (p["policy_sub_user"] == sub))
    matched = F.filter(
        F.transform(applicable, lambda p: F.struct(
            p["effect"].alias("effect"),
            F.get(F.filter(p["words"], lambda w: word_hit(w, lower, norm)), F.lit(0))["word"].alias("word"),
        )),
        lambda m: m["word"].isNotNull(),
    )
    stop = F.array_position(F.transform("_matched", lambda m: m["effect"]), "allow")
    hits = F.flatten(F.transform(
        F.when(F.col("_stop") > 0, F.slice("_matched", F.lit(1), (F.col("_stop") - 1).cast("int")))
        .otherwise(F.col("_matched")),
        lambda m: hit_detection(m["effect"], m["word"], F.col("org_key")),
    ))
    return matched, F.coalesce(stop, F.lit(0)), F.coalesce(hits, no_detections())


def policies_small(policies: DataFrame) -> bool:
    return is_small(policies, POLICY_ROWS, POLICY_BYTES)


def detect_org_keywords(
    df: DataFrame,
    policies: DataFrame,
    prompt: str = "prompt",
    mode: str = "compact",
    plan: str = "auto",
    small: bool | None = None,
) -> DataFrame:
    """Add ``_found_org`` to a frame with ``org_key``, ``sub_user`` and the text columns.

    ``plan``: ``auto`` picks by the measured size of the policies, ``broadcast`` refuses those above the bound, ``join``
    never broadcasts. ``small`` is the outcome of ``policies_small`` where it is known.
    """
    if small is None:
        small = plan != "join" and policies_small(policies)
    if plan == "broadcast" and not small:
        raise ValueError("the policies are too large to be broadcast; use plan='join'")
    # Looked for here, so that a join does not move the words.
    df = df.withColumn("_org_signals", org_signals(mode, "_words" in df.columns))
    applied = with_direct_hits(df, policies, small)
    return applied.withColumn("_found_org", found_org(prompt)).drop("_hits", "_stopped", "_org_signals")


@built_once
def found_org(prompt: str) -> Column:
    nobody = F.col("org_key").isNull() | F.col("sub_user").isNull() | is_blank(F.col(prompt))
    intent = org_intent(F.col(prompt), F.col("_inquiry"))
    found = F.when(nobody, no_detections()).when(
        ~F.col("_stopped") & (F.size("_hits") > 0), F.col("_hits")
    ).otherwise(F.concat(F.col("_hits"), intent))
    return found.cast(DETECTIONS_TYPE)
