"""Quality rules with adaptive thresholds.

Rates of each document (symbols a word, repeated lines, repeated three-word windows, word length) are held against
thresholds of its language and source, not against fixed cutoffs. The thresholds come from quantile sketches: counts of
log-spaced buckets (relative error ``ERROR``), which add up. They hold the documents that pass the fixed part, are summed
by (language, source) and merged upwards to the language and to everything. Each group is shrunk towards the next larger
one by counts: ``BORROWED`` documents dealt as in that group are added to its own, so small groups lean on the larger
one, large ones hardly do, and no size switches. A rate is out of line above the tail of its group: ``FENCE`` times the
distance between the two quantiles of ``TAIL`` beyond the upper one, and at least ``GAP`` beyond it, which is a guard against
ties and the sketch's error only. Symbols and word length have no fixed rule, so junk may be in their tails: their fence
starts at the median and the upper tenth. Of repeats the fixed part has removed the gross cases, and the tail is read to 99 %.

A document fails the fixed part if it has fewer than 50 words or if more than half of its words stand in three-word
windows that occur twice in it. All of it is DataFrame expressions; the only shuffles are of sums of bucket counts.

Null texts have no words. Null languages and sources are groups of their own. Windows within a text are told apart by
64-bit hashes of their words. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from screenwright.functions.text import settled

from .common import SPACE, WORD, keep, look_up
from .spans import quoted

# Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50

ERROR = 0.01
BORROWED = 1000
FENCE = 2.0
#: Quantiles of every rate that its fence comes from, and the smallest distance from the upper one that is out of line.
TAIL = {"symbols": ("q50", "q90"), "dup_lines": ("q95", "q99"), "repeats": ("q95", "q99"), "word_length": ("q50", "q90")}
GAP = {"symbols": 0.02, "dup_lines": 0.05, "repeats": 0.05, "word_length": 0.25}
_GAMMA = (1 + ERROR) / (1 - ERROR)
#: Rates below this are bucket null of the sketch (zero).
_LEAST = 1e-4


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words in the struct ``_q``."""
    t = f"`{text}`"
    out = docs.withColumn("_words", F.expr(f"array_remove(split({t}, {quoted(SPACE + '+')}), '')"))
    out = out.withColumn("_n", F.greatest(F.coalesce(F.size("_words"), F.lit(0)), F.lit(0)))
    out = out.withColumn("_windows", F.expr(
        "CASE WHEN _n >= 3 THEN transform(sequence(0, _n - 3), "
        "i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) ELSE array() END"))
    out = out.withColumn("_lines", F.expr(f"filter(split({t}, '\\n', -1), x -> x RLIKE {quoted(WORD)})"))
    # Only texts with a repeated window pay for sorting: equal windows become neighbours with ascending positions,
    # then positions in ascending order add what each window covers beyond the one before.
    out = out.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, "
        "(h, i) -> named_struct('h', h, 'i', i))) END"))
    out = out.withColumn("_again", F.expr(
        "CASE WHEN _sorted IS NOT NULL THEN sort_array(filter(zip_with(zip_with(_sorted, "
        "slice(_sorted, 2, size(_sorted) - 1), (a, b) -> named_struct('x', a, 'next', b.h)), "
        "concat(array(named_struct('h', CAST(NULL AS BIGINT), 'i', -1)), slice(_sorted, 1, size(_sorted) - 1)), "
        "(a, b) -> IF(a.x.h = a.next OR a.x.h = b.h, a.x.i, CAST(NULL AS INT))), x -> x IS NOT NULL)) END"))
    # Settled, as a filter on a measure would else be worked out on the text, in nested lambdas.
    out = out.withColumn("_q", settled(F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.expr("coalesce(CAST(length(array_join(_words, '')) AS BIGINT), 0L)").alias("word_chars"),
        F.coalesce(F.expr(f"regexp_count({t}, {quoted(SYMBOLS)})"), F.lit(0)).cast("long").alias("n_symbols"),
        F.expr("coalesce(CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT), 0L)").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(_again, named_struct('last', -3, 'n', 0L), (s, i) -> named_struct('last', i, "
               "'n', s.n + least(3, i - s.last)), s -> s.n), 0L)").alias("n_repeat_words"),
        F.expr("coalesce(CAST(size(_lines) AS BIGINT), 0L)").alias("n_lines"))))
    return out.drop("_words", "_n", "_windows", "_lines", "_sorted", "_again")


def _rates() -> dict[str, str]:
    return {"symbols": "_q.n_symbols / _q.n_words", "dup_lines": "_q.n_dup_lines / _q.n_lines",
            "repeats": "_q.n_repeat_words / _q.n_words", "word_length": "_q.word_chars / _q.n_words"}


def _failed() -> Column:
    return (F.col("_q.n_words") < LEAST_WORDS) | (F.col("_q.n_repeat_words") * 100 > F.col("_q.n_words") * MOST_REPEATED)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts of every rate by group: columns of ``keys``, rate, bucket, n. Sketches merge by adding counts."""
    rates = F.expr("array(" + ", ".join(
        f"named_struct('rate', '{k}', 'bucket', IF({v} < {_LEAST}D, -100000, "
        f"CAST(ceil(ln({v}) / {math.log(_GAMMA)!r}D) AS INT)))" for k, v in _rates().items()) + ")")
    return (measured.where("_q.n_words > 0").select(*keys, F.explode(rates).alias("x"))
            .groupBy(*keys, "x.rate", "x.bucket").agg(F.count(F.lit(1)).alias("n")))


def _quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles of every group and rate from bucket counts."""
    by = Window.partitionBy(*keys, "rate")
    summed = counts.withColumn("total", F.sum("n").over(by)).withColumn(
        "upto", F.sum("n").over(by.orderBy("bucket")))
    value = f"IF(bucket = -100000, 0D, 2 * pow({_GAMMA!r}D, bucket) / ({_GAMMA!r}D + 1))"
    return summed.groupBy(*keys, "rate").agg(
        *(F.expr(f"min(IF(upto >= {q} * total, {value}, NULL))").alias(name)
          for name, q in (("q50", 0.5), ("q3", 0.75), ("q90", 0.9), ("q95", 0.95), ("q99", 0.99))))


def shrunk(counts: DataFrame, keys: list[str], parent: DataFrame, above: list[str]) -> DataFrame:
    """Counts by ``keys`` with ``BORROWED`` documents more, dealt as in the larger group, which has the keys ``above``.
    In whole millionths, so that sums do not depend on the order of rows."""
    share = parent.withColumn("total", F.sum("n").over(Window.partitionBy(*above, "rate")))
    share = share.withColumn("n", F.expr(f"CAST(round({BORROWED}D * 1000000 * n / total) AS BIGINT)"))
    share = share.select(*(F.col(k).alias(f"{k}_above") for k in above), F.col("rate").alias("rate_above"), "bucket", "n")
    groups = counts.select(*keys, "rate").distinct()
    same = F.col("rate") == F.col("rate_above")
    for k in above:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_above"))
    lent = groups.join(share, same).select(*keys, "rate", "bucket", "n")
    own = counts.select(*keys, "rate", "bucket", (F.col("n") * 1_000_000).alias("n"))
    return own.unionByName(lent).groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, fence, floor): the fence, and whether ``GAP`` decides it."""
    def of_rate(values: dict[str, str]) -> str:
        return "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"

    found = _quantiles(counts, keys).withColumns({
        "low": F.expr(of_rate({k: v[0] for k, v in TAIL.items()})), "high": F.expr(of_rate({k: v[1] for k, v in TAIL.items()})),
        "gap": F.expr(of_rate({k: f"{v}D" for k, v in GAP.items()}))})
    reach = FENCE * (F.col("high") - F.col("low"))
    return found.select(*keys, "rate", (F.col("high") + F.greatest(reach, F.col("gap"))).alias("fence"),
                        (reach < F.col("gap")).alias("floor"))


def group_fences(measured: DataFrame) -> DataFrame:
    """``fences`` of every (_lang, _source)."""
    fine = keep(sketches(measured.where(~_failed()), ["_lang", "_source"]), "sketches")
    wider = fine.groupBy("_lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    widest = fine.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    by_lang = keep(shrunk(wider, ["_lang"], widest, []), "of_lang")
    return fences(shrunk(fine, ["_lang", "_source"], by_lang, ["_lang"]), ["_lang", "_source"])


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a (language, source): a struct of thresholds."""
    named = measured.withColumns({"_lang": F.col(f"`{lang}`"), "_source": F.col(f"`{source}`")})
    limits = group_fences(named).groupBy("_lang", "_source").agg(F.struct(
        *(F.max(F.when(F.col("rate") == k, F.col("fence"))).alias(k) for k in GAP)).alias("_limits"))
    return keep(limits, "thresholds")


def with_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                 carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all), the measures ``_q``, ``_base_failed`` and ``_kept``."""
    carry = docs.columns if carry is None else carry
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col(f"`{text}`").alias("_text"),
                         F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"))
    # The measures are written once and read twice, so that no filter on them reaches the texts and splits them again.
    measured = keep(measures(packed, "_text").drop("_text"), "measures")
    limits = thresholds(measured, "_lang", "_source")
    joined = look_up(measured, limits, ["_lang", "_source"])
    failed = _failed()
    out_of_line = F.expr(" OR ".join(f"coalesce({v} > _limits.{k}, false)" for k, v in _rates().items()))
    return joined.select(*(F.col("_row").getField(c).alias(c) for c in carry), "_q", failed.alias("_base_failed"),
                         F.when(failed, False).otherwise(~out_of_line).alias("_kept"))  # one CASE: not split and pushed down


def digest(docs: DataFrame) -> DataFrame:
    found = with_quality(docs.select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return found.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
                        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
