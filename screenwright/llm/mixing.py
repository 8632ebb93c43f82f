"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 3, 1, 2 and so on, and share 150 % of all words; a target stops at twice
its source's size and the excess is shared again by weight until none is above. Every document of a source then expects
target / size copies. Within its source, documents in order of size are prefix-summed, one random offset (from a digest
of the source) is added, and a document is emitted once for each integer boundary its stretch crosses. In order of size,
every stretch of the source is sampled at its rate, so words taken come near the target and no document is taken more
than twice.

The prefix sums have no group in one task: rows are range-partitioned by (source, size, id), so a hot source spreads
over many partitions; places add up from counts by (partition, source) and a rank inside the partition. Tables that two
steps read are written to the shared folder once.

Null texts have size 0. Repeated rows count each. A source of size 0 has target 0. Equal rows may swap places. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, look_up
from .spans import quoted

# Fixed values of the contract.
WEIGHTS = [3, 1, 2]
SHARE_NUMERATOR, SHARE_DENOMINATOR, CAP = 3, 2, 2


def size_of(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count(`{text}`, {quoted(WORD)})"), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place (from 0) within its group in that order, without one task a group."""
    keys = [Column.asc_nulls_last(F.col(k)) for k in group]
    ranged = keep(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    starts = keep(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    ranked = ranged.withColumn(name, F.row_number().over(inside) - 1)
    out = look_up(ranked, starts, ["_part", *group], "inner")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source; ``sizes`` has source and size."""
    sources = keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = numbered(sources.withColumn("_one", F.lit(1)), ["_one"], [F.col("source").asc_nulls_last()], "_rank").drop("_one")
    weight = F.expr(f"element_at(array({', '.join(map(str, WEIGHTS))}), CAST(_rank % {len(WEIGHTS)} AS INT) + 1)")
    weighed = keep(ranked.withColumn("weight", weight.cast("long")), "weights")
    # Sharing again: `level` is what a weight of one gets; sources that it lifts above their cap stop there.
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * CAP
        s = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.lit(1)).otherwise(0)).alias("n"),
            F.sum(F.when(above, F.col("source_size") * CAP).otherwise(0)).alias("stopped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if not s["weights"] or s["n"] == capped:
            break
        capped = s["n"]
        level = (s["all"] * SHARE_NUMERATOR - s["stopped"] * SHARE_DENOMINATOR) / float(SHARE_DENOMINATOR * s["weights"])
    target = F.least(F.col("weight") * F.lit(level or 0.0), (F.col("source_size") * CAP).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def offset_of(source: Column) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` (source, size, and an order column ``doc_id``) with source_size, target and copies."""
    limits = keep(targets(keyed), "targets")
    placed = numbered(keyed, ["source"], [F.col("size").asc(), F.col("doc_id").asc_nulls_last()], "_place")
    out = look_up(placed, limits, ["source"], "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = offset_of(F.col("source"))
    crossed = F.floor(rate * (F.col("_place") + 1) + offset) - F.floor(rate * F.col("_place") + offset)
    return out.withColumn("copies", crossed.cast("int")).drop("_place")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed documents: columns of ``docs`` and ``copy_no`` from 1, each row as often as it is emitted.

    The copies of a document are looked up by its id and text digest, so rows without an id and repeated ids are told
    apart; rows that repeat entirely share the copies of their places.
    """
    keyed = keep(docs.select(F.col(f"`{source}`").alias("source"), size_of(text).alias("size"),
                             F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash")), "sizes")
    counted = copies(keyed).groupBy("source", "doc_id", "_hash").agg(
        F.sort_array(F.collect_list("copies")).alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                         F.col(f"`{source}`").alias("_s"), F.col(f"`{doc_id}`").alias("_d"),
                         F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    counted = counted.withColumn("_total", F.expr("aggregate(_copies, 0, (s, x) -> s + x)"))
    counted = keep(counted.where("_total > 0").withColumnsRenamed({"source": "_s2", "doc_id": "_d2", "_hash": "_h2"}),
                   "copies")
    found = packed.join(counted, F.col("_s").eqNullSafe(F.col("_s2")) & F.col("_d").eqNullSafe(F.col("_d2"))
                        & F.col("_h").eqNullSafe(F.col("_h2")), "inner")
    if counted.where("_rows > 1").isEmpty():
        found = found.withColumn("_own", F.col("_total"))
    else:  # rows with the same id and text: each takes the copies of one of their places
        number = Window.partitionBy("_s", "_d", "_h").orderBy(F.lit(1))
        found = found.withColumn("_own", F.element_at("_copies", F.row_number().over(number)))
    return found.where("_own > 0").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns),
                                          F.explode(F.sequence(F.lit(1), F.col("_own"))).alias("copy_no"))


def digest(docs: DataFrame) -> DataFrame:
    keyed = keep(docs.select("doc_id", "source", size_of("text").alias("size")), "sizes")
    out = copies(keyed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
