"""Joining a large frame to a dimension whose size is not known in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A dimension up to this many rows is sent to every executor; above it, both sides are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A micro-batch cannot be counted before it is joined: in streams every key is spread over this many buckets.
STREAM_BUCKETS = 32


def is_small(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a dimension: true if its rows and the length of its text are below the bounds.

    The count stops at the bound, so measuring a huge table does not read all of it.
    """
    text = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("bigint")
            for f in dim.schema.fields if f.dataType.typeName() == "string"]
    width = F.lit(16 * len(dim.columns)).cast("bigint")
    for length in text:
        width = width + length
    rows, size = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys too frequent for one task, with the number of ``_buckets`` to spread each over.

    A key is hot if it holds more than a quarter of a mean shuffle partition, and gets a bucket for each quarter. Every
    hot key holds more than 1 / (4 x partitions) of the rows, so there are fewer than 4 x partitions of them and at most
    twice as many buckets, whatever the data: the result can be broadcast.
    """
    quarters = 4 * shuffle_partitions(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(*keys, F.ceil(F.col("_n") * quarters / total).cast("int").alias("_buckets")).where(
        "_buckets > 1")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(
    df: DataFrame,
    dim: DataFrame,
    keys: list[str],
    salt_by: str | None = None,
    how: str = "left",
    small: bool | None = None,
) -> DataFrame:
    """Equi-join ``df`` to a dimension with at most one row per key.

    A small dimension is broadcast and ``df`` is not moved. A large one is shuffled. The rows of a hot key (see
    ``hot_keys``) are spread over buckets by ``salt_by`` and a digest of the plain columns, and the row of the dimension
    is repeated for these keys only; rows without a key are spread over all tasks. In streams each key is spread over
    ``STREAM_BUCKETS``.
    """
    if small is None:
        small = is_small(dim)
    if small:
        return df.join(F.broadcast(dim), keys, how)
    digest = row_digest(df, salt_by)
    if df.isStreaming:
        salted = df.withColumn("_salt", bucket(digest, F.lit(STREAM_BUCKETS)))
        repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(STREAM_BUCKETS - 1))))
        return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
    hot = F.broadcast(hot_keys(df.select(*keys), keys))
    buckets = F.coalesce("_buckets", F.lit(1))
    keyless = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    salted = df.join(hot, keys, "left").withColumn(
        "_salt", bucket(digest, F.when(keyless, shuffle_partitions(df)).otherwise(buckets))).drop("_buckets")
    repeated = dim.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), buckets - 1))).drop("_buckets")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def row_digest(df: DataFrame, first: str | None = None) -> Column:
    """Digest of the plain columns of a row."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    by = plain if first is None else [first, *(c for c in plain if c != first)]
    return F.xxhash64(*(F.col(f"`{c}`") for c in by))


def bucket(digest: Column, buckets: Column) -> Column:
    return F.pmod(digest, buckets).cast("int")
