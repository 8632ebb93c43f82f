"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint of its shingles; fingerprints link at ``DISTANCE`` or fewer differing bits, and
documents get the smallest id that links reach. Copies share a fingerprint, so work is done on distinct fingerprints.

A fingerprint is cut into DISTANCE + w blocks. Of two linked ones at most DISTANCE blocks differ, so at least w blocks
are equal: they share one of the choices of w blocks, and every choice with its bits is a key. w is chosen from the
number of distinct fingerprints so that chance meets are rare; every w finds every link. Rows of a key meet in one
task, are compared there by blocks of a matrix, and only a spanning forest of the links leaves it, never all pairs. A key
with more than ``TILE`` fingerprints is split: they are dealt to tiles, and each pair of tiles meets in a task of its own.
Components come from repeated hooking to the smallest neighbour, written to the shared folder each round.

Null and wordless texts have fingerprint zero and link like any other. Components are null only where no linked document
has an id. Rows that repeat get a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts, mapped
from .hashing import word_bounds

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a key compared in one task at most.
TILE = 2048
#: Chance meets a key may have on average.
MEETS = 4.0


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    data = b" ".join(text.encode().lower().split()) if text else b""
    if not data:
        return 0
    start, end = word_bounds(data)
    n = len(start) - size + 1
    if n < 1:
        h = np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
        n = 1
    else:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(data[a:b], SEED) for a, b in zip(start[:n].tolist(), end[size - 1:].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 32_768):
        bits = np.unpackbits(h[at:at + 32_768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) and ``_fp``, the signed fingerprint."""
    def make():
        return lambda texts: [[fingerprint(t) for t in texts]]

    carry = docs.columns if carry is None else carry
    return map_texts(docs, text, carry, "fp long", make).withColumn("_fp", F.col("_found.fp")).drop("_found")


def choices(n: int, distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """The keys: for each, the mask of its bits, so that distinct fingerprints meet about ``MEETS`` others by chance."""
    for w in range(1, 9):
        blocks = distance + w
        if n / 2 ** (64 * w / blocks) <= MEETS or w == 8:
            break
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in c) for c in combinations(range(blocks), w)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``fp``."""
    n = len(fp)
    label = np.arange(n)
    while True:
        before = label.copy()
        for at in range(0, n, 512):
            near = np.bitwise_count(fp[at:at + 512, None] ^ fp[None, :]) <= distance
            label[at:at + 512] = np.where(near, label[None, :], n).min(axis=1)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def _links(distance: int):
    """Task: rows sorted by (key, tile): compares the fingerprints of each run and gives the edges of a forest."""

    def work(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, tile, fp = (np.concatenate([r[i] for r in rows]) for i in range(3))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(key)]]))
        run = np.cumsum(new) - 1
        f = fp.astype(np.uint64)
        a, b = [], []
        # Short runs: all at once, by the distance of places.
        most = int(size[size <= 32].max(initial=0))
        for d in range(1, most):
            i = np.flatnonzero((run[:-d] == run[d:]) & (size[run[:-d]] <= 32))
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
            a.append(f[i + d])
            b.append(f[i])
        for k in np.flatnonzero(size > 32).tolist():
            x, y = _forest(f[start[k]:start[k] + size[k]], distance)
            a.append(x)
            b.append(y)
        a, b = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            own = tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            rows.append(own)
            n += len(own[0])
            if n >= 200_000:  # all but the last run, which may go on
                key, tile, fp = (np.concatenate([r[i] for r in rows]) for i in range(3))
                last = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield work([(key[:cut], tile[:cut], fp[:cut])])
                    rows = [(key[cut:], tile[cut:], fp[cut:])]
                    n = len(rows[0][0])
        if n:
            yield work(rows)

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    n = distinct.count()
    spark = distinct.sparkSession
    masks = choices(n, distance)
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "bits")
    keyed = distinct.select("fp", keys).select("fp", F.xxhash64("choice", "bits").alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    hot = keep(hot.select("key", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("tiles")), "hot")
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("tile"), "fp")
    else:
        # Fingerprints of a hot key go to every pair of tiles that has their own.
        mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
        found = keyed.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("mine", mine)
        found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        pair = F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")
        dealt = found.select("key", pair.alias("tile"), "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(masks) / 2_000_000))
    met = dealt.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile")
    return mapped(met, _links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint with a link: rounds of linking all neighbours to the smallest one."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = keep(ordered, "edges")
    while True:
        # Every vertex and its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "low")
        upper = low.select(F.col("a").alias("b"), F.col("root").alias("above"))
        if edges.join(low, "a").join(upper, "b").where("b <> root OR b <> above").isEmpty():
            return low.select(F.col("a").alias("fp"), "root")  # stars
        # Neighbours hook to the smallest one, and so does the vertex: components stay as they are.
        hooked = both.join(low, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
            low.select("a", F.col("root").alias("b"))).where("a <> b")
        edges = keep(hooked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")


def classes(hashed: DataFrame, doc_id: str, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component) of every fingerprint in ``hashed``: its group, and the smallest id that links reach."""
    distinct = keep(hashed.groupBy(F.col("_fp").alias("fp")).agg(F.min(f"`{doc_id}`").alias("least")), "distinct")
    found = keep(components(links(distinct.select("fp"), distance)), "components")
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return keep(rooted.join(smallest, "root").select("fp", "root", "component"), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """doc_id, ``_fp`` and ``component`` of every document."""
    hashed = keep(fingerprints(docs, text, [doc_id]), "fingerprints")
    found = classes(hashed, doc_id, distance)
    # Copies make hot fingerprints; the join is one that AQE splits.
    return hashed.join(found, hashed["_fp"] == found["fp"], "left").select(f"`{doc_id}`", "_fp", "component")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One document of each group: that with the smallest id; where ids are missing or repeat, the smallest digest of
    the text, then any of the equal rows."""
    hashed = keep(fingerprints(docs.withColumn("_h", F.xxhash64(F.col(f"`{text}`"))), text, [doc_id, "_h"]), "fingerprints")
    found = classes(hashed, doc_id, distance)
    met = hashed.join(found, hashed["_fp"] == found["fp"], "left")
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.col("_h").alias("h"))
    # A group's key is its root: ids may be missing, or repeat in other groups.
    best = met.groupBy("root").agg(F.min(order).alias("o"))
    best = keep(best.select(F.col("o.id").alias("_id"), F.col("o.h").alias("_h")), "best")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                         F.col(f"`{doc_id}`").alias("_d"), F.xxhash64(F.col(f"`{text}`")).alias("_t"))
    same = packed["_d"].eqNullSafe(best["_id"]) & (packed["_t"] == best["_h"])
    kept = packed.join(best, same, "left_semi")
    if hashed.groupBy(f"`{doc_id}`", "_h").count().where("count > 1").isEmpty():
        return kept.select("_row.*")
    return kept.groupBy("_d", "_t").agg(F.first("_row").alias("_row")).select("_row.*")


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", as_hex("_fp").alias("fingerprint"), F.col("component").alias("component_id"))
