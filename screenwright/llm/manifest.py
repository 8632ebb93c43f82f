"""Merkle manifest of a dataset, with an inclusion proof for every row, from nested-interval labels.

Each row is a leaf; the leaves of a group (language), in order of id, make a binary tree, and the trees' roots, in order
of the group, make the tree above them. A node is labelled with the interval of leaf ranks that it covers. A node of
level k covers ``[i << k, (i + 1) << k)`` cut at the number of leaves, so a containment join needs no search: what lies
in a node shares the key ``rank >> k``.

Levels are handled in buckets of ``LEVELS``. All leaves below one node at the top of a bucket meet in one row of at most
``2 ** LEVELS`` members, where the nodes between are worked out: the sibling of a node is the interval of its parent
less its own. Nodes at the top are the members of the next bucket of levels; its paths, found from the root downwards,
are attached by a join on the node that contains the interval. So rows are moved twice to be ranked and once to be
bucketed, as digests without texts, and each further bucket of levels is ``2 ** LEVELS`` times smaller; no group, however
hot, meets in one task.

Nulls in any column are hashed as ``-``. Rows without an id come first; repeated rows are leaves of their own, in either
order, as their digests are equal. Rows without a group are a group, which comes first. A single leaf is its root, and its proof the
digest of nothing. An empty table has no rows. Texts are hashed whole, in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, look_up, mapped
from .mixing import numbered

#: Levels of a tree that are worked out together; a bucket has at most two to this power members.
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a step of a path: its side, then the sibling's digest (zeros for none).
STEP = 33
NONE, LEFT, RIGHT = 0, 1, 2


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    """SHA-256 of the values' fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256))


def joined(*digests: bytes) -> bytes:
    """The digest of digests written as lowercase hex."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Node(NamedTuple):
    """A node of a tree: the ranks of leaves that it covers, end exclusive, and its digest."""

    start: int
    end: int
    digest: bytes


def parents(nodes: list[Node]) -> list[Node]:
    """Every two consecutive nodes joined; a last one is joined alone."""
    return [Node(run[0].start, run[-1].end, joined(*(n.digest for n in run)))
            for run in (nodes[i:i + 2] for i in range(0, len(nodes), 2))]


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return max(0, leaves - 1).bit_length()


def climb(members: list[Node], levels: int) -> tuple[Node, list[bytes]]:
    """The node above all members after so many levels, and the path of each member to it, lowest step first."""
    rows, paths = [members], [b""] * len(members)
    for _ in range(levels):
        rows.append(parents(rows[-1]))
    for below, above in zip(rows, rows[1:], strict=False):
        at = {n.start: n for n in below}
        ends = {n.end: n for n in below}
        over, k = above[0], 0
        for i, leaf in enumerate(members):
            while leaf.start >= over.end:
                k += 1
                over = above[k]
            own = next_below(at, over, leaf)
            # What the parent covers and the node does not is its sibling.
            if own.start > over.start:
                paths[i] += bytes([LEFT]) + at[over.start].digest
            elif own.end < over.end:
                paths[i] += bytes([RIGHT]) + ends[over.end].digest
            else:
                paths[i] += bytes([NONE]) + bytes(STEP - 1)
    return rows[-1][0], paths


def next_below(at: dict[int, Node], over: Node, leaf: Node) -> Node:
    """The child of ``over`` that contains ``leaf``."""
    first = at[over.start]
    return first if leaf.start < first.end else at[first.end]


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(path), STEP):
        yield path[i], path[i + 1:i + STEP]


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for side, other in steps(path):
        leaf = joined(other, leaf) if side == LEFT else joined(leaf, other) if side == RIGHT else joined(leaf)
    return leaf


def proof(path: bytes) -> bytes:
    return joined(*(other for side, other in steps(path) if side != NONE))


def _members(row: dict) -> list[Node]:
    return [Node(m["start"], m["end"], m["digest"]) for m in row["members"]]


def _levels(row: dict, band: int, levels: int) -> int:
    return min(levels, height(row["leaves"]) - band * levels)


def _tops(band: int, levels: int) -> Callable:
    """Bucket rows to the node at the top of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                top, _ = climb(_members(row), _levels(row, band, levels))
                out.append({"group": row["group"], "leaves": row["leaves"], "start": top.start, "end": top.end, "digest": top.digest})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch, ["group", "leaves"], start=pa.int64(), end=pa.int64(), digest=pa.binary()))
    return run


def _paths(band: int, levels: int) -> Callable:
    """Bucket rows with the path above them to a row for each member with its whole path to the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                top, paths = climb(_members(row), _levels(row, band, levels))
                root = row["root"] or top.digest
                out += [{"group": row["group"], "start": m["start"], "path": p + (row["path"] or b""), "root": root}
                        for m, p in zip(row["members"], paths, strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch, ["group"], start=pa.int64(), path=pa.binary(), root=pa.binary()))
    return run


def _arrow(batch: pa.RecordBatch, same: list[str], **more: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(n, batch.schema.field(n).type) for n in same] + [pa.field(n, t) for n, t in more.items()])


def bucketed(nodes: DataFrame, band: int, levels: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each node at the top of a bucket of levels: (group, leaves, bucket, members in order of rank)."""
    member = F.struct("start", "end", "digest", *extra)
    rows = nodes.groupBy("group", "leaves", F.shiftright("start", (band + 1) * levels).alias("bucket")).agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    return keep(rows, f"merkle-{band}")


class Tree(NamedTuple):
    """``buckets`` of the leaves, and for each bucket the ``above``: (group, bucket, path, root)."""

    buckets: DataFrame
    above: DataFrame | None
    roots: DataFrame


def tree(leaves: DataFrame, levels: int, extra: tuple[str, ...] = ()) -> Tree:
    """The trees of all groups of ``leaves`` (group, leaves, start, end, digest)."""
    group = leaves.schema["group"].dataType.simpleString()
    bands, nodes, roots = [], leaves, []
    while True:
        band = len(bands)
        bands.append(bucketed(nodes, band, levels, extra if band == 0 else ()))
        plain = bands[-1].withColumn("members", F.transform("members", lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["digest"].alias("digest"))))
        tops = keep(mapped(plain, _tops(band, levels), f"group {group}, leaves long, start long, end long, digest binary"), f"tops-{band}")
        whole = (F.col("start") == 0) & (F.col("end") == F.col("leaves"))
        roots.append(tops.where(whole).select("group", "leaves", "digest"))
        nodes = tops.where(~whole)
        if nodes.isEmpty():
            break
    above = None
    for band in reversed(range(1, len(bands))):
        # Containment: a bucket lies in the member of the next band that starts where it does.
        under = _attached(bands[band], above)
        paths = mapped(under, _paths(band, levels), f"group {group}, start long, path binary, root binary")
        above = keep(paths.select("group", F.shiftright("start", band * levels).alias("bucket"), "path", "root"), f"paths-{band}")
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Tree(bands[0], above, found)


def _attached(buckets: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return buckets.withColumns({"path": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
    return look_up(buckets, above, ["group", "bucket"])


def ranked(frame: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """(group, leaves, start, end) for a frame with a digest, in the order of ``order`` within each group."""
    placed = numbered(frame, [group], order, "start")
    sizes = keep(frame.groupBy(group).agg(F.count(F.lit(1)).alias("leaves")), "merkle-sizes")
    return look_up(placed, sizes, [group], "inner").withColumn("end", F.col("start") + 1).withColumnRenamed(group, "group")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", doc_id: str = "doc_id",
             tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, path, claimed): one row a leaf, digests in bytes.

    ``path`` is the steps from the leaf to the root, each ``STEP`` bytes: the sibling's side and digest. ``claimed`` is the
    leaf of the row with the columns of ``tampered`` in the place of its own.
    """
    values = [F.col(f"`{c}`") for c in columns]
    other = [(tampered or {}).get(c, v) for c, v in zip(columns, values, strict=True)]
    changed = F.lit(False)
    for a, b in zip(values, other, strict=True):
        changed = changed | ~a.eqNullSafe(b)
    leaf = digest_of(*values)
    # Equal rows are told apart by their place in the input, so that many of them spread over partitions.
    rows = keep(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{group}`").alias("lang"), leaf.alias("digest"),
                            F.when(changed, digest_of(*other)).alias("claimed"), F.monotonically_increasing_id().alias("_place")), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("_place").asc()]
    base = tree(ranked(rows, "lang", order), levels, ("doc_id", "claimed"))
    # The roots of the groups are the leaves of the tree above, in one group.
    tops = keep(base.roots.withColumn("one", F.lit(1)).withColumnRenamed("group", "lang").drop("leaves"), "subroots")
    upper = tree(ranked(tops, "one", [F.col("lang").asc_nulls_first()]), levels, ("lang",))
    over = keep(mapped(_attached(upper.buckets, upper.above), _groups(levels), f"lang {tops.schema['lang'].dataType.simpleString()}, "
                       "over binary, subroot binary, top binary"), "over")
    known = _attached(base.buckets, base.above).drop("root")
    known = look_up(known.withColumnRenamed("group", "lang"), over, ["lang"], "inner")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return mapped(known, _leaves(levels), f"doc_id {id_type}, leaf binary, subroot binary, root binary, proof binary, path binary, claimed binary")


def _groups(levels: int) -> Callable:
    """Buckets of subroots to the path of each group above its subroot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                top, paths = climb(_members(row), _levels(row, 0, levels))
                out += [{"lang": m["lang"], "over": p + (row["path"] or b""), "subroot": m["digest"], "top": row["root"] or top.digest}
                        for m, p in zip(row["members"], paths, strict=True)]
            lang = batch.schema.field("members").type.value_type.field("lang").type
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", lang), ("over", pa.binary()), ("subroot", pa.binary()), ("top", pa.binary())]))
    return run


def _leaves(levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("members").type.value_type.field("doc_id").type
            schema = pa.schema([("doc_id", id_type)] + [(n, pa.binary()) for n in ("leaf", "subroot", "root", "proof", "path", "claimed")])
            for at in range(0, max(1, batch.num_rows), 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    _, paths = climb(_members(row), _levels(row, 0, levels))
                    for m, p in zip(row["members"], paths, strict=True):
                        path = p + (row["path"] or b"") + row["over"]
                        out.append({"doc_id": m["doc_id"], "leaf": m["digest"], "subroot": row["subroot"], "root": row["top"],
                                    "proof": proof(path), "path": path, "claimed": m["claimed"] or m["digest"]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def verified(found: DataFrame) -> DataFrame:
    """``found`` with ``folded``: the root that the claimed leaf and the original siblings give."""
    fields = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claimed, paths = batch.column("claimed").to_pylist(), batch.column("path").to_pylist()
            roots = pa.array([folded(c, p) for c, p in zip(claimed, paths, strict=True)], pa.binary())
            keep_ = [i for i, f in enumerate(batch.schema) if f.name not in ("claimed", "path")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep_), roots], [*(batch.schema.names[i] for i in keep_), "folded"])

    names = [f for f in fields if f.name not in ("claimed", "path")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", folded binary"
    return mapped(found, run, schema)


def digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots and proof of every document; where 7 divides the CRC-32 of its id, the check is made with ``n_chars``
    one higher and has to fail, but for rows without ``n_chars``."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n = F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = verified(manifest(docs.select(*COLUMNS), tampered={"n_chars": n}, levels=levels))
    hex_ = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", hex_("leaf").alias("leaf"), hex_("subroot").alias("subroot"), hex_("root").alias("root"),
                      hex_("proof").alias("proof_sha256"), hex_("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))
