"""Removal of repeated passages: exact windows of words, counted in buckets of super-k-mers.

Windows of ``WINDOW`` words that follow each other and share a minimiser (the smallest hash of the ``PART``-word parts
inside) travel together as one packed string, a super-k-mer, to the bucket of that minimiser. Equal windows have equal
minimisers, so they meet. Where a task sees a super-k-mer more than once, only its earliest place travels: every later
one repeats all of its windows. A bucket keeps the earliest place of each string, sorts the windows and compares their
words, and returns, for each string's earliest place, which of its windows start nowhere earlier. So hot passages are
reduced before the shuffle, and a document learns only which of its windows are first; all others are covered. Then
documents meet these answers by id, and the words of later windows go.

Packed strings are compressed by batch and bucket. The number of buckets follows the characters of the input, so that
buckets keep their size. Null and short texts (under ``WINDOW`` words) lose nothing. Ids are compared as integers, null
first. Rows with the same id and text are one document; neither is earlier, so neither loses words to the other. Of
different texts with the same id, the one with the smaller digest counts as earlier where places are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped
from .hashing import Stretches, word_bounds

WINDOW = 20
#: Words of the parts whose smallest hash is the minimiser.
PART = 3
#: Windows of a super-k-mer at most, so that the answer for one is a number of 32 bits.
LONGEST = 31
#: Characters of text that a task packs at a time, and of input for each bucket.
BATCH_CHARS, BUCKET_CHARS = 12_000_000, 6_000_000
NO_ID = -(2**63)


def normal(text: str | None) -> bytes:
    return b" ".join(text.encode().split()) if text else b""


def tag_of(data: bytes) -> int:
    """Tells texts with the same id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def minimisers(data: bytes, start: np.ndarray, end: np.ndarray, window: int, part: int) -> np.ndarray:
    """The minimiser of each window of the words of one text."""
    h = Stretches(data).of(start[:len(start) - part + 1], end[part - 1:])
    width = window - part + 1
    step, done = 1, 1
    while done < width:  # the smallest of a growing stretch, by doubling
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def hashes(data: bytes, a: np.ndarray, b: np.ndarray, block: int = 500_000) -> np.ndarray:
    """Hashes of stretches in ascending order of their starts, from blocks of the data, to keep memory low."""
    h = np.empty(len(a), np.uint64)
    lo = 0
    while lo < len(a):
        hi = int(np.searchsorted(a, a[lo] + block, "right"))
        base, stop = int(a[lo]), int(b[lo:hi].max())
        h[lo:hi] = Stretches(data[base:stop]).of(a[lo:hi] - base, b[lo:hi] - base)
        lo = hi
    return h


def super_kmers(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of runs of equal minimisers, cut at ``LONGEST``."""
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], change])
    n = np.diff(np.concatenate([first, [len(low)]]))
    if n.max() > LONGEST:
        pieces = -(-n // LONGEST)
        first = np.repeat(first, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        n = np.minimum(LONGEST, np.diff(np.concatenate([first, [len(low)]])))
        ends = np.repeat(np.concatenate([np.concatenate([[0], change])[1:], [len(low)]]), pieces)
        n = np.minimum(n, ends - first)
    return first, n


def _pack(buckets: int, window: int, part: int):
    """Task: super-k-mers of its documents, by bucket: (bucket, places, strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tight = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=6)
        found: dict[bytes, tuple[int, int, int]] = {}
        bucket_of: dict[bytes, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            strings = list(found)
            where = np.array([bucket_of[s] for s in strings], np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            numbers, places, packed = [], [], []
            for own in np.split(order, cuts):
                if not len(own):
                    continue
                names = [strings[i] for i in own.tolist()]
                numbers.append(int(where[own[0]]))
                places.append(packer.compress(np.array([found[s] for s in names], np.int64).T.tobytes()))
                packed.append(tight.compress(b"\n".join(names)))
            found.clear()
            bucket_of.clear()
            for at in range(0, len(numbers), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[at:at + 64], pa.int64()), pa.array(places[at:at + 64], pa.binary()),
                     pa.array(packed[at:at + 64], pa.binary())], ["bucket", "places", "strings"])

        chars = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids = batch.column(0).slice(at, 200).to_pylist()
                for doc, text in zip(ids, batch.column(1).slice(at, 200).to_pylist(), strict=True):
                    data = normal(text)
                    start, end = word_bounds(data)
                    if len(start) < window:
                        continue
                    doc, tag = NO_ID if doc is None else doc, tag_of(text.encode())
                    low = minimisers(data, start, end, window, part)
                    first, n = super_kmers(low)
                    where = (low[first] % np.uint64(buckets)).tolist()
                    cut = zip(start[first].tolist(), end[first + n + window - 2].tolist(), first.tolist(), where, strict=True)
                    for a, b, k, bucket in cut:
                        s = data[a:b]
                        place = (doc, k, tag)
                        known = found.get(s)
                        if known is None:
                            found[s] = place
                            bucket_of[s] = bucket
                        elif place < known:
                            found[s] = place
                    chars += len(data)
                    if chars >= BATCH_CHARS:
                        yield from flush()
                        chars = 0
        yield from flush()

    return run


def _judge(window: int):
    """Task: the batches of its buckets, sorted by bucket: for each string's earliest place its first windows."""

    def answer(found: dict[bytes, tuple[int, int, int]]) -> pa.RecordBatch:
        strings = list(found)
        data = b"\n".join(strings)
        start, end = word_bounds(data)
        sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
        n = sizes - window + 1
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of = np.repeat(np.arange(len(strings)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = base[of] + step
        a, b = start[first], end[first + window - 1]
        h = hashes(data, a, b)
        places = np.array(list(found.values()), np.int64)
        doc, at, tag = places[of, 0], places[of, 1] + step, places[of, 2]
        order = np.lexsort((tag, at, doc, h))
        same = h[order][1:] == h[order][:-1]
        # Equal hashes: compare the words themselves.
        left, right = order[:-1][same], order[1:][same]
        pairs = zip(a[left].tolist(), b[left].tolist(), a[right].tolist(), b[right].tolist(), strict=True)
        if not all(data[i:j] == data[k:l] for i, j, k, l in pairs):  # two windows with one hash: sort by their words
            words = [data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            order = np.array(sorted(range(len(words)), key=lambda i: (words[i], doc[i], at[i], tag[i])), np.int64)
            same = np.array([words[i] == words[j] for i, j in zip(order[:-1], order[1:], strict=True)], bool)
        is_first = np.zeros(len(order), bool)
        is_first[order] = np.concatenate([[True], ~same])
        bits = np.bincount(of, weights=is_first * np.exp2(step), minlength=len(strings)).astype(np.int64)
        own = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(places[own, 0]), pa.array(places[own, 2]), pa.array(places[own, 1] << LONGEST | bits[own])],
            ["doc", "tag", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        found: dict[bytes, tuple[int, int, int]] = {}
        bucket = None
        for batch in batches:
            for number, places, strings in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket is not None and number != bucket and found:
                    yield answer(found)
                    found = {}
                bucket = number
                rows = np.frombuffer(unpacker.decompress(places), np.int64).reshape(3, -1).T.tolist()
                for s, place in zip(unpacker.decompress(strings).split(b"\n"), rows, strict=True):
                    place = tuple(place)
                    known = found.get(s)
                    if known is None or place < known:
                        found[s] = place
        if found:
            yield answer(found)

    return run


def _without(text: str | None, firsts: list | None, window: int) -> tuple[int, int, bytes]:
    """Words, words removed and what is kept of one text."""
    words = text.encode().split() if text else []
    n = len(words)
    if n < window:
        return n, 0, b" ".join(words)
    repeated = np.ones(n - window + 1, bool)
    for place in firsts or ():
        at, bits = place >> LONGEST, place & ((1 << LONGEST) - 1)
        while bits:
            low = bits & -bits
            repeated[at + low.bit_length() - 1] = False
            bits ^= low
    if not repeated.any():
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, np.int32)
    edge[:n - window + 1] += repeated
    edge[window:] -= repeated
    gone = np.cumsum(edge)[:-1] > 0
    return n, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
                 window: int = WINDOW, part: int = PART, keep_text: bool = True) -> DataFrame:
    """The columns of ``carry`` (default: all) and a struct ``_found``: n_words, n_removed, kept_sha256 and, on demand,
    the text that is kept."""
    carry = docs.columns if carry is None else carry
    chars = docs.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, -(-chars // BUCKET_CHARS))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    packed = mapped(rows, _pack(buckets, window, part), "bucket long, places binary, strings binary")
    packed = packed.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket")
    first = mapped(packed, _judge(window), "doc long, tag long, first long")

    # A document's answers come from many buckets, so they move first and are gathered where the join needs them.
    grouped = first.repartition("doc", "tag").groupBy("doc", "tag").agg(F.collect_list("first").alias("firsts"))
    # The texts meet their answers packed as well: the join moves them once.
    squeezed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),
                           F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = [NO_ID if x is None else x for x in batch.column(1).slice(at, 500).to_pylist()]
                texts = batch.column(2).slice(at, 500).to_pylist()
                raw = [None if t is None else t.encode() for t in texts]
                tags = [0 if t is None else tag_of(t) for t in raw]
                small = [None if t is None else packer.compress(t) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 500), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()),
                     pa.array(small, pa.binary())], ["_row", "doc", "tag", "small"])

    schema = StructType([squeezed.schema["_row"], *StructType.fromDDL("doc long, tag long, small binary")])
    met = mapped(squeezed, squeeze, schema).join(grouped, ["doc", "tag"], "left").select("_row", "small", "firsts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for small, firsts in zip(batch.column(1).slice(at, 200).to_pylist(),
                                         batch.column(2).slice(at, 200).to_pylist(), strict=True):
                    t = None if small is None else unpacker.decompress(small).decode()
                    n, gone, kept = _without(t, firsts, window)
                    out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 200),
                     *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
                    ["_row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = StructType([squeezed.schema["_row"],
                         *StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string")])
    out = mapped(met, finish, schema)
    fields = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    return out.select(*(F.col("_row").getField(c).alias(c) for c in carry), F.struct(*fields).alias("_found"))


def digest(docs: DataFrame) -> DataFrame:
    found = drop_repeats(docs.select("doc_id", "text"), carry=["doc_id"], keep_text=False)
    return found.select("doc_id", "_found.n_words", "_found.n_removed", "_found.kept_sha256")
