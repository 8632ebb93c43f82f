"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window). A document contains a window only if
it contains every shingle of it, so its rarest shingle alone is a necessary prefix: shingles are ordered by how often
they occur in all documents, each window is indexed under its rarest one, and document positions are joined with that
index. Length and position bound what is left (the window has to lie inside the document), and every candidate is
verified word by word. Nothing of the documents is shuffled; items come in blocks of bounded size.

Words are compared as bytes, so results are exact. Null and wordless texts give zero counts. Items without words have
no windows; items with the same id count once; an item without an id counts under an empty id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts, mapped

WINDOW = 13
#: Words of a shingle; windows with fewer words are one shingle.
SHINGLE = 3
#: An item block holds about so many characters; each block is one broadcast and one pass over the documents.
BLOCK_CHARS = 8_000_000
#: Candidates verified at a time.
STEP = 400_000
RESULT = "n_words long, n_hit long, hits binary, items array<string>"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and anything beyond ASCII, A-Z lower-cased. UTF-8 bytes from 128 on are word bytes."""
    return text.encode().translate(_FOLD).split() if text else []


class ItemIndex:
    """The windows of one block of items, and after ``order`` their rarest shingles."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.ids: list[str] = []
        numbers: dict[str, int] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not words:
                continue
            n = numbers.setdefault(item, len(numbers))
            for at in range(max(1, len(words) - window + 1)):
                found[tuple(words[at:at + window])].add(n)
        self.ids = list(numbers)
        self.base = len(self.vocabulary) + 1
        windows = list(found)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if windows else self.length
        self.flat = np.array([x for w in windows for x in w], np.int64)
        self.owners = np.array([n for w in windows for n in sorted(found[w])], np.int64)
        self.owner_start = np.cumsum([0] + [len(found[w]) for w in windows]).astype(np.int64)
        # Every shingle of every window: its size, code, window and offset.
        size, code, of, offset = [], [], [], []
        for k, w in enumerate(windows):
            s = min(SHINGLE, len(w))
            for at in range(len(w) - s + 1):
                size.append(s)
                code.append(self.code(w[at:at + s]))
                of.append(k)
                offset.append(at)
        self.size, self.code_, self.of, self.offset = (np.array(x, np.int64) for x in (size, code, of, offset))
        self.shingles = {int(s): np.unique(self.code_[self.size == s]) for s in np.unique(self.size)}

    def code(self, words: tuple[int, ...]) -> int:
        value = 0
        for w in words:
            value = value * self.base + w
        return value

    def positions(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of that size starts in ``ids`` (0: no word of any item), and its number."""
        if len(ids) < size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(ids) - size + 1
        known = ids[:n] > 0
        for k in range(1, size):
            known &= ids[k:n + k] > 0
        at = np.flatnonzero(known)
        code = ids[at]
        for k in range(1, size):
            code = code * self.base + ids[at + k]
        table = self.shingles[size]
        where = np.minimum(np.searchsorted(table, code), len(table) - 1)
        same = table[where] == code
        return at[same], where[same]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Index each window under its rarest shingle; ``counts`` by (size, number)."""
        often = np.zeros(len(self.code_), np.int64)
        for s, table in self.shingles.items():
            of_size = self.size == s
            times = np.array([counts.get((s, k), 0) for k in range(len(table))], np.int64)
            often[of_size] = times[np.searchsorted(table, self.code_[of_size])]
        by = np.lexsort((self.offset, self.code_, often, self.of))
        first = by[np.concatenate([[True], np.diff(self.of[by]) > 0])] if len(by) else by
        self.prefix = {}
        for s, table in self.shingles.items():
            own = first[self.size[first] == s]
            number = np.searchsorted(table, self.code_[own])
            own = own[np.argsort(number, kind="stable")]
            starts = np.searchsorted(np.sort(number), np.arange(len(table) + 1))
            self.prefix[s] = (starts, self.of[own], self.offset[own])
        del self.size, self.code_, self.of, self.offset

    def matches(self, ids: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all occurrences. ``doc``: each word's document; ``bounds``: where documents start."""
        starts, windows = [], []
        for size, (first, of, offset) in self.prefix.items():
            at, number = self.positions(ids, size)
            many = first[number + 1] - first[number]
            at, number, many = at[many > 0], number[many > 0], many[many > 0]
            total = np.cumsum(many)
            lo = 0
            while lo < len(at):
                base = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, base + STEP, "right")))
                n = many[lo:hi]
                entry = np.repeat(first[number[lo:hi]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                p, k = np.repeat(at[lo:hi], n), of[entry]
                s = p - offset[entry]
                d = doc[p]
                inside = (s >= bounds[d]) & (s + self.length[k] <= bounds[d + 1])
                s, k = s[inside], k[inside]
                for length in np.unique(self.length[k]):
                    own = self.length[k] == length
                    steps = np.arange(length)
                    ss, kk = s[own], k[own]
                    for step in steps:  # narrowing word by word: most candidates end early
                        same = ids[ss + step] == self.flat[self.start[kk] + step]
                        ss, kk = ss[same], kk[same]
                    starts.append(ss)
                    windows.append(kk)
                lo = hi
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def _joined(texts: list, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of some texts in a row, the text of each word, and where texts start."""
    get = vocabulary.get
    parts = [[get(w, 0) for w in words_of(t)] for t in texts]
    n = np.array([len(x) for x in parts], np.int64)
    ids = np.fromiter((x for p in parts for x in p), np.int64, int(n.sum()))
    return ids, np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])


def _count_shingles(docs: DataFrame, text: str, index: ItemIndex) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents: sums by task, then by shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        times = {s: np.zeros(len(table), np.int64) for s, table in own.shingles.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, _, bounds = _joined(batch.column(0).slice(at, 500).to_pylist(), own.vocabulary)
                # A zero between texts keeps shingles inside one text.
                ids = np.insert(ids, bounds[1:-1], 0)
                for s, count in times.items():
                    count += np.bincount(own.positions(ids, s)[1], minlength=len(count))
        for s, count in times.items():
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), s)), pa.array(seen), pa.array(count[seen])], ["size", "number", "times"])

    found = mapped(docs.select(F.col(f"`{text}`")), run, "size long, number long, times long")
    rows = found.groupBy("size", "number").agg(F.sum("times").alias("times")).collect()  # at most the block's shingles
    shared.unpersist()
    return {(r["size"], r["number"]): r["times"] for r in rows}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", carry: list[str] | None = None, window: int = WINDOW,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of ``carry`` (default: all) and a struct ``_found``: n_words, n_hit, hits (bit set), items."""
    carry = docs.columns if carry is None else carry
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"),
                             F.col(f"`{item_text}`").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    current, extra, found = docs, None, None
    for b in range(blocks):
        index = ItemIndex([tuple(r) for r in items.where(block == b).collect()], window)  # one block, bounded
        index.order(_count_shingles(docs, text, index) if len(index.length) else {})
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = _mark(current, text, carry, shared, extra, blocks > 1)
        if b + 1 < blocks:
            current = keep(found, "decontaminate")
            extra = "_found"
    return found.drop("_text_")


def _mark(docs: DataFrame, text: str, carry: list[str], shared, before: str | None, more: bool) -> DataFrame:
    def make():
        index = shared.value

        def work(texts: list) -> list:
            ids, doc, bounds = _joined(texts, index.vocabulary)
            start, window = index.matches(ids, doc, bounds)
            edge = np.zeros(len(ids) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + index.length[window] if len(start) else start, -1)
            hit = np.cumsum(edge)[:-1] > 0
            pairs = np.unique(np.stack([doc[start], window], 1), axis=0) if len(start) else np.empty((0, 2), np.int64)
            many = index.owner_start[pairs[:, 1] + 1] - index.owner_start[pairs[:, 1]]
            of = defaultdict(set)
            owners = index.owners[np.repeat(index.owner_start[pairs[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many)
                                  + np.arange(many.sum())] if len(pairs) else []
            for d, n in zip(np.repeat(pairs[:, 0], many).tolist(), [int(x) for x in owners]):
                of[d].add(index.ids[n])
            n_words, n_hit, bits, items = [], [], [], []
            for d in range(len(texts)):
                own = hit[bounds[d]:bounds[d + 1]]
                n_words.append(len(own))
                n_hit.append(int(own.sum()))
                bits.append(np.packbits(own).tobytes() if n_hit[-1] else b"")
                items.append(sorted(of[d]) if d in of else [])
            return [n_words, n_hit, bits, items]

        return work

    if not more:
        return map_texts(docs, text, carry, RESULT, make)
    if before is None:
        wide = docs.withColumn("_text_", F.col(f"`{text}`"))
        return map_texts(wide, "_text_", [*carry, "_text_"], RESULT, make)
    # Later blocks: union with what earlier blocks found.
    out = map_texts(docs.withColumnRenamed(before, "_before"), "_text_", [*carry, "_text_", "_before"], RESULT, make)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = (a["n_words"] + 7) // 8
                bits = [np.frombuffer(x["hits"].ljust(size, b"\0"), np.uint8) for x in (a, b)]
                both = bits[0] | bits[1]
                n = int(np.unpackbits(both).sum())
                rows.append({"n_words": a["n_words"], "n_hit": n, "hits": both.tobytes() if n else b"",
                             "items": sorted({*a["items"], *b["items"]})})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, batch.schema.field(2).type)],
                                             ["_row", "_found"])

    names = [*carry, "_text_"]
    packed = out.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "_before", "_found")
    schema = packed.select("_row", "_found").schema
    return mapped(packed, union, schema).select(*(F.col("_row").getField(c).alias(c) for c in names), "_found")


def contaminated() -> Column:
    """The contract's rule on ``_found``: at least one word in twenty is hit."""
    return (F.col("_found.n_hit") > 0) & (F.col("_found.n_hit") * 20 >= F.col("_found.n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document with counts, the digest of the items and the verdict."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark, carry=["doc_id"])
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))
