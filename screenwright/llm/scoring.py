"""Masked pseudo-likelihood scoring with a small bidirectional network.

Words become symbols: the ``COMMON`` most frequent words of the corpus have their own, the others share ``SHARED`` hash
classes. The vocabulary is that of the corpus: all its words and their counts are a table on Spark, and a word of a class
has the class's chance times its own share of the class's count, so every word has its own probability. For every word, a network that sees the ``REACH`` words on both sides (position-specific embeddings, one tanh
layer) gives the chances of each symbol; the word itself is masked. A document's score is the sum of the log
probabilities of its own words; the mean is what to rank by. It scores documents with one word as well (all sides
empty). The chance of a symbol is that of its group (``GROUP`` symbols of neighbouring frequency) times that of the
symbol in the group, so a position costs ``GROUPS`` + ``GROUP`` outputs and not ``SYMBOLS``.

The network is trained in numpy, on Spark: every task runs gradient steps on its own documents from the shared start,
and parameters are averaged by the number of positions, summed by Spark row-wise; ``ROUNDS`` such rounds. Every round
steps on every position of every document, once; steps grow from ``BATCH`` to ``MOST`` positions as a task goes on. Texts
become symbols once, in a written table that rounds and scoring read. The words of classes meet their counts in a join on
the word, summed by document and word before; a word that is not common has at most 1 / (``COMMON`` + 1) of all words, so
no key is hot. The driver holds only the parameters, the list of common words and the counts of the classes, all of fixed
size; the table of words grows with the corpus. Steps are deterministic in a task; the sum over tasks depends on how rows are split, so
scores agree between runs to a few digits, which the output rounds to.

Null and empty texts have no words and score 0. An empty table trains nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts, mapped

COMMON, SHARED = 384, 127
SYMBOLS = COMMON + SHARED + 1  # 0: beyond the text
GROUP = 64
GROUPS = SYMBOLS // GROUP
REACH, SIZE, HIDDEN = 2, 16, 16
ROUNDS, BATCH, MOST, RATE = 1, 256, 2048, 0.5
RESULT = "n_words long, log_likelihood double"
#: Words counted by a task before it passes its counts on.
COUNTED = 500_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every word of the corpus, summed by task, then by word. Written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                               ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for t in batch.column(0).slice(at, 200).to_pylist():
                    counts.update(words_of(t))
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    found = mapped(docs.select(F.col(f"`{text}`")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return keep(found, "words")


def common_words(counts: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The most frequent words and their symbols, ties by the word, and the counts of all symbols."""
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    common = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}
    n = np.zeros(SYMBOLS)
    for r in counts.groupBy((F.crc32("word") % SHARED).alias("k")).agg(F.sum("n").alias("n")).collect():  # SHARED rows
        n[COMMON + 1 + r["k"]] = r["n"]
    for r in top:
        n[common[bytes(r["word"])]] = r["n"]
        n[COMMON + 1 + crc32(r["word"]) % SHARED] -= r["n"]
    return common, n


def start(often: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the log frequencies of the symbols and of their groups."""
    rng = np.random.default_rng(7)
    return {"embed": rng.normal(0, 0.1, (SYMBOLS, SIZE)).astype(np.float32),
            "mix": rng.normal(0, 0.2, (2 * REACH * SIZE, HIDDEN)).astype(np.float32),
            "lean": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.1, (HIDDEN, SYMBOLS)).astype(np.float32),
            "bias": often.astype(np.float32),
            "choose": rng.normal(0, 0.1, (HIDDEN, GROUPS)).astype(np.float32),
            "lead": np.log(np.exp(often).reshape(GROUPS, GROUP).sum(axis=1)).astype(np.float32)}


def symbols(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    get = common.get
    return np.array([get(w) or COMMON + 1 + crc32(w) % SHARED for w in words], np.int64)


def sides(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols of the words around each position; 0 beyond the ends."""
    padded = np.concatenate([np.zeros(REACH, np.int64), ids, np.zeros(REACH, np.int64)])
    return padded[at[:, None] + np.array([k for k in range(2 * REACH + 1) if k != REACH])[None, :]]


def forward(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = p["embed"].take(around, axis=0).reshape(len(around), -1)
    return x, np.tanh(x @ p["mix"] + p["lean"])


def by_group(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of positions by the group of their symbol, and where each group begins in it."""
    group = (own // GROUP).astype(np.uint8)
    return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


def level(p: dict[str, np.ndarray], out: str, bias: str) -> bool:
    """Whether outputs can get so large that exp needs their maximum taken off; hidden units are within 1."""
    return float((np.abs(p[bias]) + np.abs(p[out]).sum(axis=0)).max()) > 60


def powers(z: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp by row, in place, the sums of the rows, and what was taken off before."""
    top = 0.0
    if large:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype), top


def step(p: dict[str, np.ndarray], around: np.ndarray, own: np.ndarray, rate: float) -> None:
    """One gradient step on the mean cross-entropy, in place."""
    order, first = by_group(own)
    around, own = around.take(order, axis=0), own[order]
    x, h = forward(p, around)
    n = len(own)

    def slope(z: np.ndarray, large: bool, place: np.ndarray) -> np.ndarray:
        z, sums, _ = powers(z, large)
        z *= (1 / (sums * n))[:, None]
        z[np.arange(len(place)), place] -= 1 / n
        return z

    z = slope(h @ p["choose"] + p["lead"], level(p, "choose", "lead"), own // GROUP)
    dh = z @ p["choose"].T
    p["choose"] -= rate * (h.T @ z)
    p["lead"] -= rate * z.sum(axis=0)
    large = level(p, "out", "bias")
    for g in range(GROUPS):
        a, b, part = first[g], first[g + 1], slice(g * GROUP, (g + 1) * GROUP)
        if a < b:
            z = h[a:b] @ p["out"][:, part]
            z += p["bias"][part]
            z = slope(z, large, own[a:b] - g * GROUP)
            dh[a:b] += z @ p["out"][:, part].T
            p["out"][:, part] -= rate * (h[a:b].T @ z)
            p["bias"][part] -= rate * (np.ones(b - a, z.dtype) @ z)
    dh *= 1 - h * h
    dx = (dh @ p["mix"].T).reshape(-1, SIZE)
    p["mix"] -= rate * (x.T @ dh)
    p["lean"] -= rate * dh.sum(axis=0)
    flat = around.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat = flat[order].astype(np.int64)
    start = np.flatnonzero(np.diff(flat, prepend=-1))
    p["embed"][flat[start]] -= rate * np.add.reduceat(dx.take(order, axis=0), start, axis=0)


def in_rows(texts: Iterator[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Symbols of texts one after the other with empty places after each, so that short ones share a matrix, in rows of
    about ``size`` or one longer text, and the lengths of the texts."""
    gap = np.zeros(REACH, np.int64)
    row, n, total = [], [], 0
    for ids in texts:
        if n and total + len(ids) > size:
            yield np.concatenate(row), n
            row, n, total = [], [], 0
        row += [ids.astype(np.int64), gap]
        n.append(len(ids))
        total += len(ids) + REACH
    if n:
        yield np.concatenate(row), n


def learn(p: dict[str, np.ndarray], texts: Iterator[np.ndarray], rate: float = RATE) -> int:
    """Steps on every position of ``texts``, in place; how many these were."""
    seen = 0
    for row, _ in in_rows(texts, 16 * MOST):
        places, at = np.flatnonzero(row), 0
        around = sides(row, places)
        while at < len(places):
            to = at + min(MOST, BATCH + seen // 64)
            own = row[places[at:to]]
            step(p, around[at:to], own, rate * min(1, len(own) / BATCH))
            seen += len(own)
            at = to
    return seen


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_py() or b"", np.uint16)


def train_round(coded: DataFrame, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every task steps from ``p`` through its documents; the means of the tasks' parameters come back."""
    sc = coded.sparkSession.sparkContext
    shared = sc.broadcast(p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in shared.value.items()}
        seen = learn(own, (x for batch in batches for x in texts_of(batch.column(0))))
        if seen:
            flat = np.concatenate([own[k].ravel() for k in sorted(own)]).astype(np.float64)
            for at in range(0, len(flat), 4096):
                part = flat[at:at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part * seen),
                                                  pa.array(np.full(len(part), float(seen)))], ["i", "v", "n"])

    summed = mapped(coded.select("_code.ids"), run, "i long, v double, n double").groupBy("i").agg(
        (F.sum("v") / F.sum("n")).alias("v"))
    rows = summed.collect()  # as many rows as the network has parameters
    shared.unpersist()
    if not rows:
        return p
    flat = np.zeros(sum(v.size for v in p.values()))
    flat[[r["i"] for r in rows]] = [r["v"] for r in rows]
    out, at = {}, 0
    for k in sorted(p):
        out[k] = flat[at:at + p[k].size].reshape(p[k].shape).astype(np.float32)
        at += p[k].size
    return out


def likelihood(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Log probability of each symbol given its sides."""
    out = np.empty(len(ids))
    around = sides(ids, np.arange(len(ids)))
    of_group, in_group = level(p, "choose", "lead"), level(p, "out", "bias")

    def logs(z: np.ndarray, large: bool, place: np.ndarray) -> np.ndarray:
        own = z[np.arange(len(place)), place]
        _, sums, top = powers(z, large)
        return own - np.log(sums) - top

    for at in range(0, len(ids), 8192):
        order, first = by_group(ids[at:at + 8192])
        order += at
        own = ids[order]
        _, h = forward(p, around.take(order, axis=0))
        value = logs(h @ p["choose"] + p["lead"], of_group, own // GROUP)
        for g in range(GROUPS):
            a, b, part = first[g], first[g + 1], slice(g * GROUP, (g + 1) * GROUP)
            if a < b:
                z = h[a:b] @ p["out"][:, part]
                z += p["bias"][part]
                value[a:b] += logs(z, in_group, own[a:b] - g * GROUP)
        out[order] = value
    return out


def encoded(docs: DataFrame, text: str, carry: list[str], common: dict[bytes, int]) -> DataFrame:
    """The columns of ``carry`` and a struct ``_code``: id, a number of the row; ids, the symbols of the text's words in
    two bytes each; words and times, its words without a symbol of their own. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # of fixed size

    def make():
        given, at = shared.value, TaskContext.get().partitionId() << 40

        def work(texts: list) -> list:
            nonlocal at
            ids, rare, times = [], [], []
            for t in texts:
                w = words_of(t)
                found = symbols(w, given)
                ids.append(found.astype(np.uint16).tobytes())
                own = Counter([w[k] for k in np.flatnonzero(found > COMMON).tolist()])
                rare.append(list(own))
                times.append(list(own.values()))
            at += len(texts)
            return [list(range(at - len(texts), at)), ids, rare, times]

        return work

    code = "id long, ids binary, words array<binary>, times array<int>"
    return keep(map_texts(docs, text, carry, code, make, "_code"), "symbols")


def of_words(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, own): what a row's words of classes add by their own counts, before the counts of the classes are taken off."""
    pairs = coded.select("_code.id", F.explode(F.arrays_zip("_code.words", "_code.times")).alias("x"))
    met = pairs.select("id", F.col("x.words").alias("word"), F.col("x.times").alias("times")).join(
        counts.select("word", F.log("n").alias("ln")), "word")
    return met.groupBy("id").agg(F.sum(F.col("times") * F.col("ln")).alias("own"))


def fit(coded: DataFrame, n: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    p = start(np.log((n + 1) / (n + 1).sum()))
    for _ in range(rounds):
        p = train_round(coded, p)
    return p


def score(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) and a struct ``_found``: n_words, log_likelihood."""
    carry = docs.columns if carry is None else carry
    counts = word_counts(docs, text)
    common, n = common_words(counts)
    coded = encoded(docs, text, carry, common)
    of_class = np.zeros(SYMBOLS)
    of_class[COMMON + 1:] = np.log(np.maximum(n[COMMON + 1:], 1))
    shared = docs.sparkSession.sparkContext.broadcast((fit(coded, n), of_class))  # of fixed size

    def make():
        p, classes = shared.value

        def work(texts: list) -> list:
            sums = []
            for row, n in in_rows((np.frombuffer(x, np.uint16) for x in texts), 8192):
                values, place = likelihood(p, row) - classes[row], 0
                for k in n:
                    sums.append(float(values[place:place + k].sum()))
                    place += k + REACH
            return [[len(x) // 2 for x in texts], sums]

        return work

    flat = coded.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col("_code.id").alias("_id"),
                        F.col("_code.ids").alias("_ids"))
    found = map_texts(flat, "_ids", ["_row", "_id"], RESULT, make)
    own = of_words(coded, counts)
    whole = F.col("_found.log_likelihood") + F.coalesce("own", F.lit(0.0))
    return found.join(own, F.col("_id") == own["id"], "left").select(
        *(F.col("_row").getField(c).alias(c) for c in carry),
        F.struct(F.col("_found.n_words").alias("n_words"), whole.alias("log_likelihood")).alias("_found"))


def digest(docs: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), carry=["doc_id"])
    mean = F.when(F.col("_found.n_words") > 0, F.col("_found.log_likelihood") / F.col("_found.n_words"))
    return found.select("doc_id", "_found.n_words", F.round("_found.log_likelihood", 2).alias("log_likelihood"),
                        F.round(mean, 3).alias("mean_log_likelihood"))
