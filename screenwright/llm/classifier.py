"""Quality classifier: histogram gradient-boosted trees over statistics of a text, learned from labels.

Every text is measured whole, in Arrow batches (shares of kinds of characters, lengths of words and lines, how much of it
repeats); identifiers, languages and sources are no inputs. Labelled rows are those whose CRC-32 of the id leaves a
remainder other than ``HELD_OUT`` by four; the rest is held out. The trees are fitted on the driver to at most
``MOST_ROWS`` labelled rows, those with the smallest hash of their id, statistics only: a row is a hundred or so bytes, so
the bound is a few megabytes. Statistics are cut into ``BINS`` bins at their quantiles; each level of a tree takes, per node
and statistic, the sums of first and second derivatives by bin, and splits where the gain is largest.

The trees are complete and flattened: split statistic, threshold and leaf value of all trees lie in three arrays, and
texts walk down all of them in numpy, a level at a time.

Null and empty texts have all statistics zero and are scored like any other. A document with several labels counts with
each; labels that are null do not. Without labels every score is one half; with one class only, all are near it. Rows that
repeat are scored each. An empty table gives no rows. Input columns travel in a struct, so their names may be anything.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import keep, map_texts, mapped

MOST_ROWS = 50_000
FOLDS, HELD_OUT = 4, 2
LEAST_SCORE = 0.7
BINS, DEPTH, TREES, RATE = 64, 4, 120, 0.1
#: Added to second derivatives: leaves of few rows stay near zero; and the least sum of them on either side of a split.
CALM, LEAST_WEIGHT = 1.0, 1.0
STATISTICS = ("words", "characters", "word_length", "word_length_spread", "long_words", "letters", "capitals", "digits", "marks",
              "symbols", "spaces", "other", "distinct_words", "commonest_word", "repeated_pairs", "repeated_triples", "lines",
              "line_length", "repeated_lines", "short_lines", "word_end_marks", "entropy", "capital_words", "mixed_words")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>{}[]\\^~`@_=+"
_MARKS = b".,;:!?'\"-()/"


def _kinds() -> np.ndarray:
    """For every byte its kind: 0 letter, 1 capital, 2 digit, 3 mark, 4 symbol, 5 space, 6 other."""
    kind = np.full(256, 6, np.int8)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[128:] = 0  # part of a character beyond ASCII, mostly a letter
    for some, k in ((_MARKS, 3), (_SYMBOLS, 4), (b" \t\n\x0b\x0c\r", 5)):
        kind[np.frombuffer(some, np.uint8)] = k
    return kind


KINDS = _kinds()


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, in the order of ``STATISTICS``; all zero without a word."""
    words = _WORD.findall(text or "")
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(KINDS, weights=by_byte, minlength=7) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(codes) + ids[1:]
    triples = pairs[:-1].astype(np.float64) * len(codes) + ids[2:]
    lines = [x for x in text.split("\n") if x.strip()]
    shares = by_byte[by_byte > 0] / len(raw)
    ends = sum(w[-1] in ".,;:!?" for w in words)
    upper = sum(w.isupper() for w in words)
    mixed = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words)
    repeated = lambda x: 1 - len(np.unique(x)) / len(x) if len(x) else 0.0
    return [math.log1p(n), math.log1p(len(text)), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()),
            *(float(k) for k in kinds), len(codes) / n, float(np.bincount(ids).max()) / n, repeated(pairs), repeated(triples),
            math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
            sum(len(x) < 20 for x in lines) / len(lines), ends / n, float(-(shares * np.log2(shares)).sum()), upper / n, mixed / n]


class Trees(NamedTuple):
    """All trees in one: ``feature`` and ``threshold`` (trees x inner nodes), ``value`` (trees x leaves), and the bias."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Walk down: the children of node k are 2k + 1 and 2k + 2."""
        count, inner = self.feature.shape
        total = np.full(len(x), self.bias)
        if count:
            trees = np.arange(count)
            at = np.zeros((len(x), count), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total += self.value[trees, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the chance of label 1 by logistic loss."""
    n, f = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    bias = math.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0.0
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    if not n or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(f)]
    bins = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(f)], axis=1)
    score, out = np.full(n, bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-12)
            cut = np.full(width, BINS, np.int64)
            for k in range(f):
                at = node * BINS + bins[:, k]
                sums = [np.bincount(at, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h)]
                left_g, left_h = (s[:, :-1] for s in sums)
                all_g, all_h = (s[:, -1:] for s in sums)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + CALM) + right_g**2 / (right_h + CALM) - all_g**2 / (all_h + CALM)
                gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, 0)
                most = gain.argmax(1)
                better = gain[np.arange(width), most] > best
                best = np.where(better, gain[np.arange(width), most], best)
                cut = np.where(better, most, cut)
                feature[first:first + width][better] = k
            for j in np.flatnonzero(cut < BINS):
                k = feature[first + j]
                threshold[first + j] = edges[k][cut[j]] if cut[j] < len(edges[k]) else np.inf
            own = first + node
            node = 2 * node + (x[np.arange(n), feature[own]] > threshold[own])
        value = -RATE * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + CALM)
        score += value[node]
        out.append((feature, threshold, value))
    return Trees(*(np.stack(a) for a in zip(*out, strict=True)), bias)


def measured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``carry`` and ``_found.x``, the statistics of each text, written to the shared folder."""
    def make() -> Callable:
        return lambda texts: [[statistics(t) for t in texts]]

    return keep(map_texts(docs, text, carry, "x array<double>", make), "statistics")


def held_out(doc_id: str) -> Column:
    """Whether a row is held out; rows without an id cannot be labelled and are not."""
    crc = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == HELD_OUT, F.lit(False))


def fit(known: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = MOST_ROWS) -> Trees:
    """Trees from at most ``most`` labelled rows that are not held out, those whose id has the smallest hash."""
    named = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_y")).where("_y IS NOT NULL")
    rows = known.where(~held_out(doc_id)).select(F.col(f"`{doc_id}`").alias("_doc"), "_found.x").join(named, F.col("_doc") == F.col("_id"))
    some = rows.select("x", "_y", F.xxhash64("_id").alias("h"), "_id").orderBy("h", "_id", "_y", "x").limit(most).collect()
    return train(np.array([r["x"] for r in some]), np.array([r["_y"] for r in some]))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
          carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) and the struct ``_found`` with ``held_out`` and ``score``. An input column of
    that name gives way."""
    carry = docs.columns if carry is None else carry
    carried = [c for c in dict.fromkeys([*carry, doc_id]) if c != "_found"]
    known = measured(docs, text, carried)
    trees = fit(known, labels, doc_id, label)
    row = known.select(F.struct(*(F.col(f"`{c}`") for c in carry if c != "_found")).alias("_row"), held_out(doc_id).alias("_out"),
                       F.col("_found.x").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("_x").flatten(), np.float64).reshape(batch.num_rows, len(STATISTICS))
            parts = [trees.score(x[i:i + 2000]) for i in range(0, len(x), 2000)]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_out"), pa.array(scores)], ["_row", "_out", "_score"])

    schema = StructType([row.schema["_row"], StructField("_out", BooleanType()), StructField("_score", DoubleType())])
    out = mapped(row, run, schema)
    return out.select(*(F.col("_row").getField(c).alias(c) for c in carry if c != "_found"),
                      F.struct(F.col("_out").alias("held_out"), F.col("_score").alias("score")).alias("_found"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), labels, carry=["doc_id"])
    return found.select("doc_id", "_found.held_out", "_found.score", (F.col("_found.score") >= LEAST_SCORE).cast("int").alias("predicted"))
