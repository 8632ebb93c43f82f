"""Manifest, whitening and quality classifier against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from screenwright.llm import classifier, manifest, whitening
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Trees and proofs by lists, a level at a time."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(*(field(v) for v in (r[0], r[3], r[2], n, r[1])))

    def proofs(digests):
        paths, own, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for p, k in zip(paths, own, strict=True):
                p.append(("L", level[k - 1]) if k % 2 else ("R", level[k + 1]) if k + 1 < len(level) else ("N", ""))
            level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
            own = [k // 2 for k in own]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *proofs([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in order}
    root, over = proofs([trees[g][1] for g in order])
    out = []
    for g, above in zip(order, over, strict=True):
        leaves, subroot, paths = trees[g]
        for (_, _, own, r), path in zip(leaves, paths, strict=True):
            path = path + above
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            fold = leaf(r, r[4] + 1) if odd else own
            for side, other in path:
                fold = H(other, fold) if side == "L" else H(fold, other)
            out.append((r[0], own, subroot, root, H(*(o for _, o in path)), fold, fold == root))
    return out


@pytest.mark.parametrize("levels", [6, 2])
def test_manifest(spark, docs, rows, levels):
    rows = [(*r[:4], None if r[0] is None or r[0] % 5 == 0 else 7 * r[0], *r[5:]) for r in rows]
    frame = spark.createDataFrame(rows, docs.schema).repartition(4)
    got = manifest.digest(frame, levels).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, docs):
    for n in (0, 1, 3):
        rows = [(i, "t", "en", "s", 3) for i in range(1, n + 1)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert Counter(map(tuple, manifest.digest(frame).collect())) == Counter(plain_manifest(rows) if rows else [])


def test_manifest_of_equal_rows_in_one_group(spark):
    """Many copies of one row spread over partitions and all prove."""
    frame = spark.range(5000).selectExpr("CAST(1 AS BIGINT) AS doc_id", "'same' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars")
    assert zlib.crc32(b"1") % 7
    found = manifest.digest(frame).collect()
    want = plain_manifest([(1, "same", "en", "s", 4)] * 5000)
    assert Counter(map(tuple, found)) == Counter(want) and all(r["verified"] for r in found)


def test_manifest_equals_sql(spark):
    name = "op11_manifest"
    got = compare(spark, connect(SF), SF, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert got.startswith("ok 200")


def vectors(spark, given):
    return spark.createDataFrame([(i, v, "x", i) for i, v in given], "vec_id long, embedding array<float>, _row string, _found long").repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) + 3).astype(np.float32)
    given = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(1000, None), (1001, [None] * 20), (1002, [float("nan")] * 20),
             (1003, [float("inf")] + [0.0] * 19), (1004, [1.0, 2.0]), (1005, []), (3, [float(x) for x in base[3]])]
    got = whitening.digest(vectors(spark, given).select("vec_id", "embedding")).collect()
    fit = np.array([v for _, v in given if v and len(v) == 20 and all(x is not None and math.isfinite(x) for x in v)])
    ids = [i for i, v in given if v and len(v) == 20 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(1024 * fit).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    values, parts = values[::-1], parts.T[::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == set(ids)
    want = Counter(int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x)
    assert Counter(r["deviation"] for r in got if r["component"] == 1) == want
    sign = {}
    white = {(i, c): (y[k] @ parts[c]) / math.sqrt(values[c]) for k, i in enumerate(ids) for c in range(8)}
    for r in got:
        c, w = r["component"] - 1, white[r["vec_id"], r["component"] - 1]
        sign.setdefault(c, math.copysign(1, w) * math.copysign(1, r["whitened"]) if abs(w) > 0.1 else None)
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(w)) < 1e-8 and (sign[c] is None or abs(r["whitened"] - sign[c] * w) < 1e-8)


def test_whitening_of_odd_tables(spark):
    frame = vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0, 8.0])])
    found, model = whitening.whiten(frame)
    assert found.columns == ["vec_id", "embedding", "_row", "_found"] and len(model.eigenvalues) == 1
    assert whitening.digest(frame.select("vec_id", "embedding")).count() == 3
    for given in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        assert whitening.digest(vectors(spark, given).select("vec_id", "embedding")).count() == 0


def test_decomposition():
    rng = np.random.default_rng(1)
    for d, r in ((1, 1), (2, 2), (7, 7), (30, 30), (30, 9)):
        a = rng.normal(size=(d, r)) * 10.0 ** rng.integers(-3, 3, r)
        v = a @ a.T
        values, parts = whitening.eigen(v)
        assert np.allclose(parts.T * values @ parts, v, rtol=1e-9, atol=1e-9 * np.trace(v))
        assert np.allclose(parts @ parts.T, np.eye(len(values)), atol=1e-6) and (np.diff(values) <= 0).all()
    assert whitening.eigen(np.zeros((3, 3)))[1].shape == (0, 3)
    big = np.array([[2**45, 5], [1, 2]], np.int64)
    assert whitening.deviations(big, 2, big.sum(0)) == [None, None]
    assert whitening.deviations(big, 1, np.array([2**45, 2**31])) == [(2**31 - 5) ** 2, None]


def test_quality_scores_hold_out(spark):
    """Held-out labels are told at sf0.1; the result depends on texts alone."""
    sf = "/root/testdata/sf0.1"
    queries = __spark_entry__.queries()
    got = {r["doc_id"]: r for r in queries["op13_quality_scores"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d]["score"], q, got[d]["predicted"]) for d, q in labels.items() if got[d]["held_out"]]
    assert len(got) == 10_000 and len(held) > 900
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert sum(p == q for _, q, p in held) >= 0.99 * len(held)
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.995


def test_trees_walk_like_a_plain_descent():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, len(classifier.STATISTICS)))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 3] > 0) ^ (x[:, 5] > 0.3)).astype(float)
    trees = classifier.train(x, y)

    def plain(row):
        total = trees.bias
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x[:50]), [plain(r) for r in x[:50]])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_scores_of_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (7, None), (None, 1), (999, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = classifier.digest(docs, some).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.digest(docs.limit(0), labels).count() == 0
    clash = classifier.score(docs.withColumnsRenamed({"n_words": "_found", "lang": "_x"}), labels)
    assert clash.columns == ["doc_id", "text", "_x", "source", "n_chars", "_row", "_found"]
    assert classifier.statistics(None) == classifier.statistics(" \n") == [0.0] * len(classifier.STATISTICS)
    # No label of a held-out row is used: with other labels there, every score stays.
    flipped = docs.where(classifier.held_out("doc_id")).select("doc_id", F.lit(0).alias("quality"))
    a = classifier.digest(docs, labels.where("doc_id IN (5, 6)")).collect()
    b = classifier.digest(docs, labels.where("doc_id IN (5, 6)").unionByName(flipped)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
