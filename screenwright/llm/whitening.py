"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, so counts and sums of all vectors are exact. The scatter is summed from vectors that are
centred by the exact mean first: every task adds up its own d x d matrix, and its rows are summed by number. What comes to
the driver is one such matrix, whose size depends on the dimension alone. There, Cholesky with diagonal pivots gives
``V = L L'`` up to the order of dimensions, and plane rotations of the columns of ``L`` make them orthogonal: their norms are the
square roots of the eigenvalues, the normalised columns the components. ``V`` is never squared and no eigenvalue is lost
to cancellation.

Rows whose vector is null, or holds null, non-finite or unrepresentable entries (beyond 2 to the power of 50), are left
out. Vectors have one length; if several occur, the commonest counts (of equally common ones the longest) and rows of
others are left out, as no covariance holds them. Components of no variance have no whitened values: there are as many components as the rank, at most ``MOST``, so
one vector, or equal vectors only, or an empty table give no rows. Repeated rows count each. ``deviation`` is null where
it exceeds 64 bits. Input columns travel in a struct, so their names may be anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import keep, mapped

MOST = 8
#: Fixed values of the contract.
SCALE, SHIFT = 1024, 100_000
_LARGEST = 2.0**50
#: Rotations end when no two columns are further from orthogonal than this, or after so many rounds over all pairs.
NEAR, ROUNDS = 1e-15, 60
#: Vectors that are worked on together in a task.
ROWS = 4096


class Model(NamedTuple):
    """What whitening needs: the number of vectors, exact sums, components (a row each) and their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The lengths of all vectors (-1 for those left out), and by length their places and their entries as whole numbers."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    flat = column.flatten()
    values = np.asarray(flat.fill_null(np.nan), np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * values) + SHIFT
        bad = ~(np.abs(x) < _LARGEST)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    lengths = lengths.copy()
    lengths[owner[bad]] = -1
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = (at, x[starts[at][:, None] + np.arange(d)].astype(np.int64))
    return lengths, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in _slices(batches):
        for d, (at, x) in whole(batch.column("_vector"))[1].items():
            n, s = totals.get(d, (0, np.zeros(d, np.int64)))
            totals[d] = (n + len(at), s + x.sum(axis=0))
    for d, (n, s) in totals.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int64()), "n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.int64()))})


def _partial_scatter(n: int, sums: np.ndarray) -> Callable:
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((d, d)), False
        for batch in _slices(batches):
            found = whole(batch.column("_vector"))[1].get(d)
            if found is not None:
                y = centred(found[1], n, sums)
                total += y.T @ y
                met = True
        if met:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int64()), "v": pa.array(list(total), pa.list_(pa.float64()))})
    return run


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean: the integer part of the mean exactly, then its remainder."""
    whole_part = sums // n
    return (x - whole_part).astype(np.float64) - (sums - whole_part * n) / n


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor and order of dimensions with ``v[order][:, order] = L @ L.T``; as many columns as the rank."""
    a, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def rotated(factor: np.ndarray) -> np.ndarray:
    """The factor times an orthogonal matrix, with orthogonal columns: one-sided Jacobi.

    Each round pairs every column with every other; the pairs of a step have no column in common and rotate at once.
    """
    u = factor.copy()
    r = u.shape[1]
    if r < 2:
        return u
    ring = list(range(r)) + ([-1] if r % 2 else [])
    half = len(ring) // 2
    for _ in range(ROUNDS):
        most = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if a >= 0 and b >= 0]
            i, j = (np.array(x) for x in zip(*pairs, strict=True))
            a, b = u[:, i], u[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
            most = max(most, float(off.max()))
            turn = off > NEAR
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            u[:, i], u[:, j] = c * a - s * b, s * a + c * b
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if most <= NEAR:
            break
    return u


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (a row each) of a covariance; only those above zero."""
    factor, order = cholesky(v)
    u = rotated(factor)
    norms = np.sqrt((u * u).sum(0))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] > 0]
    components = np.zeros((len(by), len(v)))
    components[:, order] = (u[:, by] / norms[by]).T
    return norms[by] ** 2, components


def packed(vectors: DataFrame, vector: str, carry: list[str]) -> DataFrame:
    return vectors.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col(f"`{vector}`").alias("_vector"))


def fit(rows: DataFrame, most: int = MOST) -> Model | None:
    """The model of all vectors of ``packed`` rows; None if there is no variance."""
    only = rows.select("_vector")
    sums = mapped(only, _partial_sums, "d long, n long, s array<long>")
    by = sums.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).groupBy("d").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    best = by.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    n, exact = best["n"], np.array([x["s"] for x in best["s"]], np.int64)
    parts = mapped(only, _partial_scatter(n, exact), "i long, v array<double>")
    rows_of = parts.groupBy("i").agg(*(F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(len(exact)))).orderBy("i").collect()
    v = np.array([list(r)[1:] for r in rows_of]) / n
    v = (v + v.T) / 2
    values, components = eigen(v)
    if not len(values):
        return None
    return Model(n, exact, components[:most], values[:most], float(np.trace(v)))


def _apply(model: Model) -> Callable:
    d, n, sums = len(model.sums), model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
        for batch in _slices(batches):
            at, x = whole(batch.column("_vector"))[1].get(d, (np.empty(0, np.int64), np.empty((0, d), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(at)), pa.array(deviations(x, n, sums), pa.int64()),
                 pa.array(list(centred(x, n, sums) @ turn), pa.list_(pa.float64()))], ["_row", "_deviation", "_whitened"])
    return run


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S) squared; None where one exceeds 64 bits."""
    rough = n * (x - sums / n)
    if not len(x) or (np.sqrt((rough * rough).sum(1)).max() < 2.0**31 and n * (np.abs(x).max() + 1.0) < 2.0**62):
        z = n * x - sums
        return (z * z).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [z if z < 2**63 else None for z in exact]


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = MOST, carry: list[str] | None = None) -> tuple[DataFrame, Model | None]:
    """Rows with ``_found`` (deviation, whitened: one value a component), and the model. A row left out of the fit is
    left out here. An input column ``_found`` gives way."""
    carry = vectors.columns if carry is None else carry
    rows = packed(vectors, vector, carry)
    model = fit(rows, most)
    schema = StructType([rows.schema["_row"], StructField("_deviation", LongType()), StructField("_whitened", ArrayType(DoubleType()))])
    out = mapped(rows, _apply(model), schema) if model else vectors.sparkSession.createDataFrame([], schema)
    return keep(out, "whitened").select(
        *(F.col("_row").getField(c).alias(c) for c in carry if c != "_found"),
        F.struct(F.col("_deviation").alias("deviation"), F.col("_whitened").alias("whitened")).alias("_found")), model


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest distance of the covariance of whitened values from the identity; centred by their means first."""
    w = [F.col("_found.whitened")[i] for i in range(k)]
    means = whitened.agg(*(F.avg(c) for c in w)).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*(F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs)).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def digest(vectors: DataFrame) -> DataFrame:
    found, model = whiten(vectors.select("vec_id", "embedding"), carry=["vec_id"])
    if model is None:
        model = Model(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
    error = identity_error(found, len(model.eigenvalues)) if len(model.eigenvalues) else 0.0
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    return found.select("vec_id", F.posexplode("_found.whitened").alias("_at", "whitened"), F.col("_found.deviation").alias("deviation")).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
