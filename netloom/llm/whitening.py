"""Whitening of embeddings with a randomised range finder.

Entries become integers ``x = floor(scale * c) + shift``; the components are fitted on the distinct integer vectors, each once.
The fit multiplies the covariance with a block of directions, one pass over all centred rows each time, and orthonormalises:
the block starts at random and is some columns wider than the components asked for. Rayleigh-Ritz on the block gives
components and their residuals. Where the residuals don't fall fast enough (flat spectra), the block becomes the whole space,
and one more pass gives the covariance itself. Passes return one row of sums per dimension and task, added up by Spark;
only blocks of dimensions x directions reach the driver. Rows are whitened in one map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept

SCALE, SHIFT, COMPONENTS, OVERSAMPLING, PASSES, SEED = 64, 1_000_000, 16, 10, 8, 7
#: Bound on the error of a component's direction (residual over the gap to its neighbours).
TOLERANCE = 1e-11
#: Scaled entries are clipped to so much, far above any that a double holds exactly.
CLIP = float(1 << 60)
#: Directions whose variance is a smaller share of the largest are no components.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """A fitted whitening of vectors of ``dim`` entries. ``n`` and ``sums`` (of x - shift) are exact."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray  # dim x k
    variances: np.ndarray
    trace: float
    passes: int
    full: bool
    identity_error: float = 0.0
    scale: int = SCALE
    shift: int = SHIFT


def whole_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector has entries, all of them finite."""
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where((F.size(vector_col) > 0) & ~bad)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """x - shift of entries."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -CLIP, CLIP).astype(np.int64)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a column of lists without nulls."""
    if len(column):
        sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def keys(vectors: DataFrame, scale: int) -> DataFrame:
    """Each row's integer vector as ``(dim, x)``, x in the narrowest of 16, 32 and 64 bits: equal vectors have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column(0)):
                x = integers(values, scale)
                size, out = np.abs(x).max(axis=1), [b""] * len(rows)
                width = np.where(size < 1 << 15, 2, np.where(size < 1 << 31, 4, 8))
                for w in (2, 4, 8):
                    some = np.flatnonzero(width == w)
                    data, step = x[some].astype(f"<i{w}").tobytes(), w * x.shape[1]
                    for k, row in enumerate(some.tolist()):
                        out[row] = data[k * step : (k + 1) * step]
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(rows), pa.int32()), pa.array(out, pa.binary())], names=["dim", "x"])

    return vectors.mapInArrow(run, "dim int, x binary")


def decoded(column: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors of keys, in any order."""
    found = column.to_pylist()
    return np.concatenate([np.empty((0, dim), np.int64), *(np.frombuffer(b"".join(x for x in found if len(x) == w * dim), f"<i{w}").reshape(-1, dim) for w in (2, 4, 8))])


def column_sums(fit: DataFrame) -> tuple[int, int, list[int]]:
    """The commonest length among distinct vectors (the longer of equals), their number and exact sums per dimension."""
    counts = {r["dim"]: r["n"] for r in fit.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return 0, 0, []
    dim = max(counts, key=lambda d: (counts[d], d))

    def run(batches):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = decoded(batch.column(0), dim)
            high, low = high + (x >> 30).sum(axis=0), low + (x & (1 << 30) - 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(high), pa.array(low)], names=["k", "high", "low"])

    sums = fit.where(F.col("dim") == dim).select("x").mapInArrow(run, "k int, high long, low long")
    sums = sums.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]).collect()
    exact = {r["k"]: (int(r["high"]) << 30) + int(r["low"]) for r in sums}
    return dim, counts[dim], [exact[k] for k in range(dim)]


def passed(fit: DataFrame, dim: int, width: int, block) -> np.ndarray:
    """The sum of ``block(integer vectors)``, matrices of ``dim`` x ``width``, over all rows: a row of sums per dimension and task, added up by Spark."""

    def partial(batches):
        total = np.zeros((dim, width))
        for batch in batches:
            total += block(decoded(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "sums"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "sums"])

    rows = fit.select("x").mapInArrow(partial, "k int, sums binary").repartition("k").mapInArrow(added, "k int, sums binary").collect()
    found = {r["k"]: np.frombuffer(r["sums"]) for r in rows}
    return np.stack([found[k] for k in range(dim)])


def find_range(multiply, dim: int, k: int, *, oversampling: int, passes: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """The ``k`` leading eigenvectors and eigenvalues of a covariance known by ``multiply(block)``; the passes; whether the whole space was needed."""
    width = min(dim, k + oversampling)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    for done in range(1, passes + 2):
        y = multiply(q)
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if q.shape[1] == dim:
            return (q @ turn)[:, :k], values[:k], done, width < dim
        residual = np.linalg.norm(y @ turn - q @ turn * values, axis=0)[:k]
        gap = np.minimum(np.abs(np.diff(values, prepend=np.inf)), np.abs(np.diff(values, append=-np.inf)))[:k]
        worst = (residual / np.maximum(gap, 1e-300)).max()
        if worst <= tolerance:
            return (q @ turn)[:, :k], values[:k], done, False
        fall = max(values[-1], 0) / values[k - 1] if values[k - 1] > 0 else 1.0
        hopeless = done > 2 and (fall >= 1 or fall > 0 and np.log(tolerance / worst) / np.log(fall) > passes - done)
        q = np.eye(dim) if hopeless or done >= passes else np.linalg.qr(y)[0]
    raise AssertionError("the last pass covers the whole space")


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, oversampling: int = OVERSAMPLING,
                  passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = SEED) -> Whitening | None:
    """Fits on each distinct integer vector once.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than most
    distinct ones (the longer of equally common lengths). Scaled entries beyond 2 ** 60 count as 2 ** 60. Directions without
    variance are no components, so there may be fewer than ``k``; without vectors there is no whitening (None). Equal
    eigenvalues have any orthonormal vectors of their space. The covariance has the divisor n.
    """
    kept = Kept(keys(whole_vectors(vectors, vector_col).select(vector_col), scale).distinct())
    dim, n, sums = column_sums(kept.df)
    if not n:
        kept.drop()
        return None
    fit, mean = kept.df.where(F.col("dim") == dim), np.array([s / n for s in sums])
    k, trace = min(k, dim), 0.0

    def multiply(q: np.ndarray) -> np.ndarray:
        def block(x):
            centred = x - mean
            return np.column_stack([centred.T @ (centred @ q), np.square(centred).sum(axis=0)])

        nonlocal trace
        out = passed(fit, dim, q.shape[1] + 1, block) / n
        trace = float(out[:, -1].sum())
        return out[:, :-1]

    components, variances, done, full = find_range(multiply, dim, k, oversampling=oversampling, passes=passes, tolerance=tolerance, seed=seed)
    good = variances > NO_VARIANCE * max(float(variances[0]), 0.0)
    model = Whitening(dim, n, sums, components[:, good], variances[good], trace, done, full, scale=scale, shift=shift)
    if width := int(good.sum()):
        turn = model.components / np.sqrt(model.variances)

        def spread(x):
            w = (x - mean) @ turn
            out = np.zeros((dim, width + 1))
            out[:width, :width], out[:width, width] = w.T @ w, w.sum(axis=0)
            return out

        moments = passed(fit, dim, width + 1, spread)[:width] / n
        model.identity_error = float(np.abs(moments[:, :width] - np.outer(moments[:, width], moments[:, width]) - np.eye(width)).max())
    kept.drop()
    return model


def whiten(vectors: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, deviation (exact sum of (n * x - S) ** 2, null beyond a long), whitened (an array)``.

    Vectors that the fit leaves out for their entries or length are left out; rows repeated in the table are repeated here; null
    ids stay; other columns are ignored. Without a model there are no rows.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = whole_vectors(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v").select("vec_id", "v")
    schema = f"vec_id {kind}, deviation bigint, whitened array<double>"
    if model is None:
        return rows.where(F.lit(False)).select("vec_id", F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    rows = rows.where(F.size("v") == model.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean = model.n, model.sums, np.array([s / model.n for s in model.sums])
        turn = model.components / np.sqrt(model.variances)
        largest, width = max(map(abs, sums)), turn.shape[1]
        for batch in batches:
            for some, values in matrices(batch.column(1)):
                x = integers(values, model.scale)
                most = n * int(np.abs(x).max()) + largest
                if most * most * model.dim < 1 << 62:
                    deviation = np.square(n * x - np.array(sums)).sum(axis=1).tolist()
                else:
                    deviation = [d if d < 1 << 63 else None for d in (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())]
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(((x - mean) @ turn).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(deviation, pa.int64()), whitened], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, schema)


def long_form(whitened: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    n, error, shares = (model.n, model.identity_error, (model.variances / model.trace).tolist()) if model and len(model.variances) else (0, 0.0, [])
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in shares or [0.0]]), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
