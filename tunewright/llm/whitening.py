"""Whitening components of integer vectors by shifted Cholesky QR over distributed rows.

The rows are centred with exact integer sums. A pass multiplies the rows, solved by the triangular factors so far, into
one Gram matrix per task; these are added in the order of the tasks, so a lost executor changes no bit. The first factor
is taken of a shifted Gram matrix, which always has one; each further pass makes the solved rows more orthogonal, until
the last Gram matrix is the identity to working precision. The composed factor R has the singular values and right
singular vectors of the centred rows: those are the components. The driver sees matrices of the vectors' dimension only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.session import settle

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Scaled entries from here on are no whole numbers any more and count as not finite.
LARGEST = float(2**53)
#: Partial matrices that one task adds up in the first step.
FAN_IN = 256
#: Passes at most; full rank needs three, a dependent dimension never gets orthogonal.
PASSES = 6
#: A Gram matrix this close to the identity leaves a squared rest below the precision of a double.
CLOSE = 1e-8


@dataclass(frozen=True)
class Whitening:
    """Fit over ``n`` rows: per-dimension whole means and remainders (sum = n * whole + rest), unit components as columns,
    their eigenvalues (falling; zero beyond the rank), the trace, and the largest entry of whitened covariance minus identity."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        """Components over the square root of their eigenvalue, for those that have one."""
        known = self.eigenvalues > 0
        return self.components[:, known] / np.sqrt(self.eigenvalues[known])


def integer_rows(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): entries as ``floor(scale * entry) + offset``; vectors that are null or hold a null or non-finite
    entry are left out, and so are those of another length than most (ties: the longer one)."""
    entries = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= LARGEST))
    fit = vectors.where(F.col("embedding").isNotNull() & ~odd)
    rows = settle(fit.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.transform(entries, lambda c: c.cast("long") + offset).alias("x")), "integer-rows")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    usual = lengths.first()
    return rows if usual is None else rows.where(F.size("x") == usual["length"])


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as rows of an integer matrix."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch)
                # Two halves, so that no sum leaves 64 bits.
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                got = [(int(h) << 26) + int(w) for h, w in zip(high, low, strict=True)]
                totals = got if totals is None else [a + b for a, b in zip(totals, got, strict=True)]
                n += len(x)
        if totals is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int32()), pa.array([n] * len(totals), pa.int64()),
                 pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["dim", "n", "total"])

    parts = rows.select("x").mapInArrow(partial, "dim int, n long, total decimal(38,0)")
    got = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (got[0]["n"] if got else 0), [int(r["total"]) for r in got]


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x - sum / n`` as doubles: the whole part is taken off exactly."""
    return (x - whole).astype(np.float64) - rest / n


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows of ``y`` times the inverse of each upper triangular factor, by forward substitution over the columns."""
    for r in factors:
        # One dimension per row: a column is then a contiguous run.
        q = np.ascontiguousarray(y.T)
        for j in range(len(r)):
            if j:
                q[j] -= r[:j, j] @ q[:j]
            q[j] /= r[j, j]
        y = q.T
    return y


def gram(rows: DataFrame, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the outer products of ``made(integer matrix)``, ``width`` columns wide.

    Each task adds up its rows; partial matrices travel as one record per matrix row and are added in two steps, in the
    order of the tasks.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = made(matrix_of(batch))
                total = m.T @ m if total is None else total + m.T @ m
        if total is None:
            return
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int64()),
             pa.array(list(total), pa.list_(pa.float64()))], names=["row", "part", "entries"])

    def added(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")
        total = np.sum(np.stack(some["entries"].to_numpy()), axis=0)
        return pd.DataFrame({"row": [some["row"].iloc[0]], "part": [some["part"].iloc[0] // FAN_IN], "entries": [total]})

    schema = "row int, part long, entries array<double>"
    parts = rows.select("x").mapInArrow(partial, schema)
    runs = parts.groupBy("row", F.floor(F.col("part") / FAN_IN).alias("_run")).applyInPandas(added, schema)
    last = runs.groupBy("row").applyInPandas(added, schema)
    # One record per dimension.
    return np.array([r["entries"] for r in last.orderBy("row").collect()], dtype=np.float64).reshape(width, width)


def factor(g: np.ndarray, shift: float) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(g + shift * np.eye(len(g))).T
    except np.linalg.LinAlgError:
        return None


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of ``integer_rows``; None without rows."""
    n, totals = sums(rows)
    if not n or not totals:
        return None
    whole = np.array([t // n for t in totals], dtype=np.int64)
    rest = np.array([float(t % n) for t in totals])
    d, unit = len(totals), np.finfo(float).eps / 2
    factors: list[np.ndarray] = []
    composed, regular = np.eye(d), False
    for _ in range(PASSES):
        g = gram(rows, d, lambda x, r=tuple(factors): solved(centred(x, n, whole, rest), list(r)))
        size = float(np.linalg.norm(g, 2))
        if size == 0.0:
            break
        regular = bool(factors) and float(np.abs(g - np.eye(d)).max()) <= CLOSE
        shift = 11 * (n * d + d * (d + 1)) * unit * size
        r = factor(g, shift) if not factors else factor(g, 0.0)
        if r is None:
            r = factor(g, max(shift, 16 * d * unit * size))
        if regular:
            composed = r @ composed
            break
        factors.append(r)
        composed = r @ composed
    if not regular and factors:
        # Dependent dimensions: the last Gram matrix, as it is, holds what the factors could not make orthogonal.
        last = gram(rows, d, lambda x, r=tuple(factors): solved(centred(x, n, whole, rest), list(r)))
        values, vectors = np.linalg.eigh(last)
        composed = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T @ composed
    singular, right = (np.linalg.svd(composed)[1:] if factors else (np.zeros(d), np.eye(d)))
    singular = np.where(singular > singular[0] * (1e-13 if regular else 1e-9), singular, 0.0)
    eigenvalues = singular ** 2 / n
    kept = min(components, d)
    vectors = right[:kept].T
    # Either sign is right; the same one on every run.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    model = Whitening(n, whole, rest, vectors, eigenvalues[:kept], float(eigenvalues.sum()), 0.0)
    projection = model.projection
    width = projection.shape[1]
    if not width:
        return model

    def with_ones(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, whole, rest) @ projection
        return np.hstack([w, np.ones((len(w), 1))])

    g = gram(rows, width + 1, with_ones) / n
    covariance = g[:-1, :-1] - np.outer(g[:-1, -1], g[-1, :-1])
    error = float(np.abs(covariance - np.eye(width)).max())
    return Whitening(n, whole, rest, vectors, eigenvalues[:kept], model.trace, error)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Per row the exact sum of ``(n * x - sum) ** 2``."""
    away = x - model.whole
    bound = model.n * (int(np.abs(away).max(initial=0)) + 1)
    rest = [int(r) for r in model.rest]
    if bound ** 2 * max(1, x.shape[1]) < 2**63:
        return ((model.n * away - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((model.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in away.tolist()]


SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per vector and component of ``model``: see ``whitened_vectors``."""
    projection = model.projection
    kept, known = len(model.eigenvalues), projection.shape[1]
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.full(kept, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix_of(batch)
            values = np.full((m, kept), np.nan)
            values[:, :known] = centred(x, model.n, model.whole, model.rest) @ projection
            which = pa.array(np.repeat(np.arange(m), kept))
            gaps = np.tile(np.arange(kept) >= known, m)
            shares = pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m))
            away = pa.array([Decimal(v) for v in deviations(x, model)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(which), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * kept, model.n, dtype=np.int64)), away.take(which),
                 pa.array(values.ravel(), mask=gaps), shares, pa.array(np.full(m * kept, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, SCHEMA)


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) of (vec_id, embedding).

    Vectors null or holding null or non-finite entries take no part, nor do those of another length than most. A null
    vec_id is kept; repeated rows count and are returned each. A component without variance (constant or dependent
    dimensions, a single row) has a null ``whitened`` and explains 0 (null if nothing varies). ``deviation`` is exact, in
    38 digits. Empty table or empty vectors: empty result. Further input columns are not carried, whatever their names.
    """
    rows = integer_rows(vectors.select("vec_id", "embedding"), scale, offset)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return whiten(rows, model)
