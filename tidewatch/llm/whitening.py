"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, floor(scale * c) + offset, so that counts and
sums per dimension are exact. The rows, centred as (n*x - S) / n, are then
orthogonalised without ever being gathered: each pass sums the Gram matrix of
the rows (after triangular solves by the factors so far) over all partitions,
and its Cholesky factor is the next one. The first Gram matrix is shifted by
a little of its trace, so that it has a factor however ill-conditioned the
rows are; the passes end when the Gram matrix is the identity. The singular
values and right vectors of the composed factor are those of all rows.

Per pass a task sends one d x d matrix, which is summed by entry in a shuffle;
the driver holds d x d numbers (``MOST_DIMENSIONS`` bounds d), never rows.

Rows whose vector is null or holds a null or non-finite entry are dropped.
Null ids and repeated rows stay rows and count as often as they occur; extra
columns are ignored. Vectors of different lengths are an error. No rows, or
vectors without entries: no result. A direction in which the rows do not vary
(to double precision) is no component, so fewer than k may be returned; equal
rows have none. Whole numbers beyond 2**40 are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_arrow

MOST_DIMENSIONS = 4096
#: Gram passes at most; well-conditioned rows take three.
PASSES = 6
#: Numbers of a batch that are held as doubles at once.
AT_ONCE = 1 << 20
_UNIT = 2.0**-53
_LARGEST = 2**40


@dataclass
class Whitening:
    """What the fit has found; ``components`` holds one unit eigenvector a column."""

    n: int
    sums: list[int]
    exact: bool  # n*x - S and its squares fit in 64 bits
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    passes: int


def whole(vectors: DataFrame, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, x array<long>: floor(scale * c) + offset of the usable vectors."""
    fine = F.forall("embedding", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    return vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of whole numbers."""
    for b in batches:
        d = len(b.column(column)[0]) if b.num_rows else 0
        rows = max(1, AT_ONCE // max(d, 1))
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            lists = part.column(column)
            if set(lists.value_lengths().to_pylist()) != {d}:
                raise ValueError("vectors of different lengths")
            yield part, lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _sums(x: DataFrame) -> tuple[int, list[int], int, int]:
    """Rows, exact sums per dimension, least and greatest entry."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, low, high = 0, [], [], []
        for _, m in _matrices(batches):
            if m.size and max(abs(int(m.min())), abs(int(m.max()))) > _LARGEST:
                raise ValueError("an entry is beyond 2**40 as a whole number")
            if n and len(s) != m.shape[1]:
                raise ValueError("vectors of different lengths")
            part, a, z = m.sum(0).tolist(), m.min(0).tolist(), m.max(0).tolist()
            s, low, high = (part, a, z) if not n else ([x + y for x, y in zip(s, part, strict=True)], list(map(min, low, a)), list(map(max, high, z)))
            n += len(m)
        if s:
            yield to_arrow(schema, dim=range(len(s)), n=[n] * len(s), s=[Decimal(v) for v in s], low=low, high=high)

    parts = x.select("x").mapInArrow(run, "dim int, n long, s decimal(38,0), low long, high long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).limit(MOST_DIMENSIONS + 1).collect()
    if len(rows) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    if not rows:
        return 0, [], 0, 0
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return rows[0].n, [int(r.s) for r in sorted(rows, key=lambda r: r.dim)], min(r.low for r in rows), max(r.high for r in rows)


def _exact_sums(n: int, sums: list[int], low: int, high: int) -> bool:
    """Whether n*x - S, summed squares and all, stays within 64 bits for every row."""
    most = max([max(abs(n * low - s), abs(n * high - s)) for s in sums], default=0)
    return n * max(abs(low), abs(high), 1) < 2**63 and len(sums) * most**2 < 2**63


def _away(m: np.ndarray, n: int, sums: list[int], exact: bool) -> np.ndarray:
    """n*x - S, exactly."""
    return m * n - np.array(sums, np.int64) if exact else m.astype(object) * n - np.array(sums, object)


def _solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of upper triangular r, by forward substitution."""
    y = np.ascontiguousarray(rows.T)
    for i in range(len(r)):
        if i:
            y[i] -= r[:i, i] @ y[:i]
        y[i] /= r[i, i]
    return y.T


def _gram(x: DataFrame, n: int, sums: list[int], exact: bool, factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Sum over all rows of q'q, q the centred row after the solves.

    With ``last`` (a matrix) q is the row's product with it instead, behind a
    constant 1, so that the first row of the result holds the sums.
    """
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64())])
    width = len(sums) if last is None else last.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, m in _matrices(batches):
            q = _away(m, n, sums, exact).astype(float) / n
            for r in factors:
                q = _solved(q, r)
            if last is not None:
                q = np.column_stack([np.ones(len(q)), q @ last])
            total += q.T @ q
        yield to_arrow(schema, at=np.arange(width * width), value=total.ravel())

    parts = x.select("x").mapInArrow(run, "at int, value double")
    rows = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    g = np.zeros(width * width)
    g[[r.at for r in rows]] = [r.value for r in rows]
    return (g.reshape(width, width) + g.reshape(width, width).T) / 2


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular Cholesky factor of g, shifted if asked for or needed."""
    d = len(g)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    shift = max(11 * (n * d + d * (d + 1)) * _UNIT * float(np.trace(g)), np.finfo(float).tiny * 2**60)
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def fit(x: DataFrame) -> Whitening:
    """Components of all rows of ``whole``, by falling eigenvalue."""
    n, sums, low, high = _sums(x)
    d, exact = len(sums), _exact_sums(n, sums, low, high)
    nothing = Whitening(n, sums, exact, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    if not n or low == high:
        return nothing
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for done in range(1, PASSES + 1):
        g = _gram(x, n, sums, exact, factors)
        if done == 1 and not np.trace(g):
            return nothing
        if np.abs(g - np.eye(d)).max() < 1e-12 * d:
            composed = np.linalg.cholesky(g).T @ composed
            break
        if done == PASSES:  # directions without rows: the factor of what is left need not be triangular
            values, vectors = np.linalg.eigh(g)
            composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ composed
            break
        factors.append(_factor(g, n, shifted=done == 1))
        composed = factors[-1] @ composed
    _, s, vt = np.linalg.svd(composed)
    keep = s > s[0] * d * 2.0**-44
    return Whitening(n, sums, exact, s[keep] ** 2 / n, vt[keep].T, float((s**2).sum() / n), done)


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    One row per usable row and component up to k. deviation is the exact sum
    over dimensions of (n*x - S)^2; identity_error is measured in a pass over
    the whitened rows.
    """
    x = whole(vectors, scale, offset)
    model = fit(x)
    n, sums, exact = model.n, model.sums, model.exact
    k = min(k, len(model.eigenvalues))
    to = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    error = 0.0
    if k:
        seen = _gram(x, n, sums, exact, [], to) / n
        error = float(np.abs(seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:]) - np.eye(k)).max())
    share = (model.eigenvalues[:k] / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in _matrices(batches, 1):
            if not k:
                continue
            away = _away(m, n, sums, exact)
            rows = len(m)
            each = np.repeat(np.arange(rows), k)
            deviation = (away * away).sum(1)
            deviation = pa.array(deviation).cast(pa.decimal128(38, 0)) if exact else pa.array([Decimal(v) for v in deviation.tolist()], pa.decimal128(38, 0))
            yield to_arrow(OUT, vec_id=b.column(0).take(pa.array(each)), component=np.tile(np.arange(1, k + 1), rows), n=np.full(rows * k, n), deviation=deviation.take(pa.array(each)),
                           whitened=(away.astype(float) / n @ to).ravel(), explained=np.tile(share, rows), identity_error=np.full(rows * k, error))

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
