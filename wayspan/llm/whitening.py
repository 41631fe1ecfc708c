"""Embedding whitening by one-sided Jacobi SVD of a blockwise TSQR.

Vectors become integers x = floor(scale * c). The fit list is each distinct x once. Its rows, centred before anything is
multiplied, are folded block by block into a triangular R of ``dims`` by ``dims``: each task holds one R and one batch, and
the tasks' R's are merged in rounds of bounded width. Plane rotations then make R's columns orthogonal, pair by pair in
round-robin order; the accumulated rotations are the components, the columns' norms the singular values, without ever
forming a covariance. Every vector, not only the fit list, is projected.

Memory: a task holds one Arrow batch and one R, the driver one R. The fit list takes one shuffle, in which equal vectors
meet already before it; all else reads rows where they are.

Nulls: rows whose vector is null or holds null, NaN or infinite entries are left out, so are those of another length than
``dims`` (unset: the commonest one, of equally common ones the longest) and those with an integer beyond 64 bits. A null
key is kept as null, repeated rows are all returned, and only their vector counts once in the fit. Equal eigenvalues keep
the order in which the rotations leave them. Directions without variance (relative to the first, below rounding) are no
components, so vectors that are all alike, or a single one, give no rows; an empty table gives none either. A component's
sign is the one that makes its largest entry positive. Other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch
from wayspan.session import ship

#: R's that one task merges in a round.
FAN_IN = 32
SWEEPS = 60


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of a square matrix, by one-sided rotations."""
    d = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(d)
    if d < 2:
        return np.sqrt((a**2).sum(0)), v
    eps, ring = np.finfo(np.float64).eps, list(range(d + d % 2))  # an odd number of columns gets a place that rests
    floor = (eps * sqrt(float((a**2).sum()))) ** 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(i, j) < d]
            p, q = np.array([min(x) for x in pairs]), np.array([max(x) for x in pairs])
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left**2).sum(0), (right**2).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > eps * size) & (size > floor)
            if turn.any():
                turned = turned or bool((np.abs(gamma) > 4 * sqrt(d) * eps * size)[turn].any())
                p, q, zeta = p[turn], q[turn], (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    else:
        raise ArithmeticError(f"columns not orthogonal after {SWEEPS} sweeps")
    sigma = np.sqrt((a**2).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def usable(vector: str, scale: int) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < 2.0**63)), F.lit(False))


def _matrix(b: pa.RecordBatch, col: str, dims: int) -> np.ndarray:
    return b.column(col).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Whitening:
    """The fit: ``n`` distinct vectors with exact sums, components as columns, eigenvalues, and what they explain."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the mean's whole part comes off as integers, so that large means cost no digits."""
        return _centred(x, self.sums, self.n)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)^2, as Python integers."""
        top, most = int(np.abs(x.astype(np.float64)).max()) + 1 if x.size else 1, max(map(abs, self.sums), default=0) + 1
        if self.dims * top * max(top, most) >= 2**62:
            x = x.astype(object)
        squares, along = (x * x).sum(1).astype(object), (x * np.array(self.sums, dtype=x.dtype)).sum(1).astype(object)
        return self.n**2 * squares - 2 * self.n * along + sum(s * s for s in self.sums)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    whole = [s // n for s in sums]
    if max(map(abs, whole), default=0) < 2**62 and (not x.size or np.abs(x.astype(np.float64)).max() < 2**62):
        off = (x - np.array(whole, np.int64)).astype(np.float64)
    else:
        off = (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64)
    return off - np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def _per_task(d: DataFrame, fold: Callable, start: Callable) -> DataFrame:
    """One row a task: all its batches folded into one flat list of doubles, none for a task without rows."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_rows = start(), False
        for b in batches:
            if b.num_rows:
                held, any_rows = fold(held, b), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.ravel(held)], pa.list_(pa.float64()))], ["part"])

    return d.mapInArrow(folded, "part array<double>")


def _summed(parts: DataFrame) -> list:
    """The lists' sums by place."""
    rows = parts.select(F.posexplode("part").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("s")).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["i"])]


def _triangle(fit_list: DataFrame, sums: list[int], n: int, dims: int, scratch: Scratch) -> np.ndarray:
    """R of the centred fit list: folded within tasks, then merged in rounds until one is left."""

    def fold(r: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, _centred(_matrix(b, "x", dims), sums, n)]), mode="r")

    def merge(r: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, _matrix(b, "part", dims)]), mode="r")

    def start() -> np.ndarray:
        return np.zeros((dims, dims))

    at, i = scratch.write(_per_task(fit_list, fold, start), "r0"), 0
    while (left := at.count()) > 1:
        i += 1
        at = scratch.write(_per_task(at.coalesce(ceil(left / FAN_IN)), merge, start), f"r{i}")
    return np.array(at.head()["part"]).reshape(-1, dims)


def fit(fit_list: DataFrame, dims: int, count: int, scratch: Scratch) -> Whitening | None:
    """Components of distinct vectors ``x``, at most ``count``; None where there is no vector."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0] * (dims + 1)
        for b in batches:
            if b.num_rows:
                x = _matrix(b, "x", dims)
                x = x if np.abs(x.astype(np.float64)).max() * len(x) < 2**62 else x.astype(object)
                held = [a + int(s) for a, s in zip(held, [len(x), *x.sum(0)])]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([[Decimal(v) for v in held]], pa.list_(pa.decimal128(38, 0)))], ["part"])

    got = _summed(fit_list.mapInArrow(totals, "part array<decimal(38,0)>"))
    if not got:
        return None
    n, *sums = map(int, got)
    sigma, v = jacobi(_triangle(fit_list, sums, n, dims, scratch))
    real = sigma > np.finfo(np.float64).eps * max(dims, 10) * sigma[0] if sigma[0] > 0 else np.zeros(dims, bool)
    keep = np.flatnonzero(real)[:count]
    v = v[:, keep] * np.where(v[np.abs(v[:, keep]).argmax(0), keep] < 0, -1.0, 1.0)
    e = sigma**2
    return Whitening(dims, n, sums, v, e[keep] / n, [float(x) for x in e[keep] / e.sum()] if len(keep) else [])


def identity_error(fit_list: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over all its rows."""
    k = len(w.values)

    def fold(held: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        y = w.project(_matrix(b, "x", w.dims))
        return held + y.T @ y

    c = np.array(_summed(_per_task(fit_list, fold, lambda: np.zeros((k, k))))).reshape(k, k) / w.n
    return float(np.abs(c - np.eye(k)).max())


def whiten(df: DataFrame, count: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """One row per usable vector and component; ``deviation`` is decimal(38,0), null where even that is too small."""
    spark = df.sparkSession
    ship(spark)
    d = df.filter(usable(vector, scale)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    if dims is None:
        lengths = d.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), F.desc("m")).limit(1).collect()
        dims = lengths[0]["m"] if lengths else 0
    d = d.filter(F.size("v") == dims).select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    scratch = Scratch(spark, "whitening")
    ids = d.schema["id"].dataType.simpleString()
    w = None
    if dims:
        fit_list = scratch.write(d.select("x").distinct(), "fit")
        w = fit(fit_list, dims, count, scratch)
    if w is None or not len(w.values):
        scratch.clear()
        kinds = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return d.filter("false").select(F.col("id").alias(key), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    error, k = identity_error(fit_list, w), len(w.values)
    scratch.clear()
    held = spark.sparkContext.broadcast(w)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "x", held.value.dims)
            far = [Decimal(v) if v < 10**38 else None for v in held.value.deviations(x)]
            times = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(times), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(far, pa.decimal128(38, 0)).take(times), pa.array(held.value.project(x).ravel())],
                ["id", "component", "deviation", "whitened"],
            )

    rows = d.mapInArrow(projected, f"id {ids}, component int, deviation decimal(38,0), whitened double")
    shares = F.array(*(F.lit(x) for x in w.explained))
    return rows.select(F.col("id").alias(key), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
