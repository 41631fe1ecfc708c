"""Centroid clustering by sort-means over integer vectors, with exact arithmetic throughout.

Each round orders, for every centroid, the others by their distance from it. A vector looks at its centroid of the round
before first and then at the others in that order, until one is strictly farther from its own than twice its own
distance: by the triangle inequality none behind that can be as near. Then each centroid becomes its vectors'
componentwise floor(sum / count). Rounds end early only where no centroid changed, as all further ones would be equal.

Vectors of a kept length without null or non-finite entries become integers floor(scale * x). Centroids start as the
``k`` vectors with the least sha256 of ``salt:key``, in that order.

Rows stay where they are: a round reads the vectors with their last assignment, writes them with the new one, and lays
each batch's sums beside its first row, so that the sums of all rows come from a column of a few values and no vector is
ever shuffled. What reaches the driver is ``k`` sums of ``dims`` numbers.

Nulls: rows whose vector is null, of another length, or holds null, NaN or infinite entries are left out, also those with
an entry whose integer doesn't fit into 64 bits. A null key counts, but starts no centroid. Of rows with one key the
least vector comes first among starting centroids; each repeated row counts as a vector of its own. Equal distances go to
the smaller number, also where starting centroids are equal. Fewer kept vectors than ``k`` give as many centroids; an
empty table gives no rows. Distances and their sums beyond 2^63 - 1 are given as that. Other columns are not carried over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch
from wayspan.session import ship

MOST = 2**63 - 1
#: Up to here all sums of squares stay integers below 2^53 at 64 components, so that doubles hold them exactly.
_EXACT = 2**53


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles where all arithmetic on them is exact, else as Python integers."""
    x = np.floor(values.astype(np.float64) * scale)
    top = float(np.abs(x).max()) if x.size else 0.0
    if 4 * (top + 1) ** 2 * max(x.shape[1], 1) * 4 < _EXACT:
        return x
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


@dataclass
class Centroids:
    """Centroids as rows of Python integers, with each one's order of the others by squared distance."""

    rows: list[list[int]]

    def __post_init__(self) -> None:
        c = np.array(self.rows, dtype=object).reshape(len(self.rows), -1)
        apart = [[int(((a - b) ** 2).sum()) for b in c] for a in c]
        self.order = [sorted((j for j in range(len(c)) if j != a), key=lambda j: (apart[a][j], j)) for a in range(len(c))]
        self.apart = [[apart[a][j] for j in self.order[a]] for a in range(len(c))]
        top = max((abs(v) for r in self.rows for v in r), default=0)
        self.small = 4 * (top + 1) ** 2 * max(c.shape[1], 1) * 4 < _EXACT

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of each row, scanning from its last assignment."""
        if x.dtype != object and not self.small:
            x = x.astype(np.int64).astype(object)
        kind = x.dtype
        c = np.array(self.rows, dtype=object).astype(kind)
        best, near = last.astype(np.int64).copy(), np.zeros(len(x), kind)
        for a in np.unique(last):
            mine = np.flatnonzero(last == a)
            own = ((x[mine] - c[a]) ** 2).sum(1)
            far = np.argsort(-own, kind="stable")  # the farthest look the longest, so those still looking are a prefix
            mine, own = mine[far], own[far]
            at, d = np.full(len(mine), a, np.int64), own.copy()
            looking = len(mine)
            for j, between in zip(self.order[a], self.apart[a]):
                looking = int((4 * own[:looking] >= between).sum())
                if not looking:
                    break
                dj = ((x[mine[:looking]] - c[j]) ** 2).sum(1)
                nearer = (dj < d[:looking]) | ((dj == d[:looking]) & (j < at[:looking]))
                at[:looking][nearer], d[:looking][nearer] = j, dj[nearer]
            best[mine], near[mine] = at, d
        return best, near


@dataclass
class Clusters:
    """``rows``: (key, cluster, distance); ``centroids`` and ``inertia`` by number, all integers."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def usable(vector: str, dims: int, scale: int) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**63))
    return v.isNotNull() & (F.size(v) == dims) & F.coalesce(fine, F.lit(False))


def _starts(d: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The first k vectors by hash: a top-k, so k rows reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = d.filter("id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(v) for v in r] for r in integers(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1), scale)] if rows else []


def _round(d: DataFrame, centroids: Centroids, dims: int, scale: int, sums: bool) -> DataFrame:
    """``d`` (id, v, cluster) assigned anew; ``part`` of each batch's first row has, by centroid, the number of its
    vectors, the sum of their distances and, if asked for, of their components."""
    held = d.sparkSession.sparkContext.broadcast(centroids)
    n = len(centroids.rows)
    ids, kind = d.schema["id"].dataType.simpleString(), d.schema["v"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = held.value
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            best, near = c.assign(x, b.column("cluster").to_numpy(zero_copy_only=False))
            part = []
            for j in range(n):
                mine = best == j
                part += [int(mine.sum()), int(np.minimum(near[mine].astype(object), MOST).sum())]
                part += [int(v) for v in x[mine].sum(0)] if sums else []
            wide = pa.decimal128(38, 0)
            parts = pa.array([[Decimal(v) for v in part]] + [None] * (b.num_rows - 1), pa.list_(wide))
            near = near.astype(np.int64) if near.dtype != object else np.array([min(v, MOST) for v in near], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(best.astype(np.int32)), pa.array(near), parts], ["id", "v", "cluster", "distance", "part"])

    return d.select("id", "v", "cluster").mapInArrow(assigned, f"id {ids}, v {kind}, cluster int, distance long, part array<decimal(38,0)>")


def _total(d: DataFrame) -> list[int]:
    """Sums of the parts by place; each is one row of a fixed number of values a batch, added before they are dealt out."""
    rows = d.filter("part is not null").select(F.posexplode("part").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def sort_means(df: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3", key: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Cluster the usable rows; runs one job a round and one for its sums."""
    spark = df.sparkSession
    ship(spark)
    d = df.filter(usable(vector, dims, scale)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    centroids = _starts(d, k, scale, salt)
    if not centroids:
        none = d.filter("false").select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(none, [], [])
    scratch, n = Scratch(spark, "sort-means"), len(centroids)
    at, settled = d.withColumn("cluster", F.lit(0)), False
    for i in range(rounds + 1):
        last = i == rounds
        at = scratch.write(_round(at, Centroids(centroids), dims, scale, not last), f"round{i}")
        if i:
            scratch.drop(f"round{i - 1}")
        part = _total(at.select("part"))
        step = 2 + (0 if last else dims)
        parts = [part[j * step : (j + 1) * step] for j in range(n)]
        inertia = [p[1] for p in parts]
        if last:
            break
        moved = [[s // p[0] for s in p[2:]] if p[0] else c for p, c in zip(parts, centroids)]
        settled, centroids = moved == centroids, moved
        if settled:  # this round's assignment is the last one's too
            break
    return Clusters(at.select(F.col("id").alias(key), "cluster", "distance"), centroids, inertia)


def report(df: DataFrame, **how) -> DataFrame:
    """One row per usable vector with its cluster, squared distance, sums of distances and its centroid's sha256."""
    c = sort_means(df, **how)
    total = sum(c.inertia)
    fixed = [(j, min(i, MOST), min(total, MOST), hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for j, (m, i) in enumerate(zip(c.centroids, c.inertia))]
    about = df.sparkSession.createDataFrame(fixed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return c.rows.join(F.broadcast(about), "cluster").select(c.rows.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
