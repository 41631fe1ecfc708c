"""Robust outlier flags of one variable: per tag, and against all tags pooled."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.operators.schema import ORDER, Order

C = F.col
#: Levels of a grouping up to which the intervals that hold their quantiles are broadcast.
LEVELS = 1000


def thresholds(df: DataFrame, var: str, method: str, keys: list[str], q: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """(keys, lo, hi): quantiles (linear), Hampel's median +- 3 MAD, or boxplot whisker ends.

    All are order statistics, found by rank: within a key by a sorted window, which spills; over all rows by
    ``order_stats``. So no group's values are gathered in one place.
    """
    d = df.filter(C(var).isNotNull()).select(*keys, C(var).cast("double").alias("v"))
    if method not in ("quantile", "hampel", "boxplot"):
        raise ValueError(f"unknown method {method}")
    if not keys:
        return d.sparkSession.createDataFrame([_pooled(d, method, q)], "lo double, hi double")
    w = W.partitionBy(*keys)
    d = d.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("v"))})
    if method == "quantile":
        return d.groupBy(*keys).agg(*[quantile(p).alias(n) for p, n in zip(q, ("lo", "hi"))])
    if method == "hampel":
        low, high = (F.max(F.when(C("r") == f((C("n") + 1) / 2), C("v"))).over(w) for f in (F.floor, F.ceil))
        d = d.withColumn("med", (low + high) / 2)
        d = d.withColumn("dev", F.abs(C("v") - C("med")))
        d = d.select(*keys, "med", "n", C("dev").alias("v"), F.row_number().over(w.orderBy("dev")).alias("r"))
        return d.groupBy(*keys).agg(quantile(0.5).alias("mad"), F.first("med").alias("med")).select(*keys, (C("med") - 3 * C("mad")).alias("lo"), (C("med") + 3 * C("mad")).alias("hi"))
    depth = F.floor((C("n") + 3) / 2) / 2  # whole or half, counted from either end
    low = (C("r") == F.floor(depth)) | (C("r") == F.ceil(depth))
    high = (C("r") == C("n") + 1 - F.floor(depth)) | (C("r") == C("n") + 1 - F.ceil(depth))
    d = d.withColumns({"h1": F.avg(F.when(low, C("v"))).over(w), "h2": F.avg(F.when(high, C("v"))).over(w)})
    spread = 1.5 * (C("h2") - C("h1"))
    return d.groupBy(*keys).agg(F.min(F.when(C("v") >= C("h1") - spread, C("v"))).alias("lo"), F.max(F.when(C("v") <= C("h2") + spread, C("v"))).alias("hi"))


def quantile(q: float, v: str = "v", r: str = "r", n: str = "n") -> Column:
    """The linear quantile of v, from columns v, r (rank from 1) and n, as an aggregate."""
    at = (C(n) - 1) * F.lit(q)
    low, high = F.max(F.when(C(r) == F.floor(at) + 1, C(v))), F.max(F.when(C(r) == F.ceil(at) + 1, C(v)))
    return low + (high - low) * F.max(at - F.floor(at))


def order_stats(d: DataFrame, pick: Callable[[int], list[int]], column: str = "v") -> tuple[int, dict[int, float]]:
    """The number of values, and those at the ranks (from 1) that ``pick`` asks for, exactly, whatever the number.

    One pass finds approximate quantiles, several a partition. The next counts what lies below the two that enclose a
    wanted rank, and keeps only what lies between them, as value and count; the wanted rank is found by a running sum.
    Should a rank lie outside all the same, its bounds are widened. The driver sees a few numbers a partition.
    """
    n = 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.select(C(column).cast("double").alias("v")).filter("v is not null")
    total, cuts = d.agg(F.count("v"), F.percentile_approx("v", [i / n for i in range(1, n)], 10 * n)).head()
    wanted, slack = sorted({r for r in pick(total) if 1 <= r <= total}), 0.2
    if not wanted:
        return total, {}
    while True:
        ranks: dict[tuple[int, int], list[int]] = {}
        for r in wanted:
            at = r * n / total
            ranks.setdefault((max(0, math.floor(at - slack)), min(n, math.ceil(at + slack))), []).append(r)
        parts = []
        for j, (a, z) in enumerate(ranks):
            below = C("v") < cuts[a - 1] if a else F.lit(False)
            inside = C("v") <= cuts[z - 1] if z < n else F.lit(True)
            parts.append(F.when(below, F.struct(F.lit(j).alias("j"), F.lit(None).cast("double").alias("v"))).when(inside, F.struct(F.lit(j).alias("j"), C("v"))))
        counts = d.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).groupBy("x.j", "x.v").agg(F.count("*").alias("k"))
        counts = counts.withColumn("upto", F.sum("k").over(W.partitionBy("j").orderBy(F.asc_nulls_first("v"))))
        asked = F.from_json(F.lit(json.dumps([{"j": j, "r": r} for j, rs in enumerate(ranks.values()) for r in rs])), "array<struct<j:int,r:bigint>>")
        hit = F.filter(asked, lambda x: (x["j"] == C("j")) & (x["r"] <= C("upto")) & (x["r"] > C("upto") - C("k")))
        found = {x["r"]: x["v"] for x in counts.filter("v is not null").select("v", F.explode(hit).alias("x")).select("v", "x.r").collect()}
        if len(found) == len(wanted):
            return total, found
        slack *= 4


def pooled_quantiles(d: DataFrame, qs: list[float]) -> list[float | None]:
    """Linear quantiles of v over all rows."""
    ends = lambda n, q: (math.floor((n - 1) * q), math.ceil((n - 1) * q))
    n, at = order_stats(d, lambda n: [i + 1 for q in qs for i in ends(n, q)])
    low = [ends(n, q) for q in qs]
    return [at[a + 1] + (at[b + 1] - at[a + 1]) * ((n - 1) * q - a) if n else None for (a, b), q in zip(low, qs)]


def level_quantiles(d: DataFrame, level: str, columns: list[str], qs: list[float]) -> DataFrame:
    """(level, and for each column the list of its linear quantiles), exactly, where ``level`` lists the levels that a row
    belongs to; a column without values has null. However many rows a level has, no task ranks all of them.

    Approximate quantiles over all rows cut each column into intervals, several a partition, whatever the level. Counts by
    level and interval tell which intervals hold a wanted rank; only the rows of these are counted by value and ranked, one
    interval at a time. ``d`` is read three times. The driver sees the cuts.
    """
    n = 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = d.agg(F.approx_count_distinct(C(level)[0]), *[F.percentile_approx(c, [i / n for i in range(1, n)], 10 * n) for c in columns]).head()
    few, cuts = said[0] <= LEVELS, [sorted({x for x in v or [] if math.isfinite(x)} or {0.0}) for v in said[1:]]
    names = [f"__b_{c}" for c in columns]
    d = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=columns, outputCols=names, handleInvalid="keep").transform(d)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), C(b).cast("int").alias("b"), C(c).alias("v")) for c, b in zip(columns, names)])
    d = d.select(level, F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias("__x")).select(F.explode(level).alias("g"), "__x.*")
    w = W.partitionBy("g", "c")
    held = d.groupBy("g", "c", "b").agg(F.count("*").alias("k"))
    held = held.withColumns({"n": F.sum("k").over(w), "before": F.sum("k").over(w.orderBy("b")) - C("k")})
    ends = lambda q: (F.floor((C("n") - 1) * F.lit(q)) + 1, F.ceil((C("n") - 1) * F.lit(q)) + 1)
    wanted = held.filter(F.exists(F.array(*[r for q in qs for r in ends(q)]), lambda r: (r > C("before")) & (r <= C("before") + C("k")))).drop("k")
    if few:
        near = d.withColumn("k", F.lit(1)).join(F.broadcast(wanted), ["g", "c", "b"])
    else:
        near = d.groupBy("g", "c", "b", "v").agg(F.count("*").alias("k")).join(wanted, ["g", "c", "b"])
    near = near.groupBy("g", "c", "b", "n", "before", "v").agg(F.sum("k").alias("k"))
    near = near.withColumn("upto", C("before") + F.sum("k").over(W.partitionBy("g", "c", "b").orderBy("v")))
    at = lambda r: F.max(F.when((r <= C("upto")) & (r > C("upto") - C("k")), C("v")))
    linear = [at(a) + (at(b) - at(a)) * F.max((C("n") - 1) * F.lit(q) - (a - 1)) for q, (a, b) in ((q, ends(q)) for q in qs)]
    found = near.groupBy("g", "c").agg(F.array(*linear).alias("q"))
    return found.groupBy(C("g").alias(level)).agg(*[F.max(F.when(C("c") == c, C("q"))).alias(c) for c in columns])


@contextmanager
def kept(d: DataFrame) -> Iterator[DataFrame]:
    """``d`` held (in memory, else on disk) while several passes read it."""
    d = d.persist()
    try:
        yield d
    finally:
        d.unpersist()


def _pooled(d: DataFrame, method: str, q: tuple[float, float]) -> tuple[float | None, float | None]:
    with kept(d) as d:
        return _pooled_limits(d, method, q)


def _pooled_limits(d: DataFrame, method: str, q: tuple[float, float]) -> tuple[float | None, float | None]:
    if method == "quantile":
        return tuple(pooled_quantiles(d, list(q)))
    if method == "hampel":
        (med,) = pooled_quantiles(d, [0.5])
        if med is None:
            return None, None
        (mad,) = pooled_quantiles(d.select(F.abs(C("v") - F.lit(med)).alias("v")), [0.5])
        return med - 3 * mad, med + 3 * mad
    depth = lambda n: (n + 3) // 2 / 2
    sides = lambda n: ((math.floor(depth(n)), math.ceil(depth(n))), (n + 1 - math.ceil(depth(n)), n + 1 - math.floor(depth(n))))
    n, at = order_stats(d, lambda n: [r for s in sides(n) for r in s])
    if not n:
        return None, None
    h1, h2 = ((at[a] + at[b]) / 2 for a, b in sides(n))
    spread = 1.5 * (h2 - h1)
    return tuple(d.agg(F.min(F.when(C("v") >= h1 - spread, C("v"))), F.max(F.when(C("v") <= h2 + spread, C("v")))).head())


def outlier_flags(df: DataFrame, var: str = "dt", u_max: float | None = 300, q: tuple[float, float] = (0.01, 0.99), methods: tuple[str, ...] = ("quantile",), annotate: bool = True, order: Order = ORDER) -> DataFrame:
    """Adds outlier_i_<var>_<m> (i_u, i_l, 0; by the tag's own thresholds; i where both agree), outlier_ia_<var>_<m>
    (ia_u, ia_l, 0; by those of all tags) and u_max_<var>; null where the variable is."""
    d, x = df, C(var)
    for m in methods:
        own = thresholds(df, var, m, [order.key], q).select(order.key, C("lo").alias("__lo"), C("hi").alias("__hi"))
        lo, hi = _pooled(df.filter(x.isNotNull()).select(x.cast("double").alias("v")), m, q)
        d = d.join(own, order.key, "left").withColumns({"__alo": F.lit(lo).cast("double"), "__ahi": F.lit(hi).cast("double")})
        flag = lambda lo, hi, p: F.when(x.isNull(), None).when(x > C(hi), f"{p}_u").when(x < C(lo), f"{p}_l").otherwise("0")
        d = d.withColumns({f"outlier_i_{var}_{m}": flag("__lo", "__hi", "i"), f"outlier_ia_{var}_{m}": flag("__alo", "__ahi", "ia")}).drop("__lo", "__hi", "__alo", "__ahi")
    if u_max is not None:
        d = d.withColumn(f"u_max_{var}", (x >= u_max).cast("int"))
    if annotate:
        return d
    bad = [C(f"outlier_i_{var}_{m}") != "0" for m in methods]
    keep = F.lit(True)
    for b in bad:
        keep = keep & ~F.coalesce(b, F.lit(False))
    return d.filter(keep).select(df.columns)


def outlier_summary(flagged: DataFrame, var: str = "dt", method: str = "quantile", order: Order = ORDER) -> DataFrame:
    """Per tag: share of rows beyond its own and beyond the pooled thresholds, and their ratio."""
    share = lambda c: F.avg((C(c) != "0").cast("int"))
    g = flagged.groupBy(order.key).agg(share(f"outlier_i_{var}_{method}").alias("prop_i"), share(f"outlier_ia_{var}_{method}").alias("prop_ia"), F.count(var).alias("n"))
    return g.withColumn("ratio", C("prop_i") / F.nullif(C("prop_ia"), F.lit(0.0)))
