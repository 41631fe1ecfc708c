"""Sampling rates of fixes, from the time to the next fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.functions.text import fixed
from wayspan.operators.movement import time_steps
from wayspan.operators.schema import ORDER, Order

#: Usual rates in seconds and the tolerance of each, fixed values.
BREAKS = (1, 60, 100, 300, 600, 900, 1200, 1800, 3600, 7200, 10800)
TOL = (0, 0.5, 0.4, 0.4, 0.3, 0.3, 0.3, 0.3, 0.3, 0.2, 0.2)


def rate_label(dt: Column, longest: Column, breaks: tuple[float, ...] = BREAKS, tol: tuple[float, ...] = TOL) -> Column:
    """The rate b whose edge b(1+tol) is the first that dt doesn't exceed; beyond all, ``<`` and the longest dt."""
    edges = [b * (1 + t) for b, t in zip(breaks, tol, strict=True)]
    out = F.when(dt.isNull() | (dt <= edges[0]), None)
    for e, b in zip(edges[1:], breaks[1:]):
        out = out.when(dt <= e, f"{b:g}")
    return out.otherwise(F.concat(F.lit("<"), F.round(longest).cast("long").cast("string")))


def assign_rates(df: DataFrame, by: str | None = None, breaks: tuple[float, ...] = BREAKS, tol: tuple[float, ...] = TOL, out: str | None = "summary", after_gap: bool = False, order: Order = ORDER) -> DataFrame:
    """Rows with likely_rate, or per tag (and ``by``) and rate: start, end and number of fixes.

    The longest dt, which labels the open bin, is that of the whole table.
    """
    d = df if "dt" in df.columns else time_steps(df, order)
    if after_gap:
        d = d.withColumn("dt", F.when(F.col("gap") == 1, None).otherwise(F.col("dt")))
    top = d.agg(F.max("dt").alias("__top"))  # one row
    d = d.crossJoin(F.broadcast(top)).withColumn("likely_rate", rate_label(F.col("dt"), F.col("__top"), breaks, tol)).drop("__top")
    if out is None:
        return d
    return d.filter("likely_rate is not null").groupBy(order.key, *([by] if by else []), "likely_rate").agg(F.min(order.time).alias("start"), F.max(order.time).alias("end"), F.count("*").alias("N"))


def rate_tables(df: DataFrame, thresh: float = 20, top: int = 2, breaks: tuple[float, ...] = BREAKS, tol: tuple[float, ...] = TOL, order: Order = ORDER) -> dict[str, DataFrame]:
    """counts and percentages per tag and rate (with the tag "all"), wide counts, top rates, and rates over ``thresh`` percent.

    Open bins are one rate, ``<last break>+``.
    """
    s = assign_rates(df, breaks=breaks, tol=tol, order=order)
    label = F.when(F.col("likely_rate").startswith("<"), f"{breaks[-1]:g}+").otherwise(F.col("likely_rate"))
    s = s.select(F.col(order.key).cast("string").alias(order.key), label.alias("rate"), "N")
    per = s.groupBy(order.key, "rate").agg(F.sum("N").alias("N"))
    whole = per.groupBy("rate").agg(F.sum("N").alias("N")).select(F.lit("all").alias(order.key), "rate", "N")
    counts = per.unionByName(whole).withColumn("pct", 100 * F.col("N") / F.sum("N").over(W.partitionBy(order.key)))
    wide = per.groupBy(order.key).pivot("rate", [*(f"{b:g}" for b in breaks[1:]), f"{breaks[-1]:g}+"]).agg(F.sum("N")).na.fill(0)
    rank = F.row_number().over(W.partitionBy(order.key).orderBy(F.desc("N"), "rate"))
    return {
        "counts": counts,
        "wide": wide,
        "top": per.withColumn("rank", rank).filter(F.col("rank") <= top),
        "over": counts.filter(F.col("pct") > thresh),
    }


def rate_text(df: DataFrame, thresh: float = 20, max_show: int = 3, breaks: tuple[float, ...] = BREAKS, tol: tuple[float, ...] = TOL, order: Order = ORDER) -> DataFrame:
    """The extended report, as (line, text): the two top rates over all tags; tags whose finest rate with more than
    ``thresh`` % of their fixes is the coarsest, and the finest, of all (``max_show`` of them by name, then "..."); and how
    many fixes lie beyond the last rate, most of all for which tag. Equal counts go to the finer rate, equal shares to the
    tag first by name."""
    t = rate_tables(df, thresh, breaks=breaks, tol=tol, order=order)
    num = lambda c: F.regexp_replace(c, r"\+", "").cast("double")
    tag, two = F.col(order.key), lambda c: fixed(c, 2)
    counts = t["counts"].withColumn("num", num("rate"))
    first = W.partitionBy(order.key).orderBy(F.desc("N"), "num", F.length("rate"))
    lead = counts.filter(tag == "all").withColumn("line", F.row_number().over(first)).filter("line <= 2")
    lines = [lead.select("line", F.concat(F.col("line").cast("string"), F.lit(". "), "rate", F.lit(" s ("), two(F.col("pct")), F.lit("% GPS fixes)")).alias("text"))]
    fine = t["over"].withColumn("num", num("rate")).groupBy(order.key).agg(F.min("num").alias("y"))
    ends = fine.agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    named = fine.filter(tag != "all").crossJoin(F.broadcast(ends))  # one row
    for line, end, word in ((3, "hi", "coarser"), (4, "lo", "finer")):
        mine = named.filter(F.col("y") == F.col(end)).withColumn("r", F.row_number().over(W.partitionBy("y").orderBy(order.key))).filter(F.col("r") <= max_show + 1)
        shown = F.transform(F.sort_array(F.collect_list(F.struct("r", order.key))), lambda x: F.when(x["r"] <= max_show, x[order.key]).otherwise(F.lit("...")))
        text = F.concat(F.lit("For animal(s) "), F.array_join(shown, ", "), F.lit(f": {thresh:g}% or more data was collected at {word} rates of "), F.regexp_replace(F.max("y").cast("string"), r"\.0$", ""), F.lit(" s"))
        lines.append(mine.groupBy("y").agg(text.alias("text")).select(F.lit(line).alias("line"), "text"))
    beyond = counts.filter(F.col("rate").endswith("+"))
    share = beyond.filter(tag == "all").select(F.lit(5).alias("line"), F.concat(two(F.col("pct")), F.lit("% fixes above the max rate")).alias("text"))
    most = beyond.filter(tag != "all").agg(F.max("pct").alias("p"), F.min_by(order.key, F.struct(-F.col("pct"), order.key)).alias("tag")).filter("tag is not null")
    most = most.select(F.lit(6).alias("line"), F.concat(F.lit("Animal: "), "tag", F.lit(" has the greatest percentage ("), two(F.col("p")), F.lit("%) fixes above the max rate")).alias("text"))
    none = beyond.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(5).alias("line"), F.lit("No fixes detected beyond the max rate specified").alias("text"))
    for d in (share, most, none):
        lines.append(d)
    out = lines[0]
    for d in lines[1:]:
        out = out.unionByName(d)
    return out
