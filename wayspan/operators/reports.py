"""Monitoring summaries per tag, and the bundle of data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.functions.crs import Crs
from wayspan.functions.text import fixed
from wayspan.operators import checks, duplicates, outliers, rates
from wayspan.operators.movement import time_steps
from wayspan.operators.schema import ORDER, Order, micros

C = F.col


def tag_counts(df: DataFrame, tags: list | None = None, order: Order = ORDER) -> DataFrame:
    """Rows per tag and in all."""
    d = df.filter(C(order.key).isin(tags)) if tags else df
    n = d.groupBy(order.key).agg(F.count("*").alias("n_row"))
    total = n.agg(F.sum("n_row").alias("total"))
    return n.crossJoin(F.broadcast(total))  # one row


def tabulate_history(df: DataFrame, by: str | None = None, order: Order = ORDER) -> DataFrame:
    """Per tag (and ``by``): Start, End, Dur_days, nfixes, and Dur_days_mon, the sum of section spans."""
    keys = [order.key, *([by] if by else [])]
    us = micros(order.time)
    s = df.groupBy(*keys, "gapsec").agg(F.min(order.time).alias("a"), F.max(order.time).alias("b"), F.min(us).alias("lo"), F.max(us).alias("hi"), F.count("*").alias("n"))
    day = F.lit(8.64e10)
    return s.groupBy(*keys).agg(F.min("a").alias("Start"), F.max("b").alias("End"), ((F.max("hi") - F.min("lo")) / day).alias("Dur_days"), F.sum("n").alias("nfixes"), (F.sum(C("hi") - C("lo")) / day).alias("Dur_days_mon"))


def summary(df: DataFrame, stat: str = "mean", dispersion: str = "MAD", digits: int = 2, mode: str = "full", numeric: tuple[str, ...] = (), add_ranges: bool = False, gap_unit: str = "secs", order: Order = ORDER) -> DataFrame:
    """Per tag, and over all as "ALL": records, fixes (distinct times), nulls, first and last time, duration in days,
    bounding box, gaps between fixes, and ``stat ± dispersion`` of dt (and of ``numeric`` columns; with ``add_ranges``
    their least and greatest values in brackets). Gaps are in ``gap_unit``: secs, mins, hours or days.

    A tag's row comes from windows over one partitioning by tag, and the row over all from the tags' rows, but for its
    mode (from counts by value) and medians (order statistics by rank), so no group's values are gathered in one place.
    """
    unit = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400}[gap_unit]
    every = F.grouping(order.key) == 1
    d = time_steps(df, order).withColumn("dt", C("dt") / unit)
    d = d.withColumn("__fix", C(order.time).isNotNull() & ~C(order.time).eqNullSafe(F.lag(order.time).over(order.window())))
    cols = [] if mode == "simple" else ["dt", *(numeric if mode == "full_plus" else ())]
    us = micros(order.time)
    per = [
        F.count("*").alias("n_records"), F.sum(C(order.time).isNull().cast("long")).alias("n_na_DT"), F.min(order.time).alias("start"), F.max(order.time).alias("end"), F.min(us).alias("__lo"), F.max(us).alias("__hi"),
        F.min("longitude").alias("xmin"), F.max("longitude").alias("xmax"), F.min("latitude").alias("ymin"), F.max("latitude").alias("ymax"), F.sum(C("__fix").cast("long")).alias("n_fixes"),
    ]
    merged = [
        F.sum("n_records").alias("n_records"), F.sum("n_na_DT").alias("n_na_DT"), F.min("start").alias("start"), F.max("end").alias("end"), ((F.max("__hi") - F.min("__lo")) / F.lit(8.64e10)).alias("dur"),
        F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"), F.sum("n_fixes").alias("n_fixes"),
    ]
    if mode != "simple":
        most = lambda n: F.max_by("dt", F.when(C("dt").isNotNull(), F.struct(C(n).alias("n"), -C("dt"))))
        times = d.filter("dt is not null").groupBy("dt").agg(F.count("*").alias("n")).agg(most("n").alias("__gap_mode"))
        d = d.withColumn("__same", F.count("*").over(order.whole("dt")))
        per += [F.sum(C("longitude").isNull().cast("long")).alias("__no_lon"), F.sum(C("latitude").isNull().cast("long")).alias("__no_lat"), most("__same").alias("gap_mode")]
        merged += [(F.sum("__no_lon") / F.sum("n_records")).alias("na_lon"), (F.sum("__no_lat") / F.sum("n_records")).alias("na_lat"), F.min("__min_dt").alias("gap_min"), F.max("__max_dt").alias("gap_max"), F.when(~every, F.max("gap_mode")).alias("gap_mode")]
    for c in cols:
        low, high, n, mean, sd = (f"__{x}_{c}" for x in ("min", "max", "n", "mean", "sd"))
        per += [F.min(c).alias(low), F.max(c).alias(high), F.count(c).alias(n), F.avg(c).alias(mean), F.stddev(c).alias(sd)]
        merged += [F.min(low).alias(low), F.max(high).alias(high)]
        if stat == "median":
            d, mid, width = _ranked(d, c, dispersion, order)
            all_mid, all_width = _pooled_medians(d, c, dispersion)
            per += [mid.alias(f"__mid_{c}"), width.alias(f"__width_{c}")]
            merged += [F.when(every, F.lit(x).cast("double")).otherwise(F.max(f"__{y}_{c}")).alias(f"__{y}_{c}") for x, y in ((all_mid, "mid"), (all_width, "width"))]
        else:
            total = F.sum(C(n) * C(mean)) / F.sum(n)
            spread = F.sum((C(n) - 1) * F.coalesce(C(sd), F.lit(0.0)) ** 2) + F.sum(C(n) * C(mean) ** 2) - F.sum(n) * total**2
            pooled = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(F.sum(n) - 1, F.lit(0)))
            pooled = F.when(F.sum(n) > 0, pooled)
            merged += [F.when(every, total).otherwise(F.max(mean)).alias(f"__mid_{c}"), F.when(every, pooled).otherwise(F.max(sd)).alias(f"__width_{c}")]
    # The rollup doubles the tags' rows, not those of the table.
    out = d.groupBy(order.key).agg(*per).rollup(order.key).agg(every.alias("__every"), *merged)
    if mode != "simple":
        out = out.crossJoin(F.broadcast(times)).withColumn("gap_mode", F.when(C("__every"), C("__gap_mode")).otherwise(C("gap_mode"))).drop("__gap_mode")  # one row
    f = lambda v: F.coalesce(fixed(v, digits), F.lit("NA"))
    for c in cols:
        text = F.concat(f(C(f"__mid_{c}")), F.lit(" ± "), f(C(f"__width_{c}")))
        text = F.concat(text, F.lit(" ["), f(C(f"__min_{c}")), F.lit(", "), f(C(f"__max_{c}")), F.lit("]")) if add_ranges else text
        out = out.withColumn(f"{c}_{stat}", text).drop(*[f"__{x}_{c}" for x in ("mid", "width", "min", "max")])
    return out.withColumn(order.key, F.when(C("__every"), F.lit("ALL")).otherwise(C(order.key).cast("string"))).drop("__every")


def _ranked(d: DataFrame, column: str, dispersion: str, order: Order) -> tuple[DataFrame, Column, Column]:
    """Rank columns of a column within its tag, and with them the median and the MAD or IQR as aggregates by tag."""
    v, r, n, dev, by = (f"__{x}_{column}" for x in ("v", "r", "cnt", "dev", "by"))
    w = order.whole()
    d = d.withColumn(v, C(column).cast("double"))
    d = d.withColumns({n: F.count(v).over(w), r: F.row_number().over(w.orderBy(F.asc_nulls_last(v)))})
    mid = outliers.quantile(0.5, v, r, n)
    if dispersion != "MAD":
        return d, mid, outliers.quantile(0.75, v, r, n) - outliers.quantile(0.25, v, r, n)
    low, high = (F.max(F.when(C(r) == f((C(n) + 1) / 2), C(v))).over(w) for f in (F.floor, F.ceil))
    d = d.withColumn(dev, F.abs(C(v) - (low + (high - low) * 0.5)))
    return d.withColumn(by, F.row_number().over(w.orderBy(F.asc_nulls_last(dev)))), mid, outliers.quantile(0.5, dev, by, n)


def _pooled_medians(d: DataFrame, column: str, dispersion: str) -> tuple[float | None, float | None]:
    """The median of a column over all rows, and its MAD or IQR."""
    with outliers.kept(d.filter(C(column).isNotNull()).select(C(column).cast("double").alias("v"))) as x:
        low, mid, high = outliers.pooled_quantiles(x, [0.25, 0.5, 0.75])
        if mid is None or dispersion != "MAD":
            return mid, None if mid is None else high - low
        return mid, outliers.pooled_quantiles(x.select(F.abs(C("v") - F.lit(mid)).alias("v")), [0.5])[0]


def tag_timeline(df: DataFrame, active: float = 0.5, alone: float = 0.5, miss: float = 0.25, order: Order = ORDER) -> DataFrame:
    """Per tag over its own span of days: other animals active beside it (mean, sd, min, max), share of all days on
    which it was active, days alone, share of its span without data, and flags against the three thresholds."""
    days = df.select(order.key, F.to_date(order.time).alias("day")).filter("day is not null").distinct()
    busy = days.groupBy("day").agg(F.count("*").alias("n"))
    all_days = days.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("__all"))
    j = days.join(busy, "day").groupBy(order.key).agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days_active"), F.avg(C("n") - 1).alias("mean_overlap"), F.stddev(C("n") - 1).alias("sd_overlap"),
        F.min(C("n") - 1).alias("min_overlap"), F.max(C("n") - 1).alias("max_overlap"), F.sum((C("n") == 1).cast("long")).alias("days_alone"),
    )
    span = F.datediff("last", "first") + 1
    j = j.crossJoin(F.broadcast(all_days))  # one row
    j = j.withColumns({"prop_active": C("days_active") / C("__all"), "prop_missing": 1 - C("days_active") / span, "prop_alone": C("days_alone") / C("days_active")}).drop("__all")
    return j.withColumns({"low_active": C("prop_active") < active, "often_alone": C("prop_alone") > alone, "often_missing": C("prop_missing") > miss})


def day_grid(df: DataFrame, order: Order = ORDER) -> DataFrame:
    """Every tag on every day from the first to the last of all: (key, day, n)."""
    n = df.groupBy(order.key, F.to_date(order.time).alias("day")).agg(F.count("*").alias("n")).filter("day is not null")
    ends = n.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = df.select(order.key).distinct().crossJoin(F.broadcast(ends)).select(order.key, F.explode(F.sequence("a", "b")).alias("day"))  # one row of ends
    return grid.join(n, [order.key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fix_summary(df: DataFrame, least: int = 5, order: Order = ORDER) -> DataFrame:
    """Per tag: fixes, days, min, mean and max fixes a day, days below ``least`` and their share."""
    n = df.groupBy(order.key, F.to_date(order.time).alias("day")).agg(F.count("*").alias("n"))
    bad = F.sum((C("n") < least).cast("long"))
    return n.groupBy(order.key).agg(F.sum("n").alias("fixes"), F.count("*").alias("days"), F.min("n").alias("min_day"), F.avg("n").alias("mean_day"), F.max("n").alias("max_day"), bad.alias("bad_days"), (bad / F.count("*")).alias("bad_prop"), (F.sum("n") < least).alias("below"))


def bounds(df: DataFrame, crs: int = 3035) -> DataFrame:
    """Bounding box of the projected points."""
    x, y = Crs(crs).project(C("longitude"), C("latitude"))
    d = df.select(x.alias("X"), y.alias("Y"))
    return d.agg(F.min("X").alias("xmin"), F.min("Y").alias("ymin"), F.max("X").alias("xmax"), F.max("Y").alias("ymax"))


def farthest_point(df: DataFrame, per_trip: bool = False, planar: bool = False, order: Order = ORDER) -> DataFrame:
    """The fix farthest from the first one, per tag (and trip), along the rhumb line, or on the plane (X, Y)."""
    keys = [order.key, *(["tripNo"] if per_trip else [])]
    at = ["X", "Y"] if planar else ["longitude", "latitude"]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*at), F.struct(*order.by)).alias("__o"))
    ends = [C(c) for c in at] + [C(f"__o.{c}") for c in at]
    far = F.hypot(ends[0] - ends[2], ends[1] - ends[3]) if planar else geo.rhumb(*ends)
    d = df.join(first, keys).withColumn("__d", far)
    return d.groupBy(*keys).agg(F.max_by(F.struct(order.time, "longitude", "latitude"), F.struct(C("__d"), -micros(order.time))).alias("p"), F.max("__d").alias("dist")).select(*keys, "p.*", "dist")


def track_lines(df: DataFrame, order: Order = ORDER) -> DataFrame:
    """A line per section of more than one fix: its points in order."""
    p = F.struct(*order.by, "longitude", "latitude")
    g = df.filter("longitude is not null and latitude is not null").groupBy(order.key, "gapsec").agg(F.sort_array(F.collect_list(p)).alias("line"))
    return g.filter(F.size("line") > 1)


def null_report(df: DataFrame, order: Order = ORDER) -> DataFrame:
    bad = C("longitude").isNull() | C("latitude").isNull()
    return df.groupBy(order.key).agg(F.sum(bad.cast("long")).alias("n_na"), F.avg(bad.cast("int")).alias("prop_na"))


def satellite_report(df: DataFrame, most_bad: int = 3, column: str = "satellites_used", order: Order = ORDER) -> DataFrame:
    s = C(column)
    return df.groupBy(order.key).agg(F.min(s).alias("min"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.sum((s <= most_bad).cast("long")).alias("n_low"), F.sum(s.isNull().cast("long")).alias("n_na"))


def quality_report(df: DataFrame, check_for: tuple[str, ...] = ("spans", "na", "duplicates", "timeline", "rates", "satellites"), order: Order = ORDER, **spans) -> dict[str, DataFrame]:
    """The reports asked for, each lazy."""
    out: dict[str, DataFrame] = {}
    if "spans" in check_for:
        out["spans"] = checks.tag_spans(df, mode="summary", order=order, **spans)
    if "na" in check_for:
        out["na"] = null_report(df, order)
    if "duplicates" in check_for:
        out["duplicates"] = duplicates.detect(df, order=order)
    if "timeline" in check_for:
        out["timeline"] = tag_timeline(df, order=order)
    if "rates" in check_for:
        out["rates"] = rates.rate_tables(df, order=order)["counts"]
    if "satellites" in check_for and "satellites_used" in df.columns:
        out["satellites"] = satellite_report(df, order=order)
    return out


