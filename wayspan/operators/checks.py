"""Error checks: each adds a flag of 1 (suspect), 0 or null, or drops what it would flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.operators.schema import ORDER, Order

Bound = float | str | Callable[[Column], Column] | None
C = F.col


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(C(flag).isNull() | (C(flag) != 1)).drop(flag)


def highest(flags: Sequence[str]) -> Column:
    """1 if any is 1, else 0 if any is 0, else null."""
    cols = [C(f) for f in flags]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def bound_flag(df: DataFrame, name: str, lower: Bound, upper: Bound, inclusive: bool = True) -> Column:
    """1 outside the bounds (on them too if inclusive); text equals its one bound; a function of the column gives the test
    itself (one of numpy arrays by ``functions.user.over_values``)."""
    x = C(name)
    calls = [b for b in (lower, upper) if callable(b)]
    if calls:
        test = reduce(lambda a, b: a | b, [f(x) for f in calls])
    elif df.schema[name].dataType.typeName() == "string":
        given = [b for b in (lower, upper) if b is not None]
        if len(given) != 1:
            raise ValueError(f"{name}: text takes exactly one bound")
        test = x == F.lit(given[0])
    else:
        below = (lambda b: x <= b) if inclusive else (lambda b: x < b)
        above = (lambda b: x >= b) if inclusive else (lambda b: x > b)
        tests = [f(b) for f, b in ((below, lower), (above, upper)) if b is not None]
        if not tests:
            raise ValueError(f"{name}: no bound given")
        test = reduce(lambda a, b: a | b, tests)
    return F.when(x.isNull(), None).otherwise(test.cast("int"))


def filt_err(df: DataFrame, names: Sequence[str], lower: Sequence[Bound], upper: Sequence[Bound], annotate: bool = True, inclusive: bool = True, all_flag: bool = True) -> DataFrame:
    """Adds ``<name>_rm`` for each column and all_rm; drops only with ``annotate=False`` and ``all_flag=True``."""
    flags = {f"{n}_rm": bound_flag(df, n, a, b, inclusive) for n, a, b in zip(names, lower, upper, strict=True)}
    d = df.withColumns(flags)
    if not all_flag:
        return d
    d = d.withColumn("all_rm", highest(list(flags)))
    return d if annotate else drop_flagged(d, "all_rm").drop(*flags)


def null_position(df: DataFrame, flag: str = "NA_latlong_rm") -> DataFrame:
    return df.withColumn(flag, (C("longitude").isNull() | C("latitude").isNull()).cast("int"))


def all_null(df: DataFrame, columns: Sequence[str], flag: str = "all_NA_rm") -> DataFrame:
    return df.withColumn(flag, reduce(lambda a, b: a & b, [C(c).isNull() for c in columns]).cast("int"))


def few_fixes(df: DataFrame, least: int, flag: str = "tid_rm", order: Order = ORDER) -> DataFrame:
    return df.withColumn(flag, (F.count("*").over(order.whole()) < least).cast("int"))


def satellites(df: DataFrame, most_bad: int = 3, column: str = "satellites_used") -> DataFrame:
    """sat_rm for too few satellites (null stays null) and sat_NA for unknown ones."""
    return df.withColumns({"sat_rm": (C(column) <= most_bad).cast("int"), "sat_NA": C(column).isNull().cast("int")})


def flight_switch(df: DataFrame, kind: str = "MoveBank") -> DataFrame:
    """Null or non-zero switches become -99, which is flagged for rows of ``kind``."""
    d = df.withColumn("flt_switch", F.when(C("flt_switch").isNull() | (C("flt_switch") != 0), -99).otherwise(C("flt_switch")))
    return d.withColumn("flt_rm", F.coalesce((C("Type") == kind) & (C("flt_switch") == -99), F.lit(False)).cast("int"))


def precision(df: DataFrame, column: str, limit: float = 7) -> DataFrame:
    return df.withColumn(f"{column}_rm", (C(column) >= limit).cast("int"))


def single_sections(df: DataFrame, flag: str = "singlegap_rm", order: Order = ORDER) -> DataFrame:
    """Flags sections of one fix; sections are runs of a tag's fixes in order, so the fixes beside it tell."""
    other = lambda f: ~f("gapsec").over(order.window()).eqNullSafe(C("gapsec"))
    edge = lambda f: f(F.lit(1)).over(order.window()).isNull() | other(f)
    return df.withColumn(flag, (edge(F.lag) & edge(F.lead)).cast("int"))


def time_window(df: DataFrame, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    t = C(order.time).cast("timestamp")
    if start:
        df = df.filter(t >= F.lit(start).cast("timestamp"))
    return df.filter(t <= F.lit(end).cast("timestamp")) if end else df


def time_windows(df: DataFrame, bounds: DataFrame, order: Order = ORDER) -> DataFrame:
    """Per-tag bounds (key, start, end; null is open); tags without a row are left out."""
    b = bounds.select(C(order.key), C("start").alias("__a"), C("end").alias("__b"))
    t = C(order.time)
    return df.join(b, order.key).filter((C("__a").isNull() | (t >= C("__a"))) & (C("__b").isNull() | (t <= C("__b")))).drop("__a", "__b")


def tag_spans(df: DataFrame, xra: tuple[float, float] | None = None, yra: tuple[float, float] | None = None, dates: tuple[str, str] | None = None, buffer_days: float = 2, now: str | None = None, mode: str = "annotate", order: Order = ORDER) -> DataFrame:
    """Positions outside xra and yra, times after ``now``, and times outside dates widened by ``buffer_days`` days.

    ``annotate`` flags; ``resolve`` drops flagged rows and keeps nulls; ``summary`` lists offending values per tag.
    """
    t = C(order.time).cast("timestamp")
    flags: dict[str, Column] = {}
    if xra:
        flags |= {"minx_issue": C("longitude") < xra[0], "maxx_issue": C("longitude") > xra[1]}
    if yra:
        flags |= {"miny_issue": C("latitude") < yra[0], "maxy_issue": C("latitude") > yra[1]}
    flags["future_issue"] = t > (F.lit(now).cast("timestamp") if now else F.current_timestamp())
    if dates:
        buffer = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(buffer_days * 86400).cast("decimal(18,6)"))
        flags["temporal_issue"] = (t < F.lit(dates[0]).cast("timestamp") - buffer) | (t > F.lit(dates[1]).cast("timestamp") + buffer)
    d = df.withColumns({k: v.cast("int") for k, v in flags.items()})
    if mode == "annotate":
        return d
    if mode == "resolve":
        return d.withColumn("__f", highest(list(flags))).filter("__f is null or __f = 0").drop("__f", *flags)
    value = {"minx_issue": "longitude", "maxx_issue": "longitude", "miny_issue": "latitude", "maxy_issue": "latitude"}
    return d.groupBy(order.key).agg(*[F.sort_array(F.collect_set(F.when(C(k) == 1, C(value.get(k, order.time))))).alias(k) for k in flags])


def combined(df: DataFrame, flags: Sequence[str], name: str = "combined_rm") -> DataFrame:
    return df.withColumn(name, highest(flags))


def stage_counts(df: DataFrame, flags: Sequence[str], order: Order = ORDER) -> DataFrame:
    """Per tag: all rows, and rows left after each flag in turn; one pass."""
    kept, aggs = F.lit(True), [F.count("*").alias("raw")]
    for f in flags:
        kept = kept & (C(f).isNull() | (C(f) != 1))
        aggs.append(F.sum(kept.cast("long")).alias(f"after_{f.removesuffix('_rm')}"))
    return df.groupBy(order.key).agg(*aggs)


def day_fixes(df: DataFrame, least: int, strict: bool = True, flag: str = "day_rm", order: Order = ORDER) -> DataFrame:
    """Strict: flag a tag with any day of too few fixes; granular: flag those days."""
    d = df.withColumn("__n", F.count("*").over(order.whole("__day"))) if "__day" in df.columns else df.withColumn("__day", F.to_date(order.time)).withColumn("__n", F.count("*").over(order.whole("__day")))
    few = F.min("__n").over(order.whole()) < least if strict else C("__n") < least
    return d.withColumn(flag, few.cast("int")).drop("__n", "__day")


def geofence(df: DataFrame, xra: tuple[float, float], yra: tuple[float, float], flag: str = "ll_rm") -> DataFrame:
    """0 strictly inside the box, else 1."""
    x, y = C("longitude"), C("latitude")
    return df.withColumn(flag, F.when((x > xra[0]) & (x < xra[1]) & (y > yra[0]) & (y < yra[1]), 0).otherwise(1))


def speed_flag(df: DataFrame, limit: float, flag: str = "speed_rm") -> DataFrame:
    """Raw speeds at or over the limit, without iteration."""
    return df.withColumn(flag, (C("traj_speed") >= limit).cast("int"))


def flag_summary(df: DataFrame, flags: Sequence[str], order: Order = ORDER) -> DataFrame:
    """Per tag and flag: rows flagged, null, all, and percent flagged."""
    long = df.select(order.key, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), C(f).cast("int").alias("v")) for f in flags])).alias("x"))
    g = long.groupBy(order.key, C("x.flag").alias("flag")).agg(F.sum((C("x.v") == 1).cast("long")).alias("n_flagged"), F.sum(C("x.v").isNull().cast("long")).alias("n_na"), F.count("*").alias("total"))
    return g.withColumns({"n_flagged": F.coalesce("n_flagged", F.lit(0)), "pct": 100 * F.coalesce("n_flagged", F.lit(0)) / C("total")})


def transformed(df: DataFrame, column: str, how: str = "log10", truncate: float | None = None) -> DataFrame:
    """Positive values of a column, on a log10, log or sqrt scale, optionally cut at ``truncate``."""
    d = df.filter(C(column).isNotNull() & (C(column) > 0))
    if truncate is not None:
        d = d.filter(C(column) <= truncate)
    f = {"log10": F.log10, "log": F.log, "sqrt": F.sqrt}[how]
    return d.withColumn(f"{column}_t", f(column))
