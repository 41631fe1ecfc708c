"""Central-place trips: what is inside, where trips begin and end, and a row of metrics per trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.functions.crs import Crs
from wayspan.functions.text import fixed
from wayspan.operators import outliers, spatial
from wayspan.operators.schema import ORDER, Order, micros, seconds_between
from wayspan.session import settled

C = F.col


def inside(df: DataFrame, method: str = "rect", lls: tuple[float, ...] | None = None, radius: float = 1000, rings: DataFrame | list | None = None, flag: str | None = None, flag_option: str | None = None, crs: int = 3035) -> DataFrame:
    """Adds Col: 1 inside the central place.

    ``rect``: lls = (lon0, lat0, lon1, lat1), the four corners projected. ``circ``: lls = (lon, lat) and a radius in
    metres on the plane. ``shape``: projected rings, polygons or a polygon table. ``flag``: a 0/1 column. A flag column also refines the other
    methods: ``maximal`` counts a fix in by either, ``minimal`` by both.
    """
    x, y = Crs(crs).project(C("longitude"), C("latitude"))
    columns = df.columns
    if method == "rect":
        test = geo.in_polygon(x, y, [geo.rectangle(*lls, Crs(crs).point)])
    elif method == "circ":
        cx, cy = Crs(crs).point(*lls)
        test = F.hypot(x - cx, y - cy) <= radius
    elif method == "shape":
        df = spatial.within_shape(df.withColumns({"__x": x, "__y": y}), rings, "__x", "__y", "__in")
        test = C("__in")
    else:
        test = C(flag) == 1
    col = F.coalesce(test, F.lit(False)).cast("int")
    if flag and method != "flag" and flag_option:
        f = F.coalesce(C(flag), F.lit(0)).cast("int")
        col = F.greatest(col, f) if flag_option.lower() == "maximal" else F.least(col, f)
    return df.withColumn("Col", col).select(*(c for c in columns if c != "Col"), "Col")


def segment(df: DataFrame, by: str | None = None, bird_year: bool = True, new_after_gap: bool = True, consistent: bool = True, label_no_end: bool = False, label_no_start: bool = False, order: Order = ORDER) -> DataFrame:
    """Adds year, extra_row and tripNo (0 at the colony) to rows with Col and gap.

    A trip takes the colony fixes on both its sides as its ends; a single colony fix between trips is doubled, so that
    it ends one and starts the next (extra_row 1 on the second). Trips that begin before the first or end after the
    last colony fix have no number unless they are asked for.
    """
    keys = [order.key, *([by] if by else []), *(["year"] if bird_year else [])]
    d = df.withColumns({"year": F.year(order.time), "__gap": F.coalesce("gap", F.lit(0))})
    w = W.partitionBy(*keys).orderBy(*order.by)
    out = C("Col") == 0
    near = lambda f: F.coalesce(f("Col").over(w) == 0, F.lit(False))
    twice = (C("Col") == 1) & near(F.lag) & near(F.lead) if consistent else F.lit(False)
    d = d.withColumn("__twice", twice)
    d = d.withColumn("extra_row", F.explode(F.when(C("__twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    w = W.partitionBy(*keys).orderBy(*order.by, "extra_row")
    all_ = W.partitionBy(*keys)
    d = d.withColumn("__n", F.row_number().over(w))
    d = d.withColumns({"__first": F.min(F.when(C("Col") == 1, C("__n"))).over(all_), "__last": F.max(F.when(C("Col") == 1, C("__n"))).over(all_)})
    open_start, open_end = C("__n") < F.coalesce("__first", F.lit(2**30)), C("__n") > F.coalesce("__last", F.lit(0))
    labelled = out & (~open_start | F.lit(label_no_start)) & (~open_end | F.lit(label_no_end))
    d = d.withColumn("__trip", labelled.cast("int"))
    d = d.withColumns({"__next": F.lead("__trip", 1, 0).over(w), "__prev": F.lag("__trip", 1, 0).over(w), "__broken": F.lag("__gap", 1, 0).over(w)})
    # Of a doubled fix the first copy ends a trip and the second starts one.
    starts = (C("__trip") == 0) & (C("__next") == 1) & (C("Col") == 1)
    ends = (C("__trip") == 0) & (C("__prev") == 1) & (C("Col") == 1) & ~starts
    d = d.withColumn("__part", (C("__trip") == 1) | starts | ends)
    begin = starts | ((C("__trip") == 1) & (C("__prev") == 0) & ~F.coalesce(F.lag(starts).over(w), F.lit(False)))
    if new_after_gap:
        begin = begin | (C("__part") & (C("__broken") == 1) & ~starts)
    d = d.withColumn("__begin", (begin & C("__part")).cast("int"))
    d = d.withColumn("__no", F.sum("__begin").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("tripNo", F.when(C("__part"), C("__no")).otherwise(0).cast("long")).select(*df.columns, *(["year"] if "year" not in df.columns else []), "extra_row", "tripNo")


def define_trips(df: DataFrame, method: str = "rect", keep_extra_row: bool = True, order: Order = ORDER, **how) -> DataFrame:
    """``inside`` then ``segment``; doubled fixes are kept as extra rows unless told otherwise."""
    place = {k: how.pop(k) for k in ("lls", "radius", "rings", "flag", "flag_option", "crs") if k in how}
    d = segment(inside(df, method, **place), order=order, **how)
    return d if keep_extra_row else reset_cag(d)


def make_shape(method: str, lls: tuple[float, ...], radius: float = 1000, crs: int = 3035) -> geo.Ring:
    point = Crs(crs).point
    return geo.rectangle(*lls, point) if method == "rect" else geo.circle(*lls, radius, point=point)


def get_cag(df: DataFrame) -> DataFrame:
    """The doubled come-and-go fixes."""
    return df.filter("extra_row = 1")


def reset_cag(df: DataFrame) -> DataFrame:
    return df.filter("extra_row = 0")


def add_cag(df: DataFrame, extra: DataFrame) -> DataFrame:
    return df.unionByName(extra, allowMissingColumns=True)


def trip_stats(df: DataFrame, by: str | None = None, nest: DataFrame | None = None, nest_lls: tuple[float, float] | None = None, rings: list | None = None, phase: str = "br", incompl_meth: str = "all", radius: float = geo.MEAN_EARTH, crs: int = 3035, order: Order = ORDER) -> DataFrame:
    """A row per tag, year (and ``by``) and trip.

    The central place is that of the ``nest`` table (by tag, and year if it has one; the tag's mean, then everyone's,
    where that is missing), a given point, the centroid of a shape's area, or the trip's first fix. Distances are in km,
    TripDur in hours, TotalMon and ActiveMon in days. With columns ``offshore`` or ``dist2coast`` the maxima are given
    on, off and at the coast too.
    """
    keys = [order.key, "year", *([by] if by else []), "tripNo"]
    d = df.filter("tripNo <> 0")
    extra = ["extra_row"] if "extra_row" in df.columns else []
    w = W.partitionBy(*keys).orderBy(*order.by, *extra)
    x, y = Crs(crs).project(C("longitude"), C("latitude"))
    d = d.withColumns({"__x": x, "__y": y})
    d = d.withColumn("__step", F.hypot(F.lead("__x").over(w) - C("__x"), F.lead("__y").over(w) - C("__y")))
    planar = nest_lls is not None or rings is not None
    if nest is not None:
        n = nest.select(C(order.key), *(["year"] if "year" in nest.columns else []), C("longitude").alias("__lon"), C("latitude").alias("__lat"))
        on = [order.key, *(["year"] if "year" in nest.columns else [])]
        d = d.join(n, on, "left")
        mean = nest.groupBy(order.key).agg(F.avg("longitude").alias("__mlon"), F.avg("latitude").alias("__mlat"))
        total = nest.agg(F.avg("longitude").alias("__tlon"), F.avg("latitude").alias("__tlat"))
        d = d.join(mean, order.key, "left").crossJoin(F.broadcast(total))  # one row
        d = d.withColumns({"col_lon": F.coalesce("__lon", "__mlon", "__tlon"), "col_lat": F.coalesce("__lat", "__mlat", "__tlat")})
    elif nest_lls is not None:
        d = d.withColumns({"col_lon": F.lit(float(nest_lls[0])), "col_lat": F.lit(float(nest_lls[1]))})
    elif rings is not None:
        cx, cy = geo.area_centroid(rings)
        lon, lat = Crs(crs).degrees(cx, cy)
        d = d.withColumns({"col_lon": F.lit(lon), "col_lat": F.lit(lat)})
    else:
        d = d.withColumns({"col_lon": F.first("longitude").over(w), "col_lat": F.first("latitude").over(w)})
    if planar:
        px, py = Crs(crs).point(*nest_lls) if nest_lls is not None else (cx, cy)
        d = d.withColumn("__d", F.hypot(C("__x") - px, C("__y") - py) / 1000)
    else:
        d = d.withColumn("__d", geo.haversine(C("longitude"), C("latitude"), C("col_lon"), C("col_lat"), radius) / 1000)
    tie = F.struct(C("__d"), -micros(order.time))
    where = lambda cond, c: F.max(F.when(cond, c))
    aggs = [
        F.min(order.time).alias("Start"), F.max(order.time).alias("End"), F.max("__d").alias("DistMax"), F.count("*").alias("DistN"), (F.sum("__step") / 1000).alias("DistTotal"),
        ((F.max(micros(order.time)) - F.min(micros(order.time))) / F.lit(3.6e9)).alias("TripDur"),
        F.max_by("longitude", tie).alias("max_lon"), F.max_by("latitude", tie).alias("max_lat"), F.first("col_lat").alias("col_lat"), F.first("col_lon").alias("col_lon"),
    ]
    if "offshore" in df.columns:
        off = C("offshore") == 1
        aggs += [where(off, C("__d")).alias("DistMax_off"), where(~off, C("__d")).alias("DistMax_on"), F.max_by("offshore", tie).alias("DistalPointOff")]
    if "dist2coast" in df.columns:
        aggs += [F.max("dist2coast").alias("DistCoastMax")]
        if "offshore" in df.columns:
            aggs += [where(off, C("dist2coast")).alias("DistCoastMax_off"), where(~off, C("dist2coast")).alias("DistCoastMax_on")]
    broken = F.max((C("gap") == 1).cast("int")) if incompl_meth == "all" else F.max((C("gapsec") > 1).cast("int"))
    aggs.append((F.lit(None).cast("int") if phase == "wi" else broken).alias("incompl"))
    g = d.groupBy(*keys).agg(*aggs)
    g = g.withColumn("MaxBear", geo.bearing_degrees(C("max_lon") - C("col_lon"), C("max_lat") - C("col_lat")))
    every = [order.key, *([by] if by else [])]
    span = (F.max(micros(order.time)) - F.min(micros(order.time))) / F.lit(8.64e10)
    mon = df.groupBy(*every).agg(span.alias("TotalMon"), (F.coalesce(F.sum(F.when(C("gap") == 1, C("dt"))), F.lit(0.0)) / 86400).alias("__lost"))
    return g.join(mon.select(*every, "TotalMon", (C("TotalMon") - C("__lost")).alias("ActiveMon")), every)


def _means(c: Column, digits: int) -> Column:
    f = lambda v: fixed(v, digits)
    return F.when(F.count(c) > 0, F.concat(f(F.avg(c)), F.lit("±"), F.coalesce(f(F.stddev(c)), F.lit("NA")), F.lit(" ("), f(F.max(c)), F.lit(")")))


def _box(low: Column, mid: Column, high: Column, top: Column, digits: int) -> Column:
    f = lambda v: fixed(v, digits)
    return F.when(mid.isNotNull(), F.concat(f(mid), F.lit(" ("), f(low), F.lit(","), f(high), F.lit(") ["), f(top), F.lit("]")))


def tabulate_trips(trips: DataFrame, by: str | None = None, digits: int = 2, unit: str = "days", drop_incomplete: bool = True, option: str = "means", order: Order = ORDER) -> DataFrame:
    """Complete and incomplete trips and their distances and durations: per tag (and ``by``), per ``by``, and for all.

    Rows over all tags have the tag "all"; those over all levels have the level "all". ``means`` gives mean, deviation and
    greatest value; any other option the median, quartiles and greatest value. Quartiles are order statistics: by rank
    within a tag's levels (sorted windows, which spill), and for the rows over all tags by ``outliers.level_quantiles``, so
    that no task ranks a whole level.
    """
    hours = {"hours": 1, "days": 24, "mins": 1 / 60}[unit]
    t = trips.withColumn("__tag", C(order.key).cast("string")).withColumn("__by", (C(by).cast("string") if by else F.lit("all")))
    whole = C("incompl").isNull() | (C("incompl") == 0)
    use = lambda c: F.when(whole, c) if drop_incomplete else c
    measures = {"DistMax": C("DistMax"), "DistTotal": C("DistTotal"), "TripDur": C("TripDur") / hours}
    measures |= {c: C(c) for c in ("DistMax_off", "DistMax_on", "DistCoastMax", "DistCoastMax_off", "DistCoastMax_on") if c in trips.columns}
    t = t.select("__tag", "__by", whole.alias("__whole"), *(use(c).cast("double").alias(n) for n, c in measures.items()))
    counts = [F.sum(C("__whole").cast("long")).alias("complete"), F.sum((~C("__whole")).cast("long")).alias("incomplete")]
    keys = [C("__g.tag").alias(order.key), C("__g.by").alias(by or "by")]
    # One row per trip and grouping set.
    sets = [("__tag", "__by"), ("all", "__by"), ("all", "all")] if by else [("__tag", "all"), ("all", "all")]
    cell = lambda v: F.lit("all") if v == "all" else C(v)
    grouped = lambda s: t.withColumn("__g", F.explode(F.array(*[F.struct(cell(a).alias("tag"), cell(b).alias("by")) for a, b in s])))
    if option == "means":
        out = grouped(sets).groupBy(*keys).agg(*counts, *[_means(C(n), digits).alias(n) for n in measures])
    else:
        t, w = settled(t), W.partitionBy("__tag", "__by")  # read several times: trips are worked out once
        d = t
        for n in measures:
            d = d.withColumns({f"__n_{n}": F.count(n).over(w), f"__r_{n}": F.row_number().over(w.orderBy(F.asc_nulls_last(n)))})
        box = lambda n: _box(*(outliers.quantile(q, n, f"__r_{n}", f"__n_{n}") for q in (0.25, 0.5, 0.75)), F.max(n), digits)
        out = d.groupBy(C("__tag").alias(order.key), C("__by").alias(by or "by")).agg(*counts, *[box(n).alias(n) for n in measures])
        # Rows over all tags: those of each level, and the one over everything.
        level = lambda every, v: F.struct(F.lit(every).alias("every"), v.alias("by"))
        t = t.withColumn("__g", F.array(*([level(False, C("__by"))] if by else []), level(True, F.lit("all"))))
        q = outliers.level_quantiles(t, "__g", list(measures), [0.25, 0.5, 0.75])
        tops = t.withColumn("__g", F.explode("__g")).groupBy("__g").agg(*counts, *[F.max(n).alias(f"__top_{n}") for n in measures])
        all_ = tops.join(q, "__g", "left")
        out = out.unionByName(all_.select(F.lit("all").alias(order.key), C("__g.by").alias(by or "by"), "complete", "incomplete", *[_box(C(n)[0], C(n)[1], C(n)[2], C(f"__top_{n}"), digits).alias(n) for n in measures]))
    return out if by else out.drop("by")


def step_seconds(order: Order = ORDER) -> Column:
    return seconds_between(F.lead(order.time).over(order.window()), C(order.time))
