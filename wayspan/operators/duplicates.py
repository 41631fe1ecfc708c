"""Duplicate fixes: parallel streams, conflicting positions or times, exact repeats and whole-row repeats."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.functions.user import aggregate
from wayspan.operators.schema import ORDER, Order, micros

C = F.col


def quality(variables: Sequence[str], directions: Sequence[int]) -> Column:
    """Sum of variables times direction (1: higher is better), nulls skipped."""
    return sum((F.coalesce(C(v).cast("double") * s, F.lit(0.0)) for v, s in zip(variables, directions, strict=True)), F.lit(0.0))


def _ranking(method: str, order: Order, variables: Sequence[str], directions: Sequence[int], seed: int) -> list[Column]:
    tie = [C(c) for c in order.by]
    if method == "first":
        return tie
    if method == "last":
        return [c.desc() for c in tie]
    if method == "best_quality":
        return [quality(variables, directions).desc(), *tie]
    if method == "random":  # by hash, so that a rerun picks the same rows
        return [F.xxhash64(C(order.key).cast("string"), *[c.cast("string") for c in tie], F.lit(seed)), *tie]
    raise ValueError(f"unknown method {method}")


def mark(df: DataFrame, use_coords: bool = False, order: Order = ORDER) -> DataFrame:
    """Flags 0/1: dup_time_rm (one time, several places), dup_coords_rm (one place, several times; with
    ``use_coords``), dup_time_coords_rm (same time and place), all_dup_rm (whole row)."""
    at = order.whole(order.time)
    rest = [c for c in df.columns if c not in (order.key, order.time, "longitude", "latitude", order.seq)]
    equal = lambda *more: at.orderBy("longitude", "latitude", *more).rangeBetween(W.currentRow, W.currentRow)
    # Rows equal in what orders a window are a frame of it. The longest order comes first: its one sort serves the others too.
    d = df.withColumn("__row", F.count("*").over(equal(*rest)))
    d = d.withColumns({"__here": F.count("*").over(equal()), "__place": F.dense_rank().over(at.orderBy("longitude", "latitude"))})
    d = d.withColumn("dup_time_rm", (F.max("__place").over(at) > 1).cast("int"))
    if use_coords:
        here = order.whole("longitude", "latitude")
        known = C("longitude").isNotNull() & C("latitude").isNotNull()
        d = d.withColumn("dup_coords_rm", (known & F.coalesce(F.min(order.time).over(here) != F.max(order.time).over(here), F.lit(False))).cast("int"))
    return d.withColumns({"dup_time_coords_rm": (C("__here") > 1).cast("int"), "all_dup_rm": (C("__row") > 1).cast("int")}).drop("__row", "__here", "__place")


def resolve_exact(df: DataFrame, method: str = "first", variables: Sequence[str] = (), directions: Sequence[int] = (), seed: int = 1, order: Order = ORDER) -> DataFrame:
    """One row per tag, time and place."""
    w = order.whole(order.time, "longitude", "latitude").orderBy(*_ranking(method, order, variables, directions, seed))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def _centroid(df: DataFrame, keys: list[str], center: dict[str, Callable[[Column], Column]], order: Order) -> DataFrame:
    """Rows of a key become one: chosen columns by an aggregate, the rest from the first row."""
    rest = [c for c in df.columns if c not in keys and c not in center]
    first = F.min_by(F.struct(*rest), F.struct(*order.by)).alias("__f")
    g = df.groupBy(*keys).agg(first, *[aggregate(f)(C(c)).alias(c) for c, f in center.items()])
    return g.select(*[C(f"__f.{c}").alias(c) if c in rest else C(c) for c in df.columns])


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def resolve_same_time(df: DataFrame, method: str = "first", variables: Sequence[str] = (), directions: Sequence[int] = (), centroid: Callable[[Column], Column] = median, seed: int = 1, order: Order = ORDER) -> DataFrame:
    """One row per tag and time; ``centroid`` puts it at the centre of its places."""
    if method == "centroid":
        return _centroid(df, [order.key, order.time], {"longitude": centroid, "latitude": centroid}, order)
    w = order.whole(order.time).orderBy(*_ranking(method, order, variables, directions, seed))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def resolve_same_place(df: DataFrame, method: str = "first", variables: Sequence[str] = (), directions: Sequence[int] = (), seed: int = 1, order: Order = ORDER, time_fun: Callable[[Column], Column] = F.avg) -> DataFrame:
    """One row per tag and place; ``avg_time`` gives it the mean time, or another aggregate of the times in
    microseconds (``time_fun``). Rows without a place stay."""
    known, open_ = df.filter("longitude is not null and latitude is not null"), df.filter("longitude is null or latitude is null")
    if method == "avg_time":
        kind = df.schema[order.time].dataType
        mean = lambda c: F.timestamp_micros(F.floor(aggregate(time_fun)(micros(c))).cast("long")).cast(kind)
        done = _centroid(known, [order.key, "longitude", "latitude"], {order.time: mean}, order)
    else:
        w = order.whole("longitude", "latitude").orderBy(*_ranking(method, order, variables, directions, seed))
        done = known.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return done.unionByName(open_)


def resolve_rows(df: DataFrame, order: Order = ORDER) -> DataFrame:
    """Whole-row repeats, the ingest sequence aside."""
    return df.dropDuplicates([c for c in df.columns if c != order.seq])


def parallel_streams(df: DataFrame, order: Order = ORDER) -> DataFrame:
    """Adds brksec, parallel_issue and overlap_block.

    In ingest order (``order.seq``) a step back in time starts a segment; rows of a tag's segments that lie in a window
    where two of them overlap are marked, and runs of marked rows in time are numbered as blocks.
    """
    if not order.seq:
        raise ValueError("parallel streams need an ingest sequence column")
    ingest = W.partitionBy(order.key).orderBy(order.seq)
    back = F.coalesce((C(order.time) < F.lag(order.time).over(ingest)).cast("int"), F.lit(0))
    d = df.withColumn("__back", back).withColumn("brksec", (1 + F.sum("__back").over(ingest.rowsBetween(W.unboundedPreceding, 0))).cast("long")).drop("__back")
    # A time that two or more segments cover lies in an overlap: of the segments begun by then more than one hasn't ended
    # before. Each segment's first and last row stand for it, so the sweep is a sum over the tag's own rows.
    seg = W.partitionBy(order.key, "brksec").orderBy(F.asc_nulls_last(order.time), order.seq)
    known = C(order.time).isNotNull()
    d = d.withColumns({"__open": F.row_number().over(seg), "__shut": F.count(order.time).over(seg.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    d = d.withColumns({"__shut": (known & (C("__open") == C("__shut"))).cast("int"), "__open": (known & (C("__open") == 1)).cast("int")})
    # One sort by time serves the windows of the sweep and of the blocks.
    d = d.sortWithinPartitions(order.key, order.time, order.seq)
    line = W.partitionBy(order.key).orderBy(order.time).rangeBetween(W.unboundedPreceding, 0)
    ended = F.sum("__shut").over(line) - F.sum("__shut").over(order.whole(order.time))  # before this time
    d = d.withColumn("parallel_issue", (known & (F.sum("__open").over(line) - ended > 1)).cast("int"))
    timed = W.partitionBy(order.key).orderBy(order.time, order.seq)
    start = ((C("parallel_issue") == 1) & (F.coalesce(F.lag("parallel_issue").over(timed), F.lit(0)) == 0)).cast("int")
    d = d.withColumn("__start", start).withColumn("__b", F.sum("__start").over(timed.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("overlap_block", F.when(C("parallel_issue") == 1, C("__b"))).select(*df.columns, "brksec", "parallel_issue", "overlap_block")


def resolve_parallel(df: DataFrame, method: str = "first", variables: Sequence[str] = (), directions: Sequence[int] = (), seed: int = 1, order: Order = ORDER, quality_fun: Callable[[Column], Column] = F.avg) -> DataFrame:
    """One segment per overlap block stays (``merge`` keeps all rows); rows outside blocks stay. A segment's quality is
    an aggregate of its rows' (``quality_fun``)."""
    d = parallel_streams(df, order)
    if method == "merge":
        return d.drop("brksec", "parallel_issue", "overlap_block")
    q = aggregate(quality_fun)(quality(variables, directions)) if variables else F.lit(0.0)
    seg = d.filter("overlap_block is not null").groupBy(order.key, "overlap_block", "brksec").agg(q.alias("q"))
    rank = {"first": [C("brksec")], "last": [C("brksec").desc()], "best_quality": [C("q").desc(), C("brksec")], "random": [F.xxhash64(C(order.key).cast("string"), "overlap_block", "brksec", F.lit(seed))]}[method]
    best = seg.withColumn("__r", F.row_number().over(W.partitionBy(order.key, "overlap_block").orderBy(*rank))).filter("__r = 1").select(order.key, "overlap_block", C("brksec").alias("__best"))
    j = d.join(best, [order.key, "overlap_block"], "left").filter("overlap_block is null or brksec = __best")
    return j.select(df.columns)


def duplicate_track(
    df: DataFrame, method: str = "first", variables: Sequence[str] = (), directions: Sequence[int] = (), use_coords: bool = False, mode: str = "resolve", methods: dict[str, str] | None = None, seed: int = 1, order: Order = ORDER,
    quality_fun: Callable[[Column], Column] = F.avg, centroid_fun: Callable[[Column], Column] = median, time_fun: Callable[[Column], Column] = F.avg,
) -> DataFrame:
    """All steps in turn. ``mode``: resolve, annotate (flags), or detect (report). ``methods`` overrides per step:
    parallel, same_time, same_loc, exact. The three functions are aggregates of columns, or numpy's (see
    ``functions.user`` for one's own): of a parallel segment's quality, of coordinates at one time, and of times at one
    place."""
    of = lambda step: (methods or {}).get(step, method)
    if mode == "detect":
        return detect(df, use_coords, order)
    if mode == "annotate":
        d = mark(df, use_coords, order)
        if order.seq:
            # Sorted here, so that no window in ingest order is moved before those of ``mark``, which would sort twice.
            d = parallel_streams(d.sortWithinPartitions(order.key, order.seq), order).withColumnRenamed("parallel_issue", "dup_parallel_rm").drop("brksec", "overlap_block")
        return d
    how = {"variables": variables, "directions": directions, "seed": seed, "order": order}
    d = resolve_parallel(df, of("parallel"), **how, quality_fun=quality_fun) if order.seq else df
    d = resolve_exact(d, "first" if of("exact") in ("centroid", "avg_time") else of("exact"), **how)
    d = resolve_same_time(d, of("same_time"), **how, centroid=centroid_fun)
    if use_coords:
        d = resolve_same_place(d, of("same_loc"), **how, time_fun=time_fun)
    return resolve_rows(d, order)


def affected_rows(df: DataFrame, use_coords: bool = False, order: Order = ORDER) -> DataFrame:
    """The rows behind ``detect``'s counts, with the step that each is affected by: a row per step and not a list per tag."""
    d, steps = _marked(df, use_coords, order)
    x = F.explode(F.filter(F.array(*[F.when(C(f) == 1, F.lit(s)) for s, f in steps.items()]), lambda s: s.isNotNull()))
    return d.select(*df.columns, x.alias("step"))


def _marked(df: DataFrame, use_coords: bool, order: Order) -> tuple[DataFrame, dict[str, str]]:
    d = mark(df, use_coords, order)
    steps = {"same_time": "dup_time_rm", "exact": "dup_time_coords_rm", "full_row": "all_dup_rm"} | ({"same_loc": "dup_coords_rm"} if use_coords else {})
    if order.seq:
        d = parallel_streams(d, order)
        steps["parallel"] = "parallel_issue"
    return d, steps


def detect(df: DataFrame, use_coords: bool = False, order: Order = ORDER) -> DataFrame:
    """Per tag and step: issue_detected, n_affected_rows and n_segments (of parallel streams)."""
    d, steps = _marked(df, use_coords, order)
    segments = F.lit(None).cast("long")
    long = d.select(order.key, F.explode(F.array(*[F.struct(F.lit(s).alias("step"), C(f).alias("f"), (C("brksec") if s == "parallel" else segments).alias("seg")) for s, f in steps.items()])).alias("x"))
    g = long.groupBy(order.key, C("x.step").alias("step")).agg(F.sum("x.f").alias("n_affected_rows"), F.countDistinct(F.when(C("x.f") == 1, C("x.seg"))).alias("n_segments"))
    return g.select(order.key, "step", (C("n_affected_rows") > 0).alias("issue_detected"), "n_affected_rows", "n_segments")


def is_duplicated(df: DataFrame, step: str | None = None, order: Order = ORDER) -> DataFrame:
    """Whether any tag has an issue, per step."""
    d = detect(df, True, order)
    d = d.filter(C("step") == step) if step else d
    return d.groupBy("step").agg(F.max("issue_detected").alias("issue_detected"))
