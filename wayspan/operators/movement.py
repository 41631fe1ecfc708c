"""Gap sections, step speeds, smoothers, the greedy speed filter and turning angles.

Every operator is one partitioning by tag; values within a gap section compare section ids instead of partitioning
anew. Nulls in coordinates or times give null distances and speeds, and such rows are never flagged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayspan.functions.geo import EARTH, haversine
from wayspan.operators.schema import ORDER, Order, micros, seconds_between
from wayspan.session import ship

C = F.col


def gap_section(df: DataFrame, gap: float = 28800, tol: float = 0.2, drop_single: bool = False, order: Order = ORDER) -> DataFrame:
    """Adds dt (seconds to the next fix), gap (1 at the last fix of a section) and gapsec (1, 2, ... per tag).

    A section ends where dt exceeds ``gap * (1 + tol)``, and at the tag's end; a tag's first fix has gap 0 unless it is
    the last of a longer section. ``drop_single`` removes sections of one fix and works dt out again.
    """
    w, limit = order.window(), gap * (1 + tol)
    d = df.withColumn("dt", seconds_between(F.lead(order.time).over(w), C(order.time)))
    ends = F.coalesce((C("dt") > limit).cast("int"), F.lit(1))
    d = d.withColumn("gap", ends)
    d = d.withColumn("gapsec", (1 + F.coalesce(F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    d = d.withColumn("gap", F.when(F.lag(order.time).over(w).isNull() & F.lead(order.time).over(w).isNotNull(), 0).otherwise(C("gap")))
    if drop_single:
        d = d.withColumn("__n", F.count("*").over(order.whole("gapsec"))).filter("__n > 1").drop("__n")
        d = d.withColumn("dt", seconds_between(F.lead(order.time).over(w), C(order.time)))
    return d


def time_steps(df: DataFrame, order: Order = ORDER) -> DataFrame:
    """dt to the next fix of the tag."""
    return df.withColumn("dt", seconds_between(F.lead(order.time).over(order.window()), C(order.time)))


def _same_section(within: bool, other: Column) -> Column:
    return other == C("gapsec") if within else F.lit(True)


def traj_speed(df: DataFrame, within_gap: bool = False, order: Order = ORDER, radius: float = EARTH) -> DataFrame:
    """Adds dist (metres to the next fix), dt, and traj_speed (m/s into the row; null on the first)."""
    w = order.window()
    d = df.withColumns({f"__{c}": F.lead(c).over(w) for c in ("longitude", "latitude")} | {"__t": F.lead(order.time).over(w)})
    if within_gap:
        d = d.withColumn("__s", F.lead("gapsec").over(w))
    same = _same_section(within_gap, C("__s")) if within_gap else F.lit(True)
    d = d.withColumn("dist", F.when(same, haversine(C("longitude"), C("latitude"), C("__longitude"), C("__latitude"), radius)))
    d = d.withColumn("dt", F.when(same, seconds_between(C("__t"), C(order.time))))
    d = d.withColumn("__v", C("dist") / F.nullif(C("dt"), F.lit(0.0)))
    speed = F.lag("__v").over(w)
    if within_gap:
        speed = F.when(F.lag("gapsec").over(w) == C("gapsec"), speed)
    return d.withColumn("traj_speed", speed).drop("__longitude", "__latitude", "__t", "__s", "__v")


def traj_speed_sm(df: DataFrame, within_gap: bool = False, points: int = 2, include_centre: bool = False, method: str = "mcconnell", fun: Callable | None = None, order: Order = ORDER) -> DataFrame:
    """Adds traj_speed_sm, a smoothed speed.

    ``mcconnell``: root mean square of the two speeds before and after, null unless all five are there. ``flexi_clip``:
    root mean square over a centred frame of ``points`` each side, null where it is cut off. ``flexi_vec``: the like,
    over what there is. ``fun``: a function of (index, speeds) as numpy arrays, a section at a time.
    """
    d = traj_speed(df, within_gap, order)
    keys = ("gapsec",) if within_gap else ()
    w = order.window(*keys)
    v2 = C("traj_speed") * C("traj_speed")
    if fun is not None:
        schema = T.StructType([*d.schema, T.StructField("traj_speed_sm", T.DoubleType())])

        def smooth(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(order.by)
            return b.assign(traj_speed_sm=np.asarray(fun(np.arange(1, len(b) + 1), b["traj_speed"].to_numpy()), float))

        ship(df.sparkSession)
        return d.groupBy(order.key, *keys).applyInPandas(smooth, schema)
    if method == "mcconnell":
        whole = F.count("traj_speed").over(w.rowsBetween(-2, 2)) == 5
        total = sum((F.pow(f("traj_speed", k).over(w), 2) for f in (F.lag, F.lead) for k in (1, 2)), F.lit(0.0))
        return d.withColumn("traj_speed_sm", F.when(whole, F.sqrt(total / 4)))
    frame = w.rowsBetween(-points, points)
    n, total = F.count("traj_speed").over(frame), F.sum(v2).over(frame)
    if not include_centre:
        n, total = n - C("traj_speed").isNotNull().cast("int"), total - F.coalesce(v2, F.lit(0.0))
    enough = n == 2 * points + int(include_centre) if method == "flexi_clip" else n > 0
    return d.withColumn("traj_speed_sm", F.when(enough, F.sqrt(F.greatest(total, F.lit(0.0)) / F.nullif(n, F.lit(0)))))


def _raw_filter(df: DataFrame, limit: float, order: Order, keys: list[str]) -> DataFrame:
    """speed_rm by one forward pass: a fix stays if its speed from the last kept one is within the limit.

    Removing one fix changes only the next one's speed, so repeating "remove the first offender, work out speeds anew"
    ends where this single pass does. The first round alone prefers a fix that both its speeds exceed by 20. A speed at
    the limit counts as an offence as long as some later speed of the section exceeds it; where none does at all, the
    first round still removes the first such fix.

    Windows give each fix its speed from the one before and the section's last offence; the pass reads each partition's
    sorted rows as a stream of Arrow batches and keeps the last kept fix only, however long a section is.
    """
    more = [k for k in keys if k != order.key]
    w = order.window(*more)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in order, so that one sort serves all
    running = w.rowsBetween(W.unboundedPreceding, 0)
    placed = C("longitude").isNotNull() & C("latitude").isNotNull() & C(order.time).isNotNull()
    fast = traj_speed(df, "gapsec" in keys, order).select(*df.columns, "traj_speed")
    leaving = F.lead("traj_speed").over(w)
    over = F.coalesce(F.max("traj_speed").over(whole) > limit, F.lit(False))
    both = over & F.coalesce((C("traj_speed") > limit + 20) & (leaving > limit + 20), F.lit(False))
    d = fast.withColumn("__both", both.cast("int"))
    d = d.withColumns({"__first": (C("__both") == 1) & (F.sum("__both").over(running) == 1), "__id": F.row_number().over(w)}).drop("traj_speed")
    d = d.withColumn("__use", placed & ~C("__first")).drop("__both")
    fix = F.struct(micros(order.time).alias("us"), C("longitude").cast("double").alias("lon"), C("latitude").cast("double").alias("lat"))
    d = d.withColumns({"__fix": fix, "__prev": F.last(F.when(C("__use"), fix), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))})
    seconds = (C("__fix.us") - C("__prev.us")) / F.lit(1e6)
    speed = haversine(C("__prev.lon"), C("__prev.lat"), C("__fix.lon"), C("__fix.lat")) / F.nullif(seconds, F.lit(0.0))
    d = d.withColumn("__v", F.when(C("__use"), speed)).drop("__prev")
    offence = F.max(F.when(C("__v") > limit, C("__id"))).over(whole)
    alone = offence.isNull() & ~F.max("__first").over(whole)
    d = d.withColumns({"__last": F.coalesce(offence, F.lit(0)), "__alone": alone}).sortWithinPartitions(*keys, *order.by)
    schema = T.StructType([*df.schema, T.StructField("speed_rm", T.IntegerType())])
    names = list(df.columns)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _Pass(limit)
        for b in batches:
            flags = keep.batch(b)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(flags, pa.int32())], names=[*names, "speed_rm"])

    ship(df.sparkSession)
    return d.mapInArrow(passed, schema)


class _Pass:
    """The state of the forward pass: the last kept fix, and whether the fix before is that one."""

    def __init__(self, limit: float):
        self.limit, self.section, self.at = limit, 0, 0
        self.last, self.near, self.tie = (0.0, 0.0, 0.0), True, False

    def batch(self, b: pa.RecordBatch) -> np.ndarray:
        get = lambda n: b.column(n).to_numpy(zero_copy_only=False)
        fix = b.column("__fix")
        us, lon, lat = (fix.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
        number, v, offence, alone = get("__id"), get("__v").astype(float), get("__last"), get("__alone")
        out = get("__first").astype(np.int32)
        # Sections are numbered on from those of the batches before.
        section = self.section + np.cumsum(number == 1)
        self.section = int(section[-1]) if len(section) else self.section
        rows = np.flatnonzero(get("__use").astype(bool))
        if not len(rows):
            return out
        starts = np.r_[section[rows[0]] != self.at, section[rows[1:]] != section[rows[:-1]]]
        with np.errstate(invalid="ignore"):
            look = np.flatnonzero(starts | (v[rows] >= self.limit))  # others stay if the fix before them does
        i = 0
        while i < len(rows):
            r = rows[i]
            if self.near and not starts[i]:
                k = int(np.searchsorted(look, i))
                if k == len(look):
                    break
                if look[k] > i:
                    r = rows[look[k] - 1]
                    self.last = (us[r], lon[r], lat[r])
                i, r = int(look[k]), rows[look[k]]
            if starts[i]:
                self.last, self.near, self.tie = (us[r], lon[r], lat[r]), True, bool(alone[r])
                i += 1
                continue
            if self.near:
                speed = v[r]
            else:
                dt = (us[r] - self.last[0]) / 1e6
                speed = _metres(*self.last[1:], lon[r], lat[r]) / dt if dt else math.nan
            tie = speed == self.limit and (self.tie or offence[r] > number[r])
            if speed > self.limit or tie:
                out[r], self.near = 1, False
                self.tie = self.tie and not tie
            else:
                self.last, self.near = (us[r], lon[r], lat[r]), True
            i += 1
        if self.near:
            self.last = (us[rows[-1]], lon[rows[-1]], lat[rows[-1]])
        self.at = section[rows[-1]]
        return out


def section_flags(us: np.ndarray, lon: np.ndarray, lat: np.ndarray, limit: float) -> np.ndarray:
    """speed_rm of one section held in arrays (in order, times in microseconds, NaN for what is missing): what
    ``speed_filt`` gives for it."""
    n = len(us)
    placed = ~(np.isnan(us) | np.isnan(lon) | np.isnan(lat))

    def speeds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = np.radians(lat[i]), np.radians(lat[j])
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
        dt = (us[j] - us[i]) / 1e6
        return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1))) / np.where(dt == 0, np.nan, dt)

    at = np.arange(n)
    fast = np.r_[np.nan, speeds(at[:-1], at[1:])]
    first = np.zeros(n, bool)
    if (fast > limit).any():
        both = np.flatnonzero((fast > limit + 20) & (np.r_[fast[1:], np.nan] > limit + 20))
        first[both[:1]] = True
    use = placed & ~first
    rows, v = np.flatnonzero(use), np.full(n, np.nan)
    v[rows[1:]] = speeds(rows[:-1], rows[1:])
    over = np.flatnonzero(v > limit)
    offence = np.full(n, over[-1] + 1 if len(over) else 0)
    fix = pa.StructArray.from_arrays([pa.array(c) for c in (us, lon, lat)], ["us", "lon", "lat"])
    columns = {"__fix": fix, "__id": pa.array(at + 1), "__v": pa.array(v), "__last": pa.array(offence), "__alone": pa.array(np.full(n, not len(over) and not first.any())), "__first": pa.array(first), "__use": pa.array(use)}
    return _Pass(limit).batch(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)))


def _metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, h)))


def _smoothed(v: np.ndarray, p: int, include_centre: bool, clip: bool) -> np.ndarray:
    """Root mean square of the speeds in a frame of p each side: over what there is, or null unless all are there."""
    pad = np.r_[np.full(p, np.nan), v, np.full(p, np.nan)]
    rows = np.lib.stride_tricks.sliding_window_view(pad, 2 * p + 1)
    sq = rows**2
    sq = sq if include_centre else np.delete(sq, p, axis=1)
    n = (~np.isnan(sq)).sum(1)
    with np.errstate(invalid="ignore"):
        out = np.sqrt(np.nansum(sq, 1) / np.maximum(n, 1))
    return np.where(~np.isnan(rows).any(1) if clip else n > 0, out, np.nan)


def smooth_flags(us: np.ndarray, lon: np.ndarray, lat: np.ndarray, limit: float, p: int, include_centre: bool, clip: bool, fall_back: bool) -> np.ndarray:
    """1 for the fixes of a section (in order, times in microseconds) that the filter on smoothed speeds removes.

    As long as some smoothed speed exceeds the limit, the first fix at or over it goes and speeds are worked out anew; the
    first round prefers a fix that both its speeds exceed by 20, and takes one at the limit too. Kept fixes are a linked
    list and offences a heap, so a removal works out only the next fix's speed and the smoothed ones of the 2p + 1 fixes
    around it. Where no smoothed speed is left, raw ones decide if ``fall_back`` is set.
    """
    out = np.zeros(len(us), np.int32)
    use = np.flatnonzero(~(np.isnan(us) | np.isnan(lon) | np.isnan(lat)))
    n = len(use)
    if n < 2:
        return out
    t, x, y = us[use] / 1e6, lon[use], lat[use]
    a, b = np.radians(y[:-1]), np.radians(y[1:])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.diff(x)) / 2) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.r_[np.nan, 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1))) / np.diff(t)].tolist()
    v = _smoothed(np.array(raw), p, include_centre, clip).tolist()
    t, x, y = t.tolist(), x.tolist(), y.tolist()
    before, after, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    nan = math.nan

    def speed(i: int) -> float:
        j = before[i]
        if j < 0:
            return nan
        d, dt = _metres(x[j], y[j], x[i], y[i]), t[i] - t[j]
        return d / dt if dt else (math.inf if d else nan)

    def frame(i: int) -> float:
        left, right, j, k = [], [], i, i
        for _ in range(p):
            j = before[j] if j >= 0 else -1
            k = after[k] if k >= 0 else -1
            left.append(raw[j] if j >= 0 else nan)
            right.append(raw[k] if k >= 0 else nan)
        around = [*left[::-1], raw[i], *right]
        if clip and any(s != s for s in around):
            return nan
        sq = [s * s for k, s in enumerate(around) if s == s and (include_centre or k != p)]
        return math.sqrt(sum(sq) / len(sq)) if sq else nan

    sm, known, first = v, sum(s == s for s in v), True

    def choose() -> tuple[list[float], int, list[int]]:
        """The speeds that decide, how many exceed the limit, and the heap of those at or over it."""
        now = sm if known else list(raw) if fall_back else []
        return now, sum(s > limit and live[i] for i, s in enumerate(now)), [i for i, s in enumerate(now) if s >= limit and live[i]]  # in order, so a heap

    v, over, heap = choose()
    while over or (first and heap):
        k = None
        if first:
            k = next((i for i in range(n - 1) if v[i] > limit + 20 and v[i + 1] > limit + 20), None)
            first = False
        while k is None:
            i = heapq.heappop(heap)
            k = i if live[i] and v[i] >= limit else None
        had = known
        out[use[k]], live[k] = 1, False
        over -= v[k] > limit
        known -= sm[k] == sm[k]
        q, r = before[k], after[k]
        if q >= 0:
            after[q] = r
        if r >= 0:
            before[r] = q
            raw[r] = speed(r)
        touched, i, j = [], q, r
        for _ in range(p):
            if i >= 0:
                touched.append(i)
                i = before[i]
        for _ in range(p + 1):
            if j >= 0:
                touched.append(j)
                j = after[j]
        for i in touched:
            new = frame(i)
            known += (new == new) - (sm[i] == sm[i])
            now = new if had else raw[i]
            over += (now > limit) - (v[i] > limit)
            if now >= limit:
                heapq.heappush(heap, i)
            sm[i] = new
            v[i] = now
        if bool(had) != bool(known):
            v, over, heap = choose()
    return out


def _looped_flags(us: np.ndarray, lon: np.ndarray, lat: np.ndarray, limit: float, fun: Callable, fall_back: bool) -> np.ndarray:
    """The like for smoothed speeds by any function of a whole section: worked out anew after each removal."""
    out = np.zeros(len(us), np.int32)
    alive = list(np.flatnonzero(~(np.isnan(us) | np.isnan(lon) | np.isnan(lat))))
    first = True
    while len(alive) > 1:
        i = np.array(alive)
        a, b = np.radians(lat[i][:-1]), np.radians(lat[i][1:])
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.diff(lon[i])) / 2) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = np.r_[np.nan, 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1))) / np.diff(us[i] / 1e6)]
        v = np.asarray(fun(np.arange(1, len(raw) + 1), raw), float)
        v = raw if np.isnan(v).all() and fall_back else v
        if np.isnan(v).all() or np.nanmax(v) < limit or (np.nanmax(v) == limit and not first):
            break  # at the limit the first round alone removes one
        leaving = np.r_[v[1:], np.nan]
        both = np.flatnonzero((v > limit + 20) & (leaving > limit + 20)) if first else []
        out[alive.pop(int(both[0] if len(both) else np.flatnonzero(v >= limit)[0]))] = 1
        first = False
    return out


def _smooth_filter(df: DataFrame, limit: float, method: str, points: int, include_centre: bool, fun: Callable | None, fall_back: bool, order: Order, keys: list[str]) -> DataFrame:
    """speed_rm by smoothed speeds. Sections are dealt out one by one and read as a stream of sorted Arrow batches; a task
    holds the batches of one section, and of its rows' numbers only times and places."""
    w = order.window(*(k for k in keys if k != order.key))
    d = df.withColumns({"__us": micros(order.time).cast("double"), "__lon": C("longitude").cast("double"), "__lat": C("latitude").cast("double"), "__id": F.row_number().over(w)})
    d = d.sortWithinPartitions(*keys, *order.by)
    schema = T.StructType([*df.schema, T.StructField("speed_rm", T.IntegerType())])
    names = list(df.columns)
    p, centre, clip = (2, False, True) if method == "mcconnell" else (points, include_centre, method == "flexi_clip")

    def flags(us: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        if fun is not None:
            return _looped_flags(us, lon, lat, limit, fun, fall_back)
        return smooth_flags(us, lon, lat, limit, p, centre, clip, fall_back)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # batches not yet given out
        parts: list[list[np.ndarray]] = []  # the open section's columns
        done: list[np.ndarray] = []  # flags of ended sections

        def end() -> None:
            if parts:
                done.append(flags(*(np.concatenate(c) for c in zip(*parts))))
                parts.clear()

        def ready() -> Iterator[pa.RecordBatch]:
            have = np.concatenate(done) if done else np.zeros(0, np.int32)
            at = 0
            while waiting and waiting[0].num_rows <= len(have) - at:
                b = waiting.pop(0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(have[at : at + b.num_rows], pa.int32())], names=[*names, "speed_rm"])
                at += b.num_rows
            done[:] = [have[at:]]

        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            cols = [get(c) for c in ("__us", "__lon", "__lat")]
            starts = np.flatnonzero(get("__id") == 1)
            waiting.append(b)
            at = 0
            for s in [*starts.tolist(), b.num_rows]:
                if s > at:
                    parts.append([c[at:s] for c in cols])
                if s < b.num_rows:
                    end()
                at = s
            if len(starts):
                yield from ready()
        end()
        yield from ready()

    ship(df.sparkSession)
    return d.mapInArrow(passed, schema)


def speed_filt(df: DataFrame, limit: float = 50, method: str = "none", hybrid: bool = False, points: int = 2, include_centre: bool = True, fun: Callable | None = None, fall_back: bool = True, has_gaps: bool = True, annotate: bool = True, order: Order = ORDER) -> DataFrame:
    """Flags (or drops) fixes until no speed within a section exceeds ``limit``; hybrid joins raw and smoothed flags."""
    keys = [order.key, "gapsec"] if has_gaps else [order.key]
    if method == "none" and fun is None:
        d = _raw_filter(df, limit, order, keys)
    else:
        d = _smooth_filter(df, limit, method, points, include_centre, fun, fall_back, order, keys)
        if hybrid:
            d = _raw_filter(d.withColumnRenamed("speed_rm", "__sm"), limit, order, keys).withColumn("speed_rm", F.greatest("speed_rm", "__sm")).drop("__sm")
    return d if annotate else d.filter("speed_rm = 0").drop("speed_rm")


def turn_filt(df: DataFrame, limit: float = math.pi / 4, direction: str = "less_than", has_gaps: bool = True, annotate: bool = True, order: Order = ORDER) -> DataFrame:
    """Adds rel_angle (turn at the fix, on degrees), abs_angle and angle_rm (1 where the turn is at most, or is over,
    the limit); all null at both ends of a section. Dropping removes flagged rows only."""
    w = order.window(*(["gapsec"] if has_gaps else []))
    head = F.atan2(F.lead("latitude").over(w) - C("latitude"), F.lead("longitude").over(w) - C("longitude"))
    d = df.withColumn("__h", head)
    turn = C("__h") - F.lag("__h").over(w)
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn <= -math.pi, turn + 2 * math.pi).otherwise(turn)
    d = d.withColumn("rel_angle", turn).drop("__h").withColumn("abs_angle", F.abs("rel_angle"))
    hit = C("abs_angle") <= limit if direction == "less_than" else C("abs_angle") > limit
    d = d.withColumn("angle_rm", hit.cast("int"))
    return d if annotate else d.filter("angle_rm is null or angle_rm = 0").drop("angle_rm")


def tspeed_jit(df: DataFrame, nsim: int = 50, jitter: float = 0.0005, gap: float = 28800, tol: float = 0.2, breaks: tuple[float, ...] | None = None, seed: int = 1, order: Order = ORDER) -> DataFrame:
    """Per tag and sampling rate: sd, mean and number of the absolute change in speed when coordinates are jittered
    uniformly, over ``nsim`` seeded runs."""
    from wayspan.operators.rates import BREAKS, assign_rates

    d = traj_speed(gap_section(df, gap, tol, order=order), True, order)
    d = assign_rates(d, breaks=breaks or BREAKS, out=None, order=order)
    w = order.window("gapsec")
    before = {f"__{c}": F.lag(c).over(w) for c in ("longitude", "latitude", *order.by)}
    d = d.withColumns(before).filter(C(f"__{order.time}").isNotNull() & C("traj_speed").isNotNull())

    # Hashed rather than drawn, so that a retried task gives the same numbers, and a fix's shift can be worked out at
    # the next fix too: the runs are an array of each row, not rows of their own to be dealt out.
    def shift(prefix: str, sim: Column, i: int) -> Column:
        h = F.xxhash64(C(order.key).cast("string"), *[C(prefix + c).cast("string") for c in order.by], sim, F.lit(seed * 2 + i))
        return (F.pmod(h, F.lit(2**31 - 1)) / float(2**31 - 1) * 2 - 1) * jitter

    def change(sim: Column) -> Column:
        ends = [C(p + c) + shift(p, sim, i) for p in ("__", "") for i, c in enumerate(("longitude", "latitude"))]
        return F.abs(haversine(*ends) / F.nullif(seconds_between(C(order.time), C(f"__{order.time}")), F.lit(0.0)) - C("traj_speed"))

    sims = d.select(order.key, "likely_rate", F.explode(F.transform(F.sequence(F.lit(1), F.lit(nsim)), change)).alias("__d")).filter(C("__d").isNotNull())
    return sims.groupBy(order.key, "likely_rate").agg(F.stddev("__d").alias("sd"), F.avg("__d").alias("mean"), F.count("__d").alias("N"))


def resample_path(df: DataFrame, spacing: float = 100, order: Order = ORDER) -> DataFrame:
    """Points at equal planar distances along each tag's projected path (X, Y): (key, step, X, Y, angle).

    Each leg of the path yields the points that lie on it, so a path is never gathered; angle is that to the next point.
    """
    w = order.window()
    d = df.filter("X is not null and Y is not null").select(order.key, *order.by, "X", "Y")
    d = d.withColumns({"__x": F.lead("X").over(w), "__y": F.lead("Y").over(w)})
    leg = F.hypot(C("__x") - C("X"), C("__y") - C("Y"))
    d = d.withColumn("__leg", leg).withColumn("__at", F.coalesce(F.sum("__leg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    first, past = F.ceil(C("__at") / spacing), F.ceil((C("__at") + C("__leg")) / spacing)
    last = F.floor(C("__at") / spacing) * spacing == C("__at")  # the path's end is a point if it falls on one
    steps = F.when(C("__leg").isNull(), F.when(last, F.array(F.floor(C("__at") / spacing)))).when(past > first, F.sequence(first, past - 1))
    d = d.withColumn("step", F.explode(steps))
    share = F.coalesce((C("step") * spacing - C("__at")) / C("__leg"), F.lit(0.0))
    at = lambda a, b: C(a) + F.coalesce((C(b) - C(a)) * share, F.lit(0.0))
    d = d.select(order.key, "step", at("X", "__x").alias("X"), at("Y", "__y").alias("Y"))
    w = W.partitionBy(order.key).orderBy("step")
    return d.withColumn("angle", F.atan2(F.lead("Y").over(w) - C("Y"), F.lead("X").over(w) - C("X")))


def arrow_heads(points: DataFrame, length: float = 50, half_angle: float = math.pi / 6) -> DataFrame:
    """Both barbs of an arrow head at each resampled point."""
    barb = lambda s: (C("X") - length * F.cos(C("angle") + s * half_angle), C("Y") - length * F.sin(C("angle") + s * half_angle))
    (lx, ly), (rx, ry) = barb(1), barb(-1)
    return points.withColumns({"left_x": lx, "left_y": ly, "right_x": rx, "right_y": ry})
