"""The filter on smoothed speeds against the loop that works every speed out anew after each removal."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.functions.geo import EARTH
from wayspan.operators import movement
from wayspan.operators.schema import Order

O = Order(seq="seq")


def speeds(us, lon, lat):
    out = [math.nan]
    for i in range(1, len(us)):
        p, q = math.radians(lat[i - 1]), math.radians(lat[i])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon[i] - lon[i - 1]) / 2) ** 2
        d, dt = 2 * EARTH * math.asin(math.sqrt(min(h, 1))), us[i] / 1e6 - us[i - 1] / 1e6
        out.append(d / dt if dt else (math.inf if d else math.nan))
    return out


def smoothed(v, p, centre, clip):
    out = []
    for i in range(len(v)):
        frame = [(v[j] if 0 <= j < len(v) else math.nan, j == i) for j in range(i - p, i + p + 1)]
        sq = [s * s for s, mid in frame if s == s and (centre or not mid)]
        out.append(math.nan if (clip and any(s != s for s, _ in frame)) or not sq else math.sqrt(sum(sq) / len(sq)))
    return out


def loop(us, lon, lat, limit, p, centre, clip, fall_back):
    out, alive, first = [0] * len(us), [i for i in range(len(us)) if not (math.isnan(us[i]) or math.isnan(lon[i]) or math.isnan(lat[i]))], True
    while len(alive) > 1:
        raw = speeds(*([c[i] for i in alive] for c in (us, lon, lat)))
        v = smoothed(raw, p, centre, clip)
        if all(s != s for s in v):
            if not fall_back:
                break
            v = raw
        known = [s for s in v if s == s]
        if not known or max(known) < limit or (max(known) == limit and not first):
            break
        both = [i for i in range(len(v) - 1) if v[i] > limit + 20 and v[i + 1] > limit + 20] if first else []
        out[alive.pop(both[0] if both else next(i for i, s in enumerate(v) if s >= limit))] = 1
        first = False
    return out


def section(rng, n):
    us, lon, lat, t = [], [], [], 0
    for _ in range(n):
        t += rng.choice([0, 0, 60, 300, 900]) if rng.random() < 0.3 else 300
        jump = rng.random() < 0.2
        us.append(t * 1e6)
        lon.append(math.nan if rng.random() < 0.03 else rng.choice([0.0, 0.0, 0.01, 0.02]) + (rng.uniform(0.1, 0.9) if jump else 0.0))
        lat.append(50.0 + rng.choice([0.0, 0.0, 0.01]))
    return us, lon, lat


@pytest.mark.parametrize(("p", "centre", "clip"), [(2, False, True), (1, True, True), (2, True, False), (3, False, False)])
def test_list_and_heap_equal_the_loop(p, centre, clip):
    rng = random.Random(p * 10 + clip)
    removed = 0
    for n in [1, 2, 3, 5, 8] * 30 + [40] * 40 + [120] * 5:
        c = section(rng, n)
        for fall_back in (True, False):
            limit = rng.choice([5.0, 15.0, 40.0])
            got = movement.smooth_flags(*(np.array(x) for x in c), limit, p, centre, clip, fall_back).tolist()
            assert got == loop(*c, limit, p, centre, clip, fall_back)
            removed += sum(got)
    assert removed > 300


def test_a_speed_at_the_limit_goes_in_the_first_round_only():
    us, lon, lat = [i * 1e6 for i in range(6)], [i * 1e-4 for i in range(6)], [0.0] * 6
    limit = speeds(us, lon, lat)[1]
    for p, clip in ((1, False), (2, False)):
        got = movement.smooth_flags(np.array(us), np.array(lon), np.array(lat), limit, p, True, clip, True).tolist()
        assert got == loop(us, lon, lat, limit, p, True, clip, True)


def test_long_section_in_seconds():
    rng = np.random.default_rng(4)
    n = 100_000
    lon = np.cumsum(rng.normal(0, 1e-4, n))
    lon[rng.choice(n, 10_000, replace=False)] += 0.5
    began = time.time()
    flags = movement.smooth_flags(np.arange(n) * 6e7, lon, np.full(n, 50.0), 50.0, 2, False, True, True)
    assert flags.sum() >= 9_000 and time.time() - began < 30


@pytest.mark.parametrize("method", ["mcconnell", "flexi_clip", "flexi_vec"])
def test_streamed_sections_equal_the_loop(spark, method):
    rng = random.Random(7)
    rows, want = [], {}
    for tag, sec, n in [(1, 1, 70), (1, 2, 1), (1, 3, 40), (2, 1, 0), (2, 2, 130), (3, 1, 3)]:
        us, lon, lat = section(rng, n)
        flags = loop(us, lon, lat, 15.0, 2, method != "mcconnell", method != "flexi_vec", True)
        for i in range(n):
            rows.append((tag, sec, len(rows), us[i] / 1e6 + 1e9, None if math.isnan(lon[i]) else lon[i], lat[i], "x"))
            want[rows[-1][2]] = flags[i]
    rows.append((4, 1, len(rows), None, 0.0, 50.0, "x"))
    want[len(rows) - 1] = 0
    d = spark.createDataFrame(rows, "TagID int, gapsec long, seq int, s double, longitude double, latitude double, __x string").withColumn("DateTime", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = movement.speed_filt(d.repartition(3), 15.0, method, include_centre=True, order=O)
            assert got.columns == [*d.columns, "speed_rm"] and {r.seq: r.speed_rm for r in got.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert movement.speed_filt(d.filter("false"), 15.0, method, order=O).count() == 0
