import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.functions import geo, times
from wayspan.operators import checks, duplicates, enrich, movement, outliers, pipeline, rates, reports, schema, subsample, trips
from wayspan.operators.schema import Order

O = Order(seq="seq")
SCHEMA = "TagID string, DateTime timestamp, seq int, longitude double, latitude double"


def track(spark, rows):
    """rows: (tag, seconds, lon, lat)."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t, t0 + dt.timedelta(seconds=s) if s is not None else None, i, x, y) for i, (t, s, x, y) in enumerate(rows)], SCHEMA)


def test_gap_edges_and_single_fixes(spark):
    rows = [("a", 0, 0.0, 0.0), ("a", 120, 0.0, 0.0), ("a", 241, 0.0, 0.0), ("a", 301, 0.0, 0.0), ("b", 0, 0.0, 0.0)]
    d = movement.gap_section(track(spark, rows), gap=100, tol=0.2, order=O).orderBy("seq").collect()
    assert [r.gapsec for r in d] == [1, 1, 2, 2, 1]  # exactly 120 s is no gap
    assert [r.gap for r in d] == [0, 1, 0, 1, 1]
    assert d[0].dt == 120.0 and d[3].dt is None
    kept = movement.gap_section(track(spark, rows), gap=100, tol=0.2, drop_single=True, order=O)
    assert {r.TagID for r in kept.collect()} == {"a"}


def test_speed_into_the_row(spark):
    d = movement.traj_speed(track(spark, [("a", 0, 0.0, 0.0), ("a", 10, 0.0, 0.001), ("a", 20, None, None), ("a", 30, 0.0, 0.002)]), order=O).orderBy("seq").collect()
    assert d[0].traj_speed is None and abs(d[1].traj_speed - 11.1319) < 1e-3
    assert d[1].dist is None and d[2].traj_speed is None and d[3].dist is None


def brute_speed(rows, limit):
    alive, gone, first = list(range(len(rows))), set(), True

    def v(i, j):
        a, b = rows[i], rows[j]
        p, q = math.radians(a[3]), math.radians(b[3])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH * math.asin(math.sqrt(h)) / (b[1] - a[1])

    while True:
        s = [0] + [v(a, b) for a, b in zip(alive, alive[1:])]
        if not first and max(s) <= limit:
            return gone
        over = max(s) > limit
        both = [i for i in range(1, len(s) - 1) if s[i] > limit + 20 and s[i + 1] > limit + 20] if first and over else []
        bad = both or [i for i in range(1, len(s)) if s[i] >= limit]
        if not bad:
            return gone
        gone.add(alive.pop(bad[0]))
        first = False


def test_speeds_at_the_limit(spark):
    """Steps of exactly the limit, none over it: one goes. With one over it later, those before it go as well."""
    step = 0.01  # degrees of latitude a minute
    rows = lambda tag, ys: [(tag, 60 * i, 0.0, float(y)) for i, y in enumerate(ys)]
    even = rows("even", [step * i for i in range(6)])
    later = rows("later", [0, step, 2 * step, 2 * step, 2 * step, 4.5 * step, 4.5 * step])
    last = rows("last", [0, 3 * step, 2 * step, 3 * step, 3 * step, 3 * step])
    d = track(spark, even + later + last)
    v = movement.traj_speed(d, order=O).filter("TagID = 'even'").orderBy("seq").collect()
    limit = v[1].traj_speed
    same = [i for i, r in enumerate(v) if r.traj_speed == limit]
    out = movement.speed_filt(d, limit, has_gaps=False, order=O)
    got = {r.seq for r in out.filter("speed_rm = 1").collect()}
    want = set()
    for k, t in ((0, even), (6, later), (13, last)):
        want |= {k + i for i in brute_speed(t, limit)}
    assert len(same) >= 2 and got == want and len([s for s in got if s < 6]) >= 1


def test_speed_filter_over_batches_and_a_long_section(spark):
    rng = np.random.default_rng(12)
    tags = {f"t{k}": [(f"t{k}", 60 * i, float(x) if i % 17 else None, float(y)) for i, (x, y) in enumerate(zip(rng.normal(0, 0.01, 90), rng.normal(50, 0.01, 90)))] for k in range(9)}
    d = track(spark, [r for t in tags.values() for r in t])
    whole = movement.speed_filt(d, 15, has_gaps=False, order=O).select("TagID", "seq", "speed_rm").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    parts = movement.speed_filt(d, 15, has_gaps=False, order=O).select("TagID", "seq", "speed_rm").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(whole) == sorted(parts)
    got = {(r.TagID, r.seq) for r in whole if r.speed_rm}
    for k, (t, rows) in enumerate(tags.items()):
        known = [(i, r) for i, r in enumerate(rows) if r[2] is not None]
        if not any(b[0] - a[0] > 1 for a, b in zip(known, known[1:])):
            assert {s for x, s in got if x == t} == {90 * k + known[i][0] for i in brute_speed([r for _, r in known], 15)}
    n = 300_000
    long = spark.range(n).selectExpr("'a' AS TagID", "timestamp_seconds(1704067200 + id * 60) AS DateTime", "CAST(id AS INT) AS seq", "CASE WHEN id % 5 = 3 THEN 1D ELSE 0D END AS longitude", "50D AS latitude")
    out = movement.speed_filt(long, 20, has_gaps=False, order=O)
    assert out.filter("speed_rm = 1").count() == n // 5 and out.filter("speed_rm = 1 and longitude = 0").count() == 0


def test_speed_filter_is_the_loop(spark):
    rng = np.random.default_rng(3)
    tags = {f"t{k}": [(f"t{k}", 60 * i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(0, 0.01, 40), rng.normal(50, 0.01, 40)))] for k in range(6)}
    d = track(spark, [r for t in tags.values() for r in t])
    out = movement.speed_filt(d, 20, has_gaps=False, order=O)
    got = {(r.TagID, r.seq) for r in out.filter("speed_rm = 1").collect()}
    want = {(t, 40 * k + i) for k, (t, rows) in enumerate(tags.items()) for i in brute_speed(rows, 20)}
    assert got == want and out.count() == d.count()
    left = movement.traj_speed(movement.speed_filt(d, 20, has_gaps=False, annotate=False, order=O), order=O)
    assert left.agg(F.max("traj_speed")).head()[0] <= 20
    smooth = movement.speed_filt(movement.gap_section(d, order=O), 20, "flexi_vec", order=O)
    assert smooth.count() == d.count() and smooth.filter("speed_rm = 1").count() > 0


def test_turns(spark):
    d = movement.turn_filt(track(spark, [("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 1.0), ("a", 3, 1.0, 2.0)]), has_gaps=False, order=O).orderBy("seq").collect()
    assert d[0].rel_angle is None and abs(d[1].rel_angle - math.pi / 2) < 1e-9 and d[1].angle_rm == 0 and d[2].angle_rm == 1


def test_filt_err_bounds(spark):
    d = spark.createDataFrame([(1, "x", None), (5, "y", None), (None, None, None)], "n int, s string, z double")
    out = checks.filt_err(d, ["n", "s", "z"], [1, "y", 0], [4, None, 1]).collect()
    assert [(r.n_rm, r.s_rm, r.z_rm, r.all_rm) for r in out] == [(1, 0, None, 1), (1, 1, None, 1), (None, None, None, None)]
    assert [r.n_rm for r in checks.filt_err(d, ["n"], [1], [5], inclusive=False).collect()] == [0, 0, None]
    assert checks.filt_err(d, ["n"], [lambda c: c == 5], [None], annotate=False).count() == 2
    with pytest.raises(ValueError):
        checks.filt_err(d, ["s"], [None], [None])


def test_parallel_streams_and_winners(spark):
    a = [("a", 60 * i, 0.0, 0.0) for i in range(8)]
    b = [("a", 30 + 60 * i, 1.0, 1.0) for i in range(8)]
    d = duplicates.parallel_streams(track(spark, a + b), O).orderBy("DateTime").collect()
    assert [r.parallel_issue for r in d] == [0] + [1] * 14 + [0] and {r.overlap_block for r in d} == {None, 1}
    assert duplicates.resolve_parallel(track(spark, a + b), "last", order=O).filter("longitude = 0").count() == 1
    assert duplicates.resolve_parallel(track(spark, a + b), "best_quality", ["longitude"], [-1], order=O).filter("longitude = 1").count() == 1


def test_same_time_and_place(spark):
    d = track(spark, [("a", 0, 0.0, 0.0), ("a", 0, 2.0, 4.0), ("a", 60, 0.0, 0.0), ("a", 60, 0.0, 0.0), ("a", None, None, None)])
    m = {r.seq: r for r in duplicates.mark(d, True, O).collect()}
    assert (m[0].dup_time_rm, m[0].dup_coords_rm, m[2].dup_time_coords_rm, m[2].all_dup_rm, m[4].dup_coords_rm) == (1, 1, 1, 1, 0)
    c = duplicates.resolve_same_time(d.filter("DateTime is not null"), "centroid", order=O).orderBy("DateTime").collect()
    assert [(r.longitude, r.latitude) for r in c] == [(1.0, 2.0), (0.0, 0.0)]
    assert duplicates.resolve_same_place(d, "avg_time", order=O).count() == 3


def test_asof_ties_and_limit(spark):
    left, right = track(spark, [("a", 50, 0.0, 0.0), ("b", 0, 0.0, 0.0)]), track(spark, [("a", 0, 1.0, 0.0), ("a", 100, 2.0, 0.0)])
    got = {r.TagID: r.v for r in subsample.asof(left.select("TagID", "DateTime"), right.withColumnRenamed("longitude", "v"), ["v"], order=O).collect()}
    assert got == {"a": 1.0, "b": None}
    assert subsample.asof(left.select("TagID", "DateTime"), right.withColumnRenamed("longitude", "v"), ["v"], within=10, order=O).filter("v is not null").count() == 0


def test_subsamples_are_spaced(spark):
    rng = np.random.default_rng(1)
    d = track(spark, [("a", int(s), 0.0, 0.0) for s in np.cumsum(rng.integers(20, 400, 200))])
    for f in (subsample.rounder, subsample.sequencer):
        k = movement.time_steps(f(d, 300, order=O), O)
        assert k.count() > 20 and k.agg(F.min("dt")).head()[0] > 240
    one, two = (subsample.boots(d, 300, n_boot=2, seed=5, order=O).orderBy("boot", "rn").collect() for _ in range(2))
    assert one == two
    got = subsample.retrieve_boots(d, subsample.boots(d, 300, n_boot=2, order=O), order=O)
    assert got.join(movement.gap_section(d, 360, 0.0, order=O).select("seq", "gapsec"), "seq").filter("dt < 240").count() == 0


def test_rates(spark):
    d = track(spark, [("a", 0, 0.0, 0.0), ("a", 90, 0.0, 0.0), ("a", 180, 0.0, 0.0), ("a", 20000, 0.0, 0.0)])
    got = {r.likely_rate: r.N for r in rates.assign_rates(d, order=O).collect()}
    assert got == {"60": 2, "<19820": 1}
    t = rates.rate_tables(d, order=O)
    assert {(r.TagID, r.rate, r.N) for r in t["counts"].collect()} == {("a", "60", 2), ("a", "10800+", 1), ("all", "60", 2), ("all", "10800+", 1)}


def test_trips_by_hand(spark):
    out, home = 0.5, 0.0
    xs = [home, out, out, home, out, home, home, out]  # a come-and-go fix at 3, an open end at 7
    d = movement.gap_section(track(spark, [("a", 60 * i, x, 50.0) for i, x in enumerate(xs)]), order=O)
    t = trips.define_trips(d, "circ", lls=(0.0, 50.0), radius=1000, order=O).orderBy("seq", "extra_row").collect()
    assert [(r.seq, r.extra_row, r.tripNo) for r in t] == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1), (3, 1, 2), (4, 0, 2), (5, 0, 2), (6, 0, 0), (7, 0, 0)]
    labelled = trips.define_trips(d, "circ", lls=(0.0, 50.0), radius=1000, label_no_end=True, order=O)
    assert {r.tripNo for r in labelled.filter("seq >= 6").collect()} == {3}
    s = trips.trip_stats(spark.createDataFrame(t, labelled.schema), nest_lls=(0.0, 50.0), order=O).orderBy("tripNo").collect()
    assert [r.DistN for r in s] == [4, 3] and abs(s[0].DistMax - 35.8) < 0.2 and abs(s[0].TripDur - 0.05) < 1e-9 and abs(s[0].MaxBear - 90) < 1e-6
    assert trips.reset_cag(labelled).count() == 8 and trips.get_cag(labelled).count() == 1


def test_geometry():
    x, y = geo.project_point(5.0, 50.0)
    assert abs(x - 3962799.45) < 0.01 and abs(y - 2999718.85) < 0.01


def test_points_and_polygons(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    d = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (None, 1.0)], "x double, y double")
    r = d.select(geo.in_polygon(F.col("x"), F.col("y"), square).alias("i"), geo.distance_to_edges(F.col("x"), F.col("y"), square).alias("d")).collect()
    assert [(v.i, v.d) for v in r] == [(True, 5.0), (False, 5.0), (None, None)]


def test_sun_at_greenwich(spark):
    d = spark.createDataFrame([("2024-06-20 12:00:00", 0.0, 51.5), ("2024-06-20 00:30:00", 0.0, 51.5)], "t string, longitude double, latitude double").select(F.lit("a").alias("TagID"), F.to_timestamp("t").alias("DateTime"), "longitude", "latitude")
    r = enrich.sun_calc(d).collect()
    assert [v.dnt for v in r][0] == "DA" and r[1].dnt in ("NI", "ATe", "ATm", "NTe", "NTm")
    assert r[0].sunrise.strftime("%H") == "03" and r[0].sunset.strftime("%H") == "20"


def test_datetime_formats(spark):
    d = spark.createDataFrame([("01/02/2024 03:04:05",), ("01/02/24 03:04",), ("2024-02-01 03:04",), ("24-02-01 03:04:05",), ("x",), (None,)], "s string")
    assert [str(r[0]) for r in d.select(times.datetime(F.col("s"))).collect()] == ["2024-02-01 03:04:05", "2024-02-01 03:04:00", "2024-02-01 03:04:00", "2024-02-01 03:04:05", "None", "None"]


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(size=3000), np.full(5000, 0.25), rng.integers(0, 5, 2000)].astype(float)
    d = spark.createDataFrame([(f"k{i % 3}", float(x)) for i, x in enumerate(v)], "TagID string, dt double").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    assert np.allclose(outliers.pooled_quantiles(d.select(F.col("dt").alias("v")), qs), np.quantile(v, qs), rtol=0, atol=1e-12)
    t = {r.TagID: (r.lo, r.hi) for r in outliers.thresholds(d, "dt", "quantile", ["TagID"]).collect()}
    h = {r.TagID: (r.lo, r.hi) for r in outliers.thresholds(d, "dt", "hampel", ["TagID"]).collect()}
    for k in range(3):
        x = v[k::3]
        med = np.median(x)
        mad = np.median(np.abs(x - med))
        assert np.allclose(t[f"k{k}"], np.quantile(x, [0.01, 0.99])) and np.allclose(h[f"k{k}"], (med - 3 * mad, med + 3 * mad))
    med = np.median(v)
    assert np.allclose(outliers.thresholds(d, "dt", "hampel", []).head()[:], (med - 3 * np.median(np.abs(v - med)), med + 3 * np.median(np.abs(v - med))))
    assert outliers.thresholds(d.limit(0), "dt", "quantile", []).head()[:] == (None, None)


def test_jitter_equals_rows_of_their_own(spark):
    """The array of runs against the plain way: a row per run, windows over each run."""
    rng = np.random.default_rng(7)
    d = track(spark, [(f"t{k}", int(s), float(x), float(y)) for k in range(3) for s, x, y in zip(np.cumsum(rng.integers(30, 900, 40)), rng.normal(0, 0.01, 40), rng.normal(50, 0.01, 40))])
    got = {(r.TagID, r.likely_rate): (r.sd, r.mean, r.N) for r in movement.tspeed_jit(d, 6, 0.001, seed=3, order=O).collect()}
    real = rates.assign_rates(movement.traj_speed(movement.gap_section(d, order=O), True, O), out=None, order=O).withColumnRenamed("traj_speed", "real")
    s = real.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(6))))
    unit = lambda i: F.pmod(F.xxhash64("TagID", F.col("DateTime").cast("string"), F.col("seq").cast("string"), "sim", F.lit(6 + i)), F.lit(2**31 - 1)) / float(2**31 - 1)
    s = s.withColumns({"longitude": F.col("longitude") + (unit(0) * 2 - 1) * 0.001, "latitude": F.col("latitude") + (unit(1) * 2 - 1) * 0.001})
    w = O.window("sim", "gapsec")
    v = geo.haversine(F.lag("longitude").over(w), F.lag("latitude").over(w), F.col("longitude"), F.col("latitude")) / (F.unix_micros("DateTime") - F.lag(F.unix_micros("DateTime")).over(w)) * 1e6
    want = {(r.TagID, r.likely_rate): (r.sd, r.m, r.n) for r in s.withColumn("x", F.abs(v - F.col("real"))).filter("x is not null").groupBy("TagID", "likely_rate").agg(F.stddev("x").alias("sd"), F.avg("x").alias("m"), F.count("x").alias("n")).collect()}
    assert got.keys() == want.keys() and all(got[k][2] == want[k][2] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_outliers_by_tukey(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    d = spark.createDataFrame([("a", x) for x in v], "TagID string, dt double")
    t = outliers.thresholds(d, "dt", "boxplot", ["TagID"]).head()
    assert (t.lo, t.hi) == (1.0, 8.0)
    assert outliers.thresholds(d, "dt", "boxplot", []).head()[:] == (1.0, 8.0)
    f = outliers.outlier_flags(d, "dt", 50, methods=("boxplot",))
    assert f.filter("outlier_i_dt_boxplot = 'i_u' and u_max_dt = 1").count() == 1


def test_pipeline_modes(spark):
    d = track(spark, [("a", 60 * i, 0.001 * i, 50.0) for i in range(20)] + [("a", 1230, None, None)])
    a = pipeline.clean_track(d, pipeline.Cleaning(speed=50, turn=0.1), True, O)
    assert a.data.count() == 21 and a.data.filter("combined_rm = 1").count() >= 1
    assert pipeline.clean_track(d, pipeline.Cleaning(), False, O).data.count() == 20
    assert checks.stage_counts(a.data, ["NA_latlong_rm"], O).head().after_NA_latlong == 20


def test_schema(spark):
    d = track(spark, [("a", 0, 0.0, 0.0)])
    assert schema.is_kind(d, "track") and not schema.is_kind(d, "accn")
    with pytest.raises(ValueError):
        schema.validate(d.drop("latitude"))
    two = schema.stack(d, d, names=["x", "y"])
    assert {r.TagID for r in schema.flatten_stacks(two).collect()} == {"a_stack_x", "a_stack_y"}
    assert schema.simplify(d, ("seq",)).columns == ["TagID", "DateTime", "longitude", "latitude", "seq"]


def test_empty_tables(spark):
    d = track(spark, [("a", 0, 0.0, 0.0)]).filter("seq > 5")
    g = movement.gap_section(d, order=O)
    assert g.count() == 0 and movement.speed_filt(g, order=O).count() == 0
    assert reports.tag_timeline(d, order=O).count() == 0 and reports.tag_counts(d, order=O).count() == 0


def test_repaired_spacing_and_boot_rates(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.integers(20, 200, 300)).astype(float)
    taken = np.sort(rng.choice(300, 90, replace=False))
    got = subsample.repair_spacing(t, taken, 150)
    assert (np.diff(t[got]) >= 150).all() and len(set(got)) == len(got) and list(got) == sorted(got)
    kept = [a for a, b in zip(taken, taken[1:]) if t[b] - t[a] >= 150] + [taken[-1]]
    assert set(kept) <= set(got)
    for a, b in zip(got, got[1:]):  # no room is left in a hole between kept fixes
        assert not [j for j in range(a + 1, b) if t[j] - t[a] >= 150 and t[b] - t[j] >= 150] or {a, b} <= set(kept)
    d = track(spark, [("a", int(s), 0.0, 0.0) for s in t])
    for method in ("boot_sequencer", "boot_rate"):
        for strict in (True, False):
            index = subsample.sub_samp(d, 300, method=method, rate_l=240, n_boot=3, strict=strict, order=O)
            rows = index.collect()
            assert {r.boot for r in rows} == {1, 2, 3} and rows == index.collect()
            if method == "boot_sequencer":
                for b in (1, 2, 3):
                    x = np.array(sorted(r.rn for r in rows if r.boot == b and not r.coarser)) - 1
                    assert (np.diff(t[x]) >= 240).all()


def test_functions_of_ones_own(spark):
    d = track(spark, [("a", 0, 0.0, 0.0), ("a", 60, 0.0, 0.0), ("a", 600, 0.0, 0.0)])
    late = duplicates.duplicate_track(d, "avg_time", use_coords=True, methods={"parallel": "first", "exact": "first", "same_time": "first"}, time_fun=F.max, order=O)
    assert [r.DateTime.minute for r in late.collect()] == [10]
    a = [("a", 60 * i, float(i), 0.0) for i in range(8)]
    b = [("a", 30 + 60 * i, 3.0, 1.0) for i in range(8)]
    top = duplicates.resolve_parallel(track(spark, a + b), "best_quality", ["longitude"], [1], order=O, quality_fun=F.max)
    mean = duplicates.resolve_parallel(track(spark, a + b), "best_quality", ["longitude"], [-1], order=O)
    assert top.filter("latitude = 1").count() == 1 and mean.filter("latitude = 0").count() == 1


def test_rhumb_and_resampled_path(spark):
    one = spark.createDataFrame([(0.0, 50.0, 0.0, 51.0), (0.0, 50.0, 1.0, 50.0), (179.5, 0.0, -179.5, 0.0)], "a double, b double, c double, d double")
    m = [r[0] for r in one.select(geo.rhumb(*(F.col(c) for c in "abcd"))).collect()]
    deg = math.radians(1) * geo.EARTH
    assert np.allclose(m, [deg, deg * math.cos(math.radians(50)), deg])
    rng = np.random.default_rng(3)
    x, y = np.cumsum(rng.normal(0, 300, 60)), np.cumsum(rng.normal(0, 300, 60))
    x[10], y[10] = x[9], y[9]
    d = track(spark, [("a", i, 0.0, 0.0) for i in range(60)]).join(spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "seq int, X double, Y double"), "seq")
    got = movement.resample_path(d, 100, O).orderBy("step").collect()
    at = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    grid = np.arange(0, at[-1], 100)
    assert [r.step for r in got] == list(range(len(grid))) and np.allclose([r.X for r in got], np.interp(grid, at, x)) and np.allclose([r.Y for r in got], np.interp(grid, at, y))


def test_sensor_files(spark, tmp_path):
    from wayspan.sources import tracks

    d = track(spark, [("a", i, 1.0, 2.0) for i in range(5)]).selectExpr("TagID", "DateTime", "longitude AS vsll", "latitude AS vbat", "seq AS other")
    d.write.parquet(str(tmp_path / "v"))
    v = tracks.read_sensor(spark, str(tmp_path / "v"), "voltage", tags=["a"], start="2024-01-01 00:00:03")
    assert v.columns == ["TagID", "DateTime", "vsll", "vbat"] and v.count() == 2
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "other" not in plan.split("ReadSchema")[1]
    t = track(spark, [("a", 60 * i, 0.001 * i, 50.0) for i in range(6)]).select("TagID", F.date_format("DateTime", "dd/MM/yyyy HH:mm:ss").alias("DateTime"), "longitude", "latitude")
    t.write.option("header", True).csv(str(tmp_path / "c"))
    back = tracks.read_tracks(spark, str(tmp_path / "c"), "csv", "TagID string, DateTime string, longitude double, latitude double", text_time=True)
    assert back.count() == 6 and back.filter("traj_speed is not null").count() == 5


def test_order_statistics_of_few_null_and_no_values(spark):
    for v in ([], [None], [3.0], [None, 2.0, 1.0], [float(i) for i in range(40)], [1.0] * 300 + [2.0]):
        d = spark.createDataFrame([(x,) for x in v], "v double")
        known = sorted(x for x in v if x is not None)
        n, at = outliers.order_stats(d, lambda n: list(range(0, n + 2)))
        assert n == len(known) and at == {i + 1: x for i, x in enumerate(known)}
    assert outliers.pooled_quantiles(spark.createDataFrame([], "v double"), [0.5]) == [None]


def test_summary_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(t, s, x, y) for t, k in (("a", 60), ("b", 37), ("one", 1)) for s, x, y in zip(rng.integers(0, 900, k).tolist(), rng.normal(size=k).tolist(), rng.normal(size=k).tolist())]
    rows += [("b", None, 0.5, None), (None, 5, 0.1, 0.2), (None, 9, None, 0.3)]
    d = track(spark, rows).withColumn("v", F.col("longitude") * 1000 + 1e6)
    p = d.toPandas().sort_values(["TagID", "DateTime", "seq"], na_position="first")
    gap = p.groupby("TagID", dropna=False)["DateTime"].shift(-1).sub(p["DateTime"]).dt.total_seconds()
    p = p.assign(dt=gap)
    text = lambda x: "NA" if x is None or np.isnan(x) else f"{x:.2f}"
    mad = lambda x: np.median(np.abs(x - np.median(x))) if len(x) else np.nan
    groups = {"ALL": p} | {None if isinstance(k, float) else k: g for k, g in p.groupby("TagID", dropna=False)}
    for stat in ("mean", "median"):
        got = {r.TagID: r for r in reports.summary(d, stat, mode="full_plus", numeric=("v",), add_ranges=True, order=O).collect()}
        assert got.keys() == groups.keys()
        for k, g in groups.items():
            r = got[k]
            fixes = g.dropna(subset="DateTime").drop_duplicates(["TagID", "DateTime"])
            assert (r.n_records, r.n_na_DT, r.n_fixes) == (len(g), g["DateTime"].isna().sum(), len(fixes))
            assert r.na_lon == pytest.approx(g["longitude"].isna().mean()) and r.xmax == pytest.approx(g["longitude"].max())
            times = g["dt"].dropna().value_counts()
            assert r.gap_mode == (min(times[times == times.max()].index) if len(times) else None)
            for c in ("dt", "v"):
                x = g[c].dropna().to_numpy()
                mid, width = (np.mean(x), np.std(x, ddof=1) if len(x) > 1 else np.nan) if stat == "mean" and len(x) else (np.median(x), mad(x)) if len(x) else (np.nan, np.nan)
                ends = (x.min(), x.max()) if len(x) else (np.nan, np.nan)
                assert r[f"{c}_{stat}"] == f"{text(mid)} ± {text(width)} [{text(ends[0])}, {text(ends[1])}]", (k, c, stat)


def test_numbers_as_text_are_rounded_as_the_doubles_they_are(spark):
    """As C's printf, which the SQL twins use; Java's format rounds the shortest decimals half up (F5, F6)."""
    from wayspan.functions.text import fixed

    values = [0.125, 0.375, 1.005, 2.675, 0.045, 0.145, 1234.565, -1.005, -0.125, 0.005, -0.005, 0.0, 99.995, 1e15 + 0.125, 2.0**52 + 1, 1e18, 3600.0, 1 / 3, *(i + 0.565 for i in range(200)), *(i / 8 for i in range(64)), None]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", fixed(F.col("v"), 2).alias("t")).orderBy("i").collect()]
    assert got == [None if v is None else f"{v:.2f}" for v in values]


def test_bootstraps_pass_as_a_stream(spark):
    """A Python group per tag and level took a pandas frame each (F7, F11); batches of any size give the same draws."""
    from wayspan.plans import catalog

    sf = "/root/testdata/sf0.001"
    d = catalog.QUERIES["boot_rate"](spark, sf)
    assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, d.collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, catalog.QUERIES["boot_rate"](spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def most_rows_of_a_task(spark, f):
    """What ``f`` gives, and the most shuffled rows that one task of its jobs read."""
    sc, was = spark.sparkContext, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("counted", "")
    try:
        out = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    top, store = sc._gateway.new_array(sc._jvm.double, 1), sc._jsc.sc().statusStore()
    top[0] = 1.0
    said = [store.taskSummary(s, 0, top) for j in sc.statusTracker().getJobIdsForGroup("counted") for s in sc.statusTracker().getJobInfo(j).stageIds]
    return out, max(x.get().shuffleReadMetrics().readRecords().head() for x in said if x.isDefined())


@pytest.mark.parametrize("levels", [1000, 0])
def test_quartiles_of_a_level_over_many_tags(spark, monkeypatch, levels):
    monkeypatch.setattr(outliers, "LEVELS", levels)  # broadcast, and dealt out
    rng = np.random.default_rng(5)
    p = [(f"t{i % 200}", [2023, 2024, None][0 if i % 50 == 0 else 2 if i == 77 else 1], float(i // 3000 or v), None if i % 7 == 0 else float(w), 24.0 * (i % 5), int(i % 4 == 0)) for i, (v, w) in enumerate(zip(rng.exponential(9, 4000), rng.normal(size=4000)))]
    d = spark.createDataFrame(p, "TagID string, year int, DistMax double, DistTotal double, TripDur double, incompl int").repartition(4)
    rows, most = most_rows_of_a_task(spark, lambda: trips.tabulate_trips(d, "year", option="boxplot", digits=3, order=O).collect())
    got = {(r.TagID, r.year): r for r in rows}
    assert len(got) == len(rows) == len({(x[0], x[1]) for x in p}) + 4
    assert most < 3000  # of 3,919 trips in a year, in two levels and three measures
    for tag, year, chosen in [("all", str(y) if y else None, [x for x in p if x[1] == y]) for y in (2023, 2024, None)] + [("all", "all", p), ("t3", "2024", [x for x in p if x[0] == "t3" and x[1] == 2024])]:
        r, whole = got[tag, year], [x for x in chosen if not x[5]]
        assert (r.complete, r.incomplete) == (len(whole), len(chosen) - len(whole))
        for i, scale in ((2, 1), (3, 1), (4, 24)):
            v = [x[i] / scale for x in whole if x[i] is not None]
            a, m, b = np.quantile(v, [0.25, 0.5, 0.75]) if v else (0, 0, 0)
            assert r[i + 2] == (f"{m:.3f} ({a:.3f},{b:.3f}) [{max(v):.3f}]" if v else None), (tag, year, i)


def test_cleaning_sorts_once_for_windows_in_one_order(spark):
    rng = np.random.default_rng(6)
    nan, n = float("nan"), 300
    rows = [(f"t{i % 3}", None if i % 29 == 0 else int(s) * 40000, [0.0, -0.0, 0.001, nan, None][int(x)], 50.0 + int(y)) for i, (s, x, y) in enumerate(zip(rng.integers(0, 60, n), rng.integers(0, 5, n), rng.integers(0, 2, n)))]
    rows += [("calm", 60 * i, 0.0, 50.0) for i in range(40)] + [("calm", 600 + 60 * i, 0.0, 50.0) for i in range(5)] + [("calm", 600 * 60 * 9, 0.0, 50.0)]
    d = track(spark, rows).withColumn("more", F.col("seq") % 2)
    out = pipeline.clean_track(d, pipeline.Cleaning(speed=50, turn=0.1, drop_single_gap=True), True, O).data
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 7  # fifteen before
    assert out.columns.index("X") == out.columns.index("singlegap_rm") + 1 == out.columns.index("speed_rm") - 2
    got = {r.seq: r for r in out.collect()}
    assert len(got) == len(rows)
    same = lambda v: "nan" if v != v else 0.0 if v == 0 else v
    at, here, whole, segments, k, last = {}, {}, {}, {}, {}, {}
    for i, (t, s, x, y) in enumerate(rows):
        place = (same(x), y)
        at.setdefault((t, s), set()).add(place)
        here.setdefault((t, s, place), []).append(i)
        whole.setdefault((t, s, place, i % 2), []).append(i)
        back = t in last and None not in (s, last[t]) and s < last[t]
        k[t], last[t] = k.get(t, 0) + back, s
        if s is not None:
            lo, hi = segments.get((t, k[t]), (s, s))
            segments[t, k[t]] = (min(lo, s), max(hi, s))
    sections = {}
    for r in got.values():
        sections[r.TagID, r.gapsec] = sections.get((r.TagID, r.gapsec), 0) + 1
    for i, (t, s, x, y) in enumerate(rows):
        r, place = got[i], (same(x), y)
        assert (r.dup_time_rm, r.dup_time_coords_rm, r.all_dup_rm) == (len(at[t, s]) > 1, len(here[t, s, place]) > 1, len(whole[t, s, place, i % 2]) > 1), i
        covered = 0 if s is None else sum(lo <= s <= hi for (u, _), (lo, hi) in segments.items() if u == t)
        assert r.dup_parallel_rm == (covered > 1), i
        assert r.singlegap_rm == (sections[r.TagID, r.gapsec] == 1), i
    assert {r.dup_parallel_rm for r in got.values() if r.TagID == "calm"} == {r.singlegap_rm for r in got.values()} == {0, 1}
