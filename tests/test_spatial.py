"""Polygon tables against brute force in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.operators import enrich, spatial


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def star(rng, x, y, r, n):
    """A ring around (x, y) with uneven radii."""
    return [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def inside(polygons, x, y):
    """Per polygon whether it covers (x, y), by even-odd crossings."""
    out = []
    for rings in polygons:
        odd = np.zeros(len(x), bool)
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
                up = (ay > y) != (by > y)
                odd ^= up & (x < (bx - ax) * (y - ay) / ((by - ay) or 1) + ax)
        out.append(odd)
    return np.array(out)


def distances(segments, x, y):
    best = np.full(len(x), np.inf)
    for ax, ay, bx, by in segments:
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def points(spark, xy):
    return spark.createDataFrame([(i, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")


def ids(df, col="covering"):
    return {r["id"]: list(r[col]) for r in df.collect()}


def test_covering_equals_ray_casting(spark):
    rng = random.Random(5)
    shapes = [[star(rng, rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(20, 300), rng.choice([3, 7, 60]))] for _ in range(12)]
    shapes.append([square(100, 100, 700), square(200, 250, 300), square(260, 300, 80)])  # a hole with an island in it
    xy = [(rng.uniform(-100, 1200), rng.uniform(-100, 1200)) for _ in range(3000)]
    want = inside(shapes, *np.array(xy).T)
    edges = spatial.edges_of(spark, shapes)
    for size in (None, 7.0, 90.0, 5000.0):
        got = ids(spatial.covering(points(spark, xy), edges, g=spatial.grid(edges, size)))
        assert all(got[i] == list(np.flatnonzero(want[:, i])) for i in got), size


def test_boundaries_holes_touching_and_overlapping_rings(spark):
    shapes = [[square(0, 0, 10), square(3, 3, 4)], [square(10, 0, 10)], [square(5, 5, 10)]]
    edges = spatial.edges_of(spark, shapes)
    xy = [(x / 2, y / 2) for x in range(-2, 44) for y in range(-2, 34)] + [(None, 1.0), (1.0, None)]

    def want(x, y, boundary):
        if x is None or y is None:
            return []
        out = []
        for i, rings in enumerate(shapes):
            touched = any((x in (r[0][0], r[2][0]) and r[0][1] <= y <= r[2][1]) or (y in (r[0][1], r[2][1]) and r[0][0] <= x <= r[2][0]) for r in rings)
            within = sum(r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1] for r in rings) % 2 == 1
            if (touched and boundary) or (within and not touched):
                out.append(i)
        return out

    for boundary in (True, False):
        for size in (None, 1.0, 0.7):
            got = ids(spatial.covering(points(spark, xy), edges, boundary=boundary, g=spatial.grid(edges, size)))
            assert all(got[i] == want(*xy[i], boundary) for i in got), (boundary, size)


def test_spatial_join_keeps_rows_and_nulls(spark):
    edges = spatial.edges_of(spark, [[square(0, 0, 10)], [square(5, 5, 10)]])
    p = points(spark, [(6, 6), (6, 6), (1, 1), (30, 30), (None, None)])
    assert sorted((r.id, r.poly) for r in spatial.spatial_join(p, edges).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert sorted((r.id, r.poly) for r in spatial.spatial_join(p, edges, how="left").filter("poly is null").collect()) == [(3, None), (4, None)]
    assert [r.covered for r in spatial.covered(p, edges).orderBy("id").collect()] == [True, True, True, False, None]
    none = edges.filter("false")
    assert [r.covered for r in spatial.covered(p, none).orderBy("id").collect()] == [False] * 4 + [None]
    assert [r.distance for r in spatial.nearest_edge(p, none).orderBy("id").collect()] == [None] * 5


def test_edge_table_closes_rings_and_drops_nulls(spark):
    v = spark.createDataFrame([("a", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (None, 1.0), (4.0, 4.0)])], "poly string, ring int, seq int, x double, y double")
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in spatial.edge_table(v).collect()) == [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 0)]


def test_nearest_edge_equals_brute_force(spark):
    rng = random.Random(11)
    shapes = [[star(rng, rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(5, 200), 40)] for _ in range(30)]
    edges = spatial.edges_of(spark, shapes)
    xy = [(rng.uniform(-4000, 8000), rng.uniform(-4000, 8000)) for _ in range(800)] + [(rng.uniform(0, 3000), rng.uniform(0, 3000)) for _ in range(800)] + [(None, 0.0)]
    got = {r.id: (r.distance, r.tried) for r in spatial.nearest_edge(points(spark, xy), edges, tried="tried").collect()}
    segments = [(r.x1, r.y1, r.x2, r.y2) for r in edges.collect()]
    want = distances(segments, *np.array(xy[:-1]).T)
    assert np.allclose([got[i][0] for i in range(1600)], want, atol=1e-9) and got[1600] == (None, 0)
    assert np.mean([got[i][1] for i in range(1600)]) < len(segments) / 4


def test_a_coast_of_many_edges_is_joined_not_written_into_the_plan(spark):
    n = 100_000
    turn = f"2 * pi() * id / {n}"
    far = f"(1e6 + 2e4 * sin(37 * {turn}) + 1e3 * sin(3001 * {turn}))"
    corners = spark.range(n).selectExpr("0 AS poly", "0 AS ring", "id AS seq", f"{far} * cos({turn}) AS x", f"{far} * sin({turn}) AS y")
    edges = spatial.edge_table(corners).cache()
    rng = random.Random(3)
    xy = [(r * math.cos(a), r * math.sin(a)) for r, a in ((1e6 + rng.uniform(-9e5, 9e5), rng.uniform(0, 7)) for _ in range(300))]
    g = spatial.grid(edges)
    d = spatial.nearest_edge(spatial.covering(points(spark, xy), edges, g=g), edges, tried="tried", g=g)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000 and "Join" in plan and "CartesianProduct" not in d._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in d.collect()}
    segments = np.array([(r.x1, r.y1, r.x2, r.y2) for r in edges.collect()])
    ax, ay, bx, by = segments.T
    for i, (x, y) in enumerate(xy):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        assert got[i].distance == pytest.approx(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)).min(), abs=1e-6)
        up = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax)
        assert list(got[i].covering) == [0] * (up.sum() % 2)
    tried = np.array([got[i].tried for i in got])
    print("edges tried per point: median", np.median(tried), "most", tried.max())
    assert np.median(tried) < n / 20


def outline(df):
    return sorted(tuple(round(float(v), 6) for v in r) for r in df.select("x1", "y1", "x2", "y2").collect())


def test_union_of_overlapping_squares_has_no_inner_edges(spark):
    edges = spatial.edges_of(spark, [[square(0, 0, 10)], [square(5, 5, 10)]])
    coast = spatial.union_edges(edges)
    want = [(0, 0, 10, 0), (10, 0, 10, 5), (10, 5, 15, 5), (15, 5, 15, 15), (15, 15, 5, 15), (5, 15, 5, 10), (5, 10, 0, 10), (0, 10, 0, 0)]
    assert outline(coast) == sorted(tuple(map(float, w)) for w in want)
    p = points(spark, [(7, 7), (5, 5), (10, 4)])
    assert [r.distance for r in spatial.nearest_edge(p, coast.selectExpr("0 AS poly", "*")).orderBy("id").collect()] == pytest.approx([math.hypot(3, 2), 5, 0])


def test_union_drops_shared_borders_repeats_and_heals_crossings(spark):
    neighbours = [[square(0, 0, 10)], [[(10, 0), (20, 0), (20, 10), (10, 10)]], [square(0, 0, 10)]]
    assert (10.0, 0.0, 10.0, 10.0) not in outline(spatial.union_edges(spatial.edges_of(spark, neighbours)))
    assert sum(math.hypot(a - c, b - d) for a, b, c, d in outline(spatial.union_edges(spatial.edges_of(spark, neighbours)))) == pytest.approx(60)
    part = [[square(0, 0, 10)], [[(10, 3), (20, 3), (20, 7), (10, 7)]]]  # shares a stretch of one side
    assert sum(math.hypot(a - c, b - d) for a, b, c, d in outline(spatial.union_edges(spatial.edges_of(spark, part)))) == pytest.approx(40 - 4 + 20 + 4)
    bow = [[[(0, 0), (10, 10), (10, 0), (0, 10)]]]
    got = outline(spatial.union_edges(spatial.edges_of(spark, bow)))
    assert len(got) == 6 and sum((5.0, 5.0) in ((a, b), (c, d)) for a, b, c, d in got) == 4
    hole = [[square(0, 0, 10), square(2, 2, 6)], [square(4, 4, 2)]]  # an island of another polygon in a hole
    assert sum(math.hypot(a - c, b - d) for a, b, c, d in outline(spatial.union_edges(spatial.edges_of(spark, hole)))) == pytest.approx(40 + 24 + 8)


def test_union_equals_sampled_cover_of_random_shapes(spark):
    rng = random.Random(8)
    shapes = [[star(rng, rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(30, 120), 14)] for _ in range(12)]
    edges = spatial.edges_of(spark, shapes)
    coast = outline(spatial.union_edges(edges))
    # Every outline piece has cover on its left only, and the outline's even-odd cover is that of any polygon.
    ends = {}
    for a, b, c, d in coast:
        ends[(a, b)] = ends.get((a, b), 0) + 1
        ends[(c, d)] = ends.get((c, d), 0) - 1
    assert not any(ends.values())
    xy = np.array([(rng.uniform(-100, 450), rng.uniform(-100, 450)) for _ in range(4000)])
    odd = np.zeros(len(xy), bool)
    for ax, ay, bx, by in coast:
        odd ^= ((ay > xy[:, 1]) != (by > xy[:, 1])) & (xy[:, 0] < (bx - ax) * (xy[:, 1] - ay) / ((by - ay) or 1) + ax)
    assert (odd == inside(shapes, *xy.T).any(0)).all()


def slow_areas(x, y, least, weighting):
    """The same by looking at every corner again after each removal."""
    live, gone, top = list(range(len(x))), [math.inf] * len(x), 0.0
    while len(live) > least:
        best = None
        for k, i in enumerate(live):
            p, q = live[k - 1], live[(k + 1) % len(live)]
            ax, ay, bx, by = x[p] - x[i], y[p] - y[i], x[q] - x[i], y[q] - y[i]
            size = math.hypot(ax, ay) * math.hypot(bx, by)
            a = abs(ax * by - ay * bx) / 2 * (1 - weighting * (ax * bx + ay * by) / size if size else 1)
            if best is None or (a, x[i], y[i]) < best[:3]:
                best = (a, x[i], y[i], i)
        top = max(top, best[0])
        gone[best[3]] = top
        live.remove(best[3])
    return gone


@pytest.mark.parametrize("weighting", [0.0, 0.7])
def test_effective_areas_equal_the_slow_way(weighting):
    rng = random.Random(2)
    for n in (3, 4, 9, 60):
        ring = star(rng, 0, 0, 100, n)
        x, y = [p[0] for p in ring], [p[1] for p in ring]
        assert spatial.effective_areas(x, y, [False] * n, 3, weighting) == pytest.approx(slow_areas(x, y, 3, weighting))


def test_simplify_keeps_share_rings_and_shared_borders(spark):
    rng = random.Random(4)
    border = [(100 + rng.uniform(-9, 9), 10 * i) for i in range(1, 20)]
    west = [(0, 0), (100, 0), *border, (100, 200), (0, 200)]
    east = [(200, 0), (200, 200), (100, 200), *border[::-1], (100, 0)]
    islets = [[star(rng, 500 + 40 * i, 0, 5, 12)] for i in range(6)]
    edges = spatial.edges_of(spark, [[west], [east], *islets])
    simple = spatial.simplify(edges, keep=0.4)
    n, m = edges.count(), simple.count()
    assert 0.4 * n <= m <= 0.5 * n
    rings = {r["poly"]: r["n"] for r in simple.groupBy("poly").agg(F.count("*").alias("n")).collect()}
    assert set(rings) == set(range(8)) and min(rings.values()) >= 3
    of = lambda p: {(r.x1, r.y1) for r in simple.filter(f"poly = {p}").collect()}
    inner = set(border)
    assert of(0) & inner == of(1) & inner and {(100, 0), (100, 200)} <= of(0) & of(1)
    assert {r["n"] for r in spatial.simplify(edges, keep=0.0001).groupBy("poly").agg(F.count("*").alias("n")).collect()} <= {3, 4}


def test_land_in_lists_may_overlap_and_have_holes(spark):
    from wayspan.functions import geo

    a, b, c = square(0, 0, 10), square(5, 5, 10), square(2, 2, 2)
    assert geo.polygons([a, b, c]) == [[a, c], [b]] and geo.polygons([[a, c], [b]]) == [[a, c], [b]] and geo.polygons([]) == []
    assert geo.polygons([a, square(1, 1, 8), square(3, 3, 2)]) == [[a, square(1, 1, 8)], [square(3, 3, 2)]]
    p = points(spark, [(7, 7), (3, 3), (1, 1), (20, 20), (None, None)])
    got = [r.inside for r in spatial.within_shape(p, [a, b, c], "x", "y", "inside").orderBy("id").collect()]
    assert got == [True, False, True, False, None]
    many = [star(random.Random(i), 40 * i, 0, 15, 9) for i in range(12)]
    got = [r.inside for r in spatial.within_shape(points(spark, [(40 * i, 0) for i in range(13)]), many, "x", "y", "inside").orderBy("id").collect()]
    assert got == [True] * 12 + [False]


def test_area_centroid():
    from wayspan.functions import geo

    far = [(x + 4e6, y + 3e6) for x, y in square(0, 0, 10)]
    assert geo.area_centroid([far]) == pytest.approx((4e6 + 5, 3e6 + 5), abs=1e-6)
    lee = [[(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]]
    assert geo.area_centroid(lee) == pytest.approx(((20 * 5 + 16 * 1) / 36, (20 * 1 + 16 * 6) / 36))
    assert geo.area_centroid([lee[0][::-1]]) == pytest.approx(geo.area_centroid(lee))
    assert geo.area_centroid([square(0, 0, 10), square(0, 0, 4)[::-1]]) != geo.area_centroid([square(0, 0, 10)])  # touches: land of its own
    holed = geo.area_centroid([square(0, 0, 10), square(1, 1, 4)])
    assert holed == pytest.approx(((100 * 5 - 16 * 3) / 84,) * 2)
    assert geo.area_centroid([[(0, 0), (4, 0)]]) == (2, 0)


def test_offshore_and_coast_of_overlapping_land(spark):
    from wayspan.functions import geo
    from wayspan.operators import enrich

    ring = lambda lon, lat, s: [geo.project_point(*p) for p in ((lon, lat), (lon + s, lat), (lon + s, lat + s), (lon, lat + s))]
    land = [ring(0, 50, 0.2), ring(0.1, 50.1, 0.2)]
    fixes = spark.createDataFrame([(1, 0.15, 50.15), (2, 0.05, 50.05), (3, 0.5, 50.5), (4, None, 50.0), (5, 0.31, 50.2)], "id long, longitude double, latitude double").withColumn("onshore", F.lit("clash"))
    tables = (land, [[r] for r in land], spatial.edges_of(spark, [[r] for r in land]))
    for shape in tables:
        assert [r.offshore for r in enrich.offshore(fixes, shape).orderBy("id").collect()] == [0, 0, 1, None, 1]
    got = enrich.dist2coast(fixes, land).orderBy("id").collect()
    assert [r.onshore for r in got] == [True, True, False, None, False] and got[3].dist2coast is None
    outer = distances(geo.edges(land), np.array([geo.project_point(0.5, 50.5)[0]]), np.array([geo.project_point(0.5, 50.5)[1]]))
    assert got[2].dist2coast == pytest.approx(outer[0], rel=1e-9)
    inner = distances(geo.edges(land), *(np.array([v]) for v in geo.project_point(0.15, 50.15)))[0]
    assert got[0].dist2coast > inner + 1000  # edges inside the other square are no coast
    simple = enrich.dist2coast(fixes, [[star(random.Random(1), *geo.project_point(0.2, 50.2), 20_000, 90)]], simplify=True, keep=0.3)
    assert simple.filter("dist2coast is not null").count() == 4
    near = enrich.offshore(fixes, tables[2], box=(0, 0, 1, 1), buffer=10)
    assert [r.offshore for r in near.orderBy("id").collect()] == [1, 1, 1, None, 1]


# Systems


def redfearn(lon, lat, zone):
    """UTM by powers of the distance from the middle meridian: another way than the library's."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    p, d, ep2 = math.radians(lat), math.radians(lon - (6 * zone - 183)), e2 / (1 - e2)
    n, t, c, w = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep2 * math.cos(p) ** 2, d * math.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    x = 500000 + k0 * n * (w + (1 - t + c) * w**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * w**5 / 120)
    return x, k0 * (m + n * math.tan(p) * (w**2 / 2 + (5 - t + 9 * c + 4 * c * c) * w**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * w**6 / 720))


def test_systems_round_trip_and_known_points(spark):
    from wayspan.functions.crs import Crs

    assert Crs(3035).point(5, 50) == pytest.approx((3962799.45, 2999718.85), abs=0.01)  # published example
    assert Crs(32631).point(3, 0) == pytest.approx((500000, 0)) and Crs(32731).point(3, -1e-9)[1] == pytest.approx(1e7)
    assert Crs(3035).point(10, 52) == pytest.approx((4321000, 3210000)) and Crs(3035).degrees(4321000.0, 3210000.0) == pytest.approx((10, 52))
    rng = random.Random(6)
    for _ in range(300):
        lon, lat = rng.uniform(0.5, 5.5), rng.uniform(-79, 79)
        assert Crs(32631).point(lon, lat) == pytest.approx(redfearn(lon, lat, 31), abs=2e-3)
    for code, west, east, south, north in ((3035, -25, 45, 30, 72), (32631, -1, 7, -80, 84), (32733, 11, 19, -80, 0), (25832, 5, 13, 40, 80), (3857, -180, 180, -85, 85), (4326, -180, 180, -90, 90)):
        at = [(rng.uniform(west, east), rng.uniform(south, north)) for _ in range(50)]
        d = spark.createDataFrame(at, "longitude double, latitude double")
        x, y = Crs(code).project(F.col("longitude"), F.col("latitude"))
        d = d.select("*", x.alias("x"), y.alias("y"))
        lon, lat = Crs(code).unproject(F.col("x"), F.col("y"))
        for r in d.select("*", lon.alias("lon"), lat.alias("lat")).collect():
            assert math.hypot(r.lon - r.longitude, r.lat - r.latitude) < 1e-9  # a tenth of a millimetre
            assert (r.x, r.y) == pytest.approx(Crs(code).point(r.longitude, r.latitude), abs=1e-6)
    with pytest.raises(ValueError, match="27700"):
        Crs(27700).point(0, 50)
    empty = spark.createDataFrame([(None, 50.0)], "longitude double, latitude double")
    assert empty.select(*Crs(32631).project(F.col("longitude"), F.col("latitude"))).head() == (None, None)


def test_polygons_on_one_another_share_cells_with_few_edges(spark):
    """Cells of four edge lengths held hundreds of edges each where many polygons overlap (F2, F3, F4)."""
    rng = random.Random(11)
    shapes = [[square(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(8, 20))] for _ in range(600)]
    edges = spatial.edges_of(spark, shapes).cache()
    g = spatial.grid(edges)
    per = [r["count"] for r in spatial.in_cells(edges, g).groupBy("ix", "iy").count().collect()]
    assert sum(c * c for c in per) / sum(per) <= 3 * spatial.CROWD and sum(per) <= 2 * spatial.LAID * len(shapes) * 4
    spots = [(rng.uniform(-5, 85), rng.uniform(-5, 85)) for _ in range(150)]
    want = inside(shapes, *np.array(spots).T)
    xy = [spots[i % len(spots)] for i in range(1200)] + [(None, 1.0)]  # places repeat: each is worked out once
    got = ids(spatial.covering(points(spark, xy), edges, g=g))
    assert len(got) == len(xy) and got[1200] == []
    assert all(got[i] == np.flatnonzero(want[:, i % len(spots)]).tolist() for i in range(1200))
    flags = ids(spatial.covered(points(spark, spots), edges, g=g).selectExpr("id", "array(covered) AS covering"))
    assert all(flags[i] == [bool(want[:, i].any())] for i in range(len(spots)))


def test_projecting_is_compiled_and_not_repeated_by_a_null_test(spark):
    d = spark.range(200).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id / 100D END AS longitude", "50D + id / 150D AS latitude")
    kept = enrich.project(d).filter("X is not null and Y is not null")
    tests = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert tests and not any("ASIN" in line for line in tests)  # before: both formulas in the filter, 24 s for 600,000 rows
    assert kept.count() == 200 - 29
    for code in (3035, 32631):
        back = enrich.unproject(enrich.project(d, code), code, (("X", "Y", "lon", "lat"),))
        assert "lambda" not in back._jdf.queryExecution().optimizedPlan().toString()  # before: an array's variable, which is not compiled
        assert back.columns == ["id", "longitude", "latitude", "X", "Y", "lon", "lat"]
        for r in back.collect():
            assert (r["lon"] is None) == (r["longitude"] is None) and (r["lon"] is None or abs(r["lon"] - r["longitude"]) + abs(r["lat"] - r["latitude"]) < 1e-9)


def test_few_edges_are_measured_for_a_point_far_from_the_coast(spark):
    """Candidates of wide cells were measured for each point (F1)."""
    ring = [(1000 * math.cos(2 * math.pi * i / 2000), 1000 * math.sin(2 * math.pi * i / 2000)) for i in range(2000)]
    edges = spatial.edges_of(spark, [[ring]]).cache()
    rng = random.Random(12)
    spots = [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(300)] + [(None, 1.0)]
    got = spatial.nearest_edge(points(spark, spots), edges, tried="tried").orderBy("id").collect()
    assert len(got) == 301 and got[300]["distance"] is None and got[300]["tried"] == 0
    ends = list(zip(ring, [*ring[1:], ring[0]]))
    for r, (x, y) in zip(got[:300:10], spots[:300:10]):
        want = min(math.hypot(x - (a + t * (c - a)), y - (b + t * (d - b))) for (a, b), (c, d) in ends for t in [max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))])
        assert r["distance"] == pytest.approx(want, abs=1e-9)
    assert sorted(r["tried"] for r in got)[150] <= 30


def test_a_join_with_many_polygons_passes_little_through_the_driver(spark):
    """The index was collected for a broadcast, as its file is small (F1)."""
    n, places = 20_000, [(5.0 * (i * 7 % 40) + 0.3, 5.0 * (i * 11 % 40) + 0.3) for i in range(40)]
    corner = ", ".join(f"struct({i} AS seq, double(id * 37 % 200 + {p} * (8 + id % 13)) AS x, double(id * 53 % 200 + {q} * (8 + id % 13)) AS y)" for i, (p, q) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]))
    edges = spatial.edge_table(spark.range(n).selectExpr("id AS poly", "0 AS ring", f"explode(array({corner})) AS c").select("poly", "ring", "c.*"))
    p = points(spark, [places[i % 40] for i in range(800)] + [(None, 1.0)])
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "2m")  # results of tasks of one stage; before, those of the index were larger
    try:
        got = {r["id"]: (r["n"], r["s"]) for r in spatial.spatial_join(p, edges).groupBy("id").agg(F.count("*").alias("n"), F.sum("poly").alias("s")).collect()}
    finally:
        conf.remove("spark.driver.maxResultSize")
    k = np.arange(n)
    a, b, w = k * 37 % 200, k * 53 % 200, 8 + k % 13
    for i in range(800):
        x, y = places[i % 40]
        hit = (x > a) & (x < a + w) & (y > b) & (y < b + w)
        assert got.get(i, (0, None)) == (hit.sum(), k[hit].sum() if hit.any() else None)
    assert max(got) < 800


@pytest.mark.parametrize("limits", [{}, {"IDS": 0}, {"PLACES": 0, "CARRIED": 0}])
def test_every_way_of_a_join_has_the_same_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(21)
    shapes = [[star(rng, rng.uniform(0, 90), rng.uniform(0, 90), rng.uniform(5, 60), rng.choice([3, 5, 30]))] for _ in range(40)]
    shapes.append([square(10, 10, 70), square(20, 25, 30), square(26, 30, 8)])
    edges = spatial.edges_of(spark, shapes)
    spots = [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(200)]
    want = inside(shapes, *np.array(spots).T)
    for times in (1, 6):  # places differ, or repeat
        d = spatial.spatial_join(points(spark, spots * times + [(None, 1.0)]), edges, how="left").collect()
        rows = sorted((i, int(j)) for i in range(200 * times) for j in np.flatnonzero(want[:, i % 200]))
        assert sorted((r["id"], r["poly"]) for r in d if r["poly"] is not None) == rows
        assert sorted(r["id"] for r in d if r["poly"] is None) == [i for i in range(200 * times) if not want[:, i % 200].any()] + [200 * times]
