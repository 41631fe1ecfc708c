"""Archive over a local server, databases, the track store, attributes, table kinds, and functions of numpy arrays."""

import threading
import urllib.parse
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.functions import user
from wayspan.operators import checks, duplicates, movement, pipeline, schema
from wayspan.operators.schema import Order
from wayspan.plans.adapter import ORDER, doubled, placed
from wayspan.sources import archive, store, tracks

SF = "/root/testdata/sf0.001"
BEGIN = datetime(2024, 1, 1)


class Archive(BaseHTTPRequestHandler):
    """Two studies; tag a1 has hourly fixes for ten days, others one day; every request is kept."""

    log: list[dict] = []
    days = {"7": {"a1": 10, "a 2": 1}, "8": {"b1": 1}}

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        Archive.log.append(q | {"auth": self.headers.get("Authorization")})
        tags = Archive.days[q["study_id"]]
        if q["entity_type"] == "individual":
            rows = ["id,local_identifier,timestamp_start,timestamp_end"] + [f"{i},{t},{BEGIN},{BEGIN + timedelta(days=d, hours=-1)}" for i, (t, d) in enumerate(tags.items())]
        else:
            lo, hi = (datetime.strptime(q[k] + "000", "%Y%m%d%H%M%S%f") if k in q else d for k, d in (("timestamp_start", datetime.min), ("timestamp_end", datetime.max)))
            rows = ["timestamp,location_long,location_lat,ground_speed,gps_satellite_count"]
            for h in range(24 * tags[q["individual_local_identifier"]]):
                t = BEGIN + timedelta(hours=h)
                if lo <= t <= hi:
                    rows.append(f"{t:%Y-%m-%d %H:%M:%S.000},{'' if h == 3 else 0.001 * h},50.0,{'fast' if h == 4 else h},{h % 9}")
        body = "\r\n".join(rows).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/direct-read"
    server.shutdown()


def events():
    return [q for q in Archive.log if q["entity_type"] == "event"]


def test_archive_reads_catalogue_and_tags(spark, url):
    Archive.log.clear()
    d = archive.archive_table(spark, url, ["7", "8"], user="me", password="secret")
    rows = d.collect()
    assert len(rows) == 24 * 12 and {(r.study, r.TagID) for r in rows} == {("7", "a1"), ("7", "a 2"), ("8", "b1")}
    one = {r.DateTime: r for r in rows if r.TagID == "a1"}
    assert one[BEGIN + timedelta(hours=3)].longitude is None and one[BEGIN + timedelta(hours=4)].speed_2d is None and one[BEGIN + timedelta(hours=5)].satellites_used == 5 and one[BEGIN].altitude is None
    assert len(events()) == 3 and all(q["auth"].startswith("Basic ") for q in Archive.log)


def test_archive_filters_reach_the_requests(spark, url):
    Archive.log.clear()
    d = archive.archive_table(spark, url, ["7", "8"], tags=["a1"], start="2024-01-02 00:00:00", end="2024-01-03 12:00:00")
    assert d.count() == 37
    assert {(q["individual_local_identifier"], q["timestamp_start"], q["timestamp_end"]) for q in events()} == {("a1", "20240102000000000", "20240103120000000")}
    Archive.log.clear()
    assert d.filter("DateTime > timestamp'2024-01-03 10:00:00'").count() == 2 and events()[0]["timestamp_start"] == "20240103100000000"
    Archive.log.clear()
    assert archive.archive_table(spark, url, ["7", "8"], start="2024-01-05").count() == 24 * 6 and {q["individual_local_identifier"] for q in events()} == {"a1"}  # the others ended before
    Archive.log.clear()
    assert archive.archive_table(spark, url, ["7"], tags=["none"]).count() == 0 and not events()


def test_archive_slices_lose_and_repeat_nothing(spark, url):
    Archive.log.clear()
    d = archive.archive_table(spark, url, ["7"], tags=["a1"], slice=0.5)
    assert d.rdd.getNumPartitions() == 20
    got = [r.DateTime for r in d.select("DateTime").collect()]
    assert sorted(got) == [BEGIN + timedelta(hours=h) for h in range(240)]


def test_archive_tracks_are_finished(spark, url):
    windows = spark.createDataFrame([("a1", BEGIN, BEGIN + timedelta(hours=9))], "TagID string, start timestamp, end timestamp")
    d = archive.read_tracks_archive(spark, url, ["7"], bounds=windows, min_data=3)
    assert d.columns == list(schema.WIDE) and d.filter("TagID = 'a1'").count() == 9  # ten hours, one without a place


def test_database_filters_are_pushed(spark, tmp_path):
    db = f"jdbc:derby:{tmp_path}/db"
    d = placed(spark, SF).select("TagID", F.col("DateTime").cast("timestamp").alias("DateTime"), "longitude", "latitude", F.col("event_id").alias("satellites_used"))
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    d.coalesce(1).write.options(**options).option("createTableColumnTypes", "TagID BIGINT").jdbc(db + ";create=true", "fixes")
    lo, mid, hi = (str(r) for r in d.agg(F.min("DateTime"), F.expr("timestamp_seconds(floor(avg(unix_seconds(DateTime))))"), F.expr("max(DateTime) + INTERVAL 1 DAY")).head())
    tag = d.head()["TagID"]
    picked = tracks._picked(tracks.jdbc_table(spark, db, "fixes", options=options), [tag], mid, None, schema.ORDER)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert "TagID" in pushed and "DateTime" in pushed
    assert picked.count() == d.filter((F.col("TagID") == tag) & (F.col("DateTime") >= mid)).count() > 0
    parts = tracks.jdbc_table(spark, db, "fixes", [(lo, mid), (mid, hi)], options)
    assert parts.rdd.getNumPartitions() == 2 and parts.count() == d.count()
    assert {r["n"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()} == {d.filter(F.col("DateTime") < mid).count(), d.filter(F.col("DateTime") >= mid).count()}
    done = tracks.read_tracks_jdbc(spark, db, "fixes", tags=[tag], options=options, min_data=1)
    assert done.columns == list(schema.WIDE) and done.count() == d.filter(F.col("TagID") == tag).dropDuplicates(["DateTime"]).count()


def test_store_is_read_by_tag_without_an_exchange(spark, tmp_path):
    d = placed(spark, SF).select("TagID", F.col("DateTime").cast("timestamp").alias("DateTime"), "event_id", "longitude", "latitude")
    store.save_store(d, "kept_tracks", 4, str(tmp_path / "store"), ORDER)
    try:
        back = store.read_store(spark, "kept_tracks")
        out = movement.traj_speed(movement.gap_section(back, order=ORDER), True, ORDER)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan and "Exchange" in movement.gap_section(d, order=ORDER)._jdf.queryExecution().executedPlan().toString()
        key = ["TagID", "event_id", "gapsec", "traj_speed"]
        assert sorted(map(str, out.select(key).collect())) == sorted(map(str, movement.traj_speed(movement.gap_section(d, order=ORDER), True, ORDER).select(key).collect()))
        one = store.read_store(spark, "kept_tracks", tags=[d.head()["TagID"]], start="2024-01-01")
        spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
        plan = movement.gap_section(one, order=ORDER)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert "SelectedBucketsCount: 1 out of 4" in plan and "GreaterThanOrEqual(DateTime" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE kept_tracks")


def test_attributes_survive_writing_and_operators(spark, tmp_path):
    d = placed(spark, SF).withColumn("DateTime", F.col("DateTime").cast("timestamp"))
    done = pipeline.clean_track(d, pipeline.Cleaning(speed=50), order=ORDER)
    assert schema.attributes(done.data)["clean_track"]["speed"] == 50 and schema.attributes(done.data)["clean_track"]["flags"] == done.attributes["flags"]
    schema.stamp(done.data, "noted", why="test", at=BEGIN).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    for df in (back, movement.gap_section(back, order=ORDER), checks.satellites(movement.speed_filt(back.drop("speed_rm"), 40, order=ORDER), 4)):
        assert list(schema.attributes(df)) == ["clean_track", "noted"] and schema.attributes(df)["noted"]["at"] == str(BEGIN)
    bare = back.select((F.col("TagID") + 0).alias("TagID"))
    assert schema.attributes(bare) == {} and schema.attributes(schema.give_attributes(bare, schema.attributes(back))) == schema.attributes(back)


KIND_ROWS = {
    "track": "TagID string, DateTime timestamp, longitude double, latitude double", "trip": "TagID string, DistMax double, TripDur double",
    "accn": "TagID string, DateTime timestamp, x_acceleration double, y_acceleration double, z_acceleration double", "pressure": "TagID string, DateTime timestamp, pressure_avg double",
    "voltage": "TagID string, DateTime timestamp, vsll double, vbat double", "voltage_comm": "TagID string, DateTime timestamp, vbat double, bytes_communicated long",
}


@pytest.mark.parametrize("kind", sorted(KIND_ROWS))
def test_table_kinds(spark, kind):
    d = spark.createDataFrame([], KIND_ROWS[kind])
    assert schema.is_kind(d, kind) and schema.validate(d, kind) is d
    last = d.columns[-1]
    with pytest.raises(ValueError, match=f"{kind}: missing columns {last}"):
        schema.validate(d.drop(last), kind)
    assert schema.is_stack(d.withColumn("stack", F.lit("s")), kind) and not schema.is_stack(d, kind) and not schema.is_stack(d.withColumn("stack", F.lit("s")).drop(last), kind)
    if "DateTime" in d.columns:
        with pytest.raises(TypeError):
            schema.validate(d.withColumn("DateTime", F.lit("x")), kind)


def test_numpy_functions_stand_beside_columns(spark):
    d, o = doubled(spark, SF), ORDER
    same = lambda a, b: sorted(map(str, a.select("TagID", "DateTime", F.round("longitude", 9), F.round("latitude", 9)).collect())) == sorted(map(str, b.select("TagID", "DateTime", F.round("longitude", 9), F.round("latitude", 9)).collect()))
    how = {"methods": {"same_time": "centroid", "parallel": "best_quality", "same_loc": "avg_time"}, "variables": ["satellites_used"], "directions": [1], "use_coords": True, "order": o}
    ours = duplicates.duplicate_track(d, **how, centroid_fun=duplicates.median, quality_fun=duplicates.median, time_fun=F.min)
    numpy = duplicates.duplicate_track(d, **how, centroid_fun=np.median, quality_fun=np.median, time_fun=np.min)
    own = duplicates.duplicate_track(d, **how, centroid_fun=user.over_group(lambda v: float(np.sort(v)[[(len(v) - 1) // 2, len(v) // 2]].mean())), quality_fun=np.median, time_fun=np.min)
    assert same(ours, numpy) and same(ours, own)
    odd = checks.filt_err(d, ["satellites_used"], [user.over_values(lambda v: np.abs(v - 6) > 5)], [None])
    want = checks.filt_err(d, ["satellites_used"], [lambda c: F.abs(c - 6) > 5], [None])
    count = lambda x: x.groupBy("satellites_used_rm").count().collect()
    assert sorted(map(str, count(odd))) == sorted(map(str, count(want))) and len(count(odd)) == 3
    none = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, v double").groupBy("k").agg(user.over_group(np.median)(F.col("v")).alias("m"), F.count("*").alias("n"))
    assert sorted((r.k, r.m, r.n) for r in none.collect()) == [(1, None, 2), (2, 3.0, 1)]
