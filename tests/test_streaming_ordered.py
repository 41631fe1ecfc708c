"""Streams against batches, row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.operators import movement
from wayspan.operators.schema import Order
from wayspan.streaming import ordered

O = Order(seq="seq")
SCHEMA = "TagID long, DateTime timestamp, longitude double, latitude double, seq long"


def fixes(spark, n, seed):
    """Tags with gaps under, at and over the limit, outliers, speeds at the limit, ties in time and missing places."""
    rng = random.Random(seed)
    rows = []
    for tag in range(1, 6):
        t = 1_700_000_000 + tag
        for _ in range(n):
            t += rng.choice([0, 60, 60, 300, 1200, 1201, 5000])
            lon = None if rng.random() < 0.05 else rng.choice([0.0, 0.001, 0.002]) + (0.5 if rng.random() < 0.15 else 0)
            rows.append((tag, t, lon, 50.0 + rng.choice([0.0, 0.001]), len(rows)))
    rows.append((9, 1_700_000_000, 0.0, 50.0, len(rows)))  # one fix only
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, float(t), x, y, s) for a, t, x, y, s in rows], "TagID long, t double, longitude double, latitude double, seq long").select("TagID", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("DateTime"), "longitude", "latitude", "seq")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def told(df):
    return sorted((r.TagID, r.seq, r.DateTime, r.longitude, None if r.dt is None else round(r.dt, 6), r.gap, r.gapsec, r.speed_rm) for r in df.collect())


@pytest.mark.parametrize("limit", [15.0, None])
def test_shuffled_stream_equals_batch(rocks, tmp_path, limit):
    spark = rocks
    rows = fixes(spark, 40, 3)
    rng = random.Random(1)
    # Each fix comes up to two hours late; a last file of another tag drives the watermark past all.
    rows_by_arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 7000))
    size = len(rows) // 4 + 1
    parts = [rows_by_arrival[i : i + size] for i in range(0, len(rows), size)] + [[(99, 1_800_000_000, 0.0, 50.0, -1)], [(99, 1_800_000_100, 0.0, 50.0, -2)]]
    for i, p in enumerate(parts):
        frame(spark, p).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = ordered.ordered_tracks(stream, gap=1000, tol=0.2, limit=limit, late="3 hours", expire=86400, seq="seq")
    name = f"ordered{int(limit or 0)}"
    run = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    run.processAllAvailable()
    run.stop()
    batch = movement.gap_section(frame(spark, rows), 1000, 0.2, order=O)
    flags = movement.speed_filt(batch, limit, order=O) if limit else batch.withColumn("speed_rm", F.lit(0))
    batch = batch.join(flags.select("seq", "speed_rm"), "seq")  # the filter's own dt ends with the section
    got = told(spark.table(name).filter("TagID <> 99"))
    assert got == told(batch)
    assert {r[6] for r in got} > {1, 2, 3} and (limit is None or 0 < sum(r[7] for r in got) < len(got))


def test_section_flags_equal_the_batch_filter(spark):
    rng = random.Random(12)
    rows = []
    for sec in range(60):
        t = 0
        for _ in range(rng.choice([1, 2, 3, 10, 40])):
            t += rng.choice([0, 10, 10, 60])
            rows.append((sec, t, None if rng.random() < 0.05 else rng.choice([0.0, 0.001, 0.002, 0.2]), 0.0, len(rows)))
    # A speed that is the limit exactly.
    limit = 2 * movement.EARTH * math.asin(math.sqrt(math.sin(math.radians(0.001) / 2) ** 2)) / 10
    d = frame(spark, rows)
    want = {r.seq: r.speed_rm for r in movement.speed_filt(d, limit, has_gaps=False, order=O).collect()}
    got = {}
    for sec in range(60):
        mine = [r for r in rows if r[0] == sec]
        arrays = [np.array([math.nan if v is None else v for v in c], float) for c in ([r[1] * 1e6 for r in mine], [r[2] for r in mine], [r[3] for r in mine])]
        got |= dict(zip([r[4] for r in mine], movement.section_flags(*arrays, limit).tolist()))
    assert got == want and 0 < sum(got.values()) < len(got)


def test_expire_must_exceed_the_gap(spark):
    with pytest.raises(ValueError, match="longer than the gap"):
        ordered.ordered_tracks(frame(spark, fixes(spark, 1, 1)), expire=100)
