from pyspark.sql import functions as F

from wayspan.plans.adapter import ORDER, placed
from wayspan.sources import simulate, tracks
from wayspan.streaming import live


def test_write_and_read(spark, tmp_path):
    d = placed(spark, "/root/testdata/sf0.001").withColumn("DateTime", F.col("DateTime").cast("timestamp"))
    tracks.write_tracks(d.select("TagID", "DateTime", "longitude", "latitude", "satellites_used"), str(tmp_path / "t"))
    back = tracks.read_tracks(spark, str(tmp_path / "t"), min_data=1)
    assert back.count() == d.dropDuplicates(["TagID", "DateTime"]).count() and "gps_pdop" in back.columns
    one = d.select("TagID").head()[0]
    plan = tracks.read_tracks(spark, str(tmp_path / "t"), tags=[one], min_data=1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_archive_names(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0)], "`individual.local.identifier` string, `location.long` double, location_lat double")
    assert tracks.rename_archive(d).columns == ["TagID", "longitude", "latitude"]


def test_simulation_is_seeded(spark):
    a, b = (simulate.sim_data(spark, 2, 2, 30, seed=4).orderBy("TagID", "trip", "DateTime").collect() for _ in range(2))
    assert a == b and {r.phase for r in a} == {"explore", "forage", "return"}


def test_streams(spark, tmp_path):
    d = placed(spark, "/root/testdata/sf0.001").select("TagID", F.col("DateTime").cast("timestamp").alias("DateTime"), "longitude", "latitude")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, q, mode in (("sect", live.sections(s, late="0 seconds"), "append"), ("fast", live.speed_flags(s, 5.0), "append"), ("days", live.day_counts(s), "complete")):
        run = q.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert spark.table("fast").count() == d.count()
    assert 0 < spark.table("fast").filter("speed_rm = 1").count() < d.count()
    assert spark.table("sect").count() > 0
    days = d.groupBy("TagID", F.to_date("DateTime").alias("day")).count()
    assert sorted((r.TagID, r.day.date(), r.n) for r in spark.table("days").collect()) == sorted((r["TagID"], r["day"], r["count"]) for r in days.collect())


def test_entry_without_the_corpus_part(spark):
    import __spark_entry__ as e

    assert "gap_section" in e.queries() and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert ORDER.seq == "event_id"
