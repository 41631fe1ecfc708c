"""A store of tracks by tag and time: bucketed, sorted tables that windows by tag read without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.operators.schema import ORDER, Order


def save_store(df: DataFrame, table: str, buckets: int | None = None, path: str | None = None, order: Order = ORDER) -> None:
    """Write ``df`` as a table bucketed by tag and sorted by tag and time, one file a bucket.

    ``buckets`` defaults to the session's shuffle partitions. A tag is in one bucket, so choose as many as keep the largest
    about even; what reads it by tag, or joins it with a table of as many buckets, needs no exchange.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartition(n, F.col(order.key)).write.mode("overwrite").format("parquet").bucketBy(n, order.key).sortBy(order.key, *order.by)
    (w.option("path", path) if path else w).saveAsTable(table)


def read_store(spark: SparkSession, table: str, tags: list | None = None, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    """The table, or some tags (whose buckets alone are read) and times (pushed to the scan)."""
    d = spark.table(table)
    if tags:
        d = d.filter(F.col(order.key).isin(tags))
    if start:
        d = d.filter(F.col(order.time) >= F.lit(start).cast("timestamp"))
    return d.filter(F.col(order.time) <= F.lit(end).cast("timestamp")) if end else d
