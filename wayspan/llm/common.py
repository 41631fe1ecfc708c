"""Shared helpers: table access, words, shared scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as every engine does it alike."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where that is unset and
    everything runs on this machine. On a cluster it must be set: a machine-local folder would lose tables there."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wayspan-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive the loss of executors.

    Tables that no returned result reads are dropped as soon as that is so; the rest are deleted when the driver's
    program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _roots.append(self)
        if len(_roots) == 1:
            atexit.register(_sweep)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, name: str) -> None:
        """Delete a table that no later result reads."""
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Delete all tables: no later result reads any."""
        self._delete(self.root)
        _roots.remove(self)


_roots: list[Scratch] = []


def _sweep() -> None:
    for s in list(_roots):
        try:
            s.clear()
        except Exception:  # the session is already down: the shared folder's owner clears it
            return


def bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result that must have at most ``limit`` rows by construction; more is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the documented bound")
    return rows


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions to ask for: the session's own setting, so a cluster decides."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
