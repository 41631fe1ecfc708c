"""Session construction shared by tests, the bench and scripts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wayspan", cpus: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A local UTC session; a cluster's own settings win when one is already running."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WAYSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once, into the folder that driver and executors share (spark.checkpoint.dir); a temporary one
    only where that is unset and everything runs on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="wayspan-")
        atexit.register(shutil.rmtree, d, True)
        sc.setCheckpointDir(d)
    return df.checkpoint()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    d = tempfile.mkdtemp(prefix="wayspan-")  # the file server reads it as long as the application runs
    atexit.register(shutil.rmtree, d, True)
    path = os.path.join(d, f"wayspan-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in (n for n in names if n.endswith(".py")):
                f = os.path.join(top, n)
                z.write(f, os.path.relpath(f, os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
