"""Gap sections, late fixes and the speed filter over streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayspan.functions.geo import EARTH
from wayspan.session import ship


def sections(df: DataFrame, gap: str = "28800 seconds", late: str = "1 day") -> DataFrame:
    """Sections per tag as session windows; an interval of exactly the gap splits here, unlike in ``gap_section``."""
    d = df.withColumn("DateTime", F.col("DateTime").cast("timestamp")).withWatermark("DateTime", late)
    g = d.groupBy("TagID", F.session_window("DateTime", gap)).agg(F.count("*").alias("n"), F.min("DateTime").alias("start"), F.max("DateTime").alias("end"))
    return g.select("TagID", "start", "end", "n")


def day_counts(df: DataFrame, late: str = "1 day") -> DataFrame:
    d = df.withColumn("DateTime", F.col("DateTime").cast("timestamp")).withWatermark("DateTime", late)
    return d.groupBy("TagID", F.window("DateTime", "1 day")).agg(F.count("*").alias("n")).select("TagID", F.col("window.start").alias("day"), "n")


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, h)))


def speed_flags(df: DataFrame, limit: float = 50) -> DataFrame:
    """Fixes with speed_rm, by the speed from the last kept fix of the tag, which is the state (three numbers a tag).

    Fixes are taken in the order of their time within a batch; ones older than the state are flagged. What the batch
    filter decides by the whole section (speeds at the limit, the first round) is left out; ``ordered.ordered_tracks``
    gives the batch's very flags, once a section is closed.
    """
    key = df.schema["TagID"].dataType.simpleString()

    def step(tag: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("DateTime")
        flags = []
        for t, x, y in zip(rows["DateTime"].astype("datetime64[us]").astype("int64") / 1e6, rows["longitude"], rows["latitude"]):
            bad = last is not None and (t <= last[0] or _metres((last[1], last[2]), (x, y)) / (t - last[0]) > limit)
            flags.append(int(bad))
            if not bad:
                last = (t, x, y)
        if last is not None:
            state.update(last)
        yield rows.assign(speed_rm=flags)[["TagID", "DateTime", "longitude", "latitude", "speed_rm"]]

    ship(df.sparkSession)
    d = df.select("TagID", F.col("DateTime").cast("timestamp").alias("DateTime"), "longitude", "latitude").filter("longitude is not null and latitude is not null and DateTime is not null")
    return d.groupBy("TagID").applyInPandasWithState(step, f"TagID {key}, DateTime timestamp, longitude double, latitude double, speed_rm int", "t double, x double, y double", "append", GroupStateTimeout.NoTimeout)
