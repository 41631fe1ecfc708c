"""Reading and writing tracks: files, databases, and column names of other layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions.geo import project
from wayspan.functions.times import datetime
from wayspan.operators.checks import time_windows
from wayspan.operators.movement import traj_speed
from wayspan.operators.schema import ORDER, Order, add_wide_columns, to_voltage

C = F.col

#: Names in the public animal-movement archive's exports, and ours.
ARCHIVE_NAMES = {
    "individual.local.identifier": "TagID", "individual_local_identifier": "TagID", "timestamp": "DateTime", "location.long": "longitude", "location_long": "longitude", "location.lat": "latitude", "location_lat": "latitude",
    "ground.speed": "speed_2d", "ground_speed": "speed_2d", "gps.satellite.count": "satellites_used", "gps_satellite_count": "satellites_used", "gps.time.to.fix": "gps_fixtime", "gps_time_to_fix": "gps_fixtime",
    "gps.pdop": "gps_pdop", "gps.hdop": "gps_hdop", "height.above.msl": "altitude", "height_above_msl": "altitude", "heading": "direction", "flt.switch": "flt_switch", "tag.voltage": "tag_voltage", "tag_voltage": "tag_voltage", "external_temperature": "temperature",
}


def rename_archive(df: DataFrame) -> DataFrame:
    """Our names for the archive's; several spellings of one column are coalesced."""
    by: dict[str, list[str]] = {}
    for c in df.columns:
        by.setdefault(ARCHIVE_NAMES.get(c, c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{o}`") for o in old]).alias(new) for new, old in by.items()])


def finish(df: DataFrame, drop_sats: int | None = None, min_data: int = 5, drop_switch: bool = False, reduced: bool = True, order: Order = ORDER) -> DataFrame:
    """What all track sources do: null positions and repeated times out, X, Y, dist, dt, traj_speed in, tags with fewer
    than ``min_data`` fixes out, in the wide layout."""
    d = df.filter("longitude is not null and latitude is not null").dropDuplicates([order.key, order.time])
    if "flt_switch" in d.columns:
        d = d.withColumn("flt_switch", F.when(C("flt_switch").isNull() | (C("flt_switch") != 0), -99).otherwise(C("flt_switch")))
        if drop_switch:
            d = d.filter("flt_switch <> -99")
    if drop_sats is not None and "satellites_used" in d.columns:
        d = d.filter(C("satellites_used") > drop_sats)
    x, y = project(C("longitude"), C("latitude"))
    d = traj_speed(d.withColumns({"X": x, "Y": y}), order=order)
    d = d.withColumn("__n", F.count("*").over(order.whole())).filter(C("__n") >= min_data).drop("__n")
    return add_wide_columns(d) if reduced else d


def read_tracks(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, tags: list | None = None, bounds: DataFrame | None = None, text_time: bool = False, archive: bool = False, order: Order = ORDER, **how) -> DataFrame:
    """Tracks from files; tag and time filters reach the scan."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    d = (r.schema(schema) if schema else r).load(path)
    d = rename_archive(d) if archive else d
    if text_time:
        d = d.withColumn(order.time, datetime(C(order.time)))
    if tags:
        d = d.filter(C(order.key).isin(tags))
    return finish(time_windows(d, bounds, order) if bounds is not None else d, order=order, **how)


def jdbc_table(spark: SparkSession, url: str, dbtable: str, ranges: list[tuple[str, str]] | None = None, options: dict | None = None, order: Order = ORDER, quote: str = '"') -> DataFrame:
    """A database table; with ``ranges`` of times (from, before) it is read by one connection each, side by side. ``quote``
    is the database's mark around names, which keeps their capitals."""
    r = spark.read.options(**(options or {}))
    if not ranges:
        return r.format("jdbc").options(url=url, dbtable=dbtable).load()
    time = f"{quote}{order.time}{quote}"
    parts = [f"{time} >= '{a}' AND {time} < '{b}'" for a, b in ranges]
    return r.jdbc(url, dbtable, predicates=parts)


def read_tracks_jdbc(spark: SparkSession, url: str, dbtable: str, tags: list | None = None, start: str | None = None, end: str | None = None, ranges: list[tuple[str, str]] | None = None, options: dict | None = None, order: Order = ORDER, **how) -> DataFrame:
    """Tracks from a database table over JDBC; tag and time predicates are pushed to it. ``ranges`` of times are read
    side by side; so are ranges of a numeric column by Spark's own ``partitionColumn`` among the ``options``."""
    return finish(_picked(jdbc_table(spark, url, dbtable, ranges, options, order), tags, start, end, order), order=order, **how)


def read_sensor(spark: SparkSession, path: str, kind: str, form: str | None = None, fmt: str = "parquet", schema: str | None = None, tags: list | None = None, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    """Acceleration, pressure or voltage tables from files; filters and columns reach the scan."""
    r = spark.read.format(fmt)
    r = r.option("header", True) if fmt == "csv" else r
    d = (r.schema(schema) if schema else r).load(path)
    if kind == "acceleration":
        return read_acceleration(d, tags, start, end, order)
    return {"pressure": read_pressure, "voltage": read_voltage}[kind](d, form or {"pressure": "mean", "voltage": "energy"}[kind], tags, start, end, order)


def merge_pressure(track: DataFrame, pressure: DataFrame, order: Order = ORDER) -> DataFrame:
    """Tracks and pressure readings of equal tag and time in one row, either kept without the other."""
    p = pressure.select(order.key, order.time, C("pressure_avg").alias("pressure"), C("temp_avg").alias("temperature"))
    return track.drop("pressure", "temperature").join(p, [order.key, order.time], "full_outer")


def read_acceleration(df: DataFrame, tags: list | None = None, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    """Acceleration bursts by tag, time and index; whoever writes them sorts them."""
    d = _picked(df, tags, start, end, order)
    return d.select(order.key, order.time, "index", "x_acceleration", "y_acceleration", "z_acceleration")


PRESSURE_FORMS = {
    "mean": ("TagID", "DateTime", "id", "pressure_avg", "temp_avg"),
    "raw": ("TagID", "DateTime", "burst_id", "flag", "point_seq", "p", "t"),
    "calibration": ("TagID", "c1", "c2", "c3", "c4", "c5", "c6", "tracker_id"),
}


def read_pressure(df: DataFrame, form: str = "mean", tags: list | None = None, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    d = _picked(df, tags, None if form == "calibration" else start, None if form == "calibration" else end, order)
    return d.select(*PRESSURE_FORMS[form])


def read_voltage(df: DataFrame, form: str = "energy", tags: list | None = None, start: str | None = None, end: str | None = None, order: Order = ORDER) -> DataFrame:
    d = _picked(df, tags, start, end, order)
    return to_voltage(d, "vsll", "vbat") if form == "energy" else d.select("TagID", "DateTime", "vbat", "bytes_communicated")


def _picked(df: DataFrame, tags: list | None, start: str | None, end: str | None, order: Order) -> DataFrame:
    if tags:
        df = df.filter(C(order.key).isin(tags))
    if start:
        df = df.filter(C(order.time) >= F.lit(start).cast("timestamp"))
    return df.filter(C(order.time) <= F.lit(end).cast("timestamp")) if end else df


def animals(sessions: DataFrame, projects: DataFrame, stations: list[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Sessions with their projects; ``overrides`` sets the station of single tags."""
    d = sessions.join(projects, "project_id")
    if overrides:
        d = d.withColumn("station_name", F.coalesce(*[F.when(C("TagID").cast("string") == t, F.lit(s)) for t, s in overrides.items()], C("station_name")))
    return d.filter(C("station_name").isin(stations)) if stations else d


def station_names(projects: DataFrame) -> DataFrame:
    return projects.select("key_name", "station_name", "project_id")


def tracking_files(files: DataFrame, tags: list | None = None) -> DataFrame:
    return files.filter(C("TagID").isin(tags)) if tags else files


def to_archive(df: DataFrame, rename_pdop: bool = True, rename_hdop: bool = True, rename_fixtime: bool = True) -> DataFrame:
    """The archive's column names, for export."""
    names = {"TagID": "individual_local_identifier", "DateTime": "timestamp", "longitude": "location_long", "latitude": "location_lat", "speed_2d": "ground_speed", "satellites_used": "gps_satellite_count", "altitude": "height_above_msl", "direction": "heading"}
    names |= {a: b for a, b, on in (("gps_pdop", "gps_pdop_value", rename_pdop), ("gps_hdop", "gps_hdop_value", rename_hdop), ("gps_fixtime", "gps_time_to_fix", rename_fixtime)) if on}
    return df.withColumnsRenamed(names)


def write_tracks(df: DataFrame, path: str, fmt: str = "parquet", key: str = "TagID", archive: bool = False) -> None:
    """A folder per tag."""
    d = to_archive(df) if archive else df
    d.repartition(key if not archive else "individual_local_identifier").write.mode("overwrite").format(fmt).partitionBy(key if not archive else "individual_local_identifier").save(path)


def parse_time(text: Column, **how) -> Column:
    return datetime(text, **how)
