"""A track table over the shared test tables: events stand in for fixes, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.operators.schema import Order

ORDER = Order(seq="event_id")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "user_id AS TagID",
        "ts AS DateTime",
        "event_id",
        "CASE WHEN event_id % 101 = 0 THEN NULL ELSE -0.5D + CAST((event_id * 7919 + user_id * 104729) % 100003 AS DOUBLE) / 100003D END AS longitude",
        "CASE WHEN event_id % 101 = 0 THEN NULL ELSE 50D + CAST((event_id * 6007 + user_id * 15485863) % 100019 AS DOUBLE) / 100019D END AS latitude",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS satellites_used",
        "value AS gps_pdop",
        "CASE WHEN event_id % 17 = 0 THEN 1D WHEN event_id % 19 = 0 THEN NULL ELSE 0D END AS flt_switch",
        "CASE WHEN user_id % 2 = 0 THEN 'MoveBank' ELSE 'own' END AS Type",
        "event_type",
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with a position."""
    return track(spark, sf_dir).filter("longitude IS NOT NULL")


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats: every 5th fix at the same time elsewhere, every 7th whole."""
    t = placed(spark, sf_dir).drop("gps_pdop", "flt_switch", "Type", "event_type")
    n = F.lit(10_000_000)
    moved = t.filter("event_id % 5 = 0").withColumns({"longitude": F.col("longitude") + 0.25, "event_id": F.col("event_id") + n})
    same = t.filter("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + n * 2)
    later = t.filter("event_id % 9 = 0").withColumns({"DateTime": F.expr("DateTime + INTERVAL 1 HOUR"), "event_id": F.col("event_id") + n * 3})
    return t.unionByName(moved).unionByName(same).unionByName(later)


TRACK = """
track AS (
  SELECT user_id AS "TagID", ts AS "DateTime", event_id,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(-0.5 AS DOUBLE) + CAST((event_id * 7919 + user_id * 104729) % 100003 AS DOUBLE) / CAST(100003 AS DOUBLE) END AS longitude,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(50 AS DOUBLE) + CAST((event_id * 6007 + user_id * 15485863) % 100019 AS DOUBLE) / CAST(100019 AS DOUBLE) END AS latitude,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS satellites_used,
         value AS gps_pdop,
         CASE WHEN event_id % 17 = 0 THEN CAST(1 AS DOUBLE) WHEN event_id % 19 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END AS flt_switch,
         CASE WHEN user_id % 2 = 0 THEN 'MoveBank' ELSE 'own' END AS "Type", event_type
  FROM events
), placed AS (SELECT * FROM track WHERE longitude IS NOT NULL)"""

DOUBLED = """
t0 AS (SELECT "TagID", "DateTime", event_id, longitude, latitude, satellites_used FROM placed),
doubled AS (
  SELECT * FROM t0
  UNION ALL SELECT "TagID", "DateTime", event_id + 10000000, longitude + 0.25, latitude, satellites_used FROM t0 WHERE event_id % 5 = 0
  UNION ALL SELECT "TagID", "DateTime", event_id + 20000000, longitude, latitude, satellites_used FROM t0 WHERE event_id % 7 = 0
  UNION ALL SELECT "TagID", "DateTime" + INTERVAL 1 HOUR, event_id + 30000000, longitude, latitude, satellites_used FROM t0 WHERE event_id % 9 = 0
)"""


def gapped(source: str = "placed", gap: float = 28800, tol: float = 0.2) -> str:
    """CTEs g0, g1 and gapped: gap sections over a source CTE."""
    limit = gap * (1 + tol)
    return f"""
g0 AS (
  SELECT *, (epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6 AS dt,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY "TagID") AS n_tag
  FROM {source} WINDOW w AS (PARTITION BY "TagID" ORDER BY "DateTime", event_id)
), g1 AS (SELECT *, CASE WHEN dt IS NULL OR dt > {limit} THEN 1 ELSE 0 END AS e FROM g0),
gapped AS (
  SELECT * EXCLUDE (e, rn, n_tag), CASE WHEN rn = 1 AND n_tag > 1 THEN 0 ELSE e END AS gap,
         CAST(1 + coalesce(sum(e) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gapsec
  FROM g1
)"""


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6378137.0) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {radius} * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END))"


def speeds(source: str, within: bool = False) -> str:
    """CTEs s0 and speeds: dist, dt and traj_speed over a source CTE."""
    part = '"TagID", gapsec' if within else '"TagID"'
    return f"""
s0 AS (
  SELECT * {'EXCLUDE (dt)' if within else ''}, {haversine('longitude', 'latitude', 'lead(longitude) OVER w', 'lead(latitude) OVER w')} AS dist,
         (epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6 AS dt
  FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY "DateTime", event_id)
), speeds AS (
  SELECT *, lag(dist / nullif(dt, 0)) OVER (PARTITION BY {part} ORDER BY "DateTime", event_id) AS traj_speed FROM s0
)"""


def xy(lon: str = "longitude", lat: str = "latitude") -> tuple[str, str]:
    """Projected coordinates (EPSG:3035) in SQL."""
    from wayspan.functions import geo as g

    s = f"sin(radians({lat}))"
    q = f"({1 - g._E2!r} * ({s} / (1 - {g._E2!r} * {s} * {s}) - ln((1 - {g._E!r} * {s}) / (1 + {g._E!r} * {s})) / {2 * g._E!r}))"
    b, d = f"asin({q} / {g._QP!r})", f"(radians({lon}) - {g._LON0!r})"
    import math

    sb, cb = math.sin(g._B0), math.cos(g._B0)
    k = f"({g._RQ!r} * sqrt(2 / (1 + {sb!r} * sin({b}) + {cb!r} * cos({b}) * cos({d}))))"
    return f"({g._FE!r} + {k} * {g._D!r} * cos({b}) * sin({d}))", f"({g._FN!r} + {k} / {g._D!r} * ({cb!r} * sin({b}) - {sb!r} * cos({b}) * cos({d})))"


def lonlat(x: str, y: str) -> tuple[str, str]:
    """Degrees of EPSG:3035 coordinates in SQL: the authalic latitude, then its series and one step of Newton's."""
    import math

    from wayspan.functions import geo as g

    e2, e, sb, cb = g._E2, g._E, math.sin(g._B0), math.cos(g._B0)
    dx, dy = f"(({x} - {g._FE!r}) / {g._D!r})", f"(({y} - {g._FN!r}) * {g._D!r})"
    rho = f"sqrt({dx} * {dx} + {dy} * {dy})"
    c = f"(2 * asin({rho} / {2 * g._RQ!r}))"
    b = f"asin(cos({c}) * {sb!r} + {dy} * sin({c}) * {cb!r} / coalesce(nullif({rho}, 0), 1))"
    s1, s2, s3 = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360
    lat = f"({b} + {s1!r} * sin(2 * {b}) + {s2!r} * sin(4 * {b}) + {s3!r} * sin(6 * {b}))"
    w = f"(1 - {e2!r} * sin({lat}) * sin({lat}))"
    off = f"({g._QP!r} * sin({b}) / {1 - e2!r} - sin({lat}) / {w} + ln((1 - {e!r} * sin({lat})) / (1 + {e!r} * sin({lat}))) / {2 * e!r})"
    lon = f"{g._LON0!r} + atan2({dx} * sin({c}), {rho} * {cb!r} * cos({c}) - {dy} * {sb!r} * sin({c}))"
    return f"degrees({lon})", f"degrees({lat} + {w} * {w} / (2 * cos({lat})) * {off})"


def utm(zone: int, lon: str = "longitude", lat: str = "latitude") -> tuple[str, str]:
    """UTM coordinates (WGS84, north) in SQL."""
    import math

    f = 1 / 298.257223563
    e, n = math.sqrt(f * (2 - f)), f / (2 - f)
    k = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    atanh = lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"
    sinh, cosh = (lambda v: f"((exp({v}) - exp(-{v})) / 2)"), (lambda v: f"((exp({v}) + exp(-{v})) / 2)")
    s, d = f"sin(radians({lat}))", f"radians({lon} - ({6 * zone - 183}))"
    t = sinh(f"({atanh(s)} - {e!r} * {atanh(f'({e!r} * {s})')})")
    xi, eta = f"atan2({t}, cos({d}))", atanh(f"(sin({d}) / sqrt(1 + {t} * {t}))")
    north = " + ".join([xi, *(f"{c!r} * sin({2 * j} * {xi}) * {cosh(f'({2 * j} * {eta})')}" for j, c in enumerate(a, 1))])
    east = " + ".join([eta, *(f"{c!r} * cos({2 * j} * {xi}) * {sinh(f'({2 * j} * {eta})')}" for j, c in enumerate(a, 1))])
    return f"(500000 + {k!r} * ({east}))", f"({k!r} * ({north}))"
