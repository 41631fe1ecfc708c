"""Registered movement-analytics queries and their DuckDB twins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.operators import checks, duplicates, enrich, movement, outliers, pipeline, rates, reports, schema, spatial, subsample, trips
from wayspan.plans.adapter import DOUBLED, ORDER, TRACK, doubled, gapped, haversine, lonlat, placed, speeds, track, utm, xy
from wayspan.sources import tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col

COLONY = (0.0, 50.5)
#: A made-up island, as lon/lat corners.
ISLAND = [(-0.2, 50.2), (0.3, 50.25), (0.35, 50.7), (0.0, 50.8), (-0.25, 50.6)]
LAND = [[geo.project_point(*p) for p in ISLAND]]


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.gap_section(placed(spark, sf_dir).select("TagID", "DateTime", "event_id", "longitude", "latitude", "satellites_used", "gps_pdop"), order=ORDER)


W = 'WINDOW w AS (PARTITION BY "TagID" ORDER BY "DateTime", event_id)'
G = f"WITH {TRACK}, {gapped()}"  # gap sections over placed fixes


@query("track_summary", f"""{G}, {speeds('gapped', True)}
SELECT "TagID", count(*) AS n_fixes, max(gapsec) AS n_sections, round(sum(dist) / 1000, 3) AS km, round(avg(traj_speed), 6) AS mean_speed, round(max(traj_speed), 6) AS max_speed FROM speeds GROUP BY "TagID" """)
def track_summary(spark, sf_dir):
    d = movement.traj_speed(_gapped(spark, sf_dir), True, ORDER)
    return d.groupBy("TagID").agg(F.count("*").alias("n_fixes"), F.max("gapsec").alias("n_sections"), F.round(F.sum("dist") / 1000, 3).alias("km"), F.round(F.avg("traj_speed"), 6).alias("mean_speed"), F.round(F.max("traj_speed"), 6).alias("max_speed"))


@query("gap_section", f'{G} SELECT "TagID", "DateTime", event_id, round(dt, 3) AS dt, gap, gapsec FROM gapped')
def gap_section(spark, sf_dir):
    return rounded(_gapped(spark, sf_dir).select("TagID", "DateTime", "event_id", "dt", "gap", "gapsec"), dt=3)


@query("gap_section_drop_single", f"""{G}, k AS (SELECT *, count(*) OVER (PARTITION BY "TagID", gapsec) AS n FROM gapped)
SELECT "TagID", event_id, gapsec, round((epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6, 3) AS dt FROM k WHERE n > 1 {W}""")
def gap_section_drop_single(spark, sf_dir):
    d = movement.gap_section(placed(spark, sf_dir), drop_single=True, order=ORDER)
    return rounded(d.select("TagID", "event_id", "gapsec", "dt"), dt=3)


@query("traj_speed", f'WITH {TRACK}, {speeds("placed")} SELECT "TagID", event_id, round(dist, 3) AS dist, round(dt, 3) AS dt, round(traj_speed, 6) AS traj_speed FROM speeds')
def traj_speed(spark, sf_dir):
    d = movement.traj_speed(placed(spark, sf_dir), order=ORDER)
    return rounded(d.select("TagID", "event_id", "dist", "dt", "traj_speed"), dist=3, dt=3, traj_speed=6)


@query("smooth_mcconnell", f"""WITH {TRACK}, {speeds('placed')}
SELECT "TagID", event_id, CASE WHEN count(traj_speed) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN
  round(sqrt(0.25 * (pow(lag(traj_speed, 2) OVER w, 2) + pow(lag(traj_speed) OVER w, 2) + pow(lead(traj_speed) OVER w, 2) + pow(lead(traj_speed, 2) OVER w, 2))), 6) END AS traj_speed_sm
FROM speeds {W}""")
def smooth_mcconnell(spark, sf_dir):
    return rounded(movement.traj_speed_sm(placed(spark, sf_dir), order=ORDER).select("TagID", "event_id", "traj_speed_sm"), traj_speed_sm=6)


@query("smooth_flexi", f"""WITH {TRACK}, {speeds('placed')}, a AS (
SELECT *, count(traj_speed) OVER f AS n, sum(traj_speed * traj_speed) OVER f AS s FROM speeds WINDOW f AS (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT "TagID", event_id, CASE WHEN n = 7 THEN round(sqrt(s / 7), 6) END AS clip, CASE WHEN n > 0 THEN round(sqrt(s / n), 6) END AS vec FROM a""")
def smooth_flexi(spark, sf_dir):
    d = placed(spark, sf_dir)
    a = movement.traj_speed_sm(d, points=3, include_centre=True, method="flexi_clip", order=ORDER).withColumnRenamed("traj_speed_sm", "clip")
    b = movement.traj_speed_sm(a.drop("dist", "dt", "traj_speed"), points=3, include_centre=True, method="flexi_vec", order=ORDER)
    return b.select("TagID", "event_id", F.round("clip", 6).alias("clip"), F.round("traj_speed_sm", 6).alias("vec"))


SPEED_LIMIT = 5.0


@query("speed_filt", f"""WITH RECURSIVE {TRACK}, {speeds('placed')}, b AS (
  SELECT "TagID", event_id, epoch_us("DateTime") AS us, longitude, latitude, traj_speed, lead(traj_speed) OVER w AS nxt,
         max(traj_speed) OVER (PARTITION BY "TagID") AS top FROM speeds {W}
), c AS (SELECT *, coalesce(top > {SPEED_LIMIT} AND traj_speed > {SPEED_LIMIT + 20} AND nxt > {SPEED_LIMIT + 20}, false) AS both_ FROM b),
d AS (SELECT *, both_ AND sum(both_::INT) OVER (PARTITION BY "TagID" ORDER BY us, event_id) = 1 AS first_ FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY "TagID" ORDER BY us, event_id) AS k FROM d WHERE NOT first_),
f("TagID", k, us, lon, lat, event_id, kept) AS (
  SELECT "TagID", k, us, longitude, latitude, event_id, true FROM e WHERE k = 1
  UNION ALL
  SELECT e."TagID", e.k, CASE WHEN x.ok THEN e.us ELSE f.us END, CASE WHEN x.ok THEN e.longitude ELSE f.lon END, CASE WHEN x.ok THEN e.latitude ELSE f.lat END, e.event_id, x.ok
  FROM f JOIN e ON e."TagID" = f."TagID" AND e.k = f.k + 1,
  LATERAL (SELECT coalesce({haversine('f.lon', 'f.lat', 'e.longitude', 'e.latitude')} / nullif((e.us - f.us) / 1e6, 0) < {SPEED_LIMIT}, true) AS ok) x
)
SELECT d."TagID", d.event_id, CASE WHEN f.kept THEN 0 ELSE 1 END AS speed_rm FROM d LEFT JOIN f ON f."TagID" = d."TagID" AND f.event_id = d.event_id""")
def speed_filt(spark, sf_dir):
    d = placed(spark, sf_dir).select("TagID", "DateTime", "event_id", "longitude", "latitude")
    return movement.speed_filt(d, SPEED_LIMIT, has_gaps=False, order=ORDER).select("TagID", "event_id", "speed_rm")


@query("speed_filt_smooth")
def speed_filt_smooth(spark, sf_dir):
    d = placed(spark, sf_dir).select("TagID", "DateTime", "event_id", "longitude", "latitude")
    return movement.speed_filt(movement.gap_section(d, order=ORDER), SPEED_LIMIT, "mcconnell", hybrid=True, order=ORDER).select("TagID", "event_id", "gapsec", "speed_rm")


@query("turn_filt", f"""{G}, h AS (SELECT *, atan2(lead(latitude) OVER w - latitude, lead(longitude) OVER w - longitude) AS h FROM gapped WINDOW w AS (PARTITION BY "TagID", gapsec ORDER BY "DateTime", event_id)),
r AS (SELECT *, h - lag(h) OVER (PARTITION BY "TagID", gapsec ORDER BY "DateTime", event_id) AS d FROM h),
a AS (SELECT *, CASE WHEN d > pi() THEN d - 2 * pi() WHEN d <= -pi() THEN d + 2 * pi() ELSE d END AS rel FROM r)
SELECT "TagID", event_id, round(rel, 6) AS rel_angle, round(abs(rel), 6) AS abs_angle, CASE WHEN rel IS NULL THEN NULL WHEN abs(rel) <= {math.pi / 4!r} THEN 1 ELSE 0 END AS angle_rm FROM a""")
def turn_filt(spark, sf_dir):
    return rounded(movement.turn_filt(_gapped(spark, sf_dir), order=ORDER).select("TagID", "event_id", "rel_angle", "abs_angle", "angle_rm"), rel_angle=6, abs_angle=6)


@query("filt_err", f"""WITH {TRACK}, f AS (SELECT "TagID", event_id,
  CASE WHEN satellites_used IS NULL THEN NULL WHEN satellites_used <= 3 OR satellites_used >= 11 THEN 1 ELSE 0 END AS satellites_used_rm,
  CASE WHEN gps_pdop IS NULL THEN NULL WHEN gps_pdop >= 30 THEN 1 ELSE 0 END AS gps_pdop_rm,
  CASE WHEN event_type IS NULL THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_rm FROM track)
SELECT *, greatest(satellites_used_rm, gps_pdop_rm, event_type_rm) AS all_rm FROM f""")
def filt_err(spark, sf_dir):
    d = checks.filt_err(track(spark, sf_dir), ["satellites_used", "gps_pdop", "event_type"], [3, None, "error"], [11, 30, None])
    return d.select("TagID", "event_id", "satellites_used_rm", "gps_pdop_rm", "event_type_rm", "all_rm")


@query("tag_spans", f"""WITH {TRACK} SELECT "TagID", event_id, CAST(longitude < -0.4 AS INT) AS minx_issue, CAST(longitude > 0.4 AS INT) AS maxx_issue, CAST(latitude < 50.1 AS INT) AS miny_issue, CAST(latitude > 50.9 AS INT) AS maxy_issue,
  CAST("DateTime" > TIMESTAMP '2024-01-28' AS INT) AS future_issue, CAST("DateTime" < TIMESTAMP '2024-01-05' - INTERVAL 2 DAY OR "DateTime" > TIMESTAMP '2024-01-20' + INTERVAL 2 DAY AS INT) AS temporal_issue FROM track""")
def tag_spans(spark, sf_dir):
    d = checks.tag_spans(track(spark, sf_dir), (-0.4, 0.4), (50.1, 50.9), ("2024-01-05", "2024-01-20"), 2, "2024-01-28", order=ORDER)
    return d.select("TagID", "event_id", *[c for c in d.columns if c.endswith("_issue")])


def _values(of: str, test: str, name: str) -> str:
    return f"array_to_string(list_transform(coalesce(list_sort(list(DISTINCT {of}) FILTER ({test})), []), lambda v: printf('%.6f', v)), ',') AS {name}"


@query("tag_spans_summary", f"""WITH {TRACK} SELECT "TagID", {_values("longitude", "longitude < -0.4", "minx")}, {_values("longitude", "longitude > 0.4", "maxx")}, {_values("latitude", "latitude < 50.1", "miny")}, {_values("latitude", "latitude > 50.9", "maxy")},
  CAST(count(DISTINCT CASE WHEN "DateTime" > TIMESTAMP '2024-01-28' THEN "DateTime" END) AS INT) AS n_future FROM track GROUP BY "TagID" """)
def tag_spans_summary(spark, sf_dir):
    d = checks.tag_spans(track(spark, sf_dir), (-0.4, 0.4), (50.1, 50.9), mode="summary", now="2024-01-28", order=ORDER)
    shown = lambda c: F.array_join(F.transform(f"{c}_issue", lambda v: F.format_string("%.6f", v)), ",").alias(c)
    return d.select("TagID", *map(shown, ("minx", "maxx", "miny", "maxy")), F.size("future_issue").alias("n_future"))


@query("column_checks", f"""WITH {TRACK} SELECT "TagID", event_id, CAST(longitude IS NULL OR latitude IS NULL AS INT) AS "NA_latlong_rm", CAST(satellites_used <= 3 AS INT) AS sat_rm, CAST(satellites_used IS NULL AS INT) AS "sat_NA",
  CASE WHEN flt_switch IS NULL OR flt_switch <> 0 THEN -99 ELSE flt_switch END AS flt_switch, CAST("Type" = 'MoveBank' AND (flt_switch IS NULL OR flt_switch <> 0) AS INT) AS flt_rm, CAST(gps_pdop >= 7 AS INT) AS gps_pdop_rm,
  CAST(count(*) OVER (PARTITION BY "TagID") < 65 AS INT) AS tid_rm, CASE WHEN longitude > -0.3 AND longitude < 0.3 AND latitude > 50.2 AND latitude < 50.8 THEN 0 ELSE 1 END AS ll_rm FROM track""")
def column_checks(spark, sf_dir):
    d = checks.precision(checks.flight_switch(checks.satellites(checks.null_position(track(spark, sf_dir)))), "gps_pdop")
    d = checks.geofence(checks.few_fixes(d, 65, order=ORDER), (-0.3, 0.3), (50.2, 50.8))
    return d.select("TagID", "event_id", "NA_latlong_rm", "sat_rm", "sat_NA", "flt_switch", "flt_rm", "gps_pdop_rm", "tid_rm", "ll_rm")


@query("day_fixes", f"""WITH {TRACK}, n AS (SELECT *, count(*) OVER (PARTITION BY "TagID", CAST("DateTime" AS DATE)) AS n FROM track)
SELECT "TagID", event_id, CAST(min(n) OVER (PARTITION BY "TagID") < 2 AS INT) AS strict_rm, CAST(n < 2 AS INT) AS granular_rm FROM n""")
def day_fixes(spark, sf_dir):
    d = checks.day_fixes(checks.day_fixes(track(spark, sf_dir), 2, True, "strict_rm", ORDER), 2, False, "granular_rm", ORDER)
    return d.select("TagID", "event_id", "strict_rm", "granular_rm")


@query("flag_summary", f"""WITH {TRACK}, f AS (SELECT "TagID", CAST(satellites_used <= 3 AS INT) AS sat_rm, CAST(gps_pdop >= 7 AS INT) AS gps_pdop_rm FROM track), l AS (SELECT "TagID", 'sat_rm' AS flag, sat_rm AS v FROM f UNION ALL SELECT "TagID", 'gps_pdop_rm', gps_pdop_rm FROM f)
SELECT "TagID", flag, CAST(coalesce(sum(CAST(v = 1 AS INT)), 0) AS BIGINT) AS n_flagged, CAST(sum(CAST(v IS NULL AS INT)) AS BIGINT) AS n_na, count(*) AS total, round(100.0 * coalesce(sum(CAST(v = 1 AS INT)), 0) / count(*), 6) AS pct FROM l GROUP BY 1, 2""")
def flag_summary(spark, sf_dir):
    d = checks.precision(checks.satellites(track(spark, sf_dir)), "gps_pdop")
    return rounded(checks.flag_summary(d, ["sat_rm", "gps_pdop_rm"], ORDER), pct=6)


@query("clean_annotate", f"""WITH {TRACK}, {gapped('track')}
SELECT "TagID", event_id, gap, gapsec, CAST(longitude IS NULL AS INT) AS "NA_latlong_rm", CAST(satellites_used <= 3 AS INT) AS sat_rm, CAST(gps_pdop >= 20 AS INT) AS gps_pdop_rm,
  CAST(count(*) OVER (PARTITION BY "TagID", gapsec) = 1 AS INT) AS singlegap_rm,
  greatest(CAST(longitude IS NULL AS INT), CAST(satellites_used <= 3 AS INT), CAST(gps_pdop >= 20 AS INT), CAST(count(*) OVER (PARTITION BY "TagID", gapsec) = 1 AS INT), 0) AS combined_rm FROM gapped""")
def clean_annotate(spark, sf_dir):
    d = pipeline.clean_track(track(spark, sf_dir), pipeline.Cleaning(pdop=20, drop_single_gap=True, dup_method=None), True, ORDER).data
    return d.select("TagID", "event_id", "gap", "gapsec", "NA_latlong_rm", "sat_rm", "gps_pdop_rm", "singlegap_rm", "combined_rm")


@query("clean_drop", f"""WITH {TRACK}, kept AS (SELECT * FROM placed WHERE (satellites_used > 3 OR satellites_used IS NULL) AND gps_pdop < 20), {gapped('kept')}
SELECT "TagID", event_id, gap, gapsec, round(dt, 3) AS dt FROM gapped""")
def clean_drop(spark, sf_dir):
    d = pipeline.clean_track(track(spark, sf_dir), pipeline.Cleaning(pdop=20, dup_method=None), False, ORDER).data
    return rounded(d.select("TagID", "event_id", "gap", "gapsec", "dt"), dt=3)


@query("stage_counts", f"""WITH {TRACK} SELECT "TagID", count(*) AS raw, CAST(sum(CAST(longitude IS NOT NULL AS INT)) AS BIGINT) AS "after_NA_latlong",
  CAST(sum(CAST(longitude IS NOT NULL AND (satellites_used IS NULL OR satellites_used > 3) AS INT)) AS BIGINT) AS after_sat FROM track GROUP BY "TagID" """)
def stage_counts(spark, sf_dir):
    d = checks.satellites(checks.null_position(track(spark, sf_dir)))
    return checks.stage_counts(d, ["NA_latlong_rm", "sat_rm"], ORDER)


@query("clean_track_full")  # its twin stands below that of parallel streams
def clean_track_full(spark, sf_dir):
    how = pipeline.Cleaning(pdop=20, min_fix=5, speed=SPEED_LIMIT, turn=math.pi / 8, spans={"xra": (-0.4, 0.4), "now": "2024-01-28"}, flt_switch=True, drop_single_gap=True)
    d = pipeline.clean_track(track(spark, sf_dir), how, True, ORDER)
    return d.data.select("TagID", "event_id", *d.attributes["flags"], "combined_rm")


BREAKS = ", ".join(f"({i}, {b * (1 + t)!r}, '{b:g}')" for i, (b, t) in enumerate(zip(rates.BREAKS, rates.TOL)))
RATES = f"""r0 AS (SELECT *, (epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6 AS dt FROM placed {W}),
r1 AS (SELECT *, max(dt) OVER () AS top FROM r0), b(i, e, label) AS (VALUES {BREAKS}),
rated AS (SELECT r1.*, CASE WHEN dt IS NULL OR dt <= (SELECT e FROM b WHERE i = 0) THEN NULL ELSE coalesce((SELECT arg_min(label, i) FROM b WHERE b.e >= r1.dt), '<' || CAST(round(top) AS BIGINT)) END AS likely_rate FROM r1)"""


@query("assign_rates", f'WITH {TRACK}, {RATES} SELECT "TagID", likely_rate, min("DateTime") AS "start", max("DateTime") AS "end", count(*) AS "N" FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1, 2')
def assign_rates(spark, sf_dir):
    return rates.assign_rates(placed(spark, sf_dir), order=ORDER)


@query("rate_tables", f"""WITH {TRACK}, {RATES}, p AS (SELECT CAST("TagID" AS VARCHAR) AS "TagID", CASE WHEN likely_rate LIKE '<%' THEN '10800+' ELSE likely_rate END AS rate, count(*) AS "N" FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1, 2),
u AS (SELECT * FROM p UNION ALL SELECT 'all', rate, CAST(sum("N") AS BIGINT) FROM p GROUP BY rate)
SELECT "TagID", rate, "N", round(100.0 * "N" / sum("N") OVER (PARTITION BY "TagID"), 6) AS pct FROM u""")
def rate_tables(spark, sf_dir):
    return rounded(rates.rate_tables(placed(spark, sf_dir), order=ORDER)["counts"], pct=6)


@query("rate_wide", f"""WITH {TRACK}, {RATES} SELECT CAST("TagID" AS VARCHAR) AS "TagID", count(*) FILTER (likely_rate = '3600') AS r3600, count(*) FILTER (likely_rate = '10800') AS r10800, count(*) FILTER (likely_rate LIKE '<%') AS over_ FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1""")
def rate_wide(spark, sf_dir):
    return rates.rate_tables(placed(spark, sf_dir), order=ORDER)["wide"].select("TagID", C("3600").alias("r3600"), C("10800").alias("r10800"), C("`10800+`").alias("over_"))


_WIDE = [f"{b:g}" for b in rates.BREAKS[1:]]
_OVER = """p AS (SELECT CAST("TagID" AS VARCHAR) AS "TagID", CASE WHEN likely_rate LIKE '<%' THEN '10800+' ELSE likely_rate END AS rate, count(*) AS "N" FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1, 2),
u AS (SELECT * FROM p UNION ALL SELECT 'all', rate, CAST(sum("N") AS BIGINT) FROM p GROUP BY rate), c AS (SELECT *, CAST(replace(rate, '+', '') AS DOUBLE) AS num, 100.0 * "N" / sum("N") OVER (PARTITION BY "TagID") AS pct FROM u)"""


@query("rate_wide_all", f"""WITH {TRACK}, {RATES} SELECT CAST("TagID" AS VARCHAR) AS "TagID", {", ".join(f"count(*) FILTER (likely_rate = '{b}') AS r{b}" for b in _WIDE)}, count(*) FILTER (likely_rate LIKE '<%') AS beyond FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1""")
def rate_wide_all(spark, sf_dir):
    d = rates.rate_tables(placed(spark, sf_dir), order=ORDER)["wide"]
    return d.select("TagID", *(C(f"`{b}`").alias(f"r{b}") for b in _WIDE), C("`10800+`").alias("beyond"))


@query("rate_over", f"""WITH {TRACK}, {RATES}, {_OVER} SELECT "TagID", rate, "N", round(pct, 6) AS pct FROM c WHERE pct > 20""")
def rate_over(spark, sf_dir):
    return rounded(rates.rate_tables(placed(spark, sf_dir), order=ORDER)["over"], pct=6)


@query("rate_text", f"""WITH {TRACK}, {RATES}, {_OVER}, f AS (SELECT "TagID", min(num) AS y FROM c WHERE pct > 20 GROUP BY 1), e AS (SELECT max(y) AS hi, min(y) AS lo FROM f),
n AS (SELECT "TagID", y, row_number() OVER (PARTITION BY y ORDER BY "TagID") AS r FROM f WHERE "TagID" <> 'all'),
k AS (SELECT y, string_agg(CASE WHEN r <= 3 THEN "TagID" ELSE '...' END, ', ' ORDER BY r) AS names FROM n WHERE r <= 4 GROUP BY y)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY "N" DESC, num, length(rate)) AS INT) AS line, row_number() OVER (ORDER BY "N" DESC, num, length(rate)) || '. ' || rate || ' s (' || format('{{:.2f}}', pct) || '% GPS fixes)' AS text FROM c WHERE "TagID" = 'all') WHERE line <= 2
UNION ALL SELECT 3, 'For animal(s) ' || names || ': 20% or more data was collected at coarser rates of ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ' s' FROM k, e WHERE y = hi
UNION ALL SELECT 4, 'For animal(s) ' || names || ': 20% or more data was collected at finer rates of ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ' s' FROM k, e WHERE y = lo
UNION ALL SELECT 5, format('{{:.2f}}', pct) || '% fixes above the max rate' FROM c WHERE "TagID" = 'all' AND rate = '10800+'
UNION ALL SELECT 6, 'Animal: ' || arg_min("TagID", (-pct, "TagID")) || ' has the greatest percentage (' || format('{{:.2f}}', max(pct)) || '%) fixes above the max rate' FROM c WHERE "TagID" <> 'all' AND rate = '10800+'""")
def rate_text(spark, sf_dir):
    return rates.rate_text(placed(spark, sf_dir), order=ORDER)


STEP = 43200


@query("subsample_rounder", f"""WITH {TRACK}, a AS (SELECT *, epoch_us("DateTime") AS us, CAST(round_even(epoch_us("DateTime") / {STEP}e6, 0) AS BIGINT) AS slot FROM placed),
b AS (SELECT *, row_number() OVER (PARTITION BY "TagID", slot ORDER BY abs(us - slot * {STEP}000000), us, event_id) AS r FROM a),
c AS (SELECT *, (us - lag(us) OVER (PARTITION BY "TagID" ORDER BY us, event_id)) / 1e6 AS g FROM b WHERE r = 1) SELECT "TagID", event_id FROM c WHERE g IS NULL OR g > {STEP * 0.8}""")
def subsample_rounder(spark, sf_dir):
    return subsample.rounder(placed(spark, sf_dir), STEP, order=ORDER).select("TagID", "event_id")


@query("subsample_sequencer", f"""WITH {TRACK}, t AS (SELECT "TagID", event_id, epoch_us("DateTime") AS us, year("DateTime") AS y FROM placed),
s AS (SELECT "TagID", y, min(us) AS lo, max(us) AS hi FROM t GROUP BY 1, 2), g AS (SELECT "TagID", unnest(range(lo, hi + {STEP}000000 + 1, {STEP}000000)) AS g FROM s),
p AS (SELECT g.*, t.us AS pu, t.event_id AS pe FROM g ASOF LEFT JOIN t ON g."TagID" = t."TagID" AND g.g >= t.us),
n AS (SELECT p.*, t.us AS nu, t.event_id AS ne FROM p ASOF LEFT JOIN t ON p."TagID" = t."TagID" AND p.g <= t.us),
k AS (SELECT "TagID", g, CASE WHEN nu IS NULL OR g - pu <= nu - g THEN pu ELSE nu END AS us, CASE WHEN nu IS NULL OR g - pu <= nu - g THEN pe ELSE ne END AS event_id FROM n),
d AS (SELECT DISTINCT "TagID", us, event_id FROM k), z AS (SELECT *, (us - lag(us) OVER (PARTITION BY "TagID" ORDER BY us, event_id)) / 1e6 AS gap FROM d)
SELECT "TagID", event_id FROM z WHERE gap IS NULL OR gap > {STEP * 0.8}""")
def subsample_sequencer(spark, sf_dir):
    return subsample.sequencer(placed(spark, sf_dir), STEP, order=ORDER).select("TagID", "event_id")


@query("subsample_recovered", ORACLE["subsample_rounder"].replace("SELECT \"TagID\", event_id FROM c WHERE", """, n AS (SELECT *, (lead(us) OVER w - us) / 1e6 AS nx, (us - lag(us) OVER w) / 1e6 AS pv FROM a WINDOW w AS (PARTITION BY "TagID" ORDER BY us, event_id))
SELECT "TagID", event_id FROM n WHERE nx > {high} OR pv > {high} UNION SELECT "TagID", event_id FROM c WHERE""".format(high=STEP * 1.2)))
def subsample_recovered(spark, sf_dir):
    return subsample.sub_samp(placed(spark, sf_dir), STEP, drop_coarser=False, order=ORDER).select("TagID", "event_id")


@query("subsample_boots")
def subsample_boots(spark, sf_dir):
    d = placed(spark, sf_dir)
    return subsample.retrieve_boots(d, subsample.boots(d, STEP, n_boot=3, order=ORDER), True, ORDER).select("TagID", "event_id", "level", "boot", "rn")


ASOF = """WITH {TRACK}, l AS (SELECT "TagID", "DateTime", event_id FROM track), r AS (SELECT "TagID", "DateTime" - INTERVAL 25 MINUTE AS t, longitude FROM placed),
p AS (SELECT l.*, r.t AS pt, r.longitude AS pl FROM l ASOF LEFT JOIN r ON l."TagID" = r."TagID" AND l."DateTime" >= r.t),
n AS (SELECT p.*, r.t AS nt, r.longitude AS nl FROM p ASOF LEFT JOIN r ON p."TagID" = r."TagID" AND p."DateTime" <= r.t)
SELECT "TagID", event_id, pl AS backward, nl AS forward, CASE WHEN nt IS NULL OR "DateTime" - pt <= nt - "DateTime" THEN CASE WHEN epoch_us("DateTime") - epoch_us(pt) <= 7200000000 THEN pl END ELSE CASE WHEN epoch_us(nt) - epoch_us("DateTime") <= 7200000000 THEN nl END END AS nearest FROM n""".replace("{TRACK}", TRACK)


@query("asof_join", ASOF)
def asof_join(spark, sf_dir):
    right = placed(spark, sf_dir).withColumn("DateTime", C("DateTime") - F.expr("INTERVAL 25 MINUTE")).select("TagID", "DateTime", "longitude")
    return _three_ways(track(spark, sf_dir).select("TagID", "DateTime", "event_id"), right)


def _three_ways(left, right):
    d = subsample.asof_ways(left, right, ["longitude"], {"backward": ("backward", None), "forward": ("forward", None), "nearest": ("nearest", 7200)}, ORDER)
    return d.select("TagID", "event_id", *(C(f"{w}_longitude").alias(w) for w in ("backward", "forward", "nearest")))


#: Placed fixes ten minutes later, so that a whole table meets a whole table.
LATER = "INTERVAL 10 MINUTE"


def later(spark, sf_dir):
    return placed(spark, sf_dir).withColumn("DateTime", C("DateTime") + F.expr(LATER))


@query("asof_join_all", ASOF.replace("- INTERVAL 25 MINUTE", f"+ {LATER}"))
def asof_join_all(spark, sf_dir):
    return _three_ways(track(spark, sf_dir).select("TagID", "DateTime", "event_id"), later(spark, sf_dir).select("TagID", "DateTime", "longitude"))


@query("duplicates_mark", f"""WITH {TRACK}, {DOUBLED}, d AS (SELECT *, list(DISTINCT [longitude, latitude]) OVER (PARTITION BY "TagID", "DateTime") AS places, list(DISTINCT "DateTime") OVER (PARTITION BY "TagID", longitude, latitude) AS times,
  count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude, satellites_used) AS m FROM doubled)
SELECT "TagID", event_id, CAST(len(places) > 1 AS INT) AS dup_time_rm, CAST(len(times) > 1 AS INT) AS dup_coords_rm, CAST(n > 1 AS INT) AS dup_time_coords_rm, CAST(m > 1 AS INT) AS all_dup_rm FROM d""")
def duplicates_mark(spark, sf_dir):
    return duplicates.mark(doubled(spark, sf_dir), True, ORDER).select("TagID", "event_id", "dup_time_rm", "dup_coords_rm", "dup_time_coords_rm", "all_dup_rm")


@query("duplicates_exact_last", f"""WITH {TRACK}, {DOUBLED} SELECT "TagID", max(event_id) AS event_id FROM doubled GROUP BY "TagID", "DateTime", longitude, latitude""")
def duplicates_exact_last(spark, sf_dir):
    return duplicates.resolve_exact(doubled(spark, sf_dir), "last", order=ORDER).select("TagID", "event_id")


@query("duplicates_best_quality", f"""WITH {TRACK}, {DOUBLED}, q AS (SELECT *, row_number() OVER (PARTITION BY "TagID", "DateTime" ORDER BY coalesce(satellites_used, 0) - longitude DESC, event_id) AS r FROM doubled) SELECT "TagID", event_id FROM q WHERE r = 1""")
def duplicates_best_quality(spark, sf_dir):
    return duplicates.resolve_same_time(doubled(spark, sf_dir), "best_quality", ["satellites_used", "longitude"], [1, -1], order=ORDER).select("TagID", "event_id")


@query("duplicates_centroid", f"""WITH {TRACK}, {DOUBLED} SELECT "TagID", "DateTime", min(event_id) AS event_id, round(median(longitude), 9) AS longitude, round(median(latitude), 9) AS latitude FROM doubled GROUP BY 1, 2""")
def duplicates_centroid(spark, sf_dir):
    d = duplicates.resolve_same_time(doubled(spark, sf_dir), "centroid", order=ORDER)
    return rounded(d.select("TagID", "DateTime", "event_id", "longitude", "latitude"), longitude=9, latitude=9)


@query("duplicates_numpy", ORACLE["duplicates_centroid"])  # the same medians, by numpy
def duplicates_numpy(spark, sf_dir):
    d = duplicates.resolve_same_time(doubled(spark, sf_dir), "centroid", centroid=np.median, order=ORDER)
    return rounded(d.select("TagID", "DateTime", "event_id", "longitude", "latitude"), longitude=9, latitude=9)


@query("duplicates_same_place", f"""WITH {TRACK}, {DOUBLED}, q AS (SELECT *, row_number() OVER (PARTITION BY "TagID", longitude, latitude ORDER BY "DateTime" DESC, event_id DESC) AS r FROM doubled) SELECT "TagID", event_id FROM q WHERE r = 1""")
def duplicates_same_place(spark, sf_dir):
    return duplicates.resolve_same_place(doubled(spark, sf_dir), "last", order=ORDER).select("TagID", "event_id")


@query("duplicates_rows", f'WITH {TRACK}, {DOUBLED} SELECT DISTINCT "TagID", "DateTime", longitude, latitude, satellites_used FROM doubled')
def duplicates_rows(spark, sf_dir):
    return duplicates.resolve_rows(doubled(spark, sf_dir), ORDER).drop("event_id")


PARALLEL = f"""WITH {TRACK}, {DOUBLED}, i AS (SELECT *, CASE WHEN "DateTime" < lag("DateTime") OVER (PARTITION BY "TagID" ORDER BY event_id) THEN 1 ELSE 0 END AS back FROM doubled),
j AS (SELECT *, CAST(1 + sum(back) OVER (PARTITION BY "TagID" ORDER BY event_id) AS BIGINT) AS brksec FROM i), s AS (SELECT "TagID", brksec, min("DateTime") AS lo, max("DateTime") AS hi FROM j GROUP BY 1, 2),
o AS (SELECT a."TagID", greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM s a JOIN s b ON a."TagID" = b."TagID" AND a.brksec < b.brksec AND a.lo <= b.hi AND b.lo <= a.hi),
m AS (SELECT j.*, CAST(EXISTS (SELECT 1 FROM o WHERE o."TagID" = j."TagID" AND j."DateTime" BETWEEN o.lo AND o.hi) AS INT) AS parallel_issue FROM j)"""


BLOCKS = """, b AS (SELECT *, CASE WHEN parallel_issue = 1 AND coalesce(lag(parallel_issue) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id), 0) = 0 THEN 1 ELSE 0 END AS st FROM m),
z AS (SELECT *, CASE WHEN parallel_issue = 1 THEN CAST(sum(st) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id) AS BIGINT) END AS overlap_block FROM b)"""


@query("parallel_streams", PARALLEL + BLOCKS + ' SELECT "TagID", event_id, brksec, parallel_issue, overlap_block FROM z')
def parallel_streams(spark, sf_dir):
    return duplicates.parallel_streams(doubled(spark, sf_dir), ORDER).select("TagID", "event_id", "brksec", "parallel_issue", "overlap_block")


def _full_sql() -> str:
    """All flags of ``clean_track_full``: duplicates, spans, sections, the speed filter within sections, and turns."""
    columns = '"TagID", "DateTime", longitude, latitude, satellites_used, gps_pdop, flt_switch, "Type", event_type'
    flags = """CAST(longitude IS NULL OR latitude IS NULL AS INT) AS "NA_latlong_rm", 0 AS "all_NA_rm", parallel_issue AS dup_parallel_rm, CAST(len(places) > 1 AS INT) AS dup_time_rm, CAST(n_at > 1 AS INT) AS dup_time_coords_rm, CAST(n_row > 1 AS INT) AS all_dup_rm,
  CAST(n_tag < 5 AS INT) AS tid_rm, CAST(longitude < -0.4 AS INT) AS minx_rm, CAST(longitude > 0.4 AS INT) AS maxx_rm, CAST("DateTime" > TIMESTAMP '2024-01-28' AS INT) AS future_rm, CAST(satellites_used <= 3 AS INT) AS sat_rm,
  CAST("Type" = 'MoveBank' AND (flt_switch IS NULL OR flt_switch <> 0) AS INT) AS flt_rm, CAST(gps_pdop >= 20 AS INT) AS gps_pdop_rm, CAST(count(*) OVER (PARTITION BY "TagID", gapsec) = 1 AS INT) AS singlegap_rm"""
    section = 'PARTITION BY "TagID", gapsec ORDER BY "DateTime", event_id'
    step = haversine("f.lon", "f.lat", "e.longitude", "e.latitude")
    return f"""WITH RECURSIVE {PARALLEL.removeprefix("WITH ").replace(DOUBLED + ", ", "").replace("doubled", "track")},
u AS (SELECT *, list(DISTINCT [longitude, latitude]) OVER (PARTITION BY "TagID", "DateTime") AS places, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n_at, count(*) OVER (PARTITION BY {columns}) AS n_row, count(*) OVER (PARTITION BY "TagID") AS n_all FROM m),
{gapped("u")}, fl AS (SELECT * EXCLUDE (dt), n_all AS n_tag FROM gapped), v0 AS (SELECT *, (epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6 AS dt, {haversine("longitude", "latitude", "lead(longitude) OVER w", "lead(latitude) OVER w")} AS dist FROM fl WINDOW w AS ({section})),
v1 AS (SELECT *, lag(dist / nullif(dt, 0)) OVER ({section}) AS traj_speed FROM v0), v2 AS (SELECT *, lead(traj_speed) OVER ({section}) AS nxt, max(traj_speed) OVER (PARTITION BY "TagID", gapsec) AS top FROM v1),
v3 AS (SELECT *, coalesce(top > {SPEED_LIMIT} AND traj_speed > {SPEED_LIMIT + 20} AND nxt > {SPEED_LIMIT + 20}, false) AS both_ FROM v2), v4 AS (SELECT *, both_ AND sum(both_::INT) OVER ({section}) = 1 AS first_ FROM v3),
e AS (SELECT "TagID", gapsec, event_id, epoch_us("DateTime") AS us, longitude, latitude, row_number() OVER ({section}) AS k FROM v4 WHERE NOT first_ AND longitude IS NOT NULL),
f("TagID", gapsec, k, us, lon, lat, event_id, kept) AS (
  SELECT "TagID", gapsec, k, us, longitude, latitude, event_id, true FROM e WHERE k = 1
  UNION ALL
  SELECT e."TagID", e.gapsec, e.k, CASE WHEN x.ok THEN e.us ELSE f.us END, CASE WHEN x.ok THEN e.longitude ELSE f.lon END, CASE WHEN x.ok THEN e.latitude ELSE f.lat END, e.event_id, x.ok
  FROM f JOIN e ON e."TagID" = f."TagID" AND e.gapsec = f.gapsec AND e.k = f.k + 1, LATERAL (SELECT coalesce({step} / nullif((e.us - f.us) / 1e6, 0) < {SPEED_LIMIT}, true) AS ok) x
), h AS (SELECT *, atan2(lead(latitude) OVER w - latitude, lead(longitude) OVER w - longitude) AS h FROM v4 WINDOW w AS ({section})), r AS (SELECT *, h - lag(h) OVER ({section}) AS d FROM h),
a AS (SELECT *, abs(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d <= -pi() THEN d + 2 * pi() ELSE d END) AS rel FROM r),
o2 AS (SELECT a."TagID", a.event_id, {flags.replace(" OVER (PARTITION BY \"TagID\", gapsec)", " OVER (PARTITION BY a.\"TagID\", a.gapsec)").replace("longitude", "a.longitude").replace("latitude IS", "a.latitude IS").replace("a.a.", "a.")},
  CASE WHEN a.longitude IS NULL THEN 0 WHEN f.kept THEN 0 ELSE 1 END AS speed_rm, CASE WHEN rel IS NULL THEN NULL WHEN rel <= {math.pi / 8!r} THEN 1 ELSE 0 END AS angle_rm FROM a LEFT JOIN f ON f."TagID" = a."TagID" AND f.event_id = a.event_id)
SELECT *, greatest("NA_latlong_rm", "all_NA_rm", dup_parallel_rm, dup_time_rm, dup_time_coords_rm, all_dup_rm, tid_rm, minx_rm, maxx_rm, future_rm, sat_rm, flt_rm, gps_pdop_rm, singlegap_rm, speed_rm, angle_rm) AS combined_rm FROM o2"""


ORACLE["clean_track_full"] = _full_sql()


@query("duplicates_detect", PARALLEL + """, d AS (SELECT *, list(DISTINCT [longitude, latitude]) OVER (PARTITION BY "TagID", "DateTime") AS places, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n FROM m)
SELECT "TagID", CAST(sum(CAST(len(places) > 1 AS INT)) AS BIGINT) AS same_time, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS exact, CAST(sum(parallel_issue) AS BIGINT) AS parallel FROM d GROUP BY 1""")
def duplicates_detect(spark, sf_dir):
    d = duplicates.detect(doubled(spark, sf_dir), order=ORDER)
    return d.groupBy("TagID").pivot("step", ["same_time", "exact", "parallel"]).agg(F.first("n_affected_rows"))


@query("duplicate_track")
def duplicate_track(spark, sf_dir):
    return duplicates.duplicate_track(doubled(spark, sf_dir), "random", use_coords=True, order=ORDER).select("TagID", "event_id")


@query("duplicate_track_first", PARALLEL + BLOCKS + """, y AS (SELECT *, min(brksec) OVER (PARTITION BY "TagID", overlap_block) AS best FROM z),
r1 AS (SELECT *, row_number() OVER (PARTITION BY "TagID", "DateTime", longitude, latitude ORDER BY event_id) AS n FROM y WHERE overlap_block IS NULL OR brksec = best),
r2 AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY "TagID", "DateTime" ORDER BY event_id) AS n FROM r1 WHERE n = 1),
r3 AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY "TagID", longitude, latitude ORDER BY "DateTime", event_id) AS n FROM r2 WHERE n = 1)
SELECT "TagID", event_id FROM r3 WHERE n = 1""")
def duplicate_track_first(spark, sf_dir):
    return duplicates.duplicate_track(doubled(spark, sf_dir), "first", use_coords=True, order=ORDER).select("TagID", "event_id")


@query("tabulate_history", f"""{G}, s AS (SELECT "TagID", gapsec, min("DateTime") AS a, max("DateTime") AS b, count(*) AS n FROM gapped GROUP BY 1, 2)
SELECT "TagID", min(a) AS "Start", max(b) AS "End", round((epoch_us(max(b)) - epoch_us(min(a))) / 8.64e10, 6) AS "Dur_days", CAST(sum(n) AS BIGINT) AS nfixes, round(sum(epoch_us(b) - epoch_us(a)) / 8.64e10, 6) AS "Dur_days_mon" FROM s GROUP BY 1""")
def tabulate_history(spark, sf_dir):
    return rounded(reports.tabulate_history(_gapped(spark, sf_dir), order=ORDER), Dur_days=6, Dur_days_mon=6)


def _summary_sql(text: str, more: str = "") -> str:
    return f"""WITH {TRACK}, t AS (SELECT *, (epoch_us(lead("DateTime") OVER w) - epoch_us("DateTime")) / 1e6 AS dt FROM track {W}), u AS (SELECT CAST("TagID" AS VARCHAR) AS tag, * FROM t UNION ALL SELECT 'ALL', * FROM t){more}
SELECT tag AS "TagID", count(*) AS n_records, count(DISTINCT ("TagID", "DateTime")) AS n_fixes, CAST(sum(CAST("DateTime" IS NULL AS INT)) AS BIGINT) AS "n_na_DT", min("DateTime") AS "start", max("DateTime") AS "end", round((epoch_us(max("DateTime")) - epoch_us(min("DateTime"))) / 8.64e10, 6) AS dur,
  min(longitude) AS xmin, max(longitude) AS xmax, min(latitude) AS ymin, max(latitude) AS ymax, round(avg(CAST(longitude IS NULL AS INT)), 6) AS na_lon, round(avg(CAST(latitude IS NULL AS INT)), 6) AS na_lat, round(min(dt), 3) AS gap_min, round(max(dt), 3) AS gap_max,
  round((SELECT arg_max(c.dt, (c.n, -c.dt)) FROM (SELECT x.dt, count(*) AS n FROM u x WHERE x.tag = u.tag AND x.dt IS NOT NULL GROUP BY x.dt) c), 3) AS gap_mode, {text} FROM u{' JOIN med USING (tag)' if more else ''} GROUP BY tag"""


MEDIAN = """, med AS (SELECT tag, median(dt) AS med FROM u GROUP BY tag)"""


@query("summary", _summary_sql("printf('%.2f', any_value(med)) || ' ± ' || printf('%.2f', median(abs(dt - med))) AS dt_median", MEDIAN))
def summary(spark, sf_dir):
    return rounded(reports.summary(track(spark, sf_dir), "median", "MAD", order=ORDER), dur=6, na_lon=6, na_lat=6, gap_min=3, gap_max=3, gap_mode=3)


@query("summary_mean", _summary_sql("printf('%.2f', avg(dt)) || ' ± ' || printf('%.2f', stddev_samp(dt)) || ' [' || printf('%.2f', min(dt)) || ', ' || printf('%.2f', max(dt)) || ']' AS dt_mean"))
def summary_mean(spark, sf_dir):
    return rounded(reports.summary(track(spark, sf_dir), "mean", add_ranges=True, order=ORDER), dur=6, na_lon=6, na_lat=6, gap_min=3, gap_max=3, gap_mode=3)


@query("tag_counts", f'WITH {TRACK} SELECT "TagID", count(*) AS n_row, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM track GROUP BY 1')
def tag_counts(spark, sf_dir):
    return reports.tag_counts(track(spark, sf_dir), order=ORDER)


DAYS = """d AS (SELECT DISTINCT "TagID", CAST("DateTime" AS DATE) AS day FROM track), b AS (SELECT day, count(*) AS n FROM d GROUP BY 1)"""


@query("tag_timeline", f"""WITH {TRACK}, {DAYS} SELECT "TagID", min(d.day) AS "first", max(d.day) AS "last", count(*) AS days_active, round(avg(n - 1), 6) AS mean_overlap, round(stddev_samp(n - 1), 6) AS sd_overlap, min(n - 1) AS min_overlap, max(n - 1) AS max_overlap,
  CAST(sum(CAST(n = 1 AS INT)) AS BIGINT) AS days_alone, round(count(*) / (SELECT date_diff('day', min(day), max(day)) + 1 FROM d), 6) AS prop_active, round(1 - count(*) / (date_diff('day', min(d.day), max(d.day)) + 1), 6) AS prop_missing,
  round(sum(CAST(n = 1 AS INT)) / count(*), 6) AS prop_alone, count(*) / (SELECT date_diff('day', min(day), max(day)) + 1 FROM d) < 0.5 AS low_active, sum(CAST(n = 1 AS INT)) / count(*) > 0.5 AS often_alone, 1 - count(*) / (date_diff('day', min(d.day), max(d.day)) + 1) > 0.25 AS often_missing FROM d JOIN b USING (day) GROUP BY 1""")
def tag_timeline(spark, sf_dir):
    return rounded(reports.tag_timeline(track(spark, sf_dir), order=ORDER), mean_overlap=6, sd_overlap=6, prop_active=6, prop_missing=6, prop_alone=6)


@query("day_grid", f"""WITH {TRACK}, {DAYS}, g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT "TagID", CAST("DateTime" AS DATE) AS day, count(*) AS n FROM track GROUP BY 1, 2)
SELECT t."TagID", g.day, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT "TagID" FROM track) t CROSS JOIN g LEFT JOIN n ON n."TagID" = t."TagID" AND n.day = g.day""")
def day_grid(spark, sf_dir):
    return reports.day_grid(track(spark, sf_dir), ORDER)


@query("fix_summary", f"""WITH {TRACK}, n AS (SELECT "TagID", CAST("DateTime" AS DATE) AS day, count(*) AS n FROM track GROUP BY 1, 2)
SELECT "TagID", CAST(sum(n) AS BIGINT) AS fixes, count(*) AS days, min(n) AS min_day, round(avg(n), 6) AS mean_day, max(n) AS max_day, CAST(sum(CAST(n < 2 AS INT)) AS BIGINT) AS bad_days, round(sum(CAST(n < 2 AS INT)) / count(*), 6) AS bad_prop, sum(n) < 2 AS below FROM n GROUP BY 1""")
def fix_summary(spark, sf_dir):
    return rounded(reports.fix_summary(track(spark, sf_dir), 2, ORDER), mean_day=6, bad_prop=6)


@query("null_report", f'WITH {TRACK} SELECT "TagID", CAST(sum(CAST(longitude IS NULL AS INT)) AS BIGINT) AS n_na, round(avg(CAST(longitude IS NULL AS INT)), 6) AS prop_na FROM track GROUP BY 1')
def null_report(spark, sf_dir):
    return rounded(reports.null_report(track(spark, sf_dir), ORDER), prop_na=6)


@query("satellite_report", f'WITH {TRACK} SELECT "TagID", min(satellites_used) AS "min", round(avg(satellites_used), 6) AS mean, max(satellites_used) AS "max", CAST(sum(CAST(satellites_used <= 3 AS INT)) AS BIGINT) AS n_low, CAST(sum(CAST(satellites_used IS NULL AS INT)) AS BIGINT) AS n_na FROM track GROUP BY 1')
def satellite_report(spark, sf_dir):
    return rounded(reports.satellite_report(track(spark, sf_dir), order=ORDER), mean=6)


@query("hist_transform", f'WITH {TRACK} SELECT "TagID", event_id, round(log10(gps_pdop), 6) AS gps_pdop_t FROM track WHERE gps_pdop > 0 AND gps_pdop <= 50')
def hist_transform(spark, sf_dir):
    return rounded(checks.transformed(track(spark, sf_dir), "gps_pdop", "log10", 50).select("TagID", "event_id", "gps_pdop_t"), gps_pdop_t=6)


@query("farthest_point", f"""WITH {TRACK}, o AS (SELECT *, first_value(longitude) OVER w AS ox, first_value(latitude) OVER w AS oy FROM placed {W}),
p AS (SELECT *, radians(oy) - radians(latitude) AS dp, radians(ox - longitude) AS dl, ln(tan(radians(oy) / 2 + pi() / 4) / tan(radians(latitude) / 2 + pi() / 4)) AS ds FROM o),
d AS (SELECT *, {geo.EARTH} * sqrt(dp * dp + pow(CASE WHEN abs(ds) > 1e-12 THEN dp / ds ELSE cos(radians(latitude)) END * dl, 2)) AS dist FROM p)
SELECT "TagID", arg_max(event_id, dist) AS event_id, round(max(dist), 3) AS dist FROM d GROUP BY 1""")
def farthest_point(spark, sf_dir):
    d = placed(spark, sf_dir)
    far = reports.farthest_point(d, order=ORDER)
    return rounded(far.join(d.select("TagID", "DateTime", "longitude", "event_id"), ["TagID", "DateTime", "longitude"]).select("TagID", "event_id", "dist"), dist=3)


@query("track_lines", f'{G} SELECT "TagID", gapsec, CAST(count(*) AS INT) AS n FROM gapped GROUP BY 1, 2 HAVING count(*) > 1')
def track_lines(spark, sf_dir):
    return reports.track_lines(_gapped(spark, sf_dir), ORDER).select("TagID", "gapsec", F.size("line").alias("n"))


OUT = f"WITH {TRACK}, v AS (SELECT \"TagID\", event_id, (epoch_us(lead(\"DateTime\") OVER w) - epoch_us(\"DateTime\")) / 1e6 AS dt FROM track {W})"


def _flags(method: str) -> str:
    return f"""SELECT v."TagID", v.event_id, CASE WHEN dt IS NULL THEN NULL WHEN dt > o.hi THEN 'i_u' WHEN dt < o.lo THEN 'i_l' ELSE '0' END AS outlier_i_dt_{method},
  CASE WHEN dt IS NULL THEN NULL WHEN dt > a.hi THEN 'ia_u' WHEN dt < a.lo THEN 'ia_l' ELSE '0' END AS outlier_ia_dt_{method} FROM v LEFT JOIN o USING ("TagID") CROSS JOIN a"""


def _outliers(spark, sf_dir, method):
    d = movement.time_steps(track(spark, sf_dir), ORDER)
    return outliers.outlier_flags(d, "dt", None, methods=(method,), order=ORDER).select("TagID", "event_id", f"outlier_i_dt_{method}", f"outlier_ia_dt_{method}")


@query("outlier_quantile", f"""{OUT}, o AS (SELECT "TagID", quantile_cont(dt, 0.01) AS lo, quantile_cont(dt, 0.99) AS hi FROM v GROUP BY 1), a AS (SELECT quantile_cont(dt, 0.01) AS lo, quantile_cont(dt, 0.99) AS hi FROM v) {_flags('quantile')}""")
def outlier_quantile(spark, sf_dir):
    return _outliers(spark, sf_dir, "quantile")


@query("outlier_hampel", f"""{OUT}, m AS (SELECT "TagID", median(dt) AS med FROM v GROUP BY 1), o AS (SELECT "TagID", any_value(med) - 3 * median(abs(dt - med)) AS lo, any_value(med) + 3 * median(abs(dt - med)) AS hi FROM v JOIN m USING ("TagID") GROUP BY 1),
n AS (SELECT median(dt) AS med FROM v), a AS (SELECT any_value(med) - 3 * median(abs(dt - med)) AS lo, any_value(med) + 3 * median(abs(dt - med)) AS hi FROM v CROSS JOIN n) {_flags('hampel')}""")
def outlier_hampel(spark, sf_dir):
    return _outliers(spark, sf_dir, "hampel")


def _hinges(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    sel = f"{keys}," if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return f"""(WITH r AS (SELECT *, row_number() OVER ({part} ORDER BY dt) AS r, count(*) OVER ({part}) AS n FROM v WHERE dt IS NOT NULL), p AS (SELECT *, floor((n + 3) / 2) / 2 AS d FROM r),
h AS (SELECT {sel} avg(dt) FILTER (r = floor(d) OR r = ceil(d)) AS h1, avg(dt) FILTER (r = n + 1 - floor(d) OR r = n + 1 - ceil(d)) AS h2 FROM p {group})
SELECT {sel} min(dt) FILTER (dt >= h1 - 1.5 * (h2 - h1)) AS lo, max(dt) FILTER (dt <= h2 + 1.5 * (h2 - h1)) AS hi FROM v JOIN h {on} WHERE dt IS NOT NULL {group})"""


@query("outlier_boxplot", f"""{OUT}, o AS {_hinges('"TagID"')}, a AS {_hinges('')} {_flags('boxplot')}""")
def outlier_boxplot(spark, sf_dir):
    return _outliers(spark, sf_dir, "boxplot")


@query("outlier_summary", f"""SELECT "TagID", avg(CAST(outlier_i_dt_quantile <> '0' AS INT)) AS prop_i, avg(CAST(outlier_ia_dt_quantile <> '0' AS INT)) AS prop_ia, count(outlier_i_dt_quantile) AS n,
  avg(CAST(outlier_i_dt_quantile <> '0' AS INT)) / nullif(avg(CAST(outlier_ia_dt_quantile <> '0' AS INT)), 0) AS ratio FROM ({ORACLE["outlier_quantile"]}) GROUP BY 1""")
def outlier_summary(spark, sf_dir):
    d = movement.time_steps(track(spark, sf_dir), ORDER)
    return outliers.outlier_summary(outliers.outlier_flags(d, order=ORDER), order=ORDER)


X, Y = xy()
PX, PY = geo.project_point(*COLONY)
RADIUS = 25_000


@query("projected_bounds", f'WITH {TRACK} SELECT round(min({X}), 2) AS xmin, round(min({Y}), 2) AS ymin, round(max({X}), 2) AS xmax, round(max({Y}), 2) AS ymax FROM placed')
def projected_bounds(spark, sf_dir):
    return rounded(reports.bounds(track(spark, sf_dir)), xmin=2, ymin=2, xmax=2, ymax=2)


@query("reproject", f'WITH {TRACK} SELECT "TagID", event_id, round({X}, 3) AS "X", round({Y}, 3) AS "Y" FROM track')
def reproject(spark, sf_dir):
    return rounded(enrich.project(track(spark, sf_dir)).select("TagID", "event_id", "X", "Y"), X=3, Y=3)


EDGES = ", ".join(f"({a!r}, {b!r}, {c!r}, {d!r})" for a, b, c, d in geo.edges(LAND))
COAST = f"""e(x1, y1, x2, y2) AS (VALUES {EDGES}), q AS (SELECT "TagID", event_id, {X} AS x, {Y} AS y FROM placed),
k AS (SELECT "TagID", event_id, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS onshore,
  min(sqrt(pow(x - (x1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1)), 2) + pow(y - (y1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1)), 2))) AS dist
  FROM q CROSS JOIN e GROUP BY ALL)"""


@query("offshore", f'WITH {TRACK}, {COAST} SELECT "TagID", event_id, CAST(NOT onshore AS INT) AS offshore FROM k')
def offshore(spark, sf_dir):
    return enrich.offshore(placed(spark, sf_dir), LAND).select("TagID", "event_id", "offshore")


@query("dist2coast", f'WITH {TRACK}, {COAST} SELECT "TagID", event_id, onshore, round(dist, 2) AS dist2coast FROM k')
def dist2coast(spark, sf_dir):
    return rounded(enrich.dist2coast(placed(spark, sf_dir), LAND).select("TagID", "event_id", "onshore", "dist2coast"), dist2coast=2)


# Polygons from the suppliers, on a lattice of halves, so that many points lie exactly on edges and corners: squares that
# overlap and touch, every third with a hole, every ninth with an island in the hole.
def _squares(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_suppkey AS INT) AS poly", "CAST((s_suppkey * 37) % 200 AS DOUBLE) AS x", "CAST((s_suppkey * 53) % 200 AS DOUBLE) AS y", "CAST(8 + s_suppkey % 13 AS DOUBLE) AS s", "s_suppkey % 3 = 0 AS holed", "s_suppkey % 9 = 0 AS island")
    rings = F.array(
        F.struct(F.lit(0).alias("ring"), C("x").alias("a"), C("y").alias("b"), C("s").alias("w"), F.lit(True).alias("has")),
        F.struct(F.lit(1).alias("ring"), (C("x") + 2).alias("a"), (C("y") + 2).alias("b"), (C("s") - 4).alias("w"), C("holed").alias("has")),
        F.struct(F.lit(2).alias("ring"), (C("x") + 3).alias("a"), (C("y") + 3).alias("b"), F.lit(1.0).alias("w"), C("island").alias("has")),
    )
    d = d.select("poly", F.explode(F.filter(rings, lambda r: r["has"])).alias("r"))
    corner = F.array(*(F.struct(F.lit(i).alias("seq"), (C("r.a") + p * C("r.w")).alias("x"), (C("r.b") + q * C("r.w")).alias("y")) for i, (p, q) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    return spatial.edge_table(d.select("poly", C("r.ring").alias("ring"), F.explode(corner).alias("c")).select("poly", "ring", "c.seq", "c.x", "c.y"))


def _lattice(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 460 AS DOUBLE) / 2 END AS x", "CAST((o_orderkey * 104729) % 460 AS DOUBLE) / 2 AS y")


SQUARES = """s AS (SELECT CAST(s_suppkey AS INT) AS poly, CAST((s_suppkey * 37) % 200 AS DOUBLE) AS a, CAST((s_suppkey * 53) % 200 AS DOUBLE) AS b, CAST(8 + s_suppkey % 13 AS DOUBLE) AS w, s_suppkey % 3 = 0 AS holed, s_suppkey % 9 = 0 AS island FROM supplier),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 460 AS DOUBLE) / 2 END AS x, CAST((o_orderkey * 104729) % 460 AS DOUBLE) / 2 AS y FROM orders),
j AS (SELECT id, poly, x, y, x > a AND x < a + w AND y > b AND y < b + w AS inside, x >= a AND x <= a + w AND y >= b AND y <= b + w AS closed,
  x > a + 2 AND x < a + w - 2 AND y > b + 2 AND y < b + w - 2 AS in_hole, x >= a + 2 AND x <= a + w - 2 AND y >= b + 2 AND y <= b + w - 2 AS hole_closed,
  x > a + 3 AND x < a + 4 AND y > b + 3 AND y < b + 4 AS on_island, x >= a + 3 AND x <= a + 4 AND y >= b + 3 AND y <= b + 4 AS island_closed, holed, island FROM o JOIN s ON x BETWEEN a AND a + w AND y BETWEEN b AND b + w)"""


@query("spatial_join", f"""WITH {SQUARES} SELECT id, poly FROM j WHERE closed AND (NOT (holed AND in_hole) OR (island AND island_closed))""")
def spatial_join(spark, sf_dir):
    return spatial.spatial_join(_lattice(spark, sf_dir), _squares(spark, sf_dir)).select("id", "poly")


@query("spatial_within", f"""WITH {SQUARES}, k AS (SELECT id, count(*) AS n FROM j WHERE inside AND (NOT (holed AND hole_closed) OR (island AND on_island)) GROUP BY id) SELECT o.id, coalesce(n, 0) AS n_polygons FROM o LEFT JOIN k USING (id)""")
def spatial_within(spark, sf_dir):
    return spatial.covering(_lattice(spark, sf_dir), _squares(spark, sf_dir), boundary=False).select("id", F.size("covering").cast("long").alias("n_polygons"))


# Islands around the suppliers: eight corners each, many of them overlapping, as a polygon table on the plane.
def _islands(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_suppkey AS INT) AS poly", "0 AS ring", "-0.5D + CAST((s_suppkey * 7919) % 1009 AS DOUBLE) / 1009D AS lon", "50D + CAST((s_suppkey * 104729) % 1013 AS DOUBLE) / 1013D AS lat", "0.01D + CAST(s_suppkey % 7 AS DOUBLE) / 200D AS r")
    d = d.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(7))))
    far = C("r") * F.when((C("seq") + C("poly")) % 2 == 0, 1.0).otherwise(0.55)
    x, y = geo.project(C("lon") + far * F.cos(C("seq") * math.pi / 4), C("lat") + far * 0.6 * F.sin(C("seq") * math.pi / 4))
    return spatial.edge_table(d.select("poly", "ring", "seq", x.alias("x"), y.alias("y")))


_IX, _IY = (c.replace("longitude", "vlon").replace("latitude", "vlat") for c in (X, Y))
ISLANDS = f"""v0 AS (SELECT s_suppkey AS poly, CAST(-0.5 AS DOUBLE) + CAST((s_suppkey * 7919) % 1009 AS DOUBLE) / 1009 AS lon, 50 + CAST((s_suppkey * 104729) % 1013 AS DOUBLE) / 1013 AS lat, CAST(0.01 AS DOUBLE) + CAST(s_suppkey % 7 AS DOUBLE) / 200 AS r, unnest(range(8)) AS seq FROM supplier),
v1 AS (SELECT poly, seq, lon + r * CASE WHEN (seq + poly) % 2 = 0 THEN 1 ELSE CAST(0.55 AS DOUBLE) END * cos(seq * pi() / 4) AS vlon, lat + r * CASE WHEN (seq + poly) % 2 = 0 THEN 1 ELSE CAST(0.55 AS DOUBLE) END * CAST(0.6 AS DOUBLE) * sin(seq * pi() / 4) AS vlat FROM v0),
v2 AS MATERIALIZED (SELECT poly, seq, {_IX} AS x1, {_IY} AS y1 FROM v1),
ie AS MATERIALIZED (SELECT a.poly, a.x1, a.y1, b.x1 AS x2, b.y1 AS y2 FROM v2 a JOIN v2 b ON a.poly = b.poly AND b.seq = (a.seq + 1) % 8),
iq AS MATERIALIZED (SELECT "TagID", event_id, {X} AS x, {Y} AS y FROM placed),
ip AS MATERIALIZED (SELECT "TagID", event_id, poly, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS covered,
  min(sqrt(pow(x - (x1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1)), 2) + pow(y - (y1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1)), 2))) AS dist
  FROM iq CROSS JOIN ie GROUP BY ALL)"""


@query("offshore_islands", f"""WITH {TRACK}, {ISLANDS} SELECT "TagID", event_id, CAST(NOT bool_or(covered) AS INT) AS offshore FROM ip GROUP BY ALL""")
def offshore_islands(spark, sf_dir):
    return enrich.offshore(placed(spark, sf_dir), _islands(spark, sf_dir)).select("TagID", "event_id", "offshore")


@query("dist2coast_islands", f"""WITH {TRACK}, {ISLANDS}, d AS (SELECT "TagID", event_id, bool_or(covered) AS onshore, min(dist) AS dist FROM ip GROUP BY ALL) SELECT "TagID", event_id, onshore, CASE WHEN NOT onshore THEN round(dist, 2) END AS dist_at_sea FROM d""")
def dist2coast_islands(spark, sf_dir):
    # At sea the outline of all islands together is as near as the nearest island's; on land inner edges are none, which the tests hold.
    d = enrich.dist2coast(placed(spark, sf_dir).select("TagID", "event_id", "longitude", "latitude"), _islands(spark, sf_dir))
    return d.select("TagID", "event_id", "onshore", F.when(~C("onshore"), F.round("dist2coast", 2)).alias("dist_at_sea"))


_UX, _UY = utm(31)


@query("reproject_utm", f'WITH {TRACK} SELECT "TagID", event_id, round({_UX}, 3) AS "X", round({_UY}, 3) AS "Y" FROM placed')
def reproject_utm(spark, sf_dir):
    return rounded(enrich.project(placed(spark, sf_dir), 32631).select("TagID", "event_id", "X", "Y"), X=3, Y=3)


@query("unproject", f'WITH {TRACK} SELECT "TagID", event_id, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude, round(longitude, 9) AS utm_longitude, round(latitude, 9) AS utm_latitude FROM placed')
def unproject(spark, sf_dir):
    d = placed(spark, sf_dir).select("TagID", "event_id", "longitude", "latitude")
    d = enrich.unproject(enrich.project(d), 3035, (("X", "Y", "lon", "lat"),))
    d = enrich.unproject(enrich.project(d, 32631), 32631, (("X", "Y", "utm_longitude", "utm_latitude"),))
    return rounded(d.select("TagID", "event_id", C("lon").alias("longitude"), C("lat").alias("latitude"), "utm_longitude", "utm_latitude"), longitude=9, latitude=9, utm_longitude=9, utm_latitude=9)


def _sun_sql() -> str:
    """The solar equations of ``geo.sun_times`` in SQL; seconds from 1970."""
    up = ", ".join(f"acos(CASE WHEN (sin(radians({a})) - sin(radians(latitude)) * sin(de)) / (cos(radians(latitude)) * cos(de)) BETWEEN -1 AND 1 THEN (sin(radians({a})) - sin(radians(latitude)) * sin(de)) / (cos(radians(latitude)) * cos(de)) END) AS w_{s}" for (_, s), a in geo.SUN_ALTITUDES.items())
    down = ", ".join(f"2451545 + 0.0009 + (w_{s} + lw) / (2 * pi()) + n + 0.0053 * sin(m) - 0.0069 * sin(2 * ec) AS j_{s}" for _, s in geo.SUN_ALTITUDES)
    out = ", ".join(f"(j_{s} + 0.5 - 2440588) * 86400 AS {s}, (tr - (j_{s} - tr) + 0.5 - 2440588) * 86400 AS {r}" for r, s in geo.SUN_ALTITUDES)
    return f"""s1 AS (SELECT *, epoch_us("DateTime") / 1e6 AS us, date_diff('day', DATE '1970-01-01', CAST("DateTime" AS DATE)) + 2440588 - 2451545 AS day, -radians(longitude) AS lw FROM placed),
s2 AS (SELECT *, round(day - 0.0009 - lw / (2 * pi())) AS n FROM s1), s3 AS (SELECT *, 0.0009 + lw / (2 * pi()) + n AS t0 FROM s2), s4 AS (SELECT *, radians(357.5291 + 0.98560028 * t0) AS m FROM s3),
s5 AS (SELECT *, m + radians(1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m)) + radians(102.9372) + pi() AS ec FROM s4), s6 AS (SELECT *, asin(sin(ec) * sin(radians(23.4397))) AS de, 2451545 + t0 + 0.0053 * sin(m) - 0.0069 * sin(2 * ec) AS tr FROM s5),
s7 AS (SELECT *, {up} FROM s6), s8 AS (SELECT *, {down} FROM s7), sun AS (SELECT *, {out} FROM s8)"""


@query("sun_calc", f"""WITH {TRACK}, {_sun_sql()}
SELECT "TagID", event_id, make_timestamp(CAST(round(sunrise) * 1000000 AS BIGINT)) AS sunrise, make_timestamp(CAST(round(sunset) * 1000000 AS BIGINT)) AS sunset,
  CASE WHEN us >= "nightEnd" AND us < "nauticalDawn" THEN 'ATm' WHEN us >= "nauticalDawn" AND us < dawn THEN 'NTm' WHEN us >= dawn AND us < sunrise THEN 'CTm' WHEN us >= sunrise AND us < "sunriseEnd" THEN 'SR'
  WHEN us >= "sunriseEnd" AND us < "sunsetStart" THEN 'DA' WHEN us >= "sunsetStart" AND us < sunset THEN 'SS' WHEN us >= sunset AND us < dusk THEN 'CTe' WHEN us >= dusk AND us < "nauticalDusk" THEN 'NTe'
  WHEN us >= "nauticalDusk" AND us < night THEN 'ATe' ELSE 'NI' END AS dnt FROM sun""")
def sun_calc(spark, sf_dir):
    d = enrich.sun_calc(placed(spark, sf_dir), order=ORDER)
    whole = lambda c: F.timestamp_micros((F.round(F.unix_micros(c) / 1e6) * 1_000_000).cast("long")).cast("timestamp_ntz").alias(c)
    return d.select("TagID", "event_id", whole("sunrise"), whole("sunset"), "dnt")


def _trips(spark, sf_dir):
    return trips.define_trips(_gapped(spark, sf_dir), "circ", lls=COLONY, radius=RADIUS, order=ORDER)


def _inside(rings) -> str:
    """Whether the projected fix lies in the rings, by ray casting."""
    e = ", ".join(f"[{', '.join(repr(float(v)) for v in x)}]" for x in geo.edges(rings))
    return f"len(list_filter([{e}], lambda e: coalesce((e[2] > {Y}) <> (e[4] > {Y}) AND {X} < (e[3] - e[1]) * ({Y} - e[2]) / nullif(e[4] - e[2], 0) + e[1], false))) % 2 = 1"


_CIRCLE = f"sqrt(pow({X} - {PX!r}, 2) + pow({Y} - {PY!r}, 2)) <= {RADIUS}"

TRIPS = f"""{gapped()}, c0 AS (SELECT *, CAST({_CIRCLE} AS INT) AS "Col", year("DateTime") AS "year" FROM gapped),
c1 AS (SELECT *, "Col" = 1 AND coalesce(lag("Col") OVER v = 0, false) AND coalesce(lead("Col") OVER v = 0, false) AS twice FROM c0 WINDOW v AS (PARTITION BY "TagID", "year" ORDER BY "DateTime", event_id)),
c2 AS (SELECT * EXCLUDE (twice), 0 AS extra_row FROM c1 UNION ALL SELECT * EXCLUDE (twice), 1 FROM c1 WHERE twice),
c3 AS (SELECT *, row_number() OVER (PARTITION BY "TagID", "year" ORDER BY "DateTime", event_id, extra_row) AS n FROM c2),
c4 AS (SELECT *, min(CASE WHEN "Col" = 1 THEN n END) OVER (PARTITION BY "TagID", "year") AS f, max(CASE WHEN "Col" = 1 THEN n END) OVER (PARTITION BY "TagID", "year") AS l FROM c3),
c5 AS (SELECT *, CASE WHEN "Col" = 0 AND n > f AND n < l THEN 1 ELSE 0 END AS t FROM c4),
c6 AS (SELECT *, coalesce(lead(t) OVER v, 0) AS nx, coalesce(lag(t) OVER v, 0) AS pv, coalesce(lag(gap) OVER v, 0) AS bk FROM c5 WINDOW v AS (PARTITION BY "TagID", "year" ORDER BY n)),
c7 AS (SELECT *, t = 0 AND nx = 1 AND "Col" = 1 AS st, t = 0 AND pv = 1 AND "Col" = 1 AND NOT (t = 0 AND nx = 1) AS en FROM c6),
c8 AS (SELECT *, t = 1 OR st OR en AS part, st OR (t = 1 AND pv = 0 AND NOT coalesce(lag(st) OVER (PARTITION BY "TagID", "year" ORDER BY n), false)) OR ((t = 1 OR en) AND bk = 1) AS beg FROM c7),
c9 AS (SELECT *, sum(CAST(beg AND part AS INT)) OVER (PARTITION BY "TagID", "year" ORDER BY n) AS no FROM c8),
trips AS (SELECT *, CASE WHEN part THEN CAST(no AS BIGINT) ELSE 0 END AS "tripNo" FROM c9)"""


@query("define_trips", f'WITH {TRACK}, {TRIPS} SELECT "TagID", event_id, "Col", CAST("year" AS INT) AS "year", extra_row, "tripNo" FROM trips')
def define_trips(spark, sf_dir):
    return _trips(spark, sf_dir).select("TagID", "event_id", "Col", "year", "extra_row", "tripNo")


@query("trips_rect_shape", f"""WITH {TRACK}, {TRIPS.replace(_CIRCLE, _inside([geo.rectangle(-0.2, 50.3, 0.2, 50.7)]))} SELECT "TagID", CAST(sum("Col") AS BIGINT) AS in_rect, CAST(sum(CAST({_inside(LAND)} AS INT)) AS BIGINT) AS in_shape, max("tripNo") AS trips FROM trips GROUP BY 1""")
def trips_rect_shape(spark, sf_dir):
    a = trips.define_trips(_gapped(spark, sf_dir), "rect", lls=(-0.2, 50.3, 0.2, 50.7), order=ORDER)
    b = trips.inside(a.withColumnRenamed("Col", "rect"), "shape", rings=LAND)
    return b.groupBy("TagID").agg(F.sum("rect").alias("in_rect"), F.sum("Col").alias("in_shape"), F.max("tripNo").alias("trips"))


def _trip_stats(spark, sf_dir):
    return trips.trip_stats(_trips(spark, sf_dir), nest_lls=COLONY, order=ORDER)


STATS = f"""{TRIPS}, p AS (SELECT *, {X} AS x, {Y} AS y FROM trips WHERE "tripNo" <> 0), p1 AS (SELECT *, sqrt(pow(x - {PX!r}, 2) + pow(y - {PY!r}, 2)) / 1000 AS d,
  sqrt(pow(lead(x) OVER u - x, 2) + pow(lead(y) OVER u - y, 2)) AS step FROM p WINDOW u AS (PARTITION BY "TagID", "year", "tripNo" ORDER BY "DateTime", event_id, extra_row)),
mon AS (SELECT "TagID", (epoch_us(max("DateTime")) - epoch_us(min("DateTime"))) / 8.64e10 AS tm, coalesce(sum(CASE WHEN gap = 1 THEN dt END), 0) / 86400 AS lost FROM trips GROUP BY 1),
stats AS (SELECT "TagID", CAST("year" AS INT) AS "year", "tripNo", min("DateTime") AS "Start", max("DateTime") AS "End", max(d) AS "DistMax", count(*) AS "DistN", sum(step) / 1000 AS "DistTotal",
  (epoch_us(max("DateTime")) - epoch_us(min("DateTime"))) / 3.6e9 AS "TripDur", arg_max(longitude, d) AS max_lon, arg_max(latitude, d) AS max_lat, max(CAST(gap = 1 AS INT)) AS incompl FROM p1 GROUP BY 1, 2, 3)"""


@query("trip_stats", f"""WITH {TRACK}, {STATS} SELECT s."TagID", "year", "tripNo", "Start", "End", round("DistMax", 4) AS "DistMax", "DistN", round("DistTotal", 4) AS "DistTotal", round("TripDur", 6) AS "TripDur", max_lon, max_lat, incompl,
  round(degrees(atan2(max_lon - {COLONY[0]}, max_lat - {COLONY[1]})) + CASE WHEN max_lon - {COLONY[0]} < 0 THEN 360 ELSE 0 END, 4) AS "MaxBear", round(tm, 6) AS "TotalMon", round(tm - lost, 6) AS "ActiveMon" FROM stats s JOIN mon USING ("TagID")""")
def trip_stats(spark, sf_dir):
    d = _trip_stats(spark, sf_dir).drop("col_lat", "col_lon")
    return rounded(d, DistMax=4, DistTotal=4, TripDur=6, MaxBear=4, TotalMon=6, ActiveMon=6)


@query("tabulate_trips", f"""WITH {TRACK}, {STATS}, g AS (SELECT CAST("TagID" AS VARCHAR) AS tag, CAST("year" AS VARCHAR) AS y, * FROM stats UNION ALL SELECT 'all', CAST("year" AS VARCHAR), * FROM stats UNION ALL SELECT 'all', 'all', * FROM stats)
SELECT tag AS "TagID", y AS "year", CAST(sum(CAST(incompl = 0 AS INT)) AS BIGINT) AS complete, CAST(sum(CAST(incompl = 1 AS INT)) AS BIGINT) AS incomplete FROM g GROUP BY 1, 2""")
def tabulate_trips(spark, sf_dir):
    return trips.tabulate_trips(_trip_stats(spark, sf_dir), "year", order=ORDER).select("TagID", "year", "complete", "incomplete")


def _cells(how: str, digits: int = 2) -> str:
    """The formatted cells of complete trips."""
    out = []
    for name, v in (("DistMax", '"DistMax"'), ("DistTotal", '"DistTotal"'), ("TripDur", '"TripDur" / 24')):
        v = f"CASE WHEN incompl IS NULL OR incompl = 0 THEN {v} END"
        f = lambda x: f"printf('%.{digits}f', {x})"
        q = lambda p, v=v: f(f"quantile_cont({v}, {p})")  # noqa: B023, E731
        cell = f"{f(f'avg({v})')} || '±' || coalesce({f(f'stddev_samp({v})')}, 'NA') || ' (' || {f(f'max({v})')} || ')'" if how == "means" else f"{q(0.5)} || ' (' || {q(0.25)} || ',' || {q(0.75)} || ') [' || {f(f'max({v})')} || ']'"
        out.append(f'CASE WHEN count({v}) > 0 THEN {cell} END AS "{name}"')
    return ", ".join(out)


TABLE = ORACLE["tabulate_trips"].replace("AS incomplete FROM g", "AS incomplete, {cells} FROM g")


@query("tabulate_trips_text", TABLE.replace("{cells}", _cells("boxplot")))
def tabulate_trips_text(spark, sf_dir):
    return trips.tabulate_trips(_trip_stats(spark, sf_dir), "year", option="boxplot", order=ORDER)


@query("tabulate_trips_means", TABLE.replace("{cells}", _cells("means")))
def tabulate_trips_means(spark, sf_dir):
    return trips.tabulate_trips(_trip_stats(spark, sf_dir), "year", option="means", order=ORDER)


@query("flatten_stacks", f"""WITH {TRACK}, s AS (SELECT "TagID" || '_stack_' || event_type AS "TagID", event_id FROM track) SELECT "TagID", count(*) AS n FROM s GROUP BY 1""")
def flatten_stacks(spark, sf_dir):
    return schema.flatten_stacks(track(spark, sf_dir).withColumnRenamed("event_type", "stack")).groupBy("TagID").agg(F.count("*").alias("n"))


@query("tspeed_jit")
def tspeed_jit(spark, sf_dir):
    return movement.tspeed_jit(placed(spark, sf_dir), nsim=5, order=ORDER)


@query("resample_path", f"""WITH {TRACK}, q AS (SELECT "TagID", "DateTime", event_id, {X} AS x, {Y} AS y FROM placed), l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM q {W}),
d AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS leg FROM l), a AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
g AS (SELECT *, unnest(CASE WHEN leg IS NULL THEN CASE WHEN floor(pos / 5000) * 5000 = pos THEN [CAST(floor(pos / 5000) AS BIGINT)] ELSE [] END ELSE range(CAST(ceil(pos / 5000) AS BIGINT), CAST(ceil((pos + leg) / 5000) AS BIGINT)) END) AS step FROM a),
p AS (SELECT "TagID", step, x + coalesce((x2 - x) * (step * 5000 - pos) / leg, 0) AS px, y + coalesce((y2 - y) * (step * 5000 - pos) / leg, 0) AS py FROM g), r AS (SELECT *, atan2(lead(py) OVER v - py, lead(px) OVER v - px) AS an FROM p WINDOW v AS (PARTITION BY "TagID" ORDER BY step))
SELECT "TagID", step, round(px, 2) AS "X", round(py, 2) AS "Y", round(an, 5) AS angle, round(px - 50 * cos(an + pi() / 6), 2) AS left_x, round(py - 50 * sin(an + pi() / 6), 2) AS left_y, round(px - 50 * cos(an - pi() / 6), 2) AS right_x, round(py - 50 * sin(an - pi() / 6), 2) AS right_y FROM r""")
def resample_path(spark, sf_dir):
    d = movement.arrow_heads(movement.resample_path(enrich.project(placed(spark, sf_dir)), 5000, ORDER))
    return rounded(d, X=2, Y=2, angle=5, left_x=2, left_y=2, right_x=2, right_y=2)


def _customer_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_custkey AS TagID", "o_orderdate AS DateTime", "o_orderkey AS event_id", "CAST(o_totalprice AS DOUBLE) AS longitude", "CAST(o_custkey AS DOUBLE) AS latitude")


@query("orders_gap_section", f"""WITH src AS (SELECT o_custkey AS "TagID", o_orderdate AS "DateTime", o_orderkey AS event_id FROM orders), {gapped('src', 86400 * 30)} SELECT "TagID", count(*) AS n, max(gapsec) AS sections, CAST(sum(gap) AS BIGINT) AS gaps FROM gapped GROUP BY 1""")
def orders_gap_section(spark, sf_dir):
    d = movement.gap_section(_customer_orders(spark, sf_dir), 86400 * 30, order=ORDER)
    return d.groupBy("TagID").agg(F.count("*").alias("n"), F.max("gapsec").alias("sections"), F.sum("gap").alias("gaps"))


@query("time_windows", f"""WITH {TRACK} SELECT "TagID", event_id FROM track WHERE ("TagID" % 3 = 0 OR "DateTime" >= TIMESTAMP '2024-01-05') AND ("TagID" % 2 = 0 OR "DateTime" <= TIMESTAMP '2024-01-20')""")
def time_windows(spark, sf_dir):
    t = track(spark, sf_dir)
    b = t.select("TagID").distinct().selectExpr("TagID", "CASE WHEN TagID % 3 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2024-01-05 00:00:00' END AS start", "CASE WHEN TagID % 2 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2024-01-20 00:00:00' END AS end")
    return checks.time_windows(t, b, ORDER).select("TagID", "event_id")


@query("pressure_merge", f"""WITH {TRACK}, a AS (SELECT "TagID", "DateTime", event_id FROM track), p AS (SELECT "TagID", CASE WHEN event_id % 2 = 0 THEN "DateTime" ELSE "DateTime" + INTERVAL 10 MINUTE END AS "DateTime", gps_pdop AS pressure, gps_pdop * 2 AS temperature FROM track)
SELECT "TagID", "DateTime", event_id, pressure, temperature FROM a FULL OUTER JOIN p USING ("TagID", "DateTime")""")
def pressure_merge(spark, sf_dir):
    t = track(spark, sf_dir)
    p = t.selectExpr("TagID", "CASE WHEN event_id % 2 = 0 THEN DateTime ELSE DateTime + INTERVAL 10 MINUTE END AS DateTime", "gps_pdop AS pressure_avg", "gps_pdop * 2 AS temp_avg")
    return tracks.merge_pressure(t.select("TagID", "DateTime", "event_id"), p, ORDER)


@query("session_animals", """SELECT c_custkey AS "TagID", n_nationkey AS project_id, CASE WHEN c_custkey = 7 THEN 'FRANCE' ELSE n_name END AS station_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE CASE WHEN c_custkey = 7 THEN 'FRANCE' ELSE n_name END IN ('FRANCE', 'GERMANY')""")
def session_animals(spark, sf_dir):
    sessions = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS TagID", "c_nationkey AS project_id")
    projects = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS project_id", "n_name AS station_name")
    return tracks.animals(sessions, projects, ["FRANCE", "GERMANY"], {"7": "FRANCE"}).select("TagID", "project_id", "station_name")


@query("source_finish", f"""WITH {TRACK}, k AS (SELECT *, count(*) OVER (PARTITION BY "TagID") AS n FROM placed WHERE satellites_used > 3), {speeds('k')}
SELECT "TagID", "DateTime", round({X}, 3) AS "X", round({Y}, 3) AS "Y", round(dist, 3) AS dist, round(traj_speed, 6) AS traj_speed FROM speeds WHERE n >= 40""")
def source_finish(spark, sf_dir):
    d = tracks.finish(track(spark, sf_dir), 3, 40, order=ORDER)
    return rounded(d.select("TagID", "DateTime", "X", "Y", "dist", "traj_speed"), X=3, Y=3, dist=3, traj_speed=6)


@query("archive_names", f"""WITH {TRACK} SELECT "TagID" AS individual_local_identifier, "DateTime" AS "timestamp", longitude AS location_long, latitude AS location_lat, satellites_used AS gps_satellite_count FROM track""")
def archive_names(spark, sf_dir):
    return tracks.to_archive(track(spark, sf_dir).select("TagID", "DateTime", "longitude", "latitude", "satellites_used"))


@query("rate_top", f"""WITH {TRACK}, {RATES}, p AS (SELECT CAST("TagID" AS VARCHAR) AS "TagID", CASE WHEN likely_rate LIKE '<%' THEN '10800+' ELSE likely_rate END AS rate, count(*) AS "N" FROM rated WHERE likely_rate IS NOT NULL GROUP BY 1, 2),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY "TagID" ORDER BY "N" DESC, rate) AS INT) AS rank FROM p) SELECT * FROM q WHERE rank <= 2""")
def rate_top(spark, sf_dir):
    return rates.rate_tables(placed(spark, sf_dir), order=ORDER)["top"]


@query("speed_flag", f'WITH {TRACK}, {speeds("placed")} SELECT "TagID", event_id, CASE WHEN traj_speed IS NULL THEN NULL WHEN traj_speed >= {SPEED_LIMIT} THEN 1 ELSE 0 END AS speed_rm FROM speeds')
def speed_flag(spark, sf_dir):
    return checks.speed_flag(movement.traj_speed(placed(spark, sf_dir), order=ORDER), SPEED_LIMIT).select("TagID", "event_id", "speed_rm")


@query("voltage_position", f"""WITH {TRACK}, v AS (SELECT "TagID", "DateTime", gps_pdop AS vbat FROM track), r AS (SELECT "TagID", "DateTime" - INTERVAL 25 MINUTE AS t, longitude, latitude FROM placed),
p AS (SELECT v.*, r.t AS pt, r.longitude AS px, r.latitude AS py FROM v ASOF LEFT JOIN r ON v."TagID" = r."TagID" AND v."DateTime" >= r.t), n AS (SELECT p.*, r.t AS nt, r.longitude AS nx, r.latitude AS ny FROM p ASOF LEFT JOIN r ON p."TagID" = r."TagID" AND p."DateTime" <= r.t),
k AS (SELECT *, nt IS NULL OR "DateTime" - pt <= nt - "DateTime" AS back FROM n), z AS (SELECT *, CASE WHEN back THEN epoch_us("DateTime") - epoch_us(pt) ELSE epoch_us(nt) - epoch_us("DateTime") END AS off FROM k)
SELECT "TagID", "DateTime", vbat, CASE WHEN off <= 7200000000 THEN CASE WHEN back THEN px ELSE nx END END AS longitude, CASE WHEN off <= 7200000000 THEN CASE WHEN back THEN py ELSE ny END END AS latitude FROM z""")
def voltage_position(spark, sf_dir):
    v = schema.to_voltage(track(spark, sf_dir), vbat="gps_pdop").drop("vsll")
    return subsample.track_at_voltage(v, placed(spark, sf_dir).withColumn("DateTime", C("DateTime") - F.expr("INTERVAL 25 MINUTE")), 7200, schema.ORDER)


@query("voltage_position_all", ORACLE["voltage_position"].replace("- INTERVAL 25 MINUTE", f"+ {LATER}"))
def voltage_position_all(spark, sf_dir):
    v = schema.to_voltage(track(spark, sf_dir), vbat="gps_pdop").drop("vsll")
    return subsample.track_at_voltage(v, later(spark, sf_dir), 7200, schema.ORDER)


@query("time_windows_all", ORACLE["time_windows"].replace('"TagID" % 3 = 0 OR ', ""))
def time_windows_all(spark, sf_dir):
    t = track(spark, sf_dir)
    b = t.select("TagID").distinct().selectExpr("TagID", "TIMESTAMP_NTZ '2024-01-05 00:00:00' AS start", "CASE WHEN TagID % 2 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2024-01-20 00:00:00' END AS end")
    return checks.time_windows(t, b, ORDER).select("TagID", "event_id")


@query("pressure_merge_all", ORACLE["pressure_merge"].replace("ELSE \"DateTime\" + INTERVAL 10 MINUTE END", "ELSE \"DateTime\" END"))
def pressure_merge_all(spark, sf_dir):
    t = track(spark, sf_dir)
    return tracks.merge_pressure(t.select("TagID", "DateTime", "event_id"), t.selectExpr("TagID", "DateTime", "gps_pdop AS pressure_avg", "gps_pdop * 2 AS temp_avg"), ORDER)


@query("all_null", f'WITH {TRACK} SELECT "TagID", event_id, CAST(longitude IS NULL AND latitude IS NULL AND satellites_used IS NULL AS INT) AS "all_NA_rm" FROM track')
def all_null(spark, sf_dir):
    return checks.all_null(track(spark, sf_dir), ["longitude", "latitude", "satellites_used"]).select("TagID", "event_id", "all_NA_rm")


@query("hdop", f'WITH {TRACK} SELECT "TagID", event_id, CAST(gps_pdop / 2 >= 7 AS INT) AS gps_hdop_rm FROM track')
def hdop(spark, sf_dir):
    return checks.precision(track(spark, sf_dir).withColumn("gps_hdop", C("gps_pdop") / 2), "gps_hdop").select("TagID", "event_id", "gps_hdop_rm")


@query("clean_custom", f"""WITH {TRACK} SELECT "TagID", event_id, CASE WHEN event_type IS NULL THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_rm, CASE WHEN gps_pdop IS NULL THEN NULL WHEN gps_pdop <= 1 OR gps_pdop >= 40 THEN 1 ELSE 0 END AS gps_pdop_rm,
  CAST(count(*) OVER (PARTITION BY "TagID") < 65 AS INT) AS tid_rm FROM track""")
def clean_custom(spark, sf_dir):
    how = pipeline.Cleaning(dup_method=None, sat_check=False, custom=(["event_type", "gps_pdop"], ["error", 1], [None, 40]), min_fix=65, min_fix_when="after_all")
    return pipeline.clean_track(track(spark, sf_dir), how, True, ORDER).data.select("TagID", "event_id", "event_type_rm", "gps_pdop_rm", "tid_rm")


def _mean3(i, v):
    """A smoother of one's own: mean of a speed and its neighbours, of those there are."""
    import numpy as np

    around = np.vstack([np.r_[np.nan, v[:-1]], v, np.r_[v[1:], np.nan]])
    n = (~np.isnan(around)).sum(0)
    return np.where(n > 0, np.nansum(around, 0) / np.maximum(n, 1), np.nan)


@query("smooth_custom", f"""WITH {TRACK}, {speeds('placed')} SELECT "TagID", event_id, round(avg(traj_speed) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS traj_speed_sm FROM speeds""")
def smooth_custom(spark, sf_dir):
    d = movement.traj_speed_sm(placed(spark, sf_dir).select("TagID", "DateTime", "event_id", "longitude", "latitude"), fun=_mean3, order=ORDER)
    return d.select("TagID", "event_id", F.round(F.nanvl("traj_speed_sm", F.lit(None).cast("double")), 6).alias("traj_speed_sm"))


@query("smooth_flexi_no_centre", f"""WITH {TRACK}, {speeds('placed')}, a AS (SELECT *, lag(traj_speed, 2) OVER w AS a, lag(traj_speed) OVER w AS b, lead(traj_speed) OVER w AS c, lead(traj_speed, 2) OVER w AS d FROM speeds {W}),
z AS (SELECT "TagID", event_id, list_filter([a, b, c, d], lambda v: v IS NOT NULL) AS v FROM a)
SELECT "TagID", event_id, CASE WHEN len(v) = 4 THEN round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / 4), 4) END AS clip, CASE WHEN len(v) > 0 THEN round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 4) END AS vec FROM z""")
def smooth_flexi_no_centre(spark, sf_dir):
    d = placed(spark, sf_dir)
    a = movement.traj_speed_sm(d, method="flexi_clip", order=ORDER).withColumnRenamed("traj_speed_sm", "clip")
    b = movement.traj_speed_sm(a.drop("dist", "dt", "traj_speed"), method="flexi_vec", order=ORDER)
    return b.select("TagID", "event_id", F.round("clip", 4).alias("clip"), F.round("traj_speed_sm", 4).alias("vec"))


@query("turn_filt_greater", ORACLE["turn_filt"].replace(f"abs(rel) <= {math.pi / 4!r}", f"abs(rel) > {math.pi / 2!r}"))
def turn_filt_greater(spark, sf_dir):
    d = movement.turn_filt(_gapped(spark, sf_dir), math.pi / 2, "greater_than", order=ORDER)
    return rounded(d.select("TagID", "event_id", "rel_angle", "abs_angle", "angle_rm"), rel_angle=6, abs_angle=6)


SENSOR = """s AS (SELECT user_id AS "TagID", ts AS "DateTime", event_id, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20')"""


def _sensor(spark, sf_dir, **columns):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS TagID", "ts AS DateTime", "event_id", "value AS v")
    return d.withColumns({k: F.expr(v) for k, v in columns.items()})


TIMES = {"start": "2024-01-05", "end": "2024-01-20"}


@query("read_acceleration", f'WITH {SENSOR} SELECT "TagID", "DateTime", event_id AS "index", v AS x_acceleration, v * 2 AS y_acceleration, -v AS z_acceleration FROM s')
def read_acceleration(spark, sf_dir):
    return tracks.read_acceleration(_sensor(spark, sf_dir, index="event_id", x_acceleration="v", y_acceleration="v * 2", z_acceleration="-v"), **TIMES, order=ORDER)


@query("read_pressure", f'WITH {SENSOR} SELECT "TagID", "DateTime", event_id AS id, v AS pressure_avg, v / 2 AS temp_avg FROM s')
def read_pressure(spark, sf_dir):
    return tracks.read_pressure(_sensor(spark, sf_dir, id="event_id", pressure_avg="v", temp_avg="v / 2"), **TIMES, order=ORDER)


@query("read_pressure_raw", f'WITH {SENSOR} SELECT "TagID", "DateTime", event_id AS burst_id, 0 AS flag, 1 AS point_seq, v AS p, v / 2 AS t FROM s')
def read_pressure_raw(spark, sf_dir):
    return tracks.read_pressure(_sensor(spark, sf_dir, burst_id="event_id", flag="0", point_seq="1", p="v", t="v / 2"), "raw", **TIMES, order=ORDER)


@query("read_voltage", f'WITH {SENSOR} SELECT "TagID", "DateTime", v AS vsll, v * 3 AS vbat FROM s')
def read_voltage(spark, sf_dir):
    return tracks.read_voltage(_sensor(spark, sf_dir, vsll="v", vbat="v * 3"), **TIMES, order=ORDER)


@query("read_voltage_comm", f'WITH {SENSOR} SELECT "TagID", "DateTime", v AS vbat, event_id AS bytes_communicated FROM s')
def read_voltage_comm(spark, sf_dir):
    return tracks.read_voltage(_sensor(spark, sf_dir, vbat="v", bytes_communicated="event_id"), "comm", **TIMES, order=ORDER)


@query("station_names", "SELECT 'K' || n_nationkey AS key_name, n_name AS station_name, n_nationkey AS project_id FROM nation")
def station_names(spark, sf_dir):
    return tracks.station_names(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('K', n_nationkey) AS key_name", "n_name AS station_name", "n_nationkey AS project_id"))


@query("tracking_files", 'SELECT o_custkey AS "TagID", o_orderkey AS file FROM orders WHERE o_custkey IN (1, 4, 7)')
def tracking_files(spark, sf_dir):
    return tracks.tracking_files(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS TagID", "o_orderkey AS file"), [1, 4, 7])


@query("tag_ids", f'WITH {TRACK} SELECT DISTINCT event_type AS stack, "TagID" FROM track')
def tag_ids(spark, sf_dir):
    return schema.tag_ids(track(spark, sf_dir).withColumnRenamed("event_type", "stack"), stack_col="stack")


@query("simplify", f'WITH {TRACK} SELECT "TagID", "DateTime", longitude, latitude, gps_pdop FROM track')
def simplify(spark, sf_dir):
    return schema.simplify(track(spark, sf_dir), ("gps_pdop",))


@query("restack", f'WITH {TRACK} SELECT event_type AS "TagID", "Type" AS stack, count(*) AS n FROM track GROUP BY 1, 2')
def restack(spark, sf_dir):
    return schema.restack(track(spark, sf_dir), "event_type", "Type").groupBy("TagID", "stack").agg(F.count("*").alias("n"))


@query("split_stack", f'WITH {TRACK} SELECT "Type", count(*) AS n, min(event_id) AS first_id FROM track GROUP BY 1')
def split_stack(spark, sf_dir):
    parts = schema.split(track(spark, sf_dir), "Type", ["MoveBank", "own"])
    whole = schema.stack(*parts.values(), names=list(parts))
    return whole.groupBy(C("stack").alias("Type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


PATTERNS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yy HH:mm", "yyyy-MM-dd HH:mm:ss", "yy-MM-dd HH:mm")


@query("parse_times", "SELECT event_id, date_trunc(CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'minute' END, ts) AS \"DateTime\" FROM events")
def parse_times(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.coalesce(*[F.when(C("event_id") % 4 == i, F.date_format(C("ts").cast("timestamp"), p)) for i, p in enumerate(PATTERNS)])
    return d.select("event_id", tracks.parse_time(text).cast("timestamp_ntz").alias("DateTime"))


def _coastal(spark, sf_dir):
    return enrich.dist2coast(enrich.offshore(_trips(spark, sf_dir), LAND), LAND)


def _nests(spark, sf_dir):
    """A nest for two tags of three, by year; the rest fall back to the mean."""
    return placed(spark, sf_dir).select("TagID").distinct().filter("TagID % 3 <> 0").selectExpr("TagID", "2024 AS year", "CAST(TagID % 10 AS DOUBLE) / 20D - 0.25D AS longitude", "50.4D + CAST(TagID % 7 AS DOUBLE) / 70D AS latitude")


NESTS = """nests AS (SELECT DISTINCT "TagID", CAST("TagID" % 10 AS DOUBLE) / 20 - CAST(0.25 AS DOUBLE) AS home_x, CAST(50.4 AS DOUBLE) + CAST("TagID" % 7 AS DOUBLE) / 70 AS home_y FROM placed WHERE "TagID" % 3 <> 0),
home AS (SELECT t."TagID", coalesce(home_x, (SELECT avg(home_x) FROM nests)) AS home_x, coalesce(home_y, (SELECT avg(home_y) FROM nests)) AS home_y FROM (SELECT DISTINCT "TagID" FROM placed) t LEFT JOIN nests n ON n."TagID" = t."TagID")"""


def _stats_sql(place: str, before: str = "") -> str:
    return f"""WITH {TRACK}, {TRIPS}, {COAST}{before}, p AS (SELECT t.*, {X.replace("longitude", "t.longitude").replace("latitude", "t.latitude")} AS x, {Y.replace("longitude", "t.longitude").replace("latitude", "t.latitude")} AS y, k.onshore, k.dist AS coast FROM trips t JOIN k ON k."TagID" = t."TagID" AND k.event_id = t.event_id WHERE "tripNo" <> 0),
{place}
SELECT "TagID", CAST("year" AS INT) AS "year", "tripNo", round(max(d), 4) AS "DistMax", count(*) AS "DistN", round(max(CASE WHEN NOT onshore THEN d END), 4) AS "DistMax_off", round(max(CASE WHEN onshore THEN d END), 4) AS "DistMax_on", CAST(arg_max(NOT onshore, d) AS INT) AS "DistalPointOff",
  round(max(coast), 2) AS "DistCoastMax", round(max(CASE WHEN NOT onshore THEN coast END), 2) AS "DistCoastMax_off", round(max(CASE WHEN onshore THEN coast END), 2) AS "DistCoastMax_on" FROM o GROUP BY ALL"""


def _coast_stats(spark, sf_dir, more=None, **place):
    d = trips.trip_stats(_coastal(spark, sf_dir), order=ORDER, **place)
    d = d.select("TagID", "year", "tripNo", "DistMax", "DistN", "DistMax_off", "DistMax_on", "DistalPointOff", "DistCoastMax", "DistCoastMax_off", "DistCoastMax_on", *(more or {}))
    return rounded(d, **(more or {}), DistMax=4, DistMax_off=4, DistMax_on=4, DistCoastMax=2, DistCoastMax_off=2, DistCoastMax_on=2)


@query("trip_stats_nests", _stats_sql(f"""o AS (SELECT p.*, {haversine('longitude', 'latitude', 'home_x', 'home_y', geo.MEAN_EARTH)} / 1000 AS d FROM p JOIN home USING ("TagID"))""", ", " + NESTS))
def trip_stats_nests(spark, sf_dir):
    return _coast_stats(spark, sf_dir, nest=_nests(spark, sf_dir))


@query("trip_stats_first_fix", _stats_sql(f"""c AS (SELECT *, first_value(longitude) OVER w AS home_x, first_value(latitude) OVER w AS home_y FROM p WINDOW w AS (PARTITION BY "TagID", "year", "tripNo" ORDER BY "DateTime", event_id, extra_row)),
o AS (SELECT *, {haversine('longitude', 'latitude', 'home_x', 'home_y', geo.MEAN_EARTH)} / 1000 AS d FROM c)"""))
def trip_stats_first_fix(spark, sf_dir):
    return _coast_stats(spark, sf_dir)


_RING = ", ".join(f"({i}, CAST({x!r} AS DOUBLE), CAST({y!r} AS DOUBLE))" for i, (x, y) in enumerate(LAND[0]))
_CLON, _CLAT = lonlat("cx", "cy")
#: The island's centre of mass by the shoelace formula, about its first corner, and back in degrees.
CENTRE = f"""rv(i, x, y) AS (VALUES {_RING}), rs AS (SELECT a.x - o.x AS p1, a.y - o.y AS q1, b.x - o.x AS p2, b.y - o.y AS q2, o.x AS ox, o.y AS oy FROM rv a JOIN rv b ON b.i = (a.i + 1) % {len(LAND[0])} JOIN rv o ON o.i = 0),
rc AS (SELECT ox + sum((p1 + p2) * (p1 * q2 - p2 * q1)) / (3 * sum(p1 * q2 - p2 * q1)) AS cx, oy + sum((q1 + q2) * (p1 * q2 - p2 * q1)) / (3 * sum(p1 * q2 - p2 * q1)) AS cy FROM rs GROUP BY ox, oy),
centre AS (SELECT cx, cy, {_CLON} AS clon, {_CLAT} AS clat FROM rc)"""


@query("trip_stats_shape", _stats_sql("o AS (SELECT p.*, clon, clat, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) / 1000 AS d FROM p, centre)", ", " + CENTRE).replace(
    "FROM o GROUP BY ALL", ', round(arg_max(longitude, d), 6) AS max_lon, round(arg_max(latitude, d), 6) AS max_lat, round(any_value(clon), 7) AS col_lon, round(any_value(clat), 7) AS col_lat, round(degrees(atan2(arg_max(longitude, d) - any_value(clon), arg_max(latitude, d) - any_value(clat))) + CASE WHEN arg_max(longitude, d) < any_value(clon) THEN 360 ELSE 0 END, 5) AS "MaxBear" FROM o GROUP BY ALL'))
def trip_stats_shape(spark, sf_dir):
    return _coast_stats(spark, sf_dir, more=dict(max_lon=6, max_lat=6, col_lon=7, col_lat=7, MaxBear=5), rings=LAND)


_RX, _RY = lonlat("px", "py")


@query("resample_degrees", f"""WITH {TRACK}, q AS (SELECT "TagID", "DateTime", event_id, {X} AS x, {Y} AS y FROM placed), l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM q {W}),
d AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS leg FROM l), a AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY "TagID" ORDER BY "DateTime", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
g AS (SELECT *, unnest(CASE WHEN leg IS NULL THEN CASE WHEN floor(pos / 5000) * 5000 = pos THEN [CAST(floor(pos / 5000) AS BIGINT)] ELSE [] END ELSE range(CAST(ceil(pos / 5000) AS BIGINT), CAST(ceil((pos + leg) / 5000) AS BIGINT)) END) AS step FROM a),
p AS (SELECT "TagID", step, x + coalesce((x2 - x) * (step * 5000 - pos) / leg, 0) AS px, y + coalesce((y2 - y) * (step * 5000 - pos) / leg, 0) AS py FROM g), r AS (SELECT *, atan2(lead(py) OVER v - py, lead(px) OVER v - px) AS an FROM p WINDOW v AS (PARTITION BY "TagID" ORDER BY step)), h AS (SELECT *, px - 50 * cos(an + pi() / 6) AS qx, py - 50 * sin(an + pi() / 6) AS qy, px - 50 * cos(an - pi() / 6) AS sx, py - 50 * sin(an - pi() / 6) AS sy FROM r)
SELECT "TagID", step, round({_RX}, 5) AS longitude, round({_RY}, 5) AS latitude, round({_RX.replace("px", "qx").replace("py", "qy")}, 5) AS left_lon, round({_RY.replace("px", "qx").replace("py", "qy")}, 5) AS left_lat, round({_RX.replace("px", "sx").replace("py", "sy")}, 5) AS right_lon, round({_RY.replace("px", "sx").replace("py", "sy")}, 5) AS right_lat FROM h""")
def resample_degrees(spark, sf_dir):
    d = movement.arrow_heads(movement.resample_path(enrich.project(placed(spark, sf_dir)), 5000, ORDER))
    d = enrich.unproject(d, 3035, (("X", "Y", "longitude", "latitude"), ("left_x", "left_y", "left_lon", "left_lat"), ("right_x", "right_y", "right_lon", "right_lat")))
    return rounded(d.select("TagID", "step", "longitude", "latitude", "left_lon", "left_lat", "right_lon", "right_lat"), longitude=5, latitude=5, left_lon=5, left_lat=5, right_lon=5, right_lat=5)


@query("trips_made_shape", f'WITH {TRACK}, {gapped()} SELECT "TagID", event_id, CAST({_inside([trips.make_shape("circ", COLONY, RADIUS)])} AS INT) AS "Col" FROM gapped')
def trips_made_shape(spark, sf_dir):
    return trips.inside(_gapped(spark, sf_dir), "shape", rings=[trips.make_shape("circ", COLONY, RADIUS)]).select("TagID", "event_id", "Col")


@query("come_and_go", f'WITH {TRACK}, {TRIPS} SELECT "TagID", count(*) AS n, CAST(sum(extra_row) AS BIGINT) AS extra FROM trips GROUP BY 1')
def come_and_go(spark, sf_dir):
    t = _trips(spark, sf_dir)
    return trips.add_cag(trips.reset_cag(t), trips.get_cag(t)).groupBy("TagID").agg(F.count("*").alias("n"), F.sum("extra_row").alias("extra"))


@query("affected_rows", PARALLEL + """, d AS (SELECT *, list(DISTINCT [longitude, latitude]) OVER (PARTITION BY "TagID", "DateTime") AS places, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude, satellites_used) AS r FROM m)
SELECT "TagID", event_id, 'same_time' AS step FROM d WHERE len(places) > 1 UNION ALL SELECT "TagID", event_id, 'exact' FROM d WHERE n > 1 UNION ALL SELECT "TagID", event_id, 'full_row' FROM d WHERE r > 1 UNION ALL SELECT "TagID", event_id, 'parallel' FROM d WHERE parallel_issue = 1""")
def affected_rows(spark, sf_dir):
    return duplicates.affected_rows(doubled(spark, sf_dir), order=ORDER).select("TagID", "event_id", "step")


@query("is_duplicated", PARALLEL + """, d AS (SELECT *, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n FROM m)
SELECT 'exact' AS step, bool_or(n > 1) AS issue_detected FROM d""")
def is_duplicated(spark, sf_dir):
    return duplicates.is_duplicated(doubled(spark, sf_dir), "exact", ORDER)


@query("duplicates_average_time", f"""WITH {TRACK}, {DOUBLED} SELECT "TagID", longitude, latitude, count(*) AS n, min("DateTime") AS first_time FROM (SELECT "TagID", longitude, latitude, min("DateTime") AS "DateTime" FROM doubled GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def duplicates_average_time(spark, sf_dir):
    d = duplicates.resolve_same_place(doubled(spark, sf_dir), "avg_time", order=ORDER, time_fun=F.min)
    return d.groupBy("TagID", "longitude", "latitude").agg(F.count("*").alias("n"), F.min("DateTime").alias("first_time"))


@query("quality_report", f"""WITH {TRACK}, n AS (SELECT count(DISTINCT "TagID") AS n FROM track) SELECT * FROM (SELECT 'spans' AS report, n FROM n UNION ALL SELECT 'na', n FROM n UNION ALL SELECT 'timeline', n FROM n UNION ALL SELECT 'satellites', n FROM n UNION ALL SELECT 'duplicates', n * 4 FROM n)""")
def quality_report(spark, sf_dir):
    found = reports.quality_report(track(spark, sf_dir), ("spans", "na", "timeline", "satellites", "duplicates"), ORDER, xra=(-0.4, 0.4))
    one = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("report"), "n") for k, d in found.items()]
    return schema.reduce(lambda a, b: a.unionByName(b), one)


# The contents of the quality report, one query each beside those of spans and timeline.
def _quality(spark, sf_dir, name):
    return reports.quality_report(doubled(spark, sf_dir) if name == "duplicates" else track(spark, sf_dir), (name,), ORDER)[name]


@query("report_na", f"""WITH {TRACK} SELECT "TagID", CAST(sum(CAST(longitude IS NULL OR latitude IS NULL AS INT)) AS BIGINT) AS n_na, round(avg(CAST(longitude IS NULL OR latitude IS NULL AS INT)), 6) AS prop_na FROM track GROUP BY 1""")
def report_na(spark, sf_dir):
    return rounded(_quality(spark, sf_dir, "na"), prop_na=6)


@query("report_satellites", f"""WITH {TRACK} SELECT "TagID", min(satellites_used) AS "min", round(avg(satellites_used), 6) AS "mean", max(satellites_used) AS "max", CAST(count(*) FILTER (satellites_used <= 3) AS BIGINT) AS n_low, CAST(count(*) FILTER (satellites_used IS NULL) AS BIGINT) AS n_na FROM track GROUP BY 1""")
def report_satellites(spark, sf_dir):
    return rounded(_quality(spark, sf_dir, "satellites"), mean=6)


@query("report_rates", f"""WITH {TRACK}, {RATES.replace("FROM placed", "FROM track")}, {_OVER} SELECT "TagID", rate, "N", round(pct, 6) AS pct FROM c""")
def report_rates(spark, sf_dir):
    return rounded(_quality(spark, sf_dir, "rates"), pct=6)


@query("report_duplicates", PARALLEL + """, d AS (SELECT *, list(DISTINCT [longitude, latitude]) OVER (PARTITION BY "TagID", "DateTime") AS places, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude) AS n, count(*) OVER (PARTITION BY "TagID", "DateTime", longitude, latitude, satellites_used) AS r FROM m),
l AS (SELECT "TagID", 'same_time' AS step, len(places) > 1 AS f, NULL AS seg FROM d UNION ALL SELECT "TagID", 'exact', n > 1, NULL FROM d UNION ALL SELECT "TagID", 'full_row', r > 1, NULL FROM d UNION ALL SELECT "TagID", 'parallel', parallel_issue = 1, brksec FROM d)
SELECT "TagID", step, bool_or(f) AS issue_detected, count(*) FILTER (f) AS n_affected_rows, count(DISTINCT seg) FILTER (f) AS n_segments FROM l GROUP BY 1, 2""")
def report_duplicates(spark, sf_dir):
    return _quality(spark, sf_dir, "duplicates")


@query("pressure_calibration", f"""WITH {TRACK} SELECT DISTINCT "TagID", CAST("TagID" % 7 AS DOUBLE) AS c1, CAST("TagID" % 11 AS DOUBLE) AS c6, 'x' || "TagID" AS tracker_id FROM track""")
def pressure_calibration(spark, sf_dir):
    d = track(spark, sf_dir).select("TagID").distinct().selectExpr("TagID", *(f"CAST(TagID % {6 + i} AS DOUBLE) AS c{i}" for i in (1, 2, 3, 4)), "CAST(TagID % 3 AS DOUBLE) AS c5", "CAST(TagID % 11 AS DOUBLE) AS c6", "concat('x', TagID) AS tracker_id", "1 AS more")
    return tracks.read_pressure(d, "calibration").select("TagID", "c1", "c6", "tracker_id")


@query("trips_flag", f"""WITH {TRACK} SELECT "TagID", event_id, CASE WHEN flt_switch = 1 THEN 1 ELSE 0 END AS by_flag, CAST(flt_switch IS NOT DISTINCT FROM 1 OR {_CIRCLE} AS INT) AS either, CAST(flt_switch IS NOT DISTINCT FROM 1 AND {_CIRCLE} AS INT) AS both_ FROM placed""")
def trips_flag(spark, sf_dir):
    d = placed(spark, sf_dir).select("TagID", "event_id", "longitude", "latitude", "flt_switch")
    d = trips.inside(d, "flag", flag="flt_switch").withColumnRenamed("Col", "by_flag")
    d = trips.inside(d, "circ", lls=COLONY, radius=RADIUS, flag="flt_switch", flag_option="maximal").withColumnRenamed("Col", "either")
    d = trips.inside(d, "circ", lls=COLONY, radius=RADIUS, flag="flt_switch", flag_option="minimal").withColumnRenamed("Col", "both_")
    return d.select("TagID", "event_id", "by_flag", "either", "both_")


@query("transformed_scales", f"""WITH {TRACK} SELECT "TagID", event_id, round(ln(gps_pdop), 9) AS ln, round(sqrt(gps_pdop), 9) AS "sqrt" FROM track WHERE gps_pdop > 0 AND gps_pdop <= 50""")
def transformed_scales(spark, sf_dir):
    d = track(spark, sf_dir).select("TagID", "event_id", "gps_pdop")
    name = [c for c in checks.transformed(d, "gps_pdop", "log", 50).columns if c not in d.columns]
    a = checks.transformed(d, "gps_pdop", "log", 50)
    b = checks.transformed(d, "gps_pdop", "sqrt", 50)
    at = name[0] if name else "gps_pdop"
    return rounded(a.select("TagID", "event_id", C(at).alias("ln")).join(b.select("event_id", C(at).alias("sqrt")), "event_id"), ln=9, sqrt=9)


@query("boot_rate")
def boot_rate(spark, sf_dir):
    return subsample.sub_samp(placed(spark, sf_dir), 6, "hours", "boot_rate", rate_l=4, n_boot=2, strict=False, order=ORDER)
