"""Land, coast and daylight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.functions.crs import Crs
from wayspan.operators import spatial
from wayspan.operators.schema import ORDER, Order
from wayspan.session import settled

C = F.col


def project(df: DataFrame, crs: int = 3035) -> DataFrame:
    """Adds X and Y, the position on the plane of an EPSG code (see ``functions.crs``)."""
    return Crs(crs).add(df, [("longitude", "latitude", "X", "Y")])


def unproject(df: DataFrame, crs: int = 3035, pairs: tuple[tuple[str, str, str, str], ...] = (("X", "Y", "longitude", "latitude"),)) -> DataFrame:
    """Adds degrees to columns on the plane: each of ``pairs`` names (x, y, longitude, latitude)."""
    return Crs(crs).add(df, list(pairs), back=True)


Land = DataFrame | list


def _placed(df: DataFrame, crs: int) -> DataFrame:
    return Crs(crs).add(df, [("longitude", "latitude", "__x", "__y")])


def _near(land: Land, box: tuple[float, float, float, float] | None, buffer: float) -> Land:
    if not box:
        return land
    if isinstance(land, DataFrame):
        return spatial.crop(land, box, buffer)
    return [p for p in geo.polygons(land) if geo.crop(p, box, buffer)]


def offshore(df: DataFrame, land: Land, box: tuple[float, float, float, float] | None = None, buffer: float = 10_000, crs: int = 3035) -> DataFrame:
    """offshore: 1 where no polygon of the land covers the point, its boundary counted in; null without a position.

    ``land`` is on the plane of ``crs``: a polygon table (see ``spatial``), polygons as lists of rings, or rings. Polygons
    may overlap. A box (of the data, see ``bounds``) leaves out polygons farther than the buffer before any point is tested.
    """
    d = spatial.within_shape(_placed(df, crs), _near(land, box, buffer), "__x", "__y", "__in")
    return d.withColumn("offshore", (~C("__in")).cast("int")).drop("__x", "__y", "__in")


def coastline(spark: SparkSession, land: Land, simplify: bool = False, keep: float = 0.05) -> DataFrame:
    """The outline of all land as one polygon of a table: simplified if asked for, then overlaid, so that neither shared
    borders nor edges inside other land are coast. Worked out once, into the shared folder."""
    edges = land if isinstance(land, DataFrame) else spatial.edges_of(spark, geo.polygons(land))
    edges = spatial.simplify(edges, keep) if simplify else edges
    return settled(spatial.union_edges(edges).select(F.lit(0).alias("poly"), F.lit(0).alias("ring"), F.monotonically_increasing_id().alias("seq"), "x1", "y1", "x2", "y2"))


def dist2coast(df: DataFrame, land: Land, box: tuple[float, float, float, float] | None = None, buffer: float = 50_000, simplify: bool = False, keep: float = 0.05, crs: int = 3035) -> DataFrame:
    """onshore (strictly inside), and dist2coast: metres on the plane to the nearest coast segment.

    ``land`` as for ``offshore``; more than one polygon, or more than a few edges, become a ``coastline`` first, which may
    be passed as such (a table of one polygon) to use it again.
    """
    land, d = _near(land, box, buffer), _placed(df, crs)
    few = [] if isinstance(land, DataFrame) else geo.polygons(land)
    if not isinstance(land, DataFrame) and len(few) <= 1 and sum(map(len, few[0] if few else [])) <= spatial.INLINE and not simplify:
        on = geo.in_polygon(C("__x"), C("__y"), few[0]) if few else F.when(C("__x").isNotNull(), F.lit(False))
        far = geo.distance_to_edges(C("__x"), C("__y"), few[0]) if few else F.lit(None).cast("double")
        return d.withColumns({"onshore": on, "dist2coast": far}).drop("__x", "__y")
    coast = coastline(df.sparkSession, land, simplify, keep)
    g = spatial.grid(coast)
    d = settled(d)  # read five times: places are worked out once
    d = spatial.covering(d, coast, "__x", "__y", False, "__in", g)
    d = spatial.nearest_edge(d, coast, "__x", "__y", "dist2coast", g=g)
    return d.withColumn("onshore", F.when(C("__x").isNotNull() & C("__y").isNotNull(), F.size("__in") > 0)).select(*(c for c in df.columns if c not in ("onshore", "dist2coast")), "onshore", "dist2coast")


def sun_calc(df: DataFrame, keep: tuple[str, ...] = ("sunrise", "sunset"), order: Order = ORDER) -> DataFrame:
    """Adds the kept sun times (timestamps) and dnt, the part of the day: ATm, NTm, CTm (twilights of the morning),
    SR, DA, SS, CTe, NTe, ATe (of the evening), NI."""
    t = C(order.time).cast("timestamp")
    sun = geo.sun_times(F.to_date(t), C("longitude"), C("latitude"))
    names = {n: f"__{n}" for n in sun}
    d = df.withColumns({names[n]: c for n, c in sun.items()}).withColumn("__us", F.unix_micros(t) / F.lit(1e6))
    within = lambda a, b: (C("__us") >= C(names[a])) & (C("__us") < C(names[b]))
    part: Column = (
        F.when(within("nightEnd", "nauticalDawn"), "ATm").when(within("nauticalDawn", "dawn"), "NTm").when(within("dawn", "sunrise"), "CTm").when(within("sunrise", "sunriseEnd"), "SR")
        .when(within("sunriseEnd", "sunsetStart"), "DA").when(within("sunsetStart", "sunset"), "SS").when(within("sunset", "dusk"), "CTe").when(within("dusk", "nauticalDusk"), "NTe")
        .when(within("nauticalDusk", "night"), "ATe").when(C("__us").isNotNull() & C(names["sunrise"]).isNotNull(), "NI")
    )
    d = d.withColumn("dnt", part)
    return d.withColumns({n: F.timestamp_micros((C(names[n]) * 1e6).cast("long")) for n in keep}).drop("__us", *names.values())
