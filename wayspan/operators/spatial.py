"""Polygon tables: cover tests, spatial joins, nearest edges, unions and simplification, by an index of grid cells.

A polygon table has one row per edge: ``poly``, ``ring``, ``seq``, ``x1``, ``y1``, ``x2``, ``y2`` on a plane (see
``edge_table`` and ``edges_of``). A polygon covers what an odd number of its rings' edges separate from the outside, so
holes and touching parts need no marks; polygons of one table may overlap.

The index lays edges into square cells. Each cell has a fixed inner point, and scanning each row of cells once tells for
all inner points of that row whether they are inside. A point is then inside as its cell's inner point is, unless an odd
number of the cell's own edges lies between the two. The index is two tables, joined by equality: per strip of sixteen
cells of a row the polygons that cover some of them whole, as bits, and per cell the edges in it. Where polygons lie on one
another cells are made smaller until few edges share one; where only a flag is asked for, or the outline of all, edges in
a cell that another polygon covers whole are left out. A spatial join, and points that share their places, take the index as
one table instead, a row per strip and polygon, so that no row holds all polygons of a cell.

The index grows with the polygons whatever their file's size, from which Spark would judge it: a side goes to all executors
only where its rows were counted, and every other join of the cover tests is a sort-merge one.

The nearest edge is found from the top of a pyramid of cells, four times as wide on each level: of a cell's candidates
those stay that are no farther than the farthest point of the best one. That is done once for each distinct cell with
points, not for each point, and goes on in smaller cells with points, by the edges themselves, so that few are left to
be measured for a point.

Nulls: points without coordinates are covered by nothing (null where asked for a flag) and have no nearest edge. Edges with
a null coordinate are left out. Edges of no length are too; a ring with fewer than three corners covers nothing but itself.
An empty polygon table covers nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.operators.outliers import kept as held
from wayspan.operators.outliers import order_stats
from wayspan.session import settled

C = F.col
EDGE = "array<struct<t:int,x1:double,y1:double,x2:double,y2:double>>"
#: Cells of a row that make a strip.
STRIP = 16
#: The inner point of a cell, as parts of its side: off the middle, so that even coordinates don't meet it.
INNER_X, INNER_Y = 0.5130177, 0.4870429
#: An index of up to so many edges, or strips, is sent to all executors; beyond that points and index are both shuffled.
SENT = 200_000
FAN = 4
#: Times that a cell with points is cut into FAN by FAN smaller ones for the nearest edge, each with edges of its own.
FINER = 2
#: Edges that share a cell with an edge, on the average, beyond which cells are made smaller; rows per edge that they may come to.
CROWD, LAID = 16, 16
#: Distinct places of points, polygons' ids of all places together, and rows of edges by cell that may be sent to all executors.
PLACES, IDS, CARRIED = 50_000, 2_000_000, 100_000
#: Rows of a join's result that a task is meant to make, and tasks beyond which they make more: the driver samples 300 places for each.
MADE, TASKS = 100_000_000, 2_000


def edge_table(vertices: DataFrame, poly: str = "poly", ring: str = "ring", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Edges of rings given by their corners in order; the last corner is joined to the first."""
    w = W.partitionBy("poly", "ring").orderBy("seq")
    v = vertices.select(C(poly).alias("poly"), C(ring).alias("ring"), C(seq).alias("seq"), C(x).cast("double").alias("x1"), C(y).cast("double").alias("y1")).filter("x1 IS NOT NULL AND y1 IS NOT NULL")
    first = W.partitionBy("poly", "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    v = v.withColumns({"x2": F.coalesce(F.lead("x1").over(w), F.first("x1").over(first)), "y2": F.coalesce(F.lead("y1").over(w), F.first("y1").over(first))})
    return v.filter("x1 <> x2 OR y1 <> y2")


def edges_of(spark: SparkSession, polygons: list[list[geo.Ring]]) -> DataFrame:
    """A polygon table of shapes held by the caller: each polygon is a list of rings."""
    rows = [(p, r, i, *map(float, e)) for p, rings in enumerate(polygons) for r, ring in enumerate(rings) for i, e in enumerate(geo.edges([ring]))]
    return spark.createDataFrame(rows, "poly int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")


@dataclass(frozen=True)
class Grid:
    """Cell size, the table's box, and whether its index (of strips and of edges by cell) may be sent to all executors,
    also as a row per strip and polygon (``tiny``)."""

    size: float
    box: tuple[float, float, float, float] | None
    small: bool
    tiny: bool = False

    def ix(self, x: Column) -> Column:
        return F.floor(x / self.size)

    def inner(self, ix: Column, iy: Column) -> tuple[Column, Column]:
        return (ix + INNER_X) * self.size, (iy + INNER_Y) * self.size


def grid(edges: DataFrame, size: float | None = None) -> Grid:
    """A grid for a polygon table: cells of four mean edge lengths, smaller where more than ``CROWD`` edges share one
    and edges don't come to more than ``LAID`` rows each, wider where the polygons' boxes would else hold more strips than
    four for each edge. Takes one pass over the table and up to three over its cells."""
    by = edges.groupBy("poly").agg(
        F.count("*").alias("n"), F.sum(F.hypot(C("x2") - C("x1"), C("y2") - C("y1"))).alias("len"),
        *(f(f2(f"{c}1", f"{c}2")).alias(n) for f, f2, c, n in ((F.min, F.least, "x", "x0"), (F.min, F.least, "y", "y0"), (F.max, F.greatest, "x", "x1"), (F.max, F.greatest, "y", "y1"))),
    )
    r = by.agg(F.sum("n").alias("n"), F.sum("len").alias("len"), F.sum((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).head()
    if not r["n"]:
        return Grid(size or 1.0, None, True, True)
    box, n = (r["x0"], r["y0"], r["x1"], r["y1"]), r["n"]
    least = max(math.sqrt(r["area"] / STRIP / (4 * n + 1000)), 1e-9)
    fixed, size = size is not None, size or max(4 * r["len"] / n, least)
    for _ in range(3):
        c = in_cells(edges, Grid(size, box, False)).groupBy("ix", "iy").agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.sum(C("c").cast("double") * C("c")).alias("squares")).head()
        smaller = max(size * CROWD / (c["squares"] / c["rows"]), size * c["rows"] / (LAID * n), least)
        if fixed or smaller > size / 2:
            break
        size = smaller
    strips = r["area"] / STRIP / size**2
    return Grid(size, box, n <= SENT and c["rows"] <= 4 * SENT and strips <= SENT, c["rows"] <= CARRIED and strips <= CARRIED)


def _sent(d: DataFrame, all_over: bool) -> DataFrame:
    """A join's side: broadcast if so, else never, whatever size Spark takes it for."""
    return F.broadcast(d) if all_over else d.hint("merge")


def in_cells(edges: DataFrame, g: Grid) -> DataFrame:
    """Edges with the cells (ix, iy) they pass, a hair's breadth around them counted in; a row per edge and cell."""
    if not g.small:  # a table of few bytes is read by few tasks, whatever its rows come to
        edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x1", "y1")
    pad = g.size * 1e-9
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    d = edges.withColumn("ix", F.explode(F.sequence(g.ix(lo - pad), g.ix(hi + pad))))
    dx = C("x2") - C("x1")
    at = lambda x: C("y1") + (F.least(F.greatest(x, lo), hi) - C("x1")) * (C("y2") - C("y1")) / dx
    ya, yb = F.when(dx == 0, C("y1")).otherwise(at(C("ix") * g.size - pad)), F.when(dx == 0, C("y2")).otherwise(at((C("ix") + 1) * g.size + pad))
    return d.withColumn("iy", F.explode(F.sequence(g.ix(F.least(ya, yb) - pad), g.ix(F.greatest(ya, yb) + pad))))


def _bit(mask: Column | str, t: Column) -> Column:
    return F.call_function("shiftright", C(mask) if isinstance(mask, str) else mask, t).bitwiseAND(F.lit(1)) == 1


def _strips(edges: DataFrame, g: Grid, carried: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """Per strip (jx, iy) and polygon a bit per cell: ``inner`` where it covers the cell's inner point, ``cut`` where it has
    edges; with ``carried`` these ``edges`` too, each with its cell's number ``t`` in the strip. ``cells`` (ix, iy, jx), few,
    are the only ones that are asked for: edges elsewhere and other strips are left out."""
    t = F.pmod("ix", F.lit(STRIP)).cast("int")
    edge = [F.struct(t.alias("t"), "x1", "y1", "x2", "y2").alias("edge")] if carried else []
    laid = in_cells(edges, g)
    if cells is not None:
        laid = laid.join(F.broadcast(cells.select("ix", "iy").distinct()), ["ix", "iy"], "left_semi")
    laid = laid.select(F.floor(C("ix") / STRIP).alias("jx"), "iy", "poly", F.lit(0).alias("inner"), F.call_function("shiftleft", F.lit(1), t).alias("cut"), *edge)
    # Where a row's line of inner points meets the polygon's edges: between an odd crossing and the next it is inside.
    rows = edges.withColumn("iy", F.explode(F.sequence(g.ix(F.least("y1", "y2")) - 1, g.ix(F.greatest("y1", "y2")) + 1)))
    line = (C("iy") + INNER_Y) * g.size
    rows = rows.filter((C("y1") > line) != (C("y2") > line))
    rows = rows.select("poly", "iy", F.floor((C("x1") + (line - C("y1")) * (C("x2") - C("x1")) / (C("y2") - C("y1"))) / g.size - INNER_X).alias("k"))
    w = W.partitionBy("poly", "iy").orderBy("k")
    runs = rows.select("poly", "iy", (C("k") + 1).alias("a"), F.lead("k").over(w).alias("b"), F.row_number().over(w).alias("n")).filter("n % 2 = 1 AND a <= b")
    runs = runs.withColumn("jx", F.explode(F.sequence(F.floor(C("a") / STRIP), F.floor(C("b") / STRIP))))
    if cells is not None:
        runs = runs.join(F.broadcast(cells.select("jx", "iy").distinct()), ["jx", "iy"], "left_semi")
    first, last = F.greatest(C("a") - C("jx") * STRIP, F.lit(0)), F.least(C("b") - C("jx") * STRIP, F.lit(STRIP - 1))
    runs = runs.withColumns({"__first": first, "__last": last}).select("jx", "iy", "poly", F.expr("shiftleft(1, int(__last) + 1) - shiftleft(1, int(__first))").alias("inner"), F.lit(0).alias("cut"))
    listed = [F.collect_list("edge").alias("edges")] if carried else []
    return laid.unionByName(runs, allowMissingColumns=carried).groupBy("jx", "iy", "poly").agg(F.bit_or("inner").alias("inner"), F.bit_or("cut").alias("cut"), *listed)


def whole_cells(edges: DataFrame, g: Grid) -> DataFrame:
    """Per strip (jx, iy) a bit per cell that some polygon covers whole, as ``whole``; strips without one are left out."""
    return _strips(edges, g).select("jx", "iy", C("inner").bitwiseAND(F.bitwise_not("cut")).alias("whole")).filter("whole <> 0").groupBy("jx", "iy").agg(F.bit_or("whole").alias("whole"))


def _open(laid: DataFrame, whole: DataFrame, g: Grid) -> DataFrame:
    """Rows of ``in_cells`` whose cell no polygon covers whole."""
    d = laid.withColumn("jx", F.floor(C("ix") / STRIP)).join(_sent(whole, g.small), ["jx", "iy"], "left")
    return d.filter(~F.coalesce(_bit("whole", F.pmod("ix", F.lit(STRIP)).cast("int")), F.lit(False))).drop("whole")


def index(edges: DataFrame, g: Grid, any_of: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cover index: per strip (jx, iy) the polygons that cover cells whole, with a bit per cell (``whole``), and per
    cell (ix, iy) the polygons with edges in it, these, and whether they cover its inner point (``parts``).

    With ``any_of`` it only tells whether any polygon covers a point: bits of all together, and no edges in such cells.
    """
    strips, laid = _strips(edges, g), in_cells(edges, g)
    if any_of:
        whole = whole_cells(edges, g)
        laid = _open(laid, whole, g)
    else:
        bits = C("inner").bitwiseAND(F.bitwise_not("cut"))
        whole = strips.select("jx", "iy", F.struct("poly", bits.alias("bits")).alias("p")).filter("p.bits <> 0").groupBy("jx", "iy").agg(F.collect_list("p").alias("whole"))
        laid = laid.withColumn("jx", F.floor(C("ix") / STRIP))
    laid = laid.groupBy("jx", "iy", "poly", "ix").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    laid = laid.join(_sent(strips.select("jx", "iy", "poly", "inner"), g.tiny), ["jx", "iy", "poly"])
    inner = _bit("inner", F.pmod("ix", F.lit(STRIP)).cast("int"))
    return whole, laid.groupBy("ix", "iy").agg(F.collect_list(F.struct("poly", inner.cast("int").alias("inner"), "edges")).alias("parts"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def on_edge(x: Column, y: Column, e: Column) -> Column:
    within = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return within & (_side(e["x1"], e["y1"], e["x2"], e["y2"], x, y) == 0)


def _covers(edges: Column, inner: Column, x: Column, y: Column, rx: Column, ry: Column, boundary: bool) -> Column:
    """Whether a polygon with ``edges`` in a cell, and its inner point inside or not, covers (x, y) there. Both ends of an edge
    are put on a side of the line to the inner point by the same formula as the next edge's, so no corner is counted twice."""
    between = lambda e: ((_side(x, y, rx, ry, e["x1"], e["y1"]) >= 0) != (_side(x, y, rx, ry, e["x2"], e["y2"]) >= 0)) & ((_side(e["x1"], e["y1"], e["x2"], e["y2"], x, y) >= 0) != (_side(e["x1"], e["y1"], e["x2"], e["y2"], rx, ry) >= 0))
    inside = (F.size(F.filter(edges, between)) + inner) % 2 == 1
    touched = F.exists(edges, lambda e: on_edge(x, y, e))
    return inside | touched if boundary else inside & ~touched


def _at(points: DataFrame, x: str, y: str, g: Grid) -> DataFrame:
    """``points`` with their cells and strips."""
    return points.withColumns({"__ix": g.ix(C(x)), "__iy": g.ix(C(y))}).withColumn("__jx", F.floor(C("__ix") / STRIP))


def _found(points: DataFrame, edges: DataFrame, x: str, y: str, g: Grid, any_of: bool) -> tuple[DataFrame, Column]:
    """``points`` with the index's columns of their cells, and the cell's bit."""
    whole, parts = (_sent(d, g.small) for d in index(edges, g, any_of))
    p = _at(points, x, y, g)
    p = p.join(whole.select(C("jx").alias("__jx"), C("iy").alias("__iy"), C("whole").alias("__whole")), ["__jx", "__iy"], "left")
    p = p.join(parts.select(C("ix").alias("__ix"), C("iy").alias("__iy"), C("parts").alias("__parts")), ["__ix", "__iy"], "left")
    return p, F.pmod("__ix", F.lit(STRIP)).cast("int")


def _pairs(points: DataFrame, edges: DataFrame, x: str, y: str, boundary: bool, g: Grid, how: str = "inner", few: bool = False) -> DataFrame:
    """A row of ``points`` per polygon that covers it, as ``__poly``; ``left`` keeps the others too, with a null. ``few``
    points go to all executors and to the polygons, and leave out what is in no cell of theirs."""
    p = _at(points, x, y, g)
    cells = p.select(*(C(f"__{c}").alias(c) for c in ("ix", "iy", "jx"))) if few else None
    table = _strips(edges, g, True, cells).select(*(C(c).alias(f"__p{c}") for c in ("jx", "iy", "inner", "cut", "edges")), C("poly").alias("__poly"))
    t, (rx, ry) = F.pmod("__ix", F.lit(STRIP)).cast("int"), g.inner(C("__ix"), C("__iy"))
    inner = _bit("__pinner", t)
    covers = F.when(_bit("__pcut", t), _covers(F.filter("__pedges", lambda e: e["t"] == t), inner.cast("int"), C(x), C(y), rx, ry, boundary)).otherwise(inner)
    on = (C("__jx") == C("__pjx")) & (C("__iy") == C("__piy")) & covers
    d = table.join(F.broadcast(p), on) if few else p.join(_sent(table, g.tiny), on, how)
    return d.select(*points.columns, "__poly")


def _by_place(points: DataFrame, edges: DataFrame, x: str, y: str, boundary: bool, g: Grid) -> tuple[DataFrame, int | None] | None:
    """Per distinct place (__px, __py) that some polygon covers these polygons' sorted ids as ``__c``, ready to be joined to points, and
    how many rows points and polygons come to if that was counted; None where places don't repeat. Few places are held, so
    that they are known to be few. A place's ids are one row."""
    at = points.filter(C(x).isNotNull() & C(y).isNotNull()).select(C(x).alias("__px"), C(y).alias("__py"))
    n, spots = at.agg(F.count("*"), F.approx_count_distinct(F.struct("__px", "__py"))).head()
    if n < 4 * spots:
        return None
    few, places = spots <= PLACES, at.groupBy("__px", "__py").agg(F.count("*").alias("__n"))
    found = _pairs(settled(places) if few else places, edges, "__px", "__py", boundary, g, few=few)
    found = found.groupBy("__px", "__py").agg(F.sort_array(F.collect_list("__poly")).alias("__c"), F.first("__n").alias("__n"))
    if not few:
        return found.drop("__n").hint("merge"), None
    found = settled(found)
    ids, rows = found.agg(F.sum(F.size("__c")), F.sum(F.size("__c") * C("__n"))).head()
    return _sent(found.drop("__n"), (ids or 0) <= IDS), rows or 0


def covering(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", boundary: bool = True, out: str = "covering", g: Grid | None = None) -> DataFrame:
    """``points`` with the sorted ids of the polygons that cover each; points on an edge count unless ``boundary`` is off.
    Where places repeat, each is worked out once."""
    g = g or grid(edges)
    none = F.array().cast(f"array<{edges.schema['poly'].dataType.simpleString()}>")
    if places := _by_place(points, edges, x, y, boundary, g):
        d = points.withColumns({"__px": C(x), "__py": C(y)}).join(places[0], ["__px", "__py"], "left")
        return d.select(*points.columns, F.coalesce("__c", none).alias(out))
    d, t = _found(points, edges, x, y, g, False)
    rx, ry = g.inner(C("__ix"), C("__iy"))
    sure = F.transform(F.filter("__whole", lambda q: _bit(q["bits"], t)), lambda q: q["poly"])
    tried = F.transform(F.filter("__parts", lambda q: _covers(q["edges"], q["inner"], C(x), C(y), rx, ry, boundary)), lambda q: q["poly"])
    return d.select(*points.columns, F.sort_array(F.concat(F.coalesce(sure, none), F.coalesce(tried, none))).alias(out))


def spatial_join(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", how: str = "inner", boundary: bool = True) -> DataFrame:
    """A row per point and polygon that covers it; ``left`` also keeps points that none does, with a null poly.

    The result is as large as points and polygons make it; neither driver nor task holds more of it than a place's ids. Where
    places repeat, each is worked out once, and points are dealt out anew, as few bytes of theirs make many rows, by ranges of
    places, so that like rows are written together."""
    g, how = grid(edges), "left" if how == "left" else "inner"
    if not (places := _by_place(points, edges, x, y, boundary, g)):
        return _pairs(points, edges, x, y, boundary, g, how).withColumnRenamed("__poly", "poly")
    (found, rows), d = places, points.withColumns({"__px": C(x), "__py": C(y)})
    if rows:
        tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, math.ceil(rows / MADE)))
        whole = F.xxhash64(*(c for c, kind in points.dtypes if "map<" not in kind and "variant" not in kind))  # so that a place's points can be parted
        d = d.withColumn("__i", whole).repartitionByRange(tasks, "__px", "__py", "__i")
    d = d.join(found, ["__px", "__py"], how)
    return d.select(*points.columns, (F.explode_outer if how == "left" else F.explode)("__c").alias("poly"))


def covered(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", boundary: bool = True, out: str = "covered", g: Grid | None = None) -> DataFrame:
    """``points`` with a flag: whether any polygon covers it; null without a position."""
    g = g or grid(edges)
    d, t = _found(points, edges, x, y, g, True)
    rx, ry = g.inner(C("__ix"), C("__iy"))
    sure = F.coalesce(_bit("__whole", t), F.lit(False))
    tried = F.coalesce(F.exists("__parts", lambda q: _covers(q["edges"], q["inner"], C(x), C(y), rx, ry, boundary)), F.lit(False))
    return d.select(*points.columns, F.when(C(x).isNotNull() & C(y).isNotNull(), sure | tried).alias(out))


#: Edges of a shape held by the caller up to which it is a literal of the plan instead of a table.
INLINE = 64


def crop(edges: DataFrame, box: tuple[float, float, float, float], buffer: float) -> DataFrame:
    """Polygons whose own box meets the buffered one (xmin, ymin, xmax, ymax)."""
    near = edges.groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    near = near.filter((C("a") <= box[2] + buffer) & (C("b") >= box[0] - buffer) & (C("c") <= box[3] + buffer) & (C("d") >= box[1] - buffer))
    return edges.join(near.select("poly"), "poly", "left_semi")


def within_shape(df: DataFrame, shape: DataFrame | list, x: str, y: str, out: str, boundary: bool = True) -> DataFrame:
    """``df`` with a flag whether the shape, a polygon table or rings on the plane (see ``geo.polygons``), covers (x, y);
    null without a position. A few edges are tried directly, more by the index."""
    if isinstance(shape, DataFrame):
        return covered(df, shape, x, y, boundary, out)
    parts = geo.polygons(shape)
    if sum(len(r) for p in parts for r in p) > INLINE:
        return covered(df, edges_of(df.sparkSession, parts), x, y, boundary, out)
    known = C(x).isNotNull() & C(y).isNotNull()
    hit = F.lit(False)
    for rings in parts:
        hit = hit | geo.in_polygon(C(x), C(y), rings)
    return df.withColumn(out, F.when(known, hit))


def distance(x: Column, y: Column, e: Column) -> Column:
    """Planar distance from a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - (e["x1"] + along * dx), y - (e["y1"] + along * dy))


def _gap(a: Column, b: Column, wide: int) -> tuple[Column, Column]:
    """Least and greatest distance along an axis, in cells, between cell ``a`` and the ``wide`` cells from ``b`` * wide."""
    lo, hi = b * wide, (b + 1) * wide
    return F.greatest(F.lit(0), lo - (a + 1), a - hi), F.greatest(hi - a, a + 1 - lo)


def _where_most(array: str, value: Callable[[Column], Column], most: Column) -> Column:
    """The array's entries whose value is at most ``most``, which is worked out once: a column of its own would be put into
    the condition, and worked out anew for each entry."""
    return F.flatten(F.transform(F.array(most), lambda m: F.filter(array, lambda q: value(q) <= m)))


def candidates(cells: DataFrame, edges: DataFrame, g: Grid) -> DataFrame:
    """Distinct cells (ix, iy) with ``edges``: all that can be nearest to some point of the cell (an edge comes once for each cell that it passes)."""
    if g.box is None:
        return cells.distinct().withColumn("edges", F.array().cast(EDGE))
    laid = in_cells(edges, g).groupBy("ix", "iy").agg(F.collect_list(F.struct(F.lit(0).alias("t"), "x1", "y1", "x2", "y2")).alias("edges"))
    sent = F.broadcast if g.small else (lambda d: d)
    # Few bytes, but long work: tasks must not be merged. Another number than that of the shuffle before, else this one is left out.
    tasks = 2 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(g.box[2] - g.box[0], g.box[3] - g.box[1]) / g.size
    top = max(0, math.ceil(math.log(max(side, 1) / 4, FAN)))  # at most 6 by 6 cells there
    at = lambda c, level: F.floor(C(c) / FAN**level)
    occupied = in_cells(edges, g).select("ix", "iy").distinct()
    near = lambda level: lambda q: sum(_sq(_gap(C("ix"), q["cx"], FAN**level)[0], _gap(C("iy"), q["cy"], FAN**level)[0]))
    far = lambda level: lambda q: sum(_sq(_gap(C("ix"), q["cx"], FAN**level)[1], _gap(C("iy"), q["cy"], FAN**level)[1]))

    def prune(d: DataFrame, level: int) -> DataFrame:
        return d.select("ix", "iy", _where_most("cand", near(level), F.array_min(F.transform("cand", far(level)))).alias("cand"))

    roots = occupied.select(at("ix", top).alias("cx"), at("iy", top).alias("cy")).distinct().agg(F.collect_list(F.struct("cx", "cy")).alias("cand"))
    cells = cells.filter("ix IS NOT NULL AND iy IS NOT NULL").distinct().repartition(tasks, "ix", "iy")
    d = prune(cells.join(F.broadcast(roots)), top)  # one row of at most 36 cells
    for level in range(top, 0, -1):
        kids = occupied.groupBy(at("ix", level).alias("cx"), at("iy", level).alias("cy")).agg(F.collect_set(F.struct(at("ix", level - 1).alias("cx"), at("iy", level - 1).alias("cy"))).alias("kids"))
        d = d.select("ix", "iy", F.explode("cand").alias("c")).select("ix", "iy", "c.cx", "c.cy").join(sent(kids), ["cx", "cy"])
        d = prune(d.groupBy("ix", "iy").agg(F.flatten(F.collect_list("kids")).alias("cand")), level - 1)
    d = d.select("ix", "iy", F.explode("cand").alias("c")).select(C("ix").alias("qx"), C("iy").alias("qy"), C("c.cx").alias("ix"), C("c.cy").alias("iy")).join(sent(laid), ["ix", "iy"])
    return d.select(C("qx").alias("ix"), C("qy").alias("iy"), "edges").groupBy("ix", "iy").agg(F.flatten(F.collect_list("edges")).alias("edges"))


def _sq(*v: Column) -> list[Column]:
    return [x * x for x in v]


def _finer(cells: DataFrame, found: DataFrame, size: float) -> DataFrame:
    """Cells (ix, iy) of a smaller size with those of the edges in ``found``, by cells ``FAN`` times as wide, that can be
    nearest to some point of theirs: none is farther from the middle than the nearest one by more than a diagonal."""
    parent = {"__ix": F.floor(C("ix") / FAN), "__iy": F.floor(C("iy") / FAN)}
    # Few bytes, but long work: as many tasks as there may be.
    d = cells.withColumns(parent).repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__ix", "__iy")
    d = d.join(found.select(C("ix").alias("__ix"), C("iy").alias("__iy"), "edges"), ["__ix", "__iy"])
    mx, my = (C("ix") + 0.5) * size, (C("iy") + 0.5) * size
    d = d.withColumn("__d", F.transform("edges", lambda e: F.struct(distance(mx, my, e).alias("d"), e.alias("e"))))
    near = _where_most("__d", lambda q: q["d"], F.array_min("__d")["d"] + size * math.sqrt(2) * (1 + 1e-9))
    return d.select("ix", "iy", F.transform(near, lambda q: q["e"]).alias("edges"))


def nearest_edge(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", out: str = "distance", tried: str | None = None, g: Grid | None = None) -> DataFrame:
    """``points`` with the distance to the nearest edge, and in ``tried`` how many edges were measured for it."""
    g = g or grid(edges)
    fine = Grid(g.size / FAN**FINER, g.box, g.small)
    p = points.withColumns({"__ix": fine.ix(C(x)), "__iy": fine.ix(C(y))})
    cells = p.filter(C(x).isNotNull() & C(y).isNotNull()).select(C("__ix").alias("ix"), C("__iy").alias("iy")).distinct()
    up = lambda n: cells.select(*(F.floor(C(c) / FAN**n).alias(c) for c in ("ix", "iy"))).distinct() if n else cells
    found = candidates(up(FINER), edges, g)
    for n in range(FINER - 1, -1, -1):
        found = _finer(up(n), found, g.size / FAN ** (FINER - n))
    d = p.join(found.select(C("ix").alias("__ix"), C("iy").alias("__iy"), C("edges").alias("__e")), ["__ix", "__iy"], "left")
    least = F.array_min(F.transform("__e", lambda e: distance(C(x), C(y), e)))
    return d.select(*points.columns, least.alias(out), *([F.coalesce(F.size("__e"), F.lit(0)).alias(tried)] if tried else []))


def union_edges(edges: DataFrame, g: Grid | None = None, off: float = 1e-4) -> DataFrame:
    """The outline of all polygons together, as edges (x1, y1, x2, y2) with land on their left.

    Edges are cut where another one crosses, touches or overlaps them, found by a join on cells. A piece belongs to the
    outline if exactly one of the two points ``off`` beside its middle is covered: pieces inside another polygon have land
    on both sides, borders between neighbours too, and of equal pieces one stays. Self-crossing rings come out valid.
    The outline meets no cell that a polygon covers whole: edges are cut in the other cells only, and those that pass none
    of these are left out.
    """
    g = g or grid(edges)
    e = edges.withColumn("id", F.struct("poly", "ring", "seq"))
    cells = _open(in_cells(e, g), whole_cells(edges, g), g).select("ix", "iy", "id", "x1", "y1", "x2", "y2")
    e = cells.select("id", "x1", "y1", "x2", "y2").distinct()
    a, b = cells, cells.select("ix", "iy", *(C(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")))
    meet = (F.least("x1", "x2") <= F.greatest("b_x1", "b_x2")) & (F.greatest("x1", "x2") >= F.least("b_x1", "b_x2")) & (F.least("y1", "y2") <= F.greatest("b_y1", "b_y2")) & (F.greatest("y1", "y2") >= F.least("b_y1", "b_y2"))
    pairs = a.join(b, (a["ix"] == b["ix"]) & (a["iy"] == b["iy"]) & (C("id") < C("b_id")) & meet).select("id", "x1", "y1", "x2", "y2", "b_id", "b_x1", "b_y1", "b_x2", "b_y2")
    one, two = [C(c) for c in ("x1", "y1", "x2", "y2")], [C(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]
    s = {"s1": _side(*one, *two[:2]), "s2": _side(*one, *two[2:]), "s3": _side(*two, *one[:2]), "s4": _side(*two, *one[2:])}
    pairs = pairs.withColumns(s)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    share = C("s1") / (C("s1") - C("s2"))
    cross = F.when((C("s1") * C("s2") < 0) & (C("s3") * C("s4") < 0), point(two[0] + share * (two[2] - two[0]), two[1] + share * (two[3] - two[1])))
    # An end of one on the other; both edges get the very same point.
    touch = lambda side, ends, other: F.when((side == 0) & ends[0].between(F.least(other[0], other[2]), F.greatest(other[0], other[2])) & ends[1].between(F.least(other[1], other[3]), F.greatest(other[1], other[3])), point(*ends))
    on_one = F.array(cross, touch(C("s1"), two[:2], one), touch(C("s2"), two[2:], one))
    on_two = F.array(cross, touch(C("s3"), one[:2], two), touch(C("s4"), one[2:], two))
    kept = lambda v: F.filter(v, lambda p: p.isNotNull())
    both = pairs.select(F.explode(F.array(F.struct("id", kept(on_one).alias("at")), F.struct(C("b_id").alias("id"), kept(on_two).alias("at")))).alias("r")).select("r.*")
    cuts = both.filter("size(at) > 0").groupBy("id").agg(F.flatten(F.collect_list("at")).alias("at"))
    d = e.join(cuts, "id", "left")
    along = lambda p: (p["x"] - C("x1")) * (C("x2") - C("x1")) + (p["y"] - C("y1")) * (C("y2") - C("y1"))
    placed = F.array_sort(F.transform(F.coalesce("at", F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(along(p).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
    stops = F.concat(F.array(point(C("x1"), C("y1"))), F.transform(placed, lambda p: point(p["x"], p["y"])), F.array(point(C("x2"), C("y2"))))
    d = d.select(stops.alias("s")).select(F.explode(F.transform(F.expr("slice(s, 1, size(s) - 1)"), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("s", i + 1)["x"].alias("x2"), F.get("s", i + 1)["y"].alias("y2")))).alias("p")).select("p.*")
    d = d.filter("x1 <> x2 OR y1 <> y2")
    # Equal pieces, in either direction, once.
    swap = (C("x1") > C("x2")) | ((C("x1") == C("x2")) & (C("y1") > C("y2")))
    flip = lambda p, q: F.when(swap, C(q)).otherwise(C(p))
    d = d.select(flip("x1", "x2").alias("x1"), flip("y1", "y2").alias("y1"), flip("x2", "x1").alias("x2"), flip("y2", "y1").alias("y2")).distinct()
    n = F.hypot(C("x2") - C("x1"), C("y2") - C("y1"))
    mx, my, nx, ny = (C("x1") + C("x2")) / 2, (C("y1") + C("y2")) / 2, (C("y1") - C("y2")) / n * off, (C("x2") - C("x1")) / n * off
    d = d.withColumns({"lx": mx + nx, "ly": my + ny, "rx": mx - nx, "ry": my - ny})
    d = covered(covered(d, edges, "lx", "ly", out="left_in", g=g), edges, "rx", "ry", out="right_in", g=g).filter("left_in <> right_in")
    turn = lambda p, q: F.when(C("left_in"), C(p)).otherwise(C(q))
    return d.select(turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))


def effective_areas(x: list[float], y: list[float], fixed: list[bool], least: int = 3, weighting: float = 0.7) -> list[float]:
    """For each corner of a closed ring the area at which it goes: always the corner of the least triangle with its two
    neighbours goes next, and none goes at less than one before it. Fixed corners and the last ``least`` never go.

    ``weighting`` lessens sharp corners' and raises flat ones' areas by the angle's cosine; 0 takes plain areas. Equal areas go by coordinates,
    so that a line shared by two rings loses the same corners in both.
    """
    n = len(x)
    before, after, gone, left = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)], [math.inf] * n, n
    live = [True] * n

    def area(i: int) -> float:
        ax, ay, bx, by = x[before[i]] - x[i], y[before[i]] - y[i], x[after[i]] - x[i], y[after[i]] - y[i]
        size = math.hypot(ax, ay) * math.hypot(bx, by)
        return abs(ax * by - ay * bx) / 2 * (1 - weighting * (ax * bx + ay * by) / size if size else 1)

    heap = [(area(i), x[i], y[i], i) for i in range(n) if not fixed[i]]
    now = {i: a for a, _, _, i in heap}
    heapq.heapify(heap)
    top = 0.0
    while heap and left > least:
        a, _, _, i = heapq.heappop(heap)
        if not live[i] or now[i] != a:
            continue
        top = max(top, a)
        gone[i], live[i] = top, False
        left -= 1
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if live[j] and not fixed[j]:
                now[j] = area(j)
                heapq.heappush(heap, (now[j], x[j], y[j], j))
    return gone


def simplify(edges: DataFrame, keep: float = 0.05, weighting: float = 0.7) -> DataFrame:
    """The polygon table with about ``keep`` of its corners: those that go last by effective area over all rings.

    Corners where lines of several rings meet stay, so neighbours still share their borders, and three corners of every
    ring stay, so none vanishes. A ring is worked through in one Python group and must fit into a worker.
    """
    w = W.partitionBy("poly", "ring").orderBy("seq")
    last = W.partitionBy("poly", "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = edges.withColumns({"px": F.coalesce(F.lag("x1").over(w), F.last("x1").over(last)), "py": F.coalesce(F.lag("y1").over(w), F.last("y1").over(last))})
    # A corner's neighbours, whichever way its ring runs; a corner with several sets of them is where lines meet.
    p, q = F.struct(C("px").alias("x"), C("py").alias("y")), F.struct(C("x2").alias("x"), C("y2").alias("y"))
    around = v.groupBy("x1", "y1").agg((F.count_distinct(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))) > 1).alias("fixed"))
    v = v.select("poly", "ring", "seq", "x1", "y1").join(around, ["x1", "y1"])

    def areas(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("seq")
        return d.assign(area=effective_areas(d["x1"].tolist(), d["y1"].tolist(), d["fixed"].tolist(), 3, weighting))

    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("poly", "ring", "seq")}
    schema = f"x1 double, y1 double, poly {kinds['poly']}, ring {kinds['ring']}, seq {kinds['seq']}, fixed boolean, area double"
    with held(v.select("x1", "y1", "poly", "ring", "seq", "fixed").groupBy("poly", "ring").applyInPandas(areas, schema)) as a:
        n, at = order_stats(a.select((-C("area")).alias("v")), lambda n: [max(1, math.ceil(keep * n))])
        limit = -next(iter(at.values())) if at else 0.0
    return edge_table(a.filter(C("area") >= limit), x="x1", y="y1")
