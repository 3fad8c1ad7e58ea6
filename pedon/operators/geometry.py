"""Rings, grids and masks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedon.functions import geo


def edges(vertices: DataFrame) -> DataFrame:
    """(geom_id, ring_id, x1, y1, x2, y2) of rings (geom_id, ring_id, seq, x, y); a ring is closed to its first vertex."""
    w = Window.partitionBy("geom_id", "ring_id").orderBy("seq")
    at = F.struct("x", "y")
    nxt = F.coalesce(F.lead(at).over(w), F.first(at).over(w))
    return vertices.select("geom_id", "ring_id", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def ring_areas(vertices: DataFrame) -> DataFrame:
    """(geom_id, ring_id, area), negative for clockwise rings."""
    return edges(vertices).groupBy("geom_id", "ring_id").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2.0).alias("area"))


def oriented(vertices: DataFrame) -> DataFrame:
    """Rings (geom_id, ring_id, is_exterior, seq, x, y) with exteriors clockwise and holes the other way, numbered anew from 0; rings without area stay as they are, except that exteriors are reversed."""
    area = ring_areas(vertices).select("geom_id", "ring_id", F.col("area").alias("_a"))
    last = vertices.groupBy("geom_id", "ring_id").agg(F.max("seq").alias("_last"), F.min("seq").alias("_first"))
    v = vertices.join(area, ["geom_id", "ring_id"]).join(last, ["geom_id", "ring_id"])
    clockwise = F.col("_a") < 0
    seq = F.when(F.col("is_exterior") == clockwise, F.col("seq") - F.col("_first")).otherwise(F.col("_last") - F.col("seq"))
    return v.select("geom_id", "ring_id", "is_exterior", seq.alias("seq"), "x", "y")


def vertex_counts(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("geom_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_distinct("ring_id").alias("n_rings"))


def box(vertices: DataFrame) -> DataFrame:
    """One row (min_x, min_y, max_x, max_y) of all vertices; zeros where there are none."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return vertices.agg(zero(F.min("x"), "min_x"), zero(F.min("y"), "min_y"), zero(F.max("x"), "max_x"), zero(F.max("y"), "max_y"))


def same_frame(vertices: DataFrame, zone: int | None = None, south: bool | None = None) -> DataFrame:
    """Vertices (geom_id, x, y, ...) in metres of one UTM zone, with (zone, south, epsg) of it.

    A geometry whose coordinates can all be degrees is projected; others are in
    metres already, and then a zone must be given (by the user or a projection
    file). Without one, the zone is that of the mean vertex of all degrees.
    """
    kinds = vertices.groupBy("geom_id").agg(geo.is_geographic("x", "y").alias("_degrees"))
    if zone is None:
        mean = vertices.join(kinds, "geom_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_and("_degrees").alias("all")).select(geo.utm_zone("x").alias("zone"), (F.col("y") < 0).alias("south"), "all").first()
        if mean["all"] is False:
            raise ValueError("coordinates in metres need a zone")
        zone, south = mean["zone"] or 1, bool(mean["south"])
    v = vertices.join(kinds, "geom_id")
    at = geo.forward_utm("x", "y", F.lit(zone), F.lit(bool(south)))
    pick = lambda c: F.when(F.col("_degrees"), at[c]).otherwise(F.col(c)).alias(c)
    return v.select(*[pick(c) if c in ("x", "y") else F.col(c) for c in vertices.columns], F.lit(zone).alias("zone"), F.lit(bool(south)).alias("south"), geo.epsg(F.lit(zone), F.lit(bool(south))).alias("epsg"))


def choose_zone(perimeter: DataFrame, manual: tuple[int, bool] | None = None, perimeter_prj: tuple[int, bool] | None = None, points_prj: tuple[int, bool] | None = None, points: DataFrame | None = None) -> tuple[int, bool]:
    """(zone, south) of a run: what the user gave, else the perimeter's projection file, else the points', else that of the perimeter's mean vertex.

    Every vertex counts in the mean, a ring's closing one too. Without any of
    the first three, a perimeter or points in metres are an error.
    """
    for given in (manual, perimeter_prj, points_prj):
        if given:
            return given
    both = perimeter.select("x", "y", F.lit(True).alias("ring"))
    both = both.unionByName(points.select("x", "y", F.lit(False).alias("ring"))) if points is not None else both
    mean = lambda c: F.avg(F.when(F.col("ring"), F.col(c)))
    found = both.groupBy("ring").agg(geo.is_geographic("x", "y").alias("degrees"), mean("x").alias("x"), mean("y").alias("y"))
    one = found.agg(F.bool_and("degrees").alias("degrees"), F.max("x").alias("x"), F.max("y").alias("y")).select("degrees", geo.utm_zone("x").alias("zone"), (F.col("y") < 0).alias("south")).first()
    if not one["degrees"] or one["zone"] is None:
        raise ValueError("coordinates in metres need a zone")
    return int(one["zone"]), bool(one["south"])


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("geom_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def grid(vertices: DataFrame, pixel: float) -> DataFrame:
    """(geom_id, row, col, xc, yc): cells that cover the bounds, from the north-west, one pixel wider on each side."""
    b = bounds(vertices)
    x0 = F.floor(F.col("min_x") / pixel) * pixel - pixel
    y0 = F.ceil(F.col("max_y") / pixel) * pixel + pixel
    b = b.select("geom_id", x0.alias("x0"), y0.alias("y0"), (F.ceil((F.col("max_x") - x0) / pixel) + 1).alias("nx"), (F.ceil((y0 - F.col("min_y")) / pixel) + 1).alias("ny"))
    rows = b.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("col"))
    return cells.select("geom_id", "row", "col", (F.col("x0") + (F.col("col") + 0.5) * pixel).alias("xc"), (F.col("y0") - (F.col("row") + 0.5) * pixel).alias("yc"))


def mask(vertices: DataFrame, pixel: float) -> DataFrame:
    """The grid's cells whose centre lies inside by parity: holes and several rings count alike.

    An edge is joined to the grid rows whose centres it crosses; a row's
    crossings left of a cell decide, so no cell meets an edge of another row.
    """
    cells = grid(vertices, pixel)
    lines = cells.select("geom_id", "row", "yc").distinct()
    e = edges(vertices).where("y1 <> y2")
    # rows by number, so that edges and rows meet on equal keys
    top = bounds(vertices).select("geom_id", (F.ceil(F.col("max_y") / pixel) * pixel + pixel).alias("y0"))
    number = lambda y: F.floor((F.col("y0") - y) / pixel)
    crossed = e.join(top, "geom_id").select("geom_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.greatest(number(F.greatest("y1", "y2")) - 1, F.lit(0)), number(F.least("y1", "y2")) + 1)).alias("row"))
    crossed = crossed.join(lines, ["geom_id", "row"]).where((F.col("y1") > F.col("yc")) != (F.col("y2") > F.col("yc")))
    at = F.col("x1") + (F.col("yc") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    xs = crossed.groupBy("geom_id", "row").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    inside = F.size(F.filter("xs", lambda x: x > F.col("xc"))) % 2 == 1
    return cells.join(xs, ["geom_id", "row"]).where(inside).drop("xs")
