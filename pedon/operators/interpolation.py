"""From a laboratory's report, sample points and a perimeter to maps of all elements at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.functions import geo, text
from pedon.operators import geometry, geostat, matching
from pedon.session import durable


class Run(NamedTuple):
    """zone, south: of all metres. pairs: (point_id, lab_id, confidence, method). points: (element, x, y, z). models: every fit with its errors. report: geostat.element_report with the chosen model. surface: (element, row, col, xc, yc, pred, var)."""

    zone: int
    south: bool
    pairs: DataFrame
    points: DataFrame
    models: DataFrame
    report: DataFrame
    surface: DataFrame


def values_of(lab: DataFrame, lab_col: str, elements: list[str]) -> DataFrame:
    """(lab_id, element, value, n_censored): each identifier's last value of an element that is a number, and how many of its values were below a limit; lab needs row_no."""
    long = lab.select(F.col(f"`{lab_col}`").cast("string").alias("lab_id"), "row_no", F.explode(F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"`{e}`").cast("string").alias("raw")) for e in elements])).alias("v"))
    read = long.where("lab_id IS NOT NULL").select("lab_id", "row_no", "v.element", text.br_number("v.raw").alias("n")).where("n.value IS NOT NULL")
    return read.groupBy("lab_id", "element").agg(F.max_by("n.value", "row_no").alias("value"), F.count_if("n.censored").alias("n_censored"))


def interpolate(points: DataFrame, lab: DataFrame, rings: DataFrame, elements: list[str], lab_col: str, pixel: float = 5.0, min_confidence: float = 0.85, manual: DataFrame | None = None, zone: tuple[int, bool] | None = None, perimeter_prj: tuple[int, bool] | None = None, points_prj: tuple[int, bool] | None = None) -> Run:
    """Maps of ``elements`` within the rings.

    points: (row_no, point_id, x, y), of which an identifier's first place
    counts; lab: row_no, the identifiers in ``lab_col`` and a text column for
    each element; rings: (ring_id, seq, x, y) of one perimeter, in degrees or
    metres like the points. Identifiers are matched in all layers; pairs below
    ``min_confidence`` are not used, unless ``manual`` (point_id, lab_id) gave
    them. Elements of under 8 places have a report that says so and no map.
    Values of points at one place are averaged. Predictions under 0 become 0.
    """
    one = rings.withColumn("geom_id", F.lit(1))
    z, south = geometry.choose_zone(one, zone, perimeter_prj, points_prj, points)
    at = points.groupBy("point_id").agg(F.min_by(F.struct("x", "y"), "row_no").alias("p")).select(F.lit(1).alias("geom_id"), "point_id", "p.x", "p.y")
    frame = lambda v: geometry.same_frame(v, z, south)
    perimeter, places = durable(frame(one).select("geom_id", "ring_id", "seq", "x", "y")), frame(at).select("point_id", "x", "y")
    pairs = matching.match_ids(points, lab, "point_id", lab_col, similar=True)
    pairs = durable(matching.with_manual(pairs, manual) if manual is not None else pairs)
    used = matching.confident(pairs, min_confidence)
    values = durable(values_of(lab, lab_col, elements))
    raw = durable(used.join(values, "lab_id").join(places, "point_id").select("element", "x", "y", F.col("value").alias("z")))
    censored = values.groupBy("element").agg(F.sum("n_censored").alias("n_censored"))
    held = durable(geostat.collapse(raw))
    enough = held.join(geostat.stats(held).where(F.col("n") >= geostat.LEAST_POINTS).select("element"), "element", "left_semi")
    fits = durable(geostat.fit(geostat.variogram(enough)))
    errors = durable(geostat.leave_one_out(enough, fits))
    chosen = durable(geostat.choose(fits, errors))
    cells = geometry.mask(perimeter, pixel).select("row", "col", "xc", "yc", F.explode(F.array(*map(F.lit, elements))).alias("element"))
    kriged, clamped = geostat.clamp(durable(geostat.krige(enough, cells, chosen, pixel)))
    report = geostat.element_report(raw, chosen, clamped, censored)
    best = chosen.select("element", F.col("model").alias("winner"), geo.dependence("nugget", "partial_sill").alias("dependence"), F.round(F.col("nugget") / (F.col("nugget") + F.col("partial_sill")), 3).alias("nugget_share"), "rmse_loo")
    surface = kriged.join(cells, ["element", "row", "col"]).select("element", "row", "col", "xc", "yc", "pred", "var")
    return Run(z, south, pairs, held, fits.join(errors, ["element", "model"], "left"), report.join(best, "element", "left"), surface)
