"""Fertiliser quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedon.functions.rounding import col, rnd

X = Column | str | float

# Nutrient content of common sources in %.
SOURCES = {
    "ureia": {"N": 44.0},
    "sulfato_amonio": {"N": 20.0},
    "superfosfato_simples": {"P2O5": 18.0},
    "superfosfato_triplo": {"P2O5": 41.0},
    "cloreto_potassio": {"K2O": 58.0},
    "MAP": {"N": 9.0, "P2O5": 48.0},
    "DAP": {"N": 16.0, "P2O5": 45.0},
}


def quantity(dose: X, content: X) -> Column:
    """kg/ha of a product with content % of the nutrient; null where content is not positive."""
    return F.when(col(content) > 0, rnd(col(dose) * 100.0 / col(content), 1))


def blend(n: X, p2o5: X, k2o: X, sources: tuple[float, float, float]) -> Column:
    """struct(n_kg, p_kg, k_kg, total) of three simple sources; the total adds the rounded parts."""
    a, b, c = (F.when(col(x) > 0, quantity(x, t)).otherwise(0.0) for x, t in zip((n, p2o5, k2o), sources, strict=True))
    return F.struct(a.alias("n_kg"), b.alias("p_kg"), c.alias("k_kg"), rnd(a + b + c, 1).alias("total"))


def ratio(n: X, p: X, k: X) -> Column:
    """struct(n, p, k) divided by the smallest positive dose; zeros where none is positive."""
    least = F.array_min(F.filter(F.array(col(n), col(p), col(k)), lambda x: x > 0))
    part = lambda x: F.when(least.isNull(), 0.0).otherwise(rnd(col(x) / least, 2))
    return F.struct(part(n).alias("n"), part(p).alias("p"), part(k).alias("k"))


def formula_quantity(doses: tuple[X, X, X], contents: tuple[X, X, X]) -> Column:
    """kg/ha of a formula by the first nutrient that is both needed and contained; null where none is."""
    return F.coalesce(*[F.when((col(d) > 0) & (col(c) > 0), rnd(col(d) / col(c) * 100.0, 1)) for d, c in zip(doses, contents, strict=True)])


def per_furrow(kg_ha: X, spacing: X) -> Column:
    """struct(metres_ha, g_metre) for rows spacing metres apart."""
    metres = 10000.0 / col(spacing)
    return F.when(col(spacing) > 0, F.struct(rnd(metres, 0).alias("metres_ha"), rnd(col(kg_ha) * 1000.0 / metres, 1).alias("g_metre")))


def per_hole(kg_ha: X, row: X, plant: X) -> Column:
    """struct(holes_ha, g_hole) for rows and plants so many metres apart."""
    holes = 10000.0 / (col(row) * col(plant))
    return F.when(col(row) * col(plant) > 0, F.struct(rnd(holes, 0).alias("holes_ha"), rnd(col(kg_ha) * 1000.0 / holes, 2).alias("g_hole")))
