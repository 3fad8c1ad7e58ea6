"""The bulletins' class and dose tables, as DataFrames for ``lookup.decide``."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.session import durable
from pedon.sources.bulletins import joined, packaged, pipe_tables

_FIVE = ["Muito baixo", "Baixo", "Médio", "Bom", "Muito bom"]
_HIGH = ["Muito baixo", "Baixo", "Médio", "Alto", "Muito alto"]
_MICRO = ["Muito baixo", "Baixo", "Médio", "Bom", "Alto"]
_THREE = ["Baixo", "Médio", "Alto"]

# Fixed values: (bulletin, attribute, names, [(lower and upper bound of the band, upper bounds of all classes but the last)]).
# Bands: clay in % for P by clay, P-rem in mg/L for P and S by P-rem; None where there is none.
CLASS_TABLES = [
    ("mg", "ph_chemical", ["Acidez muito elevada", "Acidez elevada", "Acidez média", "Acidez fraca", "Neutra", "Alcalinidade fraca", "Alcalinidade elevada"], [(None, None, [4.5, 5.0, 6.0, 6.9, 7.0, 7.8])]),
    ("mg", "ph_agronomic", ["Muito baixo", "Baixo", "Bom", "Alto", "Muito alto"], [(None, None, [4.5, 5.4, 6.0, 7.0])]),
    ("mg", "organic_carbon", _FIVE, [(None, None, [0.40, 1.16, 2.32, 4.06])]),
    ("mg", "p_clay", _FIVE, [(60, 100, [2.7, 5.4, 8.0, 12.0]), (35, 60, [4.0, 8.0, 12.0, 18.0]), (15, 35, [6.6, 12.0, 20.0, 30.0]), (None, 15, [10.0, 20.0, 30.0, 45.0])]),
    ("mg", "s_prem", _FIVE, [(None, 4, [1.7, 2.5, 3.6, 5.4]), (4, 10, [2.4, 3.6, 5.0, 7.5]), (10, 19, [3.3, 5.0, 6.9, 10.3]), (19, 30, [4.6, 6.9, 9.4, 14.2]), (30, 44, [6.4, 9.4, 13.0, 19.6]), (44, 60, [8.9, 13.0, 18.0, 27.0])]),
    ("mg", "zn", _MICRO, [(None, None, [0.4, 0.9, 1.5, 2.2])]),
    ("mg", "mn", _MICRO, [(None, None, [2.0, 5.0, 8.0, 12.0])]),
    ("mg", "fe", _MICRO, [(None, None, [8.0, 18.0, 30.0, 45.0])]),
    ("mg", "cu", _MICRO, [(None, None, [0.3, 0.7, 1.2, 1.8])]),
    ("mg", "b", _MICRO, [(None, None, [0.15, 0.35, 0.60, 0.90])]),
    # coffee: three times the levels at planting, 0.75 times in production
    ("mg", "p_clay_coffee_planting", _FIVE, [(60, 100, [8.0, 16.0, 24.0, 36.0]), (35, 60, [12.0, 24.0, 36.0, 54.0]), (15, 35, [20.0, 36.0, 60.0, 90.0]), (None, 15, [30.0, 60.0, 90.0, 135.0])]),
    ("mg", "p_prem_coffee_planting", _FIVE, [(None, 4, [9.0, 13.0, 18.0, 24.0]), (4, 10, [12.0, 18.0, 25.0, 37.5]), (10, 19, [18.0, 25.0, 34.2, 52.5]), (19, 30, [24.0, 34.2, 47.4, 72.0]), (30, 44, [33.0, 47.4, 65.4, 99.0]), (44, 60, [45.0, 65.4, 90.0, 135.0])]),
    ("mg", "p_clay_coffee_production", _FIVE, [(60, 100, [1.9, 4.0, 6.0, 9.0]), (35, 60, [3.0, 6.0, 9.0, 13.5]), (15, 35, [5.0, 9.0, 15.0, 22.5]), (None, 15, [7.5, 15.0, 22.5, 33.8])]),
    ("mg", "p_prem_coffee_production", _FIVE, [(None, 4, [2.3, 3.2, 4.5, 6.8]), (4, 10, [3.0, 4.5, 6.2, 9.4]), (10, 19, [4.5, 6.2, 8.5, 13.1]), (19, 30, [6.0, 8.5, 11.9, 18.0]), (30, 44, [8.3, 11.9, 16.4, 24.8]), (44, 60, [11.3, 16.4, 22.5, 33.8])]),
    # vegetables: a table of their own, about four times the levels
    ("mg", "p_clay_vegetable", _FIVE, [(60, 100, [10.0, 21.0, 32.0, 48.0]), (35, 60, [16.0, 32.0, 48.0, 72.0]), (15, 35, [26.0, 48.0, 80.0, 120.0]), (None, 15, [40.0, 80.0, 120.0, 180.0])]),
    ("mg", "p_prem_vegetable", _FIVE, [(None, 4, [12.0, 17.2, 24.0, 36.0]), (4, 10, [16.0, 24.0, 33.2, 50.0]), (10, 19, [24.0, 33.2, 45.6, 70.0]), (19, 30, [32.0, 45.6, 63.2, 96.0]), (30, 44, [44.0, 63.2, 87.2, 132.0]), (44, 60, [60.0, 87.2, 120.0, 180.0])]),
    ("mg", "k_vegetable", _FIVE, [(None, None, [20.0, 50.0, 90.0, 140.0])]),
    ("mg", "k_coffee", ["Baixo", "Médio", "Bom", "Muito bom"], [(None, None, [60.0, 120.0, 200.0])]),
    ("sp", "k", _HIGH, [(None, None, [0.7, 1.5, 3.0, 6.0])]),
    ("sp", "p_forest", _HIGH, [(None, None, [2.0, 5.0, 8.0, 16.0])]),
    ("sp", "p_perennial", _HIGH, [(None, None, [5.0, 12.0, 30.0, 60.0])]),
    ("sp", "p_annual", _HIGH, [(None, None, [6.0, 15.0, 40.0, 80.0])]),
    ("sp", "p_vegetable", _HIGH, [(None, None, [10.0, 25.0, 60.0, 120.0])]),
    ("sp", "acidity", ["Muito alta", "Alta", "Média", "Baixa", "Muito baixa"], [(None, None, [4.3, 5.0, 5.5, 6.0])]),
    ("sp", "v", ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"], [(None, None, [25.0, 50.0, 70.0, 90.0])]),
    ("sp", "ca", _THREE, [(None, None, [3.0, 7.0])]),
    ("sp", "mg", _THREE, [(None, None, [4.0, 8.0])]),
    ("sp", "s", _THREE, [(None, None, [4.0, 10.0])]),
    ("sp", "b", _THREE, [(None, None, [0.20, 0.60])]),
    ("sp", "cu", _THREE, [(None, None, [0.2, 0.8])]),
    ("sp", "fe", _THREE, [(None, None, [4.0, 12.0])]),
    ("sp", "mn", _THREE, [(None, None, [1.2, 5.0])]),
    ("sp", "zn", _THREE, [(None, None, [0.5, 1.2])]),
    ("sp", "texture_by_om", ["arenoso", "textura média", "argiloso", "acúmulo"], [(None, None, [15.0, 30.0, 60.0])]),
]
#: Classes whose bounds look like misprints in the source: (attribute, band from, class); the next class's bound is used.
DOUBTFUL_CLASSES = {("p_clay_vegetable", None, 2)}

# Fixed values: (bulletin, crop, phase, nutrient, unit, what is measured, upper bounds of its classes but the last,
# [(lower and upper bound of the expected yield, dose of each class)]). None: no dose given.
DOSE_TABLES = [
    ("sp", "milho", "plantio", "n", "kg/ha", None, [], [(2, 4, [10]), (4, 6, [20]), (6, 8, [20]), (8, 10, [30]), (10, 12, [30])]),
    ("sp", "milho", "plantio", "p2o5", "kg/ha", "p", [6, 15, 40], [(2, 4, [60, 40, 30, 20]), (4, 6, [80, 60, 40, 30]), (6, 8, [90, 70, 50, 30]), (8, 10, [None, 90, 60, 40]), (10, 12, [None, 100, 70, 50])]),
    ("sp", "milho", "plantio", "k2o", "kg/ha", "k", [0.7, 1.5, 3.0], [(2, 4, [50, 40, 30, 0]), (4, 6, [50, 50, 40, 20]), (6, 8, [50, 50, 50, 30]), (8, 10, [50, 50, 50, 4]), (10, 12, [50, 50, 50, 50])]),
    ("sp", "milho", "cobertura", "n_alta", "kg/ha", None, [], [(2, 4, [40]), (4, 6, [60]), (6, 8, [100]), (8, 10, [120]), (10, 12, [140])]),
    ("sp", "milho", "cobertura", "n_media", "kg/ha", None, [], [(2, 4, [20]), (4, 6, [40]), (6, 8, [70]), (8, 10, [90]), (10, 12, [110])]),
    ("sp", "milho", "cobertura", "n_baixa", "kg/ha", None, [], [(2, 4, [10]), (4, 6, [20]), (6, 8, [40]), (8, 10, [50]), (10, 12, [70])]),
    ("sp", "milho", "cobertura", "k2o", "kg/ha", "k", [0.7, 1.5, 3.0], [(2, 4, [0, 0, 0, None]), (4, 6, [20, 0, 0, None]), (6, 8, [60, 20, 0, None]), (8, 10, [90, 60, 20, None]), (10, 12, [110, 80, 40, None])]),
    ("mg", "cafe", "pos-plantio", "k2o", "g/cova/ano", "k", [60, 120, 200], [(None, None, [30, 20, 10, 0])]),
    ("mg", "cafe", "1o ano", "k2o", "g/cova/ano", "k", [60, 120, 200], [(None, None, [40, 20, 10, 0])]),
    ("mg", "cafe", "2o ano", "k2o", "g/cova/ano", "k", [60, 120, 200], [(None, None, [60, 40, 20, 0])]),
    ("mg", "cafe", "producao", "n_foliar", "kg/ha/ano", "leaf_n", [2.5, 3.0, 3.5], [(None, 20, [200, 140, 80, None]), (20, 30, [250, 175, 110, None]), (30, 40, [300, 220, 140, None]), (40, 50, [350, 260, 170, None]), (50, 60, [400, 300, 200, None]), (60, None, [450, 340, 230, None])]),
    ("mg", "cafe", "producao", "n", "kg/ha/ano", None, [], [(None, 20, [200]), (20, 30, [250]), (30, 40, [300]), (40, 50, [350]), (50, 60, [400]), (60, None, [450])]),
    ("mg", "cafe", "producao", "k2o", "kg/ha/ano", "k", [60, 120, 200], [(None, 20, [200, 150, 100, 0]), (20, 30, [250, 190, 125, 0]), (30, 40, [300, 225, 150, 0]), (40, 50, [350, 260, 175, 50]), (50, 60, [400, 300, 200, 75]), (60, None, [450, 340, 225, 100])]),
    ("mg", "cafe", "producao", "p2o5", "kg/ha/ano", "p_class", [1, 2, 3, 4], [(None, 20, [30, 20, 10, 0, 0]), (20, 30, [40, 30, 20, 0, 0]), (30, 40, [50, 40, 25, 0, 0]), (40, 50, [60, 50, 30, 15, 0]), (50, 60, [70, 55, 35, 18, 0]), (60, None, [80, 60, 40, 20, 0])]),
    ("mg", "cafe", "plantio", "p2o5", "g/cova", "p_class", [1, 2, 3, 4], [(None, None, [80, 65, 50, 35, 20])]),
]
#: Doses that look like misprints in the source: (crop, phase, nutrient, expected yield from, class).
DOUBTFUL = {("milho", "plantio", "k2o", 8, 4)}

# Target base saturation (%) and largest limestone dose (t/ha) of forage groups: forming, maintenance.
FORAGE = [
    ("Gramíneas do Grupo I", 70, 60, 7, 3),
    ("Gramíneas do Grupo II", 60, 50, 6, 3),
    ("Gramíneas do Grupo III", 40, 40, 5, 3),
    ("Leguminosas do Grupo I", 70, 60, 7, 3),
    ("Leguminosas do Grupo II", 50, 40, 5, 3),
    ("Capineiras", 70, 60, 7, 3),
    ("Gramíneas para fenação", 70, 60, 7, 3),
    ("Pasto Consorciado do Grupo I", 70, 60, 7, 3),
    ("Pasto Consorciado do Grupo II", 50, 40, 5, 3),
    ("Leguminosa p/ exploração intensiva", 80, 80, 10, 5),
]

# t/ha of maize grain, dry and fresh matter of the plants (lower and upper bounds).
SILAGE = [(2, 4, 4, 8, 13, 26), (4, 6, 8, 12, 26, 39), (6, 8, 12, 16, 39, 52), (8, 10, 16, 20, 52, 65)]

# Critical levels of eucalyptus soils at a growth of 20, 30, 40 and 50 m3/ha/year.
EUCALYPTUS = [("p_clay", [4.3, 4.3, 4.4, 4.5]), ("p_sand", [6.2, 6.3, 6.4, 6.5]), ("k", [45, 60, 75, 90]), ("ca", [0.45, 0.60, 0.70, 0.80]), ("mg", [0.10, 0.13, 0.16, 0.19])]

# Adequate leaf contents of cereals: g/kg of N, P, K, Ca, Mg and S; mg/kg of B, Cu, Fe, Mn, Mo and Zn.
LEAF_NUTRIENTS = ["n", "p", "k", "ca", "mg", "s", "b", "cu", "fe", "mn", "mo", "zn"]
LEAF_RANGES = """
arroz    27-35 1.8-3.0 13-30 2.5-10.0 1.5-5.0 1.4-3.0  4-25  3-25 70-200 70-400 0.1-0.3 10-50
aveia    20-30 2.0-5.0 15-30 2.5-5.0  1.5-5.0 1.5-4.0  5-20  5-25 40-150 25-100 0.2-0.3 15-70
centeio  25-35 2.0-5.0 19-23 2.5-6.0  1.5-5.0 1.5-5.0  5-20  5-25 25-200 14-150 0.2-2.0 15-70
cevada   17-30 2.0-5.0 15-30 2.5-6.0  1.5-5.0 1.5-4.0  5-20  5-25 25-100 20-100 0.1-0.2 15-70
milho    27-35 2.0-4.0 17-35 2.5-8.0  1.5-5.0 1.5-3.0 10-25  6-20 30-250 20-200 0.1-0.2 15-100
sorgo    25-35 2.0-4.0 14-25 2.5-6.0  1.5-5.0 1.5-3.0  4-20  5-20 65-100 10-190 0.1-0.3 15-50
trigo    20-34 2.1-3.3 15-30 2.5-10.0 1.5-4.0 1.5-3.0  5-20  5-25 10-300 25-150 0.3-0.5 20-70
"""


def _spans(upper: list[float]) -> list[tuple[float | None, float | None]]:
    return list(pairwise([None, *upper, None]))


def class_limits(spark: SparkSession) -> DataFrame:
    """(bulletin, attribute, band_lo, band_hi, lo, hi, class_no, class_name, doubt); a null bound is open."""
    f = lambda x: None if x is None else float(x)
    rows = [
        (bulletin, attribute, f(a), f(b), f(lo), f(hi), i + 1, names[i], (attribute, a, i + 1) in DOUBTFUL_CLASSES)
        for bulletin, attribute, names, bands in CLASS_TABLES
        for a, b, upper in bands
        for i, (lo, hi) in enumerate(_spans(upper))
    ]
    return spark.createDataFrame(rows, "bulletin string, attribute string, band_lo double, band_hi double, lo double, hi double, class_no int, class_name string, doubt boolean")


def doses(spark: SparkSession) -> DataFrame:
    """(bulletin, crop, phase, nutrient, goal_lo, goal_hi, measure, lo, hi, class_no, dose, unit, doubt)."""
    f = lambda x: None if x is None else float(x)
    rows = [
        (bulletin, crop, phase, nutrient, f(a), f(b), measure, f(lo), f(hi), i + 1, f(d[i]), unit, (crop, phase, nutrient, a, i + 1) in DOUBTFUL)
        for bulletin, crop, phase, nutrient, unit, measure, upper, goals in DOSE_TABLES
        for a, b, d in goals
        for i, (lo, hi) in enumerate(_spans(upper))
    ]
    return spark.createDataFrame(rows, "bulletin string, crop string, phase string, nutrient string, goal_lo double, goal_hi double, measure string, lo double, hi double, class_no int, dose double, unit string, doubt boolean")


def forage_targets(spark: SparkSession) -> DataFrame:
    """(forage_group, phase, target_v, most): phase is formacao or manutencao."""
    rows = [(g, phase, float(v), float(m)) for g, v1, v2, m1, m2 in FORAGE for phase, v, m in (("formacao", v1, m1), ("manutencao", v2, m2))]
    return spark.createDataFrame(rows, "forage_group string, phase string, target_v double, most double")


def silage_bands(spark: SparkSession) -> DataFrame:
    """(lo, hi, dry_lo, dry_hi, fresh_lo, fresh_hi) by the yield of grain, t/ha."""
    return spark.createDataFrame([tuple(map(float, r)) for r in SILAGE], "lo double, hi double, dry_lo double, dry_hi double, fresh_lo double, fresh_hi double")


def eucalyptus_levels(spark: SparkSession) -> DataFrame:
    """(element, growth, critical): p_clay and p_sand are P in clayey and sandy soil."""
    return spark.createDataFrame([(e, g, float(x)) for e, levels in EUCALYPTUS for g, x in zip((20, 30, 40, 50), levels, strict=True)], "element string, growth int, critical double")


def leaf_ranges(spark: SparkSession) -> DataFrame:
    """(crop, nutrient, lo, hi) of cereals."""
    rows = [(crop, n, *map(float, r.split("-"))) for crop, *ranges in map(str.split, LEAF_RANGES.strip().splitlines()) for n, r in zip(LEAF_NUTRIENTS, ranges, strict=True)]
    return spark.createDataFrame(rows, "crop string, nutrient string, lo double, hi double")


def bulletins(spark: SparkSession) -> DataFrame:
    """Every table of the packaged bulletins, with ranges closed up (sources.bulletins.joined); written once, so that look-ups don't parse it again."""
    return durable(joined(pipe_tables(packaged(spark))))


def leaf_contents(tables: DataFrame) -> DataFrame:
    """(bulletin, crop, nutrient, lo, hi) of the leaf tables among ``tables``; values that are left out have no row."""
    leaf = tables.where("by = 'crop' AND stage = 'folha' AND value_lo IS NOT NULL")
    return leaf.select("bulletin", F.col("row").alias("crop"), "nutrient", F.col("value_lo").alias("lo"), F.col("value_hi").alias("hi"))


def split_doses(tables: DataFrame) -> DataFrame:
    """(crop, stage, nutrient, level, at, dose) of the tables by date that end with a row "Total"."""
    dated = tables.where("by = 'at'").select("source", "table_no", "crop", "stage", "nutrient", "level", F.col("row").alias("at"), F.col("value_lo").alias("dose"))
    return dated.join(dated.where("at = 'Total'").select("source", "table_no").distinct(), ["source", "table_no"], "left_semi").drop("source", "table_no")
