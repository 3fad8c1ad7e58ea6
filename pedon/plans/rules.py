"""Queries of the rule tables, the remaining crop rules, sheets, reports and rings, with DuckDB SQL.

The SQL has the bulletins' values written out once more, so that a slip in
``tables`` or in a formula's constant shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.functions import geo, mg, sp, tables, text
from pedon.operators import geometry, geostat, lookup, matching, registry
from pedon.plans import queries as q
from pedon.sources import writers

_D = q._D
_K, _S = q._K, q._S


def more_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = q._samples(spark, sf_dir)
    level = F.when(F.col("prem") < 20, "Baixa").when(F.col("prem") < 40, "Média").otherwise("Boa")
    credit, native, wheat = sp.residue_credit("dose", "p", "ca", "clay"), sp.native_forest_split("dose", "p", "k", "ca"), mg.wheat_irrigated("p", "dose")
    devs = F.array(mg.dop("ca", "mg"), mg.dop("p", F.lit(60.0)), F.lit(None).cast("double"))
    return s.select(
        *q._KEYS, sp.convert("ca", "cmolc_to_mmolc").alias("ca_mmolc"), sp.convert("p", "p_to_p2o5").alias("p2o5"), sp.convert("dose", "k2o_to_k").alias("k_of_k2o"),
        sp.neutralising_power_si("dose", "mg").alias("pn_si"), sp.effective_power_si("dose", "p").alias("pne"), sp.forage_gypsum_indicated("ca", "p").alias("forage_gypsum"), sp.gypsum_indicated_with_al("ca", "p", "al").alias("gypsum_al"),
        credit["k2o"].alias("credit_k"), credit["p2o5"].alias("credit_p"), sp.dry_matter("dose", "p").alias("dry"), mg.mean_balance(devs).alias("ibn"), mg.sum_of_deviations(devs).alias("dev_sum"),
        mg.response_class(F.col("ca") - 2.5, F.lit(1.5), F.lit(-2.4), F.lit(2.5)).alias("response"), mg.balanced_class("p").alias("balance"), mg.coffee_s("dose").alias("coffee_s"), sp.eucalyptus_liming("ca", "mg", 80.0).alias("euca_lime"),
        sp.nursery_liming("p", "clay", 80.0).alias("nursery"), native["n_planting"].alias("native_n"), native["k_planting"].alias("native_k"), native["b"].alias("native_b"), native["zn"].alias("native_zn"),
        mg.eucalyptus_ca("ca", 0.8).alias("euca_ca"), mg.third_steps(level).alias("thirds"), mg.maize_k_split("dose", "clay").alias("maize_k"), wheat["p2o5"].alias("wheat_p"), wheat["k2o"].alias("wheat_k"), mg.wheat_correction("clay").alias("wheat_way"),
        mg.cane_vinasse_n("p").alias("vinasse_n"), mg.substrate_dose("dose").alias("substrate"), sp.forage_p("dose", F.col("mg") > 0.5).alias("forage_p"), mg.class_factor(mg.k_class("p"), True).alias("vegetable_factor"),
        mg.gypsum_indicated("ca", "al", "p").alias("gypsum_m"), text.br_format("ca").alias("shown"),
    )


MORE_RULES = f"""{_S}, a AS (SELECT *, abs({q._num("100.0 * ca / mg - 100.0")}) AS d1, abs({q._num("100.0 * p / 60.0 - 100.0")}) AS d2 FROM s)
    SELECT {_K}, ca * {_D(10)} AS ca_mmolc, p * ({_D(1)} / {_D(0.437)}) AS p2o5, dose * {_D("0.830")} AS k_of_k2o, dose / {_D(20)} + mg / {_D(12.2)} AS pn_si, dose * (p / {_D(1000)}) AS pne,
           ca < 4 OR p > 50 AS forage_gypsum, ca < 4 OR p > 40 OR al > 5 AS gypsum_al, greatest(dose - ca, {_D(0)}) AS credit_k, greatest(p - {_D(0.5)} * clay, {_D(0)}) AS credit_p,
           dose * {_D(0.2)} + p * {_D(0.85)} AS dry, (d1 + d2) / {_D(2)} AS ibn, d1 + d2 AS dev_sum,
           CASE WHEN ca - {_D(2.5)} < {_D(-1.5)} THEN CASE WHEN ca - {_D(2.5)} = {_D(-2.4)} THEN 'positiva' ELSE 'positiva ou nula' END WHEN ca - {_D(2.5)} > {_D(1.5)} THEN CASE WHEN ca - {_D(2.5)} = {_D(2.5)} THEN 'negativa' ELSE 'negativa ou nula' END ELSE 'nula' END AS response,
           CASE WHEN p < 17 THEN NULL WHEN p <= 50 THEN 'Deficiência' WHEN p <= 83 THEN 'Marginal' WHEN p <= 117 THEN 'Adequada' WHEN p <= 150 THEN 'Elevada' WHEN p <= 183 THEN 'Excesso' END AS balance,
           dose / {_D(8)} AS coffee_s, greatest({q._num("10.0 * (20.0 - (ca + mg)) / 80.0")}, {_D(0)}) AS euca_lime, greatest({q._num("p * (60.0 - clay) / (20.0 * 80.0)")}, {_D(0)}) AS nursery,
           dose * {_D(0.5)} AS native_n, p * {_D(0.5)} AS native_k, CASE WHEN k < {_D(0.21)} THEN {_D(1)} ELSE {_D(0)} END AS native_b, CASE WHEN ca < {_D(0.6)} THEN {_D(1)} ELSE {_D(0)} END AS native_zn,
           {_D(1000)} * greatest({_D(0.8)} - ca, {_D(0)}) AS euca_ca, CASE WHEN prem < 20 THEN {_D(1)} WHEN prem < 40 THEN {_D(2)} / {_D(3)} ELSE {_D(1)} / {_D(3)} END AS thirds,
           CASE WHEN clay < 15 OR dose > 80 THEN {_D(0.5)} * dose ELSE {_D(0)} END AS maize_k, p * {_D(1.2)} AS wheat_p, dose + {_D(10)} AS wheat_k, CASE WHEN clay > 20 THEN 'total' ELSE 'gradual' END AS wheat_way,
           CASE WHEN p < 80 THEN {_D(0)} ELSE {_D(40)} END AS vinasse_n, {_D(0.5)} * dose AS substrate, CASE WHEN mg > {_D(0.5)} THEN {_D(1.3)} * dose ELSE dose END AS forage_p,
           CASE WHEN p <= 15 THEN {_D(1.2)} WHEN p <= 40 THEN {_D(1)} WHEN p <= 70 THEN {_D(0.77)} WHEN p <= 120 THEN {_D(0.53)} ELSE {_D(0.3)} END AS vegetable_factor,
           ca <= {_D(0.4)} OR al > {_D(0.5)} OR p > 30 AS gypsum_m, replace(printf('%.2f', ca), '.', ',') AS shown FROM a"""

# one row per part and attribute: a value and the clay or P-rem that it is read by
_ATTRIBUTES = "mg ph_chemical 10 5, mg ph_agronomic 10 5, mg organic_carbon 6 5, mg p_clay 60 100, mg s_prem 30 60, mg zn 3 5, mg mn 15 5, mg fe 60 5, mg cu 3 5, mg b 1 5, mg p_clay_coffee_planting 150 100, mg p_prem_coffee_planting 150 60, mg p_clay_coffee_production 40 100, mg p_prem_coffee_production 40 60, mg p_clay_vegetable 200 100, mg p_prem_vegetable 200 60, mg k_vegetable 160 5, mg k_coffee 250 5, sp k 8 5, sp p_forest 20 5, sp p_perennial 80 5, sp p_annual 100 5, sp p_vegetable 150 5, sp acidity 8 5, sp v 100 5, sp ca 10 5, sp mg 12 5, sp s 15 5, sp b 1 5, sp cu 2 5, sp fe 20 5, sp mn 8 5, sp zn 2 5, sp texture_by_om 80 5"
_WIDTHS = [tuple(x.split()) for x in _ATTRIBUTES.split(", ")]
_READINGS = (
    "SELECT p_partkey, bulletin, attribute, CAST((p_partkey * 7919) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) * top AS value, CAST((p_partkey * 104729) % 9973 AS DOUBLE) / CAST(9973 AS DOUBLE) * band_top AS band FROM {t}, ({a}) attributes"
)
_AS_ROWS = " UNION ALL ".join(f"SELECT '{b}' AS bulletin, '{a}' AS attribute, {_D(t)} AS top, {_D(w)} AS band_top" for b, a, t, w in _WIDTHS)


def soil_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's class, by the bulletins' tables."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = lambda k, m: F.pmod(F.col("p_partkey") * k, F.lit(m)).cast("double") / float(m)
    attributes = F.array(*[F.struct(F.lit(b).alias("bulletin"), F.lit(a).alias("attribute"), F.lit(float(t)).alias("top"), F.lit(float(w)).alias("band_top")) for b, a, t, w in _WIDTHS])
    rows = part.select("p_partkey", F.inline(attributes))
    rows = rows.select("p_partkey", "bulletin", "attribute", (number(7919, 997) * F.col("top")).alias("value"), (number(104729, 9973) * F.col("band_top")).alias("band"))
    return lookup.decide(rows, tables.class_limits(spark), ["bulletin", "attribute"], {"value": ("lo", "hi"), "band": ("band_lo", "band_hi")})


_CLAY4, _PREM6 = "0 15 35 60", "0 4 10 19 30 44"
_LIMITS = f"""
mg ph_chemical - 4.5 5.0 6.0 6.9 7.0 7.8
mg ph_agronomic - 4.5 5.4 6.0 7.0
mg organic_carbon - 0.40 1.16 2.32 4.06
mg p_clay {_CLAY4} - 10 20 30 45 / 6.6 12 20 30 / 4 8 12 18 / 2.7 5.4 8 12
mg s_prem {_PREM6} - 1.7 2.5 3.6 5.4 / 2.4 3.6 5.0 7.5 / 3.3 5.0 6.9 10.3 / 4.6 6.9 9.4 14.2 / 6.4 9.4 13.0 19.6 / 8.9 13.0 18.0 27.0
mg zn - 0.4 0.9 1.5 2.2
mg mn - 2 5 8 12
mg fe - 8 18 30 45
mg cu - 0.3 0.7 1.2 1.8
mg b - 0.15 0.35 0.60 0.90
mg p_clay_coffee_planting {_CLAY4} - 30 60 90 135 / 20 36 60 90 / 12 24 36 54 / 8 16 24 36
mg p_prem_coffee_planting {_PREM6} - 9 13 18 24 / 12 18 25 37.5 / 18 25 34.2 52.5 / 24 34.2 47.4 72 / 33 47.4 65.4 99 / 45 65.4 90 135
mg p_clay_coffee_production {_CLAY4} - 7.5 15 22.5 33.8 / 5 9 15 22.5 / 3 6 9 13.5 / 1.9 4 6 9
mg p_prem_coffee_production {_PREM6} - 2.3 3.2 4.5 6.8 / 3 4.5 6.2 9.4 / 4.5 6.2 8.5 13.1 / 6 8.5 11.9 18 / 8.3 11.9 16.4 24.8 / 11.3 16.4 22.5 33.8
mg p_clay_vegetable {_CLAY4} - 40 80 120 180 / 26 48 80 120 / 16 32 48 72 / 10 21 32 48
mg p_prem_vegetable {_PREM6} - 12 17.2 24 36 / 16 24 33.2 50 / 24 33.2 45.6 70 / 32 45.6 63.2 96 / 44 63.2 87.2 132 / 60 87.2 120 180
mg k_vegetable - 20 50 90 140
mg k_coffee - 60 120 200
sp k - 0.7 1.5 3.0 6.0
sp p_forest - 2 5 8 16
sp p_perennial - 5 12 30 60
sp p_annual - 6 15 40 80
sp p_vegetable - 10 25 60 120
sp acidity - 4.3 5.0 5.5 6.0
sp v - 25 50 70 90
sp ca - 3 7
sp mg - 4 8
sp s - 4 10
sp b - 0.20 0.60
sp cu - 0.2 0.8
sp fe - 4 12
sp mn - 1.2 5.0
sp zn - 0.5 1.2
sp texture_by_om - 15 30 60
"""
_NAMES = """CASE WHEN attribute = 'ph_chemical' THEN ['Acidez muito elevada', 'Acidez elevada', 'Acidez média', 'Acidez fraca', 'Neutra', 'Alcalinidade fraca', 'Alcalinidade elevada'] WHEN attribute = 'ph_agronomic' THEN ['Muito baixo', 'Baixo', 'Bom', 'Alto', 'Muito alto']
    WHEN attribute = 'k_coffee' THEN ['Baixo', 'Médio', 'Bom', 'Muito bom'] WHEN attribute = 'acidity' THEN ['Muito alta', 'Alta', 'Média', 'Baixa', 'Muito baixa'] WHEN attribute = 'v' THEN ['Muito baixa', 'Baixa', 'Média', 'Alta', 'Muito alta']
    WHEN attribute = 'texture_by_om' THEN ['arenoso', 'textura média', 'argiloso', 'acúmulo'] WHEN bulletin = 'sp' AND (attribute = 'k' OR attribute LIKE 'p@_%' ESCAPE '@') THEN ['Muito baixo', 'Baixo', 'Médio', 'Alto', 'Muito alto'] WHEN bulletin = 'sp' THEN ['Baixo', 'Médio', 'Alto']
    WHEN attribute IN ('zn', 'mn', 'fe', 'cu', 'b') THEN ['Muito baixo', 'Baixo', 'Médio', 'Bom', 'Alto'] ELSE ['Muito baixo', 'Baixo', 'Médio', 'Bom', 'Muito bom'] END"""


def _limits_sql() -> str:
    out = []
    for line in _LIMITS.strip().splitlines():
        head, rest = line.split(" - ")
        bulletin, attribute, *edges = head.split()
        for edge, top, bounds in zip(edges or ["0"], [*edges[1:], "1000"] if edges else ["1000"], rest.split(" / "), strict=True):
            out.append(f"('{bulletin}', '{attribute}', {_D(edge)}, {_D(top)}, [{', '.join(map(_D, bounds.split()))}])")
    return ", ".join(out)


SOIL_CLASSES = f"""WITH t(bulletin, attribute, edge, top, bounds) AS (VALUES {_limits_sql()}), r AS ({_READINGS.format(t="part", a=_AS_ROWS)}),
    c AS (SELECT p_partkey, r.bulletin, r.attribute, value, band, edge, 1 + len(list_filter(bounds, lambda b: value > b)) AS n FROM r JOIN t ON r.bulletin = t.bulletin AND r.attribute = t.attribute AND (band > edge OR (edge = 0 AND band = 0)) AND band <= t.top)
    SELECT p_partkey, bulletin, attribute, value, band, CAST(n AS INTEGER) AS class_no, ({_NAMES})[n] AS class_name, attribute = 'p_clay_vegetable' AND edge = 0 AND n = 2 AS doubt FROM c"""

_WANTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, crop, phase, nutrient, CAST(l_partkey % 70 AS DOUBLE) / CAST(CASE crop WHEN 'milho' THEN 5 ELSE 1 END AS DOUBLE) AS goal,
    CAST(l_suppkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE) * CAST(CASE WHEN nutrient = 'p2o5' AND crop = 'cafe' THEN 5 WHEN nutrient = 'n_foliar' THEN 4 WHEN crop = 'cafe' THEN 250 WHEN nutrient = 'k2o' THEN 5 ELSE 60 END AS DOUBLE) AS measured
    FROM (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN 'milho' ELSE 'cafe' END AS crop,
        CASE WHEN l_orderkey % 3 = 0 THEN CASE l_linenumber % 2 WHEN 0 THEN 'plantio' ELSE 'cobertura' END ELSE CASE l_linenumber % 4 WHEN 0 THEN 'plantio' WHEN 1 THEN '2o ano' ELSE 'producao' END END AS phase,
        CASE (l_partkey + l_suppkey) % 6 WHEN 0 THEN 'n' WHEN 1 THEN 'p2o5' WHEN 2 THEN 'n_foliar' WHEN 3 THEN 'n_media' ELSE 'k2o' END AS nutrient FROM {t}) wants"""


def crop_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dose of a crop's phase and nutrient, by the yield aimed at and what was measured."""
    q._tables(spark, sf_dir, "lineitem")["lineitem"].createOrReplaceTempView("_pedon_lineitem")
    rows = spark.sql(_WANTS.format(t="_pedon_lineitem"))
    got = lookup.decide(rows, tables.doses(spark), ["crop", "phase", "nutrient"], {"goal": ("goal_lo", "goal_hi"), "measured": ("lo", "hi")})
    return got.select(*rows.columns, F.col("class_no").cast("double").alias("class_no"), "dose", "unit", F.coalesce("doubt", F.lit(False)).alias("doubt"))


# crop, phase, nutrient, unit - bounds of what is measured - yields' bounds and doses by class; x: none
_DOSES = """
milho|plantio|n|kg/ha||2 4 10/4 6 20/6 8 20/8 10 30/10 12 30
milho|plantio|p2o5|kg/ha|6 15 40|2 4 60 40 30 20/4 6 80 60 40 30/6 8 90 70 50 30/8 10 x 90 60 40/10 12 x 100 70 50
milho|plantio|k2o|kg/ha|0.7 1.5 3.0|2 4 50 40 30 0/4 6 50 50 40 20/6 8 50 50 50 30/8 10 50 50 50 4/10 12 50 50 50 50
milho|cobertura|n_media|kg/ha||2 4 20/4 6 40/6 8 70/8 10 90/10 12 110
milho|cobertura|k2o|kg/ha|0.7 1.5 3.0|2 4 0 0 0 x/4 6 20 0 0 x/6 8 60 20 0 x/8 10 90 60 20 x/10 12 110 80 40 x
cafe|plantio|p2o5|g/cova|1 2 3 4|-9 999 80 65 50 35 20
cafe|2o ano|k2o|g/cova/ano|60 120 200|-9 999 60 40 20 0
cafe|producao|n|kg/ha/ano||-9 20 200/20 30 250/30 40 300/40 50 350/50 60 400/60 999 450
cafe|producao|n_foliar|kg/ha/ano|2.5 3.0 3.5|-9 20 200 140 80 x/20 30 250 175 110 x/30 40 300 220 140 x/40 50 350 260 170 x/50 60 400 300 200 x/60 999 450 340 230 x
cafe|producao|k2o|kg/ha/ano|60 120 200|-9 20 200 150 100 0/20 30 250 190 125 0/30 40 300 225 150 0/40 50 350 260 175 50/50 60 400 300 200 75/60 999 450 340 225 100
cafe|producao|p2o5|kg/ha/ano|1 2 3 4|-9 20 30 20 10 0 0/20 30 40 30 20 0 0/30 40 50 40 25 0 0/40 50 60 50 30 15 0/50 60 70 55 35 18 0/60 999 80 60 40 20 0
"""


def _doses_sql() -> str:
    out = []
    for line in _DOSES.strip().splitlines():
        crop, phase, nutrient, unit, bounds, goals = line.split("|")
        for goal in goals.split("/"):
            lo, hi, *doses = goal.split()
            out.append(f"('{crop}', '{phase}', '{nutrient}', '{unit}', CAST([{', '.join(bounds.split())}] AS DOUBLE[]), {_D(lo)}, {_D(hi)}, CAST([{', '.join('NULL' if d == 'x' else d for d in doses)}] AS DOUBLE[]))")
    return ", ".join(out)


CROP_DOSES = f"""WITH t(crop, phase, nutrient, unit, bounds, lo, hi, doses) AS (VALUES {_doses_sql()}), w AS ({_WANTS.format(t="lineitem")})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w.crop, w.phase, w.nutrient, goal, measured, CAST(CASE WHEN t.crop IS NOT NULL THEN 1 + len(list_filter(bounds, lambda b: measured > b)) END AS DOUBLE) AS class_no,
           doses[1 + len(list_filter(bounds, lambda b: measured > b))] AS dose, unit,
           coalesce(w.crop = 'milho' AND w.phase = 'plantio' AND w.nutrient = 'k2o' AND lo = 8 AND measured > 3, false) AS doubt
    FROM w LEFT JOIN t ON w.crop = t.crop AND w.phase = t.phase AND w.nutrient = t.nutrient AND goal > lo AND goal <= hi"""

_PLOTS = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 100 AS DOUBLE) AS v1, 20 + 10 * CAST(p_partkey % 4 AS INTEGER) AS growth, CAST(p_partkey % 10 AS INTEGER) AS g, CASE p_partkey % 2 WHEN 0 THEN 'formacao' ELSE 'manutencao' END AS phase FROM {t}"


def plot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forage liming by group and phase, silage by the grain's yield, potash for eucalyptus by growth, and a maize leaf's potassium."""
    q._tables(spark, sf_dir, "part")["part"].createOrReplaceTempView("_pedon_part")
    rows = spark.sql(_PLOTS.format(t="_pedon_part"))
    groups = F.array(*[F.lit(g[0]) for g in tables.FORAGE])
    rows = rows.withColumns({"forage_group": groups[F.col("g")], "grain": F.col("size") / 5.0, "element": F.lit("k"), "crop": F.lit("milho"), "nutrient": F.lit("k"), "one": F.lit(1)})
    got = lookup.decide(rows, tables.forage_targets(spark), ["forage_group", "phase"], {})
    got = lookup.decide(got, tables.silage_bands(spark).withColumn("one", F.lit(1)), ["one"], {"grain": ("lo", "hi")})
    got = lookup.decide(got, tables.eucalyptus_levels(spark), ["element", "growth"], {})
    got = lookup.decide(got, tables.leaf_ranges(spark), ["crop", "nutrient"], {})
    return got.select(
        "p_partkey", "forage_group", "phase", sp.forage_liming(F.lit(80.0), "v1", 80.0, "target_v", "most").alias("lime"), "dry_lo", "dry_hi", "fresh_lo", "fresh_hi",
        "critical", mg.eucalyptus_k("size", "critical").alias("k2o"), mg.sufficiency("size", "lo", "hi").alias("leaf_k"),
    )


_FORAGE = "('Gramíneas do Grupo I', 70, 60, 7, 3), ('Gramíneas do Grupo II', 60, 50, 6, 3), ('Gramíneas do Grupo III', 40, 40, 5, 3), ('Leguminosas do Grupo I', 70, 60, 7, 3), ('Leguminosas do Grupo II', 50, 40, 5, 3), ('Capineiras', 70, 60, 7, 3), ('Gramíneas para fenação', 70, 60, 7, 3), ('Pasto Consorciado do Grupo I', 70, 60, 7, 3), ('Pasto Consorciado do Grupo II', 50, 40, 5, 3), ('Leguminosa p/ exploração intensiva', 80, 80, 10, 5)"
PLOT_TABLES = f"""WITH f AS (SELECT row_number() OVER () - 1 AS g, * FROM (VALUES {_FORAGE}) v(name, v1f, v1m, m1f, m1m)), p AS ({_PLOTS.format(t="part")}),
    a AS (SELECT p.*, name, CAST(CASE phase WHEN 'formacao' THEN v1f ELSE v1m END AS DOUBLE) AS target, CAST(CASE phase WHEN 'formacao' THEN m1f ELSE m1m END AS DOUBLE) AS most, size / {_D(5)} AS grain, CAST(CASE growth WHEN 20 THEN 45 WHEN 30 THEN 60 WHEN 40 THEN 75 ELSE 90 END AS DOUBLE) AS critical FROM p JOIN f USING (g)),
    b AS (SELECT *, CASE WHEN grain > 2 AND grain <= 10 THEN ceil(grain / {_D(2)}) - 2 END AS step FROM a)
    SELECT p_partkey, name AS forage_group, phase, least(greatest({q._num("80.0 * (target - v1) / (10.0 * 80.0)")}, {_D(0)}), most) AS lime,
           {_D(4)} + {_D(4)} * step AS dry_lo, {_D(8)} + {_D(4)} * step AS dry_hi, {_D(13)} + {_D(13)} * step AS fresh_lo, {_D(26)} + {_D(13)} * step AS fresh_hi,
           critical, {_D(1.8)} * greatest(critical - size, {_D(0)}) AS k2o, CASE WHEN size < 17 THEN 'insuficiente' WHEN size > 35 THEN 'excessivo' ELSE 'adequado' END AS leaf_k FROM b"""


def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split doses of a table by orders (priority as the date, the largest as a stated total that is right in even months): groups whose total is wrong."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = F.col("o_custkey").alias("plot"), F.month("o_orderdate").alias("month")
    rows = o.select(*keys, F.col("o_orderpriority").alias("at"), F.rint("o_totalprice").alias("dose"))
    total = rows.groupBy("plot", "month").agg(F.sum("dose").alias("dose")).select("plot", "month", F.lit("Total").alias("at"), (F.col("dose") + F.col("month") % 2).alias("dose"))
    return lookup.total_mismatches(rows.unionByName(total), ["plot", "month"])


SPLIT_TOTALS = f"SELECT o_custkey AS plot, CAST(month(o_orderdate) AS INTEGER) AS month, sum(round_even(o_totalprice, 0)) AS dose_sum, sum(round_even(o_totalprice, 0)) + {_D(1)} AS dose_total FROM orders WHERE month(o_orderdate) % 2 = 1 GROUP BY 1, 2"

_LAB = "SELECT CAST(event_id AS {s}) AS sample, CASE event_id % 3 WHEN 0 THEN concat('T', CAST(user_id % 50 AS {s}), ' 0-20') WHEN 1 THEN concat('t', CAST(user_id % 50 AS {s}), '_10-20') ELSE '0 - 20' END AS layer, CASE event_id % 4 WHEN 0 THEN 'ND' WHEN 1 THEN ' ' ELSE replace(CAST(value AS {s}), '.', ',') END AS p, CASE event_id % 4 WHEN 3 THEN 'x' ELSE '<0,5' END AS k, CASE WHEN event_id % 9 < 7 THEN '1e2' ELSE event_type END AS kind FROM {t}"


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    q._tables(spark, sf_dir, "events")["events"].createOrReplaceTempView("_pedon_events")
    return spark.sql(_LAB.format(s="string", t="_pedon_events"))


def lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the layer 0-20."""
    return matching.lab_filter(_lab(spark, sf_dir), "0-20")


_CANON = lambda c: f"array_to_string({q._TOK(c)}, '-')"
LAB_ROWS = f"WITH r AS ({_LAB.format(s='VARCHAR', t='events')}) SELECT * FROM r WHERE " + " OR ".join(f"{_CANON(c)} = '0-20' OR {_CANON(c)} LIKE '%-0-20'" for c in ("sample", "layer", "p", "k", "kind"))


def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lab(spark, sf_dir)
    long = r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in r.columns])).alias("x")).select("x.*")
    return matching.numeric_share(long)


NUMERIC_COLUMNS = f"""WITH r AS ({_LAB.format(s="VARCHAR", t="events")}), u AS (UNPIVOT r ON COLUMNS(*) INTO NAME col VALUE v)
    SELECT col, count(*) FILTER (trim(v) <> '') AS n_filled, count(*) FILTER (trim(v) <> '' AND regexp_full_match(v, '<?[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?')) AS n_numbers,
           count(*) FILTER (trim(v) <> '') > 0 AND count(*) FILTER (trim(v) <> '' AND regexp_full_match(v, '<?[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?')) >= {_D(0.7)} * count(*) FILTER (trim(v) <> '') AS numeric FROM u GROUP BY col"""

_PAIRED = """SELECT c_custkey AS row_no, concat('T', CAST(c_nationkey AS {s}), '-', CAST(c_custkey AS {s})) AS plot_id, c_name AS name, CAST(c_nationkey AS {s}) AS zone, concat('amostra t', CAST(c_nationkey AS {s}), ' ', CAST(c_custkey AS {s})) AS sample, CAST(c_nationkey * 2 AS {s}) AS batch FROM {t}"""


def id_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of the points and the one of the report that hold the same identifiers; a third of the report is missing."""
    q._tables(spark, sf_dir, "customer")["customer"].createOrReplaceTempView("_pedon_customer")
    r = spark.sql(_PAIRED.format(s="string", t="_pedon_customer"))
    long = lambda df, cols: df.select("row_no", F.posexplode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])).alias("col_no", "x")).select("row_no", "col_no", "x.*")
    return matching.id_fields(long(r, ["plot_id", "name", "zone"]).drop("col_no"), long(r.where("row_no % 3 <> 0"), ["batch", "sample"]).drop("row_no"))


_RED = lambda c: f"array_to_string(list_filter({q._TOK(c)}, lambda x: x NOT IN ('PONTO', 'PONTOS', 'PT', 'AMOSTRA', 'AMOSTRAS', 'AM', 'SAMPLE', 'ID', 'N', 'NO', 'NUM')), '-')"
ID_FIELDS = f"""WITH r AS ({_PAIRED.format(s="VARCHAR", t="customer")}), total AS (SELECT count(*) AS n FROM r),
    p AS (SELECT row_no, col, {_RED("v")} AS key FROM (UNPIVOT (SELECT row_no, plot_id, name, zone FROM r) ON plot_id, name, zone INTO NAME col VALUE v)),
    l AS (SELECT DISTINCT col AS lab_col, {_RED("v")} AS key FROM (UNPIVOT (SELECT batch, sample FROM r WHERE row_no % 3 <> 0) ON batch, sample INTO NAME col VALUE v)),
    h AS (SELECT col, lab_col, count(*) AS hits FROM p JOIN l USING (key) WHERE key <> '' GROUP BY ALL), k AS (SELECT col, count(DISTINCT key) AS keys FROM p GROUP BY col)
    SELECT col AS point_col, lab_col, round(hits / n * (0.5 + 0.5 * keys / n), 3) AS score FROM h JOIN k USING (col), total ORDER BY hits / n * (0.5 + 0.5 * keys / n) DESC, col, lab_col LIMIT 1"""


def utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.utm(spark, sf_dir)


# Snyder's series with GRS80's e2 = 0.006694380022903416 and e'2 = 0.006739496775481622
UTM = f"""WITH r AS ({q._UTM.format(t="supplier")}), z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM r),
    a AS (SELECT *, radians(lat) AS f, radians(lon - (zone * 6 - 183)) AS l, 0.006694380022903416::DOUBLE AS e2, 0.006739496775481622::DOUBLE AS ep FROM z),
    b AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(f) * sin(f)) AS n, tan(f) * tan(f) AS t, ep * cos(f) * cos(f) AS c, cos(f) * l AS a,
          6378137.0::DOUBLE * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * f - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * f) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * f) - (35 * e2 * e2 * e2 / 3072) * sin(6 * f)) AS m FROM a)
    SELECT s_suppkey, zone, CASE WHEN lat < 0 THEN zone + 31960 ELSE zone + 31954 END AS epsg,
           round(0.9996::DOUBLE * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a * a * a * a * a / 120) + 500000, 3) AS x,
           round(0.9996::DOUBLE * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a * a * a * a * a * a / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y FROM b"""

_RECORDS = """SELECT concat('MG-', CAST(3100000 + c_nationkey AS {s}), '-', upper(md5(CAST(c_custkey AS {s})))) AS codeProperty, concat(CAST(c_custkey % 30 AS {s}), '°', CAST(c_custkey % 60 AS {s}), '''', CAST(c_custkey % 50 AS {s}), '.5"S') AS latitude,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(CAST(c_custkey % 60 AS {s}), '°', CAST(c_custkey % 59 AS {s}), '''0"W') END AS longitude, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'MG' END AS idState, 'Minas Gerais' AS nameState, c_name AS nameCity,
    CAST(c_custkey % 400 AS DOUBLE) / CAST(8 AS DOUBLE) AS fiscalModules, '2024-01-01' AS createdAt, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) / CAST(4 AS DOUBLE) END AS haRegisteredArea FROM {t}"""


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q._tables(spark, sf_dir, "customer")["customer"].createOrReplaceTempView("_pedon_customer")
    r = registry.result_rows(spark.sql(_RECORDS.format(s="string", t="_pedon_customer")))
    return r.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})


_ANGLE = lambda c: f"CAST(regexp_extract({c}, '^(\\d+)°', 1) AS DOUBLE) + CAST(regexp_extract({c}, '°(\\d+)''', 1) AS DOUBLE) / 60 + CAST(regexp_extract({c}, '''([\\d.]+)\"', 1) AS DOUBLE) / 3600"
REGISTRY_ROWS = f"""WITH r AS ({_RECORDS.format(s="VARCHAR", t="customer")})
    SELECT codeProperty AS code, round(-({_ANGLE("latitude")}), 6) AS latitude, CASE WHEN longitude <> '' THEN round(-({_ANGLE("nullif(longitude, '')")}), 6) END AS longitude, coalesce(replace(printf('%.2f', haRegisteredArea), '.', ','), '') AS area, nameCity AS place,
           nameState AS state, coalesce(idState, '') AS uf, replace(printf('%.2f', fiscalModules), '.', ',') AS modules, createdAt AS created FROM r"""

_SHEET = "SELECT c_custkey, concat(CASE WHEN c_nationkey % 2 = 0 THEN 'sp' ELSE 'MG' END, '-', lpad(CAST(CASE WHEN c_nationkey < 20 THEN 3100000 + c_nationkey ELSE 3500000 + c_nationkey END AS {s}), 7, '0'), '-', CASE WHEN c_custkey % 9 = 0 THEN 'xyz' ELSE upper(md5(CAST(c_custkey AS {s}))) END) AS code, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE ' ' END AS place FROM {t}"


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets filled offline first, then from records of a third of the codes."""
    t = q._tables(spark, sf_dir, "customer", "nation")
    t["customer"].createOrReplaceTempView("_pedon_customer")
    sheet = spark.sql(_SHEET.format(s="string", t="_pedon_customer"))
    places = t["nation"].select((F.col("n_nationkey") + 3100000).cast("string").alias("code"), F.col("n_name").alias("name"), F.lit("MG").alias("uf"))
    codes = sheet.select("code").distinct()
    offline = registry.locate(codes, places).where("uf is not null").select(text.registry_code("code").alias("code"), F.when(F.col("place") != "", F.col("place")).alias("place"), "uf")
    records = sheet.where("c_custkey % 3 = 1").select(text.registry_code("code").alias("code"), F.lit("from the record").alias("place"), F.lit("1,50").alias("area")).where("code is not null")
    return registry.fill(sheet, records, "code", ["place", "uf", "area"], offline=offline)


def sheet_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.fill_summary(_filled(spark, sf_dir), ["place", "uf", "area"])


_FILLED = f"""WITH s AS ({_SHEET.format(s="VARCHAR", t="customer")}), c AS (SELECT *, CASE WHEN regexp_full_match(upper(code), '[A-Z]{{2}}-\\d{{7}}-[0-9A-F]{{32}}') THEN substr(code, 4, 7) END AS m FROM s),
    f AS (SELECT c_custkey, code, CASE WHEN trim(place) <> '' THEN place WHEN m IS NULL THEN place WHEN c_custkey % 3 = 1 THEN 'from the record' ELSE coalesce(n_name, place) END AS place,
          CASE WHEN m IS NULL THEN NULL WHEN n_name IS NOT NULL THEN 'MG' WHEN m LIKE '31%' THEN 'MG' WHEN m LIKE '35%' THEN 'SP' END AS uf, CASE WHEN m IS NOT NULL AND c_custkey % 3 = 1 THEN '1,50' END AS area,
          CASE WHEN m IS NULL THEN 'invalid' WHEN c_custkey % 3 = 1 THEN 'found' ELSE 'not found' END AS status FROM c LEFT JOIN nation ON m = CAST(n_nationkey + 3100000 AS VARCHAR))"""
SHEET_FILL = _FILLED + " SELECT * FROM f"
SHEET_SUMMARY = _FILLED + """ SELECT count(*) AS total, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'not found') AS not_found, count(*) FILTER (status = 'found') AS found,
    count(*) FILTER (status = 'found' AND trim(coalesce(place, '')) <> '' AND trim(coalesce(uf, '')) <> '' AND trim(coalesce(area, '')) <> '') AS complete,
    count(*) FILTER (status = 'found' AND NOT (trim(coalesce(place, '')) <> '' AND trim(coalesce(uf, '')) <> '' AND trim(coalesce(area, '')) <> '')) AS partial FROM f"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with a hole in every third geometry, and exteriors."""
    r = q._rings(spark, sf_dir).withColumn("is_exterior", F.lit(True))
    hole = r.where("geom_id % 3 = 0").select("geom_id", F.lit(1).alias("ring_id"), "seq", (F.col("x") / 4 + F.col("geom_id") * 150 + 20).alias("x"), (F.col("y") / 4 + 20).alias("y"), F.lit(False).alias("is_exterior"))
    return r.unionByName(hole)


_PARTS = q._EDGES.split(", e AS")[0] + """, v AS (SELECT *, true AS is_exterior FROM r UNION ALL SELECT geom_id, 1, seq, x / 4 + geom_id * 150 + 20, y / 4 + 20, false FROM r WHERE geom_id % 3 = 0)"""


def ring_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.oriented(_parts(spark, sf_dir))


RING_ORIENTATION = _PARTS + """, a AS (SELECT v.geom_id, v.ring_id, sum(v.x * w.y - w.x * v.y) / 2 AS area FROM v JOIN v w ON v.geom_id = w.geom_id AND v.ring_id = w.ring_id AND w.seq = (v.seq + 1) % 5 GROUP BY ALL)
    SELECT geom_id, ring_id, is_exterior, CAST(CASE WHEN is_exterior = (area < 0) THEN seq ELSE 4 - seq END AS INTEGER) AS seq, x, y FROM v JOIN a USING (geom_id, ring_id)"""


def ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.vertex_counts(_parts(spark, sf_dir))


RING_COUNTS = _PARTS + " SELECT geom_id, count(*) AS n_vertices, count(DISTINCT ring_id) AS n_rings FROM v GROUP BY geom_id"


def ring_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.box(_parts(spark, sf_dir))


RING_BOX = _PARTS + " SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v"


def one_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings in degrees and in metres, all in metres of zone 23 south."""
    r = q._rings(spark, sf_dir)
    metres = r.where("geom_id % 2 = 0").withColumns({"x": F.col("x") + 290000.0, "y": F.col("y") + 7460000.0})
    degrees = r.where("geom_id % 2 = 1").withColumns({"x": F.col("x") / 50000.0 - 47.0, "y": F.col("y") / 50000.0 - 22.9})
    return geometry.same_frame(metres.unionByName(degrees), 23, True).select("geom_id", "seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "zone", "south", "epsg")


_PLANE = UTM[UTM.index("    a AS (SELECT *, radians") :].split("    SELECT s_suppkey")[0]
ONE_FRAME = q._EDGES.split(", e AS")[0] + f""", z AS (SELECT geom_id, seq, x AS x0, y AS y0, 23 AS zone, x / 50000 - 47.0::DOUBLE AS lon, y / 50000 - 22.9::DOUBLE AS lat FROM r), {_PLANE}
    SELECT geom_id, seq, CASE WHEN geom_id % 2 = 0 THEN round(x0 + 290000, 3) ELSE round(0.9996::DOUBLE * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a * a * a * a * a / 120) + 500000, 3) END AS x,
           CASE WHEN geom_id % 2 = 0 THEN round(y0 + 7460000, 3) ELSE round(0.9996::DOUBLE * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a * a * a * a * a * a / 720)) + 10000000, 3) END AS y,
           zone, true AS south, 31983 AS epsg FROM b"""


def kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("geom_id"), F.when(F.col("n_nationkey") % 4 > 0, F.concat("n_name", F.lit(" & co"))).alias("name"))
    return writers.kml_placemarks(_whole(spark, sf_dir), names)


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, whose text is the same everywhere; two polygons in every fifth geometry."""
    v = _parts(spark, sf_dir).withColumns({"poly_id": F.lit(0), "x": F.rint("x").cast("long"), "y": F.rint("y").cast("long")})
    return v.unionByName(v.where("geom_id % 5 = 0").withColumn("poly_id", F.lit(1)))


_TEXT = lambda pair, sep: f"string_agg({pair}, '{sep}' ORDER BY k) AS text"
_WHOLE = _PARTS + """, w AS (SELECT geom_id, ring_id, is_exterior, seq, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(y, 0) AS BIGINT) AS y FROM v), u AS (SELECT *, 0 AS poly_id FROM w UNION ALL SELECT *, 1 FROM w WHERE geom_id % 5 = 0),
    closed AS (SELECT *, seq AS k FROM u UNION ALL SELECT *, 9 AS k FROM u WHERE seq = 0)"""
KML = _WHOLE + f""", rings AS (SELECT geom_id, poly_id, ring_id, is_exterior, {_TEXT("x || ',' || y || ',0'", " ")} FROM closed GROUP BY ALL),
    polys AS (SELECT geom_id, poly_id, '<Polygon>' || string_agg(CASE WHEN is_exterior THEN '<outerBoundaryIs><LinearRing><coordinates>' || text || '</coordinates></LinearRing></outerBoundaryIs>' ELSE '<innerBoundaryIs><LinearRing><coordinates>' || text || '</coordinates></LinearRing></innerBoundaryIs>' END, '' ORDER BY ring_id) || '</Polygon>' AS text FROM rings GROUP BY ALL)
    SELECT geom_id, '<Placemark><name>' || CASE WHEN geom_id % 4 > 0 THEN any_value(n_name) || ' &amp; co' ELSE 'feição' END || '</name>' || CASE WHEN count(*) > 1 THEN '<MultiGeometry>' || string_agg(text, '' ORDER BY poly_id) || '</MultiGeometry>' ELSE any_value(text) END || '</Placemark>' AS kml
    FROM polys JOIN nation ON geom_id = n_nationkey GROUP BY geom_id"""


def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("geom_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return writers.geojson_features(_whole(spark, sf_dir), props)


GEOJSON = _WHOLE + f""", rings AS (SELECT geom_id, poly_id, ring_id, '[' || {_TEXT("'[' || x || ',' || y || ']'", ",").replace(" AS text", "")} || ']' AS text FROM closed GROUP BY ALL),
    polys AS (SELECT geom_id, poly_id, '[' || string_agg(text, ',' ORDER BY ring_id) || ']' AS text FROM rings GROUP BY ALL)
    SELECT geom_id, '{{"type":"Feature","properties":{{"name":"' || any_value(n_name) || '","region":' || any_value(n_regionkey) || '}},"geometry":' || CASE WHEN count(*) > 1 THEN '{{"type":"MultiPolygon","coordinates":[' || string_agg(text, ',' ORDER BY poly_id) || ']}}' ELSE '{{"type":"Polygon","coordinates":' || any_value(text) || '}}' END || '}}' AS geojson
    FROM polys JOIN nation ON geom_id = n_nationkey GROUP BY geom_id"""


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = q._ids(spark, sf_dir)
    return writers.match_report(matching.confident(matching.match_ids(ids, ids), 0.95))


MATCH_REPORT = q._MATCH + " SELECT point_id AS ponto, lab_id AS laudo, confidence AS confianca, method AS metodo FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1)"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = q._ids(spark, sf_dir)
    return writers.run_summary(ids, ids, matching.match_ids(ids, ids), 23, 31983)


RUN_SUMMARY = q._MATCH + """ SELECT 23 AS zone, 31983 AS epsg, (SELECT count(*) FROM a0) AS n_points, (SELECT count(*) FROM b0) AS n_lab, (SELECT count(*) FROM m0) + (SELECT count(*) FROM m1) + (SELECT count(*) FROM m2) AS n_pairs,
    (SELECT count(*) FROM m1) + (SELECT count(*) FROM m2) AS n_approximate, (SELECT count(*) FROM a3) AS n_point_orphans, (SELECT count(*) FROM b3) AS n_lab_orphans"""

_VALUED = "SELECT o_orderkey AS row_no, CAST(o_custkey AS {s}) AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS value, CAST(o_orderkey % 500 AS DOUBLE) AS x, CAST(o_orderkey % 400 AS DOUBLE) AS y FROM {t}"


def point_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's last value that isn't null and first place; manual pairs take the place of the matched ones."""
    q._tables(spark, sf_dir, "orders")["orders"].createOrReplaceTempView("_pedon_orders")
    r = spark.sql(_VALUED.format(s="string", t="_pedon_orders"))
    ids = r.select(F.col("id").alias("point_id"), F.col("id").alias("lab_id")).distinct().withColumns({"confidence": F.lit(1.0), "method": F.lit("canonico")})
    manual = ids.where("cast(point_id as long) % 10 = 1").select("point_id", "lab_id")
    pairs = matching.with_manual(ids, manual)
    return matching.value_at_point(pairs, r.select(F.col("id").alias("lab_id"), "row_no", "value"), r.select(F.col("id").alias("point_id"), "row_no", "x", "y"))


POINT_VALUES = f"WITH r AS ({_VALUED.format(s='VARCHAR', t='orders')}) SELECT id AS point_id, arg_min(x, row_no) AS x, arg_min(y, row_no) AS y, arg_max(value, row_no) FILTER (value IS NOT NULL) AS value FROM r GROUP BY id HAVING count(value) > 0"


def element_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q._tables(spark, sf_dir, "customer")["customer"].createOrReplaceTempView("_pedon_customer")
    r = spark.sql(q._POINTS.format(s="string", t="_pedon_customer"))
    few = r.where("x < 6").withColumn("element", F.concat(F.lit("few "), "element"))
    got = geostat.element_report(r.unionByName(few))
    return got.withColumns({"warnings": F.array_join("warnings", ","), "lowest": F.round("lowest", 6), "highest": F.round("highest", 6)})


ELEMENT_REPORT = f"""WITH r0 AS ({q._POINTS.format(s="VARCHAR", t="customer")}), r AS (SELECT * FROM r0 UNION ALL SELECT 'few ' || element, x, y, z FROM r0 WHERE x < 6), p AS (SELECT element, x, y, avg(z) AS z, count(*) AS k FROM r GROUP BY element, x, y),
    s AS (SELECT element, count(*) AS n, round(min(z), 6) AS lowest, round(max(z), 6) AS highest, round(avg(z), 4) AS mean, CAST(sum(k) - count(*) AS BIGINT) AS n_same_place FROM p GROUP BY element)
    SELECT *, CASE WHEN n >= 8 THEN CASE WHEN n > 120 THEN 'local' ELSE 'global' END END AS neighbourhood, n < 8 AS too_few, CASE WHEN n >= 8 THEN concat_ws(',', CASE WHEN n < 25 THEN 'few_points' END, CASE WHEN n_same_place > 0 THEN 'same_place' END) END AS warnings FROM s"""

_LAGS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS h, CAST(l_suppkey % 20 AS DOUBLE) / {d} AS nugget, CAST(1 + l_partkey % 9 AS DOUBLE) AS sill, CAST(10 + l_partkey % 40 AS DOUBLE) AS a FROM {t}"


def variogram_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    q._tables(spark, sf_dir, "lineitem")["lineitem"].createOrReplaceTempView("_pedon_lineitem")
    r = spark.sql(_LAGS.format(t="_pedon_lineitem", d=_D(10)))
    return r.select(*q._KEYS, *[geo.gamma(m, "h", "nugget", "sill", "a").alias(m) for m in geo.MODELS], geo.gamma("gaussian", F.lit(0.0), "nugget", "sill", "a").alias("at_zero"), geo.dependence("nugget", "sill").alias("dependence"), geo.scale_bar(F.col("h") * 37.0).alias("bar"))


VARIOGRAM_MODELS = f"""WITH r AS ({_LAGS.format(t="lineitem", d=_D(10))}), b AS (SELECT *, h * {_D(37)} / {_D(4)} AS most, pow({_D(10)}, floor(log10(h * {_D(37)} / {_D(4)}))) AS ten FROM r)
    SELECT {_K}, nugget + sill * (1 - exp(-3 * (h / a))) AS exponential, nugget + sill * (1.5 * least(h / a, 1) - 0.5 * least(h / a, 1) * least(h / a, 1) * least(h / a, 1)) AS spherical, nugget + sill * (1 - exp(-3 * ((h / a) * (h / a)))) AS gaussian, {_D(0)} AS at_zero,
           CASE WHEN nugget / (nugget + sill) <= 0.25 THEN 'forte' WHEN nugget / (nugget + sill) <= 0.75 THEN 'moderada' ELSE 'fraca' END AS dependence, CASE WHEN 5 * ten <= most THEN 5 * ten WHEN 2 * ten <= most THEN 2 * ten ELSE ten END AS bar FROM b"""

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "more_rules": (more_rules, MORE_RULES),
    "soil_classes": (soil_classes, SOIL_CLASSES),
    "crop_doses": (crop_doses, CROP_DOSES),
    "plot_tables": (plot_tables, PLOT_TABLES),
    "split_totals": (split_totals, SPLIT_TOTALS),
    "lab_rows": (lab_rows, LAB_ROWS),
    "numeric_columns": (numeric_columns, NUMERIC_COLUMNS),
    "id_fields": (id_fields, ID_FIELDS),
    "utm": (utm, UTM),
    "registry_rows": (registry_rows, REGISTRY_ROWS),
    "sheet_fill": (sheet_fill, SHEET_FILL),
    "sheet_summary": (sheet_summary, SHEET_SUMMARY),
    "ring_orientation": (ring_orientation, RING_ORIENTATION),
    "ring_counts": (ring_counts, RING_COUNTS),
    "ring_box": (ring_box, RING_BOX),
    "one_frame": (one_frame, ONE_FRAME),
    "kml": (kml, KML),
    "geojson": (geojson, GEOJSON),
    "match_report": (match_report, MATCH_REPORT),
    "run_summary": (run_summary, RUN_SUMMARY),
    "point_values": (point_values, POINT_VALUES),
    "element_report": (element_report, ELEMENT_REPORT),
    "variogram_models": (variogram_models, VARIOGRAM_MODELS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: found for name, (found, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}
