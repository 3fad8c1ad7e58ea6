"""The engine's queries over the test tables, by name, and DuckDB SQL that gives the same rows.

The tables hold no soil data, so views derive samples, identifiers, points and
rings from them; each view is one SQL text that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.functions import geo, mg, npk, sp, text
from pedon.operators import geometry, geostat, lookup, matching, registry
from pedon.session import durable

_D = "CAST({} AS DOUBLE)".format
# one row per order line: contents of a soil sample
SAMPLES = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / {_D(10)} AS ca, {_D("l_linenumber")} / {_D(5)} AS mg, l_discount AS k, l_tax * {_D(20)} AS al,
           {_D("l_partkey % 90")} / {_D(10)} + {_D("0.1")} AS h_al, {_D("l_suppkey % 61")} AS prem, {_D("l_partkey % 96")} AS clay, {_D("l_orderkey % 130")} AS p,
           {_D("l_orderkey % 7")} / {_D(2)} + {_D(3.5)} AS ph, {_D("l_suppkey % 90")} AS dose
    FROM lineitem
"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    f = lambda s: F.expr(s)
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f("l_quantity / 10D").alias("ca"), f("cast(l_linenumber as double) / 5D").alias("mg"), F.col("l_discount").alias("k"), f("l_tax * 20D").alias("al"),
        f("cast(l_partkey % 90 as double) / 10D + 0.1D").alias("h_al"), f("cast(l_suppkey % 61 as double)").alias("prem"), f("cast(l_partkey % 96 as double)").alias("clay"), f("cast(l_orderkey % 130 as double)").alias("p"),
        f("cast(l_orderkey % 7 as double) / 2D + 3.5D").alias("ph"), f("cast(l_suppkey % 90 as double)").alias("dose"),
    )


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_KEYS)
_S = f"WITH s AS ({SAMPLES})"


def _r(x: str, digits: int) -> str:
    return f"floor(({x}) * {_D(10**digits)} + {_D('0.5')}) / {_D(10**digits)}"


def _ladder(x: str, bounds: list[float], labels: list) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else _D(v)
    return "CASE " + " ".join(f"WHEN {x} <= {_D(b)} THEN {q(v)}" for b, v in zip(bounds, labels, strict=False)) + f" ELSE {q(labels[-1])} END"


def _num(sql: str) -> str:
    """Every number in a formula as a double, so that no engine computes in decimals."""
    import re

    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", r"CAST(\1 AS DOUBLE)", sql)


def _flat(df: DataFrame, keys: list[str], **structs) -> DataFrame:
    """Keys, plain columns, and the fields of the structs."""
    out = df.select(*keys, *[c.alias(n) for n, c in structs.items()])
    cols = [f"{n}.*" if out.schema[n].dataType.typeName() == "struct" else n for n in structs]
    return out.select(*keys, *cols)


def mg_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    return _flat(s, _KEYS, i=mg.indices("ca", "mg", "k", "al", "h_al"), class_ca=mg.class_of("ca", "ca"), class_al=mg.display_class("al", "al"), class_p=mg.p_class("p", "prem"), class_k=mg.k_class("p"), f_texture=mg.texture_factor("clay"), f_prem=mg.prem_factor("prem"), f_class=mg.class_factor(mg.p_class("p", "prem")))


# Fixed values, typed apart from the operators': classes; P's upper class bounds by P-rem; K's; factors by P-rem and class; acidity and saturation classes; words that carry nothing.
_CLASSES, _HIGH = ["Muito baixo", "Baixo", "Médio", "Bom", "Muito bom"], ["Muito baixo", "Baixo", "Médio", "Alto", "Muito alto"]
_P_BY_PREM = [(4, [3, 4.3, 6, 9]), (10, [4, 6, 8.3, 12.5]), (19, [6, 8.3, 11.4, 17.5]), (30, [8, 11.4, 15.8, 24]), (44, [11, 15.8, 21.8, 33]), (None, [15, 21.8, 30, 45])]
_K_CLASSES, _F_PREM, _F_CLASS = [15, 40, 70, 120], [1.3, 1.15, 1, 0.85, 0.7, 0.6], [1.25, 1, 0.8, 0.6, 0.4]
_ACIDITY = ([4.3, 5, 5.5, 6], ["Muito alta", "Alta", "Média", "Baixa", "Muito baixa"])
_SATURATION = ([25, 50, 70, 90], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"])
_EMPTY_WORDS = "PONTO PONTOS PT AMOSTRA AMOSTRAS AM SAMPLE ID N NO NUM".split()

_BANDS = "CASE " + " ".join(f"WHEN prem <= {_D(t)} THEN ({_ladder('p', b, _CLASSES)})" for t, b in _P_BY_PREM[:-1]) + f" ELSE ({_ladder('p', _P_BY_PREM[-1][1], _CLASSES)}) END"
MG_INDICES = f"""{_S}, b AS (SELECT *, ca + mg + k + {_D(0)} AS b0 FROM s)
    SELECT {_K}, {_r("b0", 2)} AS sb, {_r("b0 + al", 2)} AS t_eff, {_r("b0 + h_al", 2)} AS cec, {_r(_num("100.0 * b0 / (b0 + h_al)"), 1)} AS v,
           CASE WHEN b0 + al > 0 THEN {_r(_num("100.0 * al / (b0 + al)"), 1)} ELSE {_D(0)} END AS m,
           {_ladder("ca", [0.4, 1.2, 2.4, 4], _CLASSES)} AS class_ca, {_ladder("al", [0.2, 0.5, 1, 2], _HIGH)} AS class_al,
           {_BANDS} AS class_p, {_ladder("p", _K_CLASSES, _CLASSES)} AS class_k,
           CASE WHEN clay > 60 THEN {_D(1.25)} WHEN clay >= 35 THEN {_D(1)} WHEN clay >= 15 THEN {_D(0.8)} ELSE {_D(0.6)} END AS f_texture,
           {_ladder("prem", [b for b, _ in _P_BY_PREM[:-1]], _F_PREM)} AS f_prem,
           CASE {_BANDS} {" ".join(f"WHEN '{c}' THEN {_D(x)}" for c, x in zip(_CLASSES, _F_CLASS, strict=True))} END AS f_class FROM b"""


def mg_liming(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    sb = mg.sum_of_bases("ca", "mg", "k")
    a = mg.liming_al_camg("al", "ca", "mg", mg.effective_cec(sb, "al"), 15.0, 3.5, mg.buffer_by_clay("clay"))
    b = mg.liming_saturation(sb, "h_al", 60.0)
    return _flat(s, _KEYS, y_prem=mg.buffer_by_prem("prem"), a=a, b=F.struct(b["va"].alias("va"), b["nc"].alias("nc_v")), lime=mg.limestone(b["nc"], 75.0, 20.0, 90.0), cane=mg.cane_liming("ca", "mg", sb, "h_al"), hole=mg.hole_limestone("dose", 64.0), furrow=mg.furrow_limestone("dose", 64.0), rubber=mg.rubber_liming("ca", "mg"))


MG_LIMING = f"""{_S}, b AS (SELECT *, ca + mg + k + {_D(0)} AS b0 FROM s),
    c AS (SELECT *, {_num("0.0302 + 0.06532 * clay - 0.000257 * clay * clay")} AS y, b0 + h_al AS big, b0 + al AS t FROM b),
    d AS (SELECT *, greatest({_num("y * (al - 15.0 * t / 100.0)")}, {_D(0)}) AS acid, greatest({_num("3.5 - (ca + mg)")}, {_D(0)}) AS lack,
                 {_r(f"greatest({_num('60.0 / 100.0 * big - b0')}, {_D(0)})", 2)} AS nc_v FROM c)
    SELECT {_K}, {_num("4.002 - 0.125901 * prem + 0.001205 * prem * prem - 0.00000362 * prem * prem * prem")} AS y_prem,
           {_r("acid", 3)} AS ca_part, {_r("lack", 3)} AS cd_part, {_r("acid + lack", 2)} AS nc, {_r(_num("100.0 * b0 / big"), 1)} AS va, nc_v,
           {_r(_num("nc_v * (75.0 / 100.0) * (20.0 / 20.0) * (100.0 / 90.0)"), 3)} AS lime,
           {_r(f"greatest(least({_num('3.0 - (ca + mg)')}, {_num('0.6 * big - b0')}), {_D(0)})", 2)} AS cane,
           {_num("dose * 64.0 / 2.0")} AS hole, {_num("2.5 * (dose * 64.0 / 2.0)")} AS furrow, greatest({_num("1.0 - (ca + mg)")}, {_D(0)}) AS rubber FROM d"""


def mg_gypsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    return _flat(s, _KEYS, needed=mg.gypsum_indicated("ca", "al"), by_clay=mg.gypsum_by_clay("clay"), by_prem=mg.gypsum_by_prem("prem"), by_nc=mg.gypsum_by_liming("dose"), qty=mg.gypsum(mg.gypsum_by_clay("clay"), 75.0, 30.0), cane_kg=mg.cane_gypsum("clay", "ca"))


_CLAY = _r(_num("0.00034 - 0.002445 * sqrt(clay) + 0.0338886 * clay - 0.00176366 * clay * sqrt(clay)"), 3)
_CA = _num("315.8 - 25.5066 * sqrt(prem) - 5.70675 * prem + 0.485335 * prem * sqrt(prem)")
MG_GYPSUM = f"""{_S} SELECT {_K}, ca <= {_D(0.4)} OR al > {_D(0.5)} AS needed, {_CLAY} AS by_clay, {_r(_CA, 1)} AS ca_kg, {_r(f"({_CA}) / ({_D(10)} * {_D(18.75)})", 3)} AS ng,
    {_r(_num("0.25 * dose"), 3)} AS by_nc, {_r(f"({_CLAY}) * ({_D(75)} / {_D(100)}) * ({_D(30)} / {_D(20)})", 3)} AS qty,
    CASE WHEN ca < {_D(0.4)} THEN clay * {_D(60)} ELSE {_D(0)} END AS cane_kg FROM s"""


def fertiliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    total = npk.formula_quantity(("dose", "p", "clay"), (4.0, 16.0, 8.0))
    return _flat(s, _KEYS, b=npk.blend("dose", "p", "clay", (44.0, 18.0, 58.0)), r=npk.ratio("dose", "p", "clay"), formula=total, f=npk.per_furrow("dose", 0.8), h=npk.per_hole("dose", 0.8, 0.2))


_LEAST = f"least(CASE WHEN dose > 0 THEN dose ELSE {_D('1e300')} END, CASE WHEN p > 0 THEN p ELSE {_D('1e300')} END, CASE WHEN clay > 0 THEN clay ELSE {_D('1e300')} END)"
_PART = lambda x, t: f"CASE WHEN {x} > 0 THEN {_r(f'{x} * {_D(100)} / {_D(t)}', 1)} ELSE {_D(0)} END"
FERTILISER = f"""{_S}, a AS (SELECT *, {_PART("dose", 44)} AS n_kg, {_PART("p", 18)} AS p_kg, {_PART("clay", 58)} AS k_kg, {_LEAST} AS low FROM s)
    SELECT {_K}, n_kg, p_kg, k_kg, {_r("n_kg + p_kg + k_kg", 1)} AS total,
           {", ".join(f"CASE WHEN low > {_D('1e299')} THEN {_D(0)} ELSE {_r(f'{x} / low', 2)} END AS {n}" for x, n in (("dose", "n"), ("p", "p"), ("clay", "k")))},
           CASE WHEN dose > 0 THEN {_r(_num("dose / 4.0 * 100.0"), 1)} WHEN p > 0 THEN {_r(_num("p / 16.0 * 100.0"), 1)} WHEN clay > 0 THEN {_r(_num("clay / 8.0 * 100.0"), 1)} END AS formula,
           {_r(_num("10000.0 / 0.8"), 0)} AS metres_ha, {_r(_num("dose * 1000.0 / (10000.0 / 0.8)"), 1)} AS g_metre,
           {_r(_num("10000.0 / (0.8 * 0.2)"), 0)} AS holes_ha, {_r(_num("dose * 1000.0 / (10000.0 / (0.8 * 0.2))"), 2)} AS g_hole FROM a"""


def sp_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    big = sp.cec(sp.sum_of_bases("ca", "mg", "k"), "h_al")
    v = sp.base_saturation(sp.sum_of_bases("ca", "mg", "k"), big)
    return _flat(s, _KEYS, a=sp.analysis("ca", "mg", "k", "h_al", "al", "ph"), lime=sp.liming(big, v, 70.0, 80.0), lime_si=sp.liming_si(big, v, 70.0, 9.0), gypsum=sp.gypsum("clay"), gypsum_needed=sp.gypsum_indicated("ca", "p"), prnt=sp.prnt(sp.neutralising_power("dose", "mg"), sp.reactivity("dose", "p", "clay")), c=sp.cane_liming(big, v, 80.0, "mg"), extras=sp.maize_s_zn("ca", "mg"), soy=sp.soybean_extras("ca", "mg", "p"))


SP_ANALYSIS = f"""{_S}, b AS (SELECT *, ca + mg + k + {_D(0)} AS b0 FROM s), c AS (SELECT *, b0 + h_al AS big, {_num("100.0 * b0 / (b0 + h_al)")} AS v0 FROM b),
    d AS (SELECT *, {_num("big * (70.0 - v0) / (10.0 * 80.0)")} AS need, greatest({_num("big * (60.0 - v0) / (10.0 * 80.0)")}, {_D(0)}) AS cane FROM c),
    e AS (SELECT *, CASE WHEN cane > 0 THEN least(greatest(cane, {_D(1)}), {_D(5)}) ELSE {_D(0)} END AS nc0 FROM d)
    SELECT {_K}, {_r("b0", 2)} AS sb, {_r("big", 2)} AS cec, {_r("b0 + al", 2)} AS t_eff, {_r("v0", 1)} AS v,
           CASE WHEN b0 + al > 0 THEN {_r(_num("100.0 * al / (b0 + al)"), 1)} ELSE {_D(0)} END AS m, {_ladder("ph", *_ACIDITY)} AS acidity, {_ladder("v0", *_SATURATION)} AS saturation,
           CASE WHEN need <= 0 THEN {_D(0)} ELSE greatest(ceil(need), {_D(1)}) END AS lime, {_r(f"greatest({_num('2.0 * big * (70.0 - v0) / (100.0 * 9.0)')}, {_D(0)})", 2)} AS lime_si,
           {_r(_num("6.0 * clay"), 1)} AS gypsum, ca < 4 OR p > 40 AS gypsum_needed, {_num("(dose * 1.79 + mg * 2.48) * (0.2 * dose + 0.6 * p + clay) / 100.0")} AS prnt,
           CASE WHEN mg < 5 THEN greatest(nc0, {_D(1)}) ELSE nc0 END AS nc, mg < 5 AS dolomitic,
           CASE WHEN ca <= 6 THEN {_D(20)} ELSE {_D(40)} END AS s, CASE WHEN mg < {_D(0.6)} THEN {_D(4)} WHEN mg <= {_D(1.2)} THEN {_D(2)} ELSE {_D(0)} END AS zn,
           {_num("15.0 * ca")} AS s_soy, CASE WHEN mg <= {_D(1.5)} THEN {_D(5)} ELSE {_D(0)} END AS mn, CASE WHEN p > 50 THEN {_num("0.5 * p")} ELSE {_D(0)} END AS k_topdressing FROM e"""


def _sp_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soybean's S has a name of its own beside the maize's."""
    out = sp_analysis(spark, sf_dir)
    names = out.columns
    last = len(names) - 1 - names[::-1].index("s")
    return out.toDF(*[n if i != last else "s_soy" for i, n in enumerate(names)])


def crop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    m = mg.maize_n("dose", F.col("ca") > 2, F.col("mg") > 0.5)
    return _flat(s, _KEYS, vinasse=mg.vinasse_dose("ca", 2.0), euca_k=mg.eucalyptus_k("p", 60.0), ep=mg.eucalyptus_p("p", 40.0, "clay"), citrus=mg.citrus_n("ph", 200.0), maize=m, cane_k=mg.cane_k("p", "dose"), split=mg.pasture_splits("dose", "p"), coffee=mg.coffee_yield("dose", "p"), dop=mg.dop("ca", "mg"), balanced=mg.balanced_index("ca", "mg", 20.0), fit=mg.sufficiency("ca", 1.0, 3.0), fs=sp.forest_split("dose", "p", "mg", "ca"), pine=sp.native_forest_liming("p", "clay", 80.0), target=sp.maize_target_v("p"))


CROP_RULES = f"""{_S}, a AS (SELECT *, greatest(dose - CASE WHEN ca > 2 THEN {_D(20)} ELSE {_D(0)} END, {_D(0)}) AS n_all, {_num("100.0 * ca / mg")} AS rel FROM s)
    SELECT {_K}, greatest({_num("(185.0 - ca * 94.0) / 2.0")}, {_D(0)}) AS vinasse, {_D(1.8)} * greatest({_D(60)} - p, {_D(0)}) AS euca_k,
           CASE WHEN p < 20 THEN {_D(600)} WHEN p < 40 THEN {_D(300)} ELSE {_D(0)} END AS rock_kg_ha,
           CASE WHEN p >= 40 THEN CASE WHEN clay < 15 THEN {_D(100)} WHEN clay <= 35 THEN {_D(125)} ELSE {_D(150)} END ELSE {_D(0)} END AS ssp_g_hole,
           greatest({_D(200)} + CASE WHEN ph > {_D(2.7)} THEN {_D(-600)} * (ph - {_D(2.7)}) WHEN ph < {_D(2.4)} THEN {_D(300)} * ({_D(2.4)} - ph) ELSE {_D(0)} END, {_D(0)}) AS citrus,
           least(CASE WHEN mg > {_D(0.5)} THEN {_D(30)} ELSE {_D(20)} END, n_all) AS planting, n_all - least(CASE WHEN mg > {_D(0.5)} THEN {_D(30)} ELSE {_D(20)} END, n_all) AS topdressing,
           CASE WHEN p > 150 THEN {_D(0)} ELSE dose END AS cane_k, CAST(greatest(ceil(dose / {_D(50)}), 1) AS INTEGER) AS n_parts, CASE WHEN p > 40 THEN 3 ELSE 1 END AS k_parts,
           CASE WHEN p < {_D(0.5)} * dose THEN (dose + p) / {_D(2)} ELSE p END AS coffee, rel - {_D(100)} AS dop,
           CASE WHEN rel > 100 THEN rel - abs(rel - {_D(100)}) * {_D(20)} / {_D(100)} ELSE rel + abs(rel - {_D(100)}) * {_D(20)} / {_D(100)} END AS balanced,
           CASE WHEN ca < 1 THEN 'insuficiente' WHEN ca > 3 THEN 'excessivo' ELSE 'adequado' END AS fit,
           dose / {_D(3)} AS n_planting, p / {_D(3)} AS k_planting, CASE WHEN mg < {_D(0.21)} THEN {_D(1)} ELSE {_D(0)} END AS b, CASE WHEN ca < {_D(0.6)} THEN {_D(1.5)} ELSE {_D(0)} END AS zn,
           CASE WHEN clay < 40 THEN least(greatest({_num("p * (50.0 - clay) / (10.0 * 80.0)")}, {_D(0)}), {_D(2)}) ELSE {_D(0)} END AS pine,
           CASE WHEN p > 50 THEN {_D(50)} ELSE {_D(70)} END AS target FROM a"""

DOSES = [(c, lo, hi, cl, d) for c, f in (("A", 1.0), ("N", 1.5), ("R", 2.0)) for lo, hi, y in ((None, 20.0, 40.0), (20.0, 40.0, 60.0), (40.0, None, 80.0)) for cl, d in (("Baixo", y * f), ("Alto", y * f / 2))]


def dose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision table: crop (return flag), yield band and class."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_KEYS, F.col("l_returnflag").alias("crop"), F.col("l_quantity").alias("goal"), F.when(F.col("l_discount") < 0.05, "Baixo").otherwise("Alto").alias("level"))
    table = spark.createDataFrame(DOSES, "crop string, lo double, hi double, level string, dose double")
    return lookup.decide(rows, table, ["crop", "level"], {"goal": ("lo", "hi")})


DOSE_TABLE = f"""WITH y(lo, hi, y) AS (VALUES ({_D(-1e9)}, {_D(20)}, {_D(40)}), ({_D(20)}, {_D(40)}, {_D(60)}), ({_D(40)}, {_D(1e9)}, {_D(80)})), c(crop, f) AS (VALUES ('A', {_D(1)}), ('N', {_D(1.5)}), ('R', {_D(2)})), l(level, share) AS (VALUES ('Baixo', {_D(1)}), ('Alto', {_D(0.5)})),
    t AS (SELECT crop, lo, hi, level, y * f * share AS dose FROM y, c, l)
    SELECT {_K}, l_returnflag AS crop, l_quantity AS goal, CASE WHEN l_discount < {_D(0.05)} THEN 'Baixo' ELSE 'Alto' END AS level, dose
    FROM lineitem LEFT JOIN t ON l_returnflag = crop AND (CASE WHEN l_discount < {_D(0.05)} THEN 'Baixo' ELSE 'Alto' END) = level AND l_quantity > lo AND l_quantity <= hi"""

_IDS = """
    SELECT concat('T', lpad(CAST(o_custkey % 40 AS {s}), 2, '0'), '-', CAST(o_orderkey AS {s})) AS point_id,
           CASE o_orderkey % 4 WHEN 0 THEN concat('t', CAST(o_custkey % 40 AS {s}), '_', CAST(o_orderkey AS {s})) WHEN 1 THEN concat('Amostra T ', CAST(o_custkey % 40 AS {s}), ' ', CAST(o_orderkey AS {s}))
                WHEN 2 THEN concat('gleba ', CAST(o_custkey % 40 AS {s}), '/', CAST(o_orderkey AS {s})) ELSE concat('T', CAST(o_custkey % 40 AS {s}), ' ', CAST(o_orderkey % 5 * 5 AS {s}), '-', CAST(o_orderkey % 5 * 5 + 20 AS {s}), 'cm') END AS lab_id
    FROM {t}
"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "orders")["orders"].createOrReplaceTempView("_pedon_orders")
    return spark.sql(_IDS.format(s="string", t="_pedon_orders"))


def match_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    return matching.match_ids(ids, ids)


def match_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    pairs = matching.match_ids(ids, ids)
    side = lambda c: matching.orphans(ids, pairs, c).select(F.lit(c).alias("side"), F.col(c).alias("id"))
    return side("point_id").unionByName(side("lab_id"))


def depth_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.depth_duplicates(_ids(spark, sf_dir))


_NUM = lambda t: f"list_transform({t}, lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN CAST(CAST(x AS HUGEINT) AS VARCHAR) ELSE x END)"
_TOK = lambda c: _NUM(f"regexp_extract_all(upper(trim({c})), '[A-Z]+|\\d+')")
_NOISE = ", ".join(f"'{w}'" for w in _EMPTY_WORDS)
_LAY = [
    (lambda c: f"array_to_string({_TOK(c)}, '-')", "canonico", 1.0),
    (lambda c: f"array_to_string(list_filter({_TOK(c)}, lambda x: x NOT IN ({_NOISE})), '-')", "sem-ruido", 0.95),
    (lambda c: "array_to_string(" + _NUM(f"regexp_extract_all({c}, '\\d+')") + ", ',')", "assinatura", 0.9),
]
_MATCH = f"WITH ids AS ({_IDS.format(s='VARCHAR', t='orders')}), a0 AS (SELECT DISTINCT point_id FROM ids), b0 AS (SELECT DISTINCT lab_id FROM ids)"
for _i, (_f, _m, _c) in enumerate(_LAY):
    _MATCH += f""", p{_i} AS (SELECT min(point_id) AS point_id, {_f("point_id")} AS key FROM a{_i} GROUP BY key HAVING count(*) = 1 AND key <> ''),
        q{_i} AS (SELECT min(lab_id) AS lab_id, {_f("lab_id")} AS key FROM b{_i} GROUP BY key HAVING count(*) = 1 AND key <> ''),
        m{_i} AS (SELECT point_id, lab_id, {_D(_c)} AS confidence, '{_m}' AS method FROM p{_i} JOIN q{_i} USING (key)),
        a{_i + 1} AS (SELECT * FROM a{_i} WHERE point_id NOT IN (SELECT point_id FROM m{_i})), b{_i + 1} AS (SELECT * FROM b{_i} WHERE lab_id NOT IN (SELECT lab_id FROM m{_i}))"""
MATCH_LAYERS = _MATCH + " SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2"
MATCH_ORPHANS = _MATCH + " SELECT 'point_id' AS side, point_id AS id FROM a3 UNION ALL SELECT 'lab_id', lab_id FROM b3"
DEPTH_GROUPS = f"""WITH ids AS ({_IDS.format(s="VARCHAR", t="orders")}), t AS (SELECT lab_id, {_TOK("lab_id")} AS t0 FROM ids),
    u AS (SELECT lab_id, CASE WHEN t0[-1] = 'CM' THEN t0[: len(t0) - 1] ELSE t0 END AS t FROM t), v AS (SELECT *, TRY_CAST(t[-2] AS INTEGER) AS a, TRY_CAST(t[-1] AS INTEGER) AS b FROM u)
    SELECT base_id, count(DISTINCT lab_id) AS n, count(*) AS n_rows FROM (SELECT lab_id, array_to_string(CASE WHEN len(t) >= 2 AND a % 5 = 0 AND b % 5 = 0 AND b - a BETWEEN 5 AND 60 AND b <= 100
        AND len(list_filter(t[: len(t) - 2], lambda x: regexp_matches(x, '^\\d'))) > 0 THEN t[: len(t) - 2] ELSE t END, '-') AS base_id FROM v) GROUP BY base_id HAVING count(*) > 1"""

_RAW = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN replace(CAST(value AS {s}), '.', ',') WHEN 1 THEN concat('<', replace(CAST(value AS {s}), '.', ',')) WHEN 2 THEN 'ND' WHEN 3 THEN concat('1.', lpad(CAST(event_id % 1000 AS {s}), 3, '0'), ',5') ELSE CAST(value AS {s}) END AS raw FROM {t}"""


def lab_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "events")["events"].createOrReplaceTempView("_pedon_events")
    raw = spark.sql(_RAW.format(s="string", t="_pedon_events"))
    n = text.br_number("raw")
    return raw.select("event_id", n["value"].alias("value"), n["censored"].alias("censored"))


LAB_NUMBERS = f"""WITH r AS ({_RAW.format(s="VARCHAR", t="events")}), s AS (SELECT event_id, raw LIKE '<%' AS below, replace(raw, '<', '') AS d, raw FROM r),
    v AS (SELECT event_id, below, CASE WHEN raw <> 'ND' THEN TRY_CAST(CASE WHEN contains(d, ',') THEN replace(replace(d, '.', ''), ',', '.') ELSE d END AS DOUBLE) END AS x FROM s)
    SELECT event_id, CASE WHEN below THEN x / {_D(2)} ELSE x END AS value, below AND x IS NOT NULL AS censored FROM v"""

_CODES = "SELECT c_custkey, concat(CASE WHEN c_nationkey % 2 = 0 THEN 'sp' ELSE 'MG' END, '-', lpad(CAST(3100000 + c_nationkey AS {s}), 7, '0'), '-', CASE WHEN c_custkey % 9 = 0 THEN 'xyz' ELSE upper(md5(CAST(c_custkey AS {s}))) END) AS code, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE ' ' END AS place FROM {t}"


def registry_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "customer", "nation")
    t["customer"].createOrReplaceTempView("_pedon_customer")
    sheet = spark.sql(_CODES.format(s="string", t="_pedon_customer"))
    places = t["nation"].select((F.col("n_nationkey") + 3100000).cast("string").alias("code"), F.col("n_name").alias("name"), F.lit("BR").alias("uf"))
    found = registry.locate(sheet.select("code").distinct(), places).where("place is not null").select(text.registry_code("code").alias("code"), "place", "uf")
    return registry.fill(sheet, found, "code", ["place", "uf"])


REGISTRY_FILL = f"""WITH s AS ({_CODES.format(s="VARCHAR", t="customer")}), c AS (SELECT *, CASE WHEN regexp_full_match(upper(code), '[A-Z]{{2}}-\\d{{7}}-[0-9A-F]{{32}}') THEN substr(code, 4, 7) END AS m FROM s)
    SELECT c_custkey, code, CASE WHEN trim(place) = '' THEN coalesce(n_name, place) ELSE place END AS place, CASE WHEN n_name IS NOT NULL THEN 'BR' END AS uf,
           CASE WHEN m IS NULL THEN 'invalid' WHEN n_name IS NULL THEN 'not found' ELSE 'found' END AS status FROM c LEFT JOIN nation ON m = CAST(n_nationkey + 3100000 AS VARCHAR)"""

_POINTS = "SELECT CAST('e' || CAST(c_nationkey % 2 AS {s}) AS {s}) AS element, CAST((c_custkey * 37) % 509 AS DOUBLE) AS x, CAST((c_custkey * 91) % 401 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) / CAST(1000 AS DOUBLE) AS z FROM {t}"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "customer")["customer"].createOrReplaceTempView("_pedon_customer")
    return geostat.collapse(spark.sql(_POINTS.format(s="string", t="_pedon_customer")))


def element_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geostat.stats(_points(spark, sf_dir))
    return s.select("element", "n", "lowest", "highest", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_COLLAPSED = f"WITH r AS ({_POINTS.format(s='VARCHAR', t='customer')}), p AS (SELECT element, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r GROUP BY element, x, y)"
ELEMENT_STATS = _COLLAPSED + " SELECT element, count(*) AS n, min(z) AS lowest, max(z) AS highest, round(avg(z), 6) AS mean, round(var_pop(z), 6) AS variance FROM p GROUP BY element"


def variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geostat.variogram(_points(spark, sf_dir)).select("element", "lag", F.round("h_mean", 6).alias("h_mean"), F.round("gamma", 6).alias("gamma"), "n_pairs")


VARIOGRAM = (
    _COLLAPSED
    + f""", h AS (SELECT a.element, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, (a.z - b.z) * (a.z - b.z) / {_D(2)} AS g FROM p a JOIN p b ON a.element = b.element AND (a.x, a.y) < (b.x, b.y)),
    c AS (SELECT element, max(h) / {_D(2)} AS cut FROM h GROUP BY element)
    SELECT element, CAST(least(floor(h / (cut / {_D(12)})), 11) AS INTEGER) AS lag, round(avg(h), 6) AS h_mean, round(avg(g), 6) AS gamma, count(*) AS n_pairs
    FROM h JOIN c USING (element) WHERE h > 0 AND h <= cut GROUP BY element, 2 HAVING count(*) > 1"""
)


def _chosen(points: DataFrame) -> DataFrame:
    """The chosen model of each element; fits are written once, for they are used twice."""
    fits = durable(geostat.fit(geostat.variogram(points)))
    return geostat.choose(fits, geostat.leave_one_out(points, fits))


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(durable(_points(spark, sf_dir))).withColumn("dependence", geo.dependence("nugget", "partial_sill"))


_RINGS = """SELECT CAST(n_nationkey AS BIGINT) AS geom_id, 0 AS ring_id, CAST(i AS INTEGER) AS seq,
    CAST(n_nationkey * 200 + CASE i WHEN 0 THEN 0 WHEN 1 THEN 97 WHEN 2 THEN 103 WHEN 3 THEN 41 ELSE 3 END AS DOUBLE) AS x,
    CAST(n_regionkey * 200 + CASE i WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 89 WHEN 3 THEN 47 ELSE 101 END AS DOUBLE) AS y FROM {t}, (SELECT {g} AS i) k"""


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "nation")["nation"].createOrReplaceTempView("_pedon_nation")
    return spark.sql(_RINGS.format(t="_pedon_nation", g="explode(sequence(0, 4))"))


def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.ring_areas(_rings(spark, sf_dir))


_EDGES = f"""WITH r AS ({_RINGS.format(t="nation", g="unnest(range(0, 5))")}), e AS (SELECT a.geom_id, a.ring_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM r a JOIN r b ON a.geom_id = b.geom_id AND b.seq = (a.seq + 1) % 5)"""
RING_AREAS = _EDGES + f" SELECT geom_id, ring_id, sum(x1 * y2 - x2 * y1) / {_D(2)} AS area FROM e GROUP BY geom_id, ring_id"


def grid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mask(_rings(spark, sf_dir), 5.0)


GRID_MASK = (
    _EDGES
    + f""", b AS (SELECT geom_id, floor(min(x) / {_D(5)}) * {_D(5)} - {_D(5)} AS x0, ceil(max(y) / {_D(5)}) * {_D(5)} + {_D(5)} AS y0, max(x) AS mx, min(y) AS my FROM r GROUP BY geom_id),
    c AS (SELECT geom_id, "row", unnest(range(0, CAST(ceil((mx - x0) / {_D(5)}) AS BIGINT) + 1)) AS col, x0, y0 FROM (SELECT *, unnest(range(0, CAST(ceil((y0 - my) / {_D(5)}) AS BIGINT) + 1)) AS "row" FROM b)),
    g AS (SELECT geom_id, "row", col, x0 + (col + {_D(0.5)}) * {_D(5)} AS xc, y0 - ("row" + {_D(0.5)}) * {_D(5)} AS yc FROM c)
    SELECT g.geom_id, "row", col, xc, yc FROM g JOIN e ON g.geom_id = e.geom_id AND (y1 > yc) <> (y2 > yc) AND x1 + (yc - y1) * (x2 - x1) / (y2 - y1) > xc GROUP BY ALL HAVING count(*) % 2 = 1"""
)


def kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = durable(_points(spark, sf_dir))
    best = durable(_chosen(points).select("element", "model", "nugget", "partial_sill", "range_m"))
    # the ring around all points, for each element
    corners = points.groupBy().agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"), F.collect_set("element").alias("elements"))
    ring = corners.select(F.explode("elements").alias("geom_id"), "a", "b", "c", "d")
    ring = ring.select("geom_id", F.lit(0).alias("ring_id"), F.posexplode(F.expr("array(struct(a as x, b as y), struct(c as x, b as y), struct(c as x, d as y), struct(a as x, d as y))")).alias("seq", "v")).select("geom_id", "ring_id", "seq", "v.x", "v.y")
    cells = geometry.mask(ring, 10.0).withColumnRenamed("geom_id", "element")
    return geostat.clamp(geostat.krige(points, cells, best, 10.0))[0]


_UTM = "SELECT s_suppkey, CAST(-54 + (s_suppkey % 60) AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(45 AS DOUBLE) AS lon, CAST(-(s_suppkey % 23) AS DOUBLE) - CAST(0.25 AS DOUBLE) AS lat FROM {t}"


def utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "supplier")["supplier"].createOrReplaceTempView("_pedon_supplier")
    rows = spark.sql(_UTM.format(t="_pedon_supplier")).withColumn("zone", geo.utm_zone("lon"))
    at = geo.forward_utm("lon", "lat", "zone", F.col("lat") < 0)
    return rows.select("s_suppkey", "zone", geo.epsg("zone", F.col("lat") < 0).alias("epsg"), F.round(at["x"], 3).alias("x"), F.round(at["y"], 3).alias("y"))


_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "mg_liming": (mg_liming, MG_LIMING),
    "mg_indices": (mg_indices, MG_INDICES),
    "mg_gypsum": (mg_gypsum, MG_GYPSUM),
    "fertiliser": (fertiliser, FERTILISER),
    "sp_analysis": (_sp_analysis, SP_ANALYSIS),
    "crop_rules": (crop_rules, CROP_RULES),
    "dose_table": (dose_table, DOSE_TABLE),
    "match_layers": (match_layers, MATCH_LAYERS),
    "match_orphans": (match_orphans, MATCH_ORPHANS),
    "depth_groups": (depth_groups, DEPTH_GROUPS),
    "lab_numbers": (lab_numbers, LAB_NUMBERS),
    "registry_fill": (registry_fill, REGISTRY_FILL),
    "element_stats": (element_stats, ELEMENT_STATS),
    "variogram": (variogram, VARIOGRAM),
    "model_choice": (model_choice, None),
    "kriging": (kriging, None),
    "ring_areas": (ring_areas, RING_AREAS),
    "grid_mask": (grid_mask, GRID_MASK),
    "utm": (utm, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
