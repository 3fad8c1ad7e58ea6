"""Queries of the bulletins' dose and leaf tables, and DuckDB SQL whose values are typed apart from the package's tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.functions import tables
from pedon.operators import lookup

_D = "CAST({} AS DOUBLE)".format
_CLASS = ["baixa", "media", "boa"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else _D(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def _pick(names: list[str], key: str) -> Column:
    """The name whose place is ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.expr(key) % len(names) + 1).cast("int"))


def _picked(names: list[str], key: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][1 + CAST({key} % {len(names)} AS BIGINT)]"


# What a plant gets in each stage, as the bulletin's total rows say it: N, P2O5 and K2O at good availability (at medium twice, at low three times that).
_FRUIT = {
    "abacate": "plantio 30 30 20, 1 60 15 10, 2 80 20 20, 3 100 30 20, 4 180 30 50, 5 200 40 50, 6 240 50 70",
    "citros": "plantio 25 45 0, 1 70 10 10, 2 130 30 20, 3 160 30 30, 4 240 50 60, 5 340 70 80, 6 380 50 100, suplementar_1 80 10 30, suplementar_2 60 10 20",
    "figo": "plantio 40 30 30, 1 60 30 30, 3 120 30 50, suplementar 40 10 30",
    "goiaba": "plantio 80 30 30, 1 80 30 30, 2 120 30 40, 3 150 40 50",
    "maçã": "plantio 40 20 40, 1 60 20 30, 2 80 20 60, 3 80 20 60, 4 100 30 60, 5 130 40 70, 6 160 50 60, suplementar 70 10 20",
    "mamão": "plantio 100 20 30, frutificação 80 10 30",
    "manga": "plantio 50 20 20, 1 100 30 40, 2 150 40 50, 3 200 50 90, 4 200 50 70, 5 230 50 80, 6 350 50 120",
    "maracujá": "plantio 70 20 30, 1 120 20 80, 2 140 30 90, poda 60 20 20",
    "nêspera": "1 40 20 20, 2 50 20 20, 3 60 30 20, 4 100 30 60, 5 140 30 60, 6 240 30 70",
    "noz-pecã": "plantio 40 20 15, 1 60 20 20, 2 60 0 30, 3 80 20 40, 5 120 40 60",
    "macadâmia": "plantio 30 20 10, 1 40 10 10, 2 80 10 15, 3 90 10 15, 5 180 40 60",
    "pêssego": "plantio 40 40 50, 1 60 30 40, 2 80 40 50, 3 100 40 60, 4 100 50 70, 5 140 50 80, suplementar 25 10 15",
    "uva": "plantio 30 20 40, 1 40 20 20, 2 50 20 30, 3 60 30 40, 4 90 30 50, 5 160 30 60",
    "banana prata anã": "planta_filha 100 20 40",
}
# stages whose doses aren't in that proportion: N; P2O5 at low, medium and good; K2O likewise
_FRUIT_ODD = [("figo", "2", 90, [90, 60, 30], [120, 80, 60]), ("nêspera", "plantio", 30, [60, 40, 30], [30, 20, 10]), ("banana prata anã", "planta mãe", 240, [0, 0, 0], [420, 280, 140]), ("uva", "pós-enxertia", 30, [0, 0, 0], [30, 20, 10])]


def _fruit_rows() -> list[tuple]:
    rows = [(crop, stage.replace("_", " "), float(n), [3 * float(p), 2 * float(p), float(p)], [3 * float(k), 2 * float(k), float(k)]) for crop, said in _FRUIT.items() for stage, n, p, k in map(str.split, said.split(","))]
    return [(crop, stage, c, n, p[i], k[i]) for crop, stage, n, p, k in chain(rows, _FRUIT_ODD) for i, c in enumerate(_CLASS)]


_FRUITS = list(_FRUIT)


def fruit_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orchard: what a plant gets in all stages, as the sum of the dated doses and as the tables' own totals."""
    split = tables.split_doses(tables.bulletins(spark))
    total = F.when(F.col("at") == "Total", F.col("dose")).otherwise(0.0)
    dated = F.when(F.col("at") == "Total", 0.0).otherwise(F.coalesce("dose", F.lit(0.0)))
    sums = split.groupBy("crop", "stage", "nutrient", "level").agg(F.sum(dated).alias("dated"), F.sum(total).alias("total"))
    each = lookup.with_levels(sums, _CLASS).groupBy("crop", "level", "nutrient").agg(F.sum("dated").alias("dated"), F.sum("total").alias("total"), F.count_distinct("stage").alias("stages"))
    orchards = _read(spark, sf_dir, "customer").select("c_custkey", _pick(_FRUITS, "c_custkey").alias("crop"), _pick(_CLASS, "c_nationkey").alias("level"))
    by = each.groupBy("crop", "level").agg(*[F.max(F.when(F.col("nutrient") == n, F.col(c))).alias(f"{n}_{c}") for n in ("n", "p2o5", "k2o") for c in ("dated", "total")], F.max("stages").alias("stages"))
    return lookup.decide(orchards, by, ["crop", "level"], {})


FRUIT_PROGRAM = f"""WITH t(crop, stage, level, n, p, k) AS {_values(_fruit_rows())},
    s AS (SELECT crop, level, sum(n) AS n, sum(p) AS p, sum(k) AS k, count(*) AS stages FROM t GROUP BY crop, level),
    o AS (SELECT c_custkey, {_picked(_FRUITS, "c_custkey")} AS crop, {_picked(_CLASS, "c_nationkey")} AS level FROM customer)
    SELECT o.*, n AS n_dated, n AS n_total, p AS p2o5_dated, p AS p2o5_total, k AS k2o_dated, k AS k2o_total, stages FROM o LEFT JOIN s USING (crop, level)"""

# Vegetables: P2O5 in clayey, medium and sandy soil (or one for all) at low, medium, good and very good availability; K2O and N at the same.
_VEGETABLES = {
    "abóbora italiana": ("200 160 120 80/160 120 80 40/120 80 40 0", "240 180 120 60", "120"),
    "abóbora menina": ("150 100 60 40/100 60 40 20/60 40 20 0", "100 80 60 40", "60"),
    "alface": ("400 300 100 50", "120 90 60 0", "150"),
    "alho": ("250 200 150 100", "80 60 40 20", "80"),
    "batata": ("420 300 120 50", "350 220 150 0", "190"),
    "batata-doce": ("180 120 60 0", "90 60 30 0", "60"),
    "berinjela": ("200 160 120 80", "160 120 80 50", "100"),
    "beterraba": ("300 240 180 0", "240 180 120 0", "100"),
    "brócolos": ("400 300 100 50", "240 180 100 0", "150"),
    "cebola": ("300 220 100 50", "180 120 50 0", "120"),
    "cenoura": ("400 320 240 160/320 240 160 80/240 160 80 0", "320 240 160 80", "120"),
    "chuchu": ("200 170 140 110/170 140 110 80/140 110 80 60", "360 330 300 270", "430"),
    "couve-flor": ("300 240 100 50", "240 180 100 0", "150"),
    "feijão-vagem": ("280 230 180 130/230 180 130 80/180 130 80 50", "120 90 60 30", "150"),
    "inhame": ("180 120 60 0", "90 60 30 0", "60"),
    "jiló": ("200 160 120 80", "160 120 80 50", "100"),
    "mandioquinha-salsa": ("180 120 60 0", "90 60 30 0", "0"),
    "melancia": ("200 160 120 80/160 120 80 40/120 80 40 0", "150 120 90 60", "120"),
    "melão": ("240 200 160 120", "300 250 200 100", "200 170 140 100"),
    "moranga híbrida": ("80 60 40 0", "50 40 30 0", "60"),
    "morango": ("400 300 200 100", "350 250 150 80", "220"),
    "pepino": ("300 240 180 120/240 180 120 60/180 120 60 0", "250 180 120 60", "120"),
    "pimentão": ("300 240 100 50", "240 180 80 0", "150"),
    "quiabo": ("240 200 160 120/200 160 120 80/160 120 80 40", "240 180 120 60", "120"),
    "repolho": ("400 300 100 50", "240 180 100 0", "150"),
    "tomate rasteiro": ("600 500 400 300/500 400 300 200/400 300 200 100", "200 150 100 60", "120 100 80 50"),
    "tomate tutorado": ("1200 1000 700 500/900 800 600 400/600 500 400 300", "800 600 400 200", "400 300 200 100"),
}
_AVAILABLE, _TEXTURES = ["baixa", "media", "boa", "muito boa"], ["argilosa", "media", "arenosa"]


def vegetable_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a field of vegetables: doses by availability of P and K and by texture, and how much of N goes out at planting."""
    doses = tables.bulletins(spark).where("bulletin = 'mg'")
    fields = _read(spark, sf_dir, "part").select(
        "p_partkey", _pick(list(_VEGETABLES), "p_partkey").alias("crop"), F.lit("total").alias("stage"), _pick(_AVAILABLE, "p_size").alias("p_class"), _pick(_AVAILABLE, "p_partkey div 5").alias("k_class"), _pick(_TEXTURES, "p_size div 4").alias("texture")
    )
    wide = lookup.with_levels(doses, _TEXTURES)
    r = lookup.prescribe(fields, wide, "p2o5", "p2o5", row="p_class", level="texture")
    r = lookup.prescribe(r, doses.where("level is null"), "k2o", "k2o", row="k_class")
    r = lookup.prescribe(r, doses.where("level is null"), "n", "n", row="p_class")
    shares = doses.where("stage = 'parcelas' AND row = 'plantio'").withColumn("stage", F.lit("total"))
    r = lookup.prescribe(r, shares, "n", "share")
    return r.select("p_partkey", "crop", "p_class", "k_class", "texture", "p2o5", "k2o", "n", (F.col("n") * F.col("share") / 100).alias("n_planting"))


# Share of N at planting, %, of the vegetables that are given one.
_N_SHARE = {"alface": 20, "alho": 30, "batata": 20, "berinjela": 40, "brócolos": 20, "cebola": 30, "couve-flor": 20, "jiló": 40, "melão": 20, "morango": 16, "pimentão": 20, "repolho": 20, "tomate rasteiro": 20, "tomate tutorado": 10}


def _vegetable_rows() -> list[tuple]:
    at = lambda said, i: float((said.split() * 4)[i])
    return [(crop, c, texture, at((p.split("/") * 3)[t], i), at(k, i), at(n, i)) for crop, (p, k, n) in _VEGETABLES.items() for i, c in enumerate(_AVAILABLE) for t, texture in enumerate(_TEXTURES)]


VEGETABLE_DOSES = f"""WITH t(crop, class, texture, p2o5, k2o, n) AS {_values(_vegetable_rows())}, sh(crop, share) AS {_values(list(_N_SHARE.items()))},
    f AS (SELECT p_partkey, {_picked(list(_VEGETABLES), "p_partkey")} AS crop, {_picked(_AVAILABLE, "p_size")} AS p_class, {_picked(_AVAILABLE, "(p_partkey // 5)")} AS k_class, {_picked(_TEXTURES, "(p_size // 4)")} AS texture FROM part)
    SELECT p_partkey, f.crop, p_class, k_class, f.texture, a.p2o5, b.k2o, a.n, a.n * share / {_D(100)} AS n_planting
    FROM f JOIN t a ON a.crop = f.crop AND a.class = p_class AND a.texture = f.texture JOIN t b ON b.crop = f.crop AND b.class = k_class AND b.texture = f.texture LEFT JOIN sh ON sh.crop = f.crop"""

# São Paulo: upper bounds of expected yield, P (mg/dm³) and K (mmolc/dm³) bands; P2O5 and K2O for each yield (None: no dose given).
_FIELD = {
    ("soja", "semeadura"): ([1.9, 2.4, 2.9, 3.4], [6, 15, 40], [0.7, 1.5, 3.0], [[50, 40, 30, 20], [60, 50, 40, 20], [80, 60, 40, 20], [90, 70, 50, 30], [None, 80, 50, 40]], [[60, 40, 20, 0], [70, 50, 30, 20], [70, 50, 50, 20], [80, 60, 50, 30], [80, 60, 60, 40]]),
    ("milho safrinha", "plantio"): ([3, 4], [6, 15, 40], [0.7, 1.5, 3.0], [[50, 30, 10, 0], [60, 40, 20, 10], [None, 60, 40, 30]], [[40, 30, 20, 0], [50, 40, 30, 10], [None, 50, 40, 20]]),
    ("sorgo", "plantio"): ([4, 6], [6, 15, 40], [0.7, 1.5, 3.0], [[60, 40, 30, 20], [80, 60, 40, 20], [90, 80, 50, 30]], [[50, 40, 20, 0], [50, 50, 40, 20], [50, 50, 50, 30]]),
    ("cana-planta", "plantio"): ([100, 150], [6, 15, 40], [0.7, 1.5, 3.0, 6.0], [[180, 100, 60, 40], [180, 120, 80, 60], [None, 140, 100, 80]], [[100, 80, 40, 40, 0], [150, 120, 80, 60, 0], [200, 160, 120, 80, 0]]),
    ("cana-soca", "soca"): ([60, 80, 100], [15], [1.5, 3.0], [[30, 0]] * 4, [[90, 60, 30], [110, 80, 50], [130, 100, 70], [150, 120, 90]]),
}
# doses by clay alone in the rows: eucalyptus and pine
_FIELD |= {
    ("eucalipto", "plantio"): ([150, 350], [2, 5, 8], [0.7, 1.5], [[60, 40, 20, 0], [90, 70, 50, 20], [120, 100, 60, 30]], [[50, 30, 0], [60, 40, 0], [80, 60, 0]]),
    ("pinus", "plantio"): ([150, 350], [2, 5, 8], [0.7, 1.5], [[30, 20, 0, 0], [45, 35, 0, 0], [60, 50, 0, 0]], [[30, 20, 0], [40, 30, 0], [50, 40, 0]]),
}
_SCALE = {"soja": 1, "milho safrinha": 1.2, "sorgo": 1.6, "cana-planta": 40, "cana-soca": 25, "eucalipto": 100, "pinus": 100}


def field_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a site: P2O5 and K2O by the soil's content and the expected yield (or clay), for crops of São Paulo."""
    crops = [c for c, _ in _FIELD]
    line = _read(spark, sf_dir, "lineitem")
    tenth = lambda c: F.expr(f"cast({c} as double) / 10D")
    scale, stage = (F.create_map(*[F.lit(x) for pair in d for x in pair])[F.col("crop")] for d in ([(c, float(s)) for c, s in _SCALE.items()], list(_FIELD)))
    sites = line.select("l_orderkey", "l_linenumber", _pick(crops, "l_orderkey div 2 + l_linenumber").alias("crop"), (F.expr("cast(l_orderkey % 60 as double)") + tenth("l_linenumber")).alias("p"), tenth("l_partkey % 70").alias("k"), tenth("l_suppkey % 50").alias("goal"))
    sites = sites.withColumns({"goal": F.col("goal") * scale, "stage": stage})
    doses = tables.bulletins(spark).where("bulletin = 'sp'")
    r = lookup.prescribe(sites, doses, "p2o5", "p2o5", row_range="goal", level_range="p")
    r = lookup.prescribe(r, doses, "k2o", "k2o", row_range="goal", level_range="k")
    return r.select("l_orderkey", "l_linenumber", "crop", "stage", "p2o5", "k2o")


def _ladder(x: str, upper: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {_D(b)} THEN {i + 1}" for i, b in enumerate(upper)) + f" ELSE {len(upper) + 1} END"


def _field_sql() -> str:
    nested = lambda rows: "[" + ", ".join("[" + ", ".join("NULL" if v is None else _D(v) for v in r) + "]" for r in rows) + "]"
    case = lambda make: "CASE crop " + " ".join(f"WHEN '{c}' THEN {make(*v)}" for (c, _), v in _FIELD.items()) + " END"
    p2o5 = case(lambda goal, p, k, dp, dk: f"({nested(dp)})[{_ladder('goal', goal)}][{_ladder('p', p)}]")
    k2o = case(lambda goal, p, k, dp, dk: f"({nested(dk)})[{_ladder('goal', goal)}][{_ladder('k', k)}]")
    stage = "CASE crop " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in _FIELD) + " END"
    scale = "CASE crop " + " ".join(f"WHEN '{c}' THEN {_D(s)}" for c, s in _SCALE.items()) + " END"
    sites = f"SELECT l_orderkey, l_linenumber, {_picked([c for c, _ in _FIELD], '(l_orderkey // 2 + l_linenumber)')} AS crop, CAST(l_orderkey % 60 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / {_D(10)} AS p, CAST(l_partkey % 70 AS DOUBLE) / {_D(10)} AS k, CAST(l_suppkey % 50 AS DOUBLE) / {_D(10)} AS g FROM lineitem"
    return f"WITH s AS ({sites}), t AS (SELECT *, g * {scale} AS goal FROM s) SELECT l_orderkey, l_linenumber, crop, {stage} AS stage, {p2o5} AS p2o5, {k2o} AS k2o FROM t"


# Pastures: P2O5 at low, medium and good availability under 15, 35, 60 and over 60 % of clay, at three levels of technology, when set up and later; other crops of the bulletin: P2O5 and K2O.
_PASTURE = {
    ("pastagem baixo", "estabelecimento"): [[30, 15, 0], [50, 25, 0], [70, 35, 0], [80, 45, 0]],
    ("pastagem médio", "estabelecimento"): [[50, 30, 0], [70, 50, 0], [90, 70, 0], [100, 80, 0]],
    ("pastagem alto", "estabelecimento"): [[70, 50, 20], [90, 70, 30], [110, 90, 40], [120, 100, 50]],
    ("pastagem baixo", "manutenção"): [[15, 0, 0], [20, 0, 0], [30, 0, 0], [40, 0, 0]],
    ("pastagem médio", "manutenção"): [[20, 15, 0], [30, 20, 0], [40, 25, 0], [50, 30, 0]],
    ("pastagem alto", "manutenção"): [[30, 15, 0], [40, 20, 0], [50, 30, 0], [60, 40, 0]],
}
_CROPS = {
    "algodão": ([100, 70, 40], [100, 70, 40]), "amendoim": ([80, 60, 40], [60, 40, 20]), "arroz de sequeiro": ([75, 50, 25], [70, 45, 20]), "arroz irrigado": ([90, 60, 30], [70, 45, 20]), "girassol": ([70, 50, 30], [70, 50, 30]), "mamona": ([90, 60, 30], [90, 60, 30]),
    "soja": ([120, 80, 40], [120, 80, 40]), "cravo": ([250, 150, 50], [20, 10, 5]), "rosa": ([300, 200, 100], [240, 160, 80]),
}


def pasture_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a pasture: P2O5 by clay and availability; and as a field of another crop of Minas Gerais."""
    doses = tables.bulletins(spark).where("bulletin = 'mg'")
    o = _read(spark, sf_dir, "orders")
    r = o.select("o_orderkey", _pick([c for c, _ in _PASTURE], "o_custkey").alias("crop"), _pick([s for _, s in _PASTURE], "o_custkey").alias("stage"), F.expr("cast(o_orderkey % 97 as double)").alias("clay"), _pick(_CLASS, "o_orderkey").alias("level"), _pick(list(_CROPS), "o_custkey").alias("other"))
    r = lookup.prescribe(r, doses.where("by = 'clay'"), "p2o5", "pasture_p2o5", level="level", row_range="clay")
    r = r.select("o_orderkey", F.col("crop").alias("pasture"), F.col("stage").alias("pasture_stage"), "pasture_p2o5", "level", F.col("other").alias("crop"), F.lit("plantio").alias("stage"))
    r = lookup.prescribe(lookup.prescribe(r, doses, "p2o5", "p2o5", level="level"), doses, "k2o", "k2o", level="level")
    return r.select("o_orderkey", "pasture", "pasture_stage", "pasture_p2o5", "level", "crop", "p2o5", "k2o")


PASTURE_DOSES = f"""WITH a(crop, stage, band, level, dose) AS {_values([(*key, i + 1, c, rows[i][j]) for key, rows in _PASTURE.items() for i in range(4) for j, c in enumerate(_CLASS)])},
    b(crop, level, p2o5, k2o) AS {_values([(crop, c, p[j], k[j]) for crop, (p, k) in _CROPS.items() for j, c in enumerate(_CLASS)])},
    r AS (SELECT o_orderkey, {_picked([c for c, _ in _PASTURE], "o_custkey")} AS pasture, {_picked([s for _, s in _PASTURE], "o_custkey")} AS pasture_stage, CAST(o_orderkey % 97 AS DOUBLE) AS clay, {_picked(_CLASS, "o_orderkey")} AS level, {_picked(list(_CROPS), "o_custkey")} AS crop FROM orders)
    SELECT o_orderkey, pasture, pasture_stage, a.dose AS pasture_p2o5, r.level, r.crop, b.p2o5, b.k2o
    FROM r JOIN a ON a.crop = pasture AND a.stage = pasture_stage AND a.level = r.level AND a.band = {_ladder("clay", [15, 35, 60])} JOIN b ON b.crop = r.crop AND b.level = r.level"""

# Adequate leaf contents of some crops: N, K, B and Zn.
_LEAVES = [
    ("sp", "soja", [(40, 54), (17, 25), (21, 55), (20, 50)]),
    ("sp", "feijão", [(30, 50), (20, 24), (15, 26), (18, 50)]),
    ("sp", "mandioca", [(45, 60), (10, 20), (15, 50), (35, 100)]),
    ("sp", "cana-de-açúcar", [(18, 25), (10, 16), (10, 30), (10, 50)]),
    ("sp", "alfafa", [(34, 56), (20, 35), (30, 60), (30, 50)]),
    ("mg", "citros", [(2.3, 2.7), (1.0, 1.5), (36, 100), (35, 50)]),
    ("mg", "café geral", [(2.7, 3.2), (1.9, 2.4), (59, 80), (8, 16)]),
    ("mg", "milho", [(2.75, 3.25), (1.75, 2.25), (4, 20), (20, 70)]),
    ("mg", "soja", [(4.5, 4.5), (1.7, 1.7), (20, 20), (20, 20)]),
]
_IN_LEAVES = ["n", "k", "b", "zn"]
_STATES = ["insuficiente", "adequado", "excessivo"]


def leaf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a leaf sample of some crop: how many of four contents are below, in and above the adequate range."""
    limits = tables.leaf_contents(tables.bulletins(spark)).where(F.col("nutrient").isin(_IN_LEAVES))
    line = _read(spark, sf_dir, "lineitem")
    key = "l_partkey + l_linenumber"
    sample = line.select("l_orderkey", "l_linenumber", _pick([b for b, _, _ in _LEAVES], key).alias("bulletin"), _pick([c for _, c, _ in _LEAVES], key).alias("crop"), F.explode(F.array(*map(F.lit, _IN_LEAVES))).alias("nutrient"), F.expr("cast(l_quantity as double)").alias("q"))
    sample = sample.withColumn("content", F.when((F.col("bulletin") == "mg") & F.col("nutrient").isin("n", "k"), F.col("q") / 10).otherwise(F.col("q")))
    r = lookup.decide(sample, limits, ["bulletin", "crop", "nutrient"], {})
    state = F.when(F.col("content") < F.col("lo"), _STATES[0]).when(F.col("content") > F.col("hi"), _STATES[2]).otherwise(_STATES[1])
    return r.groupBy("l_orderkey", "l_linenumber", "bulletin", "crop").agg(*[F.count_if(state == s).alias(s) for s in _STATES])


LEAF_STATES = f"""WITH t(bulletin, crop, nutrient, lo, hi) AS {_values([(b, c, n, *r) for b, c, ranges in _LEAVES for n, r in zip(_IN_LEAVES, ranges, strict=True)])},
    s AS (SELECT l_orderkey, l_linenumber, {_picked([b for b, _, _ in _LEAVES], "(l_partkey + l_linenumber)")} AS bulletin, {_picked([c for _, c, _ in _LEAVES], "(l_partkey + l_linenumber)")} AS crop, CAST(l_quantity AS DOUBLE) AS q FROM lineitem),
    j AS (SELECT s.*, CASE WHEN bulletin = 'mg' AND nutrient IN ('n', 'k') THEN q / {_D(10)} ELSE q END AS content, lo, hi FROM s JOIN t USING (bulletin, crop))
    SELECT l_orderkey, l_linenumber, bulletin, crop, count(*) FILTER (content < lo) AS insuficiente, count(*) FILTER (content BETWEEN lo AND hi) AS adequado, count(*) FILTER (content > hi) AS excessivo FROM j GROUP BY ALL"""

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fruit_program": (fruit_program, FRUIT_PROGRAM),
    "vegetable_doses": (vegetable_doses, VEGETABLE_DOSES),
    "field_doses": (field_doses, _field_sql()),
    "pasture_doses": (pasture_doses, PASTURE_DOSES),
    "leaf_states": (leaf_states, LEAF_STATES),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: found for name, (found, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}
