"""Soil chemistry and prescriptions in the units of Minas Gerais: cmolc/dm3, clay in %, mg/dm3, t/ha.

Arguments are column names, numbers or columns; nulls give nulls unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedon.functions.rounding import col, known, ladder, rnd

X = Column | str | float

# Class names and upper bounds of the first four classes.
CLASSES = ["Muito baixo", "Baixo", "Médio", "Bom", "Muito bom"]
CLASS_BOUNDS = {
    "om": [0.70, 2.00, 4.00, 7.00],
    "ca": [0.40, 1.20, 2.40, 4.00],
    "mg": [0.15, 0.45, 0.90, 1.50],
    "al": [0.20, 0.50, 1.00, 2.00],
    "sb": [0.60, 1.80, 3.60, 6.00],
    "h_al": [1.00, 2.50, 5.00, 9.00],
    "t_eff": [0.80, 2.30, 4.60, 8.00],
    "cec": [1.60, 4.30, 8.60, 15.00],
    "m": [15.0, 30.0, 50.0, 75.0],
    "v": [20.0, 40.0, 60.0, 80.0],
}
K_BOUNDS = [15.0, 40.0, 70.0, 120.0]
# Upper P-rem bound of a band, and the band's class bounds for available P.
P_BANDS = [
    (4.0, [3.0, 4.3, 6.0, 9.0]),
    (10.0, [4.0, 6.0, 8.3, 12.5]),
    (19.0, [6.0, 8.3, 11.4, 17.5]),
    (30.0, [8.0, 11.4, 15.8, 24.0]),
    (44.0, [11.0, 15.8, 21.8, 33.0]),
    (float("inf"), [15.0, 21.8, 30.0, 45.0]),
]
# Dose factors by class, texture and P-rem.
FIELD_FACTORS = [1.25, 1.00, 0.80, 0.60, 0.40]
VEGETABLE_FACTORS = [1.20, 1.00, 0.77, 0.53, 0.30]
PREM_FACTORS = [1.30, 1.15, 1.00, 0.85, 0.70, 0.60]
#: Classes of these attributes are read the other way round: high is bad.
ADVERSE = {"al", "h_al", "m"}


def sum_of_bases(ca: X, mg: X, k: X, na: X = 0.0) -> Column:
    return col(ca) + col(mg) + col(k) + col(na)


def effective_cec(sb: X, al: X) -> Column:
    return col(sb) + col(al)


def cec(sb: X, h_al: X) -> Column:
    return col(sb) + col(h_al)


def base_saturation(sb: X, cec_: X) -> Column:
    """100 SB / T in %; 0 where T is not positive."""
    return F.when(col(cec_) > 0, 100.0 * col(sb) / col(cec_)).otherwise(F.when(col(cec_).isNotNull(), 0.0))


def al_saturation(al: X, t_eff: X) -> Column:
    """100 Al / t in %; 0 where t is not positive."""
    return base_saturation(al, t_eff)


def indices(ca: X, mg: X, k: X, al: X, h_al: X, na: X = 0.0) -> Column:
    """struct(sb, t_eff, cec to 2 digits; v, m to 1)."""
    sb = sum_of_bases(ca, mg, k, na)
    t, big = effective_cec(sb, al), cec(sb, h_al)
    return F.struct(
        rnd(sb, 2).alias("sb"), rnd(t, 2).alias("t_eff"), rnd(big, 2).alias("cec"), rnd(base_saturation(sb, big), 1).alias("v"), rnd(al_saturation(al, t), 1).alias("m")
    )


def buffer_by_clay(clay: X) -> Column:
    a = col(clay)
    return 0.0302 + 0.06532 * a - 0.000257 * a * a


def buffer_by_prem(prem: X) -> Column:
    p = col(prem)
    return 4.002 - 0.125901 * p + 0.001205 * p * p - 0.00000362 * p * p * p


def liming_al_camg(al: X, ca: X, mg: X, t_eff: X, mt: X, x: X, y: X) -> Column:
    """struct(ca_part, cd_part, nc): acidity part, deficit of Ca+Mg, and their sum from the unrounded parts, t/ha."""
    acid = F.greatest(col(y) * (col(al) - col(mt) * col(t_eff) / 100.0), F.lit(0.0))
    lack = F.greatest(col(x) - (col(ca) + col(mg)), F.lit(0.0))
    return F.struct(rnd(acid, 3).alias("ca_part"), rnd(lack, 3).alias("cd_part"), rnd(acid + lack, 2).alias("nc"))


def liming_saturation(sb: X, h_al: X, ve: X) -> Column:
    """struct(cec, va, nc): liming to the saturation ve %, t/ha."""
    big = cec(sb, h_al)
    need = F.greatest(col(ve) / 100.0 * big - col(sb), F.lit(0.0))
    return F.struct(rnd(big, 2).alias("cec"), rnd(base_saturation(sb, big), 1).alias("va"), rnd(need, 2).alias("nc"))


def limestone(nc: X, surface: X = 100.0, depth: X = 20.0, prnt: X = 100.0) -> Column:
    """Limestone in t/ha for a covered surface (%), depth (cm) and neutralising power (%); null where prnt is not positive."""
    return F.when(col(prnt) > 0, rnd(col(nc) * (col(surface) / 100.0) * (col(depth) / 20.0) * (100.0 / col(prnt)), 3))


def cane_liming(ca: X, mg: X, sb: X, h_al: X) -> Column:
    """3 - (Ca + Mg) t/ha, no more than leads to 60 % saturation, no less than 0."""
    most = 0.6 * cec(sb, h_al) - col(sb)
    return rnd(F.greatest(F.least(3.0 - (col(ca) + col(mg)), most), F.lit(0.0)), 2)


def gypsum_indicated(ca: X = None, al: X = None, m: X = None) -> Column:
    """Whether the subsoil asks for gypsum; what was not measured does not count."""
    return known(col(ca) <= 0.4) | known(col(al) > 0.5) | known(col(m) > 30.0)


def gypsum_by_clay(clay: X) -> Column:
    x = col(clay)
    return rnd(0.00034 - 0.002445 * F.sqrt(x) + 0.0338886 * x - 0.00176366 * x * F.sqrt(x), 3)


def gypsum_by_prem(prem: X, ca_content: X = 18.75) -> Column:
    """struct(ca_kg, ng): Ca to apply in kg/ha and gypsum in t/ha, the latter from the unrounded Ca."""
    p = col(prem)
    ca = 315.8 - 25.5066 * F.sqrt(p) - 5.70675 * p + 0.485335 * p * F.sqrt(p)
    return F.struct(rnd(ca, 1).alias("ca_kg"), rnd(ca / (10.0 * col(ca_content)), 3).alias("ng"))


def gypsum_by_liming(nc: X) -> Column:
    return rnd(0.25 * col(nc), 3)


def gypsum(ng: X, surface: X = 100.0, layer: X = 20.0) -> Column:
    """Gypsum in t/ha for a covered surface (%) and the thickness of the subsoil layer (cm)."""
    return rnd(col(ng) * (col(surface) / 100.0) * (col(layer) / 20.0), 3)


def cane_gypsum(clay: X, ca: X = None, m: X = None) -> Column:
    """60 kg/ha for each % of clay where Ca < 0.4 or m > 40, else 0."""
    return F.when(known(col(ca) < 0.4) | known(col(m) > 40.0), col(clay) * 60.0).otherwise(0.0)


def hole_limestone(nc: X, volume_dm3: X) -> Column:
    """Grams for a planting hole of that volume."""
    return col(nc) * col(volume_dm3) / 2.0


def furrow_limestone(nc: X, volume_dm3: X) -> Column:
    """Grams for a metre of furrow."""
    return 2.5 * hole_limestone(nc, volume_dm3)


def class_of(attribute: str, value: X) -> Column:
    """Class name of an attribute of CLASS_BOUNDS."""
    return ladder(col(value), CLASS_BOUNDS[attribute], CLASSES)


def display_class(attribute: str, value: X) -> Column:
    """Class name for print: adverse attributes are high rather than good."""
    names = ["Muito baixo", "Baixo", "Médio", "Alto", "Muito alto"] if attribute in ADVERSE else CLASSES
    return ladder(col(value), CLASS_BOUNDS[attribute], names)


def p_class(p: X, prem: X) -> Column:
    """Class of available P in the band of P-rem; at an edge the lower band counts."""
    out = F.lit(None).cast("string")
    for top, bounds in reversed(P_BANDS):
        out = F.when(col(prem) <= top, ladder(col(p), bounds, CLASSES)).otherwise(out)
    return out


def k_class(k: X) -> Column:
    return ladder(col(k), K_BOUNDS, CLASSES)


def class_factor(name: X, vegetable: bool = False) -> Column:
    """Dose factor of a class; null for an unknown one."""
    factors = VEGETABLE_FACTORS if vegetable else FIELD_FACTORS
    return F.create_map(*[F.lit(x) for pair in zip(CLASSES, factors, strict=True) for x in pair])[col(name)]


def texture_factor(clay: X) -> Column:
    c = col(clay)
    return F.when(c > 60, 1.25).when(c >= 35, 1.00).when(c >= 15, 0.80).when(c.isNotNull(), 0.60)


def prem_factor(prem: X) -> Column:
    return ladder(col(prem), [b for b, _ in P_BANDS[:-1]], PREM_FACTORS)


def vinasse_dose(cec_: X, k2o: X) -> Column:
    """m3/ha: (185 - 94 CTC) / K2O content as printed, which is negative for a CTC over 1.97; no less than 0."""
    return F.when(col(k2o) > 0, F.greatest((185.0 - col(cec_) * 94.0) / col(k2o), F.lit(0.0)))


def eucalyptus_k(k: X, critical: X) -> Column:
    """kg/ha of K2O: 1.8 for each mg/dm3 under the critical level."""
    return 1.8 * F.greatest(col(critical) - col(k), F.lit(0.0))


def eucalyptus_p(p: X, critical: X, clay: X) -> Column:
    """struct(rock_kg_ha, ssp_g_hole): rock phosphate by how far P is under the critical level; superphosphate by texture above it."""
    rock = F.when(col(p) < 0.5 * col(critical), 600.0).when(col(p) < col(critical), 300.0).when(col(p).isNotNull(), 0.0)
    ssp = F.when(col(p) >= col(critical), F.when(col(clay) < 15, 100.0).when(col(clay) <= 35, 125.0).otherwise(150.0))
    return F.struct(rock.alias("rock_kg_ha"), F.coalesce(ssp, F.lit(0.0)).alias("ssp_g_hole"))


def eucalyptus_ca(ca: X, critical: X) -> Column:
    """kg/ha of limestone: 100 for each 0.1 cmolc/dm3 under the critical level."""
    return 1000.0 * F.greatest(col(critical) - col(ca), F.lit(0.0))


def rubber_liming(ca: X, mg: X) -> Column:
    """t/ha every second year: 1 - (Ca + Mg), no less than 0."""
    return F.greatest(1.0 - (col(ca) + col(mg)), F.lit(0.0))


def third_steps(availability: X) -> Column:
    """1, 2/3 or 1/3 of a dose at low, medium or good availability (rubber gardens, citrus)."""
    return F.when(col(availability) == "Baixa", 1.0).when(col(availability) == "Média", 2.0 / 3.0).when(col(availability) == "Boa", 1.0 / 3.0)


def citrus_n(leaf_n: X, dose: X) -> Column:
    """g/plant of N: the dose at 2.4 to 2.7 dag/kg of leaf N, 60 less for each 0.1 above and 30 more for each 0.1 below; no less than 0."""
    n = col(leaf_n)
    change = F.when(n > 2.7, -600.0 * (n - 2.7)).when(n < 2.4, 300.0 * (2.4 - n)).otherwise(0.0)
    return F.greatest(col(dose) + change, F.lit(0.0))


def maize_n(dose: X, after_soy: X, no_till: X) -> Column:
    """struct(planting, topdressing): 20 kg/ha less after soybean; 30 kg/ha at planting in no-till, 20 otherwise."""
    total = F.greatest(col(dose) - F.when(known(col(after_soy)), 20.0).otherwise(0.0), F.lit(0.0))
    first = F.least(F.when(known(col(no_till)), 30.0).otherwise(20.0), total)
    return F.struct(first.alias("planting"), (total - first).alias("topdressing"))


def maize_k_split(k2o: X, clay: X) -> Column:
    """Topdressed part of K2O: half in sandy soil or over 80 kg/ha."""
    return F.when((col(clay) < 15) | (col(k2o) > 80), 0.5 * col(k2o)).otherwise(0.0)


def wheat_irrigated(p2o5: X, k2o: X) -> Column:
    """struct(p2o5, k2o) for irrigation: 20 % more P, 10 kg/ha more K2O."""
    return F.struct((col(p2o5) * 1.2).alias("p2o5"), (col(k2o) + 10.0).alias("k2o"))


def wheat_correction(clay: X) -> Column:
    """Total correction of P over 20 % of clay, else gradual."""
    return F.when(col(clay) > 20, "total").when(col(clay).isNotNull(), "gradual")


def cane_k(k: X, dose: X) -> Column:
    """No K above 150 mg/dm3."""
    return F.when(col(k) > 150, 0.0).otherwise(col(dose))


def cane_vinasse_n(cane_yield: X) -> Column:
    """N where vinasse is applied: none under 80 t/ha, else 40 kg/ha."""
    return F.when(col(cane_yield) < 80, 0.0).when(col(cane_yield).isNotNull(), 40.0)


def substrate_dose(dose_t_ha: X) -> Column:
    """kg/m3 of substrate: a hectare of 20 cm has 2000 m3."""
    return 0.5 * col(dose_t_ha)


def pasture_splits(n: X, k2o: X) -> Column:
    """struct(n_parts, k_parts): 50 kg/ha of N at a time at most; K2O over 40 kg/ha in three parts."""
    return F.struct(F.greatest(F.ceil(col(n) / 50.0), F.lit(1)).cast("int").alias("n_parts"), F.when(col(k2o) > 40, 3).otherwise(1).alias("k_parts"))


def coffee_yield(last: X, following: X) -> Column:
    """Expected yield: the mean of both years where the next is under half of the last, else the next."""
    return F.when(col(following) < 0.5 * col(last), (col(last) + col(following)) / 2.0).otherwise(col(following))


def coffee_s(n: X) -> Column:
    return col(n) / 8.0


def dop(content: X, reference: X) -> Column:
    """Deviation from the optimum in %; null where the reference is 0."""
    return F.when(col(reference) != 0, 100.0 * col(content) / col(reference) - 100.0)


def balanced_index(content: X, standard: X, cv: X) -> Column:
    """Kenworthy's balanced index: the content in % of the standard, drawn towards 100 by the coefficient of variation."""
    p = 100.0 * col(content) / col(standard)
    i = F.abs(p - 100.0) * col(cv) / 100.0
    return F.when(col(standard) != 0, F.when(p > 100, p - i).otherwise(p + i))


def balanced_class(index: X) -> Column:
    """Class of a balanced index between 17 and 183; null beyond, where the source has no class."""
    names = ["Deficiência", "Marginal", "Adequada", "Elevada", "Excesso"]
    return F.when(col(index).between(17.0, 183.0), ladder(col(index), [50.0, 83.0, 117.0, 150.0], names))


def sum_of_deviations(deviations: Column) -> Column:
    """Sum of the absolute values of an array of deviations from the optimum; nulls in it are passed over."""
    return F.aggregate(F.filter(deviations, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + F.abs(x))


def mean_balance(deviations: Column) -> Column:
    """Mean absolute value of an array of indices; nulls in it are passed over."""
    kept = F.filter(deviations, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(kept))


def response_class(index: X, mean: X, low: X, high: X) -> Column:
    """Response to a nutrient: positive (certain or probable) where its index lies under minus the mean balance, negative above it, else nil. low, high: the sample's extremes."""
    i, m = col(index), col(mean)
    return (
        F.when((i < -m) & (i == col(low)), "positiva")
        .when(i < -m, "positiva ou nula")
        .when((i > m) & (i == col(high)), "negativa")
        .when(i > m, "negativa ou nula")
        .when(i.isNotNull() & m.isNotNull(), "nula")
    )


def sufficiency(content: X, lo: X, hi: X) -> Column:
    """Whether a leaf content lies in its range."""
    return F.when(col(content) < col(lo), "insuficiente").when(col(content) > col(hi), "excessivo").when(col(content).isNotNull(), "adequado")
