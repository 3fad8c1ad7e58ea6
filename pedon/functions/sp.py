"""Soil chemistry and prescriptions in the units of Sao Paulo: mmolc/dm3, clay in g/kg, pH in CaCl2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedon.functions.rounding import col, known, ladder, rnd

X = Column | str | float

# Acidity and saturation classes.
ACIDITY = ([4.3, 5.0, 5.5, 6.0], ["Muito alta", "Alta", "Média", "Baixa", "Muito baixa"])
SATURATION = ([25.0, 50.0, 70.0, 90.0], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"])
# Conversion factors.
FACTORS = {
    "pct_to_g_kg": 10.0,
    "cmolc_to_mmolc": 10.0,
    "p2o5_to_p": 0.437,
    "k2o_to_k": 0.830,
    "cao_to_ca": 0.715,
    "mgo_to_mg": 0.602,
}
#: mg/dm3 of K in one mmolc/dm3.
K_MG_PER_MMOLC = 39.1
DEFAULT_PRNT = 67.0


def convert(value: X, factor: str) -> Column:
    """``value`` in the new unit; the way back from element to oxide ("p_to_p2o5") multiplies by one over the factor."""
    if factor in FACTORS:
        return col(value) * FACTORS[factor]
    old, new = factor.split("_to_")
    return col(value) * (1.0 / FACTORS[f"{new}_to_{old}"])


def sum_of_bases(ca: X, mg: X, k: X, na: X = 0.0) -> Column:
    return col(ca) + col(mg) + col(k) + col(na)


def cec(sb: X, h_al: X) -> Column:
    return col(sb) + col(h_al)


def effective_cec(sb: X, al: X) -> Column:
    return col(sb) + col(al)


def base_saturation(sb: X, cec_: X) -> Column:
    """100 SB / CTC in %; null where CTC is not positive, which is an input error."""
    return F.when(col(cec_) > 0, 100.0 * col(sb) / col(cec_))


def al_saturation(al: X, sb: X) -> Column:
    t = col(sb) + col(al)
    return F.when(t > 0, 100.0 * col(al) / t).when(t.isNotNull(), 0.0)


def acidity_class(ph: X) -> Column:
    return ladder(col(ph), *ACIDITY)


def saturation_class(v: X) -> Column:
    return ladder(col(v), *SATURATION)


def analysis(ca: X, mg: X, k: X, h_al: X, al: X, ph: X) -> Column:
    """struct(sb, cec, t_eff, v, m, acidity, saturation); classes come from unrounded values."""
    sb = sum_of_bases(ca, mg, k)
    big = cec(sb, h_al)
    v = base_saturation(sb, big)
    return F.struct(
        rnd(sb, 2).alias("sb"),
        rnd(big, 2).alias("cec"),
        rnd(effective_cec(sb, al), 2).alias("t_eff"),
        rnd(v, 1).alias("v"),
        rnd(al_saturation(al, sb), 1).alias("m"),
        acidity_class(ph).alias("acidity"),
        saturation_class(v).alias("saturation"),
    )


def liming(cec_: X, v1: X, v2: X, prnt: X = DEFAULT_PRNT) -> Column:
    """Whole t/ha from CTC (mmolc) and saturations in %: rounded up, at least 1 where any is needed; null where prnt is not positive."""
    need = col(cec_) * (col(v2) - col(v1)) / (10.0 * col(prnt))
    return F.when(col(prnt) > 0, F.when(need <= 0, 0.0).otherwise(F.greatest(F.ceil(need).cast("double"), F.lit(1.0))))


def liming_si(cec_: X, v1: X, v2: X, pne: X) -> Column:
    return F.when(col(pne) > 0, rnd(F.greatest(2.0 * col(cec_) * (col(v2) - col(v1)) / (100.0 * col(pne)), F.lit(0.0)), 2))


def neutralising_power(cao: X, mgo: X) -> Column:
    return col(cao) * 1.79 + col(mgo) * 2.48


def reactivity(coarse: X, medium: X, fine: X) -> Column:
    """% from the shares retained at 2 to 0.84 mm, 0.84 to 0.3 mm and below 0.3 mm."""
    return 0.2 * col(coarse) + 0.6 * col(medium) + col(fine)


def prnt(pn: X, re: X) -> Column:
    return col(pn) * col(re) / 100.0


def neutralising_power_si(ca: X, mg: X) -> Column:
    return col(ca) / 20.0 + col(mg) / 12.2


def effective_power_si(pn: X, re: X) -> Column:
    """PNE from PN and the reactivity in %, taken as RE / 1000 of the SI unit."""
    return col(pn) * (col(re) / 1000.0)


def gypsum(clay: X) -> Column:
    """kg/ha: 6 for each g/kg of clay."""
    return rnd(6.0 * col(clay), 1)


def gypsum_indicated(ca: X = None, m: X = None) -> Column:
    return known(col(ca) < 4.0) | known(col(m) > 40.0)


def gypsum_indicated_with_al(ca: X = None, m: X = None, al: X = None) -> Column:
    """The variant that also asks for Al over 5."""
    return gypsum_indicated(ca, m) | known(col(al) > 5.0)


def forage_gypsum_indicated(ca: X = None, m: X = None) -> Column:
    return known(col(ca) < 4.0) | known(col(m) > 50.0)


def residue_credit(k2o: X, p2o5: X, vinasse_k2o: X, cake_p2o5: X) -> Column:
    """struct(k2o, p2o5) left after vinasse (all of its K2O counts) and filter cake (half of its P2O5)."""
    return F.struct(
        F.greatest(col(k2o) - col(vinasse_k2o), F.lit(0.0)).alias("k2o"), F.greatest(col(p2o5) - 0.5 * col(cake_p2o5), F.lit(0.0)).alias("p2o5")
    )


def dry_matter(fresh: X = 0.0, hay: X = 0.0) -> Column:
    return col(fresh) * 0.20 + col(hay) * 0.85


def eucalyptus_liming(ca: X, mg: X, prnt_: X, x: X = 20.0) -> Column:
    return F.when(col(prnt_) > 0, F.greatest(10.0 * (col(x) - (col(ca) + col(mg))) / col(prnt_), F.lit(0.0)))


def nursery_liming(cec_: X, v1: X, prnt_: X, v2: X = 60.0) -> Column:
    """kg/m3 of substrate."""
    return F.when(col(prnt_) > 0, F.greatest(col(cec_) * (col(v2) - col(v1)) / (20.0 * col(prnt_)), F.lit(0.0)))


def _need(cec_: X, v1: X, v2: X, prnt_: X) -> Column:
    return F.when(col(prnt_) > 0, F.greatest(col(cec_) * (col(v2) - col(v1)) / (10.0 * col(prnt_)), F.lit(0.0)))


def native_forest_liming(cec_: X, v1: X, prnt_: X) -> Column:
    """To 50 % where V is under 40, 2 t/ha at most."""
    return F.when(col(v1) < 40, F.least(_need(cec_, v1, 50.0, prnt_), F.lit(2.0))).when(col(v1).isNotNull(), 0.0)


def cane_liming(cec_: X, v1: X, prnt_: X, mg: X) -> Column:
    """struct(nc, dolomitic): to 60 %, from 1 to 5 t/ha where any is needed; 1 t/ha of dolomitic lime at least where Mg is under 5."""
    need = _need(cec_, v1, 60.0, prnt_)
    nc = F.when(need > 0, F.least(F.greatest(need, F.lit(1.0)), F.lit(5.0))).otherwise(0.0)
    return F.struct(F.when(known(col(mg) < 5), F.greatest(nc, F.lit(1.0))).otherwise(nc).alias("nc"), known(col(mg) < 5).alias("dolomitic"))


def maize_target_v(om: X) -> Column:
    """70 %, or 50 % in soils with over 50 g/dm3 of organic matter."""
    return F.when(col(om) > 50, 50.0).otherwise(70.0)


def forage_liming(cec_: X, v1: X, prnt_: X, target: X, most: X) -> Column:
    """To the group's target saturation, with the group's largest dose."""
    return F.least(_need(cec_, v1, target, prnt_), col(most))


def maize_s_zn(crop_yield: X, zn: X) -> Column:
    """struct(s, zn) in kg/ha: S 20 up to 6 t/ha, else 40; Zn 4 under 0.6 mg/dm3, 2 up to 1.2."""
    return F.struct(F.when(col(crop_yield) <= 6, 20.0).otherwise(40.0).alias("s"), F.when(col(zn) < 0.6, 4.0).when(col(zn) <= 1.2, 2.0).otherwise(0.0).alias("zn"))


def soybean_extras(crop_yield: X, mn: X, k2o: X) -> Column:
    """struct(s, mn, k_topdressing) in kg/ha."""
    return F.struct(
        (15.0 * col(crop_yield)).alias("s"), F.when(col(mn) <= 1.5, 5.0).otherwise(0.0).alias("mn"), F.when(col(k2o) > 50, 0.5 * col(k2o)).otherwise(0.0).alias("k_topdressing")
    )


def forest_split(n: X, k2o: X, b: X, zn: X) -> Column:
    """struct(n_planting, k_planting, b, zn): a third of N and K2O at planting; B 1 kg under 0.21, Zn 1.5 kg under 0.6."""
    return F.struct(
        (col(n) / 3.0).alias("n_planting"), (col(k2o) / 3.0).alias("k_planting"), F.when(col(b) < 0.21, 1.0).otherwise(0.0).alias("b"), F.when(col(zn) < 0.6, 1.5).otherwise(0.0).alias("zn")
    )


def native_forest_split(n: X, k2o: X, b: X, zn: X) -> Column:
    """struct(n_planting, k_planting, b, zn): half of N and K2O at planting; B 1 kg under 0.21, Zn 1 kg under 0.6."""
    return F.struct(
        (col(n) * 0.5).alias("n_planting"), (col(k2o) * 0.5).alias("k_planting"), F.when(col(b) < 0.21, 1.0).otherwise(0.0).alias("b"), F.when(col(zn) < 0.6, 1.0).otherwise(0.0).alias("zn")
    )


def forage_p(dose: X, high_response: X) -> Column:
    """30 % more P where the response is higher than the table's."""
    return F.when(known(col(high_response)), 1.3 * col(dose)).otherwise(col(dose))


def n_response(sandy: X, corrected_grass_years: X, no_till_years: X, fallow_years: X, after_pasture: X, legumes: X, organic: X, many_years: float = 3.0) -> Column:
    """Expected response to nitrogen of annual crops by a plot's history: Alta, Média or Baixa; nulls count as no and none.

    legumes and organic are 0 (none), 1 (now and then, moderate) or 2 (intense,
    much). Low: two years of fallow or more, pasture before (but not on sandy
    soil), intense legumes, much organic manure. High: sandy soil, corrected
    soil under grasses for ``many_years``, the first years of no-till. Else
    medium. What lowers the response counts first.
    """
    yes, n = (lambda c: F.coalesce(col(c), F.lit(False))), (lambda c: F.coalesce(col(c), F.lit(0)))
    low = (n(fallow_years) >= 2) | (yes(after_pasture) & ~yes(sandy)) | (n(legumes) >= 2) | (n(organic) >= 2)
    high = yes(sandy) | (n(corrected_grass_years) >= many_years) | n(no_till_years).between(1, 2)
    middle = (n(legumes) == 1) | (n(organic) == 1) | (n(fallow_years) == 1)
    return F.when(low, "Baixa").when(high & ~middle, "Alta").otherwise("Média")


def n_response_perennial(leaf_n: X, low: X, high: X) -> Column:
    """Of perennial crops, by leaf N against its adequate range: Alta below, Média within, Baixa above; null for null."""
    v = col(leaf_n)
    return F.when(v < col(low), "Alta").when(v <= col(high), "Média").when(v > col(high), "Baixa")
