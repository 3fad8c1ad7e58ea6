"""Published examples of the scalar rules."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedon.functions import geo, mg, npk, sp, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_mg_liming(spark):
    r = value(spark, mg.liming_al_camg(0.8, 0.1, 0.1, 1.01, 25.0, 3.5, 3.0))
    assert r["nc"] == pytest.approx(4.94, abs=0.01)
    assert value(spark, mg.liming_saturation(0.21, 7.8, 60.0))["nc"] == pytest.approx(4.6, abs=0.05)
    assert value(spark, mg.limestone(6.0, 75.0, 5.0, 90.0)) == pytest.approx(1.25, abs=0.01)
    assert value(spark, mg.limestone(6.0, 75.0, 5.0, 0.0)) is None


def test_mg_gypsum(spark):
    assert value(spark, mg.gypsum_by_clay(45.0)) == pytest.approx(0.977, abs=0.001)
    assert value(spark, mg.gypsum_by_prem(15.0))["ng"] == pytest.approx(0.851, abs=0.001)
    assert value(spark, mg.gypsum(mg.gypsum_by_liming(4.8), 100.0, 35.0)) == pytest.approx(2.1, abs=0.01)
    assert value(spark, mg.gypsum_indicated(m=F.lit(35.0))) is True and value(spark, mg.gypsum_indicated()) is False


def test_npk(spark):
    b = value(spark, npk.blend(20.0, 80.0, 40.0, (44.0, 18.0, 58.0)))
    assert (b["n_kg"], b["p_kg"], b["k_kg"], b["total"]) == (45.5, 444.4, 69.0, 558.9)
    assert tuple(value(spark, npk.ratio(24.0, 8.0, 12.0))) == (3.0, 1.0, 1.5) and tuple(value(spark, npk.ratio(0.0, 0.0, 0.0))) == (0, 0, 0)
    assert value(spark, npk.formula_quantity((20.0, 80.0, 40.0), (4.0, 16.0, 8.0))) == 500
    assert value(spark, npk.per_furrow(500.0, 0.8))["g_metre"] == 40 and value(spark, npk.per_hole(500.0, 0.8, 0.2))["g_hole"] == 8


def test_sp(spark):
    assert value(spark, sp.liming(52.0, 45.0, 70.0, 80.0)) == 2 and value(spark, sp.liming(52.0, 80.0, 70.0, 80.0)) == 0
    assert value(spark, sp.base_saturation(10.0, 0.0)) is None and value(spark, sp.gypsum(350.0)) == 2100


@pytest.mark.parametrize(("raw", "want"), [("1.234,56", (1234.56, False)), ("<0,4", (0.2, True)), ("ND", (None, False)), ("-", (None, False)), ("1.234", (1.234, False)), ("", (None, False)), ("abc", (None, False)), ("nan", (None, False)), ("Infinity", (None, False)), ("-inf", (None, False)), ("1e3", (1000.0, False)), (".5", (0.5, False))])
def test_numbers(spark, raw, want):
    assert tuple(value(spark, text.br_number(F.lit(raw)))) == want


def test_ids(spark):
    assert value(spark, text.canonical_id(F.lit("T01-03"))) == value(spark, text.canonical_id(F.lit("t1_3"))) == "T-1-3"
    assert value(spark, text.reduced_id(F.lit("Ponto 12"))) == "12" and value(spark, text.signature(F.lit("AM_07/2"))) == "7,2"
    assert tuple(value(spark, text.depth_of(F.lit("T1 0-20cm")))) == (0, 20, "T-1")
    assert tuple(value(spark, text.depth_of(F.lit("STC05-10")))) == (None, None, "STC-5-10")
    assert tuple(value(spark, text.depth_of(F.lit("")))) == (None, None, "")


def test_codes(spark):
    raw = "pi-2200053-1BAB.C06A.E224.43BC.A804.FFEC.51C2.5EB9"
    assert value(spark, text.registry_code(F.lit(raw))) == "PI-2200053-1BABC06AE22443BCA804FFEC51C25EB9"
    assert value(spark, text.registry_code(F.lit("PI-22"))) is None
    assert value(spark, text.degrees(F.lit("8°22'26.947\"S"))) == -8.374152 and value(spark, text.degrees(F.lit("x"))) is None
    assert value(spark, text.br_format(18.58)) == "18,58" and value(spark, text.slug(F.lit("P (mg/dm³) é"))) == "p-mg-dm3-e"


def test_utm(spark):
    r = value(spark, geo.forward_utm(F.lit(-47.0), F.lit(-22.9), F.lit(23), F.lit(True)))
    assert abs(r["x"] - 294857) < 100 and abs(r["y"] - 7466157) < 100
    assert value(spark, geo.utm_zone(F.lit(-47.0))) == 23 and value(spark, geo.epsg(F.lit(23), F.lit(True))) == 31983


@pytest.mark.parametrize(("x", "want"), [(None, None), (0.125, "0,12"), (0.375, "0,38"), (18.58, "18,58"), (-0.625, "-0,62"), (3.0, "3,00")])
def test_br_format(spark, x, want):
    assert value(spark, text.br_format(F.lit(x).cast("double"))) == want


def test_plain_letters(spark):
    assert value(spark, text.canonical_id(F.lit("Ş１２ ã-０3ﬁ"))) == "S-12-A-3-FI"
    for raw in ("Água Boa º1", "½ dose", "Ｗｉｄｅ ｋ", "e\u0301\u00b2", "İŞ ǆ", "---"):
        want = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
        want = re.sub("[^a-z0-9]+", "-", want.lower()).strip("-") or "elemento"
        assert value(spark, text.slug(F.lit(raw))) == want, raw


@pytest.mark.parametrize(("raw", "want"), [("8°22'26.947\"S", -8.374152), ("8°22'26.947S and more", -8.374152), ("lat 8°22'26.947\"S", None), ("8°22'26.947\"O", None), ("8 22 26 S", None), ("47°30'0\"W", -47.5), ("1°30'0\"E", 1.5)])
def test_degrees(spark, raw, want):
    assert value(spark, text.degrees(F.lit(raw))) == want


@pytest.mark.parametrize(("index", "want"), [(16.9, None), (17.0, "Deficiência"), (50.0, "Deficiência"), (83.0, "Marginal"), (100.0, "Adequada"), (150.0, "Elevada"), (183.0, "Excesso"), (183.1, None)])
def test_balanced_class(spark, index, want):
    assert value(spark, mg.balanced_class(index)) == want


def test_gamma_is_what_the_solver_uses(spark):
    from pedon.operators.geostat import _shape

    for model in geo.MODELS:
        for h in (0.0, 3.0, 25.0, 90.0):
            want = 0.0 if h == 0 else 0.2 + 1.5 * float(_shape(model, np.array([h]), 40.0)[0])
            assert value(spark, geo.gamma(model, h, 0.2, 1.5, 40.0)) == pytest.approx(want)


def test_ascii_is_not_taken_apart(spark):
    """Texts of ASCII are their own plain form, and cost less than those that are taken apart sign by sign."""
    import time

    def seconds(mark):
        ids = spark.range(400_000).select(F.concat(F.lit(f"Amostr{mark} da gleba do talhao numero "), F.col("id").cast("string")).alias("x"))
        since = time.time()
        assert ids.where(text.plain("x") == F.concat(F.lit("Amostra da gleba do talhao numero "), F.regexp_extract("x", r"\d+", 0))).count() == 400_000
        return time.time() - since

    seconds("a"), seconds("á")
    assert min(seconds("a") for _ in range(2)) < 0.7 * min(seconds("á") for _ in range(2))
