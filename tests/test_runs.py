"""Zones, headers, crop names and the record of a run."""

import json

import pytest
from pyspark.sql import functions as F

from pedon.functions import sp
from pedon.operators import geometry, lookup, matching, registry
from pedon.sources import writers


def test_zone_precedence(spark):
    ring = spark.createDataFrame([(1, -47.2, -22.0), (1, -47.0, -22.5), (1, -47.2, -22.0)], "geom_id int, x double, y double")
    metres = ring.withColumns({"x": F.col("x") * -10000, "y": F.col("y") * -300000})
    assert geometry.choose_zone(ring, (21, False), (22, True), (24, True)) == (21, False)
    assert geometry.choose_zone(ring, None, (22, True), (24, True)) == (22, True) and geometry.choose_zone(metres, None, None, (24, True)) == (24, True)
    assert geometry.choose_zone(ring) == (23, True) and geometry.choose_zone(ring, points=ring) == (23, True)
    # the closing vertex counts twice: the mean is west of 48 degrees
    assert geometry.choose_zone(spark.createDataFrame([(1, -48.5, 1.0), (1, -47.2, 1.0), (1, -48.5, 1.0)], ring.schema)) == (22, False)
    for bad in ({"perimeter": metres}, {"perimeter": ring, "points": metres}, {"perimeter": ring.limit(0)}):
        with pytest.raises(ValueError):
            geometry.choose_zone(**bad)


def test_headers(spark):
    rows = spark.createDataFrame([(["Nome", "Nº do CAR", "LATITUDE", "Longitude", "Área (ha)", "Cidade", "Município", "UF", "Data do cadastro", "Registro", None],), ([],), (["Data", "Cadastro", "Estado/UF", "uf"],)], "h array<string>")
    got = [[(e["position"], e["field"]) for e in r[0]] for r in rows.select(registry.map_headers(F.col("h"))).collect()]
    assert got == [[(1, "code"), (2, "latitude"), (3, "longitude"), (4, "area"), (5, "municipio"), (7, "uf"), (8, "cadastro")], [], [(0, "cadastro"), (2, "estado"), (3, "uf")]]


def test_contained_like_all_pairs(spark):
    a, b = ["ab", "abc", "bcd", "a", "zz", "", None, "xabcx", "éa"], ["abcd", "bc", "xabcxabcx", "é", "éab", "", None, "ab"]
    left, right = spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "w string")
    got = lookup.contained(left, right, "t", "w").collect()
    want = {(x, y) for x in a for y in b if x and y and x in y}
    assert len(got) == len(want) and {(r.t, r.w) for r in got} == want
    assert "NestedLoop" not in lookup.contained(left, right, "t", "w")._jdf.queryExecution().toString()


def test_n_response(spark):
    rows = [(True, 0, 0, 0, False, 0, 0), (False, 5, 0, 0, False, 0, 0), (False, 0, 1, 0, False, 0, 0), (True, 0, 0, 0, True, 0, 0), (False, 0, 0, 0, True, 0, 0), (True, 0, 0, 2, False, 0, 0), (False, 9, 0, 0, False, 1, 0), (None,) * 7]
    df = spark.createDataFrame(rows, "sandy boolean, g int, t int, f int, p boolean, l int, o int")
    assert [r[0] for r in df.select(sp.n_response("sandy", "g", "t", "f", "p", "l", "o")).collect()] == ["Alta", "Alta", "Alta", "Alta", "Baixa", "Baixa", "Média", "Média"]


def test_conversions_are_the_published_ones(spark):
    one = spark.range(1).select(*[sp.convert(F.lit(1.0), n).alias(n) for n in ("p2o5_to_p", "k2o_to_k", "cao_to_ca", "mgo_to_mg", "p_to_p2o5", "k_to_k2o", "ca_to_cao", "mg_to_mgo", "pct_to_g_kg", "cmolc_to_mmolc")]).first()
    assert list(one) == [0.437, 0.830, 0.715, 0.602, 1 / 0.437, 1 / 0.830, 1 / 0.715, 1 / 0.602, 10, 10]


def test_record_of_a_run(spark):
    points = spark.createDataFrame([("T01",), ("T02",), ("Bela Vista",), ("Alto da Serra",), (None,)], "point_id string")
    lab = spark.createDataFrame([("t1",), ("Bela Vsta",), ("Alta Serras",), ("X1 0-20",), ("X1 20-40",)], "lab_id string")
    pairs = matching.match_ids(points, lab, similar=True)
    parts = {}
    for r in writers.run_record(points, lab, pairs, 23, 31983, "id", "Amostra").collect():
        parts.setdefault(r["part"], []).append(json.loads(r["value"]))
    assert parts["zona_utm"] == [23] and parts["campo_id_pontos"] == ["id"] and parts["pontos"] == [4]
    assert parts["pares"] == [len(pairs.collect())] and {p["point_id"] for p in parts["pontos_sem_par"]} >= {"T02"}
    assert [p["point_id"] for p in parts["aproximados_para_confirmar"]] and parts["duplicados_laudo"] == [{"base_id": "X-1", "n": 2}] and len(parts["atencao"]) == 1
    clean = writers.run_record(points, lab.limit(3), pairs, 23, 31983, "id", "Amostra")
    assert clean.where("part = 'atencao'").count() == 0
