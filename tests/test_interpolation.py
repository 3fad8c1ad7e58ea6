"""The whole way from a report to maps, and whole files of results."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedon.operators import geostat, interpolation
from pedon.sources import readers, writers


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(5)
    n = 40
    x, y = 300_000 + rng.uniform(0, 200, n), 7_500_000 + rng.uniform(0, 160, n)
    p = 10 + np.sin((x - 300_000) / 60) * 4 + rng.normal(0, 0.2, n)
    points = spark.createDataFrame(pd.DataFrame({"row_no": np.arange(n + 1), "point_id": [f"T{i:02d}" for i in range(n)] + ["T00"], "x": [*x, 0.0], "y": [*y, 0.0]}))
    rows = [(i, f"t {i}", "<0,4" if i == 3 else f"{v:.3f}".replace(".", ","), "1,5" if i < 5 else "ND", str(-1 - i % 2)) for i, v in enumerate(p)]
    lab = spark.createDataFrame([*rows, (n, "nobody", "7", "7", "7"), (n + 1, "t 0", "n/a", None, "")], "row_no long, Amostra string, P string, K string, neg string")
    ring = spark.createDataFrame([(0, s, 300_000.0 + a, 7_500_000.0 + b) for s, (a, b) in enumerate([(0, 0), (200, 0), (200, 160), (0, 160)])], "ring_id int, seq int, x double, y double")
    return points, lab, ring, interpolation.interpolate(points, lab, ring, ["P", "K", "neg"], "Amostra", 10.0, zone=(22, True)), (x, y, p)


def test_report_and_warnings(run):
    got = {r["element"]: r for r in run[3].report.collect()}
    assert set(got) == {"P", "K", "neg"}
    assert got["P"]["n"] == 40 and "censored" in got["P"]["warnings"] and got["P"]["winner"] in geostat.MODELS and 0 <= got["P"]["nugget_share"] <= 1
    assert got["K"]["too_few"] and got["K"]["winner"] is None and "clamped" in got["neg"]["warnings"]
    assert run[3].models.where("element = 'P'").count() == 3 and run[3].pairs.count() == 40 and (run[3].zone, run[3].south) == (22, True)


def test_surface_is_the_chosen_models(run):
    _, _, _, got, (x, y, p) = run
    z = np.round(p, 3)
    z[3] = 0.2
    m = got.models.where("element = 'P'").toPandas().sort_values("rmse_loo").iloc[0]
    cells = got.surface.where("element = 'P'").toPandas()
    want = geostat.krige_points(x, y, z, cells["xc"].to_numpy(), cells["yc"].to_numpy(), m)
    assert len(cells) == 20 * 16 and cells["pred"].to_numpy() == pytest.approx(np.maximum(want[0], 0), abs=1e-6)
    assert got.surface.where("element = 'neg'").agg(F.max("pred")).first()[0] == 0 and got.surface.where("element = 'K'").count() == 0


def test_manual_pairs_and_confidence(spark, run):
    points, lab, ring, _, _ = run
    manual = spark.createDataFrame([("T00", "nobody")], "point_id string, lab_id string")
    got = interpolation.interpolate(points, lab, ring, ["P"], "Amostra", 40.0, min_confidence=2.0, manual=manual, zone=(22, True))
    assert [(r["point_id"], r["lab_id"]) for r in got.pairs.where("method = 'manual'").collect()] == [("T00", "nobody")]
    assert got.points.count() == 1 and got.report.first()["too_few"] and got.surface.count() == 0


def test_csv_files_have_a_mark_and_a_header(spark, tmp_path):
    rows = spark.createDataFrame([("ação", "1;2"), (None, "x")], "nome string, v string").repartition(2)
    writers.write_csv(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert files and all(f.read_bytes().startswith("﻿nome;v\n".encode()) for f in files)
    assert {tuple(r) for r in readers.sheet_csv(spark, str(tmp_path / "out")).collect()} == {("ação", "1;2"), (None, "x")}


def test_collections(spark):
    rings = spark.createDataFrame([(g, 0, 0, True, s, float(x), float(y)) for g in (1, 2, 3) for s, (x, y) in enumerate([(0, 0), (g, 0), (g, g)])], "geom_id long, poly_id int, ring_id int, is_exterior boolean, seq int, x double, y double")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "geom_id long, theme string")
    features = writers.geojson_features(rings, names).join(spark.createDataFrame([(1, "SP-1"), (2, "SP-1"), (3, None)], "geom_id long, code string"), "geom_id")
    (row,) = writers.geojson_collections(features, "code").collect()
    got = json.loads(row["geojson"])
    assert row["code"] == "SP-1" and got["crs"]["properties"]["name"].endswith("EPSG::4674") and [f["properties"]["theme"] for f in got["features"]] == ["a", "b"]
