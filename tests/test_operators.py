import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedon.operators import geometry, geostat, lookup, matching, registry
from pedon.sources import readers
from pedon.streaming import element_stats


def test_layers(spark):
    points = spark.createDataFrame([("T01-01",), ("T01-02",), ("Ponto 3",), ("P4",), (None,)], "point_id string")
    lab = spark.createDataFrame([("t1-1",), ("T1 - 2",), ("3",), ("ponto quatro",), ("3",)], "lab_id string")
    pairs = matching.match_ids(points, lab)
    got = {(r["point_id"], r["lab_id"], r["method"]) for r in pairs.collect()}
    assert got == {("T01-01", "t1-1", "canonico"), ("T01-02", "T1 - 2", "canonico"), ("Ponto 3", "3", "sem-ruido")}
    assert [r[0] for r in matching.orphans(points, pairs, "point_id").collect()] == ["P4"]
    manual = spark.createDataFrame([("P4", "3")], "point_id string, lab_id string")
    assert {r["point_id"] for r in matching.with_manual(pairs, manual).collect()} == {"T01-01", "T01-02", "P4"}


def test_depths(spark):
    lab = spark.createDataFrame([(x,) for x in ("T1 0-20", "T1 20-40", "T2 0-20", "T2 20-40", "stc5-10", "stc5-20")], "lab_id string")
    assert {r["base_id"] for r in matching.depth_duplicates(lab).collect()} == {"T-1", "T-2"}


def test_mask_with_hole(spark):
    square = [(1, 0, i, *p) for i, p in enumerate([(0, 0), (100, 0), (100, 100), (0, 100)])]
    hole = [(1, 1, i, *p) for i, p in enumerate([(40, 40), (60, 40), (60, 60), (40, 60)])]
    rings = spark.createDataFrame([(g, r, s, float(x), float(y)) for g, r, s, x, y in square + hole], "geom_id long, ring_id int, seq int, x double, y double")
    assert 9000 < geometry.mask(rings, 5.0).count() * 25 < 10100
    assert {r["area"] for r in geometry.ring_areas(rings).collect()} == {10000.0, 400.0}
    assert geometry.mask(rings.limit(0), 5.0).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(42)
    x, y = rng.uniform(0, 500, 60), rng.uniform(0, 400, 60)
    z = 10 + 4 * np.sin(x / 120) + 3 * np.cos(y / 90) + rng.normal(0, 0.4, 60)
    return spark.createDataFrame(pd.DataFrame({"element": "P", "x": x, "y": y, "z": z}))


def test_geostatistics(spark, field):
    p = field.toPandas()
    lags = geostat.variogram(field).toPandas()
    d = np.hypot(*(p[c].to_numpy()[:, None] - p[c].to_numpy() for c in "xy"))
    i, j = np.triu_indices(60, 1)
    assert lags["n_pairs"].sum() == ((d[i, j] > 0) & (d[i, j] <= d.max() / 2)).sum()
    fits = geostat.fit(geostat.variogram(field))
    errors = geostat.leave_one_out(field, fits).toPandas().set_index("model")
    m = fits.toPandas().iloc[0]
    x, y, z = (p[c].to_numpy() for c in "xyz")
    naive = [geostat.krige_points(*(np.delete(v, k) for v in (x, y, z)), x[k : k + 1], y[k : k + 1], m)[0][0] - z[k] for k in range(60)]
    assert errors.loc[m["model"], "rmse_loo"] == pytest.approx(np.sqrt(np.mean(np.square(naive))), abs=1e-6)
    best = geostat.choose(fits, geostat.leave_one_out(field, fits))
    assert best.first()["rmse_loo"] < z.std()
    cells = spark.range(100).select(F.lit("P").alias("element"), "id", (F.col("id") * 0).alias("row"), F.col("id").alias("col"), (F.col("id") * 5.0).alias("xc"), F.lit(200.0).alias("yc")).drop("id")
    near = geostat.krige(field, cells, best, 5.0).toPandas()
    whole = geostat.krige_points(x, y, z, near["col"].to_numpy() * 5.0, np.full(len(near), 200.0), best.toPandas().iloc[0])[0]
    assert len(near) == 100 and np.sqrt(np.mean((near["pred"] - whole) ** 2)) < 0.05 * z.std()


def test_collapse(spark):
    df = spark.createDataFrame([("P", 1.0, 1.0, 2.0), ("P", 1.001, 1.0, 4.0), ("P", 2.0, 1.0, 5.0)], "element string, x double, y double, z double")
    assert sorted(r["z"] for r in geostat.collapse(df).collect()) == [3.0, 5.0]


def test_decide(spark):
    table = spark.createDataFrame([("a", None, 10.0, 1), ("a", 10.0, None, 2)], "crop string, lo double, hi double, dose int")
    rows = spark.createDataFrame([("a", 10.0), ("a", 10.5), ("b", 1.0), (None, None)], "crop string, v double")
    assert {(r["crop"], r["v"], r["dose"]) for r in lookup.decide(rows, table, ["crop"], {"v": ("lo", "hi")}).collect()} == {("a", 10.0, 1), ("a", 10.5, 2), ("b", 1.0, None), (None, None, None)}
    crops = spark.createDataFrame([("Milho grão", 1), ("Milho", 2), ("Soja", 3)], "name string, ord int")
    got = lookup.crop_parameters(spark.createDataFrame([("milho",), ("soja precoce",), ("x",)], "crop string"), crops)
    assert {(r["crop"], r["ord"]) for r in got.collect()} == {("milho", 2), ("soja precoce", 3), ("x", None)}


def test_fill(spark):
    code = "SP-3100001-" + "A" * 32
    sheet = spark.createDataFrame([(code, ""), ("bad", "keep")], "code string, place string")
    got = {r["code"]: r for r in registry.fill(sheet, spark.createDataFrame([(code, "Town", "SP")], "code string, place string, uf string"), "code", ["place", "uf"]).collect()}
    assert (got[code]["place"], got[code]["uf"], got[code]["status"]) == ("Town", "SP", "found") and (got["bad"]["place"], got["bad"]["status"]) == ("keep", "invalid")


def test_readers(spark, tmp_path):
    (tmp_path / "lab.csv").write_text("Amostra;P (mg/dm3)\nt1-1;1,5\n;\n")
    assert [tuple(r) for r in readers.lab_csv(spark, str(tmp_path / "lab.csv")).collect()] == [("t1-1", "1,5")]
    (tmp_path / "pts.csv").write_text("id;Lon;Lat\na;-47,5;-22,5\nb;x;1\n")
    assert [(r["props"]["id"], r["x"], r["y"]) for r in readers.points_csv(spark, str(tmp_path / "pts.csv")).collect()] == [("a", -47.5, -22.5)]
    (tmp_path / "p.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"plot_id":"T1"},"geometry":{"type":"Point","coordinates":[-47.1,-22.8]}}]}')
    assert [(r["props"]["plot_id"], r["x"], r["y"]) for r in readers.geojson_points(spark, str(tmp_path / "p.json")).collect()] == [("T1", -47.1, -22.8)]
    wkt = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 3, 0 0))"), (2, "POINT (1 2)")], "geom_id long, wkt string")
    assert readers.wkt_rings(wkt).count() == 4
    prj = spark.createDataFrame([("SIRGAS_2000_UTM_Zone_23S",)], "t string").select(F.expr(readers.prj_zone("t")).alias("z")).first()["z"]
    assert (prj["zone"], prj["south"]) == (23, True)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "P", 1.0), ("2024-01-01 00:10:00", "P", 3.0)], "ts string, element string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    q = element_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["mean"]) for r in spark.table("stats").collect()] == [(2, 2.0)]


def test_kriging_like_brute_force(spark):
    """Tiles of many, few and no points near, against the rule written out in numpy."""
    rng = np.random.default_rng(3)
    x, y = np.concatenate([rng.uniform(0, 60, 150), [400.0, 402.0, 405.0]]), np.concatenate([rng.uniform(0, 60, 150), [10.0, 12.0, 30.0]])
    z = np.sin(x / 20) + y / 50
    points = spark.createDataFrame(pd.DataFrame({"element": "P", "x": x, "y": y, "z": z}))
    chosen = spark.createDataFrame([("P", "spherical", 0.01, 1.0, 30.0)], "element string, model string, nugget double, partial_sill double, range_m double")
    pixel, side = 5.0, 4
    grid = [(r, c) for r in range(0, 14) for c in range(0, 90)] + [(190, 190)]
    cells = spark.createDataFrame([("P", r, c, (c + 0.5) * pixel, 70 - (r + 0.5) * pixel) for r, c in grid], "element string, row long, col long, xc double, yc double")
    got = geostat.krige(points, cells, chosen, pixel, 20, side).toPandas().set_index(["row", "col"]).sort_index()
    assert len(got) == len(grid) and got["pred"].notna().all()
    area = (x.max() - x.min()) * (y.max() - y.min())
    buffer, last = max(0.75 * 30, 3 * np.sqrt(area / len(x))), 190
    m = chosen.toPandas().iloc[0]
    for tile in {(r // side, c // side) for r, c in grid}:
        rows, cols = (np.arange(t * side, min(t * side + side, last + 1)) for t in tile)
        xs, ys = (cols + 0.5) * pixel, 70 - (rows + 0.5) * pixel
        d = np.hypot(x - xs.mean(), y - ys.mean())
        near = np.flatnonzero((x >= xs.min() - buffer) & (x <= xs.max() + buffer) & (y >= ys.min() - buffer) & (y <= ys.max() + buffer))
        near = np.argsort(d)[:16] if len(near) < 8 else near[np.argsort(d[near])[:20]]
        own = [(r, c) for r, c in grid if (r // side, c // side) == tile]
        want = geostat.krige_points(x[near], y[near], z[near], np.array([(c + 0.5) * pixel for _, c in own]), np.array([70 - (r + 0.5) * pixel for r, _ in own]), m)
        assert got.loc[own, "pred"].to_numpy() == pytest.approx(want[0], abs=1e-6) and got.loc[own, "var"].to_numpy() == pytest.approx(want[1], abs=1e-6)
    clipped, counts = geostat.clamp(spark.createDataFrame([("P", -1.0), ("P", 2.0)], "element string, pred double"))
    assert sorted(r["pred"] for r in clipped.collect()) == [0.0, 2.0] and counts.first()["n_clamped"] == 1


@pytest.mark.parametrize("nugget", [0.15, 8.0])
def test_leave_one_out_of_many_points(spark, nugget):
    """Within 1 % of the whole system's errors, with a third of the points in one strip and some that aren't finite."""
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 500, 1500), rng.uniform(0, 400, 1500)
    x[:500] = rng.uniform(0, 20, 500)
    z = 10 + 4 * np.sin(x / 120) + 3 * np.cos(y / 90) + rng.normal(0, nugget**0.5, 1500)
    odd = pd.DataFrame({"x": [np.nan, 1.0, np.inf, 3.0], "y": [1.0, np.nan, 2.0, 3.0], "z": [1.0, 1.0, 1.0, np.nan]})
    points = spark.createDataFrame(pd.concat([pd.DataFrame({"x": x, "y": y, "z": z}), odd]).assign(element="P"))
    model = spark.createDataFrame([("P", "spherical", nugget, 12.0, 300.0)], "element string, model string, nugget double, partial_sill double, range_m double")
    got = geostat.leave_one_out(points, model).first()
    e = geostat.krige_errors(x, y, z, model.first())
    assert got["rmse_loo"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-2) and got["me_loo"] == pytest.approx(e.mean(), abs=1e-2 * z.std())


def test_leave_one_out_of_few_points_is_exact(spark, field):
    p = field.toPandas()
    models = spark.createDataFrame(geostat.fit(geostat.variogram(field)).toPandas())
    errors = {r["model"]: r for r in geostat.leave_one_out(field, models).collect()}
    for m in models.toPandas().itertuples():
        e = geostat.krige_errors(*(p[c].to_numpy() for c in "xyz"), m)
        got = errors[m.model]
        assert got["rmse_loo"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-9) and got["me_loo"] == pytest.approx(e.mean(), abs=1e-9)
    # a singular system: two points at one place, no nugget
    x, y, z = np.array([0.0, 0.0, 5.0, 9.0]), np.array([0.0, 0.0, 5.0, 1.0]), np.array([1.0, 2.0, 3.0, 4.0])
    assert len(geostat.krige_errors(x, y, z, models.first())) == 4
    assert geostat.leave_one_out(field.limit(1), models).count() == 0 and geostat.leave_one_out(field.limit(0), models).count() == 0


def test_fit_like_least_squares(spark, field):
    """The relational fit against a loop over ranges with numpy's solver."""
    lags = geostat.variogram(field).toPandas().sort_values("lag")
    h, g, n = (lags[c].to_numpy() for c in ("h_mean", "gamma", "n_pairs"))
    for m in geostat.fit(geostat.variogram(field)).toPandas().itertuples():
        best = None
        for a in np.geomspace(max(h.max() / 60, 1e-3), 2 * h.max(), 80):
            s, w = geostat._shape(m.model, h, a), n / h**2
            root = np.sqrt(w)
            (c0, c), *_ = np.linalg.lstsq(np.stack([root, root * s], 1), root * g, rcond=None)
            if c0 < 0:
                c0, c = 0.0, (w * g * s).sum() / (w * s * s).sum()
            if c <= 0:
                c0, c = (w * g).sum() / w.sum(), 1e-12
            sse = (w * (g - c0 - c * s) ** 2).sum()
            if best is None or sse < best[-1]:
                best = (c0, c, a, sse)
        assert (m.nugget, m.partial_sill, m.range_m, m.sse) == pytest.approx(best, rel=1e-6)
    assert geostat.fit(geostat.variogram(field).limit(3)).count() == 0


def test_element_report(spark):
    rows = [("few", float(i), 0.0, 1.0) for i in range(7)] + [("some", float(i % 12), 1.0, float(i)) for i in range(15)] + [("many", float(i), 2.0, 3.0) for i in range(130)]
    got = {r["element"]: r for r in geostat.element_report(spark.createDataFrame(rows, "element string, x double, y double, z double")).collect()}
    assert got["few"]["too_few"] and got["few"]["warnings"] is None and got["few"]["neighbourhood"] is None
    assert (got["some"]["n"], got["some"]["n_same_place"], got["some"]["warnings"], got["some"]["neighbourhood"]) == (12, 3, ["few_points", "same_place"], "global")
    assert got["many"]["neighbourhood"] == "local" and got["many"]["warnings"] == []


def test_id_fields_ties_and_nothing(spark):
    long = lambda rows, schema: spark.createDataFrame(rows, schema)
    points = long([(i, c, v) for i in range(4) for c, v in (("b", f"T{i}"), ("a", f"T{i}"), ("area", "5"))] + [(4, "area", None)], "row_no long, col string, value string")
    lab = long([(n, c, f"t {i}") for i in range(4) for n, c in ((1, "first"), (2, "second"))] + [(0, "P", "5,1")], "col_no int, col string, value string")
    assert [tuple(r) for r in matching.id_fields(points, lab).collect()] == [("a", "first", 0.8)]
    assert matching.id_fields(points, lab.where("col = 'P'")).count() == 0 and matching.id_fields(points.limit(0), lab).count() == 0


def test_rings_and_places_readers(spark, tmp_path):
    square, hole = [[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    import json

    for name, body in {
        "c": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]},
        "f": {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square, hole]]}},
        "g": {"type": "Polygon", "coordinates": [square]},
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    count = lambda n: sorted((r["poly_id"], r["ring_id"], r["is_exterior"]) for r in readers.geojson_rings(spark, str(tmp_path / f"{n}.json")).where("seq = 0").collect())
    assert count("c") == [(0, 0, True), (0, 1, False)] and count("f") == [(0, 0, True), (1, 0, True), (1, 1, False)] and count("g") == [(0, 0, True)]
    ring = lambda kind, text: f"<{kind}><LinearRing><coordinates>{text}</coordinates></LinearRing></{kind}>"
    (tmp_path / "p.kml").write_text(f"<kml><Placemark><Polygon>{ring('outerBoundaryIs', ' 0,0,0 4,0,0  4,4,0 0,0,0 ')}{ring('innerBoundaryIs', '1,1 2,1 2,2')}</Polygon></Placemark></kml>")
    got = readers.kml_rings(spark, str(tmp_path / "p.kml")).orderBy("ring_id", "seq").collect()
    assert [(r["is_exterior"], r["x"], r["y"]) for r in got] == [(True, 0, 0), (True, 4, 0), (True, 4, 4), (True, 0, 0), (False, 1, 1), (False, 2, 1), (False, 2, 2)]
    (tmp_path / "m.tsv").write_text("3100104\tAbadia\tMG\nshort\n")
    assert [tuple(r) for r in readers.places_tsv(spark, str(tmp_path / "m.tsv")).collect()] == [("3100104", "Abadia", "MG")]
    (tmp_path / "s.csv").write_text("\ufeffcode;a,b\nx;1\n", encoding="utf-8")
    assert readers.sheet_csv(spark, str(tmp_path / "s.csv")).columns == ["code", "a,b"]
    (tmp_path / "l.csv").write_text("id;P\nT1 0-20;1\nT1 10-20;2\n")
    assert [r["P"] for r in readers.lab_csv(spark, str(tmp_path / "l.csv"), "0 - 20").collect()] == ["1"]
    with pytest.raises(ValueError):
        readers.lab_csv(spark, str(tmp_path / "l.csv"), "40-60")


def test_frames_and_boxes(spark):
    none = spark.createDataFrame([], "geom_id long, x double, y double")
    assert tuple(geometry.box(none).first()) == (0, 0, 0, 0) and geometry.same_frame(none, 23, True).count() == 0
    degrees = spark.createDataFrame([(1, -47.0, -22.9), (1, -47.01, -22.9)], "geom_id long, x double, y double")
    assert {(r["zone"], r["epsg"]) for r in geometry.same_frame(degrees).collect()} == {(23, 31983)}
    with pytest.raises(ValueError):
        geometry.same_frame(degrees.unionByName(spark.createDataFrame([(2, 294857.0, 7466157.0)], degrees.schema)))


def test_lookup_keeps_clashing_columns(spark):
    table = spark.createDataFrame([("a", 1.0, "its")], "crop string, dose double, note string")
    got = lookup.decide(spark.createDataFrame([("a", "mine")], "crop string, note string"), table, ["crop"], {}).first()
    assert got.asDict() == {"crop": "a", "note": "mine", "dose": 1.0}
    crops = spark.createDataFrame([("café", 1), ("café arábica", 2)], "name string, ord int")
    assert [r["ord"] for r in lookup.crop_parameters(spark.createDataFrame([("CAFE",), (" ",), (None,)], "crop string"), crops).orderBy("crop").collect()] == [None, None, 1]
    with pytest.raises(ValueError):
        registry.fill(spark.createDataFrame([("x", "y")], "code string, status string"), spark.createDataFrame([], "code string, place string"), "code", ["place"])


def test_writers(spark, tmp_path):
    from pedon.sources import writers

    rows = spark.createDataFrame([("P", 8, ["few_points"])], "element string, n long, warnings array<string>")
    assert writers.json_report(rows).first()["json"] == '{"element":"P","n":8,"warnings":["few_points"]}'
    writers.write_csv(rows.select("element", "n"), str(tmp_path / "out"))
    assert readers.sheet_csv(spark, str(tmp_path / "out")).first()["n"] == "8"
