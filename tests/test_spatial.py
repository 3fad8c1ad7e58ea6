"""Nearest points by the tree against distances of all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedon.operators import geostat, spatial


def cloud(rng, n):
    """Points of very unlike densities: even ones, a cluster of a third of all, a line, and repeated places."""
    x = np.concatenate([rng.uniform(0, 1000, n // 3), rng.normal(700, 0.5, n // 3), np.linspace(0, 1000, n // 6), np.full(n - 2 * (n // 3) - n // 6, 250.0)])
    y = np.concatenate([rng.uniform(0, 300, n // 3), rng.normal(200, 0.5, n // 3), np.full(n // 6, 10.0), rng.integers(0, 5, n - 2 * (n // 3) - n // 6) + 100.0])
    return pd.DataFrame({"element": "P", "x": x, "y": y, "z": rng.normal(size=n), "id": np.arange(n)})


def brute(points, place, k):
    p = points[(points.x >= place.bx0) & (points.x <= place.bx1) & (points.y >= place.by0) & (points.y <= place.by1)]
    d = np.hypot(p.x - place.mx, p.y - place.my)
    return np.sort(d.to_numpy())[:k]


@pytest.mark.parametrize(("most", "k", "visits"), [(8, 5, 4096), (64, 20, 16), (1024, 7, 4096), (4, 40, 50)])
def test_nearest_like_all_pairs(spark, monkeypatch, most, k, visits):
    monkeypatch.setattr(spatial, "VISITS", visits)
    rng = np.random.default_rng(most)
    points = cloud(rng, 900)
    n = 300
    places = pd.DataFrame({"element": "P", "q": np.arange(n), "mx": rng.uniform(-300, 1300, n), "my": rng.uniform(-100, 400, n)})
    places.loc[:99, ["mx", "my"]] = points[["x", "y"]].sample(100, random_state=1).to_numpy()
    half = rng.choice([5.0, 60.0, np.inf], n)
    for c, v, s in (("bx0", "mx", -1), ("bx1", "mx", 1), ("by0", "my", -1), ("by1", "my", 1)):
        places[c] = places[v] + s * half
    t = spatial.tree(spark.createDataFrame(points), most)
    got = {r["q"]: [p["d"] for p in r["near"]] for r in spatial.nearest(spark.createDataFrame(places), t, ["q"], k).collect()}
    for place in places.itertuples():
        want = brute(points, place, k)
        assert got.get(place.q, []) == pytest.approx(list(want))


def test_tree_has_each_point_in_one_bounded_leaf(spark):
    points = spark.createDataFrame(cloud(np.random.default_rng(2), 3000))
    t = spatial.tree(points, 32)
    leaves = t.points.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).toPandas()
    assert leaves["n"].sum() == 3000 and len(leaves) == t.nodes.where("leaf").count()
    # over 32 only where one finest cell holds them
    assert (leaves[leaves["n"] > 32]["level"] == t.depth).all() and (leaves["n"] <= 32).mean() > 0.9


def test_a_dense_cluster_elsewhere_costs_nothing(spark):
    """Places far from a cluster of 100 times the points visit as many leaves as without it."""
    rng = np.random.default_rng(4)
    even = pd.DataFrame({"element": "P", "x": rng.uniform(0, 1000, 2000), "y": rng.uniform(0, 1000, 2000), "z": 0.0, "id": np.arange(2000)})
    dense = pd.DataFrame({"element": "P", "x": rng.uniform(900, 901, 200_000), "y": rng.uniform(900, 901, 200_000), "z": 0.0, "id": np.arange(200_000)})
    places = spark.createDataFrame(pd.DataFrame({"element": "P", "q": np.arange(50), "mx": np.linspace(50, 700, 50), "my": np.linspace(50, 700, 50)}))
    box = places.withColumns({c: F.lit(float("-inf") if c.endswith("0") else float("inf")) for c in ("bx0", "bx1", "by0", "by1")})
    count = lambda p: spatial._visits(box, spatial.tree(spark.createDataFrame(p), 64), ["element", "q"], 16).count()
    assert count(pd.concat([even, dense])) <= 1.5 * count(even)


def test_odd_points_and_places(spark):
    kind = "element string, x double, y double, z double, id long"
    t = spatial.tree(spark.createDataFrame([], kind))
    places = spark.createDataFrame([("P", 1, 0.0, 0.0), ("P", 2, None, 0.0), ("P", 3, float("nan"), 1.0), ("Q", 4, 5.0, 5.0)], "element string, q int, mx double, my double")
    assert spatial.nearest(places, t, ["q"], 3).count() == 0
    one = spatial.tree(spark.createDataFrame([("P", 7.0, 7.0, 1.0, 5), ("P", 7.0, 7.0, 2.0, 6)], kind))
    got = spatial.nearest(places, one, ["q"], 3).collect()
    assert [(r["q"], [p["id"] for p in r["near"]]) for r in got] == [(1, [5, 6])]
    odd = spark.createDataFrame([("P", None, 1.0), ("P", float("nan"), 1.0), ("P", float("inf"), 1.0), ("P", 1.0, 2.0)], "element string, x double, y double")
    assert spatial.finite(odd, "x", "y").count() == 1


def test_kriging_leaves_out_what_is_not_finite(spark):
    rng = np.random.default_rng(1)
    good = pd.DataFrame({"element": "P", "x": rng.uniform(0, 100, 130), "y": rng.uniform(0, 100, 130), "z": rng.normal(size=130)})
    odd = pd.DataFrame({"element": "P", "x": [np.nan, 5.0], "y": [1.0, 2.0], "z": [1.0, np.nan]})
    model = spark.createDataFrame([("P", "spherical", 0.1, 1.0, 30.0)], "element string, model string, nugget double, partial_sill double, range_m double")
    cells = spark.createDataFrame([("P", r, c, c * 10 + 5.0, 95.0 - r * 10) for r in range(10) for c in range(10)] + [("P", 99, 99, float("nan"), 1.0)], "element string, row long, col long, xc double, yc double")
    want = geostat.krige(spark.createDataFrame(good), cells, model, 10.0).orderBy("row", "col").collect()
    got = geostat.krige(spark.createDataFrame(pd.concat([good, odd])), cells, model, 10.0).orderBy("row", "col").collect()
    assert len(got) == 100 and got == want
    assert geostat.unusable(spark.createDataFrame(pd.concat([good, odd]))).collect() == [("P", 2)]


def test_points_are_not_dealt_by_element(spark):
    """Two elements would be two tasks, however many points they have."""
    points = spark.createDataFrame([(f"e{i % 2}", float(i % 31), float(i % 37), float(i % 7)) for i in range(500)], "element string, x double, y double, z double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = geostat.variogram(points)._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
