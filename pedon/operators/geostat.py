"""Variograms, model choice by leave-one-out, and kriging by tiles.

Points are (element, x, y, z); every element is done at once.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedon.functions.geo import MODELS
from pedon.operators import spatial
from pedon.session import durable

BINS, CANDIDATES = 12, 80
# Cells of a tile's side; points of a tile at most; under so many the nearest of all are taken, and how many.
TILE_CELLS, MOST_POINTS, FEW_POINTS, FILL_POINTS = 64, 96, 8, 16
# Points up to which all predict every cell; points that an element needs, and that make a variogram robust.
GLOBAL_POINTS, LEAST_POINTS, ROBUST_POINTS = 120, 8, 25
#: Pairs of blocks that one task of a variogram takes.
BLOCK_PAIRS = 16
#: Points that each one is predicted from when it is left out; systems solved together, and by one task.
LEFT_OUT_POINTS, SOLVED, PLACES = 64, 128, 20_000


def collapse(points: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Points at the same rounded place become their mean."""
    return points.groupBy("element", F.rint(F.col("x") / tolerance).alias("_a"), F.rint(F.col("y") / tolerance).alias("_b")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")
    ).drop("_a", "_b")


def unusable(points: DataFrame) -> DataFrame:
    """(element, n_unusable): points that no prediction uses, as a coordinate or value is null, NaN or infinite."""
    return points.where(~spatial.is_finite("x", "y", "z")).groupBy("element").agg(F.count(F.lit(1)).alias("n_unusable"))


def stats(points: DataFrame) -> DataFrame:
    return points.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("lowest"), F.max("z").alias("highest"), F.avg("z").alias("mean"), F.var_pop("z").alias("variance"))


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull (Andrew's monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return p

    def chain(q):
        out: list = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def widest(points: DataFrame) -> DataFrame:
    """(element, widest): the largest distance of two points, which are corners of hulls: each task sends its own hull's."""

    def hulls(batches):
        for b in batches:
            for e, g in b.groupby("element"):
                h = _hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({"element": e, "x": h[:, 0], "y": h[:, 1]})

    def far(key, g):
        h = _hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({"element": [key[0]], "widest": [max((float(np.hypot(*(h - c).T).max()) for c in h), default=0.0)]})

    corners = points.select("element", "x", "y").mapInPandas(hulls, "element string, x double, y double")
    return corners.groupBy("element").applyInPandas(far, "element string, widest double")


def variogram(points: DataFrame, bins: int = BINS, block: int = 2000) -> DataFrame:
    """(element, lag, h_mean, gamma, n_pairs) up to half the largest distance; lags of two pairs or more.

    An element's points are dealt to blocks of about ``block``; a task takes
    two blocks (or one with itself) and gives its sums for each lag, so that no
    row stands for a pair of points and every task has as much to do.
    """
    points = durable(points.select("element", "x", "y", "z"))
    n = durable(points.groupBy("element").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    # an element's numbers go to its points: points dealt by element would be one task's
    p = points.join(F.broadcast(widest(points)), "element").where("widest > 0").join(F.broadcast(n), "element")
    p = p.withColumn("own", F.pmod(F.xxhash64("x", "y", "z"), F.col("blocks")))
    p = p.select("element", "x", "y", "z", (F.col("widest") / 2).alias("cut"), "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    p = p.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # rows are few for what they cost: as many tasks as pairs of blocks bear, not as few as their bytes do
    pairs = n.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    p = p.repartition(spatial.spread(points, int(pairs) // BLOCK_PAIRS), "element", "i", "j")

    def one(key, g):
        cut, own = float(g["cut"].iloc[0]), (g["own"] == key[1]).to_numpy()
        xyz = g[["x", "y", "z"]].to_numpy(float)
        a, b = xyz[own], xyz if key[1] == key[2] else xyz[~own]
        total = np.zeros((3, bins))
        for s in range(0, len(a), 256):
            c = a[s : s + 256]
            h = np.hypot(c[:, :1] - b[:, 0], c[:, 1:2] - b[:, 1])
            near = (h > 0) & (h <= cut)
            if key[1] == key[2]:  # each pair once
                near &= np.arange(s, s + len(c))[:, None] < np.arange(len(b))
            h, d = h[near], ((c[:, 2:] - b[:, 2]) ** 2)[near] / 2
            lag = np.minimum((h / (cut / bins)).astype(int), bins - 1)
            total += [np.bincount(lag, w, bins) for w in (np.ones(len(h)), h, d)]
        k = np.flatnonzero(total[0])
        return pd.DataFrame({"element": key[0], "lag": k, "n": total[0][k].astype(int), "h": total[1][k], "d": total[2][k]})

    sums = p.groupBy("element", "i", "j").applyInPandas(one, "element string, lag int, n long, h double, d double")
    out = sums.groupBy("element", "lag").agg((F.sum("h") / F.sum("n")).alias("h_mean"), (F.sum("d") / F.sum("n")).alias("gamma"), F.sum("n").alias("n_pairs"))
    return out.where("n_pairs > 1")


def _shape(model: str, h: np.ndarray, a: float) -> np.ndarray:
    r = h / a
    if model == "spherical":
        r = np.minimum(r, 1)
        return 1.5 * r - 0.5 * r**3
    return 1 - np.exp(-3 * (r if model == "exponential" else r * r))


#: The models' shapes at a lag of r ranges.
_SHAPES = {"exponential": "1 - exp(-3 * {r})", "spherical": "1.5 * least({r}, 1D) - 0.5 * pow(least({r}, 1D), 3)", "gaussian": "1 - exp(-3 * {r} * {r})"}


def _over_lags(term: str) -> Column:
    """The sum of ``term`` over an element's lags: l.w is a lag's weight, l.g its gamma, l.h its distance and l.s the shape there."""
    return F.expr(f"aggregate(lags, 0D, (total, l) -> total + {term})")


def fit(lags: DataFrame) -> DataFrame:
    """(element, model, nugget, partial_sill, range_m, sse): for each model the best of geometric candidate ranges, by least squares weighted by n / h2.

    A nugget or sill under 0 is held at the bound and the other refitted.
    Elements with fewer than four lags have no rows. Errors that agree in nine
    digits are equal, and the shortest of equal ranges is taken.
    """
    rows = lags.groupBy("element").agg(F.collect_list(F.struct(F.col("h_mean").alias("h"), F.col("gamma").alias("g"), (F.col("n_pairs") / F.pow(F.greatest("h_mean", F.lit(1e-9)), 2)).alias("w"))).alias("lags"), F.max("h_mean").alias("top"))
    low = F.greatest(F.col("top") / 60, F.lit(1e-3))
    each = rows.where(F.size("lags") >= 4).withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)))).withColumn("a", low * F.pow(2 * F.col("top") / low, F.col("no") / (CANDIDATES - 1)))
    each = each.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    shape = "CASE model " + " ".join(f"WHEN '{m}' THEN {_SHAPES[m].format(r='(l.h / a)')}" for m in MODELS) + " END"
    each = each.withColumn("lags", F.expr(f"transform(lags, l -> struct(l.h, l.g, l.w, {shape} AS s))"))
    each = each.withColumns({"m11": _over_lags("l.w"), "m12": _over_lags("l.w * l.s"), "m22": _over_lags("l.w * l.s * l.s"), "b1": _over_lags("l.w * l.g"), "b2": _over_lags("l.w * l.g * l.s")})
    each = each.withColumn("det", F.expr("m11 * m22 - m12 * m12")).where("abs(det) >= 1e-12")
    free = each.withColumns({"c0": F.expr("(b1 * m22 - b2 * m12) / det"), "c": F.expr("(m11 * b2 - m12 * b1) / det")})
    held = free.withColumns({"c": F.expr("CASE WHEN c0 >= 0 THEN c WHEN m22 > 0 THEN b2 / m22 ELSE 0D END"), "c0": F.expr("greatest(c0, 0D)")})
    held = held.withColumns({"c0": F.expr("CASE WHEN c <= 0 THEN b1 / m11 ELSE c0 END"), "c": F.expr("CASE WHEN c <= 0 THEN 1e-12 ELSE c END")})
    held = held.withColumn("sse", _over_lags("l.w * (l.g - c0 - c * l.s) * (l.g - c0 - c * l.s)"))
    digits = F.format_string("%.8e", "sse").cast("double")
    best = held.groupBy("element", "model").agg(F.min_by(F.struct(F.col("c0").alias("nugget"), F.col("c").alias("partial_sill"), F.col("a").alias("range_m"), "sse"), F.struct(digits, "no")).alias("b"))
    return best.select("element", "model", "b.*")


def _matrix(x: np.ndarray, y: np.ndarray, m) -> np.ndarray:
    n = len(x)
    a = np.ones((n + 1, n + 1))
    h = np.hypot(x[:, None] - x, y[:, None] - y)
    a[:n, :n] = np.where(h > 0, m.nugget + m.partial_sill * _shape(m.model, h, m.range_m), 0.0)
    a[n, n] = 0
    return a


def krige_points(x: np.ndarray, y: np.ndarray, z: np.ndarray, xc: np.ndarray, yc: np.ndarray, m) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging: (prediction, variance) at each target."""
    h = np.hypot(xc - x[:, None], yc - y[:, None])
    right = np.vstack([np.where(h > 0, m.nugget + m.partial_sill * _shape(m.model, h, m.range_m), 0.0), np.ones(len(xc))])
    a = _matrix(x, y, m)
    try:
        weights = np.linalg.solve(a, right)
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(a, right, rcond=None)[0]
    return weights[:-1].T @ z, (weights * right).sum(axis=0)


def krige_errors(x: np.ndarray, y: np.ndarray, z: np.ndarray, m) -> np.ndarray:
    """The error of predicting each point from all the others, by one inversion of the whole system; point by point where that is singular."""
    try:
        w = np.linalg.inv(_matrix(x, y, m))
        return -(w @ np.append(z, 0))[:-1] / np.diag(w)[:-1]
    except np.linalg.LinAlgError:
        return np.array([krige_points(*(np.delete(v, i) for v in (x, y, z)), x[i : i + 1], y[i : i + 1], m)[0][0] - z[i] for i in range(len(x))])


def _errors_from(near: np.ndarray, at: np.ndarray, fits: list) -> np.ndarray:
    """Errors (fits, places) at places ``at`` (places, 3: x, y, z) predicted from as many points each ``near`` (places, points, 3)."""
    n = near.shape[1]
    d = lambda a, b: np.hypot(a[..., 0] - b[..., 0], a[..., 1] - b[..., 1])
    between, to = d(near[:, :, None], near[:, None, :]), d(near, at[:, None])
    out = []
    for m in fits:
        gamma = lambda h: np.where(h > 0, m.nugget + m.partial_sill * _shape(m.model, h, m.range_m), 0.0)  # noqa: B023, E731
        a, right = np.ones((len(near), n + 1, n + 1)), np.ones((len(near), n + 1, 1))
        a[:, :n, :n], a[:, n, n], right[:, :n, 0] = gamma(between), 0, gamma(to)
        try:
            weights = np.linalg.solve(a, right)[:, :n, 0]
        except np.linalg.LinAlgError:
            weights = np.stack([np.linalg.lstsq(p, q, rcond=None)[0][:n, 0] for p, q in zip(a, right, strict=True)])
        out.append((weights * near[:, :, 2]).sum(1) - at[:, 2])
    return np.stack(out)


def leave_one_out(points: DataFrame, models: DataFrame, k: int = LEFT_OUT_POINTS) -> DataFrame:
    """(element, model, rmse_loo, me_loo): errors of predicting each point from its ``k`` nearest others.

    An element of up to k + 1 points is predicted exactly; of more points the
    nearest screen the rest. Elements of fewer than three points, and models
    without any finite error, have no row; rows that aren't finite are left out.
    """
    own = durable(spatial.finite(points, "x", "y", "z").select("element", "x", "y", "z").withColumn("id", F.monotonically_increasing_id()))
    places = own.select("element", "id", F.col("x").alias("mx"), F.col("y").alias("my"))
    near = spatial.nearest(places, spatial.tree(own), ["id"], k + 1)
    # the point itself goes, or of others at its place the last
    others = F.expr(f"slice(filter(near, p -> p.id <> id), 1, {k})")
    sets = durable(near.select("element", others.alias("near"), F.element_at(F.expr("filter(near, p -> p.id = id)"), 1).alias("own")).where("size(near) >= 2 AND own IS NOT NULL"))
    few = models.groupBy("element").agg(F.collect_list(F.struct("model", "nugget", "partial_sill", "range_m")).alias("models"))  # one for each kind of model
    together = sets.join(F.broadcast(few), "element").repartition(spatial.spread(sets, sets.count() // PLACES))
    schema = pa.schema([("element", pa.string()), ("model", pa.string()), ("sq", pa.float64()), ("sum", pa.float64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            elements, lists, at, fits = (batch.column(i) for i in range(4))
            points = np.stack([lists.flatten().field(c).to_numpy() for c in "xyz"], 1)
            at = np.stack([at.field(c).to_numpy() for c in "xyz"], 1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            # places of one element with as many neighbours are solved together
            alike = pd.DataFrame({"e": pd.factorize(elements.to_pandas(), use_na_sentinel=False)[0], "n": np.diff(ends)}).groupby(["e", "n"]).indices
            rows = []
            for (_, n), group in alike.items():
                e = elements[int(group[0])].as_py()
                models = [SimpleNamespace(**m) for m in fits[int(group[0])].as_py()]
                for s in range(0, len(group), SOLVED):
                    part = group[s : s + SOLVED]
                    for m, err in zip(models, _errors_from(points[ends[part][:, None] + np.arange(n)], at[part], models), strict=True):
                        err = err[np.isfinite(err)]
                        rows.append({"element": e, "model": m.model, "sq": float((err * err).sum()), "sum": float(err.sum()), "n": len(err)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = together.mapInArrow(run, "element string, model string, sq double, sum double, n long").groupBy("element", "model").agg(F.sum("sq").alias("sq"), F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    return out.where("n > 0").select("element", "model", F.sqrt(F.col("sq") / F.col("n")).alias("rmse_loo"), (F.col("sum") / F.col("n")).alias("me_loo"))


def choose(models: DataFrame, errors: DataFrame) -> DataFrame:
    """The fit of least leave-one-out error of each element; ties in the order of MODELS."""
    order = F.array_position(F.array(*map(F.lit, MODELS)), F.col("model"))
    both = models.join(errors, ["element", "model"])
    return both.groupBy("element").agg(F.min_by(F.struct(*both.columns), F.struct("rmse_loo", order)).alias("m")).select("m.*")


def neighbours(tiles: DataFrame, points: DataFrame, most_points: int = MOST_POINTS, few: int = FEW_POINTS, fill: int = FILL_POINTS) -> DataFrame:
    """(element, ti, tj, x, y, z): the points that each tile is predicted from.

    tiles: (element, ti, tj, x0, x1, y0, y1, mx, my, side, buffer). They are
    the points within the buffer of the tile's edges; of more than
    ``most_points`` the nearest to its centre; and where there are fewer than
    ``few``, the ``fill`` nearest of all. A null buffer stands for all of the
    element's points. Points and tiles that aren't finite are left out.
    """
    key = ["element", "ti", "tj"]
    usable = spatial.finite(points, "x", "y", "z").select("element", "x", "y", "z")
    whole = tiles.where("buffer is null").select(*key).join(usable, "element")
    local = tiles.where("buffer is not null")
    tree = spatial.tree(durable(usable.join(local.select("element").distinct(), "element", "left_semi").withColumn("id", F.monotonically_increasing_id())))
    wide = F.col("buffer")
    boxed = local.select(*key, "mx", "my", (F.col("x0") - wide).alias("bx0"), (F.col("x1") + wide).alias("bx1"), (F.col("y0") - wide).alias("by0"), (F.col("y1") + wide).alias("by1"))
    near = durable(spatial.nearest(boxed, tree, ["ti", "tj"], most_points).where(F.size("near") >= few))
    alone = local.join(near.select(*key), key, "left_anti").select(*key, "mx", "my")
    both = near.unionByName(spatial.nearest(alone, tree, ["ti", "tj"], fill))
    return both.select(*key, F.inline("near")).select(*key, "x", "y", "z").unionByName(whole.select(*key, "x", "y", "z"))


def krige(points: DataFrame, cells: DataFrame, chosen: DataFrame, pixel: float, most_points: int = MOST_POINTS, tile_cells: int = TILE_CELLS, global_points: int = GLOBAL_POINTS) -> DataFrame:
    """(element, row, col, pred, var) at each cell (element, row, col, xc, yc), by tiles of ``tile_cells`` cells a side.

    An element of up to ``global_points`` points is predicted from all of them;
    more from each tile's neighbours, within three quarters of the range or
    three spacings of the tile, whichever is more. Cells of elements without a
    model or without points have no rows, and neither have cells whose place is
    not finite; points that aren't finite are left out (``unusable`` counts them).
    """
    points, cells = spatial.finite(points, "x", "y", "z"), spatial.finite(cells, "xc", "yc")
    area = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(1.0))
    spread = points.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.sqrt(area / F.count(F.lit(1))).alias("spacing"))
    local = F.when(F.col("n") > global_points, F.greatest(0.75 * F.col("range_m"), 3 * F.col("spacing")))
    model = chosen.select("element", "model", "nugget", "partial_sill", "range_m").join(F.broadcast(spread), "element").withColumn("buffer", local)
    c = cells.select("element", "row", "col", "xc", "yc", F.floor(F.col("row") / tile_cells).alias("ti"), F.floor(F.col("col") / tile_cells).alias("tj"))
    ends = c.groupBy("element").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    at = c.groupBy("element", "ti", "tj").agg(F.min(F.col("xc") - F.col("col") * pixel).alias("xa"), F.max(F.col("yc") + F.col("row") * pixel).alias("ya")).join(F.broadcast(ends), "element").join(F.broadcast(model), "element")
    first, last = (lambda t: F.col(t) * tile_cells), (lambda t, end: F.least(F.col(t) * tile_cells + tile_cells - 1, F.col(end)))
    tiles = at.select(
        "element", "ti", "tj", "buffer", F.lit(pixel * tile_cells).alias("side"),
        (F.col("xa") + first("tj") * pixel).alias("x0"), (F.col("xa") + last("tj", "last_col") * pixel).alias("x1"),
        (F.col("ya") - last("ti", "last_row") * pixel).alias("y0"), (F.col("ya") - first("ti") * pixel).alias("y1"),
    )
    tiles = durable(tiles.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2}))
    near = neighbours(tiles, points, most_points)

    def one(key, p, c):
        if not len(c) or not len(p):
            return pd.DataFrame({"element": [], "row": [], "col": [], "pred": [], "var": []})
        pred, var = krige_points(*(p[k].to_numpy(float) for k in "xyz"), c["xc"].to_numpy(float), c["yc"].to_numpy(float), c.iloc[0])
        return pd.DataFrame({"element": np.full(len(c), key[0], object), "row": c["row"].to_numpy(), "col": c["col"].to_numpy(), "pred": pred, "var": var})

    keys = ["element", "ti", "tj"]
    places = c.join(F.broadcast(model.drop("n", "spacing", "buffer")), "element")
    places = places.toDF(*places.columns)  # columns of its own
    return near.groupBy(*keys).cogroup(places.groupBy(*keys)).applyInPandas(one, "element string, row long, col long, pred double, var double")


def clamp(kriged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with no prediction under 0, (element, n_clamped)): a content isn't negative."""
    counted = kriged.groupBy("element").agg(F.count_if(F.col("pred") < 0).alias("n_clamped"))
    return kriged.withColumn("pred", F.when(F.col("pred") < 0, 0.0).otherwise(F.col("pred"))), counted


def element_report(raw: DataFrame, chosen: DataFrame | None = None, clamped: DataFrame | None = None, censored: DataFrame | None = None, least: int = LEAST_POINTS, robust: int = ROBUST_POINTS, global_points: int = GLOBAL_POINTS) -> DataFrame:
    """One row per element of the raw points (element, x, y, z): (element, n, lowest, highest, mean, n_same_place, neighbourhood, too_few, warnings).

    Under ``least`` points an element has no map (too_few). warnings are tags:
    few_points, weak_structure (a sill under 5 % of the variance; chosen),
    censored and clamped (from (element, n_censored) and (element, n_clamped)),
    same_place.
    """
    before = raw.groupBy("element").agg(F.count(F.lit(1)).alias("n_raw"))
    r = stats(collapse(raw)).join(before, "element").withColumn("n_same_place", F.col("n_raw") - F.col("n"))
    fill = lambda r, df, c: r.join(df.select("element", c), "element", "left") if df is not None else r.withColumn(c, F.lit(None).cast("double"))
    r = fill(fill(fill(r, chosen, "partial_sill"), clamped, "n_clamped"), censored, "n_censored")
    ok = F.col("n") >= least
    tags = {"few_points": F.col("n") < robust, "weak_structure": F.col("partial_sill") < 0.05 * F.col("variance"), "censored": F.col("n_censored") > 0, "clamped": F.col("n_clamped") > 0, "same_place": F.col("n_same_place") > 0}
    warnings = F.filter(F.array(*[F.when(c, tag) for tag, c in tags.items()]), lambda x: x.isNotNull())
    return r.select("element", "n", "lowest", "highest", F.round("mean", 4).alias("mean"), "n_same_place", F.when(ok, F.when(F.col("n") > global_points, "local").otherwise("global")).alias("neighbourhood"), (~ok).alias("too_few"), F.when(ok, warnings).alias("warnings"))
