"""Matches the identifiers of two tables, one to one, in layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.functions import text
from pedon.operators.similarity import match_similar
from pedon.session import durable

LAYERS = [("canonico", 1.0), ("sem-ruido", 0.95), ("assinatura", 0.90)]


def _keyed(ids: DataFrame, column: str, side: str) -> DataFrame:
    """Each distinct identifier with the keys of all layers, from one reading of its tokens, written once."""
    tokens = ids.select(F.col(column).alias(side)).where(F.col(side).isNotNull()).distinct().withColumn("_tokens", text.id_tokens(side))
    keys = [text.canonical_of("_tokens"), text.reduced_of("_tokens"), text.signature(side)]
    return durable(tokens.select(side, *[k.alias(f"_key{i}") for i, k in enumerate(keys)]))


def _lone(ids: DataFrame, side: str, key: str) -> DataFrame:
    """Ids whose key no other id has, by partial aggregates: a very common key is one row a task."""
    return ids.select(side, F.col(key).alias("_key")).where("_key <> ''").groupBy("_key").agg(F.min(side).alias(side), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def match_ids(points: DataFrame, lab: DataFrame, point_col: str = "point_id", lab_col: str = "lab_id", similar: bool = False) -> DataFrame:
    """(point_id, lab_id, confidence, method): each layer joins the ids that no earlier layer used and whose key is unique on both sides.

    Null ids and ids with an empty key match nothing; repeated ids count once.
    A layer's pairs are written, and the next one starts from what they left.
    With ``similar`` the last layer pairs what is left by similarity.
    """
    a, b = _keyed(points, point_col, "point_id"), _keyed(lab, lab_col, "lab_id")
    found = None
    for i, (method, confidence) in enumerate(LAYERS):
        got = _lone(a, "point_id", f"_key{i}").join(_lone(b, "lab_id", f"_key{i}"), "_key")
        got = durable(got.select("point_id", "lab_id", F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))
        a, b = a.join(got, "point_id", "left_anti"), b.join(got, "lab_id", "left_anti")
        found = got if found is None else found.unionByName(got)
    return found.unionByName(match_similar(a, b)) if similar else found


def orphans(ids: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    return ids.select(column).where(F.col(column).isNotNull()).distinct().join(pairs, column, "left_anti")


def with_manual(pairs: DataFrame, manual: DataFrame) -> DataFrame:
    """Pairs that the user gave (point_id, lab_id) take the place of all that touch either side."""
    kept = pairs.join(manual, "point_id", "left_anti").join(manual, "lab_id", "left_anti")
    return kept.unionByName(manual.select("point_id", "lab_id", F.lit(1.0).alias("confidence"), F.lit("manual").alias("method")))


def confident(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    return pairs.where((F.col("confidence") >= least) | (F.col("method") == "manual"))


def depth_duplicates(lab: DataFrame, lab_col: str = "lab_id") -> DataFrame:
    """(base_id, n, n_rows): identifiers that differ by their layer only, or that several rows have."""
    return lab.select(F.col(lab_col).alias("lab_id")).groupBy(text.depth_of("lab_id")["base"].alias("base_id")).agg(F.count_distinct("lab_id").alias("n"), F.count(F.lit(1)).alias("n_rows")).where("n > 1 or n_rows > 1")


def id_fields(points: DataFrame, lab: DataFrame) -> DataFrame:
    """One row (point_col, lab_col, score): the two columns that hold the same identifiers.

    points and lab are long: (row_no, col, value) and (col_no, col, value), the
    latter's col_no being the column's place in the report. Score: the share of
    all point rows whose reduced identifier occurs in the lab column, times
    half of one plus the share of distinct identifiers among all points. Ties
    go to the first point column by name and then to the first lab column.
    Nothing scores 0, so there may be no row.
    """
    total = points.agg(F.count_distinct("row_no")).first()[0]
    p = points.select("row_no", "col", F.coalesce(text.reduced_id("value"), F.lit("")).alias("key"))
    full = p.groupBy("col").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("key").alias("_keys"), F.max((F.col("key") == "").cast("int")).alias("_empty"))
    # rows without the attribute count as one more, empty, identifier
    unique = (F.col("_keys") + F.when((F.col("_empty") == 0) & (F.col("_rows") < total), 1).otherwise(0)) / F.lit(float(total or 1))
    keys = p.where("key <> ''").groupBy("col", "key").agg(F.count(F.lit(1)).alias("n"))
    known = lab.where(F.trim("value") != "").select("col_no", F.col("col").alias("lab_col"), text.reduced_id("value").alias("key")).where("key <> ''").distinct()
    hits = keys.join(known, "key").groupBy("col", "lab_col", "col_no").agg(F.sum("n").alias("hits")).join(full.select("col", unique.alias("_unique")), "col")
    score = F.col("hits") / F.lit(float(total or 1)) * (0.5 + 0.5 * F.col("_unique"))
    scored = hits.select(F.col("col").alias("point_col"), "lab_col", "col_no", score.alias("score"))
    best = scored.agg(F.min_by(F.struct("point_col", "lab_col", F.round("score", 3).alias("score")), F.struct(-F.col("score"), "point_col", "col_no")).alias("b"))
    return best.where("b is not null").select("b.*")


def lab_filter(lab: DataFrame, wanted: str) -> DataFrame:
    """Rows of a report with a cell whose canonical form is that of ``wanted`` or ends with it."""
    target = text.canonical_id(F.lit(wanted))
    form = lambda c: F.coalesce(text.canonical_id(F.col(f"`{c}`").cast("string")), F.lit(""))
    fits = [(form(c) == target) | form(c).endswith(F.concat(F.lit("-"), target)) for c in lab.columns]
    return lab.where(reduce(lambda a, b: a | b, fits))


def numeric_share(lab: DataFrame, least: float = 0.7) -> DataFrame:
    """(col, n_filled, n_numbers, numeric) of a long report (col, value): a column is numeric where 70 % of its filled cells are numbers."""
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    number = text.br_number("value")["value"].isNotNull()
    out = lab.groupBy("col").agg(F.count_if(filled).alias("n_filled"), F.count_if(filled & number).alias("n_numbers"))
    return out.withColumn("numeric", (F.col("n_filled") > 0) & (F.col("n_numbers") >= F.lit(least) * F.col("n_filled")))


def value_at_point(pairs: DataFrame, values: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, x, y, value): the last value of a lab id that isn't null, the first coordinates of a point."""
    last = values.where("value is not null").groupBy("lab_id").agg(F.max_by("value", "row_no").alias("value"))
    first = points.groupBy("point_id").agg(F.min_by(F.struct("x", "y"), "row_no").alias("at"))
    return pairs.join(last, "lab_id").join(first, "point_id").select("point_id", "at.x", "at.y", "value")
