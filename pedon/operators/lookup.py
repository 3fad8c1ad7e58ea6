"""Decision tables: equality on some columns, ranges on others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedon.functions.text import plain

#: Tables of at most so many rows and bytes (measured) are broadcast; larger ones are joined by their equality columns.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def _small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast where its size allows."""
    n, size = table.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in table.columns]))))).first()
    return F.broadcast(table) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else table


def decide(rows: DataFrame, table: DataFrame, equal: list[str], ranges: dict[str, tuple[str, str]], closed_left: bool = False) -> DataFrame:
    """``rows`` with the columns of the table row that fits; a null bound is open. ranges: column of rows -> (lower, upper) columns of the table.

    A value belongs to the range whose upper bound it reaches (closed_left:
    whose lower bound). Rows without a fit keep null columns, and so do rows
    with a null in an equality column, or in a range column unless both bounds
    are open. Of the table's columns those that ``rows`` has already are left
    out. At least one equality column is needed, so that rows and table meet by
    key.
    """
    if not equal:
        raise ValueError("a table is joined by one equality column or more")
    t, r = _small(table).alias("_t"), rows.alias("_r")
    on: Column = F.lit(True)
    for c in equal:
        on &= F.col(f"_r.{c}") == F.col(f"_t.{c}")
    for c, (lo, hi) in ranges.items():
        x, a, b = F.col(f"_r.{c}"), F.col(f"_t.{lo}"), F.col(f"_t.{hi}")
        above, under = ((x >= a), (x < b)) if closed_left else ((x > a), (x <= b))
        on &= (a.isNull() | above) & (b.isNull() | under)
    drop = {*rows.columns, *equal, *(x for pair in ranges.values() for x in pair)}
    return r.join(t, on, "left").select("_r.*", *[F.col(f"_t.{c}") for c in table.columns if c not in drop])


def with_levels(doses: DataFrame, levels: list[str]) -> DataFrame:
    """``doses`` with each row that has no level repeated for each of ``levels``."""
    return doses.withColumn("level", F.explode(F.when(F.col("level").isNull(), F.array(*map(F.lit, levels))).otherwise(F.array("level"))))


def prescribe(rows: DataFrame, doses: DataFrame, nutrient: str, out: str, row: str | None = None, level: str | None = None, row_range: str | None = None, level_range: str | None = None) -> DataFrame:
    """``rows`` (crop, stage, ...) with the dose of a nutrient from a bulletin's relation (sources.bulletins.joined), as ``out`` and ``out``_hi.

    ``row`` and ``level`` are columns with the table's own names of its rows and
    levels, ``row_range`` and ``level_range`` columns with values that fall in
    their ranges. Rows whose crop, stage, name or value no table has, and doses
    that the bulletin leaves out, give null. Several fitting rows of one table
    would repeat a row: name or range must tell them apart.
    """
    t = doses.where(F.col("nutrient") == nutrient)
    names = {"row": row, "level": level}
    ranges = {c: (f"{k}_lo", f"{k}_hi") for k, c in (("row", row_range), ("level", level_range)) if c}
    kept = [F.col(k).alias(c) for k, c in names.items() if c] + [F.col(b) for pair in ranges.values() for b in pair]
    t = t.select("crop", "stage", *kept, F.col("value_lo").alias(out), F.col("value_hi").alias(f"{out}_hi"))
    return decide(rows, t, ["crop", "stage", *(c for c in names.values() if c)], ranges)


def total_mismatches(splits: DataFrame, keys: list[str], total: str = "Total") -> DataFrame:
    """(keys..., dose_sum, dose_total) where a table's dated doses (keys, at, dose) don't add up to its own total row; groups without one are left out."""
    sums = splits.groupBy(*keys).agg(F.sum(F.when(F.col("at") != total, F.col("dose")).otherwise(0.0)).alias("dose_sum"), F.max(F.when(F.col("at") == total, F.col("dose"))).alias("dose_total"))
    return sums.where(F.abs(F.col("dose_sum") - F.col("dose_total")) > 1e-9)


def _pieces(rows: DataFrame, column: str, longest: int = 3) -> DataFrame:
    """(column, piece): the distinct runs of one to ``longest`` signs of each text."""
    runs = [F.regexp_extract_all(F.col(column), F.lit(f"(?s)(?=({'.' * n}))"), 1) for n in range(1, longest + 1)]
    return rows.select(column, F.explode(F.array_distinct(F.concat(*runs))).alias("piece"))


def contained(texts: DataFrame, wholes: DataFrame, text_col: str, whole_col: str) -> DataFrame:
    """(text_col, whole_col): every pair of distinct texts of which the first occurs in the second, by an inverted index of pieces.

    A text occurs only where each of its pieces does, so it is looked up by one:
    of its runs of three signs (all of it, if shorter) the rarest among
    ``wholes``. Null and empty texts occur nowhere.
    """
    index = _pieces(wholes.select(whole_col).where(F.col(whole_col) != "").distinct(), whole_col)
    own = _pieces(texts.select(text_col).where(F.col(text_col) != "").distinct(), text_col).where(F.char_length("piece") == F.least(F.char_length(text_col), F.lit(3)))
    counted = own.join(index.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "piece", "left")
    rarest = counted.groupBy(text_col).agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0).cast("long")), "piece")).alias("piece"))
    return rarest.join(index, "piece").where(F.contains(whole_col, text_col)).select(text_col, whole_col)


def crop_parameters(samples: DataFrame, crops: DataFrame, crop_col: str = "crop") -> DataFrame:
    """``samples`` with the crop row of that name, else the first (by ``ord``) whose name contains it or is contained in it.

    Names are compared without accents and case. A null or blank crop fits
    none. Columns that ``samples`` has already are left out. Names meet by an
    inverted index, so neither side need be small.
    """
    fold = lambda c: F.lower(plain(F.trim(c)))
    named = crops.select(F.struct(*[F.col(f"`{c}`") for c in crops.columns]).alias("_row"), fold("name").alias("_name"))
    wanted = samples.select(fold(F.col(crop_col)).alias("_want")).where("_want <> ''").distinct()
    fits = contained(wanted, named, "_want", "_name").unionByName(contained(named, wanted, "_name", "_want")).distinct()
    best = fits.join(named, "_name").groupBy("_want").agg(F.min_by("_row", F.struct((F.col("_name") != F.col("_want")).alias("inexact"), F.col("_row.ord").alias("ord"))).alias("_crop"))
    kept = [F.col("_crop")[c].alias(c) for c in crops.columns if c not in samples.columns]
    return samples.withColumn("_key", fold(F.col(crop_col))).join(best, F.col("_key") == F.col("_want"), "left").select(*samples.columns, *kept)
