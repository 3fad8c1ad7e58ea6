"""Exact de-duplication by content hash, in DataFrame functions only.

Texts are equal when identical after each run of ASCII white space becomes one
space. Rows are grouped by a 128-bit hash of that form together with its bytes:
the hash decides where a row goes and the bytes are compared inside, so that
texts whose hashes collide stay apart. Spark combines rows before the shuffle,
so a text copied into a third of all rows leaves each map task once. What
returns to the rows is small: hash, SHA-256, smallest id and count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The compared form of a text; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    The smallest id of a group stays. Rows that repeat both id and text share
    one fate (``kept`` is true on each if the id is the group's smallest). Null
    text is the empty text, which is equal to itself only (a text of white
    space is one space). A null id is larger than any id; a group of nothing
    but null ids keeps them all. Other columns are not looked at.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    groups = (
        rows.withColumn("_hash", F.md5("_norm"))
        .groupBy("_hash", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")
    )
    # repeated texts only: the others need no lookup and don't travel again
    groups = groups.where("group_size > 1")
    light = rows.select("_id", F.md5("_norm").alias("_hash"), F.sha2("_norm", 256).alias("_sha"))
    found = light.join(groups, ["_hash", "_sha"], "left")
    lone = F.col("group_size").isNull()
    keep = F.when(lone, F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, and of equal texts only the row with the smallest id.

    Null text is the empty text. Null ids go last; of rows that share text and
    smallest id, or have nothing but null ids, one stays, the choice being made
    by a hash of their other columns. Groups are formed as in ``exact_groups``,
    and the row that stays is itself what the aggregation keeps, so a text
    crosses the network once, and a text of very many copies once a task.
    """
    rest = [c for c in docs.columns if c != text_col]
    norm = normalised(docs[text_col])
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)], F.when(~docs[text_col].eqNullSafe(norm), docs[text_col]).alias("text"), docs[text_col].isNull().alias("none"))
    hashed = [docs[f.name] for f in docs.schema if f.name != text_col and "map<" not in f.dataType.simpleString()]
    first = F.struct(docs[id_col].isNull().alias("a"), docs[id_col].alias("b"), F.xxhash64(F.lit(0), *hashed).alias("c"))
    kept = (
        docs.select(norm.alias("norm"), row.alias("row"), first.alias("first"))
        .withColumn("hash", F.md5("norm"))
        .groupBy("hash", "norm")
        .agg(F.min_by("row", "first").alias("row"))
    )
    text = F.when(~F.col("row.none"), F.coalesce("row.text", "norm"))
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {text_col: text}
    return kept.select(*[at[c].alias(c) for c in docs.columns])
