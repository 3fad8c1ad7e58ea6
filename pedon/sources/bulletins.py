"""Tables of bulletins as text: pipe tables with two-level headers and range cells become one long relation.

A table begins with a line "@ bulletin | crop | stage | unit", then comes a
header row and rows of cells between bars; lines that begin with "#" are
remarks. The first header cell says what the rows are (at, class, yield, ...),
each other one a nutrient, ":" and what is measured (if it is), and its levels:
names, or ranges of the measured content. A cell holds a value for each level,
or one for all; "-" is none, and "?" behind a value marks it as doubtful. Ranges
are "a-b", "<a" and ">a", numbers have decimal commas and thousands' points.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NUMBER = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
_RANGE = rf"^{_NUMBER}-{_NUMBER}\??$"


def number(x: Column) -> Column:
    """A number with decimal comma and thousands' points; null for anything else."""
    plain = F.regexp_extract(x, rf"^[<>]?{_NUMBER}\??$", 1)
    return F.when(plain != "", F.regexp_replace(F.regexp_replace(plain, r"\.", ""), ",", ".").cast("double"))


def bounds(x: Column) -> tuple[Column, Column]:
    """(lower, upper) of a range cell; a single number is both, an open side is null, and so are both for what is no range."""
    lo, hi = (number(F.regexp_extract(x, _RANGE, i)) for i in (1, 2))
    whole = number(x)
    return F.when(x.startswith("<"), None).otherwise(F.coalesce(lo, whole)), F.when(x.startswith(">"), None).otherwise(F.coalesce(hi, whole))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))


def _decimals(x: Column) -> Column:
    """Steps in which a cell's numbers are given: 1 for whole ones, 0.1 for one decimal, ..."""
    return F.pow(F.lit(10.0), -F.char_length(F.regexp_extract(x, r",(\d+)", 1)))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the files at ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def packaged(spark: SparkSession) -> DataFrame:
    """(source, text) of the bulletins that come with the package."""
    files = sorted((f for f in resources.files("pedon.data").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return spark.createDataFrame([(f.name, f.read_text("utf-8")) for f in files], "source string, text string")


def pipe_tables(files: DataFrame) -> DataFrame:
    """One row for each value of the tables in ``files`` (source, text): (source, table_no, bulletin, crop, stage, unit, row_no, by, row, row_lo, row_hi, nutrient, measure, level_no, level, level_lo, level_hi, value_lo, value_hi, doubt).

    ``level_lo`` and ``row_lo`` are the bounds as they are given; ``joined``
    closes them up. A cell with another number of values than its header has
    levels gives null values and doubt. Rows without a header or "@" line are
    left out. A file is read by one task.
    """
    lines = files.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).select("source", "line_no", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    order = Window.partitionBy("source").orderBy("line_no")
    cells = _cells(F.expr("trim(BOTH '|' FROM line)"))
    is_row = F.col("line").startswith("|")
    marked = lines.select("source", "line_no", "line", is_row.alias("is_row"), F.lag(is_row, 1, False).over(order).alias("after_row"))
    named = F.when(F.col("line").startswith("@"), _cells(F.substr("line", F.lit(2))))
    head = F.when(F.col("is_row") & ~F.col("after_row"), F.struct(F.col("line_no").alias("at"), cells.alias("cells")))
    placed = marked.select("source", "line_no", "is_row", "after_row", cells.alias("cells"), F.last(named, ignorenulls=True).over(order).alias("t"), F.last(head, ignorenulls=True).over(order).alias("h"))
    rows = placed.where("is_row AND after_row AND t IS NOT NULL AND size(t) = 4 AND size(cells) = size(h.cells)")
    each = rows.select("source", F.col("h.at").alias("table_no"), F.col("t").alias("t"), "line_no", F.col("h.cells")[0].alias("by"), F.col("cells")[0].alias("row"), F.posexplode(F.arrays_zip(F.slice("h.cells", 2, 1000).alias("head"), F.slice("cells", 2, 1000).alias("cell"))).alias("col_no", "c"))
    parts = each.withColumns({"parts": F.split("c.head", " +"), "values": F.split("c.cell", " +")}).withColumn("levels", F.when(F.size("parts") > 1, F.slice("parts", 2, 1000)).otherwise(F.array(F.lit(None).cast("string"))))
    n = F.size("levels")
    filled = F.when(F.size("values") == n, F.col("values")).when(F.size("values") == 1, F.array_repeat(F.col("values")[0], n)).otherwise(F.array_repeat(F.lit("?"), n))
    single = parts.select("*", F.posexplode(F.arrays_zip(F.col("levels").alias("level"), filled.alias("value"))).alias("level_no", "v"))
    (row_lo, row_hi), (level_lo, level_hi), (value_lo, value_hi) = bounds(F.col("row")), bounds(F.col("v.level")), bounds(F.col("v.value"))
    name = F.split(F.col("parts")[0], ":")
    return single.select(
        "source", "table_no", *(F.col("t")[i].alias(c) for i, c in enumerate(("bulletin", "crop", "stage", "unit"))),
        F.col("line_no").alias("row_no"), "by", "row", row_lo.alias("row_lo"), row_hi.alias("row_hi"), _decimals(F.col("row")).alias("row_step"),
        name[0].alias("nutrient"), F.get(name, F.lit(1)).alias("measure"), (F.col("level_no") + 1).alias("level_no"), F.col("v.level").alias("level"), level_lo.alias("level_lo"), level_hi.alias("level_hi"), _decimals(F.col("v.level")).alias("level_step"),
        value_lo.alias("value_lo"), value_hi.alias("value_hi"), (F.col("v.value").endswith("?") | F.coalesce(F.col("v.level").endswith("?"), F.lit(False))).alias("doubt"),
    )


def range_faults(tables: DataFrame) -> DataFrame:
    """(source, table_no, crop, stage, nutrient, of, lo, hi, before, fault) where the ranges of a row's levels, or of a table's rows, don't follow each other.

    fault: reversed (a lower bound above the upper), gap or overlap (the lower
    bound is more than one step of its own decimals above the upper bound
    before, or below it). ``of`` is level or row, ``before`` that upper bound.
    """
    key = ["source", "table_no", "crop", "stage", "nutrient"]
    level = tables.where("level_lo IS NOT NULL OR level_hi IS NOT NULL").select(*key, F.lit("level").alias("of"), F.col("level_no").alias("no"), F.col("level_lo").alias("lo"), F.col("level_hi").alias("hi"), F.col("level_step").alias("step")).distinct()
    row = tables.where("row_lo IS NOT NULL OR row_hi IS NOT NULL").select(*key, F.lit("row").alias("of"), F.col("row_no").alias("no"), F.col("row_lo").alias("lo"), F.col("row_hi").alias("hi"), F.col("row_step").alias("step")).distinct()
    before = F.lag("hi").over(Window.partitionBy(*key, "of").orderBy("no"))
    both = level.unionByName(row).withColumn("before", before)
    fault = F.when(F.col("lo") > F.col("hi"), "reversed").when(F.col("lo") < F.col("before"), "overlap").when(F.col("lo") - F.col("before") > F.col("step") + 1e-9, "gap")
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select(*key, "of", "lo", "hi", "before", "fault")


def joined(tables: DataFrame) -> DataFrame:
    """``tables`` with ranges closed up: each begins where the one before ends, the first is open below and the last above.

    A value that falls between two printed ranges so belongs to the upper one,
    and a misprinted lower bound does no harm. Bounds that stand alone stay null.
    """
    rows = Window.partitionBy("source", "table_no", "nutrient", "level_no").orderBy("row_no")
    levels = Window.partitionBy("source", "table_no", "row_no", "nutrient").orderBy("level_no")
    return tables.withColumns({"row_lo": F.lag("row_hi").over(rows), "level_lo": F.lag("level_hi").over(levels), "row_hi": F.when(F.lead("row_no").over(rows).isNotNull(), F.col("row_hi")), "level_hi": F.when(F.lead("level_no").over(levels).isNotNull(), F.col("level_hi"))}).drop("row_step", "level_step")
