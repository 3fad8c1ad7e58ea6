"""The bulletins' tables: the text form, ranges that must follow each other, totals that must add up."""

import pytest
from pyspark.sql import functions as F

from pedon.functions import tables
from pedon.operators import lookup
from pedon.sources import bulletins

TEXT = """
# a remark
| no | table |
@ x | crop | stage | kg/ha

| yield | n | p2o5:p 0-6 7-15 >15 | k2o low high |
| <2,5 | 10-20 | 1.200 30,5 - | 7 |
| 2,6-4 | 5? | 1 2 3 4 | 8 9 |
| broken |
"""


@pytest.fixture(scope="module")
def package(spark):
    return bulletins.pipe_tables(bulletins.packaged(spark)).cache()


def parsed(spark, *texts):
    return bulletins.pipe_tables(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source string, text string"))


def test_cells_levels_and_ranges(spark):
    rows = parsed(spark, TEXT).orderBy("row_no", "nutrient", "level_no").collect()
    by = {(r.row, r.nutrient, r.level_no): r for r in rows}
    assert len(rows) == 12 and {r.bulletin for r in rows} == {"x"} and {r.by for r in rows} == {"yield"}
    n = by["<2,5", "n", 1]
    assert (n.value_lo, n.value_hi, n.level, n.row_lo, n.row_hi) == (10, 20, None, None, 2.5)
    p = [by["<2,5", "p2o5", i] for i in (1, 2, 3)]
    assert [(r.level_lo, r.level_hi, r.value_lo) for r in p] == [(0, 6, 1200), (7, 15, 30.5), (15, None, None)] and {r.measure for r in p} == {"p"}
    assert [by["<2,5", "k2o", i].value_lo for i in (1, 2)] == [7, 7] and [by["2,6-4", "k2o", i].level for i in (1, 2)] == ["low", "high"]
    assert by["2,6-4", "n", 1].doubt and not by["<2,5", "n", 1].doubt
    # another number of values than levels
    assert all(by["2,6-4", "p2o5", i].value_lo is None and by["2,6-4", "p2o5", i].doubt for i in (1, 2, 3))


def test_odd_files(spark):
    assert parsed(spark, "", "\n\n", "@ a | b\n| x | y |\n| 1 | 2 |", "| x | y |\n| 1 | 2 |").count() == 0
    assert parsed(spark, None).count() == 0
    two = parsed(spark, "@ a | b | c | d\r\n| x | y |\r\n| 1 | 2 |", "@ e | f | g | h\n| x | y |\n| 3 | 4 |").collect()
    assert {(r.source, r.crop, r.value_lo) for r in two} == {("f0", "b", 2), ("f1", "f", 4)}


def test_files_of_a_folder(spark, tmp_path):
    for name, crop in (("a.txt", "uva"), ("b.txt", "figo")):
        (tmp_path / name).write_text(f"@ x | {crop} | s | u\n| at | n |\n| t | 1 |\n", "utf-8")
    got = bulletins.pipe_tables(bulletins.texts(spark, str(tmp_path))).collect()
    assert {r.crop for r in got} == {"uva", "figo"} and len({r.source for r in got}) == 2


@pytest.mark.parametrize(("levels", "fault"), [("0-6 7-15 >15", None), ("0-6 6-15", None), ("0-6 8-15", "gap"), ("0-6 5-15", "overlap"), ("0-0,7 0,8-1,5", None), ("0-0,7 0,9-1,5", "gap"), ("0-6 16-3", "reversed")])
def test_ranges_follow_each_other(spark, levels, fault):
    got = [r.fault for r in bulletins.range_faults(parsed(spark, f"@ a | b | c | d\n| x | y:p {levels} |\n| z | 1 |")).collect()]
    assert got == ([fault] if fault else [])


def test_rows_follow_each_other(spark):
    got = bulletins.range_faults(parsed(spark, "@ a | b | c | d\n| x | y |\n| <2 | 1 |\n| 2-4 | 1 |\n| 5-6 | 1 |\n| 8-9 | 1 |")).collect()
    assert [(r.of, r.lo, r.fault) for r in got] == [("row", 8.0, "gap")]


def test_package_has_its_tables_and_only_the_printed_faults(package):
    assert package.select("source", "table_no").distinct().count() == 187
    faults = {(r.crop, r.nutrient, r.lo, r.hi, r.fault) for r in bulletins.range_faults(package).collect()}
    assert faults == {("girassol", "k2o", 16.0, 3.0, "reversed"), ("soja", "k2o", 16.0, 3.0, "reversed")}
    # the doses that the source leaves out, and none through a cell that doesn't fit its header
    assert package.where("value_lo IS NULL AND value_hi IS NULL AND doubt").count() == 0


def test_dated_doses_add_up_to_every_total(spark, package):
    split = tables.split_doses(bulletins.joined(package))
    assert split.select("crop", "stage").distinct().count() == 79
    assert lookup.total_mismatches(split, ["crop", "stage", "nutrient", "level"]).count() == 0
    wrong = split.withColumn("dose", F.when((F.col("crop") == "uva") & (F.col("at") == "Total"), F.col("dose") + 1).otherwise(F.col("dose")))
    assert {r.crop for r in lookup.total_mismatches(wrong, ["crop", "stage", "nutrient", "level"]).collect()} == {"uva"}


def test_closed_ranges_leave_no_value_out(spark, package):
    at = spark.createDataFrame([("soja", "semeadura", g, p) for g, p in ((0.1, 0.0), (1.95, 6.5), (3.0, 40.0), (9.9, 999.0))] + [("soja", "semeadura", None, 1.0), ("unknown", "semeadura", 1.0, 1.0)], "crop string, stage string, goal double, p double")
    doses = bulletins.joined(package).where("bulletin = 'sp'")
    got = {(r.goal, r.p): r.d for r in lookup.prescribe(at, doses, "p2o5", "d", row_range="goal", level_range="p").collect()}
    assert got == {(0.1, 0.0): 50, (1.95, 6.5): 50, (3.0, 40.0): 50, (9.9, 999.0): 40, (None, 1.0): None, (1.0, 1.0): None}


def test_leaf_tables(package):
    leaf = tables.leaf_contents(bulletins.joined(package))
    got = {(r.bulletin, r.crop, r.nutrient): (r.lo, r.hi) for r in leaf.collect()}
    assert got["sp", "alfafa", "n"] == (34, 56) and got["mg", "banana", "k"] == (2.8, 2.8) and ("mg", "abacate", "mo") not in got
    assert len({(b, c) for b, c, _ in got}) == 44
