"""Connected components of an edge table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.session import durable, shared_folder  # noqa: F401


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the
    number of rounds grows with the logarithm of the longest path. A round is
    two partial-aggregated minima and two joins; nothing is gathered per node,
    so a node with very many neighbours is only a large join key, which
    adaptive execution splits. Loops and repeated edges are allowed; an empty
    table gives an empty one.
    """
    e = durable(edges.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        # large star: neighbours above a node move to its smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
