"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.scratch import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the larger ones; small: the smaller ones and itself) to the least of them.

    A hub's links are sorted by Spark in one task, on disk if need be.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    out = edges.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select("b", "m").union(out.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of all nodes with a link; ``edges`` has (a, b) of long. A component is its least node.

    Every round is written to the shared folder, so plans stay short and a
    lost executor costs one round at most; the round before is deleted.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    while True:
        here = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # Done when all are stars: no node has a lesser neighbour and is one itself, and none has two.
        ends = here.select("a", F.lit(1).alias("k"), F.lit(0).alias("low")).unionAll(here.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("k").alias("k"), F.max("low").alias("low")).where("k > 1 or (k > 0 and low > 0)").isEmpty():
            break
        before, now = now, written(_star(_star(here, True), False), tag)
        dropped(before)
    stars = here.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(here.select("b", "b")).distinct()
