"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least node among them and itself.

    Large: only its larger neighbours move. Small: it and its smaller neighbours move. The least
    neighbour is found by a grouped minimum, with a partial one in each task, so a node with very
    many links is no burden to one task; the join's hot keys are split by Spark.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    if large:
        moved = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        moved = near.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        moved = moved.union(least.select("a", F.col("root").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the least node of its component.

    The number of rounds grows with the logarithm of the longest chain. Each round's links are
    written to the shared scratch folder, so a lost executor costs a re-read and not all rounds.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = written(_star(_star(now, True), False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
