"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import cut

#: Edges of one task: a round on fewer needs no shuffle.
TASK_EDGES = 200_000


def in_tasks(df: DataFrame) -> DataFrame:
    """`df`, which is cut and of small rows, in as many partitions as it needs: one of few rows is joined without a shuffle."""
    return df.coalesce(max(1, -(-df.count() // TASK_EDGES)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Each round links every neighbour of a node to the smallest one it knows; the number
    of rounds grows with the logarithm of a component's size. Only two numbers a round
    reach the driver. Partitions are as many as the edges need, TASK_EDGES in each, where shuffles
    would have more. Null ends and loops are no edges; no edges give no rows.
    """
    pairs = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, seen = cut(pairs), None
    edges_n = pairs.count()
    while True:
        tasks = max(1, -(-edges_n // TASK_EDGES))
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, edges_n = now, now[0]
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
