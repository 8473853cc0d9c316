"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import stored


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node has two lower neighbours, or both a lower and a higher one."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("low")),
                   F.struct(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("low")))
    nodes = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.ups").alias("ups"), F.max("end.low").alias("low"))
    return nodes.where("ups > 1 or ups = 1 and low = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round writes one table of at most as many edges as nodes and links; a node with
    very many neighbours is combined map-side, and its join is left to adaptive skew handling.  The
    end is looked for once the number of edges stays.  Edges with a null end are left out, loops and
    repeated edges change nothing.  Rounds grow at most with the square of the logarithm of the nodes;
    an error is raised after ``max_rounds``.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    current = stored(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star")
    before = None
    for _ in range(max_rounds):
        now = current.count()
        if now == before and _settled(current):
            break
        before = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "star")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
