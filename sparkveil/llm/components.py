"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _starred(both: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Every (a, b) of `both` with `m`, the least of a and its neighbours, and the path of the minima. These are
    written first, so that the join meets two plain exchanges and a hub's rows can be split."""
    least, path = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
    return both.join(least, "a"), path


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the long pairs (u, v): one row (node, root) per node that has an edge; root is
    the smallest node of the component.

    Half rounds alternate until the edges stay as they are, which takes a number of rounds in the square of the
    logarithm of the nodes at most. Each writes its edges to the shared folder and deletes those before. No adjacency list is ever gathered: a hub
    only takes part in grouped minima and joins. Loops (u = v) and nulls are ignored, repeated and
    reversed pairs count once; no edges give no rows.
    """
    spark = edges.sparkSession
    edges, held = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        starred, first = _starred(both, "large-least")
        large, second = written(starred.where("b > a and b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        starred, third = _starred(large.select(F.col("u").alias("a"), F.col("v").alias("b")), "small-least")
        edges, new = written(
            starred.select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(),
            "small",
        )
        discard(spark, held, first, second, third)
        now, held = _signature(edges), new
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
