"""Connected components of a graph given as a table of edges, without any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import removed, saved, spread_join


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a bigint, b bigint); root is the smallest node of the component.

    Alternating star contraction: each round links every node to the smallest of its neighbourhood, first from the larger side, then from the smaller,
    until the edges are stars: each node has one edge to a smaller one, or none and only edges from larger ones. Rounds grow with the logarithm of the
    longest path. Nodes with very many edges are joined by a bounded broadcast. Each stage and each scan of files costs the driver a few MB for a moment,
    however small the table, so a round has as few as it can.
    """
    spark = edges.sparkSession
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = _both(now, ("a", "b"), ("b", "a"))
        up = F.count_if(F.col("b") < F.col("a")).alias("up")
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.count(F.lit(1)).alias("n"), up), "nodes")
        more, nodes, largest, ends = least.agg(F.count_if(F.expr("up > 1 or up > 0 and most > a")), F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
        if not more:
            removed(spark, now)
            return least.select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        # Edges go from the larger node to the smaller.
        upper = spread_join(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least.select("a", F.least("a", "m").alias("m"), "n"), ["a"], "n", ends, (nodes, largest))
        large = saved(upper.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        # There are no more nodes than before.
        kept = [] if nodes <= common.HOT else [saved(low, "nodes")]
        lower = spread_join(large, *(kept or [low]), ["a"], "n", size=None if kept else (nodes, largest))
        then = saved(_both(lower, ("b", "m"), ("a", "m")).filter("a <> b").distinct(), "edges")
        removed(spark, now, least, large, *kept)
        now = then


def _both(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Edges (a, b) from each row's pairs of columns, in one pass."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("e")).select("e.a", "e.b")
