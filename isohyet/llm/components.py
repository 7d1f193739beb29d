"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import store


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"] or 0


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): each linked id with the smallest id reachable (id, component). No links give no rows.

    Each step is one aggregate and one join against its stored result, which Spark splits where an id has very
    many links; the number of steps grows with the logarithm of the longest chain. Nothing is collected.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store(edges, "edges")
    before = (-1, -1)
    while (now := _mark(edges)) != before and now[0]:
        before = now
        # Every id hands its smallest neighbour to its larger neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large, "edges")
        # Every id hands its smallest neighbour to its smaller neighbours, and links to it.
        least = store(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = store(small, "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
