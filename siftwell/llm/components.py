"""Connected components by alternating large-star and small-star steps; each round's edges are a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b. Links what surrounds a node to the least of it (itself included).

    A node's neighbours are never gathered: the least comes from a partial aggregation, and a join hands it out.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:  # both ends of an edge: its greater end gets the least of the lesser end's surroundings
        moved = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    else:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b (bigint). Gives node and component (its least node) for every node of an edge."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        n, s = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if not n or mark == (n, s):
            break
        mark = (n, s)
        wide = materialise(star(now, True), "edges")
        after = materialise(star(wide, False), "edges")
        forget(now, wide)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
