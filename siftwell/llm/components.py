"""Connected components by alternating stars, all in DataFrame joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("m").alias("a"), "b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b long) that isn't the least of its component, that least node.

    Each round is written in the shared folder, so that plans stay short and a lost executor repeats one round at
    most; only a count and a checksum reach the driver. Rounds are about the logarithm of the longest chain. Links
    of a node to itself, repeated links and an empty table are allowed; a link with a null end is no link.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    edges = written(edges, "links")
    sign = _sign(edges)
    while sign[0]:
        edges = written(_small_star(_large_star(edges)), "stars")
        last, sign = sign, _sign(edges)
        if last == sign:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
