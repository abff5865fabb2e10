"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.sources.storage import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """
    (node, component) for every node of a link, where component is the smallest node it reaches.

    Each round hangs all neighbours of a node onto the smallest of them (once among the larger ones, once among the smaller
    ones), until every group is a star around its smallest node. The number of rounds grows with the logarithm of the longest
    chain. A round is a minimum per node and a join, both by Spark, written to the shared folder: nothing comes to the
    driver but one row of counts, and a lost executor costs one round. Links with a null end and links of a node to itself
    are left out; an empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    pairs = links.where(x.isNotNull() & y.isNotNull() & (x != y))
    edges = stored(pairs.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "links")
    while not _stars(edges):
        edges = stored(_to_smaller(_to_larger(edges)), "links")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """True if every node hangs on one other at most, and that one on none."""
    counts = edges.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("hung")).first()
    if counts["n"] != counts["hung"]:
        return False
    return edges.select(F.col("lo").alias("node")).distinct().join(edges, F.col("node") == F.col("hi"), "left_semi").isEmpty()


def _to_larger(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on its smallest neighbour, or on itself if that is smaller."""
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("least"))
    hung = edges.join(least, F.col("lo") == F.col("node"))
    return hung.select("hi", F.col("least").alias("lo")).distinct()


def _to_smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of these."""
    least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    among = edges.join(least, F.col("hi") == F.col("node")).where(F.col("lo") != F.col("least"))
    return (
        among.select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        .unionByName(least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        .distinct()
    )
