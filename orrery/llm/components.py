"""Connected components of an edge table, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked with the smallest of the node and its neighbours;
    of (a, b) with a > b, once each."""
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(edges.select("b", F.least("a", "b")))
    least = ends.groupBy(F.col("id").alias("b")).agg(F.min("other").alias("low"))
    return edges.join(least, "b").select("a", F.col("low").alias("b")).distinct()


def small_stars(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours linked with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    more = edges.join(least.where("low < high").select("a", "low"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return least.select("a", F.col("low").alias("b")).unionAll(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of (a, b).

    Rounds turn neighbourhoods into stars around their smallest node: first each node with its
    smaller neighbours, then each node's larger ones.  A node with one smaller neighbour joins
    nothing in the first step, so a large group is one star after few rounds, and its
    edges are then one a node.  Rounds end where the edges no longer change; they are cut
    to the shared folder, and minima are formed before their shuffle.
    """
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(small_stars(cut(apart)))
    before = None
    while True:
        now = cut(small_stars(cut(stars(now))))
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
