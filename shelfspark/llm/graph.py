"""Connected components by repeated joins, for graphs whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and the exclusive or of their hashes, which cannot overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """c and m, the least v of each u. Written out, so that a join on it reads two plain shuffles, of which Spark splits a hub's."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"), "least")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """The large-star or the small-star step of edges(u, v), u > v."""
    pairs = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = _least(pairs)
    met = pairs.join(least, pairs["u"] == least["c"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v), component being its least node.

    Alternates the large-star and small-star steps: each node links its larger (smaller) neighbours to its least one,
    until only stars are left; that takes about log^2 of the longest chain rounds. Every step is an aggregate and a join
    on the edges, written out before the next, so nothing but two numbers a round reaches the driver; what a round has
    read is deleted. Loops are ignored and an empty table gives an empty result.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (now := _fingerprint(edges)) != before:
        before, last = now, edges
        edges = settled(spark, lambda: _star(materialize(_star(last, True), "edges"), False), "edges")  # noqa: B023  called at once
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
