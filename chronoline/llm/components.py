"""Connected components over an edge table by alternating stars, each round settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronoline.session import settle


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node are linked to the smallest of the node and them.

    ``large`` moves the larger neighbours, else the node itself and its smaller neighbours. The
    smallest neighbour is an aggregate that is combined before the shuffle and joined back, so a
    hub's neighbours are never gathered in one place.
    """
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node it is joined with.

    ``edges`` has long columns a and b; loops and repeated edges are harmless. Rounds go on until
    a round changes nothing, about the logarithm of the longest chain; each is written to the
    shared folder, so a lost executor costs one round.
    """
    edges = settle(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    state = None
    while True:
        edges = settle(_round(_round(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).union(
        edges.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("root"))
    ).distinct()
