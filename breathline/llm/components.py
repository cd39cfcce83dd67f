"""Connected components of a distributed list of links.

Alternating large-star and small-star steps: every step points neighbours at the
smallest one they share, until each component is a star around its smallest node.
Only links that exist are held; every round is written to the shared folder.
Nodes that hold many of all links are split off, so no task gets a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, has_hot, materialise, with_hot


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, from links (a, b); roots included."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, path = materialise(edges, "links")
    before = _state(edges)
    while before[0]:
        both, written = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), []
        total = 2 * before[0]
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Large star: larger neighbours point to the smallest one. A node gets no more of these links than it has now.
        hubs = has_hot(least, "n", total)
        least = _written(least, hubs, written)
        large = (with_hot(both, least, "u", "n", total) if hubs else both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _written(large, hubs, written)
        least = _written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), hubs, written)
        small = with_hot(large, least, "u", "n", total) if hubs else large.join(least, "u")
        pointed = least.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges, new_path = materialise(pointed, "links")
        after = _state(edges)
        discard(spark, path, *written)
        path = new_path
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(df: DataFrame, wanted: bool, paths: list[str]) -> DataFrame:
    """The table itself, or written where its readers are many."""
    if not wanted:
        return df
    df, path = materialise(df, "star")
    paths.append(path)
    return df


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes; equal states are equal sets."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
