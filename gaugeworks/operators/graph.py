"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import checkpoint_folder


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that each end of ``edges`` reaches.

    Every larger neighbour of a node is tied to its least one, then every smaller
    one, in turn, until nothing moves. A node's neighbours are aggregated and
    joined, never gathered, so a node may have any number of them; rounds grow
    with the logarithm of a component's width. Each round is checkpointed to the
    shared folder, and count and checksum of the ties tell when it is the last.
    """
    checkpoint_folder(edges.sparkSession)
    ties = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    last = None
    while (state := tuple(ties.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != last:
        last = state
        both = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        ties = down.where("u <> v").distinct().checkpoint()
    return ties.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(ties.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
