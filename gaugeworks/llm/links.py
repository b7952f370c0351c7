"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Links up to which a round stays in one task: fewer are not worth a shuffle.
FEW = 1 << 18


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node that each node of ``links`` (a, b) reaches.

    Alternates the large-star and small-star steps: the former ties every larger
    neighbour of a node to its least one, the latter every smaller one, until the
    links are stars. Each round is written to the shared folder. A node's
    neighbours are aggregated and joined, never gathered, whatever their number.
    Once no more than FEW links are left, a round takes one task and no shuffle.
    """
    now = scratch.save(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last, round_ = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == last or not state.n:
            break
        last, round_ = (state.n, state.h), round_ + 1
        now = now.coalesce(1) if state.n <= FEW else now
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.save(small, f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
