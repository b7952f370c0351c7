"""Large cells compared block against block, each two blocks in a group of their own."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and payload bytes of a block.
ROWS, BYTES = 512, 8 << 20


def deal(rows: DataFrame, cell: list[str], columns: list[str], most: int = ROWS) -> DataFrame:
    """``rows`` (cell, id, label, size, columns) once for each two blocks of its cell that a row is to meet in: with x and y, the blocks, side and inside.

    ``size`` is what a row's payload will have in bytes; the payload itself comes
    after this, so that it is shuffled once. A label that fills blocks has blocks
    of its own, and those don't meet each other: what one label ties together
    needs no check. ``most`` rows are a block.
    """
    few = ["id", "label", *columns]
    sizes = rows.groupBy(*cell, "label").agg(F.count(F.lit(1)).alias("of_label"))
    many = rows.join(sizes, [*cell, "label"]).withColumn("own", F.col("of_label") >= most).withColumn("of", F.when(F.col("own"), F.col("label")).otherwise(0)).drop("of_label")
    parts = many.groupBy(*cell, "own", "of").agg(F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("size") / BYTES)).alias("parts"))
    many = many.join(parts, [*cell, "own", "of"]).select(*cell, *few, F.struct("own", "of", F.pmod(F.xxhash64("id"), "parts").alias("salt")).alias("x"))
    blocks = many.groupBy(*cell, "x").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = blocks.select(*cell, F.col("x").alias("y"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    alike = (F.col("low") == F.col("high")) & (F.col("low_2") == F.col("high_2")) & (F.col("low") == F.col("low_2"))
    twos = blocks.join(other, cell).where((F.col("x") <= F.col("y")) & ~alike).drop("low", "high", "low_2", "high_2")
    left = many.join(twos, [*cell, "x"]).select(*cell, "x", "y", *few, F.lit(0).alias("side"), (F.col("x") == F.col("y")).alias("inside"))
    right = many.withColumnRenamed("x", "y").join(twos.where("x < y"), [*cell, "y"]).select(*cell, "x", "y", *few, F.lit(1).alias("side"), F.lit(False).alias("inside"))
    # two blocks of one cell are one number
    return left.unionByName(right).withColumn("meeting", F.xxhash64(*cell, "x", "y")).drop("x", "y")


def meet(dealt: DataFrame, cell: list[str], compare: Callable[[pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """What ``compare`` gives for all two blocks that meet, and for each block inside. It takes the rows of both, ``side`` telling them apart, and whether they are one block."""
    return dealt.groupBy(*cell, "meeting").applyInArrow(lambda t: compare(t, t.column("inside")[0].as_py()), schema)
