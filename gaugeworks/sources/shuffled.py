"""Reading stored rows in a seeded order of files, row groups and rows, with a cursor to go on from.

A cursor names a file, a group of rows in it and a batch in that, each by its place in
the seeded order. What lies before it isn't read: earlier files are not opened, and of the
cursor's own file no more than the groups from the cursor on are dealt and sorted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_ROWS = 131_072


class Cursor(NamedTuple):
    file: int = 0
    group: int = 0
    batch: int = 0


class ShuffledTable:
    """The Parquet files below ``path``, each one's rows in groups of ``group_rows``, in the order of ``seed``."""

    def __init__(self, spark: SparkSession, path: str, seed: int, batch_rows: int, group_rows: int = GROUP_ROWS):
        self.spark, self.seed, self.batch_rows, self.group_rows = spark, seed, batch_rows, group_rows
        whole = spark.read.parquet(path)
        self.schema = whole.schema
        names = spark.createDataFrame([(f,) for f in whole.inputFiles()], "path string")
        # the listing is the driver's already; a name counts from its table on, so that a table may move
        tail = F.substring_index("path", "/", -2)
        self.files = [r.path for r in names.orderBy(F.sha2(F.concat(F.lit(f"{seed}/"), tail), 256), "path").collect()]

    def read(self, cursor: Cursor = Cursor()) -> DataFrame:
        """All rows from ``cursor`` on, with ``file``, ``group``, ``batch`` and ``at``; in this order within each group, groups dealt to tasks whole."""
        files = self.files[cursor.file :]
        if not files:
            return self.spark.createDataFrame([], self.schema).select("*", *(F.lit(0).alias(c) for c in ("file", "group", "batch", "at")))
        known = self.spark.createDataFrame([(f, i + cursor.file) for i, f in enumerate(files)], "_path string, file int")
        rows = self.spark.read.schema(self.schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
        number = F.floor(F.col("_row") / self.group_rows).cast("int")
        hashed = lambda *c: F.sha2(F.concat_ws("/", F.lit(str(self.seed)), *c), 256)
        plain = F.regexp_replace("_path", "^[a-z0-9]+:/+", "/")  # a listing and a row's metadata write a file's scheme in two ways
        placed = rows.withColumn("_path", plain).join(known.withColumn("_path", plain), "_path").withColumn("_number", number).drop("_path")
        # the place of a group among those of its file: groups are few, a row each
        groups = placed.groupBy("file", "_name", "_number").agg(F.count(F.lit(1)).alias("_n"))
        order = F.row_number().over(Window.partitionBy("file").orderBy(hashed("_name", F.col("_number").cast("string")))) - 1
        groups = groups.withColumn("group", order).where((F.col("file") > cursor.file) | (F.col("group") >= cursor.group)).select("file", "_number", "group")
        kept = placed.join(groups, ["file", "_number"])
        within = Window.partitionBy("file", "group").orderBy(hashed("_name", F.col("_row").cast("string")))
        place = F.row_number().over(within) - 1
        out = kept.withColumn("_place", place).withColumns({"batch": F.floor(F.col("_place") / self.batch_rows).cast("int"), "at": (F.col("_place") % self.batch_rows).cast("int")})
        begun = (F.col("file") > cursor.file) | (F.col("group") > cursor.group) | (F.col("batch") >= cursor.batch)
        return out.where(begun).drop("_name", "_row", "_number", "_place")
