"""Sinks. Each refuses to write over what is there, and commits as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import hex_bucket
from gaugeworks.operators.relations import compare


def sorted_parquet(df: DataFrame, path: str, *order: str) -> None:
    """Zstd Parquet, ordered over all files (ranges) and within each."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)


def by_bucket(df: DataFrame, path: str, key: str) -> None:
    """A directory per two hex digits of the key's SHA-256; rows meet by bucket first, so a bucket has few files."""
    df.withColumn("bucket", hex_bucket(key)).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def bucketed(df: DataFrame, name: str, path: str, device: str, order: str, buckets: int) -> DataFrame:
    """A catalogued table at ``path`` whose devices lie whole in one of ``buckets`` files, in order: windows by device and joins with a table of as many buckets read it without an exchange."""
    (
        df.repartition(buckets, device).sortWithinPartitions(device, order).write.mode("errorifexists")
        .bucketBy(buckets, device).sortBy(device, order).option("compression", "zstd").option("path", path).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def accepted_and_quarantined(marked: DataFrame, path: str, reason: str = "reason") -> None:
    """One pass, two sides: rows with a reason under accepted=false."""
    marked.withColumn("accepted", F.col(reason).isNull()).write.partitionBy("accepted").option("compression", "zstd").parquet(path)


def windows_by_split(df: DataFrame, path: str, per_file: int = 2048) -> None:
    df.write.partitionBy("split").option("maxRecordsPerFile", per_file).option("compression", "zstd").parquet(path)


def shards(df: DataFrame, path: str, per_file: int = 2048, order: str = "task_id") -> None:
    """Files of ``per_file`` windows at most, per split, in row groups of about 1,024 (a window takes some 8 KB)."""
    df.repartition("split", F.col(order)).sortWithinPartitions("split", order).write.partitionBy("split").option("maxRecordsPerFile", per_file).option("parquet.block.size", 1024 * 8192).option("compression", "zstd").parquet(path)


def publish_json(spark, value: object, path: str) -> None:
    """One small JSON document, written beside its place and renamed, so that a reader sees it whole or not at all; what is there is kept."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode() + b"\n"))
    out.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def save_runs(df: DataFrame, path: str, demo_ids: DataFrame | None = None) -> None:
    """Appends telemetry runs under their device; a run needs components, and devices of the demo fleet (``demo_ids``, a column ``id``) are refused.

    The checks are part of the write: a run that fails one ends it, and nothing is committed.
    """
    device = F.regexp_replace(F.coalesce("machine.id", "machine.hostname", F.lit("unknown")), "[^a-zA-Z0-9_-]", "-")
    rows = df.withColumn("device", device)
    if demo_ids is not None:
        rows = rows.join(demo_ids.select(F.col("id").alias("device"), F.lit(True).alias("_demo")).distinct(), "device", "left")
    else:
        rows = rows.withColumn("_demo", F.lit(None).cast("boolean"))
    empty = F.coalesce(F.size("components") <= 0, F.lit(True))
    fault = F.when(empty, F.raise_error(F.lit("a run without components"))).when(F.col("_demo"), F.raise_error(F.lit("a run of the demo fleet"))).otherwise(F.col("device"))
    machine = F.col("machine").withField("id", F.col("device")).withField("site", F.coalesce("machine.site", F.lit("local"))).withField("rack", F.coalesce("machine.rack", F.lit("bench")))
    rows.withColumn("machine", machine).withColumn("device", fault.cast("string")).select(*df.columns, "device").write.mode("append").partitionBy("device").json(path)


def verify(written: DataFrame, source: DataFrame, keys: list[str] | None = None) -> None:
    """Raises unless both hold the same rows, with multiplicity; with ``keys`` the error names records, fields and both values."""
    found = compare(written, source.select(*written.columns), keys or written.columns).limit(5).collect()
    if found:
        raise ValueError("what was written differs from its source: " + "; ".join(str(r.asDict()) for r in found))


def dataset(path: str, records: DataFrame, specs: DataFrame, observations: DataFrame, annotations: DataFrame, tasks: DataFrame) -> None:
    """The five normalized tables of a dataset: long observations instead of nested series."""
    for name, df in (("records", records), ("channel_spec", specs), ("observations", observations), ("annotations", annotations), ("tasks", tasks)):
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")


def read_dataset(spark, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("records", "channel_spec", "observations", "annotations", "tasks")}
