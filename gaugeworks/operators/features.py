"""Model inputs from windows: an allowlist, so that no identity or outcome can pass."""

from __future__ import annotations

import json
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import pattern, stable_id, trend_code, zscore
from gaugeworks.spec import PATTERNS, Study

INPUT_FIELDS = ("pre_prompt", "time_series_text", "time_series", "post_prompt")
POST_PROMPT = "Answer with one 'channel: pattern' entry per supplied channel, separated by semicolons. Answer:"


def with_texts(windows: DataFrame, study: Study) -> DataFrame:
    """Adds ``_text``: for each channel its name, description, cadence and deviation, the last with eight significant digits and no trailing zeros (C's %.8g, which Java's keeps the zeros of).

    A plan node of its own, as a Python function can't take what a lambda made.
    """
    described, cadence = {c.name: c.description for c in study.channels}, study.cadence_text
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema), "_text array<string>"])

    def run(batches):
        for batch in batches:
            texts = []
            for names, rows in zip(batch.column("channels").to_pylist(), batch.column("values").to_pylist(), strict=True):
                texts.append([f"{c}; {described[c]}; {cadence}; original standard deviation: {np.std(v, ddof=1):.8g}." for c, v in zip(names, rows, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.string()))], [*batch.schema.names, "_text"])

    return windows.mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def canonical_hash(values: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys, from any JSON text."""
    return values.map(lambda v: None if v is None else sha256(json.dumps(json.loads(v), sort_keys=True).encode()).hexdigest())


def channel_codes(study: Study, channels: Column | str = "channels", values: Column | str = "values") -> Column:
    """The pattern code of each channel of a window row, under the study's bands and counters."""
    bands = F.create_map(*[F.lit(x) for c in study.channels for x in (c.name, c.minimum_band)])
    counters = F.create_map(*[F.lit(x) for c in study.channels for x in (c.name, c.counter)])
    return F.zip_with(channels, values, lambda c, v: trend_code(v, F.element_at(bands, c), F.element_at(counters, c)))


def answer_text(channels: Column | str, codes: Column) -> Column:
    return F.concat(F.array_join(F.zip_with(channels, codes, lambda c, k: F.concat(c, F.lit(": "), pattern(k))), "; "), F.lit("."))


def complete_channels(values: Column | str = "values") -> Column:
    """Which channels have finite numbers alone."""
    return F.transform(values, lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def labelled(windows: DataFrame, study: Study, version: str) -> DataFrame:
    """Window rows (device, times_us, channels, values) with incomplete channels dropped, two or more left, and task_id and target."""
    keep = windows.withColumn("_ok", complete_channels())
    pick = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("v"), F.col("_ok").alias("ok")), lambda z: z["ok"]), lambda z: z["v"])
    rows = keep.withColumn("_c", pick("channels")).withColumn("_v", pick("values")).withColumn("channels", F.col("_c")).withColumn("values", F.col("_v")).where(F.size("channels") >= 2)
    task = stable_id(F.lit(version), F.lit(study.name), "device", F.get("times_us", F.lit(0)), F.element_at("times_us", -1))
    return rows.withColumn("task_id", task).withColumn("target", answer_text("channels", channel_codes(study))).drop("_ok", "_c", "_v")


def examples(windows: DataFrame, study: Study) -> DataFrame:
    """(inputs, target, audit): inputs hold the four allowed fields only."""
    pre = f"Describe each {study.name} signal over the entire observed 28-sample window. Use only these patterns: " + "; ".join(PATTERNS) + "."
    rows = with_texts(windows, study)
    inputs = F.struct(F.lit(pre).alias("pre_prompt"), F.col("_text").alias("time_series_text"), F.transform("values", zscore).alias("time_series"), F.lit(POST_PROMPT).alias("post_prompt"))
    audit = [c for c in ("task_id", "device", "group_id", "start", "cutoff") if c in windows.columns]
    return rows.select(inputs.alias("inputs"), "target", F.struct(*audit).alias("audit"))


def check_inputs(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows of channel inputs that break the contract: unknown, repeated or too few channels, or values that aren't finite."""
    good = (
        (F.size("channels") >= 2) & (F.size(F.array_distinct("channels")) == F.size("channels")) & (F.size(F.array_except("channels", F.array(*map(F.lit, allowed)))) == 0)
        & F.forall(complete_channels(), lambda ok: ok)
    )
    return rows.where(~F.coalesce(good, F.lit(False)))
