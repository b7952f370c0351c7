"""Queries that run as streams: given tables arrive in files, out of order within a delay, and the result is what the stream wrote.

The SQL states the result of the whole table at once: a stream's windows and scores are those of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import scratch_folder
from gaugeworks.operators import fleet
from gaugeworks.streaming import fleet_state, jobs

from . import fleet_catalog
from .catalog import DAILY, daily, query

DELAY_DAYS, FILES = 3, 4
DAY_US = 86_400_000_000
END = "2100-01-01"  # a last row of no device, whose time lets all others be taken


def arriving(rows: DataFrame, by: str, at: str, folder: str, files: int = FILES, delay_days: int = DELAY_DAYS, **closing: Column) -> str:
    """Writes ``rows`` as files that arrive day after day, each row less than ``delay_days`` after its time, up to ``files`` a day; ``closing`` has columns of the last row.

    Files of a day hold rows of that day's arrival only, so that no row is late wherever a stream ends its batches.
    """
    spark, staged = rows.sparkSession, f"{folder}-staged"
    day = F.unix_date(F.to_date(at)) + F.pmod(F.xxhash64(by, at), F.lit(delay_days))
    marked = rows.withColumn("_day", day).where("_day IS NOT NULL")
    spread = F.pmod(F.xxhash64(by, at, F.lit("file")), F.lit(files))
    marked.repartition("_day", spread).write.partitionBy("_day").parquet(staged)  # once, whatever it takes to make the rows
    stored = spark.read.schema(marked.schema).parquet(staged)
    for d in sorted(r[0] for r in stored.select("_day").distinct().collect()):  # one after the other: a stream takes files by their time
        spark.read.schema(rows.schema).parquet(f"{staged}/_day={d}").write.mode("append").parquet(folder)
    end = spark.range(1).select(*(closing[c].cast(kind).alias(c) if c in closing else F.lit(END).cast("timestamp").alias(c) if c == at else F.lit("~").alias(c) if c == by else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes))
    end.write.mode("append").parquet(folder)
    return folder


def streamed(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The windows of the days of users, as a stream gives them out."""
    folder = scratch_folder(spark)
    rows = daily(spark, sf).select(F.col("user_id").cast("string").alias("device"), F.col("dt").cast("timestamp").alias("at"), F.col("v").alias("value"), (F.col("failure") == 1).alias("failed"))
    stream = jobs.follow(spark, arriving(rows, "device", "at", f"{folder}/in"), "device string, at timestamp, value double, failed boolean", files_per_trigger=8 * FILES)
    job = jobs.run(jobs.windows(stream, "at", f"{DELAY_DAYS} days", 7, DAY_US, **options), f"{folder}/out", f"{folder}/state")
    job.awaitTermination()
    return spark.read.schema("device string, kind string, t long, start long, values array<double>, batch int").parquet(f"{folder}/out")


def _cut(rows: DataFrame) -> DataFrame:
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4)
    day = lambda c: F.timestamp_micros(c).cast("date")
    return rows.where("kind = 'window'").select(F.col("device").cast("long").alias("user_id"), day("start").alias("start"), day("t").alias("cutoff"), total.alias("total"))


@query(DAILY + """, f AS (SELECT *, max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed FROM d),
e AS (SELECT * FROM f WHERE failed = 0),
i AS (SELECT *, (dt - DATE '1970-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM e),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY dt) - 1) // 7 AS chunk FROM i)
SELECT user_id, min(dt) AS start, max(dt) AS cutoff, round(sum(v), 4) AS total FROM p GROUP BY user_id, island, chunk HAVING count(*) = 7""")
def stream_tumbling(spark, sf):
    return _cut(streamed(spark, sf))


@query(DAILY + """, f AS (SELECT *, max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed FROM d),
i AS (SELECT *, (dt - DATE '1970-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM f WHERE failed = 0 AND dt >= DATE '2024-01-03' AND dt < DATE '2024-01-27'),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY dt) AS pos, sum(v) OVER (PARTITION BY user_id, island ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total FROM i)
SELECT user_id, dt - 6 AS start, dt AS cutoff, round(total, 4) AS total FROM p WHERE pos >= 7 AND (pos - 7) % 3 = 0""")
def stream_rolling(spark, sf):
    return _cut(streamed(spark, sf, stride=3, start_us=19_725 * DAY_US, stop_us=19_749 * DAY_US))


@query(DAILY + """, f AS (SELECT *, max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed FROM d),
k AS (SELECT user_id, CASE WHEN failed = 1 THEN 'after failure' WHEN dt < DATE '2024-01-03' OR dt >= DATE '2024-01-27' THEN 'outside' END AS kind FROM f)
SELECT user_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY user_id, kind""")
def stream_left_out(spark, sf):
    """Rows that no window may hold, by their kind; within the delay none is late."""
    rows = streamed(spark, sf, stride=3, start_us=19_725 * DAY_US, stop_us=19_749 * DAY_US)
    return rows.where("kind <> 'window' AND device <> '~'").groupBy(F.col("device").cast("long").alias("user_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


def arriving_runs(runs: DataFrame, folder: str, files: int = FILES) -> str:
    nothing = [F.lit(None)] * 4
    part = F.array(F.struct(F.lit("~"), F.lit("none"), F.lit("~"), *nothing))  # the last run must have a component to move the watermark
    return arriving(runs.withColumn("by", F.col("machine.id")), "by", "collected_at", folder, files, components=part)


@query(fleet_catalog.ANALYSIS + "SELECT device, dt, component, health, len(ev)::INT AS findings, n::INT AS points, round(slope, 6) + 0.0::DOUBLE AS slope, accelerating, status, trend, priority_score, signal FROM a")
def stream_fleet(spark, sf):
    """Every component of every run as the stream scores it, run by run."""
    folder = scratch_folder(spark)
    where = arriving_runs(fleet_catalog.runs(spark, sf), f"{folder}/in")
    stream = jobs.follow(spark, where, fleet.RUN, files_per_trigger=8 * FILES)

    def shown(rows: DataFrame) -> DataFrame:
        return rows.where("kind = 'scored'").select("device", F.to_date("t").alias("dt"), "component", "health", F.size("evidence").alias("findings"), "points", (F.round("slope", 6) + 0.0).alias("slope"), "accelerating", "status", "trend", "priority_score", "signal")

    fleet_state.score(stream, DELAY_DAYS * DAY_US // 1000, f"{folder}/out", f"{folder}/kept", f"{folder}/state", shown).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
