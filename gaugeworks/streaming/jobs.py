"""Structured Streaming: ingest with quarantine, windows and growth by event time, latest runs.

State is per device: the rows that wait for the watermark, and a window or 14 runs, so a
stream's state grows with the number of devices and the delay, not with time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators.quality import reasons


def follow(spark, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a directory, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest(stream: DataFrame, rules: dict[str, Column], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Accepted and quarantined rows as two partitions of one table; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        marked = reasons(batch, rules).withColumn("accepted", F.col("reason").isNull()).withColumn("batch", F.lit(epoch))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "accepted").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")).start()


def once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, time: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Counts per day that appear when the day has closed: the watermark is the availability delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


class InOrder(StatefulProcessor):
    """Takes a key's rows in the order of their times, each when the watermark has passed its availability (time + ``cadence_us``).

    Rows wait as columns of one value, with the timer that is set for the least availability
    that waits: each call reads and writes the state once, whatever the number of rows. What
    arrives when the watermark has already passed its availability is late: it is given
    out as such and changes nothing. Of rows that repeat a time the least one is
    taken, the others are given out as repeated. A subclass has ``fields`` (the columns
    that wait, ``t`` in microseconds first), ``output`` and ``take``.
    """

    fields: dict[str, str]
    output: dict[str, str]
    cadence: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "due long, " + ", ".join(f"{k} array<{v}>" for k, v in self.fields.items()))
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key, rows: list[tuple]) -> list[tuple]:
        """The output for rows that are in order, with all that came before them taken."""
        raise NotImplementedError

    def aside(self, key, row: tuple, kind: str) -> tuple:
        """An output row for a row that isn't taken."""
        names = list(self.output)
        return tuple(kind if n == "kind" else row[0] if n == "t" else key[names.index(n)] if names.index(n) < len(key) else None for n in names)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.cadence
        places, fresh, out = None, [], []
        for row in rows:
            places = places or [row.__fields__.index(k) for k in self.fields]
            row = tuple(row[i] for i in places)
            if row[0] <= passed:
                out.append(self.aside(key, row, "late"))
            else:
                fresh.append(row)
        if fresh:
            due, held = self._held()
            self._keep(due, held + fresh)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.cadence
        held = sorted(self._held()[1], key=lambda r: tuple((x is not None, x) if not isinstance(x, (list, dict)) else (True, str(x)) for x in r))
        ready, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        self._keep(None, rest)
        out, single = [], []
        for r in ready:
            if single and single[-1][0] == r[0]:
                out.append(self.aside(key, r, "repeated"))
            else:
                single.append(r)
        if single:
            out += self.take(key, single)
        yield from self._rows(out)

    def _held(self) -> tuple[int | None, list[tuple]]:
        """(the time of the timer, the rows that wait)."""
        known = self.waiting.get()
        return (None, []) if known is None else (known[0], list(zip(*known[1:], strict=True)))

    def _keep(self, due: int | None, rows: list[tuple]) -> None:
        """Leaves ``rows`` waiting, with a timer for the first of them; ``due`` is the one that is set."""
        if not rows:
            self.waiting.clear()
            return
        at = -(-(min(r[0] for r in rows) + self.cadence) // 1000)
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            due = at
        self.waiting.update((due, *map(list, zip(*rows, strict=True))))

    def _rows(self, rows: list[tuple]) -> Iterator[Row]:
        shape = Row(*self.output)
        return (shape(*r) for r in rows)

    def close(self) -> None:
        pass


class EventWindows(InOrder):
    """Windows of ``size`` rows without a gap, at every ``stride``-th row of a run: tumbling where both are equal.

    Rows after a device's failure, its own included, and rows outside [start, stop) are given out
    as such and break a run. State is the last rows of the open run.
    """

    fields = {"t": "long", "value": "double", "failed": "boolean"}
    output = {"device": "string", "kind": "string", "t": "long", "start": "long", "values": "array<double>"}

    def __init__(self, size: int, cadence_us: int, stride: int | None = None, start_us: int | None = None, stop_us: int | None = None):
        self.size, self.cadence, self.stride, self.start, self.stop = size, cadence_us, stride or size, start_us, stop_us

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "last long, pos long, failed boolean, recent array<double>")

    def take(self, key, rows: list[tuple]) -> list[tuple]:
        last, pos, failed, recent = self.run.get() or (None, 0, False, [])
        recent, out = list(recent), []
        for row in rows:
            t, value, fails = row
            failed = failed or bool(fails)
            if failed or self.start is not None and t < self.start or self.stop is not None and t >= self.stop:
                out.append(self.aside(key, row, "after failure" if failed else "outside"))
                continue
            if last is not None and t - last != self.cadence:
                pos, recent = 0, []
            last, pos, recent = t, pos + 1, [*recent, value][-self.size :]
            if pos >= self.size and (pos - self.size) % self.stride == 0:
                out.append((key[0], "window", t, t - (self.size - 1) * self.cadence, list(recent)))
        self.run.update((last, pos, failed, recent))
        return out


def in_order(stream: DataFrame, by: list[str], time: str, delay: str, processor: InOrder) -> DataFrame:
    """The output of ``processor`` over a stream with an event time ``time`` and rows up to ``delay`` late.

    The watermark follows ``time``, but that column doesn't reach the state, so that
    Spark drops no row: what is late comes out as late.
    """
    fields = [F.unix_micros(time).alias("t"), *(F.col(c) for c in list(processor.fields)[1:])]
    rows = stream.withWatermark(time, delay).select(*by, *fields)
    schema = ", ".join(f"{k} {v}" for k, v in processor.output.items())
    return rows.groupBy(*by).transformWithState(processor, schema, "Append", "EventTime")


def windows(stream: DataFrame, time: str, delay: str, size: int, cadence_us: int, stride: int | None = None, start_us: int | None = None, stop_us: int | None = None) -> DataFrame:
    """(device, kind, t, start, values) of a stream (device, ``time``, value, failed): windows that end at ``t``, and the rows that are in none by their kind."""
    return in_order(stream, ["device"], time, delay, EventWindows(size, cadence_us, stride, start_us, stop_us))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stateful stream gives out, all that is there now, as Parquet by batch; a batch that runs again replaces its own rows."""
    spark = out.sparkSession
    key, known = "spark.sql.streaming.stateStore.providerClass", None
    known = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # the state of the processors needs its column families

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    try:
        return out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, known)


class CounterGrowth(InOrder):
    """Growth of a device's counter against the earliest of its last 14 runs, which are the state."""

    MOST = 14
    fields = {"t": "long", "value": "double"}
    output = {"device": "string", "kind": "string", "t": "long", "delta": "double", "grows": "boolean"}
    cadence = 0

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "t array<long>, v array<double>")

    def take(self, key, rows: list[tuple]) -> list[tuple]:
        times, values = map(list, self.runs.get() or ([], []))
        out = []
        for t, v in rows:
            if times:
                delta, days = v - values[0], max(0.5, (t - times[0]) / 86_400_000_000)
                out.append((key[0], "growth", t, delta, bool(delta > 0 and (delta / days > 0.5 or delta >= 5))))
            times, values = [*times, t][-self.MOST :], [*values, float(v)][-self.MOST :]
        self.runs.update((times, values))
        return out


def growth(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """(device, kind, t, delta, grows) of a stream (device, ``time``, value)."""
    return in_order(stream, ["device"], time, delay, CounterGrowth())


def drop_version(spark, path: str, version: int) -> None:
    """Deletes a version that no batch reads again, if there is one."""
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def latest_runs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A table with the newest run time and the number of runs of each device, brought up to date by each batch.

    A batch joins what the one before left with its own and writes a version of the
    table; one that runs again starts from the same version. ``current`` reads the newest.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = batch.groupBy(F.col("machine.id").alias("device")).agg(F.max("collected_at").alias("last_run"), F.count(F.lit(1)).alias("runs"))
        if epoch:
            seen = seen.unionByName(spark.read.schema(seen.schema).parquet(f"{path}/version={epoch - 1}")).groupBy("device").agg(F.max("last_run").alias("last_run"), F.sum("runs").alias("runs"))
        seen.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        drop_version(spark, path, epoch - 2)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The newest version of what ``latest_runs`` keeps."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("version") == rows.select(F.max("version")).first()[0]).drop("version")


def distinct_days(table: DataFrame, day: str, archive: str) -> DataFrame:
    """``table`` with the last check of an ingest in its plan: a day that stands in two archives is an error."""
    twice = table.groupBy(day).agg(F.count_distinct(archive).alias("n")).agg(F.max("n").alias("most"))
    known = F.when(F.col("most") > 1, F.raise_error(F.lit("archives contain overlapping daily snapshots"))).otherwise(F.lit(True))
    return table.join(F.broadcast(twice.select(known.alias("_distinct"))), F.lit(True)).where("_distinct").drop("_distinct")  # one row
