"""Streams against the batch, for rows dealt to batches in many ways."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fleet, windows
from gaugeworks.plans import catalog, fleet_catalog, stream_catalog
from gaugeworks.sources import readers
from gaugeworks.streaming import fleet_state, jobs

SF, DAY = "/root/testdata/sf0.001", 86_400_000_000
SCHEMA = "device string, at timestamp, value double, failed boolean"
EPOCH = dt.datetime(2024, 1, 1)


def deal(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame([(d, EPOCH + dt.timedelta(days=k), v, f) for d, k, v, f in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def streamed(spark, tmp_path, batches, make):
    deal(spark, tmp_path / "in", [*batches, [("~", 40_000, 0.0, False)]])
    jobs.run(make(jobs.follow(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    return [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.device != "~"]


def history(spark):
    rows = catalog.daily(spark, SF).where("user_id < 12").collect()
    return [(str(r.user_id), (r.dt - EPOCH.date()).days, r.v, r.failure == 1) for r in rows]


def days(r):
    return (dt.datetime.fromtimestamp(r / 1e6, dt.UTC).date() - EPOCH.date()).days


@pytest.mark.parametrize("seed,stride", [(1, 3), (2, None)])
def test_any_dealing_within_the_delay_gives_the_windows_of_the_batch(spark, tmp_path, seed, stride):
    rng, rows = random.Random(seed), history(spark)
    # a row arrives up to three days after its own, and a batch holds a few days of arrivals
    arrival = {r: r[1] + rng.randrange(4) for r in rows}
    cuts = sorted(rng.sample(range(34), 4))
    batches = [[r for r in rows if sum(arrival[r] >= c for c in cuts) == i] for i in range(5)]
    for b in batches:
        rng.shuffle(b)
    got = streamed(spark, tmp_path, [b for b in batches if b], lambda s: jobs.windows(s, "at", "4 days", 4, DAY, stride))
    table = spark.createDataFrame([(d, EPOCH.date() + dt.timedelta(days=k), v, int(f)) for d, k, v, f in rows], "device string, dt date, value double, failure int")
    kept = table.withColumn("ok", windows.before_failure("device", "dt", F.col("failure") == 1))
    if stride:
        batch = windows.rolling(kept.where("ok"), "device", F.unix_date("dt"), 4, stride)
        whole = windows.gather(batch.withColumn("day", F.unix_date("dt")), ["device", "island", "end_pos"], ["value", "day"])
    else:
        batch = windows.tumbling(kept, "device", F.unix_date("dt"), F.col("ok"), 4)
        whole = windows.gather(batch.withColumn("day", F.unix_date("dt")), ["device", "window"], ["value", "day"])
    want = sorted((r.device, r.day[-1] - 19_723, r.value) for r in whole.collect())
    assert sorted((r.device, days(r.t), r.values) for r in got if r.kind == "window") == want and want
    assert all(days(r.t) - days(r.start) == 3 for r in got if r.kind == "window") and not [r for r in got if r.kind == "late"]
    assert sum(r.kind == "after failure" for r in got) == kept.where("NOT ok").count()


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    first = [("a", k, float(k), False) for k in (0, 1, 2, 3, 8)] + [("b", 5, 5.0, False)]
    second = [("a", 2, 9.0, False), ("a", 4, 4.0, False), ("a", 7, 7.0, False), ("a", 7, 1.0, False), ("b", 6, 6.0, False), ("b", 5, 7.0, False)]
    third = [("b", 7, 7.0, False), ("b", 4, 4.0, False), ("c", 9, 9.0, True), ("c", 8, 8.0, False)]
    got = streamed(spark, tmp_path, [first, second, third], lambda s: jobs.windows(s, "at", "3 days", 2, DAY))
    # after the first batch the watermark stands at day 5: what was available before day 5 is late
    kinds = {k: sorted((r.device, days(r.t)) for r in got if r.kind == k) for k in ("late", "repeated", "after failure", "window")}
    assert kinds["late"] == [("a", 2), ("a", 4), ("b", 4)] and kinds["repeated"] == [("a", 7), ("b", 5)] and kinds["after failure"] == [("c", 9)]
    assert sorted((r.device, days(r.t), r.values) for r in got if r.kind == "window") == [("a", 1, [0.0, 1.0]), ("a", 3, [2.0, 3.0]), ("a", 8, [1.0, 8.0]), ("b", 6, [5.0, 6.0])]


def test_growth_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    rows = [("d", k, float(k * k % 17), False) for k in range(20)] + [("e", k, float(k), False) for k in range(5)]
    order = [rows[i] for i in (1, 0, 3, 2, 5, 4, *range(6, 25))]
    got = streamed(spark, tmp_path, [order[:8], order[8:]], lambda s: jobs.growth(s.select("device", "at", "value"), "at", "10 days"))
    table = spark.createDataFrame([(d, EPOCH + dt.timedelta(days=k), v) for d, k, v, _ in rows], "device string, at timestamp, v double")
    want = {(r.device, (r.at - EPOCH).days): (r.growth_delta, r.grows) for r in windows.counter_growth(table, "device", "at", "v").collect() if r.growth_delta is not None}
    assert {(r.device, days(r.t)): (r.delta, r.grows) for r in got if r.kind == "growth"} == want


def test_counts_once_and_latest(spark, tmp_path):
    deal(spark, tmp_path / "in", [[("a", 0, 1.0, False), ("a", 0, 1.0, False), ("b", 0, 2.0, False)], [("a", 0, 1.0, False), ("a", 1, 1.0, False)], [("z", 30, 0.0, False)]])
    stream = lambda: jobs.follow(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    def rows(out, name):
        jobs.run(out, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination(240)
        return spark.read.parquet(str(tmp_path / name)).drop("batch")
    assert rows(jobs.once(stream(), ["device", "at"], "at", "5 days"), "once").count() == 4
    counted = {(r.device, r.start): r.n for r in rows(jobs.daily_counts(stream(), "at", ["device"]), "counts").collect()}
    assert counted == {("a", EPOCH): 3, ("b", EPOCH): 1, ("a", EPOCH + dt.timedelta(days=1)): 1}
    shaped = stream().select(F.struct(F.col("device").alias("id")).alias("machine"), F.col("at").alias("collected_at"))
    for _ in range(2):  # the second run finds nothing new
        jobs.latest_runs(shaped, str(tmp_path / "latest"), str(tmp_path / "latest-state")).awaitTermination(240)
    assert sorted(map(tuple, jobs.current(spark, str(tmp_path / "latest")).select("device", "last_run", "runs").collect())) == [("a", EPOCH + dt.timedelta(days=1), 4), ("b", EPOCH, 1), ("z", EPOCH + dt.timedelta(days=30), 1)]


def test_overlapping_archives_are_an_error(spark):
    table = spark.createDataFrame([("2024-01-01", "q1", 1), ("2024-01-01", "q1", 2), ("2024-01-02", "q2", 3)], "day string, archive string, n int")
    assert jobs.distinct_days(table, "day", "archive").count() == 3
    with pytest.raises(Exception, match="overlapping"):
        jobs.distinct_days(table.unionByName(table.selectExpr("day", "'q3' AS archive", "n")), "day", "archive").collect()


def test_runs_from_files(spark, tmp_path):
    path = tmp_path / "runs"
    path.mkdir()
    (path / "a.json").write_text('{"schema": "run-v1", "collected_at": "2024-01-01T00:00:00Z",\n "machine": {"id": "m1"}, "components": []}')
    assert [(r.machine.id, r.collected_at) for r in readers.runs(spark, str(path)).collect()] == [("m1", EPOCH)]


def test_scores_in_state_are_those_of_the_batch_run_by_run(spark, tmp_path):
    runs = fleet_catalog.runs(spark, SF).where("machine.slot < 3")
    where = stream_catalog.arriving_runs(runs, str(tmp_path / "in"), files=3)
    out = fleet_state.analyse(jobs.follow(spark, where, fleet.RUN, files_per_trigger=4), "3 days")
    columns = ["device", "component", "t", "health", "points", "slope", "accelerating", "status", "trend", "priority_score", "confidence", "signal", "action", "evidence"]
    jobs.run(out.select("kind", *columns), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("kind <> 'scored'").count() == 0
    shown = lambda df: sorted((r.device, r.component, r.t, r.health, r.points, round(r.slope, 8), r.accelerating, r.status, r.trend, r.priority_score, r.confidence, r.signal, r.action, [e.signal for e in r.evidence]) for r in df.select(columns).collect())
    assert shown(got) == shown(fleet.analyse(runs)) and got.count() > 100


def test_no_row_is_late_wherever_batches_end(spark, tmp_path):
    rows = catalog.daily(spark, SF).select(F.col("user_id").cast("string").alias("device"), F.col("dt").cast("timestamp").alias("at"), F.col("v").alias("value"), F.lit(False).alias("failed"))
    where = stream_catalog.arriving(rows, "device", "at", str(tmp_path / "in"), files=2)
    out = jobs.windows(jobs.follow(spark, where, SCHEMA, files_per_trigger=5), "at", "3 days", 7, DAY)
    jobs.run(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    assert spark.read.parquet(where).where("device <> '~'").count() == rows.count()
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'late'").count() == 0


class _Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = tuple(map(list, value))

    removeKey = dict.__delitem__


def test_later_points_keep_their_blocks(monkeypatch):
    """Runs taken one by one and many at a time end in the same points and the same state, which holds the later half."""
    monkeypatch.setattr(fleet_state, "BLOCK", 4)
    rng = random.Random(7)
    rows = [(k * DAY, rng.random() * 40, f'{{"ecc_corrected": {k % 9}.0}}', "{}") for k in range(60)]

    def taken(cuts):
        one = fleet_state.FleetScores()
        one.counted, one.line, one.later = _Value(), _Value(), _Map()
        out = [r for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) for r in one.take(("d", "c"), rows[a:b])]
        return out, one.counted.held, one.line.held, dict(one.later)

    whole = taken([])
    assert len(whole[0]) == 60 and all(taken(cuts) == whole for cuts in (range(1, 60), [3, 4, 9, 31, 50], sorted(rng.sample(range(1, 60), 12))))
    assert sorted(whole[3]) == [(b,) for b in range(7, 15)]


def test_scores_of_kept_tables_are_those_of_the_batch_run_by_run(spark, tmp_path):
    """Over several batches, with a run that comes too late and one that comes twice."""
    runs, where = fleet_catalog.runs(spark, SF).where("machine.slot < 3").withColumn("by", F.col("machine.id")).persist(), str(tmp_path / "in")
    end = stream_catalog.arriving_runs(runs.drop("by").where("false"), where)  # the run that moves the watermark last
    last = spark.read.schema(runs.schema).parquet(end).persist()
    assert last.count() == 1
    where = str(tmp_path / "dealt")
    sixth = F.floor(F.datediff("collected_at", F.lit("2024-01-01")) / 6)
    for k in range(5):
        part = runs.where(sixth == k)
        part.unionByName(part.orderBy("machine.id", "collected_at").limit(1) if k == 2 else part.limit(0)).coalesce(1).write.mode("append").parquet(where)
    last.coalesce(1).write.mode("append").parquet(where)
    twice, late = (runs.where(sixth == k).orderBy("machine.id", "collected_at").first() for k in (2, 3))
    runs.where((F.col("machine.id") == late.machine.id) & (F.col("collected_at") == F.lit(late.collected_at))).coalesce(1).write.mode("append").parquet(where)
    columns = ["device", "component", "t", "health", "points", "slope", "accelerating", "status", "trend", "priority_score", "confidence", "signal", "action", "evidence"]
    stream = jobs.follow(spark, where, fleet.RUN, files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        fleet_state.score(stream, 3 * 86_400_000, str(tmp_path / "out"), str(tmp_path / "kept"), str(tmp_path / "state"), lambda df: df.select("kind", *columns)).awaitTermination(400)
    got = spark.read.parquet(str(tmp_path / "out")).persist()
    shown = lambda df: sorted((r.device, r.component, r.t, r.health, r.points, round(r.slope, 8), r.accelerating, r.status, r.trend, r.priority_score, r.confidence, r.signal, r.action, [e.signal for e in r.evidence]) for r in df.select(columns).collect())
    assert got.select("batch").distinct().count() > 3
    assert shown(got.where("kind = 'scored'")) == shown(fleet.analyse(runs)) and got.count() > 100
    aside = lambda kind: sorted((r.device, r.component, r.t, r.health, r.points) for r in got.where(F.col("kind") == kind).collect())
    of = lambda run: sorted((run.machine.id, c.id, run.collected_at, None, None) for c in run.components)
    assert aside("late") == of(late) and aside("repeated") == of(twice)
