"""Forms that hold at scale: ranges for ranks, bins for intervals, leaves for resamples, digests for comparisons, buckets for windows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import evaluation, fleet, relations, sampling
from gaugeworks.plans import study_catalog
from gaugeworks.sources import writers
from gaugeworks.sources.shuffled import Cursor, ShuffledTable

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_places(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(30), k) for k in range(500)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(6)
    ranked = sampling.Ranked(df, [F.desc("v"), F.col("k")], str(tmp_path / "r"), 5)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted((r.place, r.v, r.k) for r in ranked.rows().collect()) == [(i + 1, *r) for i, r in enumerate(want)]
    assert [tuple(ranked.page(i).first()) for i in (0, 99, 250, 499)] == [want[i] for i in (0, 99, 250, 499)]
    assert [tuple(r) for r in ranked.page(95, 40).collect()] == want[95:135] and ranked.page(490, 40).count() == 10
    assert len(ranked.first) >= 3
    one = ranked.page(250)
    assert "PartitionFilters: [isnotnull(_range" in executed(one) and "_range#" in executed(one)  # one range is read
    for bad in (-1, 500):
        with pytest.raises(IndexError):
            ranked.page(bad)
    empty = sampling.Ranked(df.where("false"), ["k"], str(tmp_path / "e"), 3)
    assert empty.rows().count() == 0
    with pytest.raises(IndexError):
        empty.page(0)


def test_scopes_of_one_hot_device(spark):
    rng = random.Random(3)
    obs = [("hot" if rng.random() < 0.8 else f"d{rng.randrange(5)}", rng.randrange(5000), rng.random()) for _ in range(3000)] + [(None, 5, 1.0), ("d1", None, 1.0), ("d1", 7, None)]
    tasks = [(i, "hot" if rng.random() < 0.7 else f"d{rng.randrange(6)}", a, a + rng.choice([0, 1, 40, 300])) for i, a in enumerate(rng.randrange(5000) for _ in range(200))]
    o, t = spark.createDataFrame(obs, "d string, t long, v double"), spark.createDataFrame(tasks, "task int, d string, a long, b long")
    want = {i: (len(inside), sum(v or 0 for v in inside)) for i, d, a, b in tasks if (inside := [v for e, x, v in obs if e == d and x is not None and a <= x < b])}
    totals = {r.task: (r.n, r.v) for r in relations.scope_totals(o, t, "task", "d", "t", "a", "b", ["v"], 50).collect()}
    assert totals.keys() == want.keys() and all(totals[k][0] == want[k][0] and totals[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    pairs = relations.within_scope(o, t, "d", "t", "a", "b", 50)
    assert {r.task: r.n for r in pairs.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: n for k, (n, _) in want.items()}
    # candidates: what is in scope, and two bins at the ends of each scope
    made = o.withColumn("_bin", F.floor(F.col("t") / 50)).join(t.where("a < b").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a") / 50), F.floor((F.col("b") - 1) / 50)))), ["d", "_bin"]).count()
    densest = max(sum(1 for e, x, _ in obs if e == "hot" and x is not None and x // 50 == b) for b in range(100))
    assert made <= sum(n for n, _ in want.values()) + 2 * densest * len(tasks) < 3000 * 200 / 4


@pytest.mark.parametrize("leaf_pairs", [64, 100_000])
def test_resampling_holds_in_leaves(spark, leaf_pairs):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.random(1500) < 0.8, rng.random(1500) < 0.7, strict=True))]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    gaps = np.array([a - b for _, a, b in rows])
    plain = np.quantile(np.random.default_rng(42).choice(gaps, size=(2000, 1500)).mean(axis=1), [0.025, 0.975])
    one = evaluation.bootstrap_interval(df.repartition(2), "a", "b", "i", leaf_pairs=leaf_pairs).first()
    again = evaluation.bootstrap_interval(df.repartition(7, "a"), "a", "b", "i", leaf_pairs=leaf_pairs).first()
    assert tuple(one) == tuple(again)
    spread = gaps.std() / 1500**0.5
    assert np.abs(np.array(tuple(one)) - plain).max() < 0.2 * spread  # some four errors of a quantile of 2000 draws


def test_resamples_have_as_many_draws_as_pairs(spark):
    ones = spark.range(1000).select("id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    assert tuple(evaluation.bootstrap_interval(ones, "a", "b", "id", leaf_pairs=50).first()) == (1.0, 1.0)


def test_differences_are_named(spark):
    rows = [(k, f"t{k % 7}", float(k)) for k in range(400)] + [(5, "t5", 5.0)]
    a = spark.createDataFrame(rows, "k int, t string, v double")
    assert relations.compare(a, a.repartition(3).orderBy(F.desc("k")), ["k"], 16).count() == 0
    changed = [(k, "other" if k == 9 else t, None if k == 11 else v) for k, t, v in rows if k != 20][:-1] + [(900, "n", 1.0)]
    b = spark.createDataFrame(changed, "k int, t string, v double")
    got = {(r.k, r.copy, r.field, r.left, r.right) for r in relations.compare(a, b, ["k"], 16).collect()}
    shape = lambda k, t, v: '{"_there":true,"t":"{\\"v\\":\\"%s\\"}","v":"{\\"v\\":%s}"}' % (t, v)
    assert {g[:3] for g in got} == {(9, 1, "t"), (11, 1, "v"), (20, 1, "row"), (5, 2, "row"), (900, 1, "row")}
    assert (9, 1, "t", "t2", "other") in got and (11, 1, "v", "11.0", None) in got and any(g[0] == 900 and g[3] is None for g in got)
    assert shape(20, "t6", 20.0) in {g[3] for g in got}
    with pytest.raises(ValueError, match="other columns"):
        relations.compare(a, b.drop("v"), ["k"])
    with pytest.raises(ValueError, match="field"):
        writers.verify(b, a, ["k"])


def test_windows_of_a_bucketed_table_need_no_exchange(spark, tmp_path):
    rows = study_catalog.history(spark, SF)
    name = f"histories_{abs(hash(str(tmp_path)))}"
    kept = writers.bucketed(rows, name, str(tmp_path / "t"), "device", "day", 4)
    try:
        windows = study_catalog.studies.daily_windows(kept, study_catalog.DAY, 5)
        plan = executed(windows)
        assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        growth = study_catalog.windows.counter_growth(kept.withColumn("t", F.col("day").cast("timestamp")), "device", "t", "n") if hasattr(study_catalog, "windows") else windows
        assert "Exchange" not in executed(growth)
        flat = lambda df: sorted(map(str, df.collect()))
        assert flat(windows) == flat(study_catalog.studies.daily_windows(rows, study_catalog.DAY, 5))
        with pytest.raises(Exception):
            writers.bucketed(rows, name, str(tmp_path / "t"), "device", "day", 4)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_release_checks_are_in_the_plan(spark):
    rows = spark.range(50).select("id", (F.col("id") % 5).alias("g"))
    opened = rows.where("id < 7").select("id")
    assert relations.unused_after_release(rows, opened, "id", 50, "g").count() == 43
    for bad in ((rows, opened, 51), (rows.unionByName(rows.limit(1)), opened, 51), (rows, opened.unionByName(spark.range(90, 91)), 50)):
        with pytest.raises(Exception, match="differs from its release"):
            relations.unused_after_release(bad[0], bad[1], "id", bad[2], "g").collect()
    with pytest.raises(Exception, match="complete the release"):
        relations.unused_after_release(rows, opened.unionByName(rows.where("g = 1").select("id")).distinct(), "id", 50, "g").collect()


def test_runs_are_saved_but_not_those_of_the_demo_fleet(spark, tmp_path):
    def run(i, parts=1):
        return ("v", "agent", dt.datetime(2024, 1, 1), (i, None, None, None, "medium", None, None, 1), [("c", "cpu", "c", {}, {}, {}, None)] * parts)
    frame = lambda *rows: spark.createDataFrame(list(rows), fleet.RUN)
    demo = spark.createDataFrame([("server-001",)], "id string")
    writers.save_runs(frame(run("a/b"), run("c")), str(tmp_path / "runs"), demo)
    back = spark.read.json(str(tmp_path / "runs"))
    assert {(r.device, r.machine.id, r.machine.site) for r in back.collect()} == {("a-b", "a-b", "local"), ("c", "c", "local")}
    for bad, said in ((run("server-001"), "demo fleet"), (run("d", 0), "without components")):
        with pytest.raises(Exception, match=said):
            writers.save_runs(frame(bad), str(tmp_path / "runs"), demo)
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_a_resumed_read_is_the_suffix(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).select("id", (F.col("id") % 3).alias("file_")).repartition(4, "id").write.parquet(path)
    table = ShuffledTable(spark, path, 5, 32, 100)
    key = lambda r: (r.file, r.group, r.batch, r.at)
    whole = sorted(table.read().collect(), key=key)
    assert sorted(r.id for r in whole) == list(range(1000)) and len({key(r) for r in whole}) == 1000
    assert {r.at for r in whole} <= set(range(32)) and max(r.group for r in whole) >= 2
    for cursor in (Cursor(0, 1, 2), Cursor(2, 0, 0), Cursor(3, 2, 1)):
        rest = table.read(cursor)
        assert [r.id for r in sorted(rest.collect(), key=key)] == [r.id for r in whole if (r.file, r.group, r.batch) >= cursor]
        assert len(rest.inputFiles()) == 4 - cursor.file  # earlier files aren't opened
    assert table.read(Cursor(4)).count() == 0
    other = sorted(ShuffledTable(spark, path, 6, 32, 100).read().collect(), key=key)
    assert [r.id for r in other] != [r.id for r in whole] and [r.id for r in sorted(ShuffledTable(spark, path, 5, 32, 100).read().collect(), key=key)] == [r.id for r in whole]


def test_names_of_large_components(spark):
    import hashlib

    edges = [("x", f"h{k:05d}") for k in range(3000)] + [("y", "h00007"), ("z", "other"), ("z", "another"), ("w", "other")]
    got = {r.d: r.group for r in relations.connected_groups(spark.createDataFrame(edges * 2, "d string, h string"), "d", "h").collect()}
    name = lambda hs: hashlib.sha256("|".join(sorted(hs)).encode()).hexdigest()
    large, small = name(f"h{k:05d}" for k in range(3000)), name(["other", "another"])
    assert got == {"x": large, "y": large, "z": small, "w": small}
