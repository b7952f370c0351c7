"""Windows over histories: the literal cases, and procedural re-statements on random histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import quality, relations, windows

DAY0 = dt.date(2024, 1, 1)


def days(spark, rows):
    return spark.createDataFrame([(d, DAY0 + dt.timedelta(days=k), float(k), f) for d, k, f in rows], "device string, dt date, v double, failure int")


def hdd(spark, rows, first="2024-01-01", last="2024-02-29", size=28):
    w = windows.hdd_windows(days(spark, rows), "device", "dt", F.col("failure") == 1, first, last, size)
    return sorted(tuple(r) for r in w.groupBy("device", "window").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).select("device", "a", "b").collect())


def test_tumbling_90_days(spark):
    rows = [("d", k, int(k == 58)) for k in range(90)]
    assert [str(r[2]) for r in hdd(spark, rows)] == ["2024-01-28", "2024-02-25"]
    gap = [r for r in rows if r[1] != 5]
    assert [str(r[1]) for r in hdd(spark, gap)] == ["2024-01-07"]


def test_tumbling_random(spark):
    random.seed(5)
    rows, want = [], []
    for n in range(60):
        d, segment, failed = f"d{n:02d}", [], False
        for k in range(40):
            if random.random() < 0.12:
                continue
            f = int(random.random() < 0.03)
            rows.append((d, k, f))
            failed = failed or f == 1
            if failed or not 2 <= k <= 33:
                continue
            if segment and k - segment[-1] != 1:
                segment = []
            segment.append(k)
            if len(segment) == 5:
                want.append((d, DAY0 + dt.timedelta(days=segment[0]), DAY0 + dt.timedelta(days=k)))
                segment = []
    random.shuffle(rows)
    assert hdd(spark, rows, "2024-01-03", "2024-02-03", 5) == sorted(want)


def test_rolling_random(spark):
    random.seed(6)
    rows, want = [], []
    for n in range(60):
        d, run, last = f"d{n:02d}", [], None
        for k in range(45):
            if random.random() < 0.06:
                continue
            rows.append((d, k, 0))
            run = [*run, k] if run and k - run[-1] == 1 else [k]
            if len(run) >= 7 and (last is None or k - last >= 3):
                want.append((d, k))
                last = k
    w = windows.rolling(days(spark, rows), "device", F.unix_date("dt"), 7, 3)
    got = [(r.device, (r.b - DAY0).days) for r in w.groupBy("device", "island", "end_pos").agg(F.max("dt").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 7").collect()]
    assert sorted(got) == sorted(want)


def test_future_rows_change_no_earlier_window(spark):
    rows = [("d", k, 0) for k in range(60)]
    before = hdd(spark, rows)
    assert hdd(spark, [(d, k, f if k < 57 else 1) for d, k, f in rows]) == before
    assert hdd(spark, list(reversed(rows))) == before


def test_sliding_cutoffs_and_labels(spark):
    cut = F.array(F.lit("2024-01-28").cast("date"))
    ends = lambda rows: windows.sliding(days(spark, rows), "device", "dt", F.col("failure") == 1, cut, 28).count()
    history = [("d", k, 0) for k in range(36)]
    assert ends(history) == 28
    assert ends([r for r in history if r[1] != 10]) == 0
    assert ends([*history, ("d", 10, 0)]) == 0
    assert ends([("d", k, int(k == 27)) for k in range(36)]) == 0
    label = lambda rows: windows.future_label(days(spark, rows), "device", "dt", F.col("failure") == 1, cut).first().label
    assert label(history) == 0
    assert label(history[:30]) is None
    gap = [r for r in history if r[1] != 29]
    assert label(gap) is None
    assert label([(d, k, int(k == 34)) for d, k, _ in gap]) == 1
    assert label([("d", k, int(k == 27)) for k in range(36)]) is None


def test_greedy_stride_and_zero_fill(spark):
    counts = spark.createDataFrame([("m", 0, 1, 0), ("m", 27, 28, 0), ("m", 34, 35, 0)], "device string, day long, reads long, scrubs long")
    ends = windows.greedy_stride(counts, "device", F.col("day"), F.col("day") >= 27, 7)
    filled = windows.zero_filled(ends, counts, "device", "day", ["reads", "scrubs"])
    got = {r.cutoff: r.reads for r in windows.gather(filled, ["device", "cutoff"], ["reads", "scrubs"]).collect()}
    assert got[27] == [1, *[0] * 26, 28] and sorted(got) == [27, 34]


@pytest.mark.parametrize(
    "values,band,counter,code",
    [([30.0] * 28, 1.0, False, 0), ([0.0, 4.0, 1.0], 1.0, True, 4), ([float(k) for k in range(28)], 1.0, True, 1), ([float(27 - k) for k in range(28)], 1.0, False, 2), ([float(k % 7) for k in range(28)], 1.0, False, 3)],
)
def test_trend_codes(spark, values, band, counter, code):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(S.trend_code("v", band, counter)).first()[0] == code


def test_trajectory_and_growth(spark):
    rows = [("d", DAY0 + dt.timedelta(days=k), 90.0 - 3 * k, 2.0 * k) for k in range(6)]
    df = spark.createDataFrame(rows, "device string, dt date, h double, c double")
    t = {r.dt: r for r in windows.trajectory(df, "device", "dt", "h").collect()}
    assert t[DAY0 + dt.timedelta(days=1)].slope == 0.0 and abs(t[DAY0 + dt.timedelta(days=5)].slope + 3) < 1e-9
    g = windows.counter_growth(df, "device", "dt", "c").orderBy("dt").collect()
    assert [r.grows for r in g] == [False, True, True, True, True, True]


def test_quarantine_and_duplicates(spark):
    rows = spark.createDataFrame([("a", "m", DAY0, 0), (None, "m", DAY0, 0), ("b", "m", DAY0, 2), ("c", "m", DAY0, None), ("d", "m", DAY0 + dt.timedelta(days=1), 0)], "serial_number string, model string, date date, failure int")
    good, bad = quality.quarantine(rows, quality.drive_day_rules(F.lit(DAY0)))
    assert [r.serial_number for r in good.collect()] == ["a"]
    assert sorted(r.reason for r in bad.collect()) == ["date differs from file", "failure flag", "failure flag", "missing identity"]
    assert quality.duplicate_keys(rows, "model").first().n == 5
    two = spark.createDataFrame([(1, "x", None), (1, "x", "y")], "k int, a string, b string")
    assert quality.conflicting(two, ["k"], ["a", "b"]).first().versions == 2


def test_media(spark):
    names = ["WDC  WUH721816ALE6L4", "DELLBOSS VD", "WDC  WDS250G2B0A", "unidentified"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert [r[0] for r in df.select(S.media_type("m")).collect()] == ["hdd", "ssd", "ssd", "unknown"]


def test_groups_do_not_depend_on_order(spark):
    edges = [("a", "h1"), ("b", "h1"), ("b", "h2"), ("c", "h2"), ("d", "h3")]
    for rows in (edges, edges[::-1]):
        got = {r.d: r.group for r in relations.connected_groups(spark.createDataFrame(rows, "d string, h string"), "d", "h").collect()}
        assert got["a"] == got["b"] == got["c"] != got["d"]


def test_interval_costs(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "id string, description string, created_at timestamp, finished_at timestamp, code int"
    run = lambda events, now, r, d: relations.compute_cost(spark.createDataFrame([("i", n, at(a), None if b is None else at(b), c) for n, a, b, c in events], schema), "id", F.lit(at(now)), r, d, F.lit(at(0))).first()
    S_, P, D = "Start Instance", "Stop Instance", "Delete Instance"
    one = run([(S_, 0, 1, 0), (P, 20, 21, 13), (S_, 21, 22, 0), (P, 40, 45, 0)], 60, 4, 1)
    assert (one.compute_seconds_upper, one.total_usd_upper, one.open_compute_interval) == (2700, 4.0, False)
    two = run([(S_, 0, 5, 9), (S_, 10, None, 0)], 30, 12, 0)
    assert (two.compute_seconds_upper, two.total_usd_upper, two.open_compute_interval) == (1500, 5.0, True)
    assert run([(S_, 0, 1, 0), (D, 25, 30, 0)], 60, 2, 2).total_usd_upper == 2.0
    four = run([(S_, 0, 1, 0), (P, 20, None, 0)], 30, 2, 0)
    assert (four.compute_seconds_upper, four.open_compute_interval) == (1800, True)
