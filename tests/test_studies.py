"""Adapters against loops by hand, and the sources, sinks and contracts around them."""

import hashlib
import json
import random
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import evaluation, fleet, quality, sampling, studies, windows
from gaugeworks.plans import study_catalog
from gaugeworks.sources import readers, writers
from gaugeworks.spec import DAY_US, STUDIES, Channel, Study, micros, splits

ALL = splits(*[("2024-01-01", "2024-04-01")] * 4)
STUDY = Study("s", "s:", (Channel("v"), Channel("n")), DAY_US, ALL, stride=7)


def by_window(rows):
    out = {}
    for r in rows.orderBy("device", "window", "at").collect():
        out.setdefault((r.device, r.window), []).append(r.time_us)
    return sorted((k[0], tuple(v)) for k, v in out.items())


def test_daily_windows_are_those_of_a_loop(spark):
    rng, rows = random.Random(3), []
    for d in range(12):
        for day in range(95):
            if rng.random() < 0.97:
                rows.append((f"d{d}", date(2024, 1, 1) + timedelta(days=day), int(rng.random() < 0.004), None if rng.random() < 0.01 else rng.random(), float("nan") if rng.random() < 0.005 else 1.0))
    want, first, stop = [], micros("2024-01-01"), micros("2024-04-01")
    for device in sorted({r[0] for r in rows}):
        run, failed = [], False
        for _, day, failure, v, n in sorted(r for r in rows if r[0] == device):
            failed, at = failed or failure == 1, ((day - date(1970, 1, 1)).days + 1) * DAY_US
            if failed or not first <= at < stop or v is None or n != n:
                run = []
                continue
            run = [*run, at] if run and at - run[-1] == DAY_US else [at]
            if len(run) == 28:
                want.append((device, tuple(run)))
                run = []
    df = spark.createDataFrame(rows, "device string, day date, failure int, v double, n double").repartition(5)
    got = studies.daily_windows(df, STUDY)
    assert by_window(got) == sorted(want) and want
    assert studies.daily_audit(df, STUDY).agg(F.sum("windows")).first()[0] == len(want)


def test_sampled_tiles_are_judged_after_the_draw(spark):
    cadence, day = 10_000_000, date(2024, 1, 2)
    t0 = micros("2024-01-02")
    times = [t0 + i * cadence + (5 if i >= 40 else 0) for i in range(56)]  # the second tile has a gap
    df = spark.createDataFrame([("h", day, t, 1.0, 2.0) for t in times], "host string, day date, time_us bigint, v double, n double")
    study = Study("c", "c:", STUDY.channels, cadence, ALL)
    most = dict.fromkeys(("train", "validation", "calibration", "test"), 1)
    keys = [hashlib.sha256(f"x:h:{times[i]}".encode()).hexdigest() for i in (0, 28)]
    got = by_window(studies.tile_windows(df, study, most, "x:"))
    assert len(got) == (1 if keys[0] < keys[1] else 0)
    assert len(by_window(studies.tile_windows(df, study, dict.fromkeys(most, 2), "x:"))) == 1
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="times of a host repeat"):
        studies.tile_windows(twice, study, most, "x:").collect()


def test_modules_are_judged_before_the_draw(spark):
    t0, cadence = micros("2024-01-02"), 900_000_000
    rows = [("g", 1, t0 + i * cadence, -1.0 if i == 10 else 5.0, 6.0) for i in range(67)]
    df = spark.createDataFrame(rows, "group_id string, module int, time_us bigint, v double, n double")
    study = Study("f", "f:", STUDY.channels, cadence, ALL)
    one = studies.module_windows(df, study, dict.fromkeys(("train", "validation", "calibration", "test"), 9), "m:")
    assert [w[1][0] for w in by_window(one)] == sorted(t0 + i * cadence for i in (11, 39)) and one.first().device == "g:1"


def test_error_windows_respect_origin_and_ticket(spark):
    base = micros("2024-01-10") // DAY_US
    logs = [("a", (base + d) * 86_400 + 10, k) for d in range(60) for k in ("R", "S")] + [("a", base * 86_400, "other")]
    df = spark.createDataFrame(logs, "device string, time_s bigint, kind string")
    tickets = spark.createDataFrame([("a", (base + 45) * 86_400)], "device string, alarm_s bigint")
    days = studies.error_days(df, tickets, {"v": "R", "n": "S"})
    assert days.agg(F.max("day"), F.sum("others")).first() == (base + 44, 1)
    ends = sorted(w[1][-1] // DAY_US for w in by_window(studies.error_windows(days, STUDY)))
    # the first value of a window is known a day after its first calendar day; the last one before the ticket
    assert ends == [base + 27 + 7 * i for i in range(3)]
    bad = spark.createDataFrame([("a", 5, "R")], "device string, time_s bigint, kind string")
    with pytest.raises(Exception, match="of its era"):
        studies.error_days(bad, tickets, {"v": "R"}).collect()


def test_declared_groups(spark):
    got = studies.placed(spark.createDataFrame([("cubico:Kelmarsh:2",)], "g string"), STUDIES["pump"], "g").first()
    assert (got.split, got.start_us, got.stop_us) == ("validation", micros("2019-01-01"), micros("2019-07-01"))
    with pytest.raises(Exception, match="no declared split"):
        studies.placed(spark.createDataFrame([("elsewhere",)], "g string"), STUDIES["pump"], "g").collect()
    assert len(STUDIES["valve"].group_splits) == 11 and len(STUDIES["gearbox"].group_splits) == 20


def test_short_supply_is_fatal(spark):
    df = spark.range(5).withColumn("g", F.lit("a"))
    assert sampling.top_by_hash(df, ["g"], "id", "s:", 5, required=True).count() == 5
    with pytest.raises(Exception, match="too few members"):
        sampling.top_by_hash(df, ["g"], "id", "s:", 6, required=True).collect()
    assert sampling.one_per_group(df, "id", "g", "a:", "b:", 5, required=True).count() == 5
    with pytest.raises(Exception, match="too few groups"):
        sampling.one_per_group(df, "id", "g", "a:", "b:", 6, required=True).collect()


def test_follow_up_needs_a_failure_of_support_alone(spark):
    def ask(failed, low=0.1, sufficient=False, drop=None):
        checks = spark.createDataFrame([(c, c not in failed) for c in evaluation.REPORT_CHECKS if c != drop], "check string, ok boolean")
        shown = spark.createDataFrame([(m, 5, low, 0.03, sufficient) for m in ("reversed", "shuffled")], "mode string, groups int, gain_low double, probability double, support_sufficient boolean")
        return evaluation.follow_up(checks, shown).first().eligible

    one = {"reversed_target_response"}
    assert ask(one) and not ask(set()) and not ask(one | {"starting"}) and not ask(one, low=0.0) and not ask(one, sufficient=True) and not ask(one, drop="constant")


def test_paired_scores_need_both_sides(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id int, s double")
    assert evaluation.paired(a, a, "id", "s").count() == 2
    with pytest.raises(Exception, match="one score only"):
        evaluation.paired(a, a.limit(1), "id", "s").collect()


def test_error_log_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "logs.zip", "w") as z:
        z.writestr("logs/dimm_1.csv", "LogTime,error_type_full_name,other\n1700000000,CE.READ,x\n1700000001,,y\n")
        z.writestr("logs/dimm_2.csv", "LogTime,error_type_full_name\n1700000002,CE.SCRUB\n")
    got = sorted(map(tuple, readers.zip_error_logs(spark, str(tmp_path / "logs.zip")).collect()))
    assert got == [("dimm_1", 1700000000, "CE.READ"), ("dimm_1", 1700000001, None), ("dimm_2", 1700000002, "CE.SCRUB")]


def test_shards_and_split_reads(spark, tmp_path):
    df = spark.range(30).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    writers.shards(df, f"file://{tmp_path}/w", 6)
    assert readers.windows_of(spark, f"file://{tmp_path}/w", "train").count() == 20
    assert all(spark.read.parquet(f"file://{f}").count() <= 6 for f in (tmp_path / "w").rglob("*.parquet"))
    with pytest.raises(ValueError):
        readers.windows_of(spark, f"file://{tmp_path}/w", "other")


def test_published_json_is_whole_and_kept(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    writers.publish_json(spark, {"b": 1, "a": [2]}, path)
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": [2], "b": 1}
    with pytest.raises(FileExistsError):
        writers.publish_json(spark, {}, path)
    assert not list(tmp_path.glob("*.part"))


def case(place, **changes):
    rng, channels = np.random.default_rng(place), ("c1", "c2")
    values = [[float(x) for x in rng.integers(0, 50, 28)] for _ in channels]
    shown = [[float(np.float32((x - np.mean(v)) / np.std(v, ddof=1))) for x in v] for v in values]
    inputs = {"time_series": shown, "time_series_text": [f"{c}; daily" for c in channels], "pre_prompt": "p"}
    dates = [str(date(2025, 1, 1) + timedelta(days=i)) for i in range(28)]
    out = {
        "case_id": f"k{place}", "source": {"dataset": "D", "split": "test", "drive_id": "x", "dataset_manifest_sha256": "a" * 64},
        "window": {"dates": dates, "start": dates[0], "as_of": dates[-1], "channels": [{"name": c, "unit": "raw_source_units", "values": v} for c, v in zip(channels, values)]},
        "model_inputs": inputs,
        "inference": {"source": "saved_model_inference", "executed_during_this_review": False, "output_text": "t", "checkpoint_sha256": "b" * 64, "input_sha256": hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest(), "failure_probability": None},
        "evaluation_reference": {"never_send_to_model": True, "weak_rule_target": "t", "exact_match": True},
    }
    for path, value in changes.items():
        at = out
        for key in path.split("__")[:-1]:
            at = at[key]
        at[path.split("__")[-1]] = value
    return out


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, None), ({"case_id": "z"}, "case id"), ({"source__split": "train"}, "source"), ({"window__start": "2025-01-02"}, "start and as-of"),
        ({"inference__failure_probability": 0.2}, "unsupported prediction"), ({"inference__input_sha256": "c" * 64}, "input digest"),
        ({"evaluation_reference__exact_match": False}, "reference"), ({"inference__checkpoint_sha256": "B"}, "inference"),
    ],
)
def test_case_bundle(spark, tmp_path, changes, reason):
    text = json.dumps({"cases": [case(0, **changes), case(1)]})
    (tmp_path / "b.json").write_text(text)
    path, digest = f"file://{tmp_path}/b.json", hashlib.sha256(text.encode()).hexdigest()
    got = quality.case_faults(readers.case_bundle(spark, path, digest), ("k0", "k1"), ("c1", "c2"), "D", "test").orderBy("place").collect()
    assert [r.reason for r in got] == [reason, None]
    with pytest.raises(Exception, match="pinned"):
        readers.case_bundle(spark, path, "0" * 64).collect()


def test_runs_of_any_times_are_those_of_a_loop(spark):
    """Off-cadence rows, gaps, rows that weren't observed: the loop as the contract states it."""
    import random

    rng, rows, want, gaps = random.Random(3), [], [], 0
    for n in range(25):
        t, segment = 1_704_240_000_000_000, []
        for _ in range(60):
            t += rng.choice([10, 10, 10, 10, 10, 10, 4, 6, 20]) * 60_000_000
            seen = rng.random() > 0.08
            rows.append((f"d{n}", "g", t, float(rng.randrange(5)) if rng.random() > 0.04 else float("nan"), seen))
            if not seen or rows[-1][3] != rows[-1][3]:
                segment = []
                continue
            if segment and t - segment[-1] != 600_000_000:
                segment, gaps = [], gaps + 1
            segment.append(t)
            if len(segment) == 4:
                want.append((f"d{n}", segment[0], t))
                segment = []
    study = Study("s", "", (Channel("v"),), 600_000_000, splits(*[("2024-01-01", "2024-03-01")] * 4), group_splits={"g": "train"})
    df = spark.createDataFrame(rows, "device string, group_id string, time_us long, v double, observed boolean")
    cut = studies.industrial_windows(df, study, 4).groupBy("device", "window").agg(F.min("time_us").alias("a"), F.max("time_us").alias("z"), F.count(F.lit(1)).alias("n"))
    assert sorted((r.device, r.a, r.z) for r in cut.collect()) == sorted(want) and want
    audit = studies.industrial_audit(df, study, 4).first()
    bad = sum(not s or v != v for *_, v, s in rows)
    assert (audit.source_rows, audit.excluded_rows, audit.calendar_gaps, audit.windows) == (len(rows), bad, gaps, len(want)) and audit.short_rows == len(rows) - bad - 4 * len(want)
    plain = windows.component_windows(df.withColumn("time_us", F.col("time_us") - 600_000_000), "device", "time_us", 600_000_000, F.col("observed") & ~F.isnan("v"), 0, 1 << 60, 4)
    assert plain.groupBy("device", "window").count().count() == len(want)
    with pytest.raises(Exception, match="repeat"):
        studies.industrial_windows(df.unionByName(df.limit(1)), study, 4).collect()


def test_turbines_and_valves_become_rows(spark):
    files = [(f"/x/{site}_{unit}_{year}.csv", f"{year}-01-01 00:00:00", 40.0, 50.0) for site, unit, year in (("Kelmarsh", "1", 2018), ("Kelmarsh", "01", 2019), ("Kelmarsh", "2", 2019), ("Penmanshiel", "10", 2020))]
    table = readers.turbine_files(spark.createDataFrame(files, "path string, at string, gear_oil_temperature double, gear_oil_inlet_temperature double"))
    years = {"train": 2018, "validation": 2019, "calibration": 2019, "test": 2020}
    got = studies.turbine_rows(table, STUDIES["gearbox"], "at", "cubico", years).collect()
    assert sorted(r.device for r in got) == ["cubico:Kelmarsh:1:gearbox", "cubico:Kelmarsh:2:gearbox", "cubico:Penmanshiel:10:gearbox"]
    assert next(r.time_us for r in got if ":1:" in r.device) == 1_514_764_800_000_000 + 600_000_000
    wide = spark.createDataFrame([("2024-12-01T01:00:00+01:00", "v1", c, x, q) for c, x, q in (("motorposition", 10.0, "observed"), ("temperature", 20.0, "observed"), ("target", 21.0, "observed"))]
        + [("2024-12-01T00:10:00+00:00", "v1", c, x, q) for c, x, q in (("motorposition", 900.0, "observed"), ("temperature", 20.0, "observed"), ("target", 21.0, "observed"), ("other", 1.0, "bad"))]
        + [("2024-12-01T00:20:00Z", "v1", c, 1.0, q) for c, q in (("motorposition", "observed"), ("temperature", "filled"), ("target", "observed"))]
        + [("2024-12-01T00:30:00Z", "v1", "motorposition", 1.0, "observed")], "time string, device string, channel string, value double, qc string")
    names = {"motorposition": "motor_position", "temperature": "device_temperature", "target": "temperature_setpoint"}
    rows = studies.valve_rows(wide, STUDIES["valve"], F.lit("homesense:H06"), names).orderBy("time_us").collect()
    assert [(r.device, r.observed, r.motor_position) for r in rows] == [("homesense:H06:v1", True, 10.0), ("homesense:H06:v1", False, 900.0), ("homesense:H06:v1", False, 1.0), ("homesense:H06:v1", False, 1.0)]
    assert rows[0].time_us == 1_733_011_200_000_000 + 600_000_000
    with pytest.raises(Exception, match="lacks its offset"):
        studies.valve_rows(wide.withColumn("time", F.lit("2024-12-01T00:00:00")), STUDIES["valve"], F.lit("g"), names).collect()


def test_clips_by_their_names(spark):
    study = STUDIES["slide_rail"]
    names = ["slider/train/normal_id_00_00000001.wav", "slider/test/normal_id_00_00000001.wav", "slider/test/anomaly_id_02_00000001.wav", "slider/test/anomaly_id_01_00000001.wav", "slider/train/normal_id_02_00000007.wav"]
    got = {r.member: (r.group_id, r.split, r.taken) for r in studies.clips(spark.createDataFrame([(n, 330_000) for n in names], "member string, length int"), study, "slider").collect()}
    assert [got[n] for n in names] == [("dcase-slider:00", "train", True), ("dcase-slider:00", "train", False), ("dcase-slider:02", "validation", False), ("dcase-slider:01", "test", True), ("dcase-slider:02", "validation", True)]
    for n, size, said in (("slider/train/normal_id_09_00000001.wav", 330_000, "unexpected"), (names[0], 10, "out of bounds")):
        with pytest.raises(Exception, match=said):
            studies.clips(spark.createDataFrame([(n, size)], "member string, length int"), study, "slider").collect()
    frames = spark.createDataFrame([("c1", "dcase-slider:00", (k + 1) * 32_000, 0.1, 0.2) for k in range(70)], "recording string, group_id string, times_us long, low_band_rms double, high_band_rms double")
    built = studies.build(studies.clip_windows(frames, study), study, "v1")
    assert built.count() == 2 and {r.split for r in built.collect()} == {"train"}


def test_studies_can_be_run():
    import dataclasses

    from gaugeworks.spec import faults

    assert {n: faults(s) for n, s in STUDIES.items() if faults(s)} == {}
    bad = dataclasses.replace(STUDIES["ssd"], salt="", channels=(Channel("a"), Channel("a", 0.0)), cadence_us=0)
    assert faults(bad) == ["channels", "bands", "cadence", "neither a salt nor declared groups"]
    assert faults(dataclasses.replace(STUDIES["ssd"], splits=STUDIES["ssd"].splits[:3])) == ["splits", "buckets"]


def test_a_module_range_may_hold_for_some_channels(spark):
    t0, cadence = micros("2024-01-02"), 900_000_000
    df = spark.createDataFrame([("g", 1, t0 + i * cadence, 5.0, 83.0) for i in range(28)], "group_id string, module int, time_us bigint, v double, n double")
    study, most = Study("f", "f:", STUDY.channels, cadence, ALL), dict.fromkeys(("train", "validation", "calibration", "test"), 9)
    assert len(by_window(studies.module_windows(df, study, most, "m:", 0.0, 40.0, ranged=("v",)))) == 1
    assert not by_window(studies.module_windows(df, study, most, "m:", 0.0, 40.0))


def _against_sql(spark, tmp_path, name, events):
    import duckdb

    import __spark_entry__

    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_crowded_slots_have_modules(spark, tmp_path):
    rows = [(k, slot) for k in range(83) for slot in range(8)]
    _against_sql(spark, tmp_path, "study_modules", [(i, datetime(2024, 1, 10) + timedelta(minutes=30 * slot, seconds=k), 3, "view", 5.0 + k % 7) for i, (k, slot) in enumerate(rows)])


def test_half_degrees_round_as_in_sql(spark, tmp_path):
    _against_sql(spark, tmp_path, "report_reasons", [(i, datetime(2024, 1, 5), i, "view", v) for i, v in enumerate((200.5, 201.5, 199.5, 200.4, 200.6), 1)])


def test_site_healths_round_as_in_sql(spark, tmp_path):
    # the health is 50.51125, whose decimal form rounds to 50.5113 and its ten-thousandfold to 505112
    _against_sql(spark, tmp_path, "site_as_of", [(1, datetime(2024, 1, 5), 3, "view", 49.48875)])


def test_site_healths_do_not_depend_on_where_events_stand(spark, tmp_path):
    # their mean is a tie of four digits; added up from the last to the first, the health would be 56.9838
    values = (38.84, 33.52, 44.65, 63.26, 37.85, 62.47, 41.48, 22.06)
    events = [(i, datetime(2024, 1, 5, i), 3, "view", v) for i, v in enumerate(values)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(events[::-1], schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert [(r.known, r.health) for r in study_catalog.site_as_of(spark, str(tmp_path)).collect()] == [(1, 56.9837)]


def test_site_healths_that_are_ties_round_up(spark):
    healths = [round(2 * i / 100 + 2 * i % 7 / 10_000, 4) for i in range(64)]  # 0.6302953125 in the mean, and 0.6302953124999999 as doubles add up in this order
    days = spark.createDataFrame([(i, 1, h, 3, "critical", []) for i, h in enumerate(healths)], "device int, day int, h double, level int, status string, groups array<string>").coalesce(1)
    places = days.selectExpr("device", "'s' AS site", "'r' AS rack")
    base = days.selectExpr("device", "h AS baseline")
    assert fleet.site_as_of(days, places, base).first().health == 0.6302953125
