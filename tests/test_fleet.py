"""The fleet layer against expectations that are worked out apart from it."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fleet, relations, windows
from gaugeworks.sources import readers


@pytest.fixture(scope="module")
def analysis(spark):
    return fleet.analyse(readers.demo_fleet(spark)).persist()


@pytest.fixture(scope="module")
def rows(analysis):
    return analysis.select("device", "component", "site", "rack", "slot", "t", "health", "status", "trend", "group", "slope", "accelerating", "priority_score", "type", "evidence", "points", "span_days").collect()


def status_of(h):
    return "healthy" if h >= 80 else "watch" if h >= 65 else "elevated" if h >= 45 else "critical"


def test_health_is_what_the_evidence_costs(rows):
    for r in rows:
        points = [e["points"] for e in r.evidence]
        assert points == sorted(points, reverse=True) and min(points, default=1) > 0
        assert r.health == pytest.approx(round(max(1.0, 100 * np.exp(-sum(points) / 85)), 1), abs=0.051) and r.status == status_of(r.health)


def test_trajectories_are_those_of_fits_by_hand(rows):
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.t):
        by[r.device, r.component].append(r)
    fit = lambda p: np.polyfit([x for x, _ in p], [y for _, y in p], 1)[0] if len(p) > 1 else 0.0
    seen = 0
    for part in list(by.values())[::7]:
        at = [((r.t - part[0].t).total_seconds() / 86400, r.health) for r in part]
        for n, r in enumerate(part, 1):
            half, known = n // 2, n >= 3
            assert r.points == n and r.slope == pytest.approx(fit(at[max(0, n - 10) : n]) if known else 0.0, abs=1e-6)
            if known:
                early, late = fit(at[: half + 1]), fit(at[half:n])
                if min(abs(late + 1), abs(late - 1.5 * min(early, -0.3))) > 1e-6:
                    assert r.accelerating == (late < -1 and late < 1.5 * min(early, -0.3))
                    seen += r.accelerating
    assert seen


def test_sites_and_patterns(spark, analysis, rows):
    last = max(r.t for r in rows)
    now = [r for r in rows if r.t == last]
    sick, racks, worst = collections.defaultdict(set), collections.defaultdict(set), {}
    for r in now:
        racks[r.site].add(r.rack)
        worst.setdefault((r.site, r.device), []).append(r.health)
        if r.status != "healthy" or r.trend in fleet.DRIFTING:
            sick[r.site, r.rack, r.group].add(r.device)
    latest = fleet.latest(analysis)
    got = {(r.site, r.rack, r.group): (r.devices, r.members, r.severity) for r in fleet.rack_patterns(latest).collect()}
    assert got == {k: (len(v), sorted(v), "elevated" if len(v) >= 5 else "watch") for k, v in sick.items() if len(v) >= 3} and got
    for r in fleet.rollup(fleet.frames(latest), ["site"]).collect():
        mine = [h for (site, _), h in worst.items() if site == r.site]
        means = [round(0.6 * min(h) + 0.4 * sum(h) / len(h), 1) for h in mine]
        assert (r.nodes, r.racks) == (len(mine), len(racks[r.site])) and abs(r.health - sum(means) / len(means)) < 0.11
        # a device counts once, with the status of its worst component
        count = collections.Counter(status_of(min(h)) for h in mine)
        assert [r.n_healthy, r.n_watch, r.n_elevated, r.n_critical] == [count[s] for s in ("healthy", "watch", "elevated", "critical")]


def test_incidents_and_ranks(spark, analysis, rows):
    last = max(r.t for r in rows)
    want = sorted(((-r.priority_score, r.device, r.component) for r in rows if r.t == last and r.status != "healthy"))
    assert [(-r.priority_score, r.device, r.component) for r in fleet.incidents(fleet.latest(analysis)).collect()] == want
    codes = {"healthy": "none", "watch": "observe", "elevated": "plan", "critical": "act"}
    by = collections.defaultdict(list)
    for r in fleet.ranked(fleet.latest(analysis)).collect():
        by[r.device].append(r)
        assert r.action == codes[r.status] and f"health={r.health:.1f}" in r.facts
    for parts in by.values():
        assert [r.priority_rank for r in sorted(parts, key=lambda r: (-r.priority_score, r.component))] == list(range(1, len(parts) + 1))


def test_timeline_is_causal_and_links_are_those_of_days(spark, analysis):
    now = F.lit("2024-06-30 12:00:00").cast("timestamp")
    days = fleet.timeline(analysis, now)
    early = fleet.timeline(analysis.where(F.col("t") <= now - F.expr("interval 5 days")), now)
    key = lambda r: (r.device, r.day)
    one, two = ({key(r): (r.h, r.status, r.groups) for r in d.where("day <= -5").collect()} for d in (days, early))
    assert one == two and len(one) == 147 * 25
    base = {r.device: r.baseline for r in windows.baseline(days.where("day <= 0"), "device", "day", "h").collect()}
    place = {r.device: (r.site, r.rack, r.slot) for r in fleet.latest(analysis).select("device", "site", "rack", "slot").distinct().collect()}
    level, names = {"healthy": 0, "watch": 1, "elevated": 2, "critical": 3}, ["healthy", "watch", "elevated", "critical"]
    want = collections.defaultdict(list)
    for r in days.collect():
        if r.h is not None and (r.status != "healthy" or r.projected or r.h <= (base.get(r.device) or 100) - 2):
            site, rack, slot = place[r.device]
            for g in r.groups:
                want[r.day, site, rack, g].append((slot or 99, r.device, level[r.status]))
    places = fleet.latest(analysis).select("device", "site", "rack", "slot").distinct()
    linked = fleet.links(days, places, windows.baseline(days.where("day <= 0"), "device", "day", "h"))
    got = {(r.day, r.site, r.rack, r.group): (r.devices, r.members, r.status) for r in linked.collect()}
    assert got == {k: (len(v), [d for _, d, _ in sorted(v)], names[max(1, *(x for _, _, x in v))]) for k, v in want.items() if len(v) >= 2} and got


def test_findings_name_what_goes_together(spark):
    e = "array<struct<signal:string,points:double>>"
    now = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), "cpu0", "cpu", 70.0, "stable", [("Temperature", 12.0)]), ("a", dt.datetime(2024, 1, 1), "fan0", "cooling", 85.0, "stable", [("Fan speed", 9.0)]),
         ("b", dt.datetime(2024, 1, 1), "d0", "storage", 75.0, "deteriorating", [("Drive temperature", 4.0)]), ("b", dt.datetime(2024, 1, 1), "d1", "storage", 90.0, "deteriorating", [])],
        f"device string, t timestamp, component string, type string, health double, trend string, evidence {e}",
    )
    got = {(r.device, r.finding): (r.severity, r.members) for r in fleet.correlate(now).collect()}
    assert got == {("a", "thermal"): ("elevated", ["cpu0", "fan0"]), ("b", "storage-thermal"): ("elevated", ["d0"]), ("b", "storage-subsystem"): ("watch", ["d0", "d1"])}


def test_search_and_questions(spark, analysis):
    frames = fleet.frames(fleet.latest(analysis))
    assert {r.site for r in fleet.search(frames, "server", site="north").collect()} == {"north"}
    q = spark.createDataFrame([("Why is rack 3 hot?", 7), ("Can it wait 3 days?", 3), ("Compare it with its peers over 2 weeks", 14), ("hello", 7)], "q string, days int")
    got = q.select(fleet.intent("q").alias("i"), fleet.days_asked("q").alias("n"), "days").collect()
    assert [r.i for r in got] == ["why", "wait", "compare", "off-topic"] and all(r.n == r.days for r in got)


def test_peers_are_those_of_sorted_healths(spark):
    rng = np.random.default_rng(1)
    rows = [(f"m{rng.integers(2)}", f"c{rng.integers(2)}", f"d{k}", float(rng.integers(40, 60))) for k in range(80)]
    for r in relations.peers(spark.createDataFrame(rows, "m string, c string, d string, h double"), "m", "c", "d", "h").collect():
        mine = sorted(h for m, c, _, h in rows if (m, c) == (r.m, r.c))
        assert r.peers == len(mine) and r.peer_median == mine[len(mine) // 2] and r.share_below == pytest.approx(sum(h < r.h for h in mine) / (len(mine) - 1))


def test_bad_numbers_are_no_errors(spark):
    raw = spark.createDataFrame([("2024-01-01", "s", "m", "1e20", "300")], "date string, serial_number string, model string, capacity_bytes string, failure string")
    r = readers.drive_days(raw).first()
    assert r.failure is None and r.capacity_bytes is None and r.serial_number == "s"


def test_band_levels_are_parsevals():
    rng = np.random.default_rng(2)
    frames = rng.uniform(-1, 1, (5, 512))
    window = np.hanning(512)
    whole = np.abs(np.fft.fft(frames * window, axis=1)) ** 2 / (512 * (window**2).sum())
    at = np.minimum(np.arange(512), 512 - np.arange(512)) * 16_000 / 512
    want = np.sqrt(np.stack([whole[:, at < 2000].sum(1), whole[:, at >= 2000].sum(1)], 1))
    assert np.allclose(readers.band_levels(frames, 16_000), want, atol=1e-12)


def test_scored_signals_are_those_that_had_data(spark):
    part = lambda t, series=None, static=None, smart=None: ("c", t, "c", static or {}, smart or {}, series or {}, None)
    cases = [
        (part("cpu", {"temp_c": [50.0], "unknown": [1.0], "freq_mhz": [4.0] * 5}), 1), (part("cpu", {"temp_c": [50.0], "bench_ops": [1.0], "freq_mhz": [4.0, 4.0, 3.0, 2.0]}, {"hardware_errors_30d": "0"}), 4),
        (part("storage", {"write_mbps": [1.0]}, {"wear_pct": "3"}, {"reallocated_sectors": 0.0, "temperature_c": 30.0, "spin_retries": 2.0}), 4), (part("storage", {"latency_ms": [float("nan")]}), 0),
        (part("memory", {"used_pct": [1.0], "swap_pct": [1.0]}, {"ecc_corrected": "0", "ecc_uncorrected": "1"}), 2), (part("battery", static={"cycle_count": "10", "full_charge_capacity_mwh": "5"}), 1),
        (part("cooling", {"rpm": [1000.0]}), 1), (part("cooling"), 0), (part("gpu", {"temp_c": [1.0], "power_w": [1.0]}), 1), (part("power", {"voltage_v": [12.0], "temp_c": [1.0]}), 2),
    ]
    runs = [("v", "agent", dt.datetime(2024, 1, 1), (f"m{i}", None, None, None, "medium", "s", "r", 1), [p]) for i, (p, _) in enumerate(cases)]
    got = {r.device: r.signals for r in fleet.analyse(spark.createDataFrame(runs, fleet.RUN)).collect()}
    assert got == {f"m{i}": n for i, (_, n) in enumerate(cases)}


def test_risk_in_closed_form_is_the_sum_of_its_steps(spark):
    rng = np.random.default_rng(4)
    rows = [(float(round(h, 1)), float(s)) for h, s in zip(rng.uniform(1, 100, 60), [0.0, 0.4, -9.0, -0.01, *rng.normal(0, 3, 56)], strict=True)]
    df = spark.createDataFrame(rows, "h double, s double")
    hazard = lambda h: 0.0004 + 0.35 * ((100 - max(0.0, h)) / 100) ** 3

    def upto(h, s, steps):
        total, at, ends = 0.0, 0.0, []
        for w in steps:
            total += hazard(h + min(0.0, s) * (at + w / 2)) * w
            at += w
            ends.append((at, 1 - np.exp(-total)))
        return ends

    from gaugeworks.functions import scalars as S

    for r in df.select("h", "s", S.cumulative_risk("h", "s", 7.0).alias("a"), S.cumulative_risk("h", "s", 0.6).alias("b"), S.cumulative_risk("h", "s", 0.0).alias("z"), S.failure_window("h", "s").alias("w")).collect():
        assert r.a == pytest.approx(upto(r.h, r.s, [0.25] * 28)[-1][1], abs=1e-12) and r.b == pytest.approx(upto(r.h, r.s, [0.25, 0.25, 0.1])[-1][1], abs=1e-12) and r.z == 0
        ends = upto(r.h, r.s, [0.5] * 60 + [5.0] * 67)
        assert (r.w.low_days, r.w.high_days) == tuple(next((t for t, p in ends if p >= q), None) for q in (0.25, 0.75))


def test_means_of_ties_round_up_in_any_order(spark):
    h = [63.3, 99.0, 75.6, 1.5]  # 59.85 in the mean, and 59.849999999999994 as doubles add up in this order
    rows = [(f"d{i}", "s", "r", x, "watch", 1, False, "demo") for i, x in enumerate(h)]
    df = spark.createDataFrame(rows, "device string, site string, rack string, h double, status string, level int, drifting boolean, source string").coalesce(1)
    assert fleet.rollup(df, ["site", "rack"]).first().health == 59.9
