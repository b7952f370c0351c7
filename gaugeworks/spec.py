"""What a study is: channels, splits, cadence. The catalogue holds the declared studies."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

PATTERNS = ("constant", "rising", "falling", "fluctuating without a clear net trend", "counter reset or decrease")
SPLITS = ("train", "validation", "calibration", "test")
DAY_US = 86_400_000_000
WINDOW = 28


@dataclass(frozen=True)
class Channel:
    name: str
    minimum_band: float = 1.0
    counter: bool = False
    description: str = ""


@dataclass(frozen=True)
class Split:
    """Buckets [low, high) of the salted hash, and times [start, stop) (or a closed range of dates)."""

    name: str
    low: int
    high: int
    start: str
    stop: str


@dataclass(frozen=True)
class Study:
    name: str
    salt: str
    channels: tuple[Channel, ...]
    cadence_us: int
    splits: tuple[Split, ...]
    group_splits: dict[str, str] = field(default_factory=dict)
    stride: int = WINDOW
    cadence_text: str = ""

    def channel(self, name: str) -> Channel:
        return next(c for c in self.channels if c.name == name)


def micros(text: str) -> int:
    at = datetime.fromisoformat(text)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000


def splits(*intervals: tuple[str, str]) -> tuple[Split, ...]:
    """The fixed hash ranges 0, 60, 75, 85, 100 with one interval each."""
    bounds = (0, 60, 75, 85, 100)
    return tuple(Split(n, bounds[i], bounds[i + 1], *intervals[i]) for i, n in enumerate(SPLITS))


def _two(a: str, b: str, band: float = 1.0) -> tuple[Channel, ...]:
    return Channel(a, band), Channel(b, band)


_CLUSTER = splits(("2020-01-01", "2020-02-01"), ("2020-08-01", "2020-09-01"), ("2020-08-01", "2020-09-01"), ("2021-02-01", "2021-03-01"))
_MINUTES = 60_000_000

_TURBINE_YEARS = splits(("2018-01-01", "2019-01-01"), ("2019-01-01", "2019-07-01"), ("2019-07-01", "2020-01-01"), ("2020-01-01", "2021-01-01"))

#: The units of each split (site and turbine; household).
_TURBINE_UNITS = {
    "train": ("Kelmarsh:1", "Penmanshiel:8", "Penmanshiel:11", "Kelmarsh:5", "Penmanshiel:15", "Penmanshiel:7", "Kelmarsh:3", "Penmanshiel:1", "Penmanshiel:5", "Kelmarsh:6"),
    "validation": ("Kelmarsh:2", "Penmanshiel:13", "Penmanshiel:12"),
    "calibration": ("Penmanshiel:2", "Kelmarsh:4"),
    "test": ("Penmanshiel:10", "Penmanshiel:14", "Penmanshiel:4", "Penmanshiel:6", "Penmanshiel:9"),
}
_HOME_UNITS = {"train": ("H06", "H03", "H04"), "validation": ("H01", "H11"), "calibration": ("H07",), "test": ("H08", "H05", "H09", "H02", "H10")}
_TURBINES = {f"cubico:{u}": s for s, units in _TURBINE_UNITS.items() for u in units}
_HOMES = {f"homesense:{u}": s for s, units in _HOME_UNITS.items() for u in units}

#: Which machine's clips a split takes.
_SLIDERS = {"dcase-slider:00": "train", "dcase-slider:02": "validation", **{f"dcase-slider:0{i}": "test" for i in (1, 3, 4, 5, 6)}}
_VALVES = {"dcase-valve:00": "train", "dcase-valve:02": "validation", **{f"dcase-valve:0{i}": "test" for i in (1, 3, 4, 5, 6)}}
_CLIP = splits(*[("1970-01-01", "1970-01-01T00:00:11")] * 4)

#: The declared studies, with their channels, bands, cadence and intervals.
STUDIES = {
    s.name: s
    for s in (
        Study("hdd", "hdd-split-v1:", (Channel("smart_5_raw", counter=True), Channel("smart_187_raw", counter=True), Channel("smart_194_raw"), Channel("smart_197_raw")), DAY_US,
              splits(("2013-01-01", "2024-12-31"), ("2025-01-01", "2025-09-30"), ("2025-01-01", "2025-09-30"), ("2025-10-01", "2026-03-31")), cadence_text="daily observations"),
        Study("ssd", "ssd:", (Channel("temperature"), Channel("power_on_hours", counter=True)), DAY_US,
              splits(("2019-01-01", "2025-01-01"), ("2025-01-01", "2025-10-01"), ("2025-01-01", "2025-10-01"), ("2025-10-01", "2026-04-02"))),
        Study("nvme", "nvme:", (Channel("temperature"), Channel("media_errors", counter=True), Channel("power_on_hours", counter=True), Channel("percentage_used", counter=True)), DAY_US,
              splits(("2020-01-01", "2022-01-01"), ("2022-01-01", "2022-04-01"), ("2022-04-01", "2022-07-01"), ("2022-07-01", "2022-10-02")), stride=7),
        Study("dram", "dram:", _two("read_error_logs", "scrub_error_logs"), DAY_US,
              splits(("2024-01-01", "2024-06-01"), ("2024-06-01", "2024-08-01"), ("2024-06-01", "2024-08-01"), ("2024-08-01", "2024-10-01")), stride=7),
        Study("cpu", "cpu:", _two("power", "core_temperature"), 10_000_000, _CLUSTER),
        Study("gpu", "gpu:", (Channel("power"), Channel("core_temperature"), Channel("memory_temperature")), 10_000_000, _CLUSTER),
        Study("server", "server:", _two("supply_0_input_power", "supply_1_input_power"), 10_000_000, _CLUSTER),
        Study("fan", "fan:", _two("rotor_0_speed", "rotor_1_speed"), 15 * _MINUTES,
              splits(("2020-03-01", "2022-01-01"), ("2022-01-01", "2022-04-01"), ("2022-04-01", "2022-07-01"), ("2022-07-01", "2022-10-01"))),
        Study("valve", "valve:", (Channel("motor_position"), Channel("device_temperature"), Channel("temperature_setpoint")), 10 * _MINUTES,
              splits(("2024-11-25", "2025-03-01"), ("2025-03-01", "2025-05-01"), ("2025-05-01", "2025-07-01"), ("2025-07-01", "2025-11-27")), group_splits=_HOMES),
        Study("gearbox", "", _two("gear_oil_temperature", "gear_oil_inlet_temperature"), 10 * _MINUTES, _TURBINE_YEARS, group_splits=_TURBINES),
        Study("bearing", "", _two("generator_bearing_front_temperature", "generator_bearing_rear_temperature"), 10 * _MINUTES, _TURBINE_YEARS, group_splits=_TURBINES),
        Study("pump", "", _two("gear_oil_pump_pressure", "gear_oil_inlet_pressure", 0.1), 10 * _MINUTES, _TURBINE_YEARS, group_splits=_TURBINES),
        Study("slide_rail", "", _two("low_band_rms", "high_band_rms", 1e-6), 32_000, _CLIP, group_splits=_SLIDERS),
        Study("industrial_valve", "", _two("low_band_rms", "high_band_rms", 1e-6), 32_000, _CLIP, group_splits=_VALVES),
    )
}


def faults(study: Study) -> list[str]:
    """What is wrong with a study's settings; none for one that can be run."""
    out = []
    channels = [c.name for c in study.channels]
    if not 1 <= len(channels) <= 8 or len(set(channels)) != len(channels):
        out.append("channels")
    if any(c.minimum_band <= 0 for c in study.channels):
        out.append("bands")
    if study.cadence_us <= 0 or study.stride < 1:
        out.append("cadence")
    if tuple(s.name for s in study.splits) != SPLITS or any(micros(s.start) >= micros(s.stop) for s in study.splits):
        out.append("splits")
    edges = [0, *(s.high for s in study.splits)]
    if [s.low for s in study.splits] != edges[:-1] or edges[-1] != 100 or sorted(edges) != edges:
        out.append("buckets")
    if not study.salt and not study.group_splits:
        out.append("neither a salt nor declared groups")
    if not set(study.group_splits.values()) <= set(SPLITS):
        out.append("groups")
    return out
