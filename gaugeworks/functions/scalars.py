"""Column functions: hashes, dates, series statistics, trend labels, risk."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.spec import PATTERNS, Split

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- identity and hashes


def stable_id(*parts: ColumnLike) -> Column:
    """SHA-256 of the parts joined by a bar; no part may be null."""
    return F.sha2(F.concat_ws("|", *(_c(p).cast("string") for p in parts)), 256)


def salted_hash(salt: str, identity: ColumnLike) -> Column:
    return F.sha2(F.concat(F.lit(salt), _c(identity).cast("string")), 256)


def bucket(salt: str, identity: ColumnLike) -> Column:
    """The first eight hex digits of the salted hash, modulo 100."""
    return F.conv(F.substring(salted_hash(salt, identity), 1, 8), 16, 10).cast("long") % 100


def hex_bucket(identity: ColumnLike) -> Column:
    return F.substring(F.sha2(_c(identity).cast("string"), 256), 1, 2)


def split_of(at: Column, rules: tuple[Split, ...]) -> Column:
    """The one rule whose bucket range holds ``at``; null if none or several do."""
    hits = [(at >= r.low) & (at < r.high) for r in rules]
    number = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    name = F.coalesce(*[F.when(h, F.lit(r.name)) for h, r in zip(hits, rules, strict=True)])
    return F.when(number == 1, name)


# --- text, dates and numbers


def parse_date(text: ColumnLike) -> Column:
    """ISO, M/d/yy or M/d/yyyy, the first that fits; null if none does. Two digits of a year from 69 on are of the last century."""
    iso, short, long = (F.try_to_timestamp(_c(text), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yy", "M/d/yyyy"))
    return F.coalesce(iso, F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short), long)


def parse_time(text: ColumnLike, otherwise: Column | None = None, *, offset: bool = False) -> Column:
    """An ISO date or time; without an offset it is UTC, whatever the session's zone, or with ``offset`` none at all. What is no time is ``otherwise`` (null)."""
    t = F.trim(_c(text))
    zone, day = F.regexp_extract(t, r"(Z|[+-]\d{2}:\d{2})$", 1), t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    whole = F.concat(F.regexp_replace(t, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2"), F.when(day, "T00:00:00Z").when(zone == "", "Z").otherwise(""))
    at = F.when(shape & ((zone != "") | F.lit(not offset)), whole.try_cast("timestamp"))
    return at if otherwise is None else F.coalesce(at, otherwise)


def null_tokens(text: ColumnLike, tokens: tuple[str, ...] = ("", "NA", "N/A", "null")) -> Column:
    return F.when(~_c(text).isin(*tokens), _c(text))


def exact_double(x: ColumnLike) -> Column:
    """True for a finite number that a double holds exactly as an integer's encoding."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(float(2**53))), F.lit(False))


def finite(x: ColumnLike) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def safe_id(text: ColumnLike) -> Column:
    return F.regexp_replace(_c(text), "[^a-zA-Z0-9_-]", "-")


def uuid_text(text: ColumnLike) -> Column:
    """The normal form of a UUID, null for anything else."""
    bare = F.lower(F.regexp_replace(F.trim(_c(text)), "^urn:uuid:|[{}-]", ""))
    parts = [F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def media_type(model: ColumnLike) -> Column:
    """hdd, ssd, unidentified or unknown, by a drive's model text."""
    m = F.trim(F.regexp_replace(_c(model), r"\s+", " "))
    # fixed values: prefixes and expressions of model families
    ssd = ("MTFD", "DELLBOSS", "WDC WDS", "Micron 5300 MTFD", "Micron 5400 MTFD", "Seagate IronWolf ZA", "WD Blue SA510")
    hdd = r"^(ST\d|HGST |Hitachi |TOSHIBA (DT|HD|MD|MG|MQ)|WDC (WD|WUH)|WUH721816ALE6L4$|SAMSUNG HD)"
    starts = reduce(lambda a, b: a | b, [m.startswith(p) for p in ssd])
    return F.when(m == "00MD00", "unidentified").when(m.contains("SSD") | starts, "ssd").when(m.rlike(hdd), "hdd").otherwise("unknown")


# --- series (arrays of doubles)


def mean(xs: ColumnLike) -> Column:
    xs = _c(xs)
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)).otherwise(0.0)


def median(xs: ColumnLike) -> Column:
    """The mean of the two middle values; null for none."""
    half = lambda s, n: F.get(s, F.floor(n / 2).cast("int"))
    return F.when(F.size(_c(xs)) > 0, let(F.sort_array(_c(xs)), lambda s: (half(s, F.size(s) - 1) + half(s, F.size(s))) / 2))


def upper_median(xs: ColumnLike) -> Column:
    s = F.sort_array(_c(xs))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def quantile(xs: ColumnLike, q: float) -> Column:
    s = F.sort_array(_c(xs))
    at = (F.size(s) - 1) * F.lit(q)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.when(F.size(s) > 0, low + (high - low) * (at - F.floor(at))).otherwise(0.0)


def deviation(xs: ColumnLike, sample: bool) -> Column:
    xs = _c(xs)
    square = let(mean(xs), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.sqrt(square / (F.size(xs) - (1 if sample else 0)))


def variation(xs: ColumnLike) -> Column:
    """Population deviation over the absolute mean; 0 under three values or at mean 0."""
    xs = _c(xs)
    return F.when(F.size(xs) < 3, 0.0).otherwise(let(mean(xs), lambda m: F.when(m == 0, 0.0).otherwise(deviation(xs, False) / F.abs(m))))


def relative_change(xs: ColumnLike) -> Column:
    """From the first to the last third; 0 under four values or from a base of 0."""
    xs = _c(xs)
    k = F.greatest(F.lit(1), F.floor(F.size(xs) / 3).cast("int"))
    # arrays, as a struct made inside another lambda loses its names
    ends = F.array(mean(F.slice(xs, F.lit(1), k)), mean(F.slice(xs, -k, k)))
    return F.when(F.size(xs) < 4, 0.0).otherwise(let(ends, lambda e: F.when(e[0] == 0, 0.0).otherwise((e[1] - e[0]) / F.abs(e[0]))))


def observed(xs: ColumnLike) -> Column:
    """The finite values of a series; none for null."""
    return F.coalesce(F.filter(_c(xs), finite), F.array().cast("array<double>"))


def log2p(x: ColumnLike) -> Column:
    return F.log2(1 + F.greatest(F.lit(0.0), _c(x).cast("double")))


def fleet_percentile(value: ColumnLike, middle: float, spread: float) -> Column:
    """A logistic position from 1 to 99."""
    p = F.bround(100 / (1 + F.exp(-(_c(value) - middle) / spread)))
    return F.greatest(F.lit(1), F.least(F.lit(99), p.cast("int")))


def trend_code(xs: ColumnLike, minimum_band: ColumnLike | float = 1.0, counter: ColumnLike | bool = False) -> Column:
    """The number of a window's pattern: a counter's decrease first, then constant, then the change of medians against the band."""
    xs = _c(xs)
    band_least = F.lit(minimum_band) if isinstance(minimum_band, (int, float)) else _c(minimum_band)
    is_counter = F.lit(counter) if isinstance(counter, bool) else _c(counter)
    n = F.size(xs)
    segment = F.least(F.lit(7), F.floor(n / 2).cast("int"))
    span = F.array_max(xs) - F.array_min(xs)
    change = median(F.slice(xs, n - segment + 1, segment)) - median(F.slice(xs, F.lit(1), segment))
    falls = F.exists(F.zip_with(F.slice(xs, F.lit(1), n - 1), F.slice(xs, F.lit(2), n - 1), lambda a, b: b < a), lambda d: d) if counter is not False else F.lit(False)
    known = F.array(span, change, F.greatest(band_least, span * 0.1))
    rest = let(known, lambda k: F.when(k[0] == 0, 0).when(k[1] >= k[2], 1).when(k[1] <= -k[2], 2).otherwise(3))
    return F.when(is_counter & falls, 4).otherwise(rest)


def pattern(code: Column) -> Column:
    return F.get(F.array(*(F.lit(p) for p in PATTERNS)), code)


def zscore(xs: ColumnLike) -> Column:
    """Against the sample deviation, or 1 where that is 1e-8 or less; floats last."""
    xs = _c(xs)
    sd = let(deviation(xs, True), lambda d: F.when(d > 1e-8, d).otherwise(1.0))
    return let(F.array(mean(xs), sd), lambda s: F.transform(xs, lambda x: ((x - s[0]) / s[1]).cast("float")))


# --- health


def hazard(health: Column) -> Column:
    x = (100 - F.greatest(F.lit(0.0), health)) / 100
    return 0.0004 + 0.35 * x * x * x


def _hazards(health: Column, decline: Column, start: Column, width: float, n: Column) -> Column:
    """The sum of hazards at the midpoints of ``n`` steps of ``width`` days from day ``start``.

    Without the clamp at health 0 a step's share lost is a + b * k, so that the cubes add up
    in closed form; from the step on where it reaches 1 each one is 1.
    """
    a, b = (100 - health - decline * (start + width / 2)) / 100, -decline * width / 100
    m = F.when(b > 0, F.greatest(F.lit(0.0), F.least(n, F.ceil((1 - a) / b).cast("double")))).when(a >= 1, 0.0).otherwise(n)
    first, second = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    cubes = m * a * a * a + 3 * a * a * b * first + 3 * a * b * b * second + b * b * b * first * first
    return width * (0.0004 * n + 0.35 * (cubes + (n - m)))


def cumulative_risk(health: ColumnLike, slope: ColumnLike, days: float | Column) -> Column:
    """The chance of a failure within ``days``, by midpoints of quarter days; only declines go on."""
    h, decline = _c(health), F.least(F.lit(0.0), _c(slope))
    days = F.lit(float(days)) if not isinstance(days, Column) else days.cast("double")
    whole = F.floor(days / 0.25 + 1e-9).cast("double")
    rest = F.greatest(F.lit(0.0), days - whole * 0.25)
    total = _hazards(h, decline, F.lit(0.0), 0.25, whole) + hazard(h + decline * (whole * 0.25 + rest / 2)) * rest
    return F.when(days <= 0, 0.0).otherwise(1 - F.exp(-total))


def failure_window(health: ColumnLike, slope: ColumnLike) -> Column:
    """Struct of low and high days (risk 25 % and 75 %): half-day steps to day 30, then five-day steps to 365.

    The sum of hazards only rises, so the first step at which it reaches a risk is found by halving.
    """
    h, decline = _c(health), F.least(F.lit(0.0), _c(slope))
    upto = lambda k: _hazards(h, decline, F.lit(0.0), 0.5, F.least(k, F.lit(60.0))) + _hazards(h, decline, F.lit(30.0), 5.0, F.greatest(k - 60.0, F.lit(0.0)))
    halves = F.array(*(F.lit(float(1 << i)) for i in range(6, -1, -1)))

    def days(risk: float) -> Column:
        below = F.aggregate(halves, F.lit(0.0), lambda k, step: F.when((k + step <= 127) & (1 - F.exp(-upto(k + step)) < risk), k + step).otherwise(k))
        return let(below + 1, lambda k: F.when(k <= 60, k * 0.5).when(k <= 127, 30 + (k - 60) * 5.0))

    return F.struct(days(0.25).alias("low_days"), days(0.75).alias("high_days"))


def failure_window_label(window: Column) -> Column:
    low, high = window["low_days"], window["high_days"]
    whole = lambda x: F.bround(x).cast("int").cast("string")
    least = lambda n, x: F.greatest(F.lit(n), F.bround(x).cast("int")).cast("string")
    return (
        F.when(low.isNull(), "> 1 year")
        .when(high.isNull() & (low < 14), F.concat(whole(low), F.lit("+ days")))
        .when(high.isNull(), F.concat(whole(low / 7), F.lit("+ weeks")))
        .when(high < 14, F.concat(F.lit("~"), least(1, low), F.lit("–"), least(2, high), F.lit(" days")))
        .otherwise(F.concat(F.lit("~"), least(1, low / 7), F.lit("–"), least(2, high / 7), F.lit(" weeks")))
    )


def settled(x: Column | str, digits: int) -> Column:
    """``x`` rounded half up, after what the order of a sum leaves beyond nine digits is gone: a tie is a tie in any order."""
    return F.round(F.round(x, 9), digits)


def status(health: ColumnLike) -> Column:
    h = _c(health)
    return F.when(h >= 80, "healthy").when(h >= 65, "watch").when(h >= 45, "elevated").otherwise("critical")


def status_order(name: ColumnLike) -> Column:
    n = _c(name)
    return F.when(n == "watch", 1).when(n == "elevated", 2).when(n == "critical", 3).otherwise(0)


def stage(health: ColumnLike) -> Column:
    h = _c(health)
    return (
        F.when(h >= 90, "Healthy").when(h >= 80, "Slight degradation").when(h >= 65, "Abnormal trajectory")
        .when(h >= 45, "Elevated risk").when(h >= 20, "Critical degradation").otherwise("Failure imminent")
    )


def trend_label(slope: ColumnLike, span: ColumnLike, points: ColumnLike) -> Column:
    s = _c(slope)
    return (
        F.when((_c(points) < 3) | (_c(span) < 0.5), "baseline").when(s <= -2, "deteriorating").when(s <= -0.5, "slowly deteriorating")
        .when(s >= 0.5, "improving").otherwise("stable")
    )


def exposure(risk: Column, weight: ColumnLike) -> Column:
    e = risk * _c(weight)
    return F.when(e < 0.04, "LOW").when(e < 0.15, "MEDIUM").otherwise("HIGH")


def drive_stats_counters(raw: ColumnLike) -> Column:
    """A drive's counters from a map of its raw attributes (smart_<id>_raw); packed bits are masked off."""
    m = _c(raw)
    v = lambda i: F.try_element_at(m, F.lit(f"smart_{i}_raw")).cast("double")
    low = lambda i, mask: v(i).cast("long").bitwiseAND(F.lit(mask)).cast("double")
    named = {
        "reallocated_sectors": v(5), "pending_sectors": v(197), "crc_errors": v(199), "uncorrectable_errors": F.greatest(v(187), v(198)),
        "spin_retries": v(10), "power_on_hours": low(9, 0xFFFFFFFF), "temperature_c": F.nullif(low(194, 0xFF), F.lit(0.0)),
    }
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in named)), F.array(*named.values()))
    return F.map_filter(pairs, lambda k, x: x.isNotNull())


def parse_answer(text: ColumnLike, channels: ColumnLike) -> Column:
    """The map of channel to pattern of a strict answer; null unless it names each channel once, with a known pattern."""
    entries = F.split(F.regexp_replace(F.trim(_c(text)), r"\.+$", ""), ";")
    pairs = F.transform(
        entries, lambda e: F.struct(F.trim(F.regexp_extract(e, r"(?s)^([^:]*):(.*)$", 1)).alias("c"), F.trim(F.regexp_extract(e, r"(?s)^([^:]*):(.*)$", 2)).alias("p"), e.contains(":").alias("ok"))
    )
    names = F.transform(pairs, lambda p: p["c"])
    channels = _c(channels)
    good = (
        F.forall(pairs, lambda p: p["ok"] & F.array_contains(channels, p["c"]) & p["p"].isin(*PATTERNS))
        & (F.size(F.array_distinct(names)) == F.size(names))
        & (F.size(names) == F.size(channels))
    )
    return F.when(good, F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["c"], p["p"]))))
