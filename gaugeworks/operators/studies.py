"""Studies end to end: an adapter turns a history into window rows of one schema, and ``build`` labels them.

Window rows are flat: device, group_id, split, window, at (0 to size - 1), time_us
(when a value became known) and one column for each channel of the study. What a
row must hold to is a filter before runs are numbered, so a row that falls out
breaks a run as a missing one does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import exact_double, finite, salted_hash
from gaugeworks.spec import DAY_US, WINDOW, Study, micros

from . import features, quality, relations, sampling, windows


def names(study: Study) -> list[str]:
    return [c.name for c in study.channels]


def every(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def placed(rows: DataFrame, study: Study, group: str) -> DataFrame:
    """Adds ``split`` and its half-open bounds ``start_us`` and ``stop_us``, by declared groups or by the group's bucket."""
    rows = sampling.explicit_split(rows, group, study.group_splits) if study.group_splits else sampling.with_split(rows, group, study.salt, study.splits)
    bound = lambda end: F.coalesce(*(F.when(F.col("split") == s.name, F.lit(micros(getattr(s, end)))) for s in study.splits))
    return rows.withColumn("start_us", bound("start")).withColumn("stop_us", bound("stop"))


def chunked(rows: DataFrame, by: list[str], time: str, step: int, size: int = WINDOW) -> DataFrame:
    """Windows that do not overlap, of rows whose times differ by ``step``; adds ``window`` and ``at``. A run may begin at any time."""
    order = Window.partitionBy(*by).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(order) != step).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_run")
    at = runs.withColumn("_pos", F.row_number().over(run.orderBy(time)) - 1).withColumn("_len", F.count(F.lit(1)).over(run))
    kept = at.where(F.col("_pos") < F.floor(F.col("_len") / size) * size)
    window = F.concat_ws("/", F.col("_run").cast("string"), F.floor(F.col("_pos") / size).cast("string"))
    return kept.withColumn("window", window).withColumn("at", (F.col("_pos") % size).cast("int")).drop("_new", "_run", "_pos", "_len")


def window_rows(rows: DataFrame, study: Study) -> DataFrame:
    return rows.select("device", "group_id", "split", "window", "at", "time_us", *(F.col(c).cast("double").alias(c) for c in names(study)))


def _daily(rows: DataFrame, study: Study) -> DataFrame:
    """Adds what a daily row is judged by: ``time_us`` (the next midnight), ``in_time`` (within its split and before a failure) and ``valid``."""
    order = Window.partitionBy("device").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.coalesce(F.max(F.coalesce(F.col("failure"), F.lit(0))).over(order), F.lit(0)) == 1
    out = placed(rows, study, "device").withColumn("time_us", (F.unix_date("day").cast("long") + 1) * DAY_US)
    inside = (F.col("time_us") >= F.col("start_us")) & (F.col("time_us") < F.col("stop_us"))
    return out.withColumn("in_time", inside & ~failed).withColumn("valid", every([exact_double(c) for c in names(study)]))


def daily_windows(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Rows (device, day, failure, channels): tumbling windows; a failure ends a device, a row out of time or without a number ends a run."""
    ok = _daily(rows, study).where(F.col("in_time") & F.col("valid"))
    return window_rows(chunked(ok, ["device"], "time_us", DAY_US, size).withColumn("group_id", F.col("device")), study)


def daily_audit(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """(split, source_rows, rows_outside, rows_invalid, calendar_gaps, windows) of ``daily_windows``, in one aggregate.

    A gap counts where it interrupts a window: the row before it is part of one that isn't full yet.
    """
    order = Window.partitionBy("device").orderBy("time_us")
    marked = _daily(rows, study).withColumn("_row", F.row_number().over(order)).withColumn("_ok", F.col("in_time") & F.col("valid"))
    mine = Window.partitionBy("device", "_ok").orderBy("time_us")
    before = marked.withColumn("_gap", F.col("time_us") - F.lag("time_us").over(mine)).withColumn("_next", F.col("_row") - F.lag("_row").over(mine) == 1)
    runs = before.withColumn("_run", F.sum(F.coalesce((F.col("_gap") != DAY_US).cast("int"), F.lit(1))).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    pos = runs.withColumn("_pos", F.row_number().over(Window.partitionBy("device", "_ok", "_run").orderBy("time_us")))
    open_ = pos.withColumn("_open", F.lag(F.col("_pos") % size != 0).over(mine))
    return open_.groupBy("split").agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(~F.col("in_time")).alias("rows_outside"), F.count_if(F.col("in_time") & ~F.col("valid")).alias("rows_invalid"),
        F.count_if(F.col("_ok") & (F.col("_gap") != DAY_US) & F.col("_next") & F.col("_open")).alias("calendar_gaps"), F.count_if(F.col("_ok") & (F.col("_pos") % size == 0)).alias("windows"),
    )


def segments(rows: DataFrame, by: list[str], time: str, step: int, ok: Column, size: int = WINDOW) -> DataFrame:
    """All rows with ``_ok`` and, for those that are, ``_run`` and ``_pos`` (from 0) in their run; ``_gap`` marks one that a wrong step cuts off a window that isn't full yet.

    A row that isn't ok ends a run wherever its time lies, and so does a step of another length.
    Times that repeat or that aren't known are fatal.
    """
    order = Window.partitionBy(*by).orderBy(time)
    since = F.col(time) - F.lag(time).over(order)
    strict = F.when((since <= 0) | F.col(time).isNull(), F.raise_error(F.lit("times of a device repeat or lack")).cast("bigint")).otherwise(since)
    seen = rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_step", strict).withColumn("_before", F.coalesce(F.lag("_ok").over(order), F.lit(False)))
    new = F.col("_ok") & ~(F.col("_before") & (F.col("_step") == step))
    runs = seen.withColumn("_new", new).withColumn("_run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_run", "_ok")
    placed_ = runs.withColumn("_pos", F.row_number().over(run.orderBy(time)) - 1)
    open_ = F.lag((F.col("_pos") + 1) % size != 0).over(order)
    return placed_.withColumn("_gap", F.col("_new") & F.col("_before") & F.coalesce(open_, F.lit(False))).drop("_step", "_before", "_new")


def whole(marked: DataFrame, by: list[str], size: int = WINDOW) -> DataFrame:
    """The rows of ``segments`` that fill a window, with ``window`` and ``at``."""
    cut = marked.where("_ok").withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))).where(F.col("_pos") < F.floor(F.col("_len") / size) * size)
    window = F.concat_ws("/", F.col("_run").cast("string"), F.floor(F.col("_pos") / size).cast("string"))
    return cut.withColumn("window", window).withColumn("at", (F.col("_pos") % size).cast("int")).drop("_ok", "_run", "_pos", "_gap", "_len")


def counters(marked: DataFrame, by: list[str], size: int = WINDOW) -> DataFrame:
    """(split, source_rows, excluded_rows, calendar_gaps, windows, short_rows) of ``segments``: short rows are ok but in no window."""
    one = marked.groupBy("split", *by, "_run", "_ok").agg(F.count(F.lit(1)).alias("n"), F.count_if("_gap").alias("gaps"))
    ok = lambda c: F.coalesce(F.sum(F.when(F.col("_ok"), c)), F.lit(0))
    return one.groupBy("split").agg(
        F.sum("n").alias("source_rows"), F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("n"))), F.lit(0)).alias("excluded_rows"), F.sum("gaps").alias("calendar_gaps"),
        ok(F.floor(F.col("n") / size)).alias("windows"), ok(F.col("n") % size).alias("short_rows"),
    )


def industrial(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Rows (device, group_id, time_us, channels, observed) as ``segments``: a row counts that was observed, within its split's time, with finite values."""
    known = placed(rows.withColumn("group_id", F.col("group_id").cast("string")), study, "group_id")
    inside = (F.col("time_us") >= F.col("start_us")) & (F.col("time_us") < F.col("stop_us"))
    ok = inside & F.col("observed") & every([F.coalesce(finite(F.col(c).cast("double")), F.lit(False)) for c in names(study)])
    return segments(known, ["device"], "time_us", study.cadence_us, ok, size)


def industrial_windows(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    return window_rows(whole(industrial(rows, study, size), ["device"], size), study)


def industrial_audit(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    return counters(industrial(rows, study, size), ["device"], size)


def turbine_rows(files: DataFrame, study: Study, time: str, provider: str, years: dict[str, int]) -> DataFrame:
    """Rows of ``readers.turbine_files`` for ``industrial``: known at the end of their interval, of the units that the study declares.

    ``years`` says which year's files a split takes: others are left out whole.
    """
    group = F.concat(F.lit(f"{provider}:"), F.col("site"), F.lit(":"), F.col("unit").cast("int").cast("string"))
    kept = sampling.explicit_split(files.withColumn("group_id", group), "group_id", study.group_splits)
    wanted = F.coalesce(*(F.when(F.col("split") == s, F.lit(y)) for s, y in years.items()))
    rows = kept.where(F.col("year") == wanted)
    us = F.unix_micros(F.to_timestamp(time)) + study.cadence_us
    return rows.select(F.concat("group_id", F.lit(f":{study.name}")).alias("device"), "group_id", us.alias("time_us"), F.lit(True).alias("observed"), *names(study))


def valve_rows(wide: DataFrame, study: Study, group: Column, variables: dict[str, str], low: float = 0.0, high: float = 800.0) -> DataFrame:
    """Rows of ``readers.wide_devices`` (time, device, channel, value, qc) for ``industrial``: a time counts if all channels were observed and the first lies in its range.

    ``time`` is text with an offset from UTC: one without is fatal.
    """
    zoned = F.col("time").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    at = F.when(zoned, F.to_timestamp("time")).otherwise(F.raise_error(F.concat(F.lit("a time lacks its offset: "), F.coalesce("time", F.lit("null")))).cast("timestamp"))
    own = wide.where(F.col("channel").isin(*variables)).withColumn("time_us", F.unix_micros(at) + study.cadence_us).withColumn("group_id", group)
    first = names(study)[0]
    of = {name: source for source, name in variables.items()}
    value = lambda c: F.max(F.when(F.col("channel") == of[c], F.col("value"))).alias(c)
    seen = F.coalesce(F.bool_and(F.col("qc") == "observed"), F.lit(False)) & (F.count(F.lit(1)) == len(variables))
    rows = own.groupBy(F.concat_ws(":", "group_id", "device").alias("device"), "group_id", "time_us").agg(*(value(c) for c in names(study)), seen.alias("_seen"))
    return rows.withColumn("observed", F.col("_seen") & F.coalesce(F.col(first).between(low, high), F.lit(False))).drop("_seen")


def drives(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Rows (device, model, day, failure, channels) as ``segments`` of a drive's days: within its split's dates, both ends included, and before its first failure."""
    by = ["device", "model"]
    order = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.coalesce(F.max((F.col("failure") == 1).cast("int")).over(order), F.lit(0)) == 1
    split = sampling.with_split(rows.withColumn("device", F.col("device").cast("string")), "device", study.salt, study.splits)
    end = lambda e: F.coalesce(*(F.when(F.col("split") == s.name, F.lit(getattr(s, e)).cast("date")) for s in study.splits))
    marked = split.withColumn("time_us", (F.unix_date("day").cast("long") + 1) * DAY_US)
    return segments(marked.withColumn("_fine", ~failed & F.col("day").between(end("start"), end("stop"))), by, "time_us", DAY_US, F.col("_fine"), size).drop("_fine")


def drive_windows(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Windows of ``drives``; a channel may lack values."""
    cut = whole(drives(rows, study, size), ["device", "model"], size)
    return window_rows(cut.withColumn("group_id", F.col("device")).withColumn("window", F.concat_ws("/", "model", "window")), study)


def drive_audit(rows: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    return counters(drives(rows, study, size), ["device", "model"], size)


def clips(files: DataFrame, study: Study, folder: str, member: str = "member", size: str = "length", least: int = 320_000, most: int = 400_000) -> DataFrame:
    """Adds ``group_id``, ``split`` and ``taken`` to clips by their names: <folder>/<train or test>/<normal or anomaly>_id_<machine>_<number>.wav.

    Another name, or a size outside the bounds, is fatal. Training and validation machines take normal
    clips of the train folder alone.
    """
    pattern = rf"^{folder}/(train|test)/(normal|anomaly)_id_(0[0-6])_[0-9]{{8}}\.wav$"
    part = lambda i: F.regexp_extract(member, pattern, i)
    fault = F.when(part(3) == "", F.raise_error(F.concat(F.lit("an unexpected clip: "), F.col(member)))).when(~F.col(size).between(least, most), F.raise_error(F.concat(F.lit("a clip's size is out of bounds: "), F.col(member))))
    group = F.coalesce(fault.cast("string"), F.concat(F.lit(f"dcase-{folder}:"), part(3)))
    known = sampling.explicit_split(files.withColumn("group_id", group), "group_id", study.group_splits)
    return known.withColumn("taken", ~F.col("split").isin("train", "validation") | (part(1) == "train") & (part(2) == "normal"))


def clip_windows(frames: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Frames (recording, group_id, times_us, channels) of clips as windows: tiles from a clip's start, whole ones only. Times are offsets in the clip."""
    tiled = windows.tiles(placed(frames, study, "group_id"), ["recording"], ["times_us"], size)
    return window_rows(tiled.withColumn("device", F.concat(F.lit("clip:"), F.col("recording").cast("string"))).withColumn("time_us", F.col("times_us")).withColumn("window", F.col("tile").cast("string")), study)


def _most(limits: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col("split") == s, F.lit(n)) for s, n in limits.items()), F.lit(0))


def tile_windows(rows: DataFrame, study: Study, limits: dict[str, int], salt: str, size: int = WINDOW) -> DataFrame:
    """Rows (host, day, time_us, channels): fixed tiles of a host's day, sampled by hash first, judged after.

    So a tile with a gap still takes one of the day's places. Times that repeat are fatal.
    """
    day = Window.partitionBy("host", "day")
    tile = Window.partitionBy("host", "day", "tile")
    tiles = windows.tiles(placed(rows, study, "host"), ["host", "day"], ["time_us"], size)
    step = F.col("time_us") - F.lag("time_us").over(day.orderBy("tile", "at"))
    strict = F.when(step <= 0, F.raise_error(F.lit("times of a host repeat")).cast("bigint")).otherwise(step)
    known = tiles.withColumn("_step", strict).withColumn("_first", F.min("time_us").over(tile)).withColumn("_last", F.max("time_us").over(tile))
    key = salted_hash(salt, F.concat_ws(":", F.col("host").cast("string"), F.col("_first").cast("string")))
    drawn = known.withColumn("_key", key).withColumn("_place", F.dense_rank().over(day.orderBy("_key", "_first"))).where(F.col("_place") <= _most(limits))
    good = ((F.col("at") == 0) | (F.col("_step") == study.cadence_us)) & every([finite(F.col(c).cast("double")) for c in names(study)])
    whole = drawn.withColumn("_good", F.bool_and(F.coalesce(good, F.lit(False))).over(tile)).where(F.col("_good") & (F.col("_first") >= F.col("start_us")) & (F.col("_last") < F.col("stop_us")))
    window = F.concat_ws("/", F.col("day").cast("string"), F.col("tile").cast("string"))
    return window_rows(whole.withColumn("device", F.col("host").cast("string")).withColumn("group_id", F.col("device")).withColumn("window", window), study)


def module_windows(rows: DataFrame, study: Study, limits: dict[str, int], salt: str, low: float = 0.0, high: float = 100_000.0, size: int = WINDOW, ranged: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (group_id, module, time_us, channels): tumbling windows of valid rows of each module, then the first of them by hash.

    All channels must be finite, and those in ``ranged`` (all, if None) from ``low`` to ``high``.
    """
    bounded = names(study) if ranged is None else ranged
    in_range = every([F.coalesce(finite(F.col(c).cast("double")) & (F.col(c).between(low, high) if c in bounded else F.lit(True)), F.lit(False)) for c in names(study)])
    ok = placed(rows, study, "group_id").where((F.col("time_us") >= F.col("start_us")) & (F.col("time_us") < F.col("stop_us")) & in_range)
    one = Window.partitionBy("group_id", "module")
    cut = chunked(ok, ["group_id", "module"], "time_us", study.cadence_us, size).withColumn("_first", F.min("time_us").over(Window.partitionBy("group_id", "module", "window")))
    key = salted_hash(salt, F.concat_ws(":", F.col("group_id").cast("string"), F.col("module").cast("string"), F.col("_first").cast("string")))
    drawn = cut.withColumn("_key", key).withColumn("_place", F.dense_rank().over(one.orderBy("_key", "_first"))).where(F.col("_place") <= _most(limits))
    return window_rows(drawn.withColumn("device", F.concat_ws(":", F.col("group_id").cast("string"), F.col("module").cast("string"))), study)


def report_windows(reports: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Reports (device, host, model, time_us, channels): the last one of a day, rolling windows at the study's stride.

    Devices that share a host, however indirectly, are one group and have one split.
    Devices with two models, or with two readings of one time, are left out.
    """
    two = quality.changing(reports, "device", "model").select("device").unionByName(quality.conflicting(reports, ["device", "time_us"], names(study)).select("device"))
    groups = relations.connected_groups(reports.select("device", "host").distinct(), "device", "host")
    last = windows.last_report(relations.without(reports, two.distinct(), "device"), "device", "time_us", DAY_US, "host").withColumn("_day", F.floor(F.col("time_us") / DAY_US).cast("long"))
    known = placed(last.withColumn("device", F.col("device").cast("string")).join(groups.withColumnRenamed("group", "group_id"), "device"), study, "group_id")
    known = known.withColumn("time_us", (F.col("_day") + 1) * DAY_US).where((F.col("time_us") >= F.col("start_us")) & (F.col("time_us") < F.col("stop_us")))
    rolled = windows.rolling(known, "device", F.col("_day"), size, study.stride)
    return window_rows(rolled.withColumn("window", F.concat_ws("/", F.col("island").cast("string"), F.col("end_pos").cast("string"))), study)


def error_days(logs: DataFrame, tickets: DataFrame, kinds: dict[str, str], era: tuple[int, int] = (1_600_000_000, 1_800_000_000)) -> DataFrame:
    """Logs (device, time_s, kind) before a device's ticket (device, alarm_s): (device, day, a count for each kind, others, first_log, alarm_s).

    A time outside the era, or a row without time or kind, is fatal.
    """
    sound = F.col("time_s").between(*era) & F.col("kind").isNotNull()
    checked = logs.withColumn("time_s", F.when(sound, F.col("time_s")).otherwise(F.raise_error(F.lit("a log row lacks a kind or a time of its era")).cast("bigint")))
    valid = relations.before_ticket(checked, tickets, "device", "time_s", "alarm_s")
    counted = {c: F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()}
    days = valid.groupBy("device", F.floor(F.col("time_s") / 86_400).cast("long").alias("day")).agg(*counted.values(), F.count_if(~F.col("kind").isin(*kinds.values())).alias("others"), F.min("time_s").alias("first_log"), F.min("alarm_s").alias("alarm_s"))
    return days.withColumn("first_log", F.min("first_log").over(Window.partitionBy("device")))


def error_windows(days: DataFrame, study: Study, size: int = WINDOW) -> DataFrame:
    """Rows of ``error_days``: calendar windows, zero where nothing was counted, that end on days with errors, a stride or more apart.

    A window's first value must be known no earlier than the first log, its last before the ticket, and all within the split.
    """
    cutoff, origin = (F.col("day") + 1) * DAY_US, (F.col("day") - (size - 2)) * DAY_US
    some = reduce(lambda a, b: a + b, [F.col(c) for c in names(study)]) > 0
    inside = (origin >= F.col("start_us")) & (origin <= cutoff) & (cutoff < F.col("stop_us")) & (origin >= F.col("first_log") * 1_000_000)
    fits = some & inside & (F.col("alarm_s").isNull() | (cutoff < F.col("alarm_s") * 1_000_000))
    ends = windows.greedy_stride(placed(days, study, "device"), "device", F.col("day"), fits, study.stride)
    filled = placed(windows.zero_filled(ends, days, "device", "day", names(study), size), study, "device")
    return window_rows(filled.withColumn("time_us", (F.col("day") + 1) * DAY_US).withColumn("window", F.col("cutoff").cast("string")).withColumn("group_id", F.col("device")), study)


def build(rows: DataFrame, study: Study, version: str) -> DataFrame:
    """An adapter's window rows as labelled windows: one row with times, channels, values, task_id and target each."""
    packed = windows.gather(rows, ["device", "group_id", "split", "window"], ["time_us", *names(study)])
    wide = packed.select(F.col("device").cast("string").alias("device"), F.col("group_id").cast("string").alias("group_id"), "split", F.col("time_us").alias("times_us"), F.array(*map(F.lit, names(study))).alias("channels"), F.array(*names(study)).alias("values"))
    return features.labelled(wide, study, version)


def support(built: DataFrame) -> DataFrame:
    """(split, pattern, windows): how often each channel pattern occurs in each split."""
    each = built.select("split", F.explode(F.split(F.regexp_replace("target", r"\.$", ""), "; ")).alias("entry"))
    return each.groupBy("split", F.regexp_extract("entry", "^[^:]*: (.*)$", 1).alias("pattern")).agg(F.count(F.lit(1)).alias("windows"))
