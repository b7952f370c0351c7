"""Windows over ordered device histories, on flat rows.

Every operator partitions by device once; a window's rows carry a number of the
window, and arrays are built, if at all, in ``gather`` at the end, where a group
has as many rows as a window. Contiguity is an island number: a place on the
calendar less the row's rank is constant as long as no step is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import let, upper_median
from gaugeworks.spec import DAY_US, WINDOW


def last_report(df: DataFrame, by: str, time: str, period: int, *ties: str) -> DataFrame:
    """The last row of each device and period (in units of ``time``)."""
    order = Window.partitionBy(by, F.floor(F.col(time) / period)).orderBy(F.desc(time), *(F.desc(t) for t in ties))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tiles(df: DataFrame, by: list[str], order: list[str], size: int = WINDOW) -> DataFrame:
    """Fixed tiles by row number; adds ``tile`` and ``at`` (0 to size - 1), complete tiles only."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = df.withColumn("_n", rank).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    kept = numbered.where(F.col("_n") < F.floor(F.col("_all") / size) * size)
    return kept.withColumn("tile", F.floor(F.col("_n") / size).cast("long")).withColumn("at", (F.col("_n") % size).cast("int")).drop("_n", "_all")


def islands(df: DataFrame, by: str, step: Column) -> DataFrame:
    """Adds ``island`` and ``pos`` (from 1): runs of rows whose whole-number ``step`` rises by one."""
    order = Window.partitionBy(by).orderBy("_step")
    runs = df.withColumn("_step", step).withColumn("island", F.col("_step") - F.row_number().over(order))
    return runs.withColumn("pos", F.row_number().over(Window.partitionBy(by, "island").orderBy("_step"))).drop("_step")


def tumbling(df: DataFrame, by: str, step: Column, eligible: Column, size: int = WINDOW) -> DataFrame:
    """Gap-free windows that do not overlap: adds ``window`` (island, chunk) and ``at``.

    Rows that aren't eligible fall out first, so they break contiguity as gaps do.
    """
    run = islands(df.where(eligible), by, step)
    chunk = F.floor((F.col("pos") - 1) / size).cast("long")
    whole = F.count(F.lit(1)).over(Window.partitionBy(by, "island", "chunk"))
    full = run.withColumn("chunk", chunk).withColumn("_n", whole).where(F.col("_n") == size)
    return full.withColumn("at", ((F.col("pos") - 1) % size).cast("int")).withColumn("window", F.concat_ws("/", F.col("island").cast("string"), F.col("chunk").cast("string"))).drop("_n", "chunk", "island", "pos")


def before_failure(by: str, order: str, failed: Column) -> Column:
    """True for rows before a device's first failure; the failure's own row is none."""
    return F.coalesce(F.max(F.coalesce(failed, F.lit(False)).cast("int")).over(Window.partitionBy(by).orderBy(order)), F.lit(0)) == 0


def hdd_windows(df: DataFrame, by: str, day: str, failed: Column, first: str, last: str, size: int = WINDOW) -> DataFrame:
    """Tumbling daily windows before failure, within a closed interval of dates."""
    marked = df.withColumn("_ok", before_failure(by, day, failed) & F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return tumbling(marked, by, F.unix_date(day), F.col("_ok"), size).drop("_ok")


def component_windows(df: DataFrame, by: str, time_us: str, cadence_us: int, valid: Column, start_us: int, stop_us: int, size: int = WINDOW) -> DataFrame:
    """Tumbling windows at a cadence, of valid rows that are available (one cadence later) in [start, stop).

    A run goes on where a row comes one cadence after the row before it and both count; so it may begin at
    any time, and a row off the cadence ends a run and begins the next.
    """
    order = Window.partitionBy(by).orderBy(time_us)
    available = F.col(time_us) + cadence_us
    marked = df.withColumn("_ok", F.coalesce(valid, F.lit(False)) & (available >= start_us) & (available < stop_us))
    on = F.coalesce(F.lag("_ok").over(order), F.lit(False)) & (F.col(time_us) - F.lag(time_us).over(order) == cadence_us)
    runs = marked.withColumn("_new", (F.col("_ok") & ~on).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_ok")
    pos = runs.withColumn("_pos", F.row_number().over(Window.partitionBy(by, "_run").orderBy(time_us)) - 1).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(by, "_run")))
    full = pos.where(F.col("_pos") < F.floor(F.col("_len") / size) * size)
    window = F.concat_ws("/", F.col("_run").cast("string"), F.floor(F.col("_pos") / size).cast("string"))
    return full.withColumn("window", window).withColumn("at", (F.col("_pos") % size).cast("int")).drop("_ok", "_new", "_run", "_pos", "_len")


def rolling(df: DataFrame, by: str, step: Column, size: int = WINDOW, stride: int = 7) -> DataFrame:
    """Windows of ``size`` contiguous rows that end at every ``stride``-th row of a run, from the first full one (stride up to size).

    A row is in the windows that end within the next size - 1 rows of its run, so
    it is exploded to those ends: no join. Adds ``end_pos`` and ``at``.
    """
    run = islands(df, by, step).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(by, "island")))
    first = F.greatest(F.col("pos"), F.lit(size))
    first = first + F.pmod(-(first - size), F.lit(stride))
    ends = F.when(first <= F.least("_len", F.col("pos") + size - 1), F.sequence(first, F.least("_len", F.col("pos") + size - 1), F.lit(stride)))
    out = run.withColumn("end_pos", F.explode(ends))
    return out.withColumn("at", (F.col("pos") - F.col("end_pos") + size - 1).cast("int")).drop("_len", "pos")


def cutoffs(first: str, last: str, stride_days: int = 7) -> Column:
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {stride_days} days"))


def sliding(df: DataFrame, by: str, day: str, failed: Column, dates: Column, size: int = WINDOW) -> DataFrame:
    """The rows of windows of ``size`` days that end at given cut-offs; adds ``cutoff`` and ``at``.

    A window exists if its rows are each day of the calendar once and no failure
    was recorded up to the cut-off.
    """
    fail = F.min(F.when(failed, F.col(day))).over(Window.partitionBy(by))
    own = F.filter(dates, lambda c: (c >= F.col(day)) & (F.date_sub(c, size - 1) <= F.col(day)))
    rows = df.withColumn("_fail", fail).withColumn("cutoff", F.explode(own)).where(F.col("_fail").isNull() | (F.col("_fail") > F.col("cutoff")))
    per = Window.partitionBy(by, "cutoff")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_days", F.size(F.collect_set(day).over(per)))
    return counted.where((F.col("_n") == size) & (F.col("_days") == size)).withColumn("at", (F.datediff(day, "cutoff") + size - 1).cast("int")).drop("_n", "_days", "_fail")


def future_label(df: DataFrame, by: str, day: str, failed: Column, dates: Column, horizon: int = 7) -> DataFrame:
    """(by, cutoff, label): 1 for a failure within the horizon, 0 if all its days were observed, else null; null after a failure too."""
    base = df.groupBy(by).agg(F.min(F.when(failed, F.col(day))).alias("_fail"))
    grid = base.withColumn("cutoff", F.explode(dates))
    own = F.filter(dates, lambda c: (c < F.col(day)) & (F.date_add(c, horizon) >= F.col(day)))
    seen = df.withColumn("cutoff", F.explode(own)).groupBy(by, "cutoff").agg(F.count_distinct(day).alias("_days"), F.max(F.coalesce(failed, F.lit(False)).cast("int")).alias("_hit"))
    label = F.when(F.col("_fail") <= F.col("cutoff"), F.lit(None)).when(F.col("_hit") == 1, 1).when(F.col("_days") == horizon, 0)
    return grid.join(seen, [by, "cutoff"], "left").select(by, "cutoff", label.cast("int").alias("label"))


def greedy_stride(df: DataFrame, by: str, day: Column, candidate: Column, stride: int = 7) -> DataFrame:
    """(by, cutoff): candidate days, each at least ``stride`` after the one taken before it.

    What is taken depends on what was taken, so this folds over a device's sorted
    days; a device has as many of these as its history has days.
    """
    days = df.where(candidate).groupBy(by).agg(F.sort_array(F.collect_set(day)).alias("days"))
    none = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("taken"))

    def take(s: Column, d: Column) -> Column:
        go = s["last"].isNull() | (d - s["last"] >= stride)
        return F.struct(F.when(go, d).otherwise(s["last"]).alias("last"), F.when(go, F.array_append(s["taken"], d)).otherwise(s["taken"]).alias("taken"))

    return days.select(by, F.explode(F.aggregate(F.transform("days", lambda d: d.cast("bigint")), none, take)["taken"]).alias("cutoff"))


def zero_filled(ends: DataFrame, counts: DataFrame, by: str, day: str, values: list[str], size: int = WINDOW) -> DataFrame:
    """(by, cutoff, day, at, values): each day of the calendar before a cut-off, with 0 where nothing was counted."""
    grid = ends.withColumn(day, F.explode(F.sequence(F.col("cutoff") - (size - 1), F.col("cutoff"))))
    joined = grid.join(counts.select(by, F.col(day).cast("bigint").alias(day), *values), [by, day], "left")
    return joined.select(by, "cutoff", day, (F.col(day) - F.col("cutoff") + size - 1).cast("int").alias("at"), *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def gather(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per window with each value as an array in the order of ``at``."""
    rows = F.sort_array(F.collect_list(F.struct("at", *values)))
    packed = df.groupBy(*keys).agg(rows.alias("_rows"))
    each = lambda v: F.transform("_rows", lambda r: r[v]).alias(v)
    return packed.select(*keys, *(each(v) for v in values))


def history(df: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """One ordered list of structs per device (bounded by a device's own history)."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("history"))


# --- causal replay of scores


def counter_growth(df: DataFrame, by: str, time: str, value: str, most: int = 14) -> DataFrame:
    """Adds ``growth_delta``, ``growth_days``, ``grows``: against the earliest of the last ``most`` rows before this one."""
    before = Window.partitionBy(by).orderBy(time).rowsBetween(-most, -1)
    first = F.first(F.struct(time, value)).over(before)
    days = F.greatest(F.lit(0.5), (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(first[time].cast("timestamp"))) / float(DAY_US))
    delta = F.col(value) - first[value]
    out = df.withColumn("growth_delta", delta).withColumn("growth_days", days)
    return out.withColumn("grows", F.coalesce((F.col("growth_delta") > 0) & ((F.col("growth_delta") / F.col("growth_days") > 0.5) | (F.col("growth_delta") >= 5)), F.lit(False)))


def slope(points: Column) -> Column:
    """Least-squares slope of an array of structs (x, y); 0 for fewer than two or equal x."""
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))
    n = F.size(points)
    sums = lambda m: F.array(total(lambda p: (p["x"] - m[0]) * (p["x"] - m[0])), total(lambda p: (p["x"] - m[0]) * (p["y"] - m[1])))
    ratio = let(F.array(total(lambda p: p["x"]) / n, total(lambda p: p["y"]) / n), lambda m: let(sums(m), lambda s: F.when(s[0] == 0, 0.0).otherwise(s[1] / s[0])))
    return F.when(n < 2, 0.0).otherwise(ratio)


def trajectory(df: DataFrame, by: str, time: str, health: str) -> DataFrame:
    """Adds ``points``, ``span_days``, ``slope``, ``accelerating``, of all rows up to each one.

    The slope is over the last ten; a decline accelerates if the later half falls
    by more than 1 a day and by more than 1.5 times the earlier half. The halves'
    slopes come from running sums: those at the place in the middle, joined to
    each row, are the earlier half's, and what is beyond them the later half's.
    Slopes are rounded to nine digits, so that thresholds don't hang on the order
    of sums.
    """
    order = Window.partitionBy(by).orderBy(time, health)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    days = F.unix_micros(F.col(time).cast("timestamp")) / float(DAY_US)
    x, y = F.col("_x"), F.col(health).cast("double")
    base = df.withColumn("_x", days - F.first(days).over(upto)).withColumn("points", F.row_number().over(order))
    base = base.withColumns({"_s": F.struct(*(F.sum(v).over(upto).alias(k) for k, v in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("xy", x * y)))), "_recent": F.regr_slope(y, x).over(order.rowsBetween(-9, 0))})
    middle = base.select(F.col(by).alias("_by"), F.col("points").alias("_k"), F.col("_s").alias("_half"), F.lead("_s").over(order).alias("_next"))
    seen = base.join(middle, F.col(by).eqNullSafe(F.col("_by")) & (F.floor(F.col("points") / 2) == F.col("_k")), "left")
    return directed(seen).drop("_by", "_k")


def directed(seen: DataFrame) -> DataFrame:
    """``span_days``, ``slope`` and ``accelerating`` of rows with their running sums (``_s``), those at the place in the middle and at the next (``_half``, ``_next``)."""

    def fitted(s: Callable[[str], Column]) -> Column:
        spread = s("n") * s("xx") - s("x") * s("x")
        return F.round(F.when(spread > 1e-9, (s("n") * s("xy") - s("x") * s("y")) / spread).otherwise(0.0), 9)

    early, late = fitted(lambda k: F.col("_next")[k]), fitted(lambda k: F.col("_s")[k] - F.col("_half")[k])
    n, known = F.col("points"), (F.col("points") >= 3) & (F.col("_x") >= 0.5)
    return (
        seen.withColumn("span_days", F.when(n >= 3, F.col("_x")).otherwise(0.0)).withColumn("slope", F.when(known, F.coalesce(F.round("_recent", 9), F.lit(0.0))).otherwise(0.0))
        .withColumn("accelerating", F.coalesce(known & (late < -1.0) & (late < 1.5 * F.least(early, F.lit(-0.3))), F.lit(False))).drop("_x", "_s", "_recent", "_half", "_next")
    )


def baseline(df: DataFrame, by: str, order: str, value: str, first: int = 5) -> DataFrame:
    """(by, baseline): the upper median of the first known values."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    early = df.where(F.col(value).isNotNull()).withColumn("_n", rank).where(F.col("_n") <= first)
    return early.groupBy(by).agg(upper_median(F.collect_list(value)).alias("baseline"))


def first_onset(frames: DataFrame, by: str, order: str, health: str, level: str, signal: Column, least: int = 4) -> DataFrame:
    """The first frame with a signal that lies 4 below the baseline or above the first frame's status; devices with ``least`` frames."""
    w = Window.partitionBy(by)
    full = frames.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_first", F.first(level).over(w.orderBy(order))).where(F.col("_n") >= least)
    off = full.join(baseline(frames, by, order, health), by).where(signal & ((F.col(health) <= F.col("baseline") - 4) | (F.col(level) > F.col("_first"))))
    return off.withColumn("_k", F.row_number().over(w.orderBy(order))).where("_k = 1").drop("_k", "_n", "_first")


def escalations(frames: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """Frames whose level exceeds all before them (the first one sets the start)."""
    before = F.max(level).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("_before", before).where(F.col(level) > F.col("_before")).drop("_before")


def as_of(events: DataFrame, grid: DataFrame, by: str, time: str, at: str, values: list[str]) -> DataFrame:
    """``grid`` (by, at) with the values of the last event at or before ``at``: one pass over the union in time order."""
    both = events.select(by, F.col(time).alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_k")).unionByName(
        grid.select(by, F.col(at).alias("_t"), F.lit(None).cast(events.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.lit(1).alias("_k"))
    )
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy(by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where("_k = 1").select(by, F.col("_t").alias(at), *(F.col("_v")[v].alias(v) for v in values))
