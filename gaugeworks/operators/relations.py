"""Joins, set operations, graph closure and interval unions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def members_of(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is listed. Spark broadcasts the list if statistics show it to be small."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def without(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def before_ticket(df: DataFrame, tickets: DataFrame, key: str, time: str, alarm: str) -> DataFrame:
    """Rows before the earliest ticket of their device, and all rows of devices without one; adds the alarm."""
    first = tickets.groupBy(key).agg(F.min(alarm).alias(alarm))
    return df.join(first, key, "left").where(F.col(alarm).isNull() | (F.col(time) < F.col(alarm)))


def _number(c: str, df: DataFrame) -> Column:
    """A time as a whole number: microseconds of timestamps, else the number itself."""
    return F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("long")


def within_scope(observations: DataFrame, tasks: DataFrame, key: str, offset: str, start: str, end: str, width: int = 21_600_000_000) -> DataFrame:
    """Observations in the half-open scope of a task of the same record.

    An observation lies in one bin of ``width`` units, a scope in those that it touches, and they
    meet by record and bin: candidates are the observations in scope and those of two bins
    at its ends, also where one record has most rows.
    """
    own = observations.withColumn("_bin", F.floor(_number(offset, observations) / width))
    touched = tasks.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(_number(start, tasks) / width), F.floor((_number(end, tasks) - 1) / width))))
    return own.join(touched, [key, "_bin"]).where((F.col(offset) >= F.col(start)) & (F.col(offset) < F.col(end))).drop("_bin")


def scope_totals(observations: DataFrame, tasks: DataFrame, task: str, key: str, offset: str, start: str, end: str, values: list[str], width: int = 21_600_000_000) -> DataFrame:
    """(task, n, values): how many observations a scope holds and the sums of their values, without forming pairs; tasks that hold none are left out.

    What lies before a time is the running sum of all whole bins of its record before it and,
    within its own bin, of the rows before it. A scope takes the difference of its two ends.
    Every window holds one bin's rows, or one row for each bin of a record.
    """
    sums = {"n": F.lit(1).cast("long"), **{v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}}
    own = observations.where(F.col(key).isNotNull() & F.col(offset).isNotNull()).select(F.col(key).alias("_key"), _number(offset, observations).alias("_t"), *(c.alias(f"_{k}") for k, c in sums.items()))
    ends = tasks.where(F.col(start) < F.col(end)).select(
        F.col(task).alias("_task"), F.col(key).alias("_key"), F.explode(F.array(F.struct(_number(start, tasks).alias("t"), F.lit(-1).alias("sign")), F.struct(_number(end, tasks).alias("t"), F.lit(1).alias("sign")))).alias("_e")
    ).select("_task", "_key", F.col("_e.t").alias("_t"), F.col("_e.sign").alias("_sign"))
    both = own.withColumns({"_task": F.lit(None).cast(tasks.schema[task].dataType), "_sign": F.lit(0)}).unionByName(ends, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_t") / width))
    before = Window.partitionBy("_key", "_bin").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)) for k in sums}).where("_sign <> 0")
    bins = both.groupBy("_key", "_bin").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    past = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = bins.select("_key", "_bin", *(F.coalesce(F.sum(f"_{k}").over(past), F.lit(0)).alias(f"_past_{k}") for k in sums))
    met = here.join(whole, ["_key", "_bin"])
    return met.groupBy(F.col("_task").alias(task)).agg(*(F.sum(F.col("_sign") * (F.col(f"_past_{k}") + F.col(f"_in_{k}"))).alias(k) for k in sums)).where("n > 0")


def task_records(tasks: DataFrame, records: DataFrame, annotations: DataFrame, record: str, kind: str, wanted: str, value: str) -> DataFrame:
    """Tasks with their record's columns and the value of its annotation of one kind; tasks without either are left out."""
    noted = annotations.where(F.col(kind) == wanted).select(record, value)
    return tasks.join(records, record).join(noted, record)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity; empty if both hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compare(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """(keys, copy, field, left, right): where two large tables differ; empty if they hold the same rows.

    Each side is read once for sums of hashes by bucket of the key and field, which don't hang on
    the order of rows. Only rows of buckets that differ are joined, by key and, of rows that
    repeat one, by their place among them; a row that a side lacks shows as the field "row".
    """
    fields = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have other columns")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    total = lambda *c: F.sum(F.xxhash64(*keys, *(F.to_json(F.struct(x)) for x in c)).cast("decimal(38,0)"))
    sums = lambda df: df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), *(total(f).alias(f"_{i}") for i, f in enumerate(fields)))
    left, right = sums(a), sums(b).withColumnsRenamed({"_n": "_m", **{f"_{i}": f"_r{i}" for i in range(len(fields))}})
    same = F.col("_n").eqNullSafe(F.col("_m"))
    for i in range(len(fields)):
        same &= F.col(f"_{i}").eqNullSafe(F.col(f"_r{i}"))
    odd = [r["_bucket"] for r in left.join(right, "_bucket", "full").where(~same).select("_bucket").collect()]  # ``buckets`` at most
    order = Window.partitionBy(*keys).orderBy(*(F.to_json(F.struct(f)) for f in fields)) if fields else Window.partitionBy(*keys).orderBy(F.lit(1))
    on = [*keys, "copy"]

    def some(df: DataFrame, side: str) -> DataFrame:
        """A side's rows of those buckets: its keys and copy under names of its own, and its fields as text."""
        own = df.where(bucket.isin(odd) if odd else F.lit(False)).withColumn("copy", F.row_number().over(order))
        values = F.struct(F.lit(True).alias("_there"), *(F.to_json(F.struct(F.col(f).alias("v"))).alias(f) for f in fields))
        return own.select(*(F.col(k).alias(f"{side}_{i}") for i, k in enumerate(on)), values.alias(side))

    alike = F.lit(True)
    for i in range(len(on)):
        alike &= F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}"))
    met = some(a, "l").join(some(b, "r"), alike, "full").select(*(F.coalesce(f"l_{i}", f"r_{i}").alias(k) for i, k in enumerate(on)), "l", "r")
    gone = F.col("l").isNull() | F.col("r").isNull()
    text = lambda side, f: F.get_json_object(F.col(f"{side}.{f}"), "$.v")
    shown = [F.when(gone, F.struct(F.lit("row").alias("field"), F.to_json("l").alias("left"), F.to_json("r").alias("right")))]
    shown += [F.when(~gone & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.struct(F.lit(f).alias("field"), text("l", f).alias("left"), text("r", f).alias("right"))) for f in fields]
    each = met.select(*keys, "copy", F.explode(F.filter(F.array(*shown), lambda x: x.isNotNull())).alias("d"))
    return each.select(*keys, "copy", "d.field", "d.left", "d.right")


def unused_after_release(all_rows: DataFrame, opened: DataFrame, key: str, expected: int | Column, groups: str, n_groups: int = 5) -> DataFrame:
    """What has not been opened; ids must be unique, the opened ones known, sizes add up and the groups number five.

    The checks are part of the plan: reading the rest fails where one does.
    """
    used = opened.select(key).distinct()
    rest = without(all_rows, used, key)
    facts = (
        all_rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("ids"))
        .crossJoin(without(used, all_rows, key).agg(F.count(F.lit(1)).alias("unknown")))
        .crossJoin(used.agg(F.count(F.lit(1)).alias("used")))
        .crossJoin(rest.agg(F.count(F.lit(1)).alias("left"), F.count_distinct(groups).alias("found")))
    )  # fmt: skip  (a row each)
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    fits = (F.col("total") == F.col("ids")) & (F.col("total") == expected) & (F.col("unknown") == 0)
    whole = (F.col("left") + F.col("used") == expected) & (F.col("found") == n_groups)
    known = F.when(~fits, F.raise_error(F.lit("the selection differs from its release"))).when(~whole, F.raise_error(F.lit("the unused rows don't complete the release"))).otherwise(F.lit(True))
    return rest.crossJoin(F.broadcast(facts.select(known.alias("_known")))).where("_known").drop("_known")


def peers(df: DataFrame, model: str, component: str, device: str, health: str) -> DataFrame:
    """For each row the upper median of its model's same component on all devices, how many share it, how many score under 80, and the shares above and below.

    Healths are counted first, each task for itself, and ranked as values: a group
    is as large as the number of different healths, whatever a model's devices.
    """
    keys, group = [model, component, health], Window.partitionBy(model, component)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(health))).withColumn("peers", F.sum("_n").over(group))
    middle = F.min(F.when(F.col("_upto") >= F.floor(F.col("peers") / 2) + 1, F.col(health))).over(group)
    known = ranked.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "peers", middle.alias("peer_median"), F.sum(F.when(F.col(health) < 80, F.col("_n")).otherwise(0)).over(group).alias("peers_under_80"), F.try_divide(F.col("peers") - F.col("_upto"), F.col("peers")).alias("share_above"), F.try_divide(F.col("_upto") - F.col("_n"), F.col("peers") - 1).alias("share_below"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return df.join(known, same[0] & same[1] & same[2]).drop("_0", "_1", "_2")


def association(findings: DataFrame, members: str, finding: str) -> DataFrame:
    """A row for each finding and member, with the other members."""
    return findings.withColumn("member", F.explode(members)).withColumn("others", F.array_remove(members, F.col("member"))).select(finding, "member", "others")


def merge_disks(listed: DataFrame, scanned: DataFrame, serial: str = "serial", place: str = "place") -> DataFrame:
    """Listed disks enriched by scanned ones: by serial (case and spaces aside), else by place among those left."""
    norm = lambda c: F.lower(F.trim(c))
    known = scanned.select(norm(F.col(serial)).alias("_s"), F.struct(*scanned.columns).alias("scan"))
    first = listed.withColumn("_s", norm(F.col(serial))).join(known, "_s", "left")
    used = first.where("scan is not null").select(F.col(f"scan.{place}").alias("_p"))
    free = scanned.select(F.col(place).alias("_p"), F.struct(*scanned.columns).alias("scan2")).join(used, "_p", "left_anti")
    return first.join(free, F.col(place) == F.col("_p"), "left").withColumn("scan", F.coalesce("scan", "scan2")).drop("_s", "_p", "scan2")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, group) of rows (label, name) that come by label and name: the SHA-256 of a label's distinct names, joined by a bar."""
    label, last, state = None, None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for at, name in zip(batch.column("label").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if at != label:
                if state:
                    done.append((label, state.hexdigest()))
                label, last, state = at, None, hashlib.sha256()
            if name != last:
                state.update((name if last is None else f"|{name}").encode())
                last = name
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["label", "group"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([state.hexdigest()], pa.string())], ["label", "group"])


def connected_groups(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(left, group): components of a bipartite graph; a group's name is the SHA-256 of its right ends, sorted and joined by a bar.

    The right ends of a component stream in order through one task, which carries the digest along
    and holds no more than a batch; nothing gathers a component in a row.
    """
    pairs = edges.select(F.concat(F.lit("d"), F.col(left).cast("string")).alias("d"), F.concat(F.lit("h"), F.col(right).cast("string")).alias("h")).where("d is not null and h is not null").distinct()
    labels = components(pairs, "d", "h")
    ends = labels.where("node like 'h%'").select("label", F.expr("substring(node, 2)").alias("name"))
    named = ends.repartition("label").sortWithinPartitions("label", "name").mapInArrow(_digests, "label string, group string")
    return labels.where("node like 'd%'").join(named, "label").select(F.expr("substring(node, 2)").alias(left), "group")


def union_of_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals that touch or overlap, merged: a new one begins where a start lies beyond the largest end so far."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def compute_intervals(events: DataFrame, by: str, now: Column) -> DataFrame:
    """(by, start, end, open): what start, stop and delete events (description, created_at, finished_at, code) add up to.

    A start opens an interval if none is open; a failed start is an interval of its
    own; only a finished, successful stop or delete closes. So an interval runs from
    the first good start after a close to the next close, or to ``now``.
    """
    order = Window.partitionBy(by).orderBy("created_at")
    finish = F.least(F.coalesce("finished_at", now), now)
    failed = F.coalesce(F.col("code") != 0, F.lit(False))
    begins = (F.col("description") == "Start Instance") & ~failed
    ends = F.col("description").isin("Stop Instance", "Delete Instance") & ~failed & F.col("finished_at").isNotNull()
    marked = events.withColumn("_finish", finish).withColumn("_begins", begins).withColumn("_ends", ends)
    epoch = marked.withColumn("_epoch", F.coalesce(F.sum(F.col("_ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = epoch.groupBy(by, "_epoch").agg(F.min(F.when(F.col("_begins"), F.col("created_at"))).alias("start"), F.max(F.when(F.col("_ends"), F.col("_finish"))).alias("_close"))
    # a close after which its epoch has no start closes nothing; a start in an epoch always precedes its close
    whole = runs.where("start is not null").select(by, "start", F.coalesce("_close", now).alias("end"), F.col("_close").isNull().alias("open"))
    tries = marked.where((F.col("description") == "Start Instance") & failed).select(by, F.col("created_at").alias("start"), F.col("_finish").alias("end"), F.lit(False).alias("open"))
    return whole.unionByName(tries)


def compute_cost(events: DataFrame, by: str, now: Column, rate: float, disk_rate: float, disk_created: Column) -> DataFrame:
    """Upper bounds of seconds and cost per instance, overlaps counted once."""
    rows = compute_intervals(events, by, now)
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    spent = union_of_intervals(rows, [by], "start", "end").groupBy(by).agg(F.sum(seconds(F.col("start"), F.col("end"))).alias("compute_seconds_upper"))
    gone = events.where((F.col("description") == "Delete Instance") & F.coalesce(F.col("code") == 0, F.lit(True)) & F.col("finished_at").isNotNull()).groupBy(by).agg(F.max(F.least("finished_at", now)).alias("_deleted"))
    open_ = rows.groupBy(by).agg(F.bool_or("open").alias("open_compute_interval"))
    out = events.select(by).distinct().join(spent, by, "left").join(gone, by, "left").join(open_, by, "left").na.fill({"compute_seconds_upper": 0.0, "open_compute_interval": False})
    disk = F.greatest(F.lit(0.0), seconds(disk_created, F.coalesce("_deleted", now)))
    money = lambda s, r: (s.cast("decimal(18,6)") * F.lit(str(r)).cast("decimal(12,6)") / F.lit(3600)).cast("double")
    out = out.withColumn("disk_seconds_upper", disk).withColumn("compute_usd_upper", money(F.col("compute_seconds_upper"), rate)).withColumn("disk_usd_upper", money(F.col("disk_seconds_upper"), disk_rate))
    return out.withColumn("total_usd_upper", F.col("compute_usd_upper") + F.col("disk_usd_upper")).drop("_deleted")


def ledger(costs: DataFrame, ceiling: float = 600.0) -> DataFrame:
    return costs.agg(F.sum("total_usd_upper").alias("total_usd_upper")).withColumn("remaining_usd", F.greatest(F.lit(0.0), F.lit(ceiling) - F.coalesce("total_usd_upper", F.lit(0.0))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return not a.select(key).intersect(b.select(key)).limit(1).count()
