"""Fleet scoring kept in state: a run that arrives is scored from what its component's state holds, without a replay.

State per device and component: the counters of the last 14 runs, the last ten points of
health, running sums of all points and of the earlier half, and the points of the later
half in map state, in blocks of ``BLOCK``. A new point moves one point at most from the later half to the
earlier, so that a run costs the same whatever the history, and runs that are taken together read and write a block once. What goes before (rules on
a run) and after (status, risk, priority) is row by row and the same as in the batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators import fleet, windows

from .jobs import InOrder, drop_version, in_order

DAY_US = 86_400_000_000.0
MOST_METRICS, RECENT, BLOCK = 14, 10, 64
REST = ("label", "site", "rack", "slot", "criticality", "source", "type", "name", "redundancy", "signals", "evidence")


def half_up(x: float, digits: int) -> float:
    """As Spark rounds a double: its shortest decimal form, halves away from zero."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def fitted(n: float, x: float, y: float, xx: float, xy: float) -> float:
    spread = n * xx - x * x
    return half_up((n * xy - x * y) / spread, 9) if spread > 1e-9 else 0.0


def recent_slope(xs: list[float], ys: list[float]) -> float:
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    spread = sum((x - mx) ** 2 for x in xs)
    return half_up(sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / spread, 9) if spread else 0.0


class FleetScores(InOrder):
    """Growth, health and trajectory of a component's runs in the order of their times."""

    fields = {"t": "long", "penalty": "double", "metrics": "string", "rest": "string"}
    output = {
        "device": "string", "component": "string", "kind": "string", "t": "long", "rest": "string", "more": "string", "health": "double",
        "points": "long", "span_days": "double", "slope": "double", "accelerating": "boolean",
    }
    cadence = 0

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getValueState("counted", "t array<long>, metrics array<string>")
        self.line = handle.getValueState("line", "first double, n long, early_n long, sums array<double>, early array<double>, xs array<double>, ys array<double>")
        self.later = handle.getMapState("later", "block long", "x array<double>, y array<double>")

    def take(self, key, rows: list[tuple]) -> list[tuple]:
        times, metrics = map(list, self.counted.get() or ([], []))
        first, n, early_n, *lists = self.line.get() or (None, 0, 0, [0.0] * 4, [0.0] * 4, [], [])
        sums, early, xs, ys = map(list, lists)
        oldest, newest, blocks, grown = early_n // BLOCK, (n - 1) // BLOCK, {}, set()

        def block(of: int) -> tuple[list, list]:
            if of not in blocks:
                blocks[of] = tuple(map(list, self.later.getValue((of,)))) if of <= newest else ([], [])
            return blocks[of]

        def point(place: int) -> tuple[float, float]:
            x, y = block((place - 1) // BLOCK)
            return x[(place - 1) % BLOCK], y[(place - 1) % BLOCK]

        out = []
        for t, penalty, own, rest in rows:
            more, cost = [], penalty
            if times:
                days, before, now = max(0.5, (t - times[0]) / DAY_US), json.loads(metrics[0]), json.loads(own)
                for k, v in now.items():
                    delta = v - before[k] if k in before else 0.0
                    if delta > 0 and (delta / days > 0.5 or delta >= 5):
                        points = min(15.0, fleet.GROWTH[k] * (3 + 2.5 * math.log2(1 + max(0.0, delta / days))))
                        more.append({"signal": f"{fleet.GROWTH_LABEL[k]} growth", "points": points})
                        cost += points
            times, metrics = [*times, t][-MOST_METRICS:], [*metrics, own][-MOST_METRICS:]
            health = half_up(max(1.0, 100 * math.exp(-cost / 85)), 1)
            at = t / DAY_US
            first = at if first is None else first
            x, n = at - first, n + 1
            sums = [s + v for s, v in zip(sums, (x, health, x * x, x * health), strict=True)]
            xs, ys = [*xs, x][-RECENT:], [*ys, health][-RECENT:]
            for held, value in zip(block((n - 1) // BLOCK), (x, health), strict=True):
                held.append(value)
            grown.add((n - 1) // BLOCK)
            if n // 2 > early_n:
                early_n += 1
                px, py = point(early_n)
                early = [s + v for s, v in zip(early, (px, py, px * px, px * py), strict=True)]
            known = n >= 3 and x >= 0.5
            slope, accelerating = 0.0, False
            if known:
                slope = recent_slope(xs, ys)
                nx, ny = point(early_n + 1)  # the earlier half ends with the point in the middle
                start = fitted(early_n + 1.0, *(s + v for s, v in zip(early, (nx, ny, nx * nx, nx * ny), strict=True)))
                late = fitted(float(n - early_n), *(s - v for s, v in zip(sums, early, strict=True)))
                accelerating = late < -1.0 and late < 1.5 * min(start, -0.3)
            out.append((*key, "scored", t, rest, json.dumps(more), health, n, x if n >= 3 else 0.0, slope, accelerating))
        # a block goes when its last point is in the earlier half
        for of in range(oldest, early_n // BLOCK):
            if of <= newest:
                self.later.removeKey((of,))
        for of in grown:
            if of >= early_n // BLOCK:
                self.later.updateValue((of,), blocks[of])
        self.counted.update((times, metrics))
        self.line.update((first, n, early_n, sums, early, xs, ys))
        return out


def analyse(runs: DataFrame, delay: str) -> DataFrame:
    """``fleet.analyse`` of a stream of runs whose rows come up to ``delay`` late, with ``kind``: scored, or late or repeated with no more than key and time.

    A run is given out when the watermark, which follows the runs that have components, has passed it.
    """
    found = fleet.findings(fleet.components(runs))
    rows = found.select("device", "component", "t", fleet.penalty().alias("penalty"), F.to_json("metrics").alias("metrics"), F.to_json(F.struct(*REST)).alias("rest"))
    kinds = {c: found.schema[c].dataType for c in REST}
    scored = in_order(rows, ["device", "component"], "t", delay, FleetScores())
    rest = F.from_json("rest", ", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()))
    more = F.from_json("more", kinds["evidence"].simpleString())
    opened = scored.withColumn("_r", rest).select(
        "device", "component", "kind", F.timestamp_micros("t").alias("t"), *(F.col(f"_r.{c}").alias(c) for c in REST if c != "evidence"), F.concat("_r.evidence", more).alias("evidence"), "health", "points", "span_days", "slope", "accelerating"
    )
    return fleet.concluded(opened)


KEY = ("device", "component")
SUMS = ("n", "x", "y", "xx", "xy")
STATE = "health double, points long, first double, _s struct<n:double,x:double,y:double,xx:double,xy:double>"


def _continued(taken: DataFrame, kept: DataFrame | None) -> DataFrame:
    """``taken`` runs with their health, place, sums and recent slope, as they go on from ``kept`` ones, which are among the rows: ``new`` tells them apart.

    Of each key the last kept run has the sums of all before it, so that sums add up in the same order as over the whole history.
    """
    fresh = taken.withColumn("new", F.lit(True)).withColumns({c.split()[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in STATE.split(", ")})
    rows = fresh.unionByName(kept.withColumn("new", F.lit(False)), allowMissingColumns=True) if kept is not None else fresh
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)))
    order = Window.partitionBy(*KEY).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    new, days = F.col("new"), F.unix_micros("t") / DAY_US
    scored = fleet.growth(rows, new).withColumn("health", F.when(new, fleet.healthy()).otherwise(F.col("health")))
    last = F.coalesce(F.col("points") == F.max("points").over(Window.partitionBy(*KEY)), F.lit(False))
    placed = scored.withColumns({"_last": last, "first": F.first(F.coalesce("first", days)).over(upto)}).withColumn("_x", days - F.col("first"))
    x, y = F.col("_x"), F.col("health")
    term = dict(zip(SUMS, (F.lit(1.0), x, y, x * x, x * y), strict=True))
    sums = F.struct(*(F.sum(F.when(new, v).when(F.col("_last"), F.col("_s")[k])).over(upto).alias(k) for k, v in term.items()))
    place = F.coalesce("points", F.coalesce(F.max("points").over(upto), F.lit(0)) + F.sum(new.cast("int")).over(upto))
    done = placed.withColumns({"points": place, "_s": F.when(new, sums).otherwise(F.col("_s")), "_recent": F.regr_slope(y, x).over(order.rowsBetween(-9, 0))})
    n = F.max("points").over(Window.partitionBy(*KEY))
    keep = F.col("points") >= F.least(F.floor((n + 1) / 2), n - (MOST_METRICS - 1))
    return done.withColumns({"_next": F.lead("_s").over(order), "keep": keep}).drop("_last")


def score(runs: DataFrame, delay_ms: int, path: str, folder: str, checkpoint: str, shown: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Writes ``shown`` of what ``analyse`` gives for a stream of runs, all that is there now, by batch; a batch that runs again replaces its own rows.

    ``folder`` has, by version, the runs that wait, those that are kept and the watermark: a batch
    goes on from the version before and writes its own. A run is given out by the batch that moves the watermark past it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = lambda name, e: f"{folder}/{name}/version={e}"
        known = spark.read.schema("passed long").parquet(at("passed", epoch - 1)).first()[0] if epoch else 0
        newest = batch.where("size(components) > 0").agg(F.unix_micros(F.max("collected_at"))).first()[0]
        passed = known if newest is None else max(known, (newest // 1000 - delay_ms) * 1000)
        spark.range(1).select(F.lit(passed).cast("long").alias("passed")).write.mode("overwrite").parquet(at("passed", epoch))

        found = fleet.findings(fleet.components(batch))
        us = F.unix_micros("t")
        kind = F.when(F.coalesce(us <= known, F.lit(True)), "late").when(us <= passed, "due").otherwise("waiting")
        arrived = found.withColumn("kind", kind)
        if epoch:
            waited = spark.read.schema(arrived.schema).parquet(at("arrived", epoch - 1)).where("kind = 'waiting'")
            arrived = arrived.unionByName(waited.withColumn("kind", kind))
        arrived.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(at("arrived", epoch))
        arrived = spark.read.schema(arrived.schema).parquet(at("arrived", epoch))

        # of runs of one time the least is taken; its text is made only where there are several
        one = Window.partitionBy(*KEY, "t")
        text = lambda c: F.when(F.col("_many") > 1, F.to_json(c))
        due = arrived.where("kind = 'due'").drop("kind").withColumn("_many", F.count(F.lit(1)).over(one))
        taken = due.withColumn("_k", F.row_number().over(one.orderBy(fleet.penalty(), text("metrics"), text(F.struct(*REST))))).where("_k = 1").drop("_k", "_many")
        held = ", ".join(["device string, component string, t timestamp, metrics map<string,double>", STATE])
        kept = spark.read.schema(f"{held}, keep boolean").parquet(at("runs", epoch - 1)).where("keep").drop("keep") if epoch else None
        done = _continued(taken, kept)
        done.write.mode("overwrite").option("compression", "zstd").parquet(at("runs", epoch))
        done = spark.read.schema(done.schema).parquet(at("runs", epoch))

        middle = done.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("points").alias("_k"), F.col("_s").alias("_half"), "_next")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
        seen = done.where("new").drop("_next", "keep", "new", "first").join(middle, [*same, F.floor(F.col("points") / 2) == F.col("_k")], "left")
        scored = windows.directed(seen).drop("_k", *(f"_{c}" for c in KEY)).withColumn("kind", F.lit("scored"))
        late = arrived.where("kind = 'late'").select(*KEY, "t", "kind")
        again = arrived.where("kind = 'due'").groupBy(*KEY, "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_i", F.explode(F.sequence(F.lit(2), "n"))).select(*KEY, "t", F.lit("repeated").alias("kind"))
        out = shown(fleet.concluded(scored.unionByName(late.unionByName(again), allowMissingColumns=True)))
        out.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        for name in ("passed", "arrived", "runs"):
            drop_version(spark, f"{folder}/{name}", epoch - 2)

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
