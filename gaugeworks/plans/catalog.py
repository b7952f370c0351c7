"""The registered queries: each applies library operators to the shared tables, next to SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import evaluation, features, quality, relations, sampling, windows
from gaugeworks.session import table
from gaugeworks.spec import PATTERNS, Channel, Study, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


CASE = "CASE {c} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END"
TILES = """
WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
g AS (SELECT user_id, n // 28 AS tile, list(value ORDER BY n) AS v, max(ts) AS last_ts FROM r GROUP BY user_id, n // 28 HAVING count(*) = 28),
m AS (SELECT *, list_max(v) - list_min(v) AS span, list_sort(v[22:28])[4] - list_sort(v[1:7])[4] AS change FROM g),
t AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN change >= greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 1
      WHEN change <= -greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 2 ELSE 3 END AS code FROM m)
"""
DAILY = "WITH d AS (SELECT user_id, ts::DATE AS dt, avg(value) AS v, max((value >= 250)::INT) AS failure, count(*) AS n FROM events GROUP BY user_id, ts::DATE)"


def tiled(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of 28 events per user as arrays, with the pattern's code."""
    rows = windows.tiles(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    return windows.gather(rows, ["user_id", "tile"], ["value", "ts"]).withColumn("code", S.trend_code("value"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.avg("value").alias("v"), F.max((F.col("value") >= 250).cast("int")).alias("failure"), F.count(F.lit(1)).alias("n"))


# --- tiles, labels and features


@query(TILES + f"SELECT user_id, tile, {CASE.format(c='code')} AS pattern FROM t")
def tile_labels(spark, sf):
    return tiled(spark, sf).select("user_id", "tile", S.pattern(F.col("code")).alias("pattern"))


@query(TILES + f"SELECT {CASE.format(c='code')} AS pattern, count(*) AS support, count(DISTINCT user_id) AS devices, min(last_ts)::DATE AS first_cutoff, max(last_ts)::DATE AS last_cutoff FROM t GROUP BY code")
def tile_pattern_support(spark, sf):
    t = tiled(spark, sf).select("user_id", S.pattern(F.col("code")).alias("pattern"), F.to_date(F.element_at("ts", -1)).alias("cutoff"))
    return evaluation.support(t, "pattern", "user_id", "cutoff")


@query(TILES + "SELECT user_id, tile, round(stddev_samp(x), 6) AS deviation, round(max(z), 4) AS highest, round(min(z), 4) AS lowest FROM (SELECT user_id, tile, x, (x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 1e-8 THEN stddev_samp(x) OVER w ELSE 1 END AS z FROM (SELECT user_id, tile, unnest(v) AS x FROM t) WINDOW w AS (PARTITION BY user_id, tile)) GROUP BY user_id, tile")
def window_zscore(spark, sf):
    z = tiled(spark, sf).withColumn("z", S.zscore("value"))
    return z.select("user_id", "tile", F.round(S.deviation("value", True), 6).alias("deviation"), F.round(F.array_max("z").cast("double"), 4).alias("highest"), F.round(F.array_min("z").cast("double"), 4).alias("lowest"))


@query("SELECT vec_id, round(stddev_samp(x), 6) AS deviation, round(avg(x), 6) AS mean FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def embedding_zscore(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(S.deviation("x", True), 6).alias("deviation"), F.round(S.mean("x"), 6).alias("mean"))


@query(TILES + ", b AS (SELECT user_id, tile, list_reverse(v) AS v FROM t), m2 AS (SELECT *, list_max(v) - list_min(v) AS span, list_sort(v[22:28])[4] - list_sort(v[1:7])[4] AS change FROM b) SELECT user_id, tile, v[1] AS first_value, CASE WHEN span = 0 THEN 0 WHEN change >= greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 1 WHEN change <= -greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 2 ELSE 3 END AS code FROM m2")
def perturb_reverse(spark, sf):
    back = tiled(spark, sf).withColumn("value", F.reverse("value"))
    return evaluation.relabelled(back, "value", 1.0, False).select("user_id", "tile", F.get("value", F.lit(0)).alias("first_value"), "code")


@query(TILES + ", x AS (SELECT user_id, tile, i, v[i + 1] AS x, sha256('612:' || user_id || '/' || tile || '|' || i) AS h FROM (SELECT user_id, tile, v, unnest(range(0, 28)) AS i FROM t)) SELECT user_id, tile, array_to_string(list(x::DECIMAL(12, 2)::VARCHAR ORDER BY h), ',') AS ordered FROM x GROUP BY user_id, tile")
def perturb_permute(spark, sf):
    t = tiled(spark, sf).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.col("tile").cast("string")))
    mixed = evaluation.permuted(t, "value", "key")
    return mixed.select("user_id", "tile", F.array_join(F.transform("value", lambda x: x.cast("decimal(12,2)").cast("string")), ",").alias("ordered"))


@query(TILES + f", c AS (SELECT user_id, tile, code, CASE WHEN code = 1 THEN 2 ELSE code END AS shown FROM t) SELECT user_id, tile, 'value: ' || {CASE.format(c='code')} || '; n: constant.' AS target, CASE WHEN tile % 3 = 0 THEN NULL ELSE {CASE.format(c='shown')} END AS parsed FROM c")
def answer_parse(spark, sf):
    t = tiled(spark, sf).withColumn("shown", F.when(F.col("code") == 1, 2).otherwise(F.col("code")))
    text = lambda c: F.concat(F.lit("value: "), S.pattern(F.col(c)), F.lit("; n: constant."))
    broken = F.when(F.col("tile") % 3 == 0, F.concat(text("shown"), F.lit(" and so on"))).otherwise(text("shown"))
    parsed = S.parse_answer(broken, F.array(F.lit("value"), F.lit("n")))
    return t.select("user_id", "tile", text("code").alias("target"), F.element_at(parsed, F.lit("value")).alias("parsed"))


@query(TILES + "SELECT user_id, tile, CASE WHEN b < 128 THEN 'original' WHEN b < 192 THEN 'reversed' ELSE 'shuffled' END AS choice FROM (SELECT user_id, tile, ('0x' || substr(sha256('7:1:' || user_id || '/' || tile), 1, 2))::INT AS b FROM t)")
def augmentation_choice(spark, sf):
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.col("tile").cast("string"))
    return tiled(spark, sf).select("user_id", "tile", evaluation.augmentation(key, 1, 7).alias("choice"))


@query()
def model_examples(spark, sf):
    """Window rows as model inputs: the allowed fields, with their eight-digit deviations (no SQL has %.8g)."""
    study = Study("event", "event:", (Channel("value", description="event value"), Channel("reversed", description="the same, backwards")), 1, splits(*[("2024-01-01", "2025-01-01")] * 4), cadence_text="one event at a time")
    t = tiled(spark, sf).select(F.concat(F.lit("user:"), F.col("user_id")).alias("device"), F.transform("ts", lambda x: F.unix_micros(x.cast("timestamp"))).alias("times_us"), F.array(F.lit("value"), F.lit("reversed")).alias("channels"), F.array("value", F.reverse("value")).alias("values"))
    e = features.examples(features.labelled(t, study, "v1"), study)
    return e.select(F.col("audit.task_id").alias("task_id"), "target", F.array_join("inputs.time_series_text", "\n").alias("text"), F.sha2(F.array_join(F.transform(F.flatten("inputs.time_series"), lambda x: F.bround(x.cast("double"), 4).cast("string")), ","), 256).alias("series_hash"))


# --- windows over time


@query("SELECT user_id, ts::DATE AS dt, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1")
def daily_last_report(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return windows.last_report(e, "user_id", "us", 86_400_000_000, "event_id").select("user_id", F.to_date("ts").alias("dt"), "event_id", "value")


@query(DAILY + """, f AS (SELECT *, max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed FROM d),
e AS (SELECT * FROM f WHERE failed = 0 AND dt BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'),
i AS (SELECT *, (dt - DATE '1970-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM e),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY dt) - 1) // 7 AS chunk FROM i)
SELECT user_id, min(dt) AS start, max(dt) AS cutoff, round(sum(v), 4) AS total FROM p GROUP BY user_id, island, chunk HAVING count(*) = 7""")
def island_tumbling(spark, sf):
    w = windows.hdd_windows(daily(spark, sf), "user_id", "dt", F.col("failure") == 1, "2024-01-02", "2024-01-28", 7)
    return w.groupBy("user_id", "window").agg(F.min("dt").alias("start"), F.max("dt").alias("cutoff"), F.round(F.sum("v"), 4).alias("total")).drop("window")


@query(DAILY + """, i AS (SELECT *, (dt - DATE '1970-01-01') - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY dt) AS pos, sum(v) OVER (PARTITION BY user_id, island ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total FROM i)
SELECT user_id, dt - 6 AS start, dt AS cutoff, round(total, 4) AS total FROM p WHERE pos >= 7 AND (pos - 7) % 3 = 0""")
def island_rolling_stride(spark, sf):
    w = windows.rolling(daily(spark, sf), "user_id", F.unix_date("dt"), 7, 3)
    return w.groupBy("user_id", "island", "end_pos").agg(F.min("dt").alias("start"), F.max("dt").alias("cutoff"), F.round(F.sum("v"), 4).alias("total")).select("user_id", "start", "cutoff", "total")


CUTS = ", c AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-24', INTERVAL 7 DAY))::DATE AS cutoff)"


@query(DAILY + CUTS + """, x AS (SELECT user_id, min(dt) FILTER (failure = 1) AS fail FROM d GROUP BY user_id)
SELECT d.user_id AS user_id, c.cutoff AS cutoff, round(sum(d.v), 4) AS total FROM d JOIN c ON d.dt BETWEEN c.cutoff - 6 AND c.cutoff JOIN x ON d.user_id = x.user_id
WHERE x.fail IS NULL OR x.fail > c.cutoff GROUP BY d.user_id, c.cutoff HAVING count(*) = 7 AND count(DISTINCT d.dt) = 7""")
def cutoff_sliding(spark, sf):
    w = windows.sliding(daily(spark, sf), "user_id", "dt", F.col("failure") == 1, windows.cutoffs("2024-01-10", "2024-01-24"), 7)
    return w.groupBy("user_id", "cutoff").agg(F.round(F.sum("v"), 4).alias("total"))


@query(DAILY + CUTS + """, x AS (SELECT user_id, min(dt) FILTER (failure = 1) AS fail FROM d GROUP BY user_id)
SELECT x.user_id AS user_id, c.cutoff AS cutoff, CASE WHEN x.fail <= c.cutoff THEN NULL WHEN max(d.failure) = 1 THEN 1 WHEN count(DISTINCT d.dt) = 3 THEN 0 END AS label
FROM x CROSS JOIN c LEFT JOIN d ON d.user_id = x.user_id AND d.dt > c.cutoff AND d.dt <= c.cutoff + 3 GROUP BY x.user_id, c.cutoff, x.fail""")
def future_label(spark, sf):
    return windows.future_label(daily(spark, sf), "user_id", "dt", F.col("failure") == 1, windows.cutoffs("2024-01-10", "2024-01-24"), 3)


GREEDY = DAILY + """, k AS (SELECT user_id, (dt - DATE '1970-01-01')::BIGINT AS dn FROM d WHERE n >= 3),
g AS (WITH RECURSIVE t AS (SELECT user_id, min(dn) AS dn FROM k GROUP BY user_id
      UNION ALL SELECT t.user_id AS user_id, (SELECT min(k.dn) FROM k WHERE k.user_id = t.user_id AND k.dn >= t.dn + 4) AS dn FROM t WHERE t.dn IS NOT NULL)
      SELECT user_id, dn AS cutoff FROM t WHERE dn IS NOT NULL)"""


@query(GREEDY + " SELECT user_id, cutoff FROM g")
def greedy_stride(spark, sf):
    d = daily(spark, sf)
    return windows.greedy_stride(d, "user_id", F.unix_date("dt"), F.col("n") >= 3, 4)


@query(GREEDY + """ SELECT g.user_id AS user_id, g.cutoff AS cutoff, s.dn AS dn, coalesce(d.n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(-6, 1)) AS o) o
CROSS JOIN LATERAL (SELECT g.cutoff + o.o AS dn) s LEFT JOIN d ON d.user_id = g.user_id AND (d.dt - DATE '1970-01-01')::BIGINT = s.dn""")
def zero_filled_calendar(spark, sf):
    d = daily(spark, sf).withColumn("dn", F.unix_date("dt").cast("long"))
    ends = windows.greedy_stride(d, "user_id", F.col("dn"), F.col("n") >= 3, 4)
    return windows.zero_filled(ends, d, "user_id", "dn", ["n"], 7).select("user_id", "cutoff", "dn", "n")


@query("""WITH d AS (SELECT l_returnflag || l_linestatus AS device, l_shipdate::DATE AS dt, count(*) AS n FROM lineitem GROUP BY l_returnflag || l_linestatus, l_shipdate::DATE),
i AS (SELECT *, (dt - DATE '1970-01-01') - row_number() OVER (PARTITION BY device ORDER BY dt) AS island FROM d),
p AS (SELECT *, (row_number() OVER (PARTITION BY device, island ORDER BY dt) - 1) // 28 AS chunk FROM i)
SELECT device, min(dt) AS start, max(dt) AS cutoff, sum(n)::BIGINT AS total FROM p GROUP BY device, island, chunk HAVING count(*) = 28""")
def series_windows(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("device"), F.to_date("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    w = windows.tumbling(d, "device", F.unix_date("dt"), F.lit(True), 28)
    return w.groupBy("device", "window").agg(F.min("dt").alias("start"), F.max("dt").alias("cutoff"), F.sum("n").alias("total")).drop("window")


@query("""WITH h AS (SELECT user_id, floor(epoch_us(ts) / 21600000000)::BIGINT AS q, avg(value) AS v, count(*) AS n FROM events GROUP BY user_id, floor(epoch_us(ts) / 21600000000)),
b AS (SELECT user_id, q - min(q) OVER (PARTITION BY user_id) AS k, q, v, v < 200 AND (q + 1) * 21600000000 >= 1704153600000000 AND (q + 1) * 21600000000 < 1706400000000000 AS ok FROM h),
i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS island FROM b WHERE ok),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY k) - 1) // 5 AS chunk FROM i)
SELECT user_id, min(q) AS first_q, max(q) AS last_q, round(sum(v), 4) AS total FROM p GROUP BY user_id, island, chunk HAVING count(*) = 5""")
def cadence_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("q", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).cast("long"))
    h = e.groupBy("user_id", "q").agg(F.avg("value").alias("v")).withColumn("us", F.col("q") * 21_600_000_000)
    w = windows.component_windows(h, "user_id", "us", 21_600_000_000, F.col("v") < 200, 1_704_153_600_000_000, 1_706_400_000_000_000, 5)
    return w.groupBy("user_id", "window").agg(F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.round(F.sum("v"), 4).alias("total")).drop("window")


@query("""WITH e AS (SELECT user_id, ts, event_id, sum(('0' || json_extract_string(props, '$.k'))::BIGINT % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS c FROM events),
f AS (SELECT *, first_value(c) OVER w AS c0, first_value(ts) OVER w AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, c - c0 AS delta, greatest(0.5::DOUBLE, (epoch_us(ts) - epoch_us(t0)) / 86400000000.0::DOUBLE) AS days FROM f)
SELECT user_id, count(*) FILTER (coalesce(delta > 0 AND (delta / days > 0.5 OR delta >= 5), false)) AS growing, round(max(delta / days), 4) AS fastest FROM g GROUP BY user_id""")
def counter_growth(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long") % 3)
    run = F.sum("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double")
    g = windows.counter_growth(e.withColumn("c", run), "user_id", "ts", "c")
    return g.groupBy("user_id").agg(F.count_if("grows").alias("growing"), F.round(F.max(F.col("growth_delta") / F.col("growth_days")), 4).alias("fastest"))


@query(DAILY + """, h AS (SELECT user_id, dt, 100 - least(99, v) AS h, (dt - DATE '2024-01-01')::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY dt) AS n, min(dt) OVER (PARTITION BY user_id) AS d0 FROM d),
s AS (SELECT *, (dt - d0)::DOUBLE AS span, round(regr_slope(h, x) OVER (PARTITION BY user_id ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS sl FROM h),
z AS (SELECT user_id, dt, n, CASE WHEN n >= 3 THEN span ELSE 0 END AS span, CASE WHEN n >= 3 AND span >= 0.5 THEN sl ELSE 0 END AS sl FROM s)
SELECT user_id, dt, round(sl, 6) + 0.0::DOUBLE AS slope, CASE WHEN n < 3 OR span < 0.5 THEN 'baseline' WHEN sl <= -2 THEN 'deteriorating' WHEN sl <= -0.5 THEN 'slowly deteriorating' WHEN sl >= 0.5 THEN 'improving' ELSE 'stable' END AS trend FROM z""")
def health_trajectory(spark, sf):
    h = daily(spark, sf).withColumn("h", 100 - F.least(F.lit(99.0), "v"))
    t = windows.trajectory(h, "user_id", "dt", "h")
    return t.select("user_id", "dt", (F.round("slope", 6) + 0.0).alias("slope"), S.trend_label("slope", "span_days", "points").alias("trend"))


FRAMES = DAILY + ", f AS (SELECT user_id, dt, 100 - least(99, v) AS h, CASE WHEN v > 80 THEN 3 WHEN v > 60 THEN 2 WHEN v > 50 THEN 1 ELSE 0 END AS level FROM d)"


def leveled(days):
    v = F.col("v")
    return days.withColumns({"h": 100 - F.least(F.lit(99.0), v), "level": F.when(v > 80, 3).when(v > 60, 2).when(v > 50, 1).otherwise(0)})


def frames(spark, sf):
    return leveled(daily(spark, sf)).select("user_id", "dt", "h", "level")


@query(FRAMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dt) AS k, count(*) OVER (PARTITION BY user_id) AS n, first_value(level) OVER (PARTITION BY user_id ORDER BY dt) AS l0 FROM f),
b AS (SELECT user_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS base FROM r WHERE k <= 5 GROUP BY user_id)
SELECT r.user_id AS user_id, r.dt AS dt, round(r.h, 4) AS h, round(b.base, 4) AS baseline FROM r JOIN b ON r.user_id = b.user_id WHERE n >= 4 AND (r.h <= b.base - 4 OR r.level > r.l0)
QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY r.dt) = 1""")
def first_onset(spark, sf):
    o = windows.first_onset(frames(spark, sf), "user_id", "dt", "h", "level", F.lit(True))
    return o.select("user_id", "dt", F.round("h", 4).alias("h"), F.round("baseline", 4).alias("baseline"))


@query(FRAMES + "SELECT user_id, dt, level FROM (SELECT *, max(level) OVER (PARTITION BY user_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f) WHERE level > b")
def status_escalations(spark, sf):
    return windows.escalations(frames(spark, sf), "user_id", "dt", "level").select("user_id", "dt", "level")


@query("""WITH g AS (SELECT u.user_id AS user_id, c.at_ts AS at_ts FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 12:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 DAY)) AS at_ts) c)
SELECT g.user_id AS user_id, g.at_ts AS at_ts, e.event_id AS event_id, e.value AS value FROM g ASOF LEFT JOIN events e ON g.user_id = e.user_id AND g.at_ts >= e.ts""")
def asof_state(spark, sf):
    e = table(spark, sf, "events")
    days = F.expr("transform(sequence(0, 29), i -> cast(timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(i) as timestamp_ntz))")
    grid = e.select("user_id").distinct().withColumn("at_ts", F.explode(days))
    return windows.as_of(e, grid, "user_id", "ts", "at_ts", ["event_id", "value"])


# --- splits and samples

CUSTOMER = splits(*[("2024-01-01", "2025-01-01")] * 4)
BUCKET = "(('0x' || substr(sha256('{salt}' || {key}), 1, 8))::BIGINT % 100)"
SPLIT = "CASE WHEN {b} < 60 THEN 'train' WHEN {b} < 75 THEN 'validation' WHEN {b} < 85 THEN 'calibration' ELSE 'test' END"


@query(f"SELECT c_custkey, {BUCKET.format(salt='customer-v1:', key='c_custkey')} AS bucket, {SPLIT.format(b=BUCKET.format(salt='customer-v1:', key='c_custkey'))} AS split FROM customer")
def split_assignment(spark, sf):
    c = sampling.with_split(table(spark, sf, "customer"), "c_custkey", "customer-v1:", CUSTOMER)
    return c.select("c_custkey", S.bucket("customer-v1:", "c_custkey").alias("bucket"), "split")


@query(f"WITH s AS (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-03' AND user_id % 7 = 0 THEN 'test' ELSE {SPLIT.format(b=BUCKET.format(salt='u:', key='user_id'))} END AS split FROM events) SELECT user_id, count(DISTINCT split) AS splits FROM s GROUP BY user_id HAVING count(DISTINCT split) > 1")
def split_disjoint(spark, sf):
    s = sampling.with_split(table(spark, sf, "events"), "user_id", "u:", CUSTOMER)
    s = s.withColumn("split", F.when((F.col("ts") < F.expr("timestamp_ntz'2024-01-03 00:00:00'")) & (F.col("user_id") % 7 == 0), "test").otherwise(F.col("split")))
    return sampling.overlaps(s, "user_id")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') ORDER BY md5(user_id || ':cohort'), user_id LIMIT 20")
def cohort_topk(spark, sf):
    base = table(spark, sf, "events").where(F.col("ts") < F.expr("timestamp_ntz'2024-01-02 00:00:00'"))
    return sampling.cohort(base, "user_id", ":cohort", 20)


@query("SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('stratum:' || c_custkey), c_custkey) <= 10")
def stratified_topk(spark, sf):
    return sampling.top_by_hash(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", "stratum:", 10).select("c_mktsegment", "c_custkey")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('task:' || event_id), event_id) = 1) ORDER BY sha256('drive:' || user_id), user_id LIMIT 30")
def heldout_one_per_group(spark, sf):
    return sampling.one_per_group(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", "drive:", "task:", 30).select("user_id", "event_id")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('heldout:' || o_orderkey), o_orderkey) <= 5")
def heldout_k_per_group(spark, sf):
    return sampling.top_by_hash(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "heldout:", 5).select("o_orderpriority", "o_orderkey")


@query("SELECT event_id, sha256('612:' || event_id) AS place FROM events WHERE sha256('612:' || event_id) > '8'")
def shuffled_resume(spark, sf):
    return sampling.shuffled(table(spark, sf, "events"), "event_id", 612, after="8").select("event_id", "place")


@query()
def unused_after_release(spark, sf):
    """What a release of all events leaves once 25 of them are opened; held against brute force in the tests."""
    rows = table(spark, sf, "events").select("event_id", "user_id")
    opened = rows.orderBy(S.salted_hash("open:", "event_id"), "event_id").limit(25)
    known = rows.agg(F.max("event_id") + 1, F.count_distinct("user_id")).first()  # ids are numbered from 0
    return relations.unused_after_release(rows, opened, "event_id", known[0], "user_id", known[1])


# --- audits and aggregates


@query("""SELECT p.p_brand AS model, count(*) AS rows, count(DISTINCT l.l_suppkey) AS devices, sum((l.l_returnflag = 'R')::INT)::BIGINT AS events, round(count(nullif(l.l_discount, 0))::DOUBLE / count(*), 6) AS coverage
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' GROUP BY p.p_brand HAVING count(DISTINCT l.l_suppkey) >= 5 ORDER BY events DESC, rows DESC, model LIMIT 20""")
def model_audit(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = l.where(F.col("l_shipdate").between(F.expr("timestamp_ntz'1995-01-01 00:00:00'"), F.expr("timestamp_ntz'1998-12-31 00:00:00'"))).join(p, l.l_partkey == p.p_partkey)
    a = rows.groupBy(F.col("p_brand").alias("model")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_suppkey").alias("devices"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("events"), F.round(F.count(F.when(F.col("l_discount") != 0, 1)) / F.count(F.lit(1)), 6).alias("coverage"))
    return a.where("devices >= 5").orderBy(F.desc("events"), F.desc("rows"), "model").limit(20)


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS devices, round(sum(value), 2) AS total, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events")
def global_stats(spark, sf):
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("devices"), F.round(F.sum("value"), 2).alias("total"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT p_name, count(DISTINCT (p_brand, p_size)) AS versions FROM part GROUP BY p_name HAVING count(DISTINCT (p_brand, p_size)) > 1")
def conflicting_values(spark, sf):
    return quality.conflicting(table(spark, sf, "part"), ["p_name"], ["p_brand", "p_size"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def changing_attribute(spark, sf):
    return quality.changing(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS history FROM orders GROUP BY o_custkey")
def ordered_history(spark, sf):
    h = windows.history(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], [])
    return h.select("o_custkey", F.array_join(F.transform("history", lambda r: r["o_orderkey"].cast("string")), ",").alias("history"))


EVENT_RULE = "CASE WHEN event_type IS NULL OR user_id IS NULL THEN 'missing identity' WHEN ts::DATE <> DATE '2024-01-01' + (event_id % 30)::INT AND value > 100 THEN 'date differs' WHEN coalesce(value NOT BETWEEN 0 AND 250, true) THEN 'range' END"


def event_rules():
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 30).cast("int"))
    return {"missing identity": F.col("event_type").isNotNull() & F.col("user_id").isNotNull(), "date differs": ~((F.to_date("ts") != day) & (F.col("value") > 100)), "range": F.col("value").between(0, 250)}


@query(f"SELECT coalesce({EVENT_RULE}, 'accepted') AS reason, count(*) AS n FROM events GROUP BY 1")
def validity_audit(spark, sf):
    return quality.audit(table(spark, sf, "events"), event_rules())


@query(f"SELECT event_id, {EVENT_RULE} AS reason FROM events WHERE {EVENT_RULE} IS NOT NULL")
def quarantine_split(spark, sf):
    return quality.quarantine(table(spark, sf, "events"), event_rules())[1].select("event_id", "reason")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN (props->>'k')::BIGINT BETWEEN 0 AND 80 THEN NULL ELSE 'range' END AS reason FROM events")
def json_report_valid(spark, sf):
    e = table(spark, sf, "events").withColumn("r", F.from_json("props", "k bigint")).withColumn("k", F.col("r.k"))
    return quality.reasons(e, {"range": F.col("k").between(0, 80)}).select("event_id", "k", "reason")


@query("""SELECT p_partkey, CASE WHEN m = '00MD00' THEN 'unidentified' WHEN contains(m, 'SSD') OR m LIKE 'MTFD%' OR m LIKE 'DELLBOSS%' OR m LIKE 'WDC WDS%' THEN 'ssd'
WHEN regexp_matches(m, '^(ST[0-9]|HGST |Hitachi |TOSHIBA (DT|HD|MD|MG|MQ)|WDC (WD|WUH)|WUH721816ALE6L4$|SAMSUNG HD)') THEN 'hdd' ELSE 'unknown' END AS media
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'WDC WUH' || p_size WHEN 1 THEN 'DELLBOSS VD' WHEN 2 THEN 'WDC WDS250' WHEN 3 THEN '00MD00' WHEN 4 THEN 'ST' || p_size ELSE p_name END AS m FROM part)""")
def media_class(spark, sf):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    m = F.when(k == 0, F.concat(F.lit("WDC   WUH"), size)).when(k == 1, "DELLBOSS  VD").when(k == 2, " WDC WDS250").when(k == 3, "00MD00").when(k == 4, F.concat(F.lit("ST"), size)).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.media_type(m).alias("media"))


@query("SELECT user_id, ts::DATE AS dt, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type NOT IN ('view', 'error')) AS others FROM events GROUP BY user_id, ts::DATE")
def daily_type_counts(spark, sf):
    e, t = table(spark, sf, "events"), F.col("event_type")
    return e.groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.count_if(t == "view").alias("views"), F.count_if(t == "error").alias("errors"), F.count_if(~t.isin("view", "error")).alias("others"))


@query("WITH d AS (SELECT md5(text) AS h, doc_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) SELECT doc_id, h FROM d WHERE copies = 1")
def content_dedup(spark, sf):
    """Documents whose content occurs once: all copies of what repeats are dropped."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    once = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.select("doc_id", "h")


@query("SELECT ts::DATE AS dt, event_type, count(*) AS n FROM events GROUP BY ts::DATE, event_type")
def timeline_histogram(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("dt"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, ts::DATE AS dt, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id) = 1")
def event_dedup(spark, sf):
    e = table(spark, sf, "events").withColumn("dt", F.to_date("ts"))
    return e.groupBy("user_id", "dt", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "dt", "event_type", F.col("m.event_id").alias("event_id"))


# --- evaluation


@query(TILES + f", n AS (SELECT p.pattern AS pattern, count(t.code) AS n FROM (SELECT unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS pattern) p LEFT JOIN t ON {CASE.format(c='t.code')} = p.pattern GROUP BY p.pattern) SELECT pattern, n, round(greatest(0.1, least(30.0, (SELECT sum(n) FROM n)::DOUBLE / (5 * greatest(n, 1)))), 6) AS weight FROM n")
def class_weights(spark, sf):
    n = tiled(spark, sf).groupBy(S.pattern(F.col("code")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.class_weights(n, "pattern", "n").withColumn("weight", F.round("weight", 6))


RULED = "WITH r AS (SELECT l.doc_id AS doc_id, l.quality AS quality, d.source AS source, (regexp_matches(d.text, '[!#$%&|]') = false)::INT AS said FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def ruled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", (~F.col("text").rlike("[!#$%&|]")).cast("int").alias("said"))
    return table(spark, sf, "labels").select("doc_id", "quality").join(d, "doc_id")


@query(RULED + """, c AS (SELECT unnest(['0', '1']) AS class), x AS (SELECT c.class AS class, count(*) FILTER (r.quality::VARCHAR = c.class) AS support, count(*) FILTER (r.said::VARCHAR = c.class) AS said, count(*) FILTER (r.said = r.quality AND r.quality::VARCHAR = c.class) AS tp FROM c CROSS JOIN r GROUP BY c.class)
SELECT class, support, round(CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + said > 0 THEN 2.0::DOUBLE * tp / (support + said) ELSE 0 END, 6) AS f1 FROM x""")
def confusion_metrics(spark, sf):
    m = evaluation.class_metrics(ruled(spark, sf), "quality", "said")
    return m.select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(RULED + "SELECT source, round(avg((said = quality)::INT), 6) AS accuracy FROM r GROUP BY source")
def group_mean_gain(spark, sf):
    r = ruled(spark, sf).withColumn("accuracy", (F.col("said") == F.col("quality")).cast("int"))
    return evaluation.group_means(r, "source", "accuracy").withColumn("accuracy", F.round("accuracy", 6))


GAINS = "g AS (SELECT event_type, avg(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) AS gain, row_number() OVER (ORDER BY event_type) - 1 AS i FROM events GROUP BY event_type)"


def gains(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")))
    return evaluation.group_means(e, "event_type", "s")


@query(f"WITH {GAINS}, m AS (SELECT unnest(range(0, 32)) AS m), s AS (SELECT m.m AS m, avg(CASE WHEN (m.m >> g.i::INT) & 1 = 1 THEN g.gain ELSE -g.gain END) AS s FROM m CROSS JOIN g GROUP BY m.m) SELECT 5 AS groups, round((SELECT avg(gain) FROM g), 6) AS mean_gain, avg((s >= (SELECT avg(gain) FROM g) - 1e-9)::INT) AS probability FROM s")
def sign_test(spark, sf):
    return evaluation.sign_test(gains(spark, sf), "s").withColumn("mean_gain", F.round("mean_gain", 6))


@query(f"WITH {GAINS} SELECT (SELECT bool_and(gain > 0) FROM g) AS passed, (SELECT coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT gain > 0), '') FROM g) AS failed")
def gate(spark, sf):
    return evaluation.gate(gains(spark, sf).select(F.col("event_type").alias("check"), (F.col("s") > 0).alias("ok"))).withColumn("failed", F.array_join("failed", ","))


@query()
def bootstrap_ci(spark, sf):
    r = ruled(spark, sf).withColumn("right", (F.col("said") == F.col("quality")).cast("int"))
    return evaluation.bootstrap_interval(r, "right", "quality", "doc_id")


# --- joins, sets, graph, intervals


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')")
def allowed_rows(spark, sf):
    keys = table(spark, sf, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    rows = relations.members_of(table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice"), keys, "l_partkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH t AS (SELECT user_id, min(ts) AS alarm FROM events WHERE value >= 250 GROUP BY user_id) SELECT e.user_id AS user_id, count(*) AS n, any_value(t.alarm)::DATE AS alarm FROM events e LEFT JOIN t ON e.user_id = t.user_id WHERE t.alarm IS NULL OR e.ts < t.alarm GROUP BY e.user_id")
def before_ticket(spark, sf):
    e = table(spark, sf, "events")
    rows = relations.before_ticket(e, e.where("value >= 250").select("user_id", F.col("ts").alias("alarm")), "user_id", "ts", "alarm")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("alarm")).alias("alarm"))


@query("WITH t AS (SELECT event_id AS task, user_id, ts AS a, ts + INTERVAL 2 DAY AS b FROM events WHERE event_type = 'signup') SELECT t.task AS task, count(*) AS n, round(sum(e.value), 4) AS total FROM t JOIN events e ON e.user_id = t.user_id AND e.ts >= t.a AND e.ts < t.b GROUP BY t.task")
def task_scope(spark, sf):
    """Each signup's events of the same user in the two days from it on."""
    e = table(spark, sf, "events")
    tasks = e.where("event_type = 'signup'").select(F.col("event_id").alias("task"), "user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 2 days")).alias("b"))
    found = relations.scope_totals(e.select("user_id", "ts", "value"), tasks, "task", "user_id", "ts", "a", "b", ["value"])
    return found.select("task", "n", F.round("value", 4).alias("total"))


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '2%') SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT k, 'right' AS side FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)")
def set_differences(spark, sf):
    o = table(spark, sf, "orders")
    pick = lambda p: o.where(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("k"))
    return relations.differences(pick("1"), pick("2"))


@query()
def component_closure(spark, sf):
    """Customers that share order slots, however indirectly; held against brute force in the tests."""
    edges = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("d"), F.concat_ws("/", F.to_date("o_orderdate").cast("string"), (F.col("o_orderkey") % 7).cast("string")).alias("h"))
    return relations.connected_groups(edges, "d", "h")


@query("""WITH i AS (SELECT o_custkey, o_orderdate::DATE AS a, (o_orderdate::DATE + (o_orderkey % 40)::INT) AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT o_custkey, run, min(a) AS a, max(b) AS b FROM g GROUP BY o_custkey, run)
SELECT o_custkey, count(*) AS intervals, sum(b - a)::BIGINT AS days, round(sum(b - a) * 0.25::DOUBLE, 4) AS cost FROM u GROUP BY o_custkey""")
def interval_union_cost(spark, sf):
    i = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("b"))
    u = relations.union_of_intervals(i, ["o_custkey"], "a", "b").withColumn("d", F.datediff("b", "a").cast("long"))
    return u.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("intervals"), F.sum("d").alias("days"), F.round(F.sum("d") * 0.25, 4).alias("cost"))


# --- fleet


def parts(spark, sf):
    """Stand-in components: suppliers' line items by return flag, placed in nations (racks) and regions (sites)."""
    l, s, n, r = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    place = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    c = l.groupBy("l_suppkey", "l_returnflag").agg(F.avg(F.col("l_quantity") + 500 * F.col("l_discount")).alias("q"))
    return c.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("device"), F.col("l_returnflag").alias("component"), F.col("r_name").alias("site"), F.col("n_name").alias("rack"), F.round(110 - F.col("q"), 3).alias("health"))


PARTS = """WITH c AS (SELECT l_suppkey AS device, l_returnflag AS component, avg(l_quantity + 500 * l_discount) AS q FROM lineitem GROUP BY l_suppkey, l_returnflag),
p AS (SELECT c.device AS device, c.component AS component, r.r_name AS site, n.n_name AS rack, round(110 - c.q, 3) AS health FROM c JOIN supplier s ON c.device = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
q AS (SELECT *, CASE WHEN health >= 80 THEN 'healthy' WHEN health >= 65 THEN 'watch' WHEN health >= 45 THEN 'elevated' ELSE 'critical' END AS status FROM p)"""


@query(PARTS + "SELECT site, rack, component, count(DISTINCT device) AS devices, CASE WHEN count(DISTINCT device) >= 5 THEN 'elevated' ELSE 'watch' END AS severity FROM q WHERE status <> 'healthy' GROUP BY site, rack, component HAVING count(DISTINCT device) >= 2")
def rack_patterns(spark, sf):
    bad = parts(spark, sf).where(S.status("health") != "healthy")
    g = bad.groupBy("site", "rack", "component").agg(F.count_distinct("device").alias("devices")).where("devices >= 2")
    return g.withColumn("severity", F.when(F.col("devices") >= 5, "elevated").otherwise("watch"))


@query(PARTS + ", d AS (SELECT device, site, rack, 0.6::DOUBLE * min(health) + 0.4::DOUBLE * avg(health) AS h FROM q GROUP BY device, site, rack) SELECT site, count(*) AS nodes, count(DISTINCT rack) AS racks, round(avg(h), 4) AS health FROM d GROUP BY site")
def site_rollup(spark, sf):
    d = parts(spark, sf).groupBy("device", "site", "rack").agg((0.6 * F.min("health") + 0.4 * F.avg("health")).alias("h"))
    return d.groupBy("site").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("rack").alias("racks"), F.round(F.avg("h"), 4).alias("health"))


@query(PARTS + "SELECT site, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'watch') AS watch, count(*) FILTER (status = 'elevated') AS elevated, count(*) FILTER (status = 'critical') AS critical FROM q GROUP BY site")
def status_histogram(spark, sf):
    p = parts(spark, sf).withColumn("status", S.status("health"))
    return p.groupBy("site").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "watch", "elevated", "critical")))


@query(PARTS + "SELECT device, component, greatest(1, least(99, round_even(100 / (1 + exp(-(health - 60) / 7)), 0)))::INT AS percentile FROM q")
def fleet_percentile(spark, sf):
    return parts(spark, sf).select("device", "component", S.fleet_percentile("health", 60, 7).alias("percentile"))


@query(PARTS + "SELECT device, rack, component, count(*) OVER (PARTITION BY rack, component) AS peers, m AS peer_median, round(CASE WHEN count(*) OVER (PARTITION BY rack, component) > 1 THEN (rank() OVER (PARTITION BY rack, component ORDER BY health) - 1)::DOUBLE / (count(*) OVER (PARTITION BY rack, component) - 1) END, 6) AS share_below FROM (SELECT q.*, x.m AS m FROM q JOIN (SELECT rack, component, list_sort(list(health))[len(list(health)) // 2 + 1] AS m FROM q GROUP BY rack, component) x ON q.rack = x.rack AND q.component = x.component)")
def peer_compare(spark, sf):
    p = relations.peers(parts(spark, sf), "rack", "component", "device", "health")
    return p.select("device", "rack", "component", "peers", "peer_median", F.round("share_below", 6).alias("share_below"))


RISK = "(1 - exp(-list_sum(list_transform(range(0, {n}), lambda k: (0.0004::DOUBLE + 0.35::DOUBLE * pow((100 - greatest(0, health - slope * (k * 0.25::DOUBLE + 0.125::DOUBLE))) / 100, 3)) * 0.25::DOUBLE))))"


@query(PARTS + f", z AS (SELECT *, (device % 5)::DOUBLE / 2 AS slope FROM q) SELECT device, component, round({RISK.format(n=28)}, 6) AS risk FROM z")
def cumulative_risk(spark, sf):
    p = parts(spark, sf).withColumn("slope", -(F.col("device") % 5).cast("double") / 2)
    return p.select("device", "component", F.round(S.cumulative_risk("health", "slope", 7.0), 6).alias("risk"))


@query(PARTS + """, z AS (SELECT device, component, health, (device % 5)::DOUBLE / 2 AS slope FROM q), k AS (SELECT unnest(range(0, 127)) AS k),
t AS (SELECT z.device AS device, z.component AS component, CASE WHEN k < 60 THEN k * 0.5::DOUBLE ELSE 30 + (k - 60) * 5.0::DOUBLE END AS a, CASE WHEN k < 60 THEN 0.5::DOUBLE ELSE 5.0::DOUBLE END AS dt, z.health AS health, z.slope AS slope FROM z CROSS JOIN k),
y AS (SELECT device, component, a + dt AS e, 1 - exp(-sum((0.0004::DOUBLE + 0.35::DOUBLE * pow((100 - greatest(0, health - slope * (a + dt / 2))) / 100, 3)) * dt) OVER (PARTITION BY device, component ORDER BY a)) AS r FROM t)
SELECT device, component, min(e) FILTER (r >= 0.25) AS low_days, min(e) FILTER (r >= 0.75) AS high_days FROM y GROUP BY device, component""")
def failure_window(spark, sf):
    p = parts(spark, sf).withColumn("slope", -(F.col("device") % 5).cast("double") / 2)
    return p.select("device", "component", S.failure_window("health", "slope").alias("w")).select("device", "component", "w.low_days", "w.high_days")


@query(PARTS + f", z AS (SELECT *, 0.0::DOUBLE AS slope FROM q), y AS (SELECT device, component, round(100 * (0.6::DOUBLE * {RISK.format(n=28)} + 0.4::DOUBLE * (100 - health) / 100), 4) AS priority FROM z) SELECT *, row_number() OVER (PARTITION BY device ORDER BY priority DESC, component)::INT AS place FROM y")
def priority_rank(spark, sf):
    p = parts(spark, sf).withColumn("priority", F.round(100 * (0.6 * S.cumulative_risk("health", F.lit(0.0), 7.0) + 0.4 * (100 - F.col("health")) / 100), 4))
    return p.select("device", "component", "priority").withColumn("place", F.row_number().over(Window.partitionBy("device").orderBy(F.desc("priority"), "component")))
