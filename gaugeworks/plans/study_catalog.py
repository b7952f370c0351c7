"""Queries of the study adapters and of the operators around them, on stand-in histories, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import evaluation, features, fleet, quality, relations, sampling, studies, windows
from gaugeworks.session import scratch_folder, table
from gaugeworks.spec import DAY_US, Channel, Study, micros, splits

from .catalog import BUCKET, CASE, DAILY, FRAMES, PARTS, RULED, SPLIT, TILES, daily, leveled, parts, query, ruled, tiled

TIMES = splits(("2024-01-03", "2024-01-24"), ("2024-01-08", "2024-01-31"), ("2024-01-05", "2024-01-28"), ("2024-01-02", "2024-02-01"))
DAY = Study("day", "day:", (Channel("v"), Channel("n")), DAY_US, TIMES, stride=3)
SLOT_US = 30 * 60_000_000
SLOT = Study("slot", "slot:", (Channel("v"), Channel("n")), SLOT_US, TIMES)


def bound(end: str) -> str:
    return "CASE split " + " ".join(f"WHEN '{s.name}' THEN {micros(getattr(s, end))}" for s in TIMES) + " END"


def split_sql(salt: str, key: str) -> str:
    return SPLIT.format(b=BUCKET.format(salt=salt, key=key))


TOTALS = ("device", "split", "first_us", "last_us", "total")


def totals(rows: DataFrame) -> DataFrame:
    w = rows.groupBy("device", "split", "window").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.round(F.sum(F.col("v") + F.col("n")), 4).alias("total"))
    return w.withColumn("device", F.col("device").cast("string")).select(*TOTALS)


SUMS = "SELECT {device} AS device, split, min(time_us) AS first_us, max(time_us) AS last_us, round(sum(v + n), 4) AS total FROM {rows}"


# --- adapters

HISTORY = DAILY + f""", h AS (SELECT user_id, dt, CASE WHEN n % 5 = 4 THEN NULL ELSE v END AS v, n::DOUBLE AS n, ((dt - DATE '1970-01-01')::BIGINT + 1) * {DAY_US} AS time_us,
max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed, row_number() OVER (PARTITION BY user_id ORDER BY dt) AS rn, {split_sql('day:', 'user_id')} AS split FROM d),
j AS (SELECT *, failed = 0 AND time_us >= {bound('start')} AND time_us < {bound('stop')} AS in_time, v IS NOT NULL AS valid FROM h),
i AS (SELECT *, time_us // {DAY_US} - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM j WHERE in_time AND valid),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY dt) AS pos FROM i)"""


def history(spark, sf) -> DataFrame:
    d = daily(spark, sf)
    return d.select(F.col("user_id").alias("device"), F.col("dt").alias("day"), "failure", F.when(F.col("n") % 5 != 4, F.col("v")).alias("v"), F.col("n").cast("double").alias("n"))


@query(HISTORY + SUMS.format(device="user_id::VARCHAR", rows="c GROUP BY user_id, split, island, (pos - 1) // 5 HAVING count(*) = 5"))
def study_daily(spark, sf):
    return totals(studies.daily_windows(history(spark, sf), DAY, 5))


@query(HISTORY + f""", g AS (SELECT *, time_us - lag(time_us) OVER w <> {DAY_US} AND rn - lag(rn) OVER w = 1 AND lag(pos) OVER w % 5 <> 0 AS gap FROM c WINDOW w AS (PARTITION BY user_id ORDER BY dt)),
a AS (SELECT split, count(*) AS source_rows, count(*) FILTER (NOT in_time) AS rows_outside, count(*) FILTER (in_time AND NOT valid) AS rows_invalid FROM j GROUP BY split)
SELECT a.split AS split, source_rows, rows_outside, rows_invalid, coalesce(count(*) FILTER (gap), 0) AS calendar_gaps, count(*) FILTER (pos % 5 = 0) AS windows FROM a LEFT JOIN g ON a.split = g.split GROUP BY a.split, source_rows, rows_outside, rows_invalid""")
def study_audit(spark, sf):
    return studies.daily_audit(history(spark, sf), DAY, 5)


LABEL = "CASE WHEN list_max({x}) = list_min({x}) THEN 0 WHEN {c} >= greatest(1.0::DOUBLE, (list_max({x}) - list_min({x})) * 0.1::DOUBLE) THEN 1 WHEN {c} <= -greatest(1.0::DOUBLE, (list_max({x}) - list_min({x})) * 0.1::DOUBLE) THEN 2 ELSE 3 END"
LABELS = {x: LABEL.format(x=x, c=f"((list_sort({x}[4:5])[1] + list_sort({x}[4:5])[2]) / 2 - (list_sort({x}[1:2])[1] + list_sort({x}[1:2])[2]) / 2)") for x in ("vs", "ns")}


@query(HISTORY + f""", w AS (SELECT user_id, split, min(time_us) AS a, max(time_us) AS z, list(v ORDER BY dt) AS vs, list(n ORDER BY dt) AS ns FROM c GROUP BY user_id, split, island, (pos - 1) // 5 HAVING count(*) = 5)
SELECT sha256('v1|day|' || user_id || '|' || a || '|' || z) AS task_id, split, 'v: ' || {CASE.format(c=LABELS['vs'])} || '; n: ' || {CASE.format(c=LABELS['ns'])} || '.' AS target FROM w""")
def study_build(spark, sf):
    """History to labelled windows in one plan: adapter, arrays, labels, identities."""
    return studies.build(studies.daily_windows(history(spark, sf), DAY, 5), DAY, "v1").select("task_id", "split", "target")


@query(HISTORY + f""", w AS (SELECT split, list(v ORDER BY dt) AS vs, list(n ORDER BY dt) AS ns FROM c GROUP BY user_id, split, island, (pos - 1) // 5 HAVING count(*) = 5),
e AS (SELECT split, {CASE.format(c=LABELS['vs'])} AS pattern FROM w UNION ALL SELECT split, {CASE.format(c=LABELS['ns'])} AS pattern FROM w) SELECT split, pattern, count(*) AS windows FROM e GROUP BY split, pattern""")
def study_support(spark, sf):
    return studies.support(studies.build(studies.daily_windows(history(spark, sf), DAY, 5), DAY, "v1"))


SLOTS = f"""WITH s AS (SELECT event_type AS host, ts::DATE AS day, (epoch_us(ts) // {SLOT_US} + 1) * {SLOT_US} AS time_us, min(value) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2, 3),
p AS (SELECT *, {split_sql('slot:', 'host')} AS split FROM s)"""
LIMITS = {"train": 4, "validation": 3, "calibration": 2, "test": 5}
MOST = "CASE split " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in LIMITS.items()) + " END"


def slots(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = e.groupBy(F.col("event_type").alias("host"), F.to_date("ts").alias("day"), ((F.floor(F.col("us") / SLOT_US).cast("long") + 1) * SLOT_US).alias("time_us"))
    return s.agg(F.min("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


@query(SLOTS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY time_us) - 1 AS k FROM p),
t AS (SELECT host, day, split, k // 3 AS tile, min(time_us) AS a, max(time_us) AS z, list(time_us ORDER BY k) AS ts, sum(v + n) AS total FROM r GROUP BY host, day, split, k // 3 HAVING count(*) = 3),
o AS (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY sha256('tile:' || host || ':' || a), a) AS place FROM t)
SELECT host AS device, split, a AS first_us, z AS last_us, round(total, 4) AS total FROM o WHERE place <= {MOST} AND ts[2] - ts[1] = {SLOT_US} AND ts[3] - ts[2] = {SLOT_US} AND a >= {bound('start')} AND z < {bound('stop')}""")
def study_tiles(spark, sf):
    """Tiles of a host's day, drawn by hash before they are judged."""
    return totals(studies.tile_windows(slots(spark, sf), SLOT, LIMITS, "tile:", 3))


@query(SLOTS + f""", ok AS (SELECT host, host AS g, day, time_us, v, n, split, (epoch_us(day::TIMESTAMP) // {DAY_US}) % 2 AS module FROM p WHERE v BETWEEN 0 AND 40 AND time_us >= {bound('start')} AND time_us < {bound('stop')}),
i AS (SELECT *, time_us // {SLOT_US} - row_number() OVER (PARTITION BY g, module ORDER BY time_us) AS island FROM ok),
c AS (SELECT *, (row_number() OVER (PARTITION BY g, module, island ORDER BY time_us) - 1) // 4 AS chunk FROM i),
w AS (SELECT g, module, split, min(time_us) AS a, max(time_us) AS z, sum(v + n) AS total FROM c GROUP BY g, module, split, island, chunk HAVING count(*) = 4),
o AS (SELECT *, row_number() OVER (PARTITION BY g, module ORDER BY sha256('fan:' || g || ':' || module || ':' || a), a) AS place FROM w)
SELECT g || ':' || module AS device, split, a AS first_us, z AS last_us, round(total, 4) AS total FROM o WHERE place <= {MOST}""")
def study_modules(spark, sf):
    """Valid runs of a module first, then a sample of its windows by hash."""
    s = slots(spark, sf).withColumn("module", F.unix_date("day") % 2).withColumnRenamed("host", "group_id")
    return totals(studies.module_windows(s, SLOT, LIMITS, "fan:", 0.0, 40.0, 4, ("v",)))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value, event_id, CASE WHEN user_id % 10 = 3 THEN event_type ELSE 'm' END AS model, (user_id % 40)::VARCHAR AS host FROM events),
x AS (SELECT user_id FROM e GROUP BY user_id HAVING count(DISTINCT model) > 1),
l AS (SELECT user_id, us // {DAY_US} AS day, value AS v, (event_id % 9)::DOUBLE AS n, sha256(host) AS g FROM e WHERE user_id NOT IN (SELECT user_id FROM x) QUALIFY row_number() OVER (PARTITION BY user_id, us // {DAY_US} ORDER BY us DESC, host DESC) = 1),
p AS (SELECT *, (day + 1) * {DAY_US} AS time_us, {split_sql('day:', 'g')} AS split FROM l),
i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM p WHERE time_us >= {bound('start')} AND time_us < {bound('stop')}),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS pos, sum(v + n) OVER (PARTITION BY user_id, island ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS total FROM i)
SELECT user_id::VARCHAR AS device, split, time_us - 5 * {DAY_US} AS first_us, time_us AS last_us, round(total, 4) AS total FROM c WHERE pos >= 6 AND (pos - 6) % 3 = 0""")
def study_reports(spark, sf):
    """Last reports of a day; devices that share hosts have one group and one split; two models leave a device out."""
    e = table(spark, sf, "events")
    r = e.select(F.col("user_id").alias("device"), (F.col("user_id") % 40).cast("string").alias("host"), F.when(F.col("user_id") % 10 == 3, F.col("event_type")).otherwise("m").alias("model"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.col("value").alias("v"), (F.col("event_id") % 9).cast("double").alias("n"))
    return totals(studies.report_windows(r, DAY, 6))


UNITS = {"view": "train", "signup": "train", "click": "validation", "error": "calibration", "purchase": "test"}
UNIT = Study("unit", "", (Channel("v"), Channel("n")), SLOT_US, TIMES, group_splits=UNITS)
INDUSTRIAL = f"""WITH s AS (SELECT event_type AS host, (epoch_us(ts) // {SLOT_US} + 1) * {SLOT_US} AS time_us, min(value) AS v, count(*)::DOUBLE AS n, max(event_id) % 11 <> 0 AS observed FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE host {' '.join(f"WHEN '{u}' THEN '{x}'" for u, x in UNITS.items())} END AS split FROM s),
o AS (SELECT *, observed AND time_us >= {bound('start')} AND time_us < {bound('stop')} AS ok FROM p),
r AS (SELECT *, coalesce(lag(ok) OVER w, false) AS before, time_us - lag(time_us) OVER w AS step FROM o WINDOW w AS (PARTITION BY host ORDER BY time_us)),
c AS (SELECT *, sum(CASE WHEN before AND step = {SLOT_US} THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY time_us) AS run FROM r WHERE ok),
k AS (SELECT *, row_number() OVER (PARTITION BY host, run ORDER BY time_us) - 1 AS pos FROM c)"""


def units(spark, sf) -> DataFrame:
    s = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    slot = s.groupBy(F.col("event_type").alias("group_id"), ((F.floor(F.col("us") / SLOT_US).cast("long") + 1) * SLOT_US).alias("time_us"))
    return slot.agg(F.min("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"), (F.max("event_id") % 11 != 0).alias("observed")).withColumn("device", F.col("group_id"))


@query(INDUSTRIAL + ", w AS (SELECT host, split, run, pos // 4 AS chunk, min(time_us) AS a, max(time_us) AS z, sum(v + n) AS total FROM k GROUP BY ALL HAVING count(*) = 4) SELECT host AS device, split, a AS first_us, z AS last_us, round(total, 4) AS total FROM w")
def study_industrial(spark, sf):
    """Units of declared splits: a row that wasn't observed, or a gap, ends a run."""
    return totals(studies.industrial_windows(units(spark, sf), UNIT, 4))


@query(INDUSTRIAL + f""", g AS (SELECT k.*, before AND step <> {SLOT_US} AND lag((pos + 1) % 4 <> 0) OVER (PARTITION BY host ORDER BY time_us) AS gap FROM k),
n AS (SELECT split, host, run, count(*) AS n FROM k GROUP BY ALL), x AS (SELECT split, sum(n // 4) AS windows, sum(n % 4) AS short_rows FROM n GROUP BY split), y AS (SELECT split, count(*) FILTER (gap) AS calendar_gaps FROM g GROUP BY split)
SELECT o.split AS split, count(*) AS source_rows, count(*) FILTER (NOT ok) AS excluded_rows, coalesce(any_value(calendar_gaps), 0) AS calendar_gaps, coalesce(any_value(windows), 0)::BIGINT AS windows, coalesce(any_value(short_rows), 0)::BIGINT AS short_rows FROM o LEFT JOIN x ON o.split = x.split LEFT JOIN y ON o.split = y.split GROUP BY o.split""")
def study_industrial_audit(spark, sf):
    return studies.industrial_audit(units(spark, sf), UNIT, 4)


DRIVE_TIMES = splits(("2024-01-03", "2024-01-20"), ("2024-01-08", "2024-01-31"), ("2024-01-05", "2024-01-28"), ("2024-01-02", "2024-01-30"))
DRIVE = Study("drive", "drive:", (Channel("v"), Channel("n")), DAY_US, DRIVE_TIMES)
DRIVES = DAILY + f""", h AS (SELECT *, 'm' || (user_id % 3) AS model, {split_sql('drive:', 'user_id')} AS split, max(failure) OVER (PARTITION BY user_id ORDER BY dt) AS failed FROM d),
o AS (SELECT *, failed = 0 AND dt BETWEEN {' '.join(['CASE split', *(f"WHEN '{s.name}' THEN DATE '{s.start}'" for s in DRIVE_TIMES), 'END'])} AND {' '.join(['CASE split', *(f"WHEN '{s.name}' THEN DATE '{s.stop}'" for s in DRIVE_TIMES), 'END'])} AS ok FROM h),
i AS (SELECT *, (dt - DATE '1970-01-01')::BIGINT - row_number() OVER (PARTITION BY user_id ORDER BY dt) AS island FROM o WHERE ok), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY dt) - 1 AS pos FROM i)"""


def drive_history(spark, sf) -> DataFrame:
    return daily(spark, sf).select(F.col("user_id").alias("device"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("dt").alias("day"), "failure", "v", F.col("n").cast("double").alias("n"))


@query(DRIVES + f", w AS (SELECT user_id, split, island, pos // 5 AS chunk, min(dt) AS a, max(dt) AS z, sum(v + n) AS total FROM k GROUP BY ALL HAVING count(*) = 5) SELECT user_id::VARCHAR AS device, split, ((a - DATE '1970-01-01')::BIGINT + 1) * {DAY_US} AS first_us, ((z - DATE '1970-01-01')::BIGINT + 1) * {DAY_US} AS last_us, round(total, 4) AS total FROM w")
def study_drives(spark, sf):
    """Drives by model and serial number: closed dates, nothing from a failure on."""
    return totals(studies.drive_windows(drive_history(spark, sf), DRIVE, 5))


@query(DRIVES + """, n AS (SELECT split, user_id, island, count(*) AS n FROM k GROUP BY ALL), x AS (SELECT split, sum(n // 5) AS windows, sum(n % 5) AS short_rows FROM n GROUP BY split)
SELECT o.split AS split, count(*) AS source_rows, count(*) FILTER (NOT ok) AS excluded_rows, coalesce(any_value(windows), 0)::BIGINT AS windows, coalesce(any_value(short_rows), 0)::BIGINT AS short_rows FROM o LEFT JOIN x ON o.split = x.split GROUP BY o.split""")
def study_drive_audit(spark, sf):
    return studies.drive_audit(drive_history(spark, sf), DRIVE, 5).drop("calendar_gaps")


@query(f"""WITH e AS (SELECT user_id, event_type AS g, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, value AS v, (event_id % 9)::DOUBLE AS n FROM events)
SELECT 'clip:' || user_id || '-' || g AS device, CASE g {' '.join(f"WHEN '{u}' THEN '{x}'" for u, x in UNITS.items())} END AS split, (min(k) * 32000)::BIGINT AS first_us, (max(k) * 32000)::BIGINT AS last_us, round(sum(v + n), 4) AS total FROM e GROUP BY user_id, g, (k - 1) // 3 HAVING count(*) = 3""")
def study_clips(spark, sf):
    """Frames of clips, told apart by offsets alone."""
    e = table(spark, sf, "events")
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    frames_ = e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("recording"), F.col("event_type").alias("group_id"), (k * 32_000).cast("long").alias("times_us"), F.col("value").alias("v"), (F.col("event_id") % 9).cast("double").alias("n"))
    return totals(studies.clip_windows(frames_, UNIT, 3))


LOGS = f"""WITH RECURSIVE l AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_type FROM events), t AS (SELECT user_id, min(epoch_us(ts) // 1000000) AS alarm_s FROM events WHERE value >= 200 GROUP BY user_id),
b AS (SELECT l.*, t.alarm_s AS alarm_s FROM l LEFT JOIN t ON l.user_id = t.user_id WHERE t.alarm_s IS NULL OR l.s < t.alarm_s),
e AS (SELECT user_id, s // 86400 AS day, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS n, count(*) FILTER (event_type NOT IN ('view', 'error')) AS others, min(min(s)) OVER (PARTITION BY user_id) AS first_log, min(alarm_s) AS alarm_s FROM b GROUP BY user_id, s // 86400),
p AS (SELECT *, (day + 1) * {DAY_US} AS cutoff, (day - 3) * {DAY_US} AS origin, {split_sql('day:', 'user_id')} AS split FROM e),
k AS (SELECT * FROM p WHERE v + n > 0 AND {bound('start')} <= origin AND cutoff < {bound('stop')} AND origin >= first_log * 1000000 AND (alarm_s IS NULL OR cutoff < alarm_s * 1000000)),
g AS (SELECT user_id, split, min(day) AS day FROM k GROUP BY user_id, split UNION ALL SELECT user_id, split, (SELECT min(k.day) FROM k WHERE k.user_id = g.user_id AND k.day >= g.day + 3) AS day FROM g WHERE day IS NOT NULL)"""
KINDS = {"v": "view", "n": "error"}


def error_days(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    logs = e.select(F.col("user_id").alias("device"), F.col("s").alias("time_s"), F.col("event_type").alias("kind"))
    return studies.error_days(logs, e.where("value >= 200").select(F.col("user_id").alias("device"), F.col("s").alias("alarm_s")), KINDS)


@query(LOGS + " SELECT user_id AS device, day, v, n, others, first_log, alarm_s FROM e")
def error_counts(spark, sf):
    return error_days(spark, sf)


@query(LOGS + f", w AS (SELECT user_id, split, day FROM g WHERE day IS NOT NULL) SELECT w.user_id::VARCHAR AS device, w.split AS split, (w.day - 3) * {DAY_US} AS first_us, (w.day + 1) * {DAY_US} AS last_us, coalesce(sum(e.v + e.n), 0)::DOUBLE AS total FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.day BETWEEN w.day - 4 AND w.day GROUP BY w.user_id, w.split, w.day")
def study_errors(spark, sf):
    """Windows over the calendar that end on days with errors, a stride apart, after the first log and before the ticket."""
    return totals(studies.error_windows(error_days(spark, sf), DAY, 5))


# --- reports and windows against their rules

REPORTS = """WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN 't' ELSE 'f' END AS invalid, strftime(ts + INTERVAL (CASE WHEN event_id % 13 = 0 THEN 40 ELSE 0 END) DAY, '%Y-%m-%d %H:%M:%S') AS stamp,
CASE WHEN event_id % 11 = 0 THEN 'none' ELSE upper(lpad(user_id::VARCHAR, 32, 'a')) END AS u, CASE WHEN event_id % 7 = 0 THEN 'ATA' ELSE 'NVMe' END AS protocol, value::INT AS temperature, event_id % 300 AS used, event_id AS hours FROM events)"""


@query(REPORTS + """SELECT event_id, CASE WHEN invalid <> 'f' THEN 'marked invalid' WHEN u = 'none' THEN 'device' WHEN stamp[1:7] <> '2024-01' THEN 'month' WHEN protocol <> 'NVMe' THEN 'protocol' WHEN temperature > 200 THEN 'temperature' WHEN used > 255 THEN 'percentage used' END AS reason,
CASE WHEN u <> 'none' THEN lower(u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32]) END AS device FROM r""")
def report_reasons(spark, sf):
    """Monthly JSON reports through the whole set of rules: the first one that each breaks."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    late = F.when(i % 13 == 0, F.expr("interval 40 days")).otherwise(F.expr("interval 0 days"))
    body = F.struct(F.struct(F.when(i % 7 == 0, "ATA").otherwise("NVMe").alias("protocol")).alias("device"), F.struct(F.lit(0).alias("media_errors"), (i % 300).alias("percentage_used"), F.bround("value").cast("int").alias("temperature"), i.alias("power_on_hours")).alias("nvme_smart_health_information_log"))
    rows = e.select("event_id", F.when(i % 17 == 0, "t").otherwise("f").alias("invalid"), F.date_format(F.col("ts") + late, "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(i % 11 == 0, "none").otherwise(F.upper(F.lpad(F.col("user_id").cast("string"), 32, "a"))).alias("device_uuid"), F.to_json(body).alias("report"))
    return quality.report_rows(rows, "2024-01").select("event_id", "reason", "device")


FAULTS = TILES + ", w AS (SELECT user_id, tile, epoch_us(last_ts) AS z, v FROM t), f AS (SELECT g.user_id AS user_id, g.tile AS tile, epoch_us(min(r.ts)) AS a FROM g JOIN r ON r.user_id = g.user_id AND r.n // 28 = g.tile GROUP BY g.user_id, g.tile)"


@query(FAULTS + f"SELECT w.user_id AS user_id, w.tile AS tile, CASE WHEN w.tile % 4 = 1 THEN 'channels' WHEN a < {micros('2024-01-02')} OR z >= {micros('2024-01-25')} THEN 'split time' WHEN w.tile % 4 = 2 THEN 'values' END AS reason FROM w JOIN f ON w.user_id = f.user_id AND w.tile = f.tile")
def window_reasons(spark, sf):
    t = tiled(spark, sf)
    second = F.when(F.col("tile") % 4 == 1, "other").otherwise("reversed")
    bad = F.when(F.col("tile") % 4 == 2, F.transform("value", lambda x: x / F.nullif(x - x, F.lit(0.0)))).otherwise(F.reverse("value"))
    w = t.select("user_id", "tile", F.transform("ts", lambda x: F.unix_micros(x.cast("timestamp"))).alias("times_us"), F.array(F.lit("value"), second).alias("channels"), F.array("value", bad).alias("values"))
    return quality.window_faults(w, None, ("value", "reversed"), F.lit(micros("2024-01-02")), F.lit(micros("2024-01-25"))).select("user_id", "tile", "reason")


@query(TILES + "SELECT user_id, tile FROM t WHERE tile % 4 IN (1, 2)")
def input_faults(spark, sf):
    """Windows that may not become model inputs: an unknown channel, or a value that is no number."""
    t = tiled(spark, sf)
    bad = F.when(F.col("tile") % 4 == 2, F.transform("value", lambda x: F.lit(float("nan")))).otherwise(F.reverse("value"))
    w = t.select("user_id", "tile", F.array(F.lit("value"), F.when(F.col("tile") % 4 == 1, "other").otherwise("reversed")).alias("channels"), F.array("value", bad).alias("values"))
    return features.check_inputs(w, ("value", "reversed")).select("user_id", "tile")


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 500 = 499 THEN NULL WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN ts::TIMESTAMP(0) - INTERVAL 10 DAY ELSE date_trunc('second', ts) END AS t FROM events),
y AS (SELECT *, t > lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS up, event_id = min(event_id) OVER (PARTITION BY user_id) AS head FROM x)
SELECT user_id, count(*) AS rows, min(t)::DATE AS first_day, bool_and(t IS NOT NULL AND coalesce(up, head)) AS sound FROM y GROUP BY user_id""")
def ordered_tables(spark, sf):
    """Tables of time texts: whether each parses and rises from row to row."""
    i, t = F.col("event_id"), F.col("ts")
    moved = F.when((F.col("user_id") % 3 == 0) & (i % 50 == 0), t - F.expr("interval 10 days")).otherwise(t)
    text = F.when(i % 500 == 499, "unknown").otherwise(F.date_format(moved, "dd-MMM-yyyy HH:mm:ss"))
    o = quality.ordered_times(table(spark, sf, "events").select("user_id", i.alias("row"), text.alias("text")), "user_id", "text")
    return o.select("user_id", "rows", F.to_date("first").alias("first_day"), "sound")


@query("SELECT o_orderkey, o_totalprice <= 300000 AND o_orderkey % 9 <> 0 AS counts FROM orders")
def valve_range(spark, sf):
    marks = F.array(F.lit("observed"), F.when(F.col("o_orderkey") % 9 == 0, "imputed").otherwise("observed"))
    return table(spark, sf, "orders").select("o_orderkey", quality.valve_position(F.when(F.col("o_totalprice") <= 300000, 800).otherwise(801), marks).alias("counts"))


# --- evaluation


SEEN = [f"SELECT user_id, tile, {w} AS weight, {x} AS v FROM {t}" for w, x, t in ((2, "v", "t"), (1, "list_reverse(v)", "t"), (1, "v", "sh"))]


@query(TILES + f""", sh AS (SELECT user_id, tile, list(x ORDER BY h) AS v FROM (SELECT user_id, tile, v[i + 1] AS x, sha256('612:' || user_id || '/' || tile || '|' || i) AS h FROM (SELECT user_id, tile, v, unnest(range(0, 28)) AS i FROM t)) GROUP BY user_id, tile),
vw AS ({' UNION ALL '.join(SEEN)}), m3 AS (SELECT weight, list_max(v) - list_min(v) AS span, list_sort(v[22:28])[4] - list_sort(v[1:7])[4] AS change FROM vw),
k AS (SELECT weight, CASE WHEN span = 0 THEN 0 WHEN change >= greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 1 WHEN change <= -greatest(1.0::DOUBLE, span * 0.1::DOUBLE) THEN 2 ELSE 3 END AS code FROM m3)
SELECT code, count(*) AS windows, sum(weight)::BIGINT AS support FROM k GROUP BY code""")
def weighted_support(spark, sf):
    t = tiled(spark, sf).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.col("tile").cast("string"))).drop("code")
    return evaluation.weighted_support(t, "value", "key")


FIRST = 400  # windows, so that the smallest tables have some behind it


@query(TILES + f""", b AS (SELECT *, user_id % 3 AS file, tile % 5 AS grp, user_id // 4 AS batch FROM t), n AS (SELECT file, grp, batch, count(*) AS n FROM b GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file, grp, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT code, count(*) AS windows, count(DISTINCT (file, grp, batch)) AS batches FROM b JOIN u USING (file, grp, batch) WHERE before < {FIRST} GROUP BY code""")
def first_support(spark, sf):
    """Patterns among the windows of the first batches that hold enough of them."""
    t = tiled(spark, sf).withColumns({"file": F.col("user_id") % 3, "group": F.col("tile") % 5, "batch": F.floor(F.col("user_id") / 4)})
    return evaluation.first_batches(t, ["file", "group", "batch"], FIRST).groupBy("code").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("file", "group", "batch").alias("batches"))


TIMES = """WITH e AS (SELECT event_id, event_id % 8 AS k, date_trunc('second', ts) AS s, ts FROM events)
SELECT event_id, CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s - INTERVAL 90 MINUTE WHEN 3 THEN date_trunc('day', s) WHEN 4 THEN ts WHEN 5 THEN TIMESTAMP '2024-06-01 00:00:00' WHEN 6 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE date_trunc('minute', s) + INTERVAL 5 HOUR END AS at,
CASE k WHEN 1 THEN s WHEN 2 THEN s - INTERVAL 90 MINUTE WHEN 7 THEN date_trunc('minute', s) + INTERVAL 5 HOUR END AS strict_at FROM e"""


@query(TIMES)
def parsed_times(spark, sf):
    """Times in the forms that runs and reports have: naive, with offsets, dates, and what is no time."""
    e, at = table(spark, sf, "events"), lambda form: F.date_format("ts", form)
    text = F.get(F.array(at("yyyy-MM-dd HH:mm:ss"), F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")), at("yyyy-MM-dd"), at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("yesterday"), F.lit(None).cast("string"), F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit("-05:00"))), (F.col("event_id") % 8).cast("int"))
    naive = lambda c: c.cast("timestamp_ntz")
    return e.select("event_id", naive(S.parse_time(text, F.lit("2024-06-01 00:00:00").cast("timestamp"))).alias("at"), naive(S.parse_time(text, offset=True)).alias("strict_at"))


@query(RULED + """, c AS (SELECT quality AS class, count(*) AS support FROM r GROUP BY quality), f AS (SELECT c.class AS class, 2.0::DOUBLE * count(*) FILTER (r.said = r.quality AND r.quality = c.class) / (any_value(c.support) + count(*) FILTER (r.said = c.class)) AS f1 FROM c CROSS JOIN r GROUP BY c.class)
SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM f""")
def macro_f1(spark, sf):
    return evaluation.macro(ruled(spark, sf), "quality", "said").withColumn("macro_f1", F.round("macro_f1", 6))


@query(TILES + f""", a AS (SELECT user_id, tile, code, CASE WHEN code = 1 THEN 2 ELSE code END AS shown, tile % 3 <> 0 AS valid FROM t)
SELECT count(*) AS windows, count(*) AS channel_labels, round(avg(valid::INT), 6) AS valid_output_rate, round(avg((valid AND code = shown)::INT), 6) AS exact_window_accuracy, round(avg((valid AND code = shown)::INT), 6) AS channel_accuracy,
round(count(*) FILTER (valid AND shown <> 0 AND code <> 0)::DOUBLE / greatest(1, count(*) FILTER (valid AND shown <> 0)), 6) AS changed_channel_precision, round(count(*) FILTER (valid AND shown <> 0 AND code <> 0)::DOUBLE / greatest(1, count(*) FILTER (code <> 0)), 6) AS changed_channel_recall FROM a""")
def answer_summary(spark, sf):
    shown = F.when(F.col("code") == 1, 2).otherwise(F.col("code"))
    said = F.concat(F.lit("value: "), S.pattern(shown), F.lit("."))
    t = tiled(spark, sf).select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("tile").cast("string")).alias("key"), F.array(F.lit("value")).alias("channels"), F.concat(F.lit("value: "), S.pattern(F.col("code")), F.lit(".")).alias("target"), F.when(F.col("tile") % 3 == 0, F.concat(said, F.lit(" and so on"))).otherwise(said).alias("output"))
    s = evaluation.summary(evaluation.scored(t, "key", "channels", "target", "output"), "key")
    return s.select("windows", "channel_labels", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query(RULED + """, z AS (SELECT quality AS t, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS t2, said, CASE WHEN doc_id % 2 = 0 THEN 1 - said ELSE said END AS said2 FROM r)
SELECT count(*) AS changed, round(avg((said2 = t2)::INT), 6) AS actual, round(avg((said = t2)::INT), 6) AS unchanged, round(avg((said2 = t2)::INT) - avg((said = t2)::INT), 6) AS gain FROM z WHERE t <> t2""")
def counterfactual_gain(spark, sf):
    i = F.col("doc_id")
    r = ruled(spark, sf).withColumn("t2", F.when(i % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("said2", F.when(i % 2 == 0, 1 - F.col("said")).otherwise(F.col("said")))
    r = r.withColumn("right", (F.col("said2") == F.col("t2")).cast("int")).withColumn("old", (F.col("said") == F.col("t2")).cast("int"))
    g = evaluation.counterfactual(r, "quality", "t2", "right", "old")
    return g.select("changed", *(F.round(c, 6).alias(c) for c in ("actual", "unchanged", "gain")))


NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(evaluation.REPORT_CHECKS))


@query(f"""WITH n(i, name) AS (VALUES {NAMES}), c AS (SELECT n.name AS name, i < 5 OR max(e.value) > 1e9 AS ok FROM n JOIN events e ON e.event_id % 7 = n.i GROUP BY n.name, n.i),
x AS (SELECT bool_and(ok) FILTER (name NOT LIKE '%_target_response') AS others, count(*) FILTER (NOT ok) > 0 AS failed, count(*) AS n FROM c), m AS (SELECT count(DISTINCT event_type) AS groups, avg(value) AS gain FROM events)
SELECT x.n = 7 AND failed AND others AND m.groups = 5 AND m.gain > 0 AS eligible, x.n = 7 AS complete, failed AND others AS limited, m.groups = 5 AND m.gain > 0 AS supported FROM x, m""")
def follow_up_eligible(spark, sf):
    e = table(spark, sf, "events")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(evaluation.REPORT_CHECKS) for x in (i, c)])
    n = (F.col("event_id") % 7).cast("int")
    checks = e.groupBy(n.alias("i")).agg(F.max("value").alias("most")).select(F.element_at(place, F.col("i")).alias("check"), ((F.col("i") < 5) | (F.col("most") > 1e9)).alias("ok"))
    shown = e.agg(F.count_distinct("event_type").alias("groups"), F.avg("value").alias("gain_low")).select(F.explode(F.array(*map(F.lit, evaluation.SUPPORT_CHECKS))).alias("mode"), "groups", "gain_low", F.lit(0.03).alias("probability"), F.lit(False).alias("support_sufficient"))
    return evaluation.follow_up(checks, shown)


@query("SELECT d.source AS source, count(*) AS examples, round(avg(l.quality - l.toxic), 6) AS gain FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source")
def paired_gain(spark, sf):
    """Two scores of each example side by side, averaged within groups."""
    rows = table(spark, sf, "labels")
    both = evaluation.paired(rows.select("doc_id", F.col("quality").cast("double").alias("s")), rows.select("doc_id", F.col("toxic").cast("double").alias("s")), "doc_id", "s")
    return both.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg(F.col("first") - F.col("second")), 6).alias("gain"))


# --- joins and orders


@query("SELECT o.o_orderkey AS task, c.c_mktsegment AS record, o.o_orderpriority AS partition FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'")
def task_record(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    tasks = o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("customer"))
    records = c.select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("record"))
    notes = o.select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("partition"))
    return relations.task_records(tasks, o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("of")), notes, "task", "kind", "F", "partition").join(records, "customer").select("task", "record", "partition")


@query("""WITH l AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 2 = 0 THEN upper(' ' || s_name || ' ') ELSE s_name END AS serial FROM supplier),
k AS (SELECT s_suppkey + 1 AS place, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'scan-' || s_suppkey END AS serial, s_acctbal AS life FROM supplier WHERE s_suppkey % 5 <> 0),
a AS (SELECT l.place AS place, k.place AS found, k.life AS life FROM l LEFT JOIN k ON lower(trim(l.serial)) = lower(trim(k.serial))),
f AS (SELECT * FROM k WHERE place NOT IN (SELECT found FROM a WHERE found IS NOT NULL))
SELECT a.place AS place, coalesce(a.found, f.place) AS found, coalesce(a.life, f.life) AS life FROM a LEFT JOIN f ON a.place = f.place""")
def disk_merge(spark, sf):
    """Listed disks and scanned ones: by serial, else by place among those left."""
    s, k, name = table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_name")
    listed = s.select(k.alias("place"), F.when(k % 2 == 0, F.upper(F.concat(F.lit(" "), name, F.lit(" ")))).otherwise(name).alias("serial"))
    scanned = s.where(k % 5 != 0).select((k + 1).alias("place"), F.when(k % 3 == 1, name).otherwise(F.concat(F.lit("scan-"), k.cast("string"))).alias("serial"), F.col("s_acctbal").alias("life"))
    return relations.merge_disks(listed, scanned).select("place", F.col("scan.place").alias("found"), F.col("scan.life").alias("life"))


@query("WITH m AS (SELECT l_orderkey, list_sort(list(DISTINCT l_shipmode)) AS ms FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_orderkey) SELECT l_orderkey, u.x AS member, array_to_string(list_filter(ms, lambda y: y <> u.x), ',') AS others FROM m, unnest(ms) AS u(x)")
def association_members(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("ms"))
    return relations.association(g, "ms", "l_orderkey").withColumn("others", F.array_join("others", ","))


MACHINES = "m AS (SELECT c_custkey AS machine, CASE WHEN n_regionkey = 4 THEN 'local' ELSE r_name END AS site, CASE WHEN n_regionkey = 4 THEN 'bench' ELSE 'rack-' || n_nationkey END AS rack FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def machines(spark, sf) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    at = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    away = F.col("n_regionkey") != 4
    rows = at.select(F.col("c_custkey").alias("machine"), F.when(away, F.col("r_name")).alias("site"), F.when(away, F.concat(F.lit("rack-"), F.col("n_nationkey").cast("string"))).otherwise("").alias("rack"))
    sites = r.where("r_regionkey < 3").select(F.col("r_name").alias("site"), F.lower("r_name").alias("name"), F.lit("known").alias("region"), F.lit("datacenter").alias("kind"))
    return fleet.sites_of(rows, sites)


@query(f"WITH {MACHINES} SELECT machine, site, rack, CASE WHEN r.r_regionkey < 3 THEN lower(site) ELSE site END AS name, CASE WHEN r.r_regionkey < 3 THEN 'known' ELSE '' END AS region, CASE WHEN r.r_regionkey < 3 THEN 'datacenter' ELSE 'office' END AS kind FROM m LEFT JOIN region r ON m.site = r.r_name")
def site_dimension(spark, sf):
    return machines(spark, sf).select("machine", "site", "rack", "name", "region", "kind")


@query(f"WITH {MACHINES}, r AS (SELECT DISTINCT site, rack FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rack) - 1 AS n FROM r) SELECT site, rack, upper(rack[1]) || replace(rack[2:], '-', ' ') AS title, (n // 4)::INT AS row, (n % 4)::INT AS col FROM k")
def rack_grid(spark, sf):
    return fleet.rack_grid(machines(spark, sf))


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(nullif(s_suppkey % 7, 0), 99), s_name)::INT AS place FROM supplier")
def slot_order(spark, sf):
    s = table(spark, sf, "supplier").withColumn("slot", F.col("s_suppkey") % 7)
    return s.select("s_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*fleet.device_order("slot", "s_name"))).alias("place"))


@query("SELECT event_id, user_id FROM events ORDER BY sha256('612:' || event_id), event_id LIMIT 1 OFFSET 41")
def page_at(spark, sf):
    order = [S.salted_hash("612:", "event_id"), F.col("event_id")]
    return sampling.Ranked(table(spark, sf, "events").select("event_id", "user_id"), order, scratch_folder(spark)).page(41)


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events")
def event_rank(spark, sf):
    """The place of every event by value, over the whole table."""
    return sampling.Ranked(table(spark, sf, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")], scratch_folder(spark)).rows().drop("value")


@query(PARTS + ", d AS (SELECT device, site, rack, min(health) AS h, arg_min(status, health) AS status FROM q GROUP BY device, site, rack) SELECT device, site, h, status FROM d WHERE contains(lower(device || ' ' || rack || ' ' || site), 'a') AND status <> 'healthy' AND site = 'ASIA'")
def fleet_table(spark, sf):
    """Devices by text and site, worst first."""
    worst = F.min(F.struct("health", "component"))
    d = parts(spark, sf).groupBy("device", "site", "rack").agg(worst.alias("w")).select(F.col("device").cast("string").alias("device"), F.col("device").alias("id"), F.col("device").cast("string").alias("label"), "site", "rack", F.lit("").alias("worst"), F.col("w.health").alias("h"))
    d = d.withColumn("status", S.status("h")).withColumn("level", S.status_order("status")).withColumn("priority", 100 - F.col("h"))
    return fleet.search(d, "A", "ASIA").where("status <> 'healthy'").select(F.col("id").alias("device"), "site", "h", "status")


@query(PARTS + """, n AS (SELECT rack, component, list_sort(list(health))[len(list(health)) // 2 + 1] AS m, count(*) AS peers, count(*) FILTER (health < 80) AS low FROM q GROUP BY rack, component)
SELECT q.device AS device, q.component AS component, n.m AS peer_median, n.peers::BIGINT AS peers, n.low::BIGINT AS peers_under_80, round((SELECT count(*) FROM q o WHERE o.rack = q.rack AND o.component = q.component AND o.health > q.health)::DOUBLE / n.peers, 6) AS share_above FROM q JOIN n ON q.rack = n.rack AND q.component = n.component""")
def fleet_comparison(spark, sf):
    p = relations.peers(parts(spark, sf), "rack", "component", "device", "health")
    return p.select("device", "component", "peer_median", "peers", "peers_under_80", F.round("share_above", 6).alias("share_above"))


SITES = FRAMES + """, l AS (SELECT user_id, dt, round(h, 4) AS h, level, ['healthy', 'watch', 'elevated', 'critical'][level + 1] AS status, n FROM f JOIN d USING (user_id, dt)),
b AS (SELECT user_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS base FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dt) AS k FROM l) WHERE k <= 5 GROUP BY user_id),
s AS (SELECT l.user_id AS user_id, l.dt AS day, 'site-' || (l.user_id % 3) AS site, 'rack-' || (l.user_id % 10) AS rack, h, level, status, level > 0 OR (n > 1 AND h <= b.base - 2) AS drifting FROM l JOIN b ON l.user_id = b.user_id)"""


def in_event_order(spark, sf) -> DataFrame:
    """(user_id, dt, v, n) of ``daily``; a day's values add up in the order of its events, so that a mean is the same however the table is split."""
    day = Window.partitionBy("user_id", "dt").orderBy("ts", "event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("dt"), "ts", "event_id", "value")
    so_far = e.select("user_id", "dt", "value", F.sum("value").over(day).alias("total"), F.row_number().over(day).alias("place"))
    return so_far.groupBy("user_id", "dt").agg(F.try_divide(F.max_by("total", "place"), F.count("value")).alias("v"), F.count(F.lit(1)).alias("n"))


def site_inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    level = F.get(F.array(*map(F.lit, ("healthy", "watch", "elevated", "critical"))), F.col("level"))
    d = leveled(in_event_order(spark, sf)).where("user_id IS NOT NULL AND dt IS NOT NULL")
    days = d.select(F.col("user_id").alias("device"), F.col("dt").alias("day"), (F.round(F.col("h") * 10_000) / 10_000).alias("h"), "level", level.alias("status"), F.when(F.col("n") > 1, F.array(F.lit("storage"))).otherwise(F.array().cast("array<string>")).alias("groups"))
    named = lambda p, n: F.concat(F.lit(p), (F.col("device") % n).cast("string"))
    places = days.select("device").distinct().select("device", named("site-", 3).alias("site"), named("rack-", 10).alias("rack"))
    return days, places, windows.baseline(days, "device", "day", "h")


@query(SITES + "SELECT day, site, count(*) AS known, count(DISTINCT rack) AS racks, round(avg(h), 9) AS health, ['healthy', 'watch', 'elevated', 'critical'][max(level) + 1] AS status, count(*) FILTER (drifting) AS drifting, count(*) FILTER (level = 0) AS n_healthy, count(*) FILTER (level = 1) AS n_watch, count(*) FILTER (level = 2) AS n_elevated, count(*) FILTER (level = 3) AS n_critical FROM s GROUP BY day, site")
def site_as_of(spark, sf):
    return fleet.site_as_of(*site_inputs(spark, sf)).withColumn("health", F.round(F.col("health") * 1e9) / 1e9)


@query(SITES + "SELECT day, site, user_id AS device, h FROM s WHERE drifting QUALIFY row_number() OVER (PARTITION BY day, site ORDER BY h, user_id) <= 8")
def most_drifting(spark, sf):
    return fleet.most_drifting(*site_inputs(spark, sf)).select("day", "site", "device", "h")


@query("SELECT round(sum(o_totalprice) / 1000000, 4) AS total_usd_upper, round(greatest(0, 600 - sum(o_totalprice) / 1000000), 4) AS remaining_usd FROM orders WHERE o_orderstatus = 'P'")
def cost_ledger(spark, sf):
    l = relations.ledger(table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_totalprice") / 1_000_000).alias("total_usd_upper")))
    return l.select(*(F.round(c, 4).alias(c) for c in ("total_usd_upper", "remaining_usd")))


@query("SELECT o_orderkey, o_orderdate::DATE AS dt FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest_snapshot(spark, sf):
    from gaugeworks.sources import readers

    return readers.snapshot(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))


# --- scalar functions


@query(TILES + "SELECT user_id, tile, round(CASE WHEN list_avg(v[1:9]) = 0 THEN 0 ELSE (list_avg(v[20:28]) - list_avg(v[1:9])) / abs(list_avg(v[1:9])) END, 6) AS change, round(list_aggregate(v, 'quantile_cont', 0.9), 6) AS upper, round(list_aggregate(v, 'stddev_pop') / abs(list_avg(v)), 6) AS variation FROM t")
def series_statistics(spark, sf):
    return tiled(spark, sf).select("user_id", "tile", F.round(S.relative_change("value"), 6).alias("change"), F.round(S.quantile("value", 0.9), 6).alias("upper"), F.round(S.variation("value"), 6).alias("variation"))


@query("SELECT o_orderkey, sha256(o_orderkey::VARCHAR)[1:2] AS bucket, o_orderdate::DATE AS day, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]', '-', 'g') AS safe, lower(trim(o_orderpriority)) = lower(trim(' ' || upper(o_orderpriority))) AS same_serial, round(log2(1 + greatest(0, o_totalprice - 100000)), 6) AS scale, CASE WHEN o_totalprice / 1000000 < 0.04 THEN 'LOW' WHEN o_totalprice / 1000000 < 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS exposure FROM orders")
def order_scalars(spark, sf):
    """Bucket, the three date formats, safe ids, serials, the log scale and exposure."""
    o, day = table(spark, sf, "orders"), F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "M/d/yy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "M/d/yyyy")).otherwise(day.cast("string"))
    p = F.col("o_orderpriority")
    return o.select("o_orderkey", S.hex_bucket("o_orderkey").alias("bucket"), S.parse_date(text).alias("day"), S.safe_id("o_orderpriority").alias("safe"), (F.lower(F.trim(p)) == F.lower(F.trim(F.concat(F.lit(" "), F.upper(p))))).alias("same_serial"),
                    F.round(S.log2p(F.col("o_totalprice") - 100000), 6).alias("scale"), S.exposure(F.col("o_totalprice") / 1_000_000, F.lit(1.0)).alias("exposure"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 255)::DOUBLE AS temperature, greatest(l_suppkey, l_linenumber)::DOUBLE AS uncorrectable, l_quantity AS pending FROM lineitem WHERE l_partkey & 255 <> 0")
def drive_counters(spark, sf):
    l = table(spark, sf, "lineitem")
    raw = F.create_map(F.lit("smart_194_raw"), (F.col("l_partkey") + 256 * 1000).cast("double"), F.lit("smart_187_raw"), F.col("l_suppkey").cast("double"), F.lit("smart_198_raw"), F.col("l_linenumber").cast("double"), F.lit("smart_197_raw"), F.col("l_quantity").cast("double"))
    c = l.select("l_orderkey", "l_linenumber", S.drive_stats_counters(raw).alias("c"))
    at = lambda k: F.try_element_at("c", F.lit(k))
    return c.select("l_orderkey", "l_linenumber", at("temperature_c").alias("temperature"), at("uncorrectable_errors").alias("uncorrectable"), at("pending_sectors").alias("pending")).where("temperature is not null")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS finite, true AS exact FROM embeddings")
def finite_values(spark, sf):
    """What is left of a series once its non-numbers go, here those made of what isn't positive."""
    xs = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(F.lit(float("nan"))))
    return table(spark, sf, "embeddings").select("vec_id", F.size(S.observed(xs)).cast("long").alias("finite"), S.exact_double(F.get("embedding", F.lit(0)).cast("double")).alias("exact"))


@query("WITH w AS (SELECT s_suppkey, (s_suppkey % 60 + 1)::DOUBLE / 2 AS low, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 60 + 1)::DOUBLE / 2 + s_suppkey % 9 END AS high FROM supplier) "
       "SELECT s_suppkey, CASE WHEN high IS NULL AND low < 14 THEN round_even(low, 0)::INT || '+ days' WHEN high IS NULL THEN round_even(low / 7, 0)::INT || '+ weeks' WHEN high < 14 THEN '~' || greatest(1, round_even(low, 0)::INT) || '–' || greatest(2, round_even(high, 0)::INT) || ' days' ELSE '~' || greatest(1, round_even(low / 7, 0)::INT) || '–' || greatest(2, round_even(high / 7, 0)::INT) || ' weeks' END AS label FROM w")
def failure_labels(spark, sf):
    k = F.col("s_suppkey")
    low = (k % 60 + 1).cast("double") / 2
    w = F.struct(low.alias("low_days"), F.when(k % 4 != 0, low + k % 9).alias("high_days"))
    return table(spark, sf, "supplier").select("s_suppkey", S.failure_window_label(w).alias("label"))
