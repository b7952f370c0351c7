"""Queries over telemetry runs: a run per user and day, made from `events` and `customer`, scored, replayed and asked.

A run has a processor (its peak from the day's largest value, errors of the day), a drive
(errors so far, a temperature from the least value) and a fan (speed from the least value),
so that all rules, growth, trends and groups of the scoring have something to say. The SQL
works the same runs out from the tables by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators import fleet, questions, sampling, windows
from gaugeworks.session import scratch_folder, table, written

from .catalog import query

NOW = "2024-01-29 12:00:00"
SITES = ("north", "east", "west")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry runs (``fleet.RUN``) of each user and day."""
    e, c = table(spark, sf, "events"), table(spark, sf, "customer")
    days = e.groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count_if(F.col("event_type") == "error").alias("errs"))
    so_far = F.sum("errs").over(Window.partitionBy("user_id").orderBy("dt")).cast("double")
    rows = days.withColumn("moved", so_far).join(c.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left")
    strings, numbers = F.expr("cast(map() as map<string,string>)"), F.expr("cast(map() as map<string,double>)")
    none = F.expr("cast(map() as map<string,array<double>>)")

    def part(name: str, kind: str, title: str, static=strings, smart=numbers, series=none):
        return F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(title).alias("name"), static.alias("static"), smart.alias("smart"), series.alias("series"), F.expr("cast(null as map<string,string>)").alias("drive_stats"))

    of = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    parts = F.array(
        part("cpu0", "cpu", "CPU", of(hardware_errors_30d=F.col("errs").cast("string")), series=of(temp_c=F.array(F.least(F.lit(99.0), 40 + F.col("hi") / 2)))),
        part("disk0", "storage", "Drive", of(redundancy=F.when(F.col("user_id") % 6 == 0, "raid6").otherwise("none")), of(reallocated_sectors=F.col("moved"), temperature_c=30 + F.col("lo") / 2)),
        part("fan0", "cooling", "Fan", of(rated_rpm=F.lit("9000")), series=of(rpm=F.array(9000 - 20 * F.col("lo")))),
    )
    site = F.get(F.array(*map(F.lit, SITES)), (F.col("user_id") % 3).cast("int"))
    rack = F.concat(site, F.lit("-rack-"), F.floor(F.col("user_id") / 30).cast("string"))
    name = F.concat(F.lit("d"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    level = F.when(F.col("c_mktsegment") == "MACHINERY", "high").when(F.col("c_mktsegment") == "HOUSEHOLD", "low").otherwise("medium")
    machine = F.struct(name.alias("id"), name.alias("hostname"), F.upper(name).alias("label"), F.lit("server").alias("form_factor"), level.alias("criticality"), site.alias("site"), rack.alias("rack"), (F.col("user_id") % 7).cast("int").alias("slot"))
    return rows.select(F.lit("run-v1").alias("schema"), F.when(F.col("user_id") % 5 == 0, "agent").otherwise("demo").alias("source"), F.col("dt").cast("timestamp").alias("collected_at"), machine.alias("machine"), parts.alias("components"))


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.analyse(runs(spark, sf))


def kept(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """What timelines read of the analysis; they do so several times, so it is written once."""
    few = ["device", "label", "site", "rack", "slot", "source", "t", "component", "name", "health", "slope", "status", "trend", "group", "signal", "priority_score"]
    return written(analysis(spark, sf).select(*few), f"{folder}/analysis")


def _steps(x: str, *at: tuple[int, int]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN {p}::DOUBLE" for b, p in at) + " ELSE 0::DOUBLE END"


def _risk(days: str) -> str:
    """The chance of a failure within ``days``, step by step."""
    return f"(1 - exp(-coalesce(list_sum(list_transform(range(0, ({days} * 4)::BIGINT), lambda k: (0.0004::DOUBLE + 0.35::DOUBLE * pow((100 - greatest(0::DOUBLE, health + least(0::DOUBLE, slope) * (k * 0.25::DOUBLE + 0.125::DOUBLE))) / 100, 3)) * 0.25::DOUBLE)), 0)))"


STATUS = "CASE WHEN {h} >= 80 THEN 'healthy' WHEN {h} >= 65 THEN 'watch' WHEN {h} >= 45 THEN 'elevated' ELSE 'critical' END"
LEVEL = "CASE {s} WHEN 'watch' THEN 1 WHEN 'elevated' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END"
FALLING = "('deteriorating', 'slowly deteriorating')"

#: a: every component of every run, as the engine scores it
ANALYSIS = f"""
WITH day AS (SELECT user_id, ts::DATE AS dt, max(value) AS hi, min(value) AS lo, count(*) FILTER (event_type = 'error') AS errs FROM events GROUP BY ALL),
run AS (SELECT user_id, dt, errs::DOUBLE AS errs, (sum(errs) OVER (PARTITION BY user_id ORDER BY dt))::DOUBLE AS moved, least(99::DOUBLE, 40 + hi / 2) AS peak, 30 + lo / 2 AS drive, (9000 - 20 * lo) / 9000 AS share FROM day),
part AS (
  SELECT user_id, dt, 'cpu0' AS component, 'cpu' AS type, 'thermal' AS grp, 'CPU' AS name, 0.8::DOUBLE AS w, 2 AS signals, errs AS m, 0.8::DOUBLE AS gw, 'Hardware error events growth' AS gl,
    [{{'p': {_steps('peak', (95, 22), (88, 12), (80, 4))}, 's': 'Temperature'}}, {{'p': CASE WHEN errs > 0 THEN least(30::DOUBLE, 10 + 5 * log2(1 + errs)) ELSE 0::DOUBLE END, 's': 'Hardware error events'}}] AS e FROM run
  UNION ALL SELECT user_id, dt, 'disk0', 'storage', 'storage', 'Drive', 1.0::DOUBLE * CASE WHEN user_id % 6 = 0 THEN 0.6::DOUBLE ELSE 1.3::DOUBLE END, 2, moved, 1.0::DOUBLE, 'Reallocated sectors growth',
    [{{'p': CASE WHEN moved > 0 THEN least(38::DOUBLE, 10 + 4 * log2(1 + moved)) ELSE 0::DOUBLE END, 's': 'Reallocated sectors'}}, {{'p': {_steps('drive', (60, 10), (50, 4))}, 's': 'Drive temperature'}}] FROM run
  UNION ALL SELECT user_id, dt, 'fan0', 'cooling', 'thermal', 'Fan', 0.75::DOUBLE, 1, NULL::DOUBLE, 0::DOUBLE, '',
    [{{'p': CASE WHEN share < 0.75::DOUBLE THEN least(26::DOUBLE, 60 * (1 - share)) ELSE 0::DOUBLE END, 's': 'Fan speed'}}, {{'p': CASE WHEN peak >= 85 THEN 10::DOUBLE ELSE 0::DOUBLE END, 's': 'Fan response'}}] FROM run),
back AS (SELECT *, first_value(m) OVER b AS m0, greatest(0.5::DOUBLE, (dt - first_value(dt) OVER b)::DOUBLE) AS days FROM part WINDOW b AS (PARTITION BY user_id, component ORDER BY dt ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
proof AS (SELECT *, list_filter(list_append(e, {{'p': CASE WHEN coalesce(m - m0 > 0 AND ((m - m0) / days > 0.5::DOUBLE OR m - m0 >= 5), false) THEN least(15::DOUBLE, gw * (3 + 2.5::DOUBLE * log2(1 + (m - m0) / days))) ELSE 0::DOUBLE END, 's': gl}}), lambda x: x.p > 0) AS ev FROM back),
cost AS (SELECT *, round(greatest(1::DOUBLE, 100 * exp(-coalesce(list_sum(list_transform(ev, lambda x: x.p)), 0) / 85)), 1) AS health FROM proof),
line AS (SELECT *, row_number() OVER o AS n, (dt - first_value(dt) OVER o)::DOUBLE AS x FROM cost WINDOW o AS (PARTITION BY user_id, component ORDER BY dt)),
sums AS (SELECT *, sum(x) OVER o AS sx, sum(health) OVER o AS sy, sum(x * x) OVER o AS sxx, sum(x * health) OVER o AS sxy, round(regr_slope(health, x) OVER (PARTITION BY user_id, component ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS recent FROM line WINDOW o AS (PARTITION BY user_id, component ORDER BY dt)),
halves AS (SELECT s.*, h.n AS hn, h.sx AS hx, h.sy AS hy, h.sxx AS hxx, h.sxy AS hxy, j.n AS jn, j.sx AS jx, j.sy AS jy, j.sxx AS jxx, j.sxy AS jxy FROM sums s
  LEFT JOIN sums h ON s.user_id = h.user_id AND s.component = h.component AND h.n = s.n // 2 LEFT JOIN sums j ON s.user_id = j.user_id AND s.component = j.component AND j.n = s.n // 2 + 1),
fits AS (SELECT *, CASE WHEN n >= 3 THEN x ELSE 0 END AS span, n >= 3 AND x >= 0.5::DOUBLE AS known, round(CASE WHEN jn * jxx - jx * jx > 1e-9 THEN (jn * jxy - jx * jy) / (jn * jxx - jx * jx) ELSE 0 END, 9) AS early,
  round(CASE WHEN (n - hn) * (sxx - hxx) - (sx - hx) * (sx - hx) > 1e-9 THEN ((n - hn) * (sxy - hxy) - (sx - hx) * (sy - hy)) / ((n - hn) * (sxx - hxx) - (sx - hx) * (sx - hx)) ELSE 0 END, 9) AS late FROM halves),
tr AS (SELECT *, CASE WHEN known THEN coalesce(recent, 0) ELSE 0 END AS slope, coalesce(known AND late < -1 AND late < 1.5::DOUBLE * least(early, -0.3::DOUBLE), false) AS accelerating FROM fits),
sc AS (SELECT t.*, 'd' || lpad(t.user_id::VARCHAR, 6, '0') AS device, ['north', 'east', 'west'][t.user_id % 3 + 1] AS site, (t.user_id % 7)::INT AS slot, CASE WHEN t.user_id % 5 = 0 THEN 'agent' ELSE 'demo' END AS source, ev,
  w * CASE c_mktsegment WHEN 'MACHINERY' THEN 1.3::DOUBLE WHEN 'HOUSEHOLD' THEN 0.7::DOUBLE ELSE 1::DOUBLE END AS weight, {_risk('7')} AS risk_7d, {STATUS.format(h='health')} AS status,
  CASE WHEN n < 3 OR span < 0.5::DOUBLE THEN 'baseline' WHEN slope <= -2 THEN 'deteriorating' WHEN slope <= -0.5::DOUBLE THEN 'slowly deteriorating' WHEN slope >= 0.5::DOUBLE THEN 'improving' ELSE 'stable' END AS trend,
  list_sort(list_transform(ev, lambda q: {{'o': -q.p, 's': q.s}}))[1].s AS signal FROM tr t LEFT JOIN customer ON t.user_id = c_custkey),
a AS MATERIALIZED (SELECT *, site || '-rack-' || (user_id // 30)::VARCHAR AS rack, {LEVEL.format(s='status')} AS level, round(100 * (0.6::DOUBLE * risk_7d + 0.4::DOUBLE * (100 - health) / 100) * weight, 1) AS priority_score,
  CASE WHEN 0.6::DOUBLE * least(1::DOUBLE, signals / 4) + 0.4::DOUBLE * least(1::DOUBLE, (n - 1) / 7) >= 0.7::DOUBLE THEN 'high' WHEN 0.6::DOUBLE * least(1::DOUBLE, signals / 4) + 0.4::DOUBLE * least(1::DOUBLE, (n - 1) / 7) >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM sc),
now AS (SELECT * FROM a QUALIFY dt = max(dt) OVER (PARTITION BY device))"""
#: f: a row for each device and run
FRAMES = """,
f AS (SELECT device, site, rack, slot, source, dt, round(0.6::DOUBLE * min(health) + 0.4::DOUBLE * avg(health), 1) AS h, min({'o': -level, 'h': health, 'c': component, 'n': name, 's': status, 'g': signal}) AS wst,
  list_sort(coalesce(list(DISTINCT grp) FILTER (health < 97.5::DOUBLE OR status <> 'healthy' OR trend IN """ + FALLING + """), [])) AS groups, bool_or(trend IN """ + FALLING + """) AS drifting FROM a GROUP BY ALL),
fnow AS (SELECT *, wst.s AS status, -wst.o AS level FROM f QUALIFY dt = max(dt) OVER (PARTITION BY device))"""
COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("healthy", "watch", "elevated", "critical"))


@query(ANALYSIS + f"""SELECT device, component, health, status, trend, round(slope, 3) + 0.0::DOUBLE AS slope, accelerating, round(risk_7d, 4) AS risk_7d, priority_score, row_number() OVER (PARTITION BY device ORDER BY priority_score DESC, component)::INT AS priority_rank,
CASE WHEN {_risk('14')} <= 0.05 THEN 'In 14 days' WHEN {_risk('7')} <= 0.05 THEN 'In 7 days' WHEN {_risk('3')} <= 0.05 THEN 'In 3 days' WHEN {_risk('0.5')} <= 0.05 THEN 'Tonight' ELSE 'Now' END AS recommended, confidence, signal,
CASE level WHEN 0 THEN 'none' WHEN 1 THEN 'observe' WHEN 2 THEN 'plan' ELSE 'act' END AS action FROM now""")
def fleet_components(spark, sf):
    now = fleet.ranked(fleet.latest(analysis(spark, sf)))
    return now.select("device", "component", "health", "status", "trend", (F.round("slope", 3) + 0.0).alias("slope"), "accelerating", F.round("risk_7d", 4).alias("risk_7d"), "priority_score", "priority_rank", "recommended", "confidence", "signal", "action")


@query(ANALYSIS + "SELECT device, dt, component, health, len(ev)::INT AS findings, n::INT AS points, round(slope, 6) + 0.0::DOUBLE AS slope, accelerating FROM a")
def fleet_replay(spark, sf):
    """Every component of every run as it stood then."""
    return analysis(spark, sf).select("device", F.to_date("t").alias("dt"), "component", "health", F.size("evidence").alias("findings"), "points", (F.round("slope", 6) + 0.0).alias("slope"), "accelerating")


def _rollup(*by: str) -> str:
    keys = ", ".join(by)
    return ANALYSIS + FRAMES + f"SELECT {keys}, count(*) AS nodes, count(DISTINCT rack) AS racks, round(avg(h), 1) AS health, max_by(status, level) AS status, count(*) FILTER (drifting) AS drifting, bool_or(source <> 'demo') AS live, {COUNTS} FROM fnow GROUP BY {keys}"


@query(_rollup("site"))
def fleet_sites(spark, sf):
    return fleet.rollup(fleet.frames(fleet.latest(analysis(spark, sf))), ["site"])


@query(_rollup("site", "rack"))
def fleet_racks(spark, sf):
    return fleet.rollup(fleet.frames(fleet.latest(analysis(spark, sf))), ["site", "rack"]).drop("racks").withColumn("racks", F.lit(1).cast("long"))


@query(ANALYSIS + f"""SELECT site, rack, grp AS "group", count(DISTINCT device) AS devices, string_agg(DISTINCT device, ',' ORDER BY device) AS members, CASE WHEN count(DISTINCT device) >= 5 THEN 'elevated' ELSE 'watch' END AS severity
FROM now WHERE status <> 'healthy' OR trend IN {FALLING} GROUP BY site, rack, grp HAVING count(DISTINCT device) >= 3""")
def fleet_rack_patterns(spark, sf):
    return fleet.rack_patterns(fleet.latest(analysis(spark, sf))).withColumn("members", F.array_join("members", ","))


POINTS = "coalesce(list_sum(list_transform(list_filter(ev, lambda q: q.s IN {names}), lambda q: q.p)), 0)"


@query(ANALYSIS + f""", one AS (SELECT device, dt, list_sort(coalesce(list(component) FILTER (type IN ('cpu', 'gpu') AND {POINTS.format(names="('Temperature', 'GPU temperature', 'Sustained performance', 'Temperature drift', 'GPU throttling')")} >= 8), [])) AS hot_parts,
 list_sort(coalesce(list(component) FILTER (type = 'cooling' AND coalesce(list_sum(list_transform(ev, lambda q: q.p)), 0) >= 6), [])) AS weak, bool_or({POINTS.format(names="('Drive temperature', 'Temperature')")} > 0) AS hot,
 list_sort(coalesce(list(component) FILTER (type = 'storage' AND health < 80), [])) AS disks, list_sort(coalesce(list(component) FILTER (type = 'storage' AND trend IN {FALLING}), [])) AS falling FROM now GROUP BY device, dt)
SELECT device, dt, 'thermal' AS finding, 'elevated' AS severity, array_to_string(list_concat(hot_parts, weak), ',') AS members FROM one WHERE len(hot_parts) > 0 AND len(weak) > 0
UNION ALL SELECT device, dt, 'storage-thermal', 'elevated', array_to_string(list_concat(disks, weak), ',') FROM one WHERE len(disks) > 0 AND (hot OR len(weak) > 0)
UNION ALL SELECT device, dt, 'storage-subsystem', 'watch', array_to_string(falling, ',') FROM one WHERE len(falling) >= 2""")
def fleet_findings(spark, sf):
    return fleet.correlate(fleet.latest(analysis(spark, sf))).select("device", F.to_date("t").alias("dt"), "finding", "severity", F.array_join("members", ",").alias("members"))


@query(ANALYSIS + """SELECT device, upper(device) AS label, site, rack, component, name, type, status, health, round(risk_7d, 6) AS risk_7d, trend, priority_score, signal, row_number() OVER (ORDER BY priority_score DESC, device, component) AS place FROM now WHERE status <> 'healthy'""")
def fleet_incidents(spark, sf):
    found = fleet.incidents(fleet.latest(analysis(spark, sf))).drop("action")
    order = [F.desc("priority_score"), F.col("device"), F.col("component")]
    return sampling.Ranked(found, order, scratch_folder(spark)).rows().withColumn("risk_7d", F.round("risk_7d", 6))


#: t: the days -29 to 7 of each device
TIMELINE = FRAMES + f""",
grid AS (SELECT device, d AS day, (TIMESTAMP '{NOW}' + to_days(d::INT)) AS at FROM (SELECT DISTINCT device FROM f), range(-29, 1) q(d)),
past AS (SELECT g.device AS device, g.day AS day, x.h AS h, x.wst.s AS status, -x.wst.o AS level, x.wst.n AS worst, x.wst.g AS signal, x.groups AS groups, false AS projected, NULL::DOUBLE AS risk FROM grid g LEFT JOIN f x ON g.device = x.device AND x.dt = (SELECT max(y.dt) FROM f y WHERE y.device = g.device AND y.dt::TIMESTAMP <= g.at)),
seen AS (SELECT * FROM a WHERE dt::TIMESTAMP <= TIMESTAMP '{NOW}' QUALIFY dt = max(dt) OVER (PARTITION BY device)),
ahead AS (SELECT device, d AS day, component, name, signal, grp, slope, greatest(1::DOUBLE, health + least(0::DOUBLE, slope) * d) AS hh, {_risk('d')} AS rr FROM seen, range(1, 8) q(d)),
future AS (SELECT device, day, round(0.6::DOUBLE * min(hh) + 0.4::DOUBLE * avg(hh), 1) AS h, min({{'h': hh, 'c': component, 'n': name, 'g': signal, 'r': rr}}) AS wst,
  list_sort(coalesce(list(DISTINCT grp) FILTER ({STATUS.format(h='hh')} <> 'healthy' OR slope <= -0.5::DOUBLE), [])) AS groups FROM ahead GROUP BY device, day),
next AS (SELECT device, day, h, {STATUS.format(h='wst.h')} AS status, wst.n AS worst, wst.g AS signal, groups, true AS projected, round(wst.r, 4) AS risk FROM future),
t AS (SELECT device, day, h, status, level, worst, signal, groups, projected, risk FROM past UNION ALL SELECT device, day, h, status, {LEVEL.format(s='status')}, worst, signal, groups, projected, risk FROM next)"""


@query(ANALYSIS + TIMELINE + "SELECT device, day::INT AS day, h, status, level::INT AS level, worst, signal, array_to_string(groups, ',') AS groups, projected, risk FROM t")
def fleet_timeline(spark, sf):
    return fleet.timeline(kept(spark, sf, scratch_folder(spark)), F.lit(NOW).cast("timestamp")).withColumn("groups", F.array_join("groups", ",")).withColumn("level", F.col("level").cast("int"))


@query(ANALYSIS + TIMELINE + """, base AS (SELECT device, list_sort(list(h))[len(list(h)) // 2 + 1] AS baseline FROM (SELECT device, h FROM t WHERE day <= 0 AND h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY device ORDER BY day) <= 5) GROUP BY device),
place AS (SELECT DISTINCT device, site, rack, slot FROM now),
o AS (SELECT t.device AS device, day, site, rack, slot, level, unnest(groups) AS grp FROM t JOIN place USING (device) LEFT JOIN base USING (device) WHERE status <> 'healthy' OR projected OR h <= coalesce(baseline, 100) - 2),
m AS (SELECT day, site, rack, grp, device, min(CASE WHEN slot IS NULL OR slot = 0 THEN 99 ELSE slot END) AS slot, max(level) AS level FROM o GROUP BY day, site, rack, grp, device)
SELECT day::INT AS day, site, rack, grp AS "group", count(*) AS devices, string_agg(device, ',' ORDER BY slot, device) AS members, greatest(max(level), 1)::INT AS level, ['healthy', 'watch', 'elevated', 'critical'][greatest(max(level), 1) + 1] AS status FROM m GROUP BY day, site, rack, grp HAVING count(*) >= 2""")
def fleet_links(spark, sf):
    folder = scratch_folder(spark)
    a = kept(spark, sf, folder)
    days = written(fleet.timeline(a, F.lit(NOW).cast("timestamp")), f"{folder}/days")
    base = windows.baseline(days.where("day <= 0"), "device", "day", "h")
    places = fleet.latest(a).select("device", "site", "rack", "slot").distinct()
    return fleet.links(days, places, base).withColumn("members", F.array_join("members", ",")).withColumn("level", F.col("level").cast("int"))


def asked_of(spark: SparkSession, sf: str) -> DataFrame:
    """A question per event: its type says what is asked, its user whom or where."""
    e, user, n = table(spark, sf, "events"), F.col("user_id"), F.col("event_id")
    server, rack = F.concat(F.lit("server D"), F.lpad(user.cast("string"), 6, "0")), F.concat(F.lit("rack 0"), F.floor(user / 20).cast("string"))
    text = (
        F.when(n % 17 == 0, "Tell me a story").when(F.col("event_type") == "error", F.concat(F.lit("Why is "), server, F.lit(" flagged?"))).when((F.col("event_type") == "signup") & (n % 4 < 2), F.concat(F.lit("What if we wait "), (n % 9).cast("string"), F.lit(" weeks?")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Can "), server, F.lit(" be postponed by "), (n % 9).cast("string"), F.lit(" days or 3 weeks?"))).when(F.col("event_type") == "purchase", F.concat(F.lit("What should I fix in "), rack, F.lit("?")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Compare "), server, F.lit(" with its peers"))).when(n % 2 == 0, F.concat(F.lit("Any critical alert in "), rack)).otherwise(F.concat(F.lit("How is "), rack, F.lit(" doing")))
    )
    site = F.when(n % 13 > 0, F.get(F.array(*map(F.lit, SITES)), (n % 3).cast("int")))
    seen = F.when(n % 5 == 0, F.concat(F.lit("d"), F.lpad(user.cast("string"), 6, "0"))).when(n % 23 == 0, "gone")
    return e.select(n.alias("question_id"), text.alias("question"), site.alias("site"), F.when(n % 19 == 0, F.concat(F.lit("north-rack-"), F.floor(user / 30).cast("string"))).alias("rack"), seen.alias("device"), F.when(n % 11 == 0, "2024-01-10").otherwise("now").alias("cutoff"))


EXPOSURE = "CASE WHEN {r} * weight < 0.04::DOUBLE THEN 'LOW' WHEN {r} * weight < 0.15::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END"
WAITS = ", ".join(f"'{name}: ' || " + EXPOSURE.format(r=_risk(str(d))) for name, d in fleet.WAIT)


@query(ANALYSIS + FRAMES + f""",
dev AS (SELECT f.*, q.priority FROM fnow f JOIN (SELECT device, max(priority_score) AS priority FROM now GROUP BY device) q USING (device)),
foc AS (SELECT *, [{WAITS}] AS options FROM now QUALIFY row_number() OVER (PARTITION BY device ORDER BY level DESC, priority_score DESC, component) = 1),
sco AS (SELECT *, rack AS scope FROM dev UNION ALL SELECT *, '' FROM dev),
st AS (SELECT site, scope, count(*) AS cnt, count(*) FILTER (drifting) AS drift, count(*) FILTER (level >= 2) AS bad, list(device ORDER BY level DESC, priority DESC, device)[1] AS worst,
  coalesce(list(device ORDER BY priority DESC, device) FILTER (level > 0), [])[1:4] AS first, coalesce(list(status ORDER BY priority DESC, device) FILTER (level > 0), [])[1] AS first_s,
  coalesce(list(device ORDER BY priority DESC, device) FILTER (level >= 2), [])[1:6] AS shown, coalesce(list(status ORDER BY priority DESC, device) FILTER (level >= 2), [])[1] AS shown_s FROM sco GROUP BY site, scope),
pat AS (SELECT site, rack, grp FROM now WHERE status <> 'healthy' OR trend IN {FALLING} GROUP BY site, rack, grp HAVING count(DISTINCT device) >= 3),
pats AS (SELECT site, rack AS scope, min(rack || '/' || grp) AS pattern FROM pat GROUP BY ALL UNION ALL SELECT site, '', min(rack || '/' || grp) FROM pat GROUP BY site),
qs AS (SELECT event_id AS id, user_id, event_type AS k, 'd' || lpad(user_id::VARCHAR, 6, '0') AS own, coalesce(CASE WHEN event_id % 13 > 0 THEN ['north', 'east', 'west'][event_id % 3 + 1] END, (SELECT min(site) FROM dev)) AS site, CASE WHEN event_id % 19 = 0 THEN 'north-rack-' || (user_id // 30) END AS seen_rack,
  CASE WHEN event_id % 5 = 0 THEN 'd' || lpad(user_id::VARCHAR, 6, '0') WHEN event_id % 23 = 0 THEN 'gone' END AS seen FROM events),
kind AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'unavailable' WHEN id % 17 = 0 THEN 'off-topic' WHEN k = 'error' THEN 'why' WHEN k = 'signup' THEN 'wait' WHEN k = 'purchase' THEN 'action' WHEN k = 'click' THEN 'compare' WHEN id % 2 = 0 THEN 'incident' ELSE 'status' END AS what,
  id % 17 > 0 AND (k IN ('error', 'click') OR k = 'signup' AND id % 4 >= 2) AS names_device, id % 17 > 0 AND k NOT IN ('error', 'click', 'signup') AS names_rack, CASE WHEN id % 4 < 2 THEN 7 ELSE 1 END * (id % 9) AS days FROM qs),
named AS (SELECT q.*, CASE WHEN names_rack THEN d.rack END AS named_rack FROM kind q LEFT JOIN (SELECT DISTINCT site, rack FROM dev) d ON names_rack AND d.rack = q.site || '-rack-' || (user_id // 20)),
look AS (SELECT *, coalesce(named_rack, seen_rack) AS rack, CASE WHEN names_device THEN own WHEN named_rack IS NULL THEN seen END AS dev0 FROM named),
goal AS (SELECT l.*, cnt, drift, bad, first, first_s, shown, shown_s, coalesce(dev0, worst) AS device FROM look l LEFT JOIN st s ON l.site = s.site AND coalesce(l.rack, '') = s.scope),
whole AS (SELECT g.*, o.component, o.health, o.slope, o.weight, o.status, o.options, o.ev, d.rack AS own_rack, d.status AS dstatus, CASE WHEN o.component IS NULL AND what <> 'unavailable' THEN 'no-devices' ELSE what END AS intent FROM goal g LEFT JOIN foc o USING (device) LEFT JOIN dev d USING (device)),
waits AS (SELECT *, {_risk('days')} AS risk, CASE WHEN {_risk('14')} <= 0.05 THEN 'In 14 days' WHEN {_risk('7')} <= 0.05 THEN 'In 7 days' WHEN {_risk('3')} <= 0.05 THEN 'In 3 days' WHEN {_risk('0.5')} <= 0.05 THEN 'Tonight' ELSE 'Now' END AS rec FROM whole),
of_model AS (SELECT n.device, n.component, n.health, CASE c_mktsegment WHEN 'MACHINERY' THEN 'high' WHEN 'HOUSEHOLD' THEN 'low' ELSE 'medium' END AS model FROM now n LEFT JOIN customer ON n.user_id = c_custkey),
peer AS (SELECT x.device AS device, count(*) AS peers, list_sort(list(y.health))[count(*) // 2 + 1] AS med, count(*) FILTER (y.health > x.health) AS above, count(*) FILTER (y.health < 80) AS under
  FROM of_model x JOIN foc o ON x.device = o.device AND x.component = o.component JOIN of_model y ON x.component = y.component AND x.model = y.model AND x.device <> y.device GROUP BY x.device)
SELECT id AS question_id, intent, CASE WHEN intent <> 'unavailable' THEN w.site END AS site, CASE WHEN intent <> 'unavailable' THEN w.rack END AS rack, CASE WHEN intent NOT IN ('unavailable', 'no-devices') THEN w.device END AS device, CASE WHEN intent NOT IN ('unavailable', 'no-devices') THEN component END AS component,
  CASE intent WHEN 'why' THEN status WHEN 'wait' THEN CASE WHEN {EXPOSURE.format(r="risk")} = 'HIGH' THEN 'critical' ELSE status END WHEN 'action' THEN coalesce(first_s, 'healthy') WHEN 'compare' THEN CASE WHEN peers > 0 THEN status END WHEN 'incident' THEN coalesce(shown_s, 'healthy') WHEN 'status' THEN dstatus WHEN 'off-topic' THEN 'watch' END AS tone,
  CASE intent WHEN 'why' THEN least(3, len(ev)) WHEN 'action' THEN len(coalesce(first, [])) WHEN 'compare' THEN coalesce(peers, 0) WHEN 'incident' THEN coalesce(bad, 0) WHEN 'status' THEN cnt END AS n,
  array_to_string(CASE intent WHEN 'why' THEN list_transform(list_sort(list_transform(ev, lambda q: {{'o': -q.p, 's': q.s}}))[1:3], lambda q: q.s) WHEN 'wait' THEN options WHEN 'action' THEN coalesce(first, []) WHEN 'incident' THEN coalesce(shown, []) END, ',') AS items,
  CASE WHEN intent = 'wait' THEN days::INT END AS days, CASE WHEN intent = 'wait' THEN round(risk, 6) END AS risk, CASE WHEN intent = 'wait' THEN {EXPOSURE.format(r="risk")} END AS exposure, CASE WHEN intent = 'wait' THEN rec END AS recommended,
  CASE WHEN intent = 'compare' THEN med END AS peer_median, CASE WHEN intent = 'compare' THEN coalesce(above, 0) END AS peers_above, CASE WHEN intent = 'compare' THEN coalesce(under, 0) END AS peers_under_80,
  CASE WHEN intent = 'status' THEN drift END AS drifting, CASE WHEN intent IN ('status', 'action') THEN pattern END AS pattern
FROM waits w LEFT JOIN peer p ON w.device = p.device LEFT JOIN pats ON w.site = pats.site AND CASE WHEN what = 'status' THEN coalesce(own_rack, w.rack, '') ELSE coalesce(w.rack, '') END = pats.scope
""")
def fleet_answers(spark, sf):
    """What each question comes to, in figures."""
    a = analysis(spark, sf)
    found = questions.answers(asked_of(spark, sf), a, scratch_folder(spark), model="criticality")
    return found.withColumns({"items": F.array_join("items", ","), "risk": F.round("risk", 6)})
