"""Questions about a fleet, answered as rows: what each is about, what it asks, and the figures that answer it.

A question has a text and what its asker looks at (site, rack, device; each may be null) and
a cutoff. Names in the text go before that. All questions are answered at once: names are
looked up by joins, and a scope's figures are aggregates made once for each site and rack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.session import written

from . import fleet

#: How a text names a device, a rack and a time, and the words of a question about status.
DEVICE = r"(server|laptop)\s*([a-z0-9-]+)"
RACK = r"(rack|floor)\s*0*(\d+)"
STATUS_WORDS = ("status", "how ", "health", "doing", "state", "overview", "summar", "okay", "ok?")

#: Devices that an answer lists: to be fixed first, and elevated or critical.
FIRST, SHOWN, DRIVERS = 4, 6, 3


def asked(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds intent, days, and the names in the text: _device ("server x"), _word ("x") and _rack (a number), empty where there are none."""
    q = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    about = (q == "") | F.col("_word").isNotNull() | F.col("_rack").isNotNull()
    for w in STATUS_WORDS:
        about |= q.contains(w)
    kind, word, rack = F.regexp_extract(q, DEVICE, 1), F.regexp_extract(q, DEVICE, 2), F.regexp_extract(q, RACK, 2)
    named = questions.withColumns({"_device": F.when(word != "", F.concat_ws(" ", kind, word)), "_word": F.nullif(word, F.lit("")), "_rack": F.nullif(rack, F.lit(""))})
    found = fleet.intent(q)
    intent = F.when(~found.isin("status", "off-topic"), found).when(about, "status").otherwise("off-topic")
    return named.withColumns({"intent": intent, "days": fleet.days_asked(q)})


def spread(key: Column | str) -> Column:
    """``key``, and for a null a text that none is looked up by: nulls, which match nothing, don't meet in one task."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64("question_id", "_text").cast("string")))


def best(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str, salts: int = 64) -> DataFrame:
    """(by, name): the first ``n`` devices of each group. Parts of a group are cut to ``n`` first, so that no task holds a whole site."""
    part = F.pmod(F.xxhash64("device"), F.lit(salts))
    cut = rows.withColumn("_s", part).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))).where(F.col("_n") <= n)
    cut = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    return cut.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "device", "status"))), lambda x: F.struct(x["device"].alias("device"), x["status"].alias("status"))).alias(name))


def focus(now: DataFrame) -> DataFrame:
    """Each device's component of the worst level, among those of the greatest priority (ties: component id)."""
    few = ["component", "type", "health", "slope", "status", "weight", "recommended", "evidence", "_model"]
    worst = F.min_by(F.struct(*few), F.struct(-S.status_order("status"), -F.col("priority_score"), "component"))
    return now.groupBy("device").agg(worst.alias("part"))


def others(now: DataFrame) -> DataFrame:
    """(_model, component, health): of the same component on all other devices of the model, how many there are, their upper median, how many score above and how many under 80.

    Healths are counted before they are ranked. Without one row of health h the k-th of the rest is the
    next one of all where h is at or before the k-th.
    """
    keys, group = ["_model", "component"], Window.partitionBy("_model", "component")
    counts = now.groupBy(*keys, "health").agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("health")), "_all": F.sum("_n").over(group)})
    place = F.floor((F.col("_all") - 1) / 2)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("health"))).over(group)
    ranked = ranked.withColumns({"_low": at(place), "_high": at(place + 1), "_under": F.sum(F.when(F.col("health") < 80, F.col("_n")).otherwise(0)).over(group)})
    return ranked.select(*keys, "health", (F.col("_all") - 1).alias("peers"), F.when(F.col("_all") > 1, F.when(F.col("health") <= F.col("_low"), F.col("_high")).otherwise(F.col("_low"))).alias("peer_median"),
                         (F.col("_all") - F.col("_upto")).alias("peers_above"), (F.col("_under") - (F.col("health") < 80).cast("int")).alias("peers_under_80"))


#: What answers read of a component.
STATE = ("device", "label", "site", "rack", "slot", "source", "t", "component", "type", "name", "health", "slope", "status", "trend", "group", "weight", "recommended", "evidence", "priority_score", "signal")


def answers(questions: DataFrame, analysis: DataFrame, folder: str, *, text: str = "question", model: str | None = None) -> DataFrame:
    """A row for each row of ``questions`` (question_id, text, site, rack, device, cutoff), from ``fleet.analyse``'s last run of each device.

    The components of the last runs, and the devices, are written once to ``folder``, which all
    executors share; all else reads them there, so that the history is scored once.

    intent: what is asked; ``unavailable`` where cutoff isn't now, ``no-devices`` where nothing is in
    scope. site, rack, device, component: what it is asked about. A device in the text goes
    before the one looked at; a rack in the text ends the look at a device; where neither gives a
    device, the scope's worst stands for it. Without a site the first is meant. tone: a
    status. n: for why the drivers, for action the devices that aren't healthy (the listed ones),
    for compare the peers, for incident the devices that are elevated or critical, for status those
    of the scope. items: drivers, options or devices, as names. ``model`` is a column of ``analysis`` that
    tells models of devices apart; without it all are peers.

    Defined cases: a null text asks for status, a null cutoff is now, a device that has no run is no-devices;
    rows that repeat have an answer each; other columns of ``questions`` aren't carried along.
    """
    same = F.coalesce(F.col(model).cast("string"), F.lit("")) if model else F.lit("")
    now = written(fleet.latest(analysis).select(*STATE, same.alias("_model")), f"{folder}/components")
    devices = written(fleet.frames(now).select("device", "label", "site", "rack", "status", "level", "priority", "drifting"), f"{folder}/devices")
    by, urgent = ["site", "_scope"], [F.desc("priority"), F.col("device")]
    patterns = fleet.rack_patterns(now).select("site", "rack", "group")
    patterns = patterns.withColumn("_scope", F.explode(F.array("rack", F.lit("")))).groupBy(*by).agg(F.min(F.struct("rack", "group")).alias("_p")).select(*by, F.concat_ws("/", "_p.rack", "_p.group").alias("pattern"))
    # all that is told of a device, in one row
    rest, parts = others(now), focus(now)
    known = parts.join(rest, (F.col("part._model") == rest["_model"]) & (F.col("part.component") == rest["component"]) & (F.col("part.health") == rest["health"]), "left").drop(rest["_model"], rest["component"], rest["health"])
    known = known.join(devices.groupBy("device").agg(F.min(F.struct("rack", "status")).alias("_d")), "device")
    known = known.select("device", F.struct("device", "part", F.col("_d.rack").alias("own"), F.col("_d.status").alias("state"), "peers", "peer_median", "peers_above", "peers_under_80").alias("_known"))
    # a device is in its rack's scope and in its site's, which has no rack
    both = devices.unionByName(devices.withColumn("rack", F.lit(""))).withColumnRenamed("rack", "_scope")
    scopes = both.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"), F.count_if("drifting").alias("drifting"), F.count_if(F.col("level") >= 2).alias("_bad"), F.min(F.struct(-F.col("level"), -F.col("priority"), "device")).alias("_worst"))
    scopes = scopes.join(best(both.where("level > 0"), by, urgent, FIRST, "_first"), by, "left").join(best(both.where("level >= 2"), by, urgent, SHOWN, "_shown"), by, "left")
    # with its worst device, so that no question that names none looks for one
    scopes = scopes.join(patterns, by, "left").join(known.withColumnRenamed("device", "_w"), F.col("_worst.device") == F.col("_w"), "left").join(patterns.select("site", F.col("_scope").alias("_w_rack"), F.col("pattern").alias("_w_pattern")).withColumnRenamed("site", "_w_site"), (F.col("site") == F.col("_w_site")) & (F.col("_known.own") == F.col("_w_rack")), "left")
    scopes = scopes.select(*by, F.struct("_count", "drifting", "_bad", "_first", "_shown", "_known", "pattern", "_w_pattern").alias("_of"))

    first = F.broadcast(devices.agg(F.min("site").alias("_default")))  # one row
    q = asked(questions.select("question_id", F.col(text).alias("_text"), F.col("site").alias("_site"), F.col("rack").alias("_seen_rack"), F.col("device").alias("_seen"), F.coalesce("cutoff", F.lit("now")).alias("_cutoff")), "_text")
    q = q.crossJoin(first).withColumn("site", F.coalesce("_site", "_default"))
    racks = devices.groupBy("site", F.nullif(F.regexp_extract(F.lower("rack"), r"(rack|floor)[\s-]*0*(\d+)$", 2), F.lit("")).alias("_rack")).agg(F.min("rack").alias("_named_rack"))
    labels = devices.select(F.lower("label").alias("_key"), F.col("device").alias("_d"), F.col("site").alias("_at"))
    wanted = q.where("_word is not null").select("site", "_device", "_word").distinct().withColumn("_key", F.explode(F.array_distinct(F.array("_device", "_word"))))
    called = wanted.join(labels, "_key").groupBy("site", "_device").agg(F.min(F.struct(F.col("site") != F.col("_at"), "_d")).alias("_x")).select("site", "_device", F.col("_x._d").alias("_named"))
    q = q.withColumns({"_rack": spread("_rack"), "_device": spread("_device")}).join(racks, ["site", "_rack"], "left").join(called, ["site", "_device"], "left")
    seen = F.when(F.col("_named_rack").isNull(), F.col("_seen"))
    q = q.withColumns({"rack": F.coalesce("_named_rack", "_seen_rack"), "_named_device": F.coalesce("_named", seen)}).withColumn("_scope", F.coalesce("rack", F.lit("")))
    # a row per site is sent to all; racks and devices are looked up by those questions that have one
    q = q.join(F.broadcast(scopes.where("_scope = ''").select("site", F.col("_of").alias("_site_of"))), "site", "left")
    local = scopes.where("_scope <> ''").select("site", F.col("_scope").alias("_in"), F.col("_of").alias("_rack_of"))
    q = q.withColumn("_in", spread(F.nullif("_scope", F.lit("")))).join(local, ["site", "_in"], "left")
    q = q.withColumn("_of", F.when(F.col("_scope") == "", F.col("_site_of")).otherwise(F.col("_rack_of"))).drop("_site_of", "_rack_of")
    q = q.withColumn("_look", spread("_named_device")).join(known.select(F.col("device").alias("_look"), F.col("_known").alias("_own")), "_look", "left")
    q = q.withColumn("_is", F.when(F.col("_named_device").isNull(), F.col("_of._known")).otherwise(F.col("_own"))).withColumn("device", F.coalesce("_named_device", "_is.device"))
    # a status is told with the pattern of the device's own rack, a list with that of the scope
    own = F.when((F.col("intent") == "status") & F.col("_named_device").isNotNull(), F.col("_own.own"))
    q = q.withColumn("_has_own", own.isNotNull()).withColumn("_at", spread(own)).join(patterns.select("site", F.col("_scope").alias("_at"), F.col("pattern").alias("_own_pattern")), ["site", "_at"], "left")
    on_worst = (F.col("intent") == "status") & F.col("_named_device").isNull() & F.col("_is.own").isNotNull()
    pattern = F.when(F.col("_has_own"), F.col("_own_pattern")).when(on_worst, F.col("_of._w_pattern")).otherwise(F.col("_of.pattern"))
    told = {c: F.col(f"_is.{c}") for c in ("part", "peers", "peer_median", "peers_above", "peers_under_80")} | {c: F.col(f"_of.{c}") for c in ("_count", "drifting", "_bad", "_first", "_shown")}
    q = q.withColumns({"_state": F.col("_is.state"), "pattern": pattern, **told})

    intent = F.when(F.col("_cutoff") != "now", "unavailable").when(F.col("part").isNull(), "no-devices").otherwise(F.col("intent"))
    q = q.withColumn("intent", intent).withColumn("risk", S.cumulative_risk("part.health", "part.slope", F.col("days")))
    q = q.withColumn("exposure", S.exposure(F.col("risk"), "part.weight"))
    is_ = lambda *names: F.col("intent").isin(*names)
    strong = F.transform(F.slice("part.evidence", 1, DRIVERS), lambda e: e["signal"])
    listed = lambda c: F.coalesce(F.transform(c, lambda d: d["device"]), F.array().cast("array<string>"))
    mood = lambda c: F.coalesce(F.get(F.transform(c, lambda d: d["status"]), F.lit(0)), F.lit("healthy"))
    options = F.array(*(F.concat(F.lit(f"{name}: "), S.exposure(S.cumulative_risk("part.health", "part.slope", d), "part.weight")) for name, d in fleet.WAIT))
    about, held = ~is_("unavailable"), ~is_("unavailable", "no-devices")
    only = lambda c, *names: F.when(is_(*names), c)
    return q.select(
        "question_id", "intent", F.when(about, F.col("site")).alias("site"), F.when(about, F.col("rack")).alias("rack"), F.when(held, F.col("device")).alias("device"), F.when(held, F.col("part.component")).alias("component"),
        F.when(is_("why"), F.col("part.status")).when(is_("wait"), F.when(F.col("exposure") == "HIGH", "critical").otherwise(F.col("part.status"))).when(is_("action"), mood(F.col("_first")))
        .when(is_("compare"), F.when(F.col("peers") > 0, F.col("part.status"))).when(is_("incident"), mood(F.col("_shown"))).when(is_("status"), F.col("_state")).when(is_("off-topic"), "watch").alias("tone"),
        F.when(is_("why"), F.size(strong).cast("long")).when(is_("action"), F.size(listed("_first")).cast("long")).when(is_("compare"), F.col("peers")).when(is_("incident"), F.coalesce("_bad", F.lit(0))).when(is_("status"), F.col("_count")).alias("n"),
        F.when(is_("why"), strong).when(is_("wait"), options).when(is_("action"), listed("_first")).when(is_("incident"), listed("_shown")).alias("items"),
        only(F.col("days"), "wait").alias("days"), only(F.col("risk"), "wait").alias("risk"), only(F.col("exposure"), "wait").alias("exposure"), only(F.col("part.recommended"), "wait").alias("recommended"),
        only(F.col("peer_median"), "compare").alias("peer_median"), only(F.col("peers_above"), "compare").alias("peers_above"), only(F.col("peers_under_80"), "compare").alias("peers_under_80"),
        only(F.col("drifting"), "status").alias("drifting"), only(F.col("pattern"), "status", "action").alias("pattern"),
    )
