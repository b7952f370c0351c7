"""Questions over a made fleet against plain loops over its last runs."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fleet, questions
from gaugeworks.plans import fleet_catalog
from gaugeworks.sources import readers

ASKED = "question_id long, question string, site string, rack string, device string, cutoff string, extra int"
LEVEL = {"healthy": 0, "watch": 1, "elevated": 2, "critical": 3}


@pytest.fixture(scope="module")
def state(spark):
    analysis = fleet.analyse(readers.demo_fleet(spark, devices=60, days=12)).persist()
    return analysis, fleet.latest(analysis).collect(), {r.device: r for r in fleet.frames(fleet.latest(analysis)).collect()}


def test_what_is_asked(spark):
    texts = {
        "Why is it hot?": ("why", 7), "Can we wait 2 weeks or 3 days": ("wait", 14), "postpone 4d": ("wait", 4), "what should I do": ("action", 7), "compare": ("compare", 7),
        "any ALERT": ("incident", 7), "is it okay": ("status", 7), "rack 4": ("status", 7), "server 012": ("status", 7), "": ("status", 7), None: ("status", 7), "tell me a joke": ("off-topic", 7),
    }
    got = questions.asked(spark.createDataFrame([(t,) for t in texts], "question string")).collect()
    assert {r.question: (r.intent, r.days) for r in got} == texts


def test_scopes_and_figures(spark, state, tmp_path):
    analysis, now, devices = state
    rows = [
        (1, "why is server 004 flagged", "north", None, None, None, 0), (2, "how is rack 1", "east", None, "server-003", "now", 0), (3, "status", None, None, None, None, 0), (4, "status", "west", "west-rack-2", None, None, 0),
        (5, "what to fix", "north", None, None, None, 0), (6, "incident?", "east", "east-rack-0", None, None, 0), (7, "compare", "west", None, "server-008", None, 0), (8, "why", "north", None, None, "2024-01-01", 0),
        (9, "why", "nowhere", None, None, None, 0), (10, "why", "north", None, "no such device", None, 0), (11, "what if I wait 5 days", "east", None, "server-001", None, 0), (11, "what if I wait 5 days", "east", None, "server-001", None, 0),
        (12, None, None, None, None, None, 0), (13, "how is server 999", "north", None, "server-006", None, 0),
    ]
    got = {r.question_id: r for r in questions.answers(spark.createDataFrame(rows, ASKED), analysis, str(tmp_path / "a")).collect()}
    assert len(got) == 13 and got[8].intent == "unavailable" and got[8].site is None and {got[i].intent for i in (9, 10)} == {"no-devices"}
    worst = lambda inside: min(inside, key=lambda d: (-d.level, -d.priority, d.device)).device
    of = lambda site, rack=None: [d for d in devices.values() if d.site == site and (rack is None or d.rack == rack)]
    first = min(d.site for d in devices.values())
    assert got[1].device == "server-004" and got[1].site == "north" and got[3].site == got[12].site == first and got[3].device == worst(of(first))
    assert (got[2].rack, got[2].device, got[2].n) == ("east-rack-1", worst(of("east", "east-rack-1")), len(of("east", "east-rack-1")))
    assert got[4].n == len(of("west", "west-rack-2")) and got[4].drifting == sum(d.drifting for d in of("west", "west-rack-2")) and got[13].device == "server-006"
    urgent = lambda inside, least, n: [d.device for d in sorted(inside, key=lambda d: (-d.priority, d.device)) if d.level >= least][:n]
    assert got[5]["items"] == urgent(of("north"), 1, 4) and got[6]["items"] == urgent(of("east", "east-rack-0"), 2, 6)
    part = {}
    for r in sorted(now, key=lambda r: (LEVEL[r.status], r.priority_score), reverse=False):
        part[r.device] = r
    assert got[1].component == part["server-004"].component and got[1]["items"] == [e["signal"] for e in part["server-004"].evidence[:3]]
    rest = sorted(r.health for r in now if r.component == got[7].component and r.device != "server-008")
    own = part["server-008"].health
    assert (got[7].n, got[7].peer_median, got[7].peers_above, got[7].peers_under_80) == (len(rest), rest[len(rest) // 2], sum(h > own for h in rest), sum(h < 80 for h in rest))
    assert got[11].days == 5 and 0 <= got[11].risk <= 1 and [x.split(":")[0] for x in got[11]["items"]] == [n for n, _ in fleet.WAIT]
    assert questions.answers(spark.createDataFrame(rows, ASKED), analysis, str(tmp_path / "b")).count() == 14
    assert questions.answers(spark.createDataFrame(rows[:1], ASKED), analysis.where(F.lit(False)), str(tmp_path / "c")).first().intent == "no-devices"
    assert not questions.answers(spark.createDataFrame([], ASKED), analysis, str(tmp_path / "d")).count()


def test_medians_without_oneself(spark):
    rows = [("d%d" % k, "c", "", float(h)) for k, h in enumerate((70, 70, 80, 90, 90, 95))] + [("alone", "x", "", 50.0)]
    got = {(r.component, r.health): r for r in questions.others(spark.createDataFrame(rows, "device string, component string, _model string, health double")).collect()}
    for d, c, _, h in rows:
        rest = sorted(x for e, k, _, x in rows if k == c and e != d)
        assert (got[c, h].peers, got[c, h].peer_median, got[c, h].peers_above, got[c, h].peers_under_80) == (len(rest), rest[len(rest) // 2] if rest else None, sum(x > h for x in rest), sum(x < 80 for x in rest))


def test_links_read_what_is_written_once(spark):
    """The scored history goes into links by several ways; each would score it again, and one task hold the windows of all."""
    for query in (fleet_catalog.fleet_links, fleet_catalog.fleet_timeline):
        assert not [f for f in query(spark, "/root/testdata/sf0.001").inputFiles() if "/testdata/" in f]


def test_names_that_are_not_there_are_apart(spark):
    """Questions without a name match nothing, so they must not meet under one key; one with a name keeps it."""
    rows = spark.createDataFrame([(i, "how is it", "a" if i == 0 else None) for i in range(50)], "question_id long, _text string, name string")
    got = [r.k for r in rows.select(questions.spread("name").alias("k")).collect()]
    assert got[0] == "a" and len(set(got)) == 50 and None not in got


def test_a_device_under_two_labels_has_an_answer(spark, state, tmp_path):
    twice = state[0].withColumn("label", F.when((F.col("device") == "server-004") & (F.col("type") == "cpu"), "other").otherwise(F.col("label")))
    rows = spark.createDataFrame([(1, "why", None, None, "server-004", None, 0), (2, "status", None, None, None, None, 0)], ASKED)
    assert questions.answers(rows, twice, str(tmp_path / "e")).count() == 2
