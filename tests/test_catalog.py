"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import collections
import hashlib
import math

import duckdb
import pytest

from gaugeworks.plans import catalog, fleet_catalog, stream_catalog, study_catalog  # noqa: F401
from gaugeworks.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_are_those_of_sql(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_model_examples_hold_no_identity(spark):
    df = catalog.QUERIES["model_examples"](spark, SF)
    text = df.first().text
    assert "user:" not in text and "original standard deviation: " in text


def test_whole_tables_are_brute_force(spark, duck):
    """Queries over whole tables that no SQL states in fair time, and one that SQL states too."""
    orders = duck.sql("SELECT o_custkey::VARCHAR, (o_orderdate::DATE)::VARCHAR || '/' || (o_orderkey % 7) FROM orders").fetchall()
    parent = {x: x for d, h in orders for x in (("d", d), ("h", h))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, h in orders:
        parent[find(("d", d))] = find(("h", h))
    hosts = collections.defaultdict(set)
    for _, h in orders:
        hosts[find(("h", h))].add(h)
    want = {d: hashlib.sha256("|".join(sorted(hosts[find(("d", d))])).encode()).hexdigest() for d, _ in orders}
    assert {r.d: r.group for r in catalog.QUERIES["component_closure"](spark, SF).collect()} == want

    events = duck.sql("SELECT event_id, user_id, ts, event_type, value FROM events").fetchall()
    scopes = {}
    for task, user, start, kind, _ in events:
        if kind == "signup":
            inside = [e[4] for e in events if e[1] == user and 0 <= (e[2] - start).total_seconds() < 2 * 86400]
            scopes[task] = (len(inside), math.fsum(inside))
    got = {r.task: (r.n, r.total) for r in catalog.QUERIES["task_scope"](spark, SF).collect()}
    assert got.keys() == scopes.keys() and all(got[k][0] == n and abs(got[k][1] - total) < 1e-3 for k, (n, total) in scopes.items())

    opened = sorted((hashlib.sha256(f"open:{e[0]}".encode()).hexdigest(), e[0]) for e in events)[:25]
    left = {(e[0], e[1]) for e in events} - {(e[0], e[1]) for e in events if e[0] in {i for _, i in opened}}
    assert {(r.event_id, r.user_id) for r in catalog.QUERIES["unused_after_release"](spark, SF).collect()} == left
