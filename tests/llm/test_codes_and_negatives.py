import hashlib

import numpy as np
import pytest

from gaugeworks.llm import delta_lloyd, hard_negatives, inverted_lists
from gaugeworks.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, row long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "", 0) for i, v, label in rows], SCHEMA)


def kept(rows):
    return [(i, [float(c) for c in v], label) for i, v, label in rows if v and all(c is not None and np.isfinite(c) for c in v)]


def lloyd(rows, rounds=6):
    """The contract in whole numbers of Python."""
    rows = [(i, [int(np.floor(4096 * c)) for c in v], label) for i, v, label in kept(rows)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    d = len(rows[0][1]) // 8
    books = [[r[1][p * d : p * d + d] for r in first] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = [r[1][p * d : p * d + d] for r in rows]
            of = [near(v, books[p])[1] for v in own]
            for e in range(len(books[p])):
                members = [v for v, n in zip(own, of, strict=True) if n == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in rows:
        found = [near(v[p * d : p * d + d], books[p]) for p in range(8)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(x for x, _ in found), label))
    total: dict = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i is None, i or 0, c, e, total[label], digest) for i, c, e, label in out)


def codes(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("chunk_rows", [8192, 7])
def test_codes_are_those_of_plain_rounds(spark, chunk_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    own = frame(spark, [(i, [float(x) for x in v], label) for i, v, label in rows])
    assert codes(delta_lloyd.compress(own, Scratch(spark), chunk_rows=chunk_rows)) == lloyd(rows)


def test_odd_vectors_are_coded(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 11 else None, rng.normal(size=8).round(2).tolist(), None if i % 5 == 0 else int(i) % 3) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, [9.0] * 8, 1), (90, [-3e9] * 4 + [3e9] * 4, 2), (91, [2e6] * 8, 2)]
    bad = [(92, None, 1), (93, [], 1), (94, [None] * 8, 1), (95, [float("nan")] * 8, 1), (96, [1.0] * 7, 1)]
    assert codes(delta_lloyd.compress(frame(spark, rows + bad), Scratch(spark), chunk_rows=9)) == lloyd([(i, list(np.clip(v, -(2.0**28), 2.0**28)), label) for i, v, label in rows])
    few = [(i, v, 0) for i, v, _ in rows[1:6]]
    assert codes(delta_lloyd.compress(frame(spark, few), Scratch(spark))) == lloyd(few)
    assert delta_lloyd.compress(frame(spark, []), Scratch(spark)).collect() == []
    two = delta_lloyd.compress(frame(spark, few + [(20, [1.0] * 16, 0), (21, [2.0] * 16, 0)]), Scratch(spark)).collect()
    assert len({r.codebooks_sha256 for r in two}) == 2


def test_a_round_shuffles_no_vector(spark):
    scratch = Scratch(spark)
    vectors = scratch.bucketed(delta_lloyd.chunks(spark.read.parquet(f"{SF}/embeddings.parquet"), 50).repartition(3, "chunk"), "vectors", "chunk", 3)
    books = delta_lloyd.first_entries(vectors)
    state = scratch.bucketed(delta_lloyd.assigned(vectors.select("chunk", "dim", "vecs", delta_lloyd.F.lit(None).cast("binary").alias("codes")), books), "codes", "chunk", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = vectors.select("chunk", "dim", "vecs").join(state.select("chunk", "codes"), "chunk")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again = delta_lloyd.assigned(joined, books)
    assert again.selectExpr("sum(size(moved))").first()[0] == 0  # nothing changed, nothing moves
    scratch.close()


def mined(rows, every):
    rows = [(i, np.floor(256 * np.array(v)), label) for i, v, label in kept(rows) if i is not None and label is not None]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % every:
            continue
        scored = [(-int(sum(int(x) * int(y) for x, y in zip(v, w, strict=True))), j, n) for n, (j, w, _) in enumerate(rows) if n != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if rows[x[2]][2] == label)[:5]:
            fits = sorted((t, k) for t, k, n in scored if rows[n][2] != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("every,piece_rows,lists", [(100, 4096, None), (10, 16, 9), (10, 4096, 1)])
def test_negatives_are_those_of_brute_force(spark, every, piece_rows, lists):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = hard_negatives.mine(table, Scratch(spark), every, piece_rows, lists).collect()
    assert sorted(map(tuple, got)) == mined(rows, every)


def test_clustered_vectors_leave_lists_unvisited(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16)) * 3
    rows = [(i, (middle[i % 12] + rng.normal(size=16) * 0.1).tolist(), i % 4) for i in range(600)]
    table = frame(spark, rows)
    got = hard_negatives.mine(table, Scratch(spark), 20, 64, 12).collect()
    assert sorted(map(tuple, got)) == mined(rows, 20) and got
    scratch = Scratch(spark)
    index = inverted_lists.Lists(scratch.save(inverted_lists.numbered(table.select("vec_id", "label", "embedding"), hard_negatives.quantise), "rows"), scratch, 64, 12)
    queries = spark.read.parquet(f"{scratch.root}/rows").where("vec_id % 20 = 0").withColumn("windows", inverted_lists.F.expr("array(named_struct('least', 500000L, 'most', 600000L, 'floor', 500000L))"))
    assert index.visits(queries, False).count() < 0.5 * 30 * 12


def test_odd_negatives(spark):
    nan = float("nan")
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2), (4, [0.79, 0.0], 3), (6, [0.85, 1.0], 13), (8, [0.8, 0.0], 3)]
    rows += [(5, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (9, None, 2), (10, [nan, 1.0], 2), (11, [None, 1.0], 2), (12, [], 2), (200, [-1.0, 0.0], 4), (13, [1.0, 0.0], 4), (300, [1.0], 5), (15, [1.0], 5), (16, [1.0], 6), (7, [1.0, 0.0], 0)]
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), Scratch(spark)).collect())) == mined(rows, 100)
    large = [(100, [2.0**40] * 2, 1), (1, [2.0**20] * 2, 1), (2, [2.0**20, 2.0**19], 2)]
    top = 2**63 - 1  # scores are held there
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, large), Scratch(spark)).collect()] == [(100, 1, 1, 2, top, top)]
    assert hard_negatives.mine(frame(spark, []), Scratch(spark)).collect() == []
