import numpy as np
import pytest

from gaugeworks.llm import balltree_topk, imi_search
from gaugeworks.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in pairs], SCHEMA)


def brute(ids, x, q, k):
    out = []
    for i in q:
        s = x @ x[ids.index(i)]
        out += [(i, r + 1, ids[j], s[j]) for r, j in enumerate(sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k])]
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(16384, 8192), (60, 4)])
def test_exact_top_k_is_brute_force(spark, shard_rows, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.toPandas().sort_values("vec_id")
    x = np.floor(256 * np.stack(data.embedding.to_numpy()).astype(np.float64))
    ids = data.vec_id.tolist()
    got = balltree_topk.top_k(table, Scratch(spark), shard_rows, block_rows).collect()
    assert sorted(map(tuple, got)) == sorted(brute(ids, x, [i for i in ids if i % 50 == 0], 5))


@pytest.mark.parametrize("shard_rows,block_rows", [(65536, 4096), (100, 8)])
def test_multi_index_recall(spark, shard_rows, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.toPandas().sort_values("vec_id")
    x, ids = np.stack(data.embedding.to_numpy()).astype(np.float64), data.vec_id.tolist()
    want = {(a, c): s for a, _, c, s in brute(ids, x, [i for i in ids if i % 20 == 0], 20)}
    got = imi_search.nearest_neighbours(table, Scratch(spark), shard_rows, block_rows).collect()
    assert sum((r.query_id, r.vec_id) in want for r in got) >= 0.9 * len(want)
    assert all(abs(r.score - float(x[ids.index(r.query_id)] @ x[ids.index(r.vec_id)])) < 1e-12 for r in got)
    assert len(got) == len(want)


def test_cells_come_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    walk = list(imi_search.cells(a, b))
    assert len({(i, j) for i, j, _ in walk}) == 35 and all(x[2] >= y[2] for x, y in zip(walk, walk[1:], strict=False))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = rows(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 0.0]), (7, [1.0, 0.0]), (5, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (6, [inf, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (100, [1.0])])
    exact = [tuple(r) for r in balltree_topk.top_k(table, Scratch(spark)).orderBy("query_id", "rank").collect()]
    assert [r for r in exact if r[0] == 50] == [(50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 5, 0), (50, 4, 7, 0)]
    assert [r for r in exact if r[0] == 100] == [(100, 1, 9, 65536)]
    near = [tuple(r) for r in imi_search.nearest_neighbours(table, Scratch(spark)).orderBy("query_id", "rank").collect()]
    assert [r for r in near if r[0] == 100] == [(100, 1, 9, 1.0)] and not [r for r in near if r[0] == 50 or r[2] == 50]
    empty = rows(spark, [])
    assert balltree_topk.top_k(empty, Scratch(spark)).count() == 0 and imi_search.nearest_neighbours(empty, Scratch(spark)).count() == 0


def test_large_numbers_stay_exact():
    points = np.array([[2.0**40, 3.0], [2.0**40, 5.0]])
    assert balltree_topk.inner(points, np.array([2.0**15, 1.0]), False).tolist() == [2**55 + 3, 2**55 + 5]


@pytest.mark.parametrize("shard_rows,block_rows", [(65536, 4096), (3, 1)])
def test_rows_that_repeat_a_query_have_lists_of_their_own(spark, shard_rows, block_rows):
    table = rows(spark, [(100, [1.0, 0.5]), (100, [0.5, 1.0]), (100, [1.0, 0.5]), *((k, [1.0, k / 10]) for k in range(1, 8)), *((k, [k / 10, 1.0]) for k in range(11, 18))])
    plain = [(k, np.array([1.0, np.float32(k / 10)])) for k in range(1, 8)] + [(k, np.array([np.float32(k / 10), 1.0])) for k in range(11, 18)]
    def want(q, k, of):
        return [(r + 1, i, s) for r, (s, i) in enumerate(sorted(((-float(of(x) @ of(q)), i) for i, x in plain))[:k])]
    both = [np.array([1.0, 0.5]), np.array([0.5, 1.0]), np.array([1.0, 0.5])]
    exact = balltree_topk.top_k(table, Scratch(spark), shard_rows, block_rows).collect()
    floored = sorted((r, i, int(-s)) for q in both for r, i, s in want(q, 5, lambda x: np.floor(256 * x)))
    assert sorted((r.rank, r.vec_id, r.score) for r in exact) == floored and {r.query_id for r in exact} == {100}
    near = imi_search.nearest_neighbours(table, Scratch(spark), shard_rows, block_rows).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in near) == sorted((r, i, -s) for q in both for r, i, s in want(q, 20, lambda x: x))
