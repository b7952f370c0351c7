"""Exact top-k by inner product: a ball tree per shard, searched best bound first.

Components become floor(256 * x), so scores are integers. A node's bound on the
inner product with q is q . centre + |q| * radius; the nodes of a shard are taken
from a heap by falling bound until the best bound left is below the k-th score,
which starts from the one that the query already has from another shard.

Defined cases: vectors that are null, empty or hold nulls or non-finite numbers
take no part, nor do rows without vec_id; vectors meet those of their own length
only; a query's own vec_id is no candidate, so rows that repeat a vec_id don't
find each other, and each of them that is a query has a list of its own; ties go to the smaller vec_id; scores beyond 64 bits are held at
the limit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vectors import best, packed, search

K, QUERY_EVERY = 5, 50
SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 8_192, 256


class BallTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.order = np.arange(len(ids))
        self.points, self.ids = points, ids
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(0, len(ids))
        self.points, self.ids = points[self.order], ids[self.order]
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)

    def _build(self, start: int, end: int) -> int:
        own = self.points[self.order[start:end]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append((start, end, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        if end - start > LEAF and away.max() > 0:
            pole = own[away.argmax()]
            other = own[((own - pole) ** 2).sum(1).argmax()]
            along = own @ (other - pole)
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(along, half)]
            left, right = self._build(start, start + half), self._build(start + half, end)
            self.nodes[at] = (start, end, left, right)
        return at


def inner(points: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in doubles where these hold every partial sum."""
    if exact:
        return (points @ q).astype(np.int64)
    whole = [int(x) for x in q]
    top = 2**63 - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in points.tolist()], np.int64)


def visit(ids, matrix, query_ids, query_matrix, floors):
    tree = BallTree(ids, matrix)
    exact = np.abs(matrix).max() * np.abs(query_matrix).max() * matrix.shape[1] < 2.0**52
    bounds = query_matrix @ tree.centre.T + np.sqrt((query_matrix**2).sum(1))[:, None] * tree.radius
    bounds += np.abs(bounds) * 1e-9 + 1e-6 * (1 + np.abs(query_matrix).max() * np.abs(matrix).max())
    bounds[~np.isfinite(bounds)] = np.inf  # of numbers whose squares overflow: such nodes are always visited
    numbers, found, scores = [], [], []
    for n, (own, q, floor) in enumerate(zip(query_ids.tolist(), query_matrix, floors.tolist(), strict=True)):
        bound = bounds[n].tolist()
        heap, top_ids, top_scores, kth = [(-bound[0], 0)], np.empty(0, np.int64), np.empty(0, np.int64), floor
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            start, end, left, right = tree.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            got = inner(tree.points[start:end], q, exact)
            here = np.flatnonzero((got >= kth) & (tree.ids[start:end] != own))
            if len(here):
                top_ids, top_scores = np.concatenate([top_ids, tree.ids[start:end][here]]), np.concatenate([top_scores, got[here]])
                kept = best(top_ids, top_scores, K)
                top_ids, top_scores = top_ids[kept], top_scores[kept]
                if len(kept) == K:
                    kth = max(kth, float(top_scores[-1]))
        numbers.append(np.full(len(top_ids), n))
        found.append(top_ids)
        scores.append(top_scores)
    return np.concatenate(numbers), np.concatenate(found), np.concatenate(scores)


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def top_k(embeddings: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the K best entries for each row whose vec_id QUERY_EVERY divides."""
    vectors = scratch.save(packed(embeddings, quantise), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), K, "long", visit, shard_rows=shard_rows, block_rows=block_rows, shared=scratch)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), Scratch(spark))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.id AS id, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
"""
