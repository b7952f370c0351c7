"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own, so a pair of
centroids is a cell. A query goes through the cells in the order of the summed
distance (here the negated inner product with the two centroids), taken from a
heap that grows along both sorted lists, and reranks their entries by the exact
inner product. It ends when a cell's summed score plus ``Z`` standard deviations
of what quantisation left out falls below the k-th score found: near queries end
after a few cells, those with no near neighbours read most of a shard.

The codebooks are fitted on at most ``SAMPLE`` vectors, the first by a hash of
vec_id; every vector is indexed. Recall is measured against brute force in the
tests (0.9 at least) and noted in the README.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite
numbers take no part, nor do rows without vec_id; vectors meet those of their own
length only; a query's own vec_id is no candidate, so rows that repeat one don't
find each other, and each of them that is a query has a list of its own; ties go to the smaller vec_id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vectors import best, counts, packed, search

K, QUERY_EVERY = 20, 20
SAMPLE, CENTROIDS, ROUNDS, Z = 8_192, 32, 10, 3.4
SHARD_ROWS, BLOCK_ROWS, LOOK_EVERY = 65_536, 4_096, 512


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def codebook(points: np.ndarray) -> np.ndarray:
    """k-means, started from points spread evenly over the sample."""
    if not points.shape[1]:  # the second half of one component
        return np.zeros((1, 0))
    different = np.unique(points, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(CENTROIDS, len(different))).astype(int)].copy()
    for _ in range(ROUNDS):
        of = nearest(points, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, points[:, j], minlength=len(centres)) for j in range(points.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: DataFrame, dims: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each dimension two codebooks and the standard deviation of a component's remainder."""
    out = {}
    for dim in dims:
        rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(4)), "vec_id").limit(SAMPLE).select("vec").collect()
        sample = np.frombuffer(b"".join(r.vec for r in rows), np.float64).reshape(len(rows), dim)
        halves = (sample[:, : (dim + 1) // 2], sample[:, (dim + 1) // 2 :])
        books = tuple(codebook(h) for h in halves)
        left = sum(((h - b[nearest(h, b)]) ** 2).sum() for h, b in zip(halves, books, strict=True))
        out[dim] = (*books, float(np.sqrt(left / sample.size)))
    return out


def cells(near: np.ndarray, far: np.ndarray):
    """Pairs of centroids by falling sum of their two scores: the multi-sequence walk over two sorted lists."""
    first, second = np.argsort(-near, kind="stable").tolist(), np.argsort(-far, kind="stable").tolist()
    a, b = near[first].tolist(), far[second].tolist()
    reached = [0] * (len(a) + 1)  # how far row i has come; row i + 1 waits for row i at each place
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield first[i], second[j], -cost
        reached[i] = j + 1
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))


def visitor(books: dict[int, tuple[np.ndarray, np.ndarray, float]]):
    def visit(ids, matrix, query_ids, query_matrix, floors):
        dim = matrix.shape[1]
        one, two, left = books[dim]
        half = (dim + 1) // 2
        cell = nearest(matrix[:, :half], one) * len(two) + nearest(matrix[:, half:], two)
        order = np.argsort(cell, kind="stable")
        entries, ids = matrix[order], ids[order]
        ends = np.cumsum(np.bincount(cell, minlength=len(one) * len(two))).tolist()
        near, far = query_matrix[:, :half] @ one.T, query_matrix[:, half:] @ two.T
        margins = (Z * left * np.sqrt((query_matrix**2).sum(1))).tolist()
        numbers, found, scores = [], [], []
        for n, (own, q) in enumerate(zip(query_ids.tolist(), query_matrix, strict=True)):
            kth, spans, got, looked, new, top = float(floors[n]), [], [], 0, 0, np.empty(0)
            for i, j, score in cells(near[n], far[n]):
                if score + margins[n] < kth:
                    break
                at = i * len(two) + j
                start, end = (ends[at - 1] if at else 0), ends[at]
                if start == end:
                    continue
                spans.append((start, end))
                got.append(entries[start:end] @ q)
                new += end - start
                if new >= LOOK_EVERY:
                    top = np.concatenate([top, *got[looked:]])
                    looked, new = len(got), 0
                    if len(top) > K:  # one more than K: the query itself may be among them
                        top = np.partition(top, len(top) - K - 1)[-K - 1 :]
                        kth = max(kth, float(top[0]))
            if not spans:
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in spans])
            rough = np.concatenate(got)
            other = ids[rows] != own
            rows, rough = rows[other], rough[other]
            if len(rows) > K:
                least = np.partition(rough, len(rough) - K)[len(rough) - K]
                rows = rows[rough >= least - 1e-9 * (1 + abs(least))]
            exact = (entries[rows] * q).sum(1)  # row by row alike, so that equal vectors score equally
            kept = best(ids[rows], exact, K)
            numbers.append(np.full(len(kept), n))
            found.append(ids[rows][kept])
            scores.append(exact[kept])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *numbers]), np.concatenate([none, *found]), np.concatenate([np.empty(0), *scores])

    return visit


def nearest_neighbours(embeddings: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the K nearest found for each row whose vec_id QUERY_EVERY divides."""
    vectors = scratch.save(packed(embeddings, zeros=False), "vectors")
    books = fit(vectors, counts(vectors))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), K, "double", visitor(books), shard_rows=shard_rows, block_rows=block_rows)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), Scratch(spark))
