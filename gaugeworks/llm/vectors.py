"""Vector search by shards of entries and blocks of queries.

Rows that take part become (dim, vec_id, packed doubles). Entries are dealt to
shards and queries to blocks by hashes, in numbers that follow from the counts,
so that no group grows with the table; every block meets every shard of its
dimension in a group of its own, and the best of each meet in a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch


def matrices(column: pa.Array):
    """(places, matrix of doubles) for each length that occurs, of the vectors that have components, all of them finite numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == n)
        x = pc.fill_null(pc.list_flatten(column.take(pa.array(places))).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(x).all(1)
        if good.any():
            yield places[good], x[good]


def packed(rows: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None, zeros: bool = True) -> DataFrame:
    """(dim, vec_id, vec, row): the rows, each with a number of its own, whose vectors have components, all of them finite (and one not zero, unless ``zeros``)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not zeros and not x.any():
                    continue
                ids.append(i)
                dims.append(len(x))
                out.append((change(x) if change else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(np.arange(number, number + len(ids)))], ["dim", "vec_id", "vec", "row"])
            number += len(ids)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "dim int, vec_id long, vec binary, row long")


def counts(vectors: DataFrame) -> dict[int, int]:
    return {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per dimension that occurs


def _dealt(numbers: dict[int, int], size: int, salt: int, by: str = "vec_id"):
    """Which of ceil(count / size) parts a row goes to, by its dimension."""
    parts = {d: max(1, math.ceil(n / size)) for d, n in numbers.items()}
    of = F.lit(1)
    for d, n in parts.items():
        of = F.when(F.col("dim") == d, F.lit(n)).otherwise(of)
    return parts, F.pmod(F.xxhash64(by, F.lit(salt)), of).cast("int")


def search(
    entries: DataFrame, queries: DataFrame, k: int, score_type: str, visit: Callable, *, shard_rows: int, block_rows: int, shared: Scratch | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best entries for each row of ``queries``, its own vec_id left out.

    ``visit(ids, matrix, query_ids, query_matrix, floors)`` returns arrays (query
    number, vec_id, score) of the best in one shard. With ``shared``, a place for tables, each query
    first visits one shard alone, and the k-th score that it has then is its floor
    in all others. ``entries`` and ``queries`` should be stored: they are read twice.
    """
    n_entries, n_queries = counts(entries), counts(queries)
    shards, shard = _dealt(n_entries, shard_rows, 1)
    _, block = _dealt(n_queries, block_rows, 2, "row")
    blocks = {d: max(1, math.ceil(n / block_rows)) for d, n in n_queries.items()}
    number = lambda of, default: _case(of, default)
    # names of their own for the columns: both sides may come from one table, and Spark could not tell them apart
    entries = entries.toDF("dim", "vec_id", "vec", "number").drop("number")
    left = entries.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), number(blocks, 0) - 1))) if any(n > 1 for n in blocks.values()) else entries.withColumn("shard", shard).withColumn("block", F.lit(0))
    right = queries.withColumn("block", block).withColumn("home", F.pmod(F.xxhash64("row", F.lit(3)), number(shards, 1)).cast("int"))
    unpack = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, -1)
    kind = pa.int64() if score_type == "long" else pa.float64()

    def group(key, entry: pa.Table, query: pa.Table) -> pa.Table:
        names = ["row", "query_id", "vec_id", "score"]
        if not entry.num_rows or not query.num_rows:
            return pa.table([*(pa.array([], pa.int64()) for _ in range(3)), pa.array([], kind)], names)
        query_ids = query.column("vec_id").to_numpy()
        floors = query.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        number, ids, scores = visit(entry.column("vec_id").to_numpy(), unpack(entry), query_ids, unpack(query), np.where(np.isnan(floors), -np.inf, floors))
        rows = query.column("row").to_numpy()
        return pa.table([pa.array(rows[number], pa.int64()), pa.array(query_ids[number], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], names)

    def meet(of: DataFrame) -> DataFrame:
        keys = ("dim", "shard", "block")
        return left.groupBy(*keys).cogroup(of.groupBy(*keys)).applyInArrow(group, f"row long, query_id long, vec_id long, score {score_type}")

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    everywhere = F.explode(F.sequence(F.lit(0), number(shards, 1) - 1))
    if shared and any(n > 1 for n in shards.values()):
        first = shared.save(meet(right.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double"))), "first")
        floors = top(first).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
        rest = queries.toDF("q_dim", "q_id", "q_vec", "row").join(floors, "row", "left").select(F.col("q_dim").alias("dim"), F.col("q_id").alias("vec_id"), F.col("q_vec").alias("vec"), "row", "floor")
        rest = rest.withColumn("block", block).withColumn("home", F.pmod(F.xxhash64("row", F.lit(3)), number(shards, 1)).cast("int")).withColumn("shard", everywhere).where(F.col("shard") != F.col("home"))
        found = first.unionByName(meet(rest))
    else:
        found = meet(right.withColumn("shard", everywhere).withColumn("floor", F.lit(None).cast("double")))
    return top(found).select("query_id", "rank", "vec_id", "score")


def _case(of: dict[int, int], default: int):
    out = F.lit(default)
    for d, n in of.items():
        out = F.when(F.col("dim") == d, F.lit(n)).otherwise(out)
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
