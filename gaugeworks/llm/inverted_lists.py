"""Inverted lists by k-means with stored radii, visited by exact bounds.

Rows are (row, dim, vec_id, label, vec): a number of the row's own, and packed
doubles that are whole numbers. Every row lies in the list of its nearest centroid;
a list of many rows is cut into pieces, which are packed rows of a table, made once. The
inner product of q with any row of a list lies within |q| * radius of q . centroid,
so a query goes only to the lists whose interval reaches into one of its windows
and whose upper end does not lie below the k-th score that the query already has.

A visit is a row of its own (list, query). Pieces and visits meet in partitions
sorted by piece, pieces first, and stream through a task that holds one piece at a
time. What is shuffled follows the rows and the visits made; a piece that many queries
visit is dealt to as many tasks as its visits need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .balltree_topk import inner
from .shared import Scratch
from .vectors import best, counts, matrices

SAMPLE, MOST_LISTS, LLOYD = 16_384, 4_096, 12  # rows that centroids are fitted to, lists of a length, rounds
PIECE_ROWS, BLOCK_VISITS, AT_ONCE, FIRST = 4_096, 32_768, 256, 2
LEAST, MOST = -(2**63), 2**63 - 1
ROW = "row long, dim int, vec_id long, label {label}, vec binary"
WINDOWS = "array<struct<least:long,most:long,floor:long>>"


def numbered(rows: DataFrame, change) -> DataFrame:
    """Rows of (vec_id, label, embedding) as ROW: those whose vectors have components, all of them finite, which ``change`` makes whole."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for places, x in matrices(batch.column("embedding")):
                own, x = pa.array(places), change(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(x))), pa.array(np.full(len(x), x.shape[1], np.int32)), batch.column("vec_id").take(own), batch.column("label").take(own), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["row", "dim", "vec_id", "label", "vec"],
                )
                at += len(x)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, ROW.format(label=label))


def unpack(vecs: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out, squares = np.empty(len(x), np.int64), (centroids**2).sum(1)
    for at in range(0, len(x), 1024):
        out[at : at + 1024] = np.argmin(squares - 2 * x[at : at + 1024] @ centroids.T, 1)
    return out


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows spread over ``x``; a centroid that gets no row stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(LLOYD):
            of = nearest(x, out)
            n = np.bincount(of, minlength=k)
            total = np.zeros_like(out)
            np.add.at(total, of, x)
            out[n > 0] = total[n > 0] / n[n > 0, None]
        return np.nan_to_num(out, posinf=1e300, neginf=-1e300)


class Lists:
    """The index: ``pieces`` (dim, list, piece, ids, rows, labels, vecs), and on the driver, for each length, at most MOST_LISTS centroids, radii and piece counts."""

    def __init__(self, rows: DataFrame, scratch: Scratch, piece_rows: int = PIECE_ROWS, lists: int | None = None):
        self.scratch, self.spark = scratch, rows.sparkSession
        self.label = rows.schema["label"].dataType.simpleString()
        self.centre: dict[int, np.ndarray] = {}
        for dim, n in counts(rows).items():
            share = min(1.0, 3 * SAMPLE / n)
            key = F.xxhash64("row", F.lit(1))
            some = rows.where(F.col("dim") == dim).where(key <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else MOST))
            x = unpack(some.orderBy(key, "row").limit(SAMPLE).select("vec").toArrow().column("vec"), dim)
            self.centre[dim] = centroids(x, min(len(x), lists or MOST_LISTS, max(1, math.ceil(math.sqrt(n) / 2))))
        placed = scratch.save(self._placed(rows), "placed")
        self.radius = {dim: np.zeros(len(c)) for dim, c in self.centre.items()}
        self.parts = {dim: np.zeros(len(c), np.int64) for dim, c in self.centre.items()}
        for r in placed.groupBy("dim", "list").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():  # a row for each list
            self.radius[r.dim][r.list], self.parts[r.dim][r.list] = r.away, math.ceil(r.n / piece_rows)
        table = self._of_lists("parts", self.parts)
        piece = F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")).cast("int")
        self.pieces = scratch.save(placed.join(F.broadcast(table), ["dim", "list"]).withColumn("piece", piece).groupBy("dim", "list", "piece").applyInArrow(self._packed(), f"dim int, list int, piece int, ids binary, rows binary, labels array<{self.label}>, vecs binary"), "pieces")
        scratch.drop("placed")

    def _of_lists(self, name: str, values: dict[int, np.ndarray]) -> DataFrame:
        return self.spark.createDataFrame([(dim, i, int(v)) for dim, own in values.items() for i, v in enumerate(own)], f"dim int, list int, {name} long")

    def _placed(self, rows: DataFrame) -> DataFrame:
        centre = self.centre

        def run(batches):
            for batch in batches:
                for dim, own in by_dim(batch):
                    x = unpack(own.column("vec"), dim)
                    with np.errstate(over="ignore", invalid="ignore"):
                        of = nearest(x, centre[dim])
                        away = np.sqrt(((x - centre[dim][of]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(of, pa.int32()), pa.array(np.where(np.isfinite(away), away, np.inf))], [*own.schema.names, "list", "away"])

        return rows.mapInArrow(run, ROW.format(label=self.label) + ", list int, away double")

    @staticmethod
    def _packed():
        def pack(key, rows):
            dim, of, piece = (k.as_py() for k in key)
            labels = rows.column("label").combine_chunks()
            return pa.table({
                "dim": pa.array([dim], pa.int32()), "list": pa.array([of], pa.int32()), "piece": pa.array([piece], pa.int32()), "ids": [rows.column("vec_id").to_numpy().tobytes()], "rows": [rows.column("row").to_numpy().tobytes()],
                "labels": pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels), "vecs": pa.array([b"".join(rows.column("vec").to_pylist())], pa.binary()),
            })

        return pack

    def visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """(dim, list, row, label, vec, windows): the lists that a query (row, dim, label, vec, windows) goes to.

        With ``first``, the FIRST lists by upper bound among those that reach into a
        window; without, all others, but those that end below the floor of each window.
        """
        centre, radius, parts = self.centre, self.radius, self.parts

        def run(batches):
            for batch in batches:
                for dim, own in by_dim(batch):
                    for at in range(0, own.num_rows, 1024):
                        some = own.slice(at, 1024)
                        q = unpack(some.column("vec"), dim)
                        with np.errstate(over="ignore", invalid="ignore"):
                            middle, reach = q @ centre[dim].T, np.sqrt((q**2).sum(1))[:, None] * radius[dim]
                            slack = (np.abs(middle) + reach) * 1e-9 + 1e-6 * (1 + np.sqrt((q**2).sum(1)))[:, None]
                            upper, lower = middle + reach + slack, middle - reach - slack
                        upper[np.isnan(upper)], lower[np.isnan(lower)] = np.inf, -np.inf
                        took, lists = [], []
                        for n, windows in enumerate(some.column("windows").to_pylist()):
                            within = parts[dim] > 0
                            into = np.zeros(len(within), bool)
                            open_ = np.zeros(len(within), bool)
                            for w in windows:
                                reaches = (upper[n] >= w["least"]) & (lower[n] <= w["most"])
                                into |= reaches
                                open_ |= reaches & (upper[n] >= w["floor"])
                            into &= within
                            found = np.flatnonzero(into)
                            ahead = found[np.argsort(-upper[n][found], kind="stable")[:FIRST]]
                            if not first:
                                into &= open_
                                into[ahead] = False
                                ahead = np.flatnonzero(into)
                            took.append(np.full(len(ahead), n))
                            lists.append(ahead)
                        took = pa.array(np.concatenate(took))
                        got = some.take(took)
                        yield pa.RecordBatch.from_arrays([got.column("dim"), pa.array(np.concatenate(lists), pa.int32()), *(got.column(c) for c in ("row", "label", "vec", "windows"))], ["dim", "list", "row", "label", "vec", "windows"])

        return queries.select("dim", "row", "label", "vec", "windows").mapInArrow(run, f"dim int, list int, row long, label {self.label}, vec binary, windows {WINDOWS}")

    def found(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, window, vec_id, found, score) of the ``k`` best of each piece for each visit and window, of the query's label (``same``) or of others.

        ``visits`` should be stored: they are read twice.
        """
        per = visits.groupBy("dim", "list").count().collect()  # a row for each list
        blocks = {dim: np.ones(len(c), np.int64) for dim, c in self.centre.items()}
        for r in per:
            blocks[r.dim][r.list] = math.ceil(r["count"] / BLOCK_VISITS)
        table = F.broadcast(self._of_lists("parts", self.parts).join(self._of_lists("blocks", blocks), ["dim", "list"]))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
        none = lambda kind: F.lit(None).cast(kind)
        left = self.pieces.join(table, ["dim", "list"]).withColumn("block", each("blocks")).select(
            "dim", "list", "piece", "block", F.lit(0).alias("kind"), "ids", "rows", "labels", "vecs", none("long").alias("row"), none(self.label).alias("label"), none(WINDOWS).alias("windows"))
        right = visits.join(table, ["dim", "list"]).withColumn("piece", each("parts")).select(
            "dim", "list", "piece", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), none("binary").alias("ids"), none("binary").alias("rows"), none(f"array<{self.label}>").alias("labels"),
            F.col("vec").alias("vecs"), "row", "label", "windows")
        key = ("dim", "list", "piece", "block")
        met = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind")

        def run(batches):
            held, ids = None, None
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                cuts = np.flatnonzero(np.diff(kinds, prepend=-1) != 0).tolist() + [len(kinds)]
                for start, end in zip(cuts, cuts[1:], strict=False):
                    if kinds[start] == 0:  # a piece after a piece has no visit
                        held = batch.slice(end - 1, 1)
                        dim = held.column("dim")[0].as_py()
                        points = np.frombuffer(held.column("vecs")[0].as_py(), np.float64).reshape(-1, dim)
                        ids, rows = (np.frombuffer(held.column(c)[0].as_py(), np.int64) for c in ("ids", "rows"))
                        labels = held.column("labels")[0].values.to_numpy(zero_copy_only=False)
                        top = np.abs(points).max(initial=0)
                        continue
                    for at in range(start, end, AT_ONCE):
                        some = batch.slice(at, min(AT_ONCE, end - at))
                        q = unpack(some.column("vecs"), dim)
                        exact = top * np.abs(q).max(initial=0) * dim < 2.0**52
                        scores = (points @ q.T).astype(np.int64) if exact else np.column_stack([inner(points, v, False) for v in q])
                        out = [[], [], [], [], []]
                        for n, (row, label, windows) in enumerate(zip(some.column("row").to_pylist(), some.column("label").to_pylist(), some.column("windows").to_pylist(), strict=True)):
                            own = scores[:, n]
                            fits = ((labels == label) & (rows != row) if same else labels != label) & (own >= min(max(w["least"], w["floor"]) for w in windows))
                            near = np.flatnonzero(fits)
                            got = own[near]
                            for number, w in enumerate(windows):
                                here = near[(got >= max(w["least"], w["floor"])) & (got <= w["most"])]
                                kept = here[best(ids[here], own[here], k)]
                                out[0].append(np.full(len(kept), row))
                                out[1].append(np.full(len(kept), number, np.int32))
                                out[2].append(ids[kept])
                                out[3].append(rows[kept])
                                out[4].append(own[kept])
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["row", "window", "vec_id", "found", "score"])

        return met.mapInArrow(run, "row long, window int, vec_id long, found long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best for each query and window, ties to the smaller vec_id, with their ``rank``."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(lists: Lists, queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """(row, window, rank, vec_id, found, score): for each window of each query the ``k`` best rows of its label (``same``) or of others, exactly."""
    scratch = lists.scratch
    ahead = scratch.save(top(lists.found(scratch.save(lists.visits(queries, True), f"{name}_ahead_visits"), k, same), k), f"{name}_ahead")
    floors = ahead.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))  # as many as a query has windows
    raised = F.transform("windows", lambda w, i: F.struct(w["least"].alias("least"), w["most"].alias("most"), F.coalesce(F.try_element_at("floors", i), F.lit(LEAST)).alias("floor")))
    rest = scratch.save(lists.visits(queries.join(floors, "row", "left").withColumn("windows", raised), False), f"{name}_visits")
    return top(ahead.drop("rank").unionByName(lists.found(rest, k, same)), k)
