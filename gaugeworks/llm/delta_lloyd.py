"""Vector code compression: product codes by Lloyd rounds that are maintained by deltas.

Components become floor(4096 * x), vectors are cut into ``PARTS`` equal consecutive
parts, and each part position has a codebook of at most ``ENTRIES`` integer entries.
Vectors lie in chunks of some thousand rows, in a table bucketed by chunk. A round
reads that table beside the previous round's assignments, bucketed alike, so that the two meet
without an exchange; it writes the new assignments and, for each chunk, what its
changed parts take from their old entries and bring to their new ones. Only these
sums are shuffled, a number for each component of an entry; the driver keeps the
running sums and counts, 16 * (components + 8) numbers, and sets the entries to
floor(sum / count). Sums and distances are integers, so that no order of adding
changes a result.

Defined cases: vectors that are null, empty or hold nulls or non-finite numbers
take no part, nor do those whose length 8 doesn't divide; vectors of another length
have codebooks (and a digest) of their own; rows without vec_id or label take part,
for the first entries they come last, and null labels add up together; of rows that
repeat a vec_id, the one whose components come first comes first; with fewer than
16 rows there are as many entries; scaled components beyond 2**40 are held at that
limit, errors beyond 64 bits at theirs; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vectors import matrices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
MOST = 2.0**40  # of a scaled component
EXACT = 2**29  # below it, eight squared differences of 64-bit numbers add up without overflow for parts of 8 components
CHUNK_ROWS, BUCKET_ROWS, BUCKETS = 8_192, 262_144, 16_384

Codebook = list[list[list[int]]]  # part, entry, component


def scaled(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int64)


def nearest(own: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The least entry of those nearest to each row of ``own``, and its squared distance (Python's integers where 64 bits don't hold it)."""
    book = np.array(entries, np.int64)
    top = max(int(np.abs(own).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int64 if own.shape[1] * (2 * top) ** 2 < 2**63 else object
    away = np.stack([((own.astype(kind) - entry.astype(kind)) ** 2).sum(1) for entry in book])
    code = np.argmin(away, 0) if kind is np.int64 else np.array([min(range(len(book)), key=lambda e: column[e]) for column in away.T])
    return code, away[code, np.arange(len(own))]


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, dim)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def chunks(embeddings: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, dim, ids, labels, vecs): the rows that take part, packed."""
    label = embeddings.schema["label"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for places, x in matrices(batch.column("embedding")):
                for at in range(0, len(places) if x.shape[1] % PARTS == 0 else 0, chunk_rows):
                    own = pa.array(places[at : at + chunk_rows])
                    ids, labels = batch.column("vec_id").take(own), batch.column("label").take(own)
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([x.shape[1]], pa.int32()), one(ids), one(labels), pa.array([scaled(x[at : at + chunk_rows]).tobytes()], pa.binary())],
                        ["chunk", "dim", "ids", "labels", "vecs"],
                    )
                    number += 1

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return rows.mapInArrow(run, f"chunk long, dim int, ids array<long>, labels array<{label}>, vecs binary")


def first_entries(chunked: DataFrame) -> dict[int, Codebook]:
    """The parts of the first rows by vec_id, for each length."""

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for dim, ids, vecs in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vecs")), strict=True):
                x = _matrix(vecs, dim)
                keys = np.array([math.inf if i is None else i for i in ids], object)
                near = sorted(range(len(ids)), key=lambda i: (keys[i], x[i].tolist()))[:ENTRIES]
                best[dim] = sorted([*best.get(dim, []), *((keys[i], x[i].tolist()) for i in near)])[:ENTRIES]
        for dim, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(own), pa.int32()), pa.array([None if i == math.inf else i for i, _ in own], pa.int64()), pa.array([v for _, v in own], pa.list_(pa.int64()))], ["dim", "vec_id", "vec"])

    top = chunked.select("dim", "ids", "vecs").mapInArrow(run, "dim int, vec_id long, vec array<long>")  # of a partition
    order = (F.col("vec_id").asc_nulls_last(), "vec")
    for by in ((F.pmod(F.hash("vec_id", "vec"), F.lit(64)),), ()):
        top = top.withColumn("n", F.row_number().over(Window.partitionBy("dim", *by).orderBy(*order))).where(F.col("n") <= ENTRIES)
    out: dict[int, Codebook] = {}
    for r in top.orderBy("dim", "n").collect():  # 16 for each length
        book = out.setdefault(r.dim, [[] for _ in range(PARTS)])
        for p in range(PARTS):
            book[p].append(list(r.vec[p * r.dim // PARTS : (p + 1) * r.dim // PARTS]))
    return out


def assigned(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """(chunk, dim, codes, moved): new assignments beside the previous ones in ``codes`` (null: none), and what they change.

    ``moved`` holds (place, value) pairs; a place counts through parts, entries and, of each entry, its count and its components.
    """

    def run(batches):
        for batch in batches:
            for chunk, dim, vecs, before in zip(*(batch.column(c).to_pylist() for c in ("chunk", "dim", "vecs", "codes")), strict=True):
                x = _matrix(vecs, dim)
                old = np.frombuffer(before, np.uint8).reshape(-1, PARTS) if before is not None else None
                new, width, at, values = np.empty((len(x), PARTS), np.uint8), dim // PARTS + 1, [], []
                for p, own in enumerate(_parts(x)):
                    new[:, p] = nearest(own, books[dim][p])[0]
                    changed = np.flatnonzero(new[:, p] != old[:, p]) if old is not None else np.arange(len(x))
                    total = np.zeros((ENTRIES, width), np.int64)
                    with_count = np.column_stack([np.ones(len(changed), np.int64), own[changed]])
                    np.add.at(total, new[changed, p], with_count)
                    if old is not None:
                        np.subtract.at(total, old[changed, p], with_count)
                    found = np.flatnonzero(total)
                    at.append(found + p * ENTRIES * width)
                    values.append(total.ravel()[found])
                at, values = np.concatenate(at), np.concatenate(values)
                pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(values, pa.int64())], ["place", "value"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([dim], pa.int32()), pa.array([new.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pairs)],
                    ["chunk", "dim", "codes", "moved"],
                )

    return rows.mapInArrow(run, "chunk long, dim int, codes binary, moved array<struct<place:int,value:long>>")


def fit(vectors: DataFrame, scratch: Scratch, buckets: int, rounds: int = ROUNDS) -> dict[int, Codebook]:
    """The codebooks after all rounds, by length; ``vectors`` are chunks, bucketed by chunk."""
    books = first_entries(vectors)
    sums = {dim: np.zeros((PARTS, ENTRIES, dim // PARTS + 1), object) for dim in books}
    rows = vectors.select("chunk", "dim", "vecs", F.lit(None).cast("binary").alias("codes"))
    for n in range(rounds):
        state = scratch.bucketed(assigned(rows, books), f"codes_{n}", "chunk", buckets)
        moved = state.select("dim", F.explode("moved").alias("m")).groupBy("dim", "m.place").agg(F.sum(F.col("m.value").cast("decimal(38,0)")).alias("value"))
        for r in moved.collect():  # a number for each component of an entry
            sums[r.dim].ravel()[r.place] += int(r.value)
        for dim, total in sums.items():
            books[dim] = [[[s // int(own[0]) for s in own[1:].tolist()] if own[0] else entry for entry, own in zip(books[dim][p], total[p], strict=False)] for p in range(PARTS)]
        rows = vectors.select("chunk", "dim", "vecs").join(state.select("chunk", "codes"), "chunk")
        if n:
            scratch.drop(f"codes_{n - 1}")
    return books


def digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(str(c) for part in book for entry in part for c in entry).encode()).hexdigest()


def encoded(vectors: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256), a row for each vector."""
    digests = {dim: digest(book) for dim, book in books.items()}
    label = vectors.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for n, (dim, vecs) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("vecs").to_pylist(), strict=True)):
                x = _matrix(vecs, dim)
                found = [nearest(own, books[dim][p]) for p, own in enumerate(_parts(x))]
                codes = np.column_stack([code for code, _ in found]).astype(np.uint8)
                away = [np.asarray(a, object) if max(int(a.max(initial=0)) for _, a in found) * PARTS >= 2**63 else a for _, a in found]
                error = np.minimum(sum(away), 2**63 - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[n].values, batch.column("labels")[n].values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), pa.array([digests[dim]] * len(x), pa.string())],
                    ["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return vectors.select("dim", "ids", "labels", "vecs").mapInArrow(run, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(embeddings: DataFrame, scratch: Scratch, rounds: int = ROUNDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all rows that take part."""
    packed = scratch.save(chunks(embeddings, chunk_rows), "packed")
    n = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
    buckets = min(BUCKETS, max(1, math.ceil(n / BUCKET_ROWS), min(packed.count(), packed.sparkSession.sparkContext.defaultParallelism)))
    vectors = scratch.bucketed(packed.repartition(buckets, "chunk"), "vectors", "chunk", buckets)
    scratch.drop("packed")
    books = fit(vectors, scratch, buckets, rounds)
    codes = scratch.save(encoded(vectors, books), "encoded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), Scratch(spark))


def _oracle() -> str:
    """All rounds written out; the lengths of the vectors must be one multiple of 8."""
    steps = ["""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT rid, p, list_slice(q, p * len(q) // 8 + 1, (p + 1) * len(q) // 8) AS own FROM k, range(8) t(p)),
f AS (SELECT q, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM k QUALIFY e < 16),
b0 AS MATERIALIZED (SELECT p, e, list_slice(q, p * len(q) // 8 + 1, (p + 1) * len(q) // 8) AS entry FROM f, range(8) t(p))"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT rid, v.p, min({{'d': list_sum(list_transform(list_zip(own, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT, 'e': e}}) AS best
      FROM v JOIN b{n} b ON v.p = b.p GROUP BY rid, v.p)""")
        if n < ROUNDS:
            steps.append(f"""
s{n} AS (SELECT p, best.e AS e, i, sum(own[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (rid, p), range(1, 1000) t(i) WHERE i <= len(own) GROUP BY ALL),
m{n} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i)::BIGINT[] AS entry FROM s{n} GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM b{n} b LEFT JOIN m{n} m USING (p, e))""")
    steps.append(f"""
c AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS digest FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM k JOIN c USING (rid), h
""")
    return ",".join(steps)


ORACLE = _oracle()
