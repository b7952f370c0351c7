"""Suffix dedup of bytes: removes what a 50-byte string of an earlier document covers.

The distributed difference-cover construction, cut at the depth that matters.
Suffixes need sorting to 50 bytes only, so a cover of period 13 takes the place
of triples modulo 3: for any two positions some shift below 13 brings both into
the sample, and a 38-byte prefix from there still lies inside the 50 bytes.

1. Sampled suffixes are named by their 38-byte prefixes; names are sorted, and
   neighbours in that order show which repeat. A unique name ends its suffix's
   part in the recursion, as it cannot share a longer prefix.
2. The names of the next level are those of 50-byte prefixes, of all suffixes
   (sampled or not) within reach of a sampled one that is left. They are merged
   in sorted order; equal neighbours are equal prefixes, and of these the ones
   that also start in a smaller document mark their bytes for removal.

Documents are dealt in the order of doc_id to chunks of ``CHUNK`` bytes. A chunk
sends each name once, however often it holds it, sorted and as differences, to
the name's range; what comes back is a bit for each name. As chunks are in the
order of doc_id, "in an earlier chunk" is all that a range must answer, and the
documents of one chunk are told apart in place. A hot string thus sends one name
per chunk, and no group grows with its number of copies.

A document whose whole text an earlier one has too goes first: all its bytes are
covered, and whatever it holds starts in the earlier one, so it changes no other
document's result. That keeps groups of copies out of both levels.

Names are hashes: of 41 or more bits at level one, where a false repeat costs
time alone, and at level two of so many bits, 64 and further bytes of a second
hash, that the expected number of false equalities among all strings of a corpus
of that size is below ``FALSE``, whatever the size: bits grow with its logarithm.

Defined cases: a null text is empty; texts under 50 bytes keep all; rows that
repeat a doc_id are the same document to each other and remove nothing from one
another; a row without doc_id keeps all and is nobody's earlier document; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import names as nm
from .shared import U64, Scratch, buffers, content_key, prefix_hash, second_hash, span_hash, table, text_of

LENGTH, PERIOD, COVER = 50, 13, (0, 1, 3, 9)
SAMPLE_LENGTH = LENGTH - PERIOD + 1
#: Raise this with the corpus (128 MB at 100 TB): a chunk meets every range.
CHUNK, FALSE = 4 << 20, 1e-6
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Chunk:
    """The texts of a chunk end to end, and both levels' names of its positions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids
        self.prefix = prefix_hash(data)

    def named(self, places: np.ndarray, length: int, bits: int):
        """(order of the places by name, then place; where a new name begins in it; the different names; their bytes beyond 64 bits, if any)."""
        names = span_hash(self.prefix, places, places + length) >> U64(max(0, 64 - bits))
        order = np.argsort(names, kind="stable")
        extra = second_hash(self.data, places, length, (bits - 57) // 8) if bits > 64 else None
        if extra is not None:
            ordered = names[order]
            same = np.flatnonzero(ordered[1:] == ordered[:-1])
            if (extra[order[same + 1]] != extra[order[same]]).any():
                order = np.lexsort((extra, names))
        ordered, fresh = names[order], np.ones(len(names), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        if extra is not None:
            same = np.flatnonzero(~fresh)
            fresh[same] = extra[order[same]] != extra[order[same - 1]]
            extra = extra[order[fresh]].view(np.uint8).reshape(-1, 8)[:, : (bits - 57) // 8]
        return order, fresh, ordered[fresh], extra

    def sampled(self, bits: int):
        sizes = np.diff(self.offsets)
        inside = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], sizes)
        taken = np.zeros(PERIOD, bool)
        taken[list(COVER)] = True
        left = np.repeat(sizes, sizes) - inside
        self.places = np.flatnonzero(taken[inside % PERIOD] & (left >= SAMPLE_LENGTH))
        self.whole = left >= LENGTH
        return self.named(self.places, SAMPLE_LENGTH, bits)

    def reachable(self, bits: int, repeated: np.ndarray):
        """Positions whose 50 bytes hold a sampled suffix that is left, with their names."""
        order, fresh, names, _ = self.sampled(bits)
        number = np.cumsum(fresh) - 1
        alive = repeated | (np.bincount(number, minlength=len(names)) > 1)
        marks = np.zeros(len(self.data) + PERIOD + 1, np.int32)
        marks[self.places[order[alive[number]]] + 1] = 1
        upto = np.cumsum(marks, dtype=np.int32)
        n = len(self.data)
        return np.flatnonzero((upto[PERIOD : n + PERIOD] > upto[:n]) & self.whole)

    def result(self, starts: np.ndarray) -> pa.RecordBatch:
        marks = np.zeros(len(self.data) + LENGTH + 1, np.int32)
        marks[starts] += 1
        marks[starts + LENGTH] -= 1
        gone = np.cumsum(marks[: len(self.data)]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        begins = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[begins] = gone[begins]
        upto, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
        a, b = self.offsets[:-1], self.offsets[1:]
        kept = [sha256((self.data[i:j] if not n else self.data[i:j][~gone[i:j]]).tobytes()).hexdigest() for i, j, n in zip(a.tolist(), b.tolist(), (upto[b] - upto[a]).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(b - a, pa.int64()), pa.array(upto[b] - upto[a], pa.int64()), pa.array(runs[b] - runs[a], pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, short): documents whose text a document of smaller doc_id has too; ``short`` is a text under LENGTH bytes."""
    size = F.octet_length(text_of()).cast("long")
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("key"), size.alias("n_bytes"), F.when(size < LENGTH, text_of()).alias("short"))
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head")
    return keyed.join(heads, "key").where("doc_id > head").drop("head")


def make_chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(chunk, ids, sizes, data), in the order of doc_id; rows of equal doc_id stay together."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit():
            data, offsets = buffers(pa.chunked_array([h.column("text") for h in held]))
            ids = np.concatenate([h.column("doc_id").to_numpy() for h in held])
            columns = [pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "data"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i in range(len(ids)):
                before = ids[i - 1] if i else (held[-1].column("doc_id")[-1].as_py() if held else None)
                if size + sizes[i] > CHUNK and size and before != ids[i]:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield emit()
                    held, size, at, n = [], 0, i, n + 1
                size += sizes[i]
            if at < len(ids):
                held.append(batch.slice(at))
        if held:
            yield emit()

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return scratch.save(dealt.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, data binary"), "chunks", rows=nm.FILE_CHUNKS)


def _chunk(batch: pa.RecordBatch, i: int) -> Chunk:
    sizes = batch.column("sizes")[i].values.to_numpy()
    data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
    return Chunk(data, np.concatenate([[0], np.cumsum(sizes)]), batch.column("ids")[i].values.to_numpy())


def remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    copies = scratch.save(whole_copies(docs), "copies")
    others = docs.select("doc_id", "text").withColumn("key", content_key()).join(copies.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")
    chunks = make_chunks(others, scratch)
    total = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)")).alias("n")).first().n or 0
    names = max(2.0, total * len(COVER) / PERIOD)
    ranges = nm.ranges(names)
    first_bits = min(62, max(41, math.ceil(math.log2(names)) + 10))

    def level_one(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, own, _ = _chunk(batch, i).sampled(first_bits)
                yield nm.sent(batch.column("chunk")[i].as_py(), own, first_bits, ranges, 3)

    left = scratch.save(nm.ask(chunks.select("chunk", "ids", "sizes", "data").mapInArrow(level_one, nm.SENT), nm.repeated(False)), "left")
    second_bits = max(48, math.ceil(2 * math.log2(max(2, total)) - 1 - math.log2(FALSE)))
    seconds = nm.ranges(total * 0.5)
    both = chunks.join(left.hint("shuffle_hash"), "chunk", "left")

    def level_two(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = _chunk(batch, i)
                places = own.reachable(first_bits, nm.bits_of(batch.column("answer")[i].as_py()))
                _, _, names, extra = own.named(places, LENGTH, second_bits)
                yield nm.sent(batch.column("chunk")[i].as_py(), names, min(64, second_bits), seconds, 4, extra)

    told = scratch.save(nm.ask(both.mapInArrow(level_two, nm.SENT), nm.repeated(True)), "told")

    def merge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = _chunk(batch, i)
                places = own.reachable(first_bits, nm.bits_of(batch.column("answer")[i].as_py()))
                order, fresh, _, _ = own.named(places, LENGTH, second_bits)
                number = np.cumsum(fresh) - 1
                earlier = nm.bits_of(batch.column("earlier")[i].as_py())[number]
                places = places[order]
                doc = own.ids[np.searchsorted(own.offsets, places, side="right") - 1]
                # places of a name are in their order, so the first is in the smallest document
                earlier |= doc > doc[fresh][number]
                yield own.result(places[earlier])

    all_ = both.join(told.withColumnRenamed("answer", "earlier").hint("shuffle_hash"), "chunk", "left")
    done = all_.mapInArrow(merge, RESULT)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    unnamed = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    gone = F.col("n_bytes") >= LENGTH
    copied = copies.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.sha2(F.coalesce("short", F.lit("")), 256).alias("kept_sha256"))
    return done.unionByName(copied).unionByName(unnamed)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, x[i + 1 : i + 50] AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS head FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id AS doc_id, w.i AS i FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.head),
b AS (SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true)::INT AS begins FROM h),
r AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
l AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM g GROUP BY doc_id)
SELECT d.doc_id AS doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN l.a IS NULL THEN sha256(x)
            ELSE sha256(unhex(array_to_string(list_transform(range(0, len(l.a) + 1), lambda k: hex(x[coalesce(l.z[k], 0) + 1 : coalesce(l.a[k + 1], n)])), ''))) END AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""
