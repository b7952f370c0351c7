"""Near-duplicate documents by weighted MinHash over TF-IDF shingles.

A document is a set of five-word shingles; a shingle's weight is its count times
its inverse document frequency, 1 + ln((1 + N) / (1 + df)) in steps of 1/1024,
where df is the number of documents that hold the shingle, counted over all rows. Improved consistent weighted sampling draws
``BANDS * ROWS`` samples from each document: for a shingle of weight w and gamma
and uniform numbers r, c, b that its hash fixes, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r, and the least a is the sample. As a depends on the
shingle and t alone, its value stands for both. Two documents agree in a sample
with the probability of their weighted Jaccard similarity; at 0.8 they share one
band of ten at least with a probability of 0.9992.

Documents that agree in a whole band are candidates:

1. Each is checked against one document, the one that is the least in most of
   its bands: one check per document, in hot bands too.
2. Components form. Where a band still holds documents of several components,
   all its documents meet those of the others: in bands of up to ``WIDE``
   documents as pairs, in wider ones block against block (``blocks.meet``), where
   the similarities of two blocks are a product of matrices, and only links that
   tie components together leave. Nothing is left unchecked.

A check is the weighted Jaccard similarity of the whole sets, ``LEAST`` or more.
Documents with one text are one class from the start, by its MD5.

Defined cases: a null text is empty, and empty texts are copies of each other;
texts of white space alone are alike; a text under five words is one shingle of
all its words; rows that repeat a doc_id are one document, that of the text with
the least MD5; rows without doc_id are no document here (and stay in
``keep_one``); an empty table gives an empty result; other columns pass through
``keep_one`` and are not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from . import names as nm
from .links import components
from .shared import U64, Scratch, buffers, content_key, mix, shingles, table, text_of

WIDTH, LEAST = 5, 0.8
BANDS, ROWS, SEED = 10, 3, 11
BITS = 48
#: Cells of up to WIDE rows meet as pairs, wider ones block against block.
WIDE = 32


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different shingles of 48 bits, text after text and in order; how often each occurs; each text's first)."""
    hashes, at, _, _ = shingles(*buffers(texts), WIDTH)
    count, out, times, starts = np.diff(at), [np.empty(0, U64)], [np.empty(0, np.int64)], [0]
    for a in range(0, len(count), 1 << 16):
        b = min(len(count), a + (1 << 16))
        key = (np.repeat(np.arange(b - a), count[a:b]).astype(U64) << U64(BITS)) | (hashes[at[a] : at[b]] >> U64(64 - BITS))
        key.sort()
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        times.append(np.diff(np.concatenate([fresh, [len(key)]])))
        own = key[fresh]
        out.append(own & U64((1 << BITS) - 1))
        starts += (starts[-1] + np.cumsum(np.bincount((own >> U64(BITS)).astype(np.int64), minlength=b - a))).tolist()
    return np.concatenate(out), np.concatenate(times), np.array(starts)


def inverse_frequencies(n: int, df: np.ndarray) -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)), the smoothed form, in steps of 1/1024."""
    return np.clip(np.rint(1024 * (1 + np.log((1 + n) / (1 + df)))), 1, 65535).astype("<u2")


def shingle_steps(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """(chunk, answer): for each chunk the inverse document frequency of its different shingles, in their order."""
    count = chunks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.expr("aggregate(texts, 0L, (a, t) -> a + octet_length(t))")).alias("bytes")).first()
    n, parts = int(count.n or 0), nm.ranges((count.bytes or 0) / 5)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, _, _ = shingle_sets(batch.column("texts")[i].values)
                own, docs = np.unique(keys, return_counts=True)
                yield nm.sent(batch.column("chunk")[i].as_py(), own, BITS, parts, 4, docs.astype("<u4").view(np.uint8).reshape(-1, 4))

    def answer(names, sizes, extra):
        order = np.argsort(names, kind="stable")
        fresh = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        group = np.cumsum(fresh) - 1
        step = np.empty(len(names), "<u2")
        step[order] = inverse_frequencies(n, np.add.reduceat(extra.view("<u4")[order].astype(np.int64), np.flatnonzero(fresh)))[group]
        return [x.tobytes() for x in np.split(step, np.cumsum(sizes)[:-1])]

    return scratch.save(nm.ask(chunks.select("chunk", "texts").mapInArrow(send, nm.SENT), answer), "steps", rows=nm.FILE_CHUNKS)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    shared = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


_drawn: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at the middle of 65,536 steps: r, 1 / r and ln c."""
    if not _drawn:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.sqrt(2 * p)  # Newton from the small end of 1 - exp(-x) (1 + x) = p
        low, high = np.zeros_like(p), np.full_like(p, 40.0)
        for _ in range(60):
            less = 1 - np.exp(-x) * (1 + x) < p
            low, high = np.where(less, x, low), np.where(less, high, x)
            x = (low + high) / 2
        _drawn["t"] = (x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32))
    return _drawn["t"]


def samples(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """BANDS * ROWS samples (32 bits each) of each text; those of a text without words are 0. About ``most`` shingles at a time stay in the cache."""
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.int32)
    full = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(first[1:][full], first[full[at]] + most, side="right")))
        texts = full[at:to]
        span = slice(first[texts[0]], first[texts[-1] + 1])
        out[texts] = _draw(shingle[span], weight[span], first[texts] - first[texts[0]]).view(np.int32)
        at = to
    return out


def _draw(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r, inverse, log_c = _tables()
    out = np.empty((len(starts), BANDS * ROWS), np.float32)
    log_w = np.log(weight).astype(np.float32)
    low16, scale = U64(0xFFFF), np.float32(2.0**-32)
    base = mix(shingle.copy())
    for k in range(BANDS * ROWS):
        h = base * U64((0x9E3779B97F4A7C15 * (2 * (k + SEED) + 1)) % (1 << 64))
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        at = (h & low16).astype(np.int32)
        b = (h >> U64(32)).astype(np.float32) * scale
        t = np.floor(log_w * inverse[at] + b)
        value = log_c[((h >> U64(16)) & low16).astype(np.int32)] - r[at] * (t - b + np.float32(1))
        out[:, k] = np.minimum.reduceat(value, starts)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    x = drawn.view(np.uint32).astype(U64).reshape(len(drawn), BANDS, ROWS)
    key = np.zeros((len(drawn), BANDS), U64) + np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        key = mix((key ^ x[:, :, j]) * U64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def signatures(chunks: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(chunk, ids, keys, bands, texts, steps): each text's band keys, and the steps of its shingles in their order as 16-bit numbers."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, times, starts = shingle_sets(batch.column("texts")[i].values)
                step = nm.numbers_of(batch.column("answer")[i].as_py(), "<u2")[np.searchsorted(np.unique(keys), keys)]
                bands, n = band_keys(samples(keys, times * (step / 1024), starts)), len(starts) - 1
                whole = pa.array([0, n], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                said = pa.array([step[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())
                columns = [batch.column(c).slice(i, 1) for c in ("chunk", "ids", "keys")] + [pa.ListArray.from_arrays(whole, x) for x in (lists, said)] + [batch.column("texts").slice(i, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "keys", "bands", "steps", "texts"])

    both = chunks.join(steps.hint("shuffle_hash"), "chunk", "left")
    return scratch.save(both.mapInArrow(run, "chunk long, ids array<long>, keys array<string>, bands array<array<long>>, steps array<binary>, texts array<string>"), "signed", rows=nm.FILE_CHUNKS)


def weighted_sets(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, size, set) of ``wanted`` (chunk, id, key): the set is its shingles (48 bits, step below) and, after them, their counts."""
    lists = wanted.groupBy("chunk").agg(F.collect_set(F.struct("id", "key")).alias("wanted"))  # of one chunk, so bounded

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                wants = {(w["id"], w["key"]) for w in batch.column("wanted")[i].as_py()}
                ids, keys = (batch.column(c)[i].as_py() for c in ("ids", "keys"))
                # a text that a chunk holds twice under one id counts once
                places = pa.array(list({x: k for k, x in enumerate(zip(ids, keys, strict=True)) if x in wants}.values()), pa.int64())
                own, times, starts = shingle_sets(batch.column("texts")[i].values.take(places))
                step = np.frombuffer(b"".join(batch.column("steps")[i].values.take(places).to_pylist()), "<u2")
                packed, times = (own << U64(16)) | step.astype(U64), times.astype("<u4")
                sets = [packed[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.take(places), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["id", "size", "set"])

    # what is wanted is held, and the chunks, which are far larger, pass by
    both = lists.hint("shuffle_hash").join(signed, "chunk")
    return both.select("ids", "keys", "texts", "steps", "wanted").mapInArrow(run, "id long, size long, set binary").dropDuplicates(["id"])


def read_set(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, steps)."""
    n = len(blob) // 12
    packed = np.frombuffer(blob, "<u8", n)
    return packed >> U64(16), np.frombuffer(blob, "<u4", n, 8 * n).astype(np.int64), (packed & U64(0xFFFF)).astype(np.int64)


def _check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is LEAST or more."""

    def run(batches):
        for batch in batches:
            got = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                (a, n, v), (b, m, w) = read_set(x.as_py()), read_set(y.as_py())
                got.append(similarity(a, n * v, b, m * w))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    one, two = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= LEAST).select("a", "b")


def similarities(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], one: np.ndarray, two: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """The weighted Jaccard similarities of the sets ``one`` with the sets ``two``: sums of least counts, as a product of matrices."""
    sizes = np.array([int(n.sum()) for _, n, _ in sets])
    total = np.array([int((n * v).sum()) for _, n, v in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), sizes)
    key, step = np.concatenate([np.repeat(a, n) for a, n, _ in sets]), np.concatenate([np.repeat(v, n) for _, n, v in sets])
    again = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for _, n, _ in sets])
    # the k-th time that a set has a shingle is an element of its own
    _, element, count = np.unique(mix(key + again.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    kept = count[element] > 1
    order = np.argsort(element[kept], kind="stable")
    row, step = row[kept][order], step[kept][order].astype(np.float64)
    column = np.unique(element[kept][order], return_inverse=True)[1]
    shared, wide, at, columns = np.zeros((len(one), len(two))), max(1, most // max(1, len(sets))), 0, int(column[-1]) + 1 if len(column) else 0
    for first in range(0, columns, wide):
        to = int(np.searchsorted(column, first + wide))
        dense = np.zeros((len(sets), min(wide, columns - first)))
        dense[row[at:to], column[at:to] - first] = np.sqrt(step[at:to])
        shared += dense[one] @ dense[two].T
        at = to
    union = total[one][:, None] + total[two][None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def _tie(group: pa.Table, inside: bool) -> pa.Table:
    """Of the links between the blocks, or inside one, those that tie labels together that no other of them has tied."""
    ids, labels, side = (group.column(c).to_numpy() for c in ("id", "label", "side"))
    sets = [read_set(x.as_py()) for x in group.column("set")]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if inside else 1))
    near, links = similarities(sets, one, two), []
    # the product of roots is off in the last places, so what is close is looked at again
    for i, j in np.argwhere(np.abs(near - LEAST) < 1e-6).tolist():
        (a, n, v), (b, m, w) = sets[one[i]], sets[two[j]]
        near[i, j] = similarity(a, n * v, b, m * w)
    root = np.unique(labels, return_inverse=True)[1]
    for i, x in enumerate(one.tolist()):
        while len(far := np.flatnonzero((near[i] >= LEAST) & (root[two] != root[x]))):
            y = int(two[far[0]])
            links.append((int(ids[x]), int(ids[y])))
            root[root == root[y]] = root[x]
    return pa.table([pa.array([c[k] for c in links], pa.int64()) for k in range(2)], ["id", "id_2"])


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, class_id): a row for each doc_id; class_id is the least doc_id that its links reach."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), content_key().alias("key"), text_of().alias("text"))
    chunks = nm.make_chunks(rows, ["id", "key", "text"], scratch)
    steps = shingle_steps(chunks, scratch)
    chunked = signatures(chunks, steps, scratch)
    for name in ("chunks", "steps"):
        scratch.drop(name)
    signed = chunked.select("chunk", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("keys").alias("key"), "bands")).alias("x")).select("chunk", "x.*")
    members = scratch.save(signed.groupBy("id").agg(F.min("key").alias("key")), "members")
    heads = scratch.save(members.groupBy("key").agg(F.min("id").alias("head")), "heads")
    own = signed.join(heads.select("key", F.col("head").alias("id")), ["id", "key"], "left_semi")
    banded = own.select("chunk", "id", "key", F.posexplode("bands").alias("band", "value"))
    # all in a band that more than one class is in, and the least of them
    cells = banded.groupBy("band", "value").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "value", "low")
    shared = scratch.save(banded.join(cells, ["band", "value"]), "shared")
    best = shared.where("id > low").groupBy("id", "low").agg(F.count_distinct("band").alias("n")).groupBy("id").agg(F.max(F.struct("n", -F.col("low"))).alias("m"))
    first = scratch.save(best.select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b")), "first")
    sets = scratch.save(weighted_sets(chunked, shared.select("chunk", "id", "key").distinct()), "sets")
    scratch.drop("signed")
    linked = scratch.save(_check(first, sets), "linked-1")
    labels = components(linked, scratch, "one")
    # what is left in a band: all of its documents, if they are of several components
    inside = shared.select("band", "value", "id").distinct().join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = inside.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "value", "n")
    left = scratch.save(inside.join(mixed, ["band", "value"]).select("band", "value", "n", "label", "id"), "left")
    few = left.where(F.col("n") <= WIDE)
    met = few.join(few.select("band", "value", F.col("label").alias("label_2"), F.col("id").alias("b")), ["band", "value"]).where("label <> label_2 and id > b")
    open_ = met.select(F.col("id").alias("a"), "b").distinct().join(first, ["a", "b"], "left_anti")
    linked = linked.unionByName(scratch.save(_check(open_, sets), "linked-2"))
    many = left.where(F.col("n") > WIDE).join(sets.select("id", "size"), "id")
    dealt = blocks.deal(many, ["band", "value"], []).join(sets.select("id", "set").hint("merge"), "id")
    tied = blocks.meet(dealt, ["band", "value"], _tie, "id long, id_2 long")
    linked = linked.unionByName(scratch.save(tied.select(F.col("id").alias("a"), F.col("id_2").alias("b")), "linked-3"))
    final = components(linked, scratch, "two")
    labelled = members.join(heads, "key").join(final.select(F.col("node").alias("head"), "label"), "head", "left")
    return labelled.select(F.col("id").alias("doc_id"), F.coalesce("label", "head").alias("class_id"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` but those of documents that are in the class of one with a smaller doc_id; one row for a doc_id, that of the text with the least MD5."""
    classes = near_duplicates(docs, scratch).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("kept_id"), content_key().alias("kept_key"))
    kept = rows.where(F.col("kept_id").isNotNull()).join(classes, "kept_id", "left_semi").groupBy("kept_id").agg(F.min_by("row", F.struct("kept_key", F.xxhash64("row"))).alias("row"))
    return kept.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
