"""What several operators share: table reading, durable cuts of lineage, Arrow text buffers and word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_tables: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one on one machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='gaugeworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder; each one cuts the lineage of what it holds. ``close`` removes them all.

    A query's result is a plan that reads its last tables, so a caller closes the
    scratch after it has written or collected the result.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/gaugeworks-{uuid.uuid4().hex}"
        self.known: list[str] = []  # tables of the catalog

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        """``df`` as written and read again; ``rows`` bounds those of a file, as a reader decodes thousands of a file at once, however wide."""
        path, schema = f"{self.root}/{name}", df.schema
        writer = df.write.option("compression", "zstd")
        writer = writer.option("maxRecordsPerFile", rows) if rows else writer
        # the table takes the place of the plan's shuffle files; a task holds a batch several times over, outside the heap and in Python
        wanted = {_CLEAN: "true", _BATCH: "16m"}
        before = {k: self.spark.conf.get(k) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table in ``buckets`` by ``key``: tables of as many buckets are joined by it without an exchange."""
        known = f"{self.root.rpartition('/')[2].replace('-', '_')}_{name}"
        df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(known)
        self.known.append(known)
        return self.spark.table(known)

    def close(self) -> None:
        for known in self.known:
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self.drop("")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with an underscore more for as long as a column has that name."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def content_key(name: str = "text") -> Column:
    """128 bits that stand for a text; equal for equal texts."""
    return F.md5(text_of(name))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """Parts of a batch with about ``most`` bytes of text each (one longer text makes a part of its own)."""
    at, size, lengths = 0, 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(n)
    if at < len(lengths):
        yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def powers(n: int, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """C**i and C**-i modulo 2**64 for i < n at least, where C is B**times."""
    up, down = f"up{times}", f"down{times}"
    if len(_tables.get(up, ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, base in ((up, pow(_BASE, times, 1 << 64)), (down, pow(_BASE_INV, times, 1 << 64))):
            out = np.empty(size, U64)
            out[0], done, step = 1, 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * U64(step)
                done, step = 2 * done, step * step % (1 << 64)
            _tables[key] = out
    return _tables[up], _tables[down]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums of byte times power, from which ``span_hash`` takes any span's hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def second_hash(data: np.ndarray, start: np.ndarray, length: int, width: int) -> np.ndarray:
    """``width`` bytes (up to 8) of a hash of the spans that is independent of ``span_hash``, as a number each."""
    up, down = powers(len(data) + 1, 3)
    # other numbers stand for the bytes and other powers for the places
    stands = mix(np.arange(256, dtype=U64) + U64(0x632BE59BD9B4E019))
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(stands[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[start + length] - prefix[start]) * down[start]) >> U64(64 - 8 * width)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each text's first word (n + 1 numbers). A word is a run of bytes above the space."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data > 32
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    start = inside & ~before
    end = ~inside & before
    joined = cut[inside[cut] & before[cut]]
    start[joined] = True
    end[joined] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Hashes of all ``width``-word shingles, each text's first shingle (n + 1), the word hashes and each text's first word.

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    starts, ends, first = words(data, offsets)
    prefix = prefix_hash(data)
    word = span_hash(prefix, starts, ends)
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    index = np.arange(at[-1]) - np.repeat(at[:-1], per) + np.repeat(first[:-1], per)
    last = np.repeat(first[1:], per)
    out = np.zeros(len(index), U64)
    factor = 1
    padded = np.concatenate([word, np.zeros(width, U64)])
    for k in range(width):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        piece = padded[index + k] * U64(factor)
        if k:
            piece[index + k >= last] = 0
        out += piece
    return mix(out), at, word, first
