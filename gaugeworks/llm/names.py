"""Sorted names of a chunk's strings, dealt to ranges of names and answered there.

A chunk sends each name once, sorted and as differences, to the name's range. A
range sees all chunks that hold a name and answers each of them, name by name.
So a string that is everywhere sends one name per chunk, and no group grows with
the number of its copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, Scratch, slices

RANGE_NAMES, CHUNK = 3 << 20, 4 << 20
#: Chunks of a file: a task decodes a file's rows at once, so that is what it holds, whatever its share of the input.
FILE_CHUNKS = 8


def make_chunks(rows: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """(chunk, and a list ``<column>s`` for each of ``columns``): ``rows`` as they are dealt, about CHUNK bytes of ``text`` in a row."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                whole = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, part.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), *lists], ["chunk", *(f"{c}s" for c in columns)])
                n += 1

    schema = ", ".join(["chunk long", *(f"{c}s array<{rows.schema[c].dataType.simpleString()}>" for c in columns)])
    return scratch.save(rows.select(*columns).mapInArrow(run, schema), "chunks", rows=FILE_CHUNKS)


def pack(names: np.ndarray, width: int) -> bytes:
    """Sorted, different numbers as the first and the differences, ``width`` bytes each; a width that is too small is raised."""
    if not len(names):
        return b""
    gaps = np.diff(names)
    width = max(width, (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 1)
    return bytes([width]) + int(names[0]).to_bytes(8, "little") + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, U64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw) + 1, 8), np.uint8)
    out[1:, :width] = raw
    out[0] = np.frombuffer(blob[1:9], np.uint8)
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


def ranges(names: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, names / RANGE_NAMES))))


def sent(chunk: int, names: np.ndarray, bits: int, parts: int, width: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """(span, chunk, names, extra): a row for each range that sorted ``names`` of so many bits fall in. ``extra`` has a row of bytes for each name."""
    ends = np.searchsorted(names, np.arange(1, parts, dtype=U64) << U64(bits - parts.bit_length() + 1)) if parts > 1 else np.empty(0, np.int64)
    cut = [0, *ends.tolist(), len(names)]
    rows = [(r, a, b) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([pack(names[a:b], width) for _, a, b in rows], pa.binary()),
            pa.array([extra[a:b].tobytes() if extra is not None else b"" for _, a, b in rows], pa.binary()),
        ],
        ["span", "chunk", "names", "extra"],
    )


SENT = "span int, chunk long, names binary, extra binary"
Answer = Callable[[np.ndarray, list[int], np.ndarray | None], list[bytes]]


def ask(rows: DataFrame, answer: Answer) -> DataFrame:
    """(chunk, answer): for each chunk array<struct<span, n, told>> in the order of its names.

    ``answer`` takes a range's names, chunk after chunk in the order of chunks, the
    number of each chunk and all extra bytes, and gives the bytes for each chunk.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        names = [unpack(b) for b in group.column("names").to_pylist()]
        extra = np.frombuffer(b"".join(group.column("extra").to_pylist()), np.uint8)
        sizes = [len(x) for x in names]
        told = answer(np.concatenate(names), sizes, extra if len(extra) else None)
        return pa.table([group.column("span"), group.column("chunk"), pa.array(sizes, pa.int64()), pa.array(told, pa.binary())], ["span", "chunk", "n", "told"])

    out = rows.groupBy("span").applyInArrow(run, "span int, chunk long, n long, told binary")
    return out.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("span", "n", "told"))).alias("answer"))


def met(names: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, group): the places of names whose first bits occur more than once, name by name, in the order they were sent; names that are equal in all bytes have one group number."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    places = order[twice]
    if extra is not None and len(places):
        wide = extra.reshape(len(names), -1)[places]
        places = places[np.lexsort((*wide.T, names[places]))]  # a stable sort: what was sent first stays first
        wide = extra.reshape(len(names), -1)[places]
        fresh = np.concatenate([[True], (names[places][1:] != names[places][:-1]) | (wide[1:] != wide[:-1]).any(axis=1)])
    else:
        fresh = np.concatenate([[True], names[places][1:] != names[places][:-1]])[: len(places)]
    return places, np.cumsum(fresh) - 1


def repeated(earlier: bool) -> Answer:
    """A bit for each name: another chunk (``earlier``: a smaller one) sent it too."""

    def answer(names: np.ndarray, sizes: list[int], extra: np.ndarray | None) -> list[bytes]:
        places, group = met(names, extra)
        hit = np.zeros(len(names), bool)
        if len(places):
            hit[places] = np.concatenate([[False], group[1:] == group[:-1]]) if earlier else np.bincount(group)[group] > 1
        return [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]

    return answer


def bits_of(answer) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a["told"], np.uint8), count=a["n"]).astype(bool) for a in (answer or [])]
    return np.concatenate([np.empty(0, bool), *parts])


def numbers_of(answer, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(a["told"], dtype) for a in (answer or []))])
