"""Near-duplicate passages of different documents, by compact windows.

A document is the sequence of its five-word shingles, and a passage has 50 words
(46 shingles) or more. For each of ``FUNCTIONS`` hash functions the Cartesian
tree over a document's shingle hashes gives its compact windows: all
subsequences that contain the place c and stay between l and r have the hash of
c as their least one. Only windows of 46 shingles or more can hold a passage, and
their number is about 2n / 46 per function.

1. Documents with one text are one class from the start, and the least doc_id
   stands for it. Which shingles another text has is asked by ``names.ask``. Texts
   leave that can't have a passage, whatever the other text (``hopeful``), and
   windows whose least shingle no other text has.
2. Each text is verified with the least one of the groups of its windows, where it
   is that in ENOUGH functions: a check per text and group, in hot groups too.
   Classes form. A group that is of one class is settled. All others go on.
3. An interval join inside each document brings windows of two functions
   together that overlap in 46 shingles or more: a passage that both agree in lies
   in the overlap. The two hashes are the overlap's signature. A text agrees in two
   of four functions with a passage at a similarity of 0.8 with a probability of
   0.973, and with an exact copy always.
4. Each text is verified with the least one of its signatures' groups, as before,
   and in groups that are then not settled all overlaps meet those of the other
   classes: in groups with few pairs of two classes (``WIDE``) as pairs of whole
   texts, each pair once for all its groups, in others block against block, where
   those leave that can't have a passage with another class, and a product of
   matrices leaves only pairs with enough shingles in common. Groups that one class
   has half of, or more, meet as one for each such class, with what their overlaps
   span in a text: a large class of near copies has hundreds of them with the same
   texts. Others meet on the overlaps. Nothing is left unchecked, so no link
   between classes is lost.

Verification chains shingles that both sides hold into passages, and a pair of
passages counts if it has 50 words on both sides and a Jaccard similarity of
shingles of 0.8 or more.

Result, a row per document: class_id, the least doc_id that passages connect it
with (its own, if none); class_size, the documents of its class; n_words;
n_repeated and spans, the words (first:end, end exclusive) that lie in passages
verified with another document, that is with the least one of a group at least;
n_later, those of them that an earlier document was verified to have. A copy of an earlier text of 50 words or more is a passage
as a whole; shorter texts are in no class but their own.

Defined cases: a null text is empty; texts under 50 words have no passages; rows
that repeat a doc_id are one document (the text with the least MD5); rows without
doc_id are left out; repeats inside one document are no links; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from . import names as nm
from .links import components
from .shared import U64, Scratch, buffers, content_key, mix, shingles, table, text_of

WIDTH, WORDS, LEAST = 5, 50, 0.8
SHORTEST = WORDS - WIDTH + 1
FUNCTIONS, ENOUGH = 4, 2
BITS = 48
#: Groups whose pairs of two classes are WIDE / 2 for each of their texts at most meet as pairs, others block against block.
WIDE = 4
#: Texts of a block that meets others.
MEETING = 256
#: Shingles that may be missing between two common ones of a passage, before it is looked at as two.
GAP = 12


def compact_windows(hashes: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r): the windows of ``shortest`` places or more, of all texts end to end; equal hashes: the leftmost is the least.

    The place of a window that wide is the least of some stretch of ``shortest``
    places, and so are the places that bound it. So the tree is built over those.
    """
    bits = max(1, int(len(hashes)).bit_length())
    # the place in the low bits: a running minimum then tells where it is, and the leftmost of equals wins
    low = (hashes >> U64(bits) << U64(bits)) | np.arange(len(hashes), dtype=U64)
    width, least = 1, low
    while 2 * width <= shortest:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = shortest - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest and len(least) > rest else least[: max(0, len(least) - rest)]
    size = np.diff(first)
    whole = np.repeat(np.arange(len(size)), np.maximum(size - shortest + 1, 0))
    if not len(whole):
        none = np.empty(0, np.int64)
        return none, none, none
    begin = np.arange(len(whole)) - (np.cumsum(np.maximum(size - shortest + 1, 0)) - np.maximum(size - shortest + 1, 0))[whole] + first[whole]
    place = (least[begin] & U64((1 << bits) - 1)).astype(np.int64)
    fresh = np.concatenate([[True], place[1:] != place[:-1]])
    place, doc = place[fresh], whole[fresh]
    value = low[place].tolist()
    left, right = first[doc].tolist(), (first[doc + 1] - 1).tolist()
    places, docs, stack, now = place.tolist(), doc.tolist(), [], -1
    for i, (v, d) in enumerate(zip(value, docs, strict=True)):
        if d != now:
            stack, now = [], d
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return place, np.array(left), np.array(right)


def _function(hashes: np.ndarray, k: int) -> np.ndarray:
    return mix(hashes ^ U64((0xA0761D6478BD642F * (2 * k + 1)) % (1 << 64)))


def hopeful(shared: np.ndarray, again: np.ndarray, first: np.ndarray, cost: int = 4) -> np.ndarray:
    """Which of the texts, end to end, can have a passage at all: ``shared`` tells places whose shingle another text has too, ``again`` those that repeat one of their text.

    A passage begins and ends with shared places, and of its different shingles four are in the other passage for
    each one that isn't. So where a shared place counts 1, and one that is the first of its shingle and not shared -``cost``
    of 4, its places have a sum of 0 at least.
    """
    n, texts = len(shared), len(first) - 1
    count = np.diff(first)
    # a running sum of each text, with its 0 in front; each text lies below all earlier ones, so that no place meets another text's
    text = np.repeat(np.arange(texts), count + 1)
    slot = np.arange(n) + np.repeat(np.arange(texts), count)
    far = 2 * (cost + 1) * (n + 1)
    upto = np.zeros(n + texts, np.int64)
    upto[slot + 1] = np.where(shared, 1, np.where(again, 0, -cost))
    upto = np.cumsum(upto)
    upto -= upto[first[:-1] + np.arange(texts)][text] + text * far
    slot = slot[shared]
    begin = np.full(n + texts, far)
    begin[slot] = upto[slot]
    ends = slot[slot + 1 >= SHORTEST] + 1
    out = np.zeros(texts, bool)
    out[text[ends[upto[ends] >= np.minimum.accumulate(begin)[ends - SHORTEST]]]] = True
    return out


class Texts:
    """The shingles of a chunk's texts end to end, and their different names."""

    def __init__(self, texts: pa.Array):
        self.hashes, self.first, _, _ = shingles(*buffers(texts), WIDTH)
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        order = np.argsort(self.hashes, kind="stable")
        ordered, text = self.hashes[order] >> U64(64 - BITS), text[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        own = fresh | np.concatenate([[True], text[1:] != text[:-1]])[: len(ordered)]
        group = np.cumsum(fresh) - 1
        self.names = ordered[fresh]
        #: whether several texts of this chunk have the name
        self.several = np.bincount(group, own, len(self.names)) > 1
        self.group, self.again = np.empty(len(order), np.int64), np.empty(len(order), bool)
        self.group[order], self.again[order] = group, ~own


class Windows:
    """The compact windows of texts whose least shingle is ``shared``, by function: names, and first and last place with the texts end to end."""

    def __init__(self, hashes: np.ndarray, shared: np.ndarray, first: np.ndarray):
        self.first = first
        self.names, self.left, self.right = [], [], []
        for k in range(FUNCTIONS):
            c, left, right = compact_windows(_function(hashes, k), first)
            order = np.lexsort((-right, left))
            c, left, right = c[order], left[order], right[order]
            # where a hash occurs again, the window of its first place holds those of the others
            parent = _parents(right)
            kept = ((parent < 0) | (hashes[c][parent] != hashes[c])) & shared[c]
            self.names.append(mix(hashes[c[kept]] + U64(k + 1)) >> U64(64 - BITS))
            self.left.append(left[kept])
            self.right.append(right[kept])

    @classmethod
    def of(cls, lists: pa.Array) -> Windows:
        """Those in rows of list<struct<fn, name, first, last>>, a text's each."""
        self, x = cls.__new__(cls), lists.values
        fn, names, first, last = (x.field(c).to_numpy() for c in ("fn", "name", "first", "last"))
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        size = np.zeros(len(lists), np.int64)
        np.maximum.at(size, text, last.astype(np.int64) + 1)
        self.first = np.concatenate([[0], np.cumsum(size)])
        left, right = self.first[text] + first, self.first[text] + last
        self.names, self.left, self.right = [], [], []
        for k in range(FUNCTIONS):
            own = np.flatnonzero(fn == k)
            own = own[np.lexsort((-right[own], left[own]))]
            self.names.append(names[own].view(U64))
            self.left.append(left[own])
            self.right.append(right[own])
        return self

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, first place, last place) of all overlaps of SHORTEST places or more of windows of two functions."""
        parents = [_parents(right) for right in self.right]
        out = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for f in range(FUNCTIONS):
            for g in range(f + 1, FUNCTIONS):
                # each pair once: the later begin is a place that the other window holds
                later, over = _covering(self.left[f], self.right[f], parents[f], self.left[g], "right")
                early, under = _covering(self.left[g], self.right[g], parents[g], self.left[f], "left")
                i, j = np.concatenate([over, early]), np.concatenate([later, under])
                key = mix(self.names[f][i] * U64(0x9E3779B97F4A7C15) + mix(self.names[g][j] + U64(FUNCTIONS * f + g)))
                out.append((key, np.maximum(self.left[f][i], self.left[g][j]), np.minimum(self.right[f][i], self.right[g][j])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parents(right: np.ndarray) -> np.ndarray:
    """The least window that holds each one; windows of one function are nested or apart, and sorted by begin, the wider first."""
    out, stack, ends = [], [], right.tolist()
    for i, r in enumerate(ends):
        while stack and ends[stack[-1]] < r:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return np.array(out, np.int64)


def _covering(left: np.ndarray, right: np.ndarray, parent: np.ndarray, places: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """(place number, window) for all windows that hold the SHORTEST places from each of ``places`` on; ``side`` left: and begin before."""
    query, now, found = np.arange(len(places)), np.searchsorted(left, places, side=side) - 1, [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while len(query := query[now >= 0]):
        now = now[now >= 0]
        fits = right[now] >= places[query] + SHORTEST - 1
        found.append((query[fits], now[fits]))
        now = parent[now]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_HELD = "name long, id long, fn byte, first int, last int, shingles binary"


def shared_windows(chunks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(name, id, fn, first, last, head), the windows that another text has too, where places are shingles of the document; and (id, shingles), 32 bits of each of the shingles of their documents, end to end."""
    size = chunks.agg(F.sum(F.expr("aggregate(texts, 0L, (a, t) -> a + octet_length(t))")).alias("n")).first().n or 0
    parts = nm.ranges(size / 5)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, _, _, _ = shingles(*buffers(batch.column("texts")[i].values), WIDTH)
                yield nm.sent(batch.column("chunk")[i].as_py(), np.unique(hashes >> U64(64 - BITS)), BITS, parts, 4)

    told = scratch.save(nm.ask(chunks.select("chunk", "texts").mapInArrow(send, nm.SENT), nm.repeated(False)), "told", rows=nm.FILE_CHUNKS)

    def keep(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts, ids = Texts(batch.column("texts")[i].values), batch.column("ids")[i].values.to_numpy()
                shared = (texts.several | nm.bits_of(batch.column("answer")[i].as_py()))[texts.group]
                held = np.flatnonzero(hopeful(shared, texts.again, texts.first))
                if not len(held):
                    continue
                begin, size = texts.first[held], np.diff(texts.first)[held]
                first = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(first[-1]) + np.repeat(begin - first[:-1], size)
                windows, ids = Windows(texts.hashes[place], shared[place], first), ids[held]
                columns = []
                for k in range(FUNCTIONS):
                    at = windows.text_of(windows.left[k])
                    columns.append((windows.names[k].view(np.int64), ids[at], np.full(len(at), k, np.int8), *((x[k] - first[at]).astype(np.int32) for x in (windows.left, windows.right))))
                columns = [pa.array(np.concatenate(x)) for x in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], ["name", "id", "fn", "first", "last", "shingles"])
                low = (texts.hashes[place] >> U64(32)).astype("<u4")
                low = [low[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                none = [pa.nulls(len(held), t) for t in (pa.int64(), pa.int8(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(ids), *none[1:], pa.array(low, pa.binary())], ["name", "id", "fn", "first", "last", "shingles"])

    kept = scratch.save(chunks.join(told.hint("shuffle_hash"), "chunk", "left").select("ids", "texts", "answer").mapInArrow(keep, _HELD), "kept")
    windows = _with_heads(kept.where("name is not null").drop("shingles"), scratch, "windows")
    known = kept.where("shingles is not null").select("id", "shingles").join(windows.select("id").distinct(), "id", "left_semi")
    return windows, scratch.save(known, "shingled")


def _with_heads(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (name, id, ...) of groups of several texts, with the least of them, ``head``."""
    groups = rows.groupBy("name").agg(F.min("id").alias("head"), F.max("id").alias("high")).where("head < high").select("name", "head")
    return scratch.save(rows.join(groups, "name"), name)


def overlaps(windows: DataFrame) -> DataFrame:
    """(name, id, first, last): the overlaps of windows of two functions, by signature."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = pa.concat_arrays([part.column("held")])
                of = Windows.of(held if not held.offset else held.take(pa.array(range(len(held)))))
                sig, first, last = of.overlaps()
                text = of.text_of(first)
                begin = of.first[text]
                columns = [pa.array(sig.view(np.int64)), part.column("id").take(pa.array(text)), pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "id", "first", "last"])

    lists = windows.groupBy("id").agg(F.collect_list(F.struct("fn", "name", "first", "last")).alias("held"))  # of one document, so bounded
    return lists.select("id", "held").mapInArrow(run, "name long, id long, first int, last int")


def unsettled(rows: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The groups of ``rows`` that hold several classes, with each row's class, ``label``."""
    labels = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch, f"{name}-classes")
    inside = rows.drop("head").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    groups = inside.groupBy("name").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("name")
    return scratch.save(inside.join(groups, "name"), name)


def _runs(a: np.ndarray, b: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """(first and last place in ``a``, place in ``b`` less that in ``a``) of all maximal runs of equal shingles, in order of the first."""
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    lo, hi = np.searchsorted(sorted_b, a, side="left"), np.searchsorted(sorted_b, a, side="right")
    hits = np.flatnonzero(hi > lo)
    upto = np.concatenate([[0], np.cumsum((hi - lo)[hits])])
    wide, starts, ends, at = len(a) + 1, [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(hits):  # ``most`` matches at a time, whatever the number of repeats
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        part, count = hits[at:to], np.diff(upto[at : to + 1])
        i = np.repeat(part, count)
        place = order[np.repeat(lo[part], count) + np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], count)]
        key = np.sort((place - i + len(a)) * wide + i)
        new = np.flatnonzero(np.diff(key) != 1)
        starts.append(key[np.concatenate([[0], new + 1])])
        ends.append(key[np.concatenate([new, [len(key) - 1]])])
        at = to
    start, end = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(start)
    start, end = start[by], end[by]
    fresh = np.concatenate([[True], start[1:] != end[:-1] + 1])[: len(start)]
    start, end = start[fresh], end[np.concatenate([fresh[1:], [True]])[: len(end)]]
    out = np.stack([start % wide, end % wide, start // wide - len(a)], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Union:
    """Intervals that are apart, in order; those added that overlap or touch at an end become one."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []

    def holds(self, first: int, last: int) -> bool:
        at = bisect_right(self.first, first) - 1
        return at >= 0 and last <= self.last[at]

    def add(self, first: int, last: int) -> None:
        low, high = bisect_left(self.last, first), bisect_right(self.first, last)
        if low < high:
            first, last = min(first, self.first[low]), max(last, self.last[high - 1])
        self.first[low:high], self.last[low:high] = [first], [last]


def _again(x: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """Which places repeat a shingle of ``x``; none, if all are different. ``order`` sorts ``x`` and keeps the order of equals."""
    ordered = x[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return None
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    return out


def _repeats(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    again = _again(x, order)
    return np.zeros(len(x), bool) if again is None else again


def _worthwhile(hit: np.ndarray, again: np.ndarray | None, cost: int) -> bool:
    """Whether SHORTEST or more places in a row, the first and the last in common with the other sequence, have ``cost`` shingles in common for each different one that is not."""
    upto = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(np.where(hit, 1, -cost if again is None else np.where(again, 0, -cost)), out=upto[1:])
    ends = np.flatnonzero(hit[SHORTEST - 1 :]) + SHORTEST
    return bool((upto[ends] >= np.minimum.accumulate(np.where(hit, upto[:-1], len(hit) + 1))[ends - SHORTEST]).any())


def promising(hit_a: np.ndarray, again_a: np.ndarray | None, hit_b: np.ndarray, again_b: np.ndarray | None) -> bool:
    """Whether two sequences can have a pair of passages: where c different shingles are in both, c / 4 at most are in one only, so c / 8 on one side."""
    least = 2 * SHORTEST * LEAST / (1 + LEAST) - 1e-6
    if again_a is None and again_b is None and np.count_nonzero(hit_a) < least:
        return False
    if not (_worthwhile(hit_a, again_a, 4) and _worthwhile(hit_b, again_b, 4)):
        return False
    return _worthwhile(hit_a, again_a, 8) or _worthwhile(hit_b, again_b, 8)


def all_promising(one: np.ndarray, again: np.ndarray, others: list[np.ndarray], others_again: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` can have a passage with ``one``, as ``promising`` tells of two; shingles are small numbers."""
    flat, flat_again, size = np.concatenate(others), np.concatenate(others_again), [len(x) for x in others]
    first, row = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(others)), size)
    names, mine = np.unique(one, return_inverse=True)
    at = np.full(max(int(flat.max()), int(one.max())) + 1, -1)
    at[names] = np.arange(len(names))
    at = at[flat]
    hit = at >= 0
    out = hopeful(hit, flat_again, first)
    holds = np.zeros((len(others), len(names)), bool)
    holds[row[hit], at[hit]] = True
    ours, left = np.flatnonzero(out), np.zeros(len(others), bool)
    if not len(ours):
        return out
    ours_hit, ours_again, ours_first = holds[ours][:, mine].ravel(), np.tile(again, len(ours)), np.arange(len(ours) + 1) * len(one)
    left[ours] = hopeful(ours_hit, ours_again, ours_first, 8)
    out[ours] = hopeful(ours_hit, ours_again, ours_first)
    return out & (left | hopeful(hit, flat_again, first, 8))


def _long_enough(runs: np.ndarray) -> np.ndarray:
    """Those of ``runs`` that lie among others, near enough to go on from each other, that reach over SHORTEST places on both sides."""
    first, last, off = runs.T
    by = np.argsort(off, kind="stable")
    band = np.empty(len(runs), np.int64)
    band[by] = np.cumsum(np.concatenate([[0], np.diff(off[by]) > GAP + 1]))
    by = np.lexsort((first, band))
    move = band[by] * (last.max() + GAP + 2)
    upto = np.maximum.accumulate(last[by] + move)
    starts = np.flatnonzero(np.concatenate([[True], first[by][1:] + move[1:] > upto[:-1] + GAP]))
    reach = [np.maximum.reduceat(y[by], starts) - np.minimum.reduceat(x[by], starts) + 1 for x, y in ((first, last), (first + off, last + off))]
    kept = np.empty(len(runs), bool)
    kept[by] = np.repeat((reach[0] >= SHORTEST) & (reach[1] >= SHORTEST), np.diff(np.concatenate([starts, [len(runs)]])))
    return runs[kept]


def _chained(first: list[int], last: list[int], off: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """For each run, the one that it goes on from (-1, if none) and the last place of that which it takes; and whether no other goes on from all of it."""
    n = len(first)
    score, before, leave, ended = [j - i + 1 for i, j in zip(first, last, strict=True)], [-1] * n, [0] * n, [True] * n
    by: dict[int, list[int]] = {}
    for t, (i, d) in enumerate(zip(first, off, strict=True)):
        best, found, at = 0, -1, 0
        for e in range(d - GAP - 1, d + GAP + 2):
            for k in reversed(by.get(e, ())):  # runs of a diagonal are apart and in order
                if last[k] < i - GAP:
                    break
                # the last shingle of it that lies before this run on both sides
                x = min(last[k], i - 1, i + d - 1 - e)
                if x >= first[k] and x >= i - GAP and x >= i + d - GAP - 1 - e:
                    behind = score[k] - (last[k] - x)
                    if found < 0 or behind > best or (behind == best and off[found] == e):
                        best, found, at = behind, k, x
        if found >= 0:
            score[t] += best
            before[t], leave[t] = found, at
            ended[found] = ended[found] and at < last[found]
        by.setdefault(d, []).append(t)
    return before, leave, ended


def passages(a: np.ndarray, b: np.ndarray, new: bool = False) -> list[tuple[int, int, int, int]]:
    """Maximal pairs of passages (first and last shingle in ``a`` and in ``b``) of two sequences of hashes, in both SHORTEST long and alike enough.

    Each run of equal shingles goes on from the run before it that has the most
    behind it, if no more than GAP shingles are missing between them on either
    side. A run may serve several, so each of the places of a repeat has its chain.
    ``new`` leaves out pairs both sides of which others cover already.
    """
    if len(a) < SHORTEST or len(b) < SHORTEST:
        return []
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    again_a, again_b = _again(a, order_a), _again(b, order_b)
    plain, ordered = again_a is None and again_b is None, b[order_b]
    at = np.searchsorted(ordered, a)
    at[at == len(b)] = 0
    hit = ordered[at] == a
    if plain:
        i = np.flatnonzero(hit)
        place, other = np.full(len(a), -1), np.zeros(len(b), bool)
        place[i] = order_b[at[i]]
        other[place[i]] = True
    else:
        ordered = a[order_a]
        at = np.searchsorted(ordered, b)
        at[at == len(a)] = 0
        other = ordered[at] == b
    if not promising(hit, again_a, other, again_b):
        return []
    if plain:
        off = place[i] - i
        new_run = np.flatnonzero((np.diff(i) != 1) | (np.diff(off) != 0)) + 1
        start, end = np.concatenate([[0], new_run]), np.concatenate([new_run - 1, [len(i) - 1]])
        runs = np.stack([i[start], i[end], off[start]], axis=1) if len(i) else np.empty((0, 3), np.int64)
    else:
        runs = _runs(a, b)
    if len(runs) > 4:
        runs = _long_enough(runs)
    first, last, off = runs[:, 0].tolist(), runs[:, 1].tolist(), runs[:, 2].tolist()
    before, leave, ended = _chained(first, last, off)
    todo = []
    for t in [t for t, x in enumerate(ended) if x]:
        chain, end = [], last[t]
        while t >= 0:
            chain.append((first[t], end, first[t] + off[t], end + off[t]))
            t, end = before[t], leave[t]
        todo.append(chain[::-1])
    if new:
        todo.sort(key=lambda c: c[-1][1] - c[0][0])
    out, ours, theirs = set(), Union(), Union()
    while todo:
        chain = todo.pop()
        i, p, j, q = chain[0][0], chain[0][2], chain[-1][1], chain[-1][3]
        if j - i + 1 < SHORTEST or q - p + 1 < SHORTEST:
            continue
        if new and ours.holds(i, j) and theirs.holds(p, q):
            continue
        if len(chain) > 1 and plain:
            one, two = j - i + 1, q - p + 1
            both = int(np.count_nonzero((place[i : j + 1] >= p) & (place[i : j + 1] <= q)))
        elif len(chain) > 1:
            sets = np.unique(a[i : j + 1]), np.unique(b[p : q + 1])
            one, two, both = len(sets[0]), len(sets[1]), len(np.intersect1d(*sets, assume_unique=True))
        if len(chain) == 1 or both >= LEAST * (one + two - both):
            out.add((i, j, p, q))
            ours.add(i, j)
            theirs.add(p, q)
            continue
        gaps = [(y[0] - x[1]) + (y[2] - x[3]) for x, y in zip(chain[:-1], chain[1:], strict=True)]
        cut = int(np.argmax(gaps)) + 1
        todo += [chain[:cut], chain[cut:]]
    return sorted(out)


def _verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, other, first, end): word spans of passages of the pairs (a, b), once from each side."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, one, two in zip(*(batch.column(c) for c in ("a", "b", "one", "two")), strict=True):
                got = passages(np.frombuffer(one.as_buffer(), "<u4"), np.frombuffer(two.as_buffer(), "<u4"), new=True)
                for x, y, side in ((a, b, [g[:2] for g in got]), (b, a, [g[2:] for g in got])):
                    spans = Union()
                    for i, j in side:
                        spans.add(i, j + WIDTH)
                    rows += [(x.as_py(), y.as_py(), i, j) for i, j in zip(spans.first, spans.last, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "other", "first", "end"])

    one, two = (known.select(F.col("id").alias(c), F.col("shingles").alias(n)).hint("merge") for c, n in (("a", "one"), ("b", "two")))
    # many texts have one head ``b``: the work is dealt by ``a``
    return pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(run, "id long, other long, first long, end long")


def _regions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (name, id, label, first, last, side, inside, meeting) with the overlap's shingles, ``part``."""
    few = ("name", "label", "first", "side", "inside", "meeting")
    lists = rows.groupBy("id").agg(F.collect_list(F.struct(*few, "last")).alias("asked"))  # of one document, so bounded

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, hashes = batch.column("asked")[i].values, np.frombuffer(batch.column("shingles")[i].as_buffer(), "<u4")
                for at in range(0, len(asked), 1 << 10):
                    some = asked.slice(at, 1 << 10)
                    first, last = (some.field(c).to_pylist() for c in ("first", "last"))
                    parts = [hashes[a : b + 1].tobytes() for a, b in zip(first, last, strict=True)]
                    ids = pa.array(np.full(len(parts), batch.column("id")[i].as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(some.field(c) for c in few), pa.array(parts, pa.binary())], ["id", *few, "part"])

    schema = "id long, name long, label long, first int, side int, inside boolean, meeting long, part binary"
    return lists.join(known.hint("merge"), "id").select("id", "shingles", "asked").mapInArrow(run, schema)


def common(parts: list[np.ndarray], one: np.ndarray, two: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many different shingles each of the parts ``one`` has in common with each of the parts ``two``, as a product of matrices."""
    sets = [np.unique(x) for x in parts]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = count[element] > 1
    order = np.argsort(element[kept], kind="stable")
    row, column = row[kept][order], np.unique(element[kept][order], return_inverse=True)[1]
    out, wide, at, columns = np.zeros((len(one), len(two)), np.float32), max(1, most // max(1, len(sets))), 0, int(column[-1]) + 1 if len(column) else 0
    for first in range(0, columns, wide):
        to = int(np.searchsorted(column, first + wide))
        dense = np.zeros((len(sets), min(wide, columns - first)), np.float32)
        dense[row[at:to], column[at:to] - first] = 1
        out += dense[one] @ dense[two].T
        at = to
    return out


def among_labels(parts: list[np.ndarray], labels: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which of the parts can have a passage, if only shingles count that another label has too, and if there are two sides, the other side."""
    size = np.array([len(x) for x in parts])
    row, flat = np.repeat(np.arange(len(parts)), size), np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    fresh = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    starts, row = np.flatnonzero(fresh), row[order]
    several = np.ones(len(starts), bool)
    for x in (labels, side) if side.any() else (labels,):
        several &= np.minimum.reduceat(x[row], starts) < np.maximum.reduceat(x[row], starts)
    shared, again = np.empty(len(flat), bool), np.zeros(len(flat), bool)
    shared[order] = several[np.cumsum(fresh) - 1]
    again[order[1:]] = ~fresh[1:] & (row[1:] == row[:-1])
    return hopeful(shared, again, np.concatenate([[0], np.cumsum(size)]))


def least_different(part: np.ndarray) -> int:
    """A bound on how few different shingles SHORTEST places of ``part`` hold: those that don't occur within that many places before."""
    order = np.argsort(part, kind="stable")
    near = (part[order][1:] == part[order][:-1]) & (np.diff(order) < SHORTEST)
    again = np.zeros(len(part) + 1, np.int64)
    again[order[1:][near] + 1] = 1
    upto = np.cumsum(again)
    return max(1, SHORTEST - int((upto[SHORTEST:] - upto[:-SHORTEST]).max(initial=0)))


def _tie(group: pa.Table, inside: bool) -> pa.Table:
    """The passages (id, other, first, end), once from each side, that tie labels of two blocks, or of one, that none before has tied."""
    ids, labels, side, begin = (group.column(c).to_numpy() for c in ("id", "label", "side", "first"))
    parts = [np.frombuffer(x.as_py(), "<u4") for x in group.column("part")]
    kept = np.flatnonzero(among_labels(parts, labels, side))
    ids, labels, side, begin, parts = ids[kept], labels[kept], side[kept], begin[kept], [parts[k] for k in kept.tolist()]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if inside else 1))
    if not len(one) or not len(two):
        return pa.table([pa.array([], pa.int64())] * 4, ["id", "other", "first", "end"])
    # of sets of m and n at a similarity of LEAST or more, (m + n) LEAST / (1 + LEAST) are in both
    least = LEAST / (1 + LEAST) * np.array([least_different(x) for x in parts])
    both = common(parts, one, two)
    fits = both >= least[one][:, None] + least[two][None, :] - 1e-3
    fits &= ids[one][:, None] != ids[two][None, :]
    root, rows = np.unique(labels, return_inverse=True)[1], []
    size = np.array([len(p) for p in parts])
    code = np.split(np.unique(np.concatenate(parts), return_inverse=True)[1], np.cumsum(size)[:-1])
    again = [_repeats(c) for c in code]
    for i, x in enumerate(one.tolist()):
        far = np.flatnonzero(fits[i] & (root[two] != root[x]))
        if len(far) > 4:
            other = two[far].tolist()
            out = far[~all_promising(code[x], again[x], [code[y] for y in other], [again[y] for y in other])]
            fits[i, out] = False
            if inside:
                fits[out, i] = False
        while len(far := np.flatnonzero(fits[i] & (root[two] != root[x]))):
            j = far[np.argmax(both[i, far])]
            y = int(two[j])
            fits[i, j] = False
            if inside:
                fits[j, i] = False
            for a, b, p, q in passages(parts[x], parts[y], new=True):
                rows += [(ids[x], ids[y], begin[x] + a, begin[x] + b + WIDTH), (ids[y], ids[x], begin[y] + p, begin[y] + q + WIDTH)]
                root[root == root[y]] = root[x]
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["id", "other", "first", "end"])


def verified(windows: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, other, first, end): passages verified, once from each side."""
    star = windows.where("id > head").groupBy("id", "head").agg(F.min("fn").alias("low"), F.max("fn").alias("high")).where("low < high")
    star = scratch.save(star.select(F.col("id").alias("a"), F.col("head").alias("b")), "star-1")
    found = scratch.save(_verify(star, known), "found-1")
    signed = _with_heads(scratch.save(overlaps(unsettled(windows, found, scratch, "left-1")), "overlaps"), scratch, "signatures")
    scratch.drop("overlaps")
    again = signed.where("id > head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    again = scratch.save(again, "star-2")
    found = scratch.save(found.unionByName(_verify(again, known)), "found-2")
    left = unsettled(signed, found, scratch, "left-2")
    each = scratch.save(left.select("name", "id", "label").distinct(), "members-2")
    one_label = each.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    cells = one_label.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("alike"), F.max(F.struct("n", "label")).alias("top"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
    # n * n - alike is twice the number of pairs of two classes
    few_pairs = F.col("n") * F.col("n") - F.col("alike") <= WIDE * F.least("n", F.lit(blocks.ROWS))
    cells = cells.select("name", "x", "y", "n", F.col("top.label").alias("top"), few_pairs.alias("few"), (2 * F.col("top.n") >= F.col("n")).alias("held"))
    cells = scratch.save(cells, "cells-2")
    # groups of the same texts have the same pairs
    few = each.join(cells.where("few").groupBy("n", "x", "y").agg(F.min(F.struct("name", "top")).alias("g")).select("g.name", "g.top"), "name")
    # each such pair has one at least that is not of the largest class, so no more than these meet
    met = few.where("label <> top").select("name", "label", F.col("id").alias("x")).join(few.select("name", F.col("label").alias("label_2"), F.col("id").alias("y")), "name").where("label <> label_2")
    pairs = met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(star.unionByName(again), ["a", "b"], "left_anti")
    more = scratch.save(_verify(pairs, known), "found-3")
    many = left.join(cells.where("not few").select("name", "held", "top"), "name")
    # each text once for all groups that the same class has half of
    held = many.where("held").groupBy(F.xxhash64("top").alias("name"), "id", "label").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    many = many.where("not held").select(held.columns).unionByName(held).withColumn("size", 4 * (F.col("last") - F.col("first")))
    wide = _regions(blocks.deal(many, ["name"], ["first", "last"], MEETING), known)
    rest = scratch.save(blocks.meet(wide, ["name"], _tie, "id long, other long, first long, end long"), "found-4")
    return scratch.save(found.unionByName(more).unionByName(rest).distinct(), "found")


def repeated_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each doc_id: class_id, class_size, n_words, n_repeated, n_later, spans (array<struct<first, end>>)."""
    words = F.size(F.filter(F.split(text_of(), "[\\x00-\\x20]+"), lambda w: w != "")).cast("long")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), content_key().alias("key"), text_of().alias("text"))
    every = rows.select("id", "key", words.alias("n_words")).groupBy("id").agg(F.min(F.struct("key", "n_words")).alias("x")).select("id", "x.*")
    members = scratch.save(every, "members")
    # the least document stands for all with its text
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    long = heads.join(members.select("key", "n_words", F.col("id").alias("head")), ["key", "head"]).where(F.col("n_words") >= WORDS)
    members = scratch.save(members.join(heads, "key"), "headed")
    texts = rows.join(long.select("key", F.col("head").alias("id")), ["id", "key"], "left_semi").select("id", "text").dropDuplicates(["id"])
    windows, known = shared_windows(nm.make_chunks(texts, ["id", "text"], scratch), scratch)
    for name in ("chunks", "told", "kept"):
        scratch.drop(name)
    found = verified(windows, known, scratch)
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WORDS)
    ties = members.where(whole & (F.col("id") > F.col("head"))).select(F.col("id").alias("a"), F.col("head").alias("b"))
    classes = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(ties), scratch, "classes")
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    classes = classes.join(sizes, "label").withColumnRenamed("node", "id")
    merged = _merge(found, "id")
    later = _merge(found.where(F.col("other") < F.col("id")), "id").groupBy("id").agg(F.sum(F.col("end") - F.col("first")).alias("n_later"))
    spans = merged.groupBy("id").agg(F.sum(F.col("end") - F.col("first")).alias("n_repeated"), F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    marks = spans.join(later, "id", "left").withColumnRenamed("id", "head")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    copy = F.array(F.struct(zero.alias("first"), F.col("n_words").alias("end")))
    return members.join(marks, "head", "left").join(classes, "id", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("label", "id").alias("class_id"), F.coalesce("class_size", one).alias("class_size"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_repeated", zero)).alias("n_repeated"),
        F.when(F.col("id") > F.col("head"), F.when(whole, F.col("n_words")).otherwise(zero)).otherwise(F.coalesce("n_later", zero)).alias("n_later"),
        F.when(whole, copy).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def _merge(spans: DataFrame, by: str) -> DataFrame:
    """The union of spans: a new run begins where a span starts beyond the largest end so far."""
    order = Window.partitionBy(by).orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("first") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("run")


def query(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string"))), ","))
