"""BPE encoding and decoding with a lexicon of frequent words as a minimal acyclic transducer.

The words that occur most in the whole corpus are compiled, with their ids as
outputs, into an automaton that shares prefixes and suffixes: an arc carries how
many words sort before those it leads to, the sum along a path is the word's
number, and that number finds its ids. Workers map the automaton from a file
into memory and walk it for all words of a part at once. Words that are not in
it are merged exactly, also many at once, by the tokenizer's ranks. So the
lexicon decides the speed alone, never a result.

Only the layout of tokenizer file that this needs is read: added tokens that
are not normalised, NFC + white space + lower case, words by one expression,
byte-level letters, BPE with a word-end suffix, no decoder. Another is refused.

Defined cases: a null text is an empty text; an empty text has no ids and
decodes to an empty text; rows are independent, so repeated ids, clashing
columns and nulls elsewhere change nothing; texts are taken whole, however long.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, slices, table

#: The most words in the lexicon: a bound on what is broadcast, whatever the corpus.
LEXICON_WORDS = 32_768
#: Characters whose class and lower case no version of Unicode changes; texts of others are cut by the library itself.
PLAIN_BELOW = 0x250
LONG_WORD = 40
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for every byte: printable Latin-1 for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Rules:
    """The tokenizer's data, from its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        fits = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel"
            and not level["use_regex"] and not level["add_prefix_space"] and spec["decoder"] is None and model["type"] == "BPE" and model["end_of_word_suffix"]
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and not any(t["normalized"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError("this layout of tokenizer file isn't supported")
        self.text, self.end, self.pattern = text, model["end_of_word_suffix"], split["pattern"]["Regex"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.size = size
        keys = left * size + right
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_RANK where it has none or a side is padding (below 0)."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, merged exactly: always the pair of lowest rank, the leftmost of equals."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        sizes = np.array([len(w) for w in words])
        for top, least in ((8, 0), (14, 8), (22, 14), (LONG_WORD, 22)):
            rows = np.flatnonzero((sizes > least) & (sizes <= top))
            if len(rows):
                self._merge_block([words[i] for i in rows], rows, top, out)
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = self._merge_long(words[i])
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        place = np.arange(width)
        symbols = np.where(place < size[:, None], self.first[raw], -1)
        symbols[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        rank = np.full((n, width), NO_RANK, np.int32)
        rank[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            going = best < NO_RANK
            for row, line, length in zip(rows[~going].tolist(), symbols[~going], size[~going].tolist(), strict=True):
                out[row] = line[:length].copy()
            rows, symbols, rank, size, at, best = rows[going], symbols[going], rank[going], size[going], at[going], best[going]
            if not len(rows):
                break
            every = np.arange(len(rows))
            moved = place + (place > at[:, None])  # the right symbol of the pair goes; those behind it move up
            symbols = np.take_along_axis(symbols, np.minimum(moved, width - 1), 1)
            rank = np.take_along_axis(rank, np.minimum(moved, width - 1), 1)
            size = size - 1
            symbols[every, at] = self.merged[best]
            symbols[every, size] = -1
            rank[every, size] = NO_RANK
            behind = np.where(at + 1 < width, symbols[every, np.minimum(at + 1, width - 1)], -1)
            rank[every, at] = self.rank(symbols[every, at], behind)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.rank(symbols[has, at[has] - 1], symbols[has, at[has]])

    def _merge_long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        symbol = self.first[raw].tolist()
        symbol[-1] = int(self.last[raw[-1]])
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64)).tolist()
        heap = [(r, i, symbol[i], symbol[i + 1]) for i, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.merged[r]), None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    rank = int(self.rank(np.array([symbol[left]]), np.array([symbol[right]]))[0])
                    if rank < NO_RANK:
                        heapq.heappush(heap, (rank, left, symbol[left], symbol[right]))
        return np.array([s for s in symbol if s is not None], np.int32)


class Cutter:
    """The words of a text, as the tokenizer's normaliser and expression cut it; None stands where an added token does."""

    def __init__(self, rules: Rules):
        self.rules = rules
        odd = "".join(c for c in map(chr, range(PLAIN_BELOW)) if c not in "İ\x1c\x1d\x1e\x1f")
        self.plain = re.compile(f"[{re.escape(odd)}]*+").fullmatch
        kind = {c: unicodedata.category(c)[0] for c in odd}
        cls = lambda which: "".join(re.escape(c) for c in odd if which(c))
        letter, number = cls(lambda c: kind[c] == "L"), cls(lambda c: kind[c] == "N")
        space = cls(lambda c: c in "\t\n\v\f\r \x85\xa0")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(rules.added, key=len, reverse=True))) + ")")
        self.bytes_of = {ord(v): k for k, v in byte_letters().items()}
        self.library = None

    def cut(self, text: str) -> list:
        if not any(a in text for a in self.rules.added):
            return self.part(text)
        out: list = []
        for i, piece in enumerate(self.special.split(text)):
            out += [(piece,)] if i % 2 else self.part(piece)
        return out

    def pieces(self, text: str) -> list:
        """Parts that can be cut one by one: what stands between white space, where no rule looks across it."""
        if self.plain(text) and not any(a in text for a in self.rules.added):
            return text.split()
        return self.cut(text)

    def part(self, text: str) -> list[str]:
        if self.plain(text):
            return self.words(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules.text)
        done = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)) if text else []
        return [bytes(self.bytes_of[ord(c)] for c in w).decode("utf-8") for w, _ in done]


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """A minimal acyclic automaton over sorted words, numbering them, and their ids by number, as one block of bytes."""
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict[tuple, int] = {}
    finals: list[int] = []
    arcs: list[tuple] = []
    below: list[int] = []  # words that a state accepts

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in known:
            known[key] = len(arcs)
            finals.append(state[0])
            arcs.append(key[1])
            below.append(state[0] + sum(below[t] for _, t in key[1]))
        return known[key]

    path, last = [[0, []]], b""
    for word in [*(words[i] for i in order), None]:
        shared = 0
        if word is not None:
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
        while len(path) - 1 > shared:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(state)))
        if word is not None:
            path += [[0, []] for _ in range(len(word) - shared)]
            path[-1][0], last = 1, word
    root = settle(path[0])
    key, target, output = [], [], []
    for state, out in enumerate(arcs):
        passed = finals[state]
        for byte, to in out:
            key.append(state * 256 + byte)
            target.append(to)
            output.append(passed)
            passed += below[to]
    sizes = [len(ids[i]) for i in order]
    parts = [np.array([root, len(arcs), len(key), len(order)], np.int64), np.array(key, np.int64), np.array(target, np.int64), np.array(output, np.int64), np.array(finals, np.int64), np.cumsum([0, *sizes], dtype=np.int64), np.concatenate([*(ids[i] for i in order), np.empty(0, np.int32)]).astype(np.int64)]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled automaton, mapped from a file that is unlinked at once (so it goes with the process)."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        all_ = np.frombuffer(self.map, np.int64)
        self.root, states, arcs, words = all_[:4].tolist()
        ends = np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        _, self.key, self.target, self.output, self.final, self.offset = (all_[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
        self.ids = all_[ends[-1] :]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, -1 if it isn't there: one step of all walks at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return out
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        live, state, number, depth = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(live):
            done = size[live] == depth
            here = live[done]
            out[here[self.final[state[here]] == 1]] = number[here[self.final[state[here]] == 1]]
            live = live[~done]
            key = state[live] * 256 + data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            live, at = live[found], at[found]
            state[live] = self.target[at]
            number[live] += self.output[at]
            depth += 1
        return out


class Encoder:
    """Encodes texts; what it has found for a piece is kept until there are ``KEPT`` pieces."""

    KEPT = 500_000

    def __init__(self, rules: Rules, block: bytes):
        self.rules, self.cutter, self.lexicon = rules, Cutter(rules), Lexicon(block)
        self.known: dict = {}

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words: the lexicon's, or else merged."""
        at = self.lexicon.numbers(words)
        unseen = np.flatnonzero(at < 0).tolist()
        out = [self.lexicon.ids[self.lexicon.offset[k] : self.lexicon.offset[k + 1]] if k >= 0 else None for k in at.tolist()]
        for i, ids in zip(unseen, self.rules.merge([words[i] for i in unseen]), strict=True):
            out[i] = ids
        return out

    def learn(self, pieces: set) -> None:
        cut = {p: [p] if isinstance(p, tuple) else self.cutter.cut(p) for p in pieces}
        different = list({w for ws in cut.values() for w in ws})
        plain = [w for w in different if not isinstance(w, tuple)]
        ids = dict(zip(plain, self.words([w.encode("utf-8") for w in plain]), strict=True)) | {w: [self.rules.added[w[0]]] for w in different if isinstance(w, tuple)}
        tokens = self.rules.tokens
        done = {w: (np.asarray(x, "<u4").tobytes(), " ".join([tokens[k] for k in x]).encode("utf-8")) for w, x in ids.items()}
        for p, ws in cut.items():
            self.known[p] = done[ws[0]] if len(ws) == 1 else (b"".join([done[w][0] for w in ws]), b" ".join([done[w][1] for w in ws]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 32 bits) and its decoded text in UTF-8."""
        cut = [self.cutter.pieces(t) if t else [] for t in texts]
        if len(self.known) > self.KEPT:
            self.known.clear()
        self.learn(set().union(*cut) - self.known.keys())
        out = []
        for pieces in cut:
            got = [*map(self.known.__getitem__, pieces)]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])))
        return out


def frequent_words(docs: DataFrame, rules: Rules, most: int = LEXICON_WORDS) -> list[str]:
    """The ``most`` most frequent words of all documents. A task counts before it emits, and leaves out pieces it has met once since it last emitted: they are no frequent words, and a lexicon without one only costs time."""

    def count(batches):
        cutter, seen = Cutter(rules), Counter()

        def emit():
            words = Counter()
            for piece, n in seen.items():
                if n > 1 and not isinstance(piece, tuple):
                    for w in cutter.cut(piece):
                        words[w] += n
            kept = [(w, n) for w, n in words.items() if isinstance(w, str) and len(w) <= LONG_WORD]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, most=1 << 22):
                for text in part.column("text").to_pylist():
                    if text:
                        seen.update(cutter.pieces(text))
                if len(seen) > 400_000:
                    yield emit()
        yield emit()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]  # bounded by ``most``


_held: dict = {}


def encode_documents(docs: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_decoded: bool = True, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``keep`` columns of ``docs`` and n_tokens, ids_sha256, decoded_sha256; ``ids`` and ``decoded`` themselves too if asked for.

    Where ``keep`` holds one of these names, the new column takes an underscore more.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        rules = Rules(f.read())
    words = frequent_words(docs, rules, lexicon_words)
    coded = [w.encode("utf-8") for w in words]
    shipped = spark.sparkContext.broadcast((rules.text, compile_lexicon(coded, rules.merge(coded))))
    keep = tuple(k for k in keep if k in docs.columns)
    types = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_decoded else {})
    names = [*keep, *(free_name(n, list(keep)) for n in types)]
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"`{n}` {t}" for n, t in zip(names[len(keep) :], types.values(), strict=True))])

    def encode(batches):
        text, block = shipped.value
        if _held.get("block") is not block:
            _held.update(encoder=Encoder(Rules(text), block), block=block)
        encoder = _held["encoder"]
        for batch in batches:
            for part in slices(batch, most=1 << 21):
                done = encoder.encode(part.column("text").to_pylist())
                columns = [part.column(k) for k in keep]
                columns += [pa.array([len(i) // 4 for i, _ in done], pa.int64()), pa.array([sha256(i).hexdigest() for i, _ in done]), pa.array([sha256(d).hexdigest() for _, d in done])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<i4") for i, _ in done], pa.list_(pa.int32())))
                if with_decoded:
                    columns.append(pa.array([d.decode("utf-8") for _, d in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, "text").mapInArrow(encode, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False, with_decoded=False)
