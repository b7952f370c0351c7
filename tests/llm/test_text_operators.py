"""Text operators against brute force on small tables, and their odd cases."""

import collections
import math
import pathlib
import re
from hashlib import md5, sha256

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gaugeworks.llm import blocks, bpe_lexicon, line_dedup, names, quality_pu, shared, source_mixing, substring_dedup, suffix_dedup, weighted_minhash
from gaugeworks.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, replica int, score double, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, long), (5, long), (None, "x y z"), (6, long.replace("w15000 ", "other ")), (7, "l1\nl2\nl3\nl4"), (8, "q\nl1\nl2\nl3\nr"), (9, "é" * 60), (10, "é" * 60)]
    return spark.createDataFrame([(i, t, None, None if n % 2 else "s", None, 7, 7, 0.5, "x") for n, (i, t) in enumerate(texts)], ODD)


def test_word_hashes_follow_the_words():
    texts = ["a b  c\nd e f", "", None, "e", "a b c d e", "x" * 50 + " y"]
    s, at, w, first = shared.shingles(*shared.buffers(pa.array(texts)), 5)
    assert np.diff(first).tolist() == [6, 0, 0, 1, 5, 2] and np.diff(at).tolist() == [2, 0, 0, 1, 1, 1]
    assert s[0] == s[at[4]] and w[4] == w[6] and len(set(w.tolist())) == 8


@pytest.mark.parametrize("module", [line_dedup, source_mixing, suffix_dedup])
def test_sql_gives_the_same(spark, module):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = module.query(spark, SF), con.sql(module.ORACLE)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_lines_odd(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns[:5] == odd.columns[:5]
    assert {r.n_removed for r in out.collect()} == {7}
    got = [(r.doc_id, r.n_lines, r.n_removed_, r.text) for r in out.collect() if r.doc_id in (1, 2, 3, 7, 8) or r.doc_id is None]
    assert sorted(got, key=str) == sorted([(1, 1, 0, "a b"), (1, 1, 0, "a b"), (2, 1, 0, None), (3, 1, 0, ""), (7, 4, 0, "l1\nl2\nl3\nl4"), (8, 5, 3, "q\nr"), (None, 1, 0, "x y z")], key=str)
    assert line_dedup.dedup_lines(odd.where("doc_id > 99")).count() == 0


def test_mixing_odd(odd):
    out = source_mixing.mix_sources(odd, expansion=3.0)
    assert out.columns == [*odd.columns, "replica_", "shuffle_key"] and out.where("replica <> 7 or replica_ < 1").count() == 0
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(source_mixing, "FEW_SOURCES", 0)
        assert sorted(map(str, source_mixing.mix_sources(odd, expansion=3.0).collect())) == sorted(map(str, out.collect()))
    assert source_mixing.mix_sources(odd.where("doc_id > 99")).count() == 0
    assert source_mixing.mix_sources(odd, {"s": 1.0}).where("source is null").count() == 0
    big = source_mixing.mix_sources(odd.where("doc_id = 9"), {"s": 1.0, None: 1.0}, expansion=2000.0)
    assert abs(big.count() - 2000) < 300


def test_suffixes_odd(spark, odd):
    got = collections.defaultdict(list)
    for r in suffix_dedup.remove_repeats(odd, Scratch(spark)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    empty = sha256(b"").hexdigest()
    assert got[2] == got[3] == [(0, 0, 0, empty)] and got[1] == [(3, 0, 0, sha256(b"a b").hexdigest())] * 2
    n = got[4][0][0]
    assert got[5] == [(n, n, 1, empty)] and got[9][0][1] == 0 and got[10] == [(120, 120, 1, empty)] and got[None][0][1] == 0
    assert got[6][0][2] == 2 and 0 < got[6][0][0] - got[6][0][1] < 10
    assert suffix_dedup.remove_repeats(odd.where("doc_id > 99"), Scratch(spark)).count() == 0


def test_suffixes_over_many_chunks(spark, docs, monkeypatch):
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs, Scratch(spark)).collect()))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5_000)
    monkeypatch.setattr(names, "RANGE_NAMES", 2_000)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, Scratch(spark)).collect())) == want


def test_names_pack():
    some = np.sort(np.unique(np.random.default_rng(0).integers(0, 2**62, 1000).astype(np.uint64)))
    for x in (some, some[:1], some[:0]):
        assert names.unpack(names.pack(x, 3)).tolist() == x.tolist()


def test_tokens_are_the_librarys(spark, docs, rows, odd):
    from tokenizers import Tokenizer

    file = bpe_lexicon.default_tokenizer()
    library = Tokenizer.from_file(file)
    for table, texts in ((docs, rows), (odd.where("doc_id > 1"), {r.doc_id: r.text or "" for r in odd.where("doc_id > 1").collect()})):
        for r in bpe_lexicon.encode_documents(table, file, lexicon_words=500).collect():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == sha256(r.decoded.encode()).hexdigest()
    assert bpe_lexicon.encode_documents(docs.where("doc_id < 0"), file).count() == 0


def test_tokens_keep_columns_of_their_names(spark, odd):
    import corpus_pipeline

    clash = odd.where("doc_id > 1").withColumns({"decoded": odd.score, "ids_sha256": odd.source})
    got = corpus_pipeline.tokens(spark, clash, SF)
    assert got.columns == [*(c for c in clash.columns if c != "text"), "n_tokens", "ids_sha256_", "decoded_sha256", "ids_"]
    plain = {r.doc_id: r for r in corpus_pipeline.tokens(spark, clash.select("doc_id", "text"), SF).collect()}
    for r in got.collect():
        assert (r.ids, r.decoded) == ("x", 0.5) and (r.ids_, r.ids_sha256_, r.n_tokens) == (plain[r.doc_id].ids, plain[r.doc_id].ids_sha256, plain[r.doc_id].n_tokens)


def test_tokens_of_hard_texts():
    from tokenizers import Tokenizer

    file = bpe_lexicon.default_tokenizer()
    library, rules = Tokenizer.from_file(file), bpe_lexicon.Rules(open(file, encoding="utf-8").read())
    texts = ["", "'s I'LL ''re", "<|endoftext|>a<|startoftext|>b", "<|endoftext|", "ΑΣ Σς", "İı", "x" * 3000, "!?" * 900, "漢字 é", "a\x1cb\x85c\xa0d", "½²ª12٣", "#" * 200, "aaaaaaaaaaaaaaaa"]
    encoder = bpe_lexicon.Encoder(rules, bpe_lexicon.compile_lexicon([b"a", b"ab"], rules.merge([b"a", b"ab"])))
    for t, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == library.decode(want, skip_special_tokens=False), t


def test_the_lexicon_is_a_minimal_automaton():
    words = sorted({f"{a}{b}ing".encode() for a in "abc" for b in "xyz"})
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon(words, [np.array([i], np.int32) for i in range(len(words))]))
    assert lexicon.numbers([*words, b"a", b"axin", b""]).tolist() == [*range(9), -1, -1, -1]
    assert len(lexicon.key) == 3 + 3 + 3  # one state after each letter: first, second, i, n, g


def brute_classes(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows):
    """Classes by exact counts of five-word tuples; nothing here is the module's."""
    got = {r.doc_id: re.findall("[^\x00-\x20]+", r.text or "") for r in rows.collect()}
    sets = {i: collections.Counter([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []) for i, w in got.items()}
    df = collections.Counter(x for s in sets.values() for x in s)
    weight = {x: round(1024 * (1 + math.log((1 + len(got)) / (1 + n)))) for x, n in df.items()}
    total = {i: sum(n * weight[x] for x, n in s.items()) for i, s in sets.items()}
    where, both = collections.defaultdict(list), collections.Counter()
    for i in sorted(sets):
        for x, n in sets[i].items():
            for j, m in where[x]:
                both[i, j] += min(n, m) * weight[x]
            where[x].append((i, n))
    empty = [i for i, s in sets.items() if not s]
    links = {(i, j) for (i, j), v in both.items() if v >= 0.8 * (total[i] + total[j] - v)} | {(i, empty[0]) for i in empty}
    return brute_classes(got, links)


def test_near_duplicates_are_brute_force(spark, docs, rows):
    want = brute_near(docs)
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs, Scratch(spark)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def edits_of(base, n, changes, seed):
    rng = np.random.default_rng(seed)
    for k in range(n):
        text = list(base)
        for place in rng.choice(len(base), changes, replace=False):
            text[place] = f"e{seed}x{k}x{place}"
        yield text


def among_others(spark, texts, n=2000):
    """``texts`` with n short texts of other words, so that what the near copies share is not in every document."""
    others = [(10_000 + k, f"o{k} p{k} q{k} r{k} s{k} t{k}") for k in range(n)]
    return spark.createDataFrame([*texts, *others], "doc_id long, text string")


def test_pairs_in_wide_cells_are_found(spark):
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k, text in enumerate(edits_of(base, 300, 2, 1)):  # about 0.7 to each other, so in one cell of most bands
        texts += [text, next(edits_of(text, 1, 1, 1000 + k))] if k % 3 == 0 else [text]  # each third has a twin at about 0.9
    rows = among_others(spark, [(i * 7919 % len(texts), " ".join(t)) for i, t in enumerate(texts)])
    want = brute_near(rows)
    assert 250 < len({c for c in want.values() if c < 10_000}) < 330
    assert {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(rows, Scratch(spark)).collect()} == want


def test_links_through_a_member_are_found(spark):
    """Near copies of one text that are not alike among themselves: all links go through it, and it is not the least doc_id."""
    for n, block in ((20, 512), (300, 512), (300, 64)):
        base = [f"w{i}" for i in range(200)]
        texts = [" ".join(base), *(" ".join(t) for t in edits_of(base, n, 2, n))]
        rows = among_others(spark, [((i + n // 2) % (n + 1), t) for i, t in enumerate(texts)])
        want = brute_near(rows)
        assert len({c for c in want.values() if c < 10_000}) < 5
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(blocks, "ROWS", block)
            assert {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(rows, Scratch(spark)).collect()} == want


def test_files_hold_few_chunks_whatever_the_input(spark, docs, tmp_path, monkeypatch):
    """A task decodes a file's chunks at once: 200 texts of one task, each a chunk of its own, lie in files of FILE_CHUNKS or fewer."""
    want = sorted(map(tuple, weighted_minhash.near_duplicates(docs, Scratch(spark)).collect()))
    monkeypatch.setattr(names, "CHUNK", 1)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1)
    kept = []
    monkeypatch.setattr(Scratch, "drop", lambda self, name: kept.append(f"{self.root}/{name}"))
    assert sorted(map(tuple, weighted_minhash.near_duplicates(docs.coalesce(1), Scratch(spark)).collect())) == want
    suffix = Scratch(spark)
    suffix_dedup.make_chunks(docs, suffix)
    for folder in {f for f in kept if f.rpartition("/")[2] in ("chunks", "steps", "signed")} | {f"{suffix.root}/chunks"}:
        sizes = [pq.read_metadata(f).num_rows for f in pathlib.Path(folder.removeprefix("file:").replace("//", "/")).glob("*.parquet")]
        assert sum(sizes) > 100 and max(sizes) <= names.FILE_CHUNKS
    assert len(kept) > 2


def test_near_duplicates_odd(spark, odd):
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(odd, Scratch(spark)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9, 10: 9}
    kept = weighted_minhash.keep_one(odd, Scratch(spark))
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "4", "7", "8", "9", "None"])
    assert weighted_minhash.keep_one(odd.where("doc_id > 99"), Scratch(spark)).count() == 0


def test_products_are_similarities():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**48, 60).astype(np.uint64))
    step = rng.integers(1, 9000, len(pool))
    sets = []
    for _ in range(25):
        k = np.sort(rng.choice(len(pool), rng.integers(0, 40), replace=False))
        sets.append((pool[k], rng.integers(1, 4, len(k)), step[k]))
    one, two = np.arange(10), np.arange(10, 25)
    want = [[weighted_minhash.similarity(a, n * v, b, m * w) for b, m, w in sets[10:]] for a, n, v in sets[:10]]
    for most in (30, 1 << 20):
        assert np.allclose(weighted_minhash.similarities(sets, one, two, most), want, atol=1e-9)


def test_sampling_agrees_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**48, 4000).astype(np.uint64))
    w = rng.integers(1, 5, len(base)).astype(float)
    a, b = slice(0, 3000), slice(800, 4000)
    exact = weighted_minhash.similarity(base[a], w[a], base[b], w[b])
    shingle, weight = np.concatenate([base[a], base[b]]), np.concatenate([w[a], w[b]])
    hits = []
    for k in range(12):
        d = weighted_minhash.samples(shingle ^ np.uint64(k * 7919), weight, np.array([0, 3000, len(shingle)]))
        hits += (d[0] == d[1]).tolist()
    assert abs(np.mean(hits) - exact) < 0.08


def test_passages_are_found(spark, docs, rows):
    where = collections.defaultdict(set)
    for i, t in rows.items():
        words = t.split()
        for k in range(len(words) - 49):
            where[md5(" ".join(words[k : k + 50]).encode()).digest()].add(i)
    shared_ = [v for v in where.values() if len(v) > 1]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs, Scratch(spark)).collect()}
    assert sorted(got) == sorted(rows)
    for v in shared_:
        assert all(got[i].class_size > 1 and got[i].n_repeated >= 50 for i in v) and len({got[i].class_id for i in v}) == 1
    clean = set(rows) - set().union(*shared_)
    assert sum(got[i].class_size > 1 for i in clean) <= 0.1 * len(clean)


def test_each_place_of_a_passage_is_found():
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    p = new(56)
    assert substring_dedup.passages(p, np.concatenate([p[:36], new(40), p])) == [(0, 55, 76, 131)]
    many = np.concatenate([x for _ in range(12) for x in (p, new(30))])
    assert substring_dedup.passages(p, many) == [(0, 55, 86 * k, 86 * k + 55) for k in range(12)]
    edited = np.concatenate([p[:20], new(5), p[25:]])
    assert substring_dedup.passages(p, np.concatenate([new(9), edited, new(9)])) == [(0, 55, 9, 64)]
    for _ in range(20):  # exact runs between two texts of few pieces are those of brute force
        pieces = [new(n) for n in (50, 60, 30)]
        a, b = (np.concatenate([x for k in rng.integers(0, 3, 6) for x in (pieces[k], new(20))]) for _ in range(2))
        same = a[:, None] == b[None, :]
        want = set()
        for i, q in np.argwhere(same):
            if not (i and q and same[i - 1, q - 1]):
                n = 1
                while i + n < len(a) and q + n < len(b) and same[i + n, q + n]:
                    n += 1
                if n >= substring_dedup.SHORTEST:
                    want.add((i, i + n - 1, q, q + n - 1))
        assert set(substring_dedup.passages(a, b)) == want
    assert substring_dedup.passages(new(0), p) == [] == substring_dedup.passages(new(60), p)
    assert substring_dedup._runs(many, many, 100).tolist() == substring_dedup._runs(many, many).tolist()


def test_what_is_not_promising_has_no_passages(monkeypatch):
    rng, kept = np.random.default_rng(6), 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 120).astype(np.uint64)
        b = a.copy()
        for at in rng.integers(0, 115, rng.integers(1, 8)):
            b[at : at + 5] = rng.integers(0, 1 << 62, 5)
        fast = substring_dedup.passages(a, b)
        with monkeypatch.context() as patch:
            patch.setattr(substring_dedup, "promising", lambda *_: True)
            assert substring_dedup.passages(a, b) == fast
        kept += bool(fast)
    assert 50 < kept < 290


def test_texts_without_a_passage_leave_before_they_meet(spark):
    """Sixty texts share a line of 45 words, which windows of 50 words meet by, and two of them a passage of 60 words."""
    line, passage = " ".join(f"l{i}" for i in range(45)), " ".join(f"p{i}" for i in range(60))
    own = lambda k, at: " ".join(f"o{k}x{at + i}" for i in range(50))
    rows = [(k, f"{own(k, 0)} {line} {own(k, 50)}" + (f" {passage} {own(k, 100)}" if k in (7, 31) else "")) for k in range(60)]
    scratch = Scratch(spark)
    got = {r.doc_id: (r.class_id, r.n_repeated) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {k: (k, 0) for k in range(60)} | {7: (7, 60), 31: (7, 60)}
    assert sorted(r.id for r in spark.read.parquet(f"{scratch.root}/shingled").collect()) == [7, 31]


def test_hopeful_texts_are_those_of_brute_force():
    rng, seen = np.random.default_rng(1), []
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 130, 5))])
        hit, again = rng.random(first[-1]) < rng.choice([0.7, 0.75, 0.8]), rng.random(first[-1]) < 0.05
        worth, want = np.where(hit, 1, np.where(again, 0, -4)), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            upto = np.concatenate([[0], np.cumsum(worth[a:b])])
            want.append(any(hit[a + i] and hit[a + j - 1] and upto[j] >= upto[i] for i in range(b - a) for j in range(i + substring_dedup.SHORTEST, b - a + 1)))
        assert substring_dedup.hopeful(hit, again, first).tolist() == want
        seen += want
    assert 0.1 < np.mean(seen) < 0.9


def test_links_behind_a_head_are_found(spark):
    """Two documents share a passage; two with smaller ids hold only the shingles that are its least."""
    words = [f"m{i}" for i in range(50)]
    hashes, _, _, _ = shared.shingles(*shared.buffers(pa.array([" ".join(words)])), 5)
    least = sorted({int(np.argmin(substring_dedup._function(hashes, k))) for k in range(substring_dedup.FUNCTIONS)})
    other = lambda n: " ".join(" ".join([*(f"f{n}x{at}x{k}" for k in range(30)), *words[at : at + 5]]) for at in least) + " " + " ".join(f"g{n}x{k}" for k in range(40))
    rows = [(1, other(1)), (2, " ".join(words)), (3, other(3)), (4, " ".join(words) + " and more")]
    got = {r.doc_id: (r.class_id, r.n_repeated) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got == {1: (1, 0), 2: (2, 50), 3: (3, 0), 4: (2, 50)}


def test_near_passages_are_found(spark):
    """Passages of 90 words with up to four words changed, in texts that are otherwise strange to each other, and a line that all share: by brute force, 0.9 of the links between classes at least."""
    rng, rows = np.random.default_rng(8), []
    for k in range(60):
        passage = [f"p{k}x{i}" for i in range(90)]
        for copy in range(2):
            for at in rng.choice(90, rng.integers(0, 5), replace=False):
                passage[at] = f"e{k}x{copy}x{at}"
            mine = [f"o{k}x{copy}x{i}" for i in range(80)]
            rows.append((2 * k + copy, " ".join([*mine[:40], *passage, *(f"line{i}" for i in range(12)), *mine[40:]])))
    for wide in (substring_dedup.WIDE, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring_dedup, "WIDE", wide)
            got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
        hashes, at, _, _ = shared.shingles(*shared.buffers(pa.array([t for _, t in rows])), 5)
        own = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if substring_dedup.passages(own[i], own[j])]
        assert len(links) > 40 and np.mean([got[i] == got[j] for i, j in links]) >= 0.9
        assert all(got[i] in (i, i - 1) for i in got)


def test_what_is_promising_of_many_is_as_of_two():
    rng, seen = np.random.default_rng(3), []
    for _ in range(40):
        base = rng.integers(0, 90, 100)
        texts = [base.copy() for _ in range(12)]
        for t in texts:
            for at in rng.integers(0, 95, rng.integers(0, 7)):
                t[at : at + 5] = rng.integers(100, 400, 5)
        again = [substring_dedup._repeats(t) for t in texts]
        want = [substring_dedup.promising(np.isin(texts[0], t), again[0], np.isin(t, texts[0]), a) for t, a in zip(texts[1:], again[1:], strict=True)]
        assert substring_dedup.all_promising(texts[0], again[0], texts[1:], again[1:]).tolist() == want
        seen += want
    assert 0.1 < np.mean(seen) < 0.9


def test_a_large_class_meets_others_once(spark, monkeypatch):
    """Near copies of one text and others that are edited too much: whatever the number of groups, a text meets once; classes are those of brute force."""
    rng, rows = np.random.default_rng(4), []
    for k in range(60):
        words = [f"w{i}" for i in range(120)]
        for at in range(int(rng.integers(5, 20)), 120, 25) if k >= 45 else rng.choice(120, 1 if k else 0):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
    dealt, deal, scratch = [], blocks.deal, Scratch(spark)
    monkeypatch.setattr(blocks, "deal", lambda many, *a: dealt.append(many.select("id").collect()) or deal(many, *a))
    monkeypatch.setattr(substring_dedup, "WIDE", 0)
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert len(dealt) == 1 and 0 < len(dealt[0]) < spark.read.parquet(f"{scratch.root}/left-2").count()
    hashes, at, _, _ = shared.shingles(*shared.buffers(pa.array([t for _, t in rows])), 5)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and substring_dedup.passages(hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(rows))] == label


def test_all_documents_of_a_group_are_linked(spark):
    """A passage in 30 texts, two of them alike beyond it and five exact copies of one: links are those of brute force."""
    shared_ = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(40)] + shared_ + [f"b{k}x{i}" for i in range(40)])) for k in range(30)]
    rows += [(100 + k, rows[7][1]) for k in range(5)]
    tail = " ".join(f"t{i}" for i in range(55))
    rows += [(200 + k, f"u{k} " + " ".join(shared_) + f" v{k} {tail}") for k in range(2)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert {r.class_size for r in got.values()} == {len(rows)} and {r.class_id for r in got.values()} == {0}
    hashes, at, _, _ = shared.shingles(*shared.buffers(pa.array([t for _, t in rows])), 5)
    own = {i: hashes[at[k] : at[k + 1]] for k, (i, _) in enumerate(rows)}
    for i, r in got.items():
        places, earlier = set(), set()
        for j in own:
            if i != j:
                for first, last, _, _ in substring_dedup.passages(own[i], own[j]):
                    places |= set(range(first, last + 5))
                    earlier |= set(range(first, last + 5)) if j < i else set()
        assert (r.n_repeated, r.n_later) == (len(places), len(earlier))
        assert {p for s in r.spans for p in range(s["first"], s["end"])} == places


def test_passages_odd(spark, odd):
    got = {r.doc_id: (r.class_id, r.class_size > 1, r.n_later > 0) for r in substring_dedup.repeated_passages(odd, Scratch(spark)).collect()}
    assert got[4] == (4, True, False) and got[5] == (4, True, True) and got[6] == (4, True, True)
    assert all(got[i] == (i, False, False) for i in (1, 2, 3, 7, 8, 9, 10)) and None not in got
    assert substring_dedup.repeated_passages(odd.where("doc_id > 99"), Scratch(spark)).count() == 0


def test_compact_windows_are_those_of_the_tree():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    first = np.array([0, 3, 150, 150, 400])
    want = set()
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            lo, hi = i, i
            while lo > a and h[lo - 1] > h[i]:
                lo -= 1
            while hi < b - 1 and h[hi + 1] > h[i]:
                hi += 1
            if hi - lo >= 19:
                want.add((i, lo, hi))
    assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, first, 20)), strict=True)) == want


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_pu.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in got]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_the_prior_is_that_of_the_unlabelled(share):
    rng = np.random.default_rng(5)
    draw = lambda n, at: rng.normal(at, 1.0, (n, 6)).astype(np.float32)
    good = round(4000 * share)
    unlabelled = rng.permutation(np.concatenate([draw(good, 1.2), draw(4000 - good, -1.2)]))
    assert abs(quality_pu.prior_of(draw(3000, 1.2), unlabelled) - share) < 0.06


def test_marks_that_are_not_good_are_never_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bad = labels.where("quality = 0").select("doc_id")
    # a row marked bad leaves the unlabelled, whatever else its mark says
    one, two = (quality_pu.fit(docs, x) for x in (labels, labels.where("quality = 1").unionByName(bad.selectExpr("doc_id", "0 AS quality", "1 AS toxic"))))
    assert one.prior == two.prior and one.offset == two.offset


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_pu.score_documents(odd, quality_pu.fit(odd, none))
    assert out.count() == odd.count() and out.where("score between 0 and 1").count() == odd.count()
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_pu.keep_good(odd, some).columns == odd.columns
    empty = odd.where("doc_id > 99")
    assert quality_pu.score_documents(empty, quality_pu.fit(empty, some)).count() == 0


def test_pipeline_stages_do_what_the_operators_do(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = Scratch(spark), docs.columns
    one = scratch.save(p.quality(spark, docs, SF), "1")
    good = {r.doc_id for r in quality_pu.query(spark, SF).where("predicted = 1").collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == good
    two = scratch.save(p.lines(spark, one, SF), "2")
    seen, want = set(), {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        lines, gone = r.text.split("\n"), set()
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if key in seen else set()
            seen.add(key)
        want[r.doc_id] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert two.columns == columns and {r.doc_id: r.text for r in two.collect()} == want and all(r.n_chars == len(r.text) for r in two.collect())
    three = scratch.save(p.near_duplicates(spark, two, SF), "3")
    kept = {i for i, c in brute_near(two).items() if i == c}
    texts = {r.doc_id: r.text for r in two.collect()}
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == {i: texts[i] for i in kept}
    four = scratch.save(p.mixing(spark, three, SF), "4")
    sources = collections.Counter(r.source for r in three.collect())
    copies = collections.Counter()
    for r in three.collect():
        rate = sum(sources.values()) * math.sqrt(sources[r.source]) / sum(map(math.sqrt, sources.values())) / sources[r.source]
        u, n, at, upto = int(md5(f"20240|n|{r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate), math.exp(-rate)
        while upto <= u:
            n += 1
            at *= rate / n
            upto += at
        copies[r.doc_id] = n
    assert four.columns == columns and collections.Counter(r.doc_id for r in four.collect()) == +copies
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_lexicon.default_tokenizer())
    five = p.tokens(spark, four, SF).collect()
    assert collections.Counter(r.doc_id for r in five) == +copies
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in five)


def test_pipeline_stages_leave_other_columns_alone(spark, odd):
    import corpus_pipeline as p

    got = p.mixing(spark, p.lines(spark, odd, SF), SF)
    assert got.columns == odd.columns and {(r.n_removed, r.replica, r.score, r.ids) for r in got.collect()} == {(7, 7, 0.5, "x")}


def test_equal_first_names_are_told_apart(docs, monkeypatch):
    """With first names cut to a few bits, the further bytes must tell all strings apart that they make equal."""
    whole = suffix_dedup.span_hash
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda *a: whole(*a) & np.uint64(0xFFF))
    spark_free = [(r.doc_id, r.text or "") for r in docs.where("doc_id < 60").collect()]
    data, offsets = shared.buffers(pa.array([t for _, t in spark_free]))
    chunk = suffix_dedup.Chunk(data, offsets, np.array([i for i, _ in spark_free]))
    places = np.arange(0, len(data) - 50)
    order, fresh, named, extra = chunk.named(places, 50, 128)
    assert extra.shape == (len(named), 8) and len(np.unique(named)) < 5000 < len(named)
    strings = {data[p : p + 50].tobytes() for p in places}
    assert fresh.sum() == len(strings)
    number = np.cumsum(fresh) - 1
    assert len({(n, data[p : p + 50].tobytes()) for n, p in zip(number.tolist(), places[order].tolist(), strict=True)}) == len(strings)
    twice = np.concatenate([named, named[::2]])
    both = np.concatenate([extra, extra[::2]])
    got, group = names.met(twice, both)
    size = np.bincount(group)[group]
    assert sorted(got[size > 1].tolist()) == sorted([*range(0, len(named), 2), *range(len(named), len(twice))]) and set(size.tolist()) <= {1, 2}
    pairs = got[size > 1].reshape(-1, 2)
    assert (twice[pairs[:, 0]] == twice[pairs[:, 1]]).all() and (both[pairs[:, 0]] == both[pairs[:, 1]]).all() and (pairs[:, 0] < pairs[:, 1]).all()
