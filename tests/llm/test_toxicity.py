import zlib

import numpy as np

from gaugeworks.llm import toxicity
from gaugeworks.llm.shared import Scratch

SF = "/root/testdata/sf0.01"


def scores(spark, docs, labels):
    return toxicity.toxic_scores(docs, labels, Scratch(spark)).toPandas()


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = scores(spark, docs, labels)
    assert len(got) == docs.count() and (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert ((held.predicted == held.toxic).mean()) >= 0.93
    assert held[held.toxic == 0].predicted.mean() <= 0.05


def world(spark, n=900):
    """Clean and toxic texts; some toxic ones hold a made-up stem that no lexicon knows."""
    rng = np.random.default_rng(1)
    plain = ["field", "river", "morning", "letters", "garden", "window", "account", "travel", "stone", "music"]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, 40)), ["idiot", "worthless"][i // 6 % 2] if i % 12 else "grubzek" + str(rng.choice(["en", "os", "ar", "um", "ik"])))
        rows.append((i, " ".join(words), "x", i % 3))
        if i % 2 == 0 and i % 10 < 8:
            marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, votes int"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_mined_stems_reach_unmarked_texts(spark):
    docs, labels = world(spark)
    got = scores(spark, docs, labels)
    assert ((got.predicted == 1) == (got.doc_id % 6 == 0)).all()
    model, _ = toxicity.fit(docs, labels, Scratch(spark), ["doc_id"])
    assert any(t.startswith("grubzek") for t, _ in model.terms.all)
    assert model.labels.accuracy["dense"] > 0.95 and model.labels.linked
    votes, at, _ = model.terms.look("a GRUBZEKUM walks, you idiots!!")
    assert votes >> 15 & 1 and votes & 1 and any(model.terms.all[a][0].startswith("grubzek") for a in at if a < len(model.terms.all))


def test_the_label_model_counts_what_goes_together_once():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.3
    def bit(p, q):
        return (rng.random(len(y)) < np.where(y, p, q)).astype(np.int64)
    one, three = bit(0.7, 0.05), bit(0.8, 0.1)
    patterns = one | one << 1 | one << 2 | three << 5  # three voters that always agree
    every, n = np.unique(patterns, return_counts=True)
    known = np.zeros((len(every), 2))
    np.add.at(known, (np.searchsorted(every, patterns[:2000]), y[:2000].astype(int)), 1)
    model = toxicity.LabelModel(every, n.astype(float), known)
    for p in every.tolist():
        assert abs(model.posterior(np.array([p]))[0] - y[patterns == p].mean()) < 0.05


def test_odd_texts(spark):
    docs, labels = world(spark, 400)
    odd = spark.createDataFrame([(1000, None, "x", 1), (1001, "", "x", 1), (None, "you worthless idiot, idiot", "x", 1), (2, "field", "x", 1), (2, "aaa", "x", 1), (1002, "river " * 100000, "x", 1), (1003, "😀 1234 !!", "x", 1)], docs.schema)
    got = scores(spark, docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(0, 1, 0), (3, 1, None), (None, 1, 1)], labels.schema)))
    assert len(got) == 407 and got.score.notna().all()
    assert not got[got.doc_id.isna()].held_out.any() and (got[got.doc_id.isna()].predicted == 1).all()
    assert (got[got.doc_id.isin([1000, 1001, 1002, 1003])].predicted == 0).all()
    none = labels.where("false")
    alone = scores(spark, docs, none)
    assert alone.score.between(0, 1).all() and alone[(alone.doc_id % 6 == 0) & (alone.doc_id % 12 != 0)].predicted.all() and not alone[alone.doc_id % 6 != 0].predicted.any()
    assert scores(spark, docs.where("false"), labels).empty and len(scores(spark, docs.limit(3), labels.where("toxic = 0"))) == 3
