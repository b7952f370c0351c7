"""Quality classifier by positive-unlabelled learning.

Documents marked good are the trusted positives, documents without a mark are
the unlabelled web text. A small network on the bytes and words of a text is
trained to minimise the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

and steps back along the second term's gradient where it falls below zero. The
class prior comes from positives and unlabelled text alone, by best bin
estimation: a network told to tell the two apart on one half of the sample ranks
the other half, and of all top bins that hold a share q of the positives and r of
the unlabelled, r / q is the prior at the one where r / q and its sampling error
together are least. The final score's offset is the one at which unlabelled text
scores the prior on average. Marks other than good are never learned from.

The fit uses bounded samples, the first rows by a hash of the id: at most
``POSITIVES`` positives and ``UNLABELLED`` unlabelled. Scoring covers every whole
text of the table.

Defined cases: a null text is an empty one and gets the network's score for it;
labels that contradict each other for one doc_id, or are null, count as none;
with fewer than two positives or two unlabelled texts to learn from, nothing
speaks against a text and every score is 1; of rows that repeat a doc_id, the text that sorts first
is learned from; rows without doc_id are scored and never learned from; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, prefix_hash, slices, span_hash, table, text_of, words

POSITIVES, UNLABELLED = 6_000, 12_000
HELD_OUT_OF, CUT = 5, 0.3
HIDDEN, EPOCHS, BATCH, RATE, SEED = 48, 30, 512, 3e-3, 7
DELTA, GAMMA = 0.1, 0.01  # best bin estimation: chance that its bound fails, and weight of the bound beyond one
_LAST = 128  # all bytes above ASCII


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text: how often each byte occurs, and what its words and lines look like."""
    data, offsets = buffers(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    of_byte = np.repeat(np.arange(n, dtype=np.int64), sizes)
    histogram = np.bincount(of_byte * (_LAST + 1) + np.minimum(data, _LAST), minlength=n * (_LAST + 1)).reshape(n, _LAST + 1)
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(n, dtype=np.int64), count)
    hashes = span_hash(prefix_hash(data), starts, ends)
    length = (ends - starts).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128))])
    caps, small = upper[ends] - upper[starts], lower[ends] - lower[starts]
    last = data[np.maximum(ends - 1, 0)] if len(ends) else np.empty(0, np.uint8)
    symbol = (last > 32) & (last < 128) & ~((last >= 48) & (last <= 57) | (last >= 65) & (last <= 90) | (last >= 97) & (last <= 122) | np.isin(last, np.frombuffer(b".,;:?'\")", np.uint8)))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    total = lambda x: np.bincount(doc, x, minlength=n)
    per = np.maximum(count, 1)
    mean = total(length) / per
    shares = [mean, np.sqrt(np.maximum(total(length**2) / per - mean**2, 0)), *(total(x.astype(float)) / per for x in (caps == 1, (caps > 1) & (small == 0), (caps == 0) & (small == 0), (caps > 0) & (small > caps), symbol, same, fresh[np.argsort(order, kind="stable")], length == 1, length > 14))]
    lines = histogram[:, 10] / per
    out = np.column_stack([np.log1p(1000 * histogram / np.maximum(sizes, 1)[:, None]), *shares, np.log1p(count), np.log1p(20 * lines)])
    return out.astype(np.float32)


class Network:
    """One hidden layer, trained with Adam: ``fit`` minimises the non-negative risk, ``separate`` tells positive from unlabelled."""

    def __init__(self, prior: float):
        self.prior, self.offset = prior, 0.0
        self.weights: list[np.ndarray] | None = None

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.maximum(x @ a + b, 0)
        return hidden, hidden @ c + d

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        """The sigmoid loss: l(+, g) = 1 - s(g), l(-, g) = s(g)."""

        def pull(sp: np.ndarray, su: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = np.float32(self.prior)
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            return (-2 * pi * dp, du) if su.mean() - pi * sp.mean() >= 0 else (pi * dp, -du)

        self._train(positive, unlabelled, pull, EPOCHS)
        self._centre(self.margin(unlabelled))

    def separate(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        """The logistic loss of positive against unlabelled."""
        self._train(positive, unlabelled, lambda sp, su: ((sp - 1) / len(sp), su / len(su)), EPOCHS // 2)

    def _centre(self, margins: np.ndarray) -> None:
        """The offset at which the mean score of ``margins`` is the prior, by bisection."""
        low, high = -60.0, 60.0
        for _ in range(80):
            self.offset = (low + high) / 2
            if self._squash(margins).mean() < self.prior:
                low = self.offset
            else:
                high = self.offset

    def _train(self, positive: np.ndarray, unlabelled: np.ndarray, pull, epochs: int) -> None:
        """``pull`` gives the gradients of the risk by the margins of a batch of positives and one of unlabelled, from their sigmoids."""
        rng = np.random.default_rng(SEED)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = (positive - self.mean) / self.scale, (unlabelled - self.mean) / self.scale
        width = p.shape[1]
        self.weights = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros((), np.float32)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            rows = rng.permutation(len(u))
            for at in range(0, len(u), BATCH):
                xu = u[rows[at : at + BATCH]]
                xp = p[rng.integers(0, len(p), BATCH)]
                (hp, gp), (hu, gu) = self._forward(xp), self._forward(xu)
                wp, wu = pull(1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu)))
                grads = []
                for x, h, w in ((xp, hp, wp), (xu, hu, wu)):
                    back = (w[:, None] * self.weights[2]) * (h > 0)
                    grads.append((x.T @ back, back.sum(0), h.T @ w, w.sum()))
                step += 1
                for i, w in enumerate(self.weights):
                    g = grads[0][i] + grads[1][i] + 1e-4 * w * (i in (0, 2))
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.weights[i] = (w - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1].astype(np.float64)

    def _squash(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins + self.offset, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return self._squash(self.margin(x))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, by best bin estimation; between 0.02 and 0.98."""
    judge = Network(0.5)
    judge.separate(positive[::2], unlabelled[::2])
    p, u = np.sort(judge.margin(positive[1::2])), np.sort(judge.margin(unlabelled[1::2]))
    cuts = np.unique(p)
    q, r = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(np.log(4 / DELTA) / (2 * len(p))) + np.sqrt(np.log(4 / DELTA) / (2 * len(u)))
    best = np.argmin((r + (1 + GAMMA) * error) / q)
    return float(np.clip(r[best] / q[best], 0.02, 0.98))


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(HELD_OUT_OF))


def first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows that come first by a hash of doc_id; a threshold on the hash keeps what is sorted near that number."""
    n = ids.count()
    share = min(1.0, 3 * most / max(n, 1))
    key = F.xxhash64("doc_id", F.lit(SEED))
    return ids.where(key <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(key, "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    marks = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r"))
    )
    trusted = marks.where((F.col("q") == F.col("r")) & (F.col("q") >= 1) & (fold() != 0)).select("doc_id")
    ids = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id").distinct()
    picked = (
        first_by_hash(trusted, POSITIVES).withColumn("part", F.lit(0))
        .unionByName(first_by_hash(ids.join(labels.where("quality is not null").select("doc_id"), "doc_id", "left_anti"), UNLABELLED).withColumn("part", F.lit(1)))
    )
    rows = picked.collect()  # bounded by the two numbers
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.part) for r in rows], f"id {docs.schema['doc_id'].dataType.simpleString()}, part int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id", "part").agg(F.min(text_of()).alias("text"))

    def compute(batches):
        for batch in batches:
            for part in slices(batch):
                got = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array([r.tobytes() for r in got], pa.binary())], ["doc_id", "part", "features"])

    got = texts.select("doc_id", "part", "text").mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, features binary").collect()
    got.sort(key=lambda r: str(r.doc_id))
    positive, unlabelled = (np.array([np.frombuffer(r.features, np.float32) for r in got if r.part == k]) for k in (0, 1))
    if min(len(positive), len(unlabelled)) < 2:
        return Network(1.0)
    model = Network(prior_of(positive, unlabelled))
    model.fit(positive, unlabelled)
    return model


def _scored(docs: DataFrame, model: Network, keep: list[str], name: str) -> DataFrame:
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), f"`{name}` double"])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(model.score(features(part.column("text"))), pa.float64())], [*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs``."""
    return _scored(docs, model, ["doc_id"], "score").select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier predicts to be good."""
    return _scored(docs, fit(docs, labels), docs.columns, "quality_pu_score").where(F.col("quality_pu_score") >= CUT).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
