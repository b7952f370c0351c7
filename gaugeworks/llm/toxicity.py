"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters look at a whole text and vote or don't: lexicons of insults in four languages,
threats, spelling patterns, and lexicons of words and stems mined from marked rows. A mined
term must tell toxic from clean in both halves of the marked sample; its tier is the lesser
of the two lower bounds of its precision, so that chance in one half makes no term.

The label model is a tree over the voters for each class: P(class) times P(vote of j |
vote of j's parent, class). It is fitted by expectation maximisation to how often each pattern
of votes occurs over all documents (2**16 patterns at most) beside the marked ones, whose
class is known. The tree joins the voters that go most together within a class (by mutual
information given the class), so that two voters who say the same count once.

A linear classifier on the terms of a text and its votes is then trained on the model's
posterior labels of the marked sample's texts, and scores every text of the table.

The fit uses a bounded sample, the first rows by a hash of the id: at most ``MARKED``
marked rows. Votes are counted over all documents.

Defined cases: a null text is an empty one and gets the classifier's score for it;
marks that contradict each other for one doc_id, or are null, count as none; without a
sample of both classes the score is the label model's posterior of the votes; of
rows that repeat a doc_id, the text that sorts first is learned from; rows without
doc_id are scored and never learned from; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_pu import first_by_hash, fold
from .shared import Scratch, slices, table, text_of

MARKED, TERMS, CANDIDATES = 40_000, 2_000, 40_000
CUT, SEED = 0.5, 13
TIERS = (0.8, 0.6, 0.35)  # least precision, as a lower bound in both halves
STEM, LONGEST = (3, 10), 40  # letters of a stem; longer words are no terms of their own
DENSE = 0.01  # hits a word
ROUNDS, STEPS, RIDGE = 40, 300, 1.0
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]")
_MASKS = re.compile(r"[*@$#]")

# Insults by language; an asterisk stands for any ending.
INSULTS = {
    "en": "idiot* moron* stupid* loser* scum* worthless pathetic disgusting trash garbage filth* vermin dumb* jerk* creep* freak* fool* clown* ugly bastard* bitch* asshole* shit* fuck* retard* imbecile*",
    "de": "idiot* dumm* trottel* depp* arschloch* abschaum versager* widerlich* wertlos* dreck* scheiß* hurensohn* missgeburt* schwachkopf* vollpfosten miststück* blödmann",
    "fr": "idiot* imbécile* crétin* connard* connasse* salaud* salope* ordure* racaille* débile* merde* pathétique* dégoûtant* pourriture* abruti* minable*",
    "es": "idiota* imbécil* estúpid* inútil* basura escoria asqueros* patétic* payas* mierda* cabrón* cabron* perdedor* gilipollas pendej* despreciable*",
}
THREATS = ("kill you", "kill yourself", "hope you die", "hurt you", "shut up", "go to hell", "bring dich um", "halt die klappe", "fahr zur hölle", "te tuer", "ferme ta gueule", "va mourir", "te mato", "voy a matar", "cállate", "muérete")
VOTERS = ("insults_en", "insults_de", "insults_fr", "insults_es", "threats", "words_strong", "words_medium", "words_weak", "stems_strong", "stems_medium", "stems_weak", "several", "dense", "masked", "shouting", "exclaims")


class Terms:
    """Words and stems with the voter that each belongs to, looked up by their first letters."""

    def __init__(self, mined: list[tuple[str, int]]):
        own = [(t, i) for i, lang in enumerate(INSULTS) for t in INSULTS[lang].split()]
        self.all = own + mined
        self.heads: dict[str, list[tuple[str, bool, int, int]]] = {}
        for at, (term, voter) in enumerate(self.all):
            stem = term.endswith("*")
            letters = term.rstrip("*")
            self.heads.setdefault(letters[:3], []).append((letters, stem, at, voter))

    def hits(self, counted: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in counted.items():
            for letters, stem, at, _ in self.heads.get(word[:3], ()):
                if word == letters or stem and word.startswith(letters):
                    out[at] = out.get(at, 0) + n
        return out

    def look(self, text: str) -> tuple[int, list[int], list[float]]:
        """The votes as bits, and the text's features: their places and values."""
        low = text.lower()
        words = _WORD.findall(low)
        hits = self.hits(Counter(words))
        votes = 0
        for at in hits:
            votes |= 1 << self.all[at][1]
        votes |= (any(t in low for t in THREATS)) << 4
        sure = [at for at in hits if self.all[at][1] in (0, 1, 2, 3, 5, 6, 8, 9)]
        votes |= (len(sure) > 1) << 11
        total = sum(hits[at] for at in sure)
        votes |= (total >= 1 and total >= DENSE * len(words)) << 12
        votes |= bool(_MASKS.search(low) and _MASKED.search(low)) << 13
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        upper, lower = np.count_nonzero((raw >= 65) & (raw <= 90)), np.count_nonzero((raw >= 97) & (raw <= 122))
        votes |= bool(upper >= 20 and upper > lower) << 14
        votes |= ("!!" in text) << 15
        at = list(hits)
        values = [float(np.log1p(hits[a])) for a in at]
        n = len(self.all)
        for j in range(len(VOTERS)):
            if votes >> j & 1:
                at.append(n + j)
                values.append(1.0)
        at += [n + len(VOTERS), n + len(VOTERS) + 1]
        values += [float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(words))))]
        return votes, at, values

    @property
    def width(self) -> int:
        return len(self.all) + len(VOTERS) + 2


def grams(text: str) -> set[str]:
    """A text's words and, with an asterisk, the stems of its longer words."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) <= LONGEST}
    out = set(words)
    for w in words:
        for n in range(STEM[0], min(len(w) - 1, STEM[1]) + 1):
            out.add(w[:n] + "*")
    return out


def counted(sample: DataFrame) -> DataFrame:
    """(gram, t0, c0, t1, c1): in how many toxic and clean texts of either half of (text, mark, half) each gram stands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                seen: dict[tuple[int, int], Counter] = {(m, h): Counter() for m in (0, 1) for h in (0, 1)}
                for text, mark, half in zip(*(part.column(c).to_pylist() for c in ("text", "mark", "half")), strict=True):
                    seen[mark, half].update(grams(text))
                every = sorted(set().union(*seen.values()))
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([seen[k][g] for g in every], pa.int64()) for k in ((1, 0), (0, 0), (1, 1), (0, 1)))], ["gram", "t0", "c0", "t1", "c1"])

    each = sample.select("text", "mark", "half").mapInArrow(run, "gram string, t0 long, c0 long, t1 long, c1 long")
    return each.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))


def least_precision(t, n, z: float = 1.8):
    """Wilson's lower bound of t out of n."""
    p = t / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def mined(sample: DataFrame, base: float) -> list[tuple[str, int]]:
    """Terms that tell toxic texts in both halves, with their voters: the TERMS best."""
    bound = F.least(*(least_precision(F.col(f"t{h}"), F.col(f"t{h}") + F.col(f"c{h}")) for h in (0, 1)))
    good = counted(sample).where("t0 >= 3 AND t1 >= 3").withColumn("bound", bound).where(F.col("bound") >= max(TIERS[-1], min(0.9, 2 * base)))
    rows = {r.gram: r for r in good.orderBy(F.desc("bound"), F.desc("t0"), "gram").limit(CANDIDATES).collect()}
    same = lambda a, b: (a.t0, a.c0, a.t1, a.c1) == (b.t0, b.c0, b.t1, b.c1)
    # of nested stems with equal counts the longest stands for all
    spare = set()
    for g in rows:
        shorter = g[:-2] + "*" if g.endswith("*") else g[:-1] + "*"
        for one in (shorter, g + "*"):
            if one != g and one in rows and same(rows[one], rows[g]):
                spare.add(one)
        if not g.endswith("*"):  # a whole word may be longer than the longest stem
            for n in range(STEM[0], STEM[1] + 1):
                one = g[:n] + "*"
                if one in rows and same(rows[one], rows[g]):
                    spare.add(one)
    kept: dict[str, float] = {}
    for g in sorted(set(rows) - spare, key=lambda g: (len(g.rstrip("*")), not g.endswith("*"), g)):
        letters = g.rstrip("*")
        above = max((kept.get(letters[:n] + "*", 0.0) for n in range(STEM[0], len(letters) + 1)), default=0.0)
        if rows[g].bound > above:  # a longer term must say more than its stem
            kept[g] = rows[g].bound
    best = sorted(kept, key=lambda g: (-kept[g], g))[:TERMS]
    tier = lambda b: next(i for i, least in enumerate(TIERS) if b >= least)
    return [(g, (8 if g.endswith("*") else 5) + tier(kept[g])) for g in best]


def looked(docs: DataFrame, terms: Terms, keep: list[str]) -> DataFrame:
    """(``keep``, votes, at, value) of every row of ``docs``."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "votes int, at array<int>, value array<float>"])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = [terms.look(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.float32()))],
                    [*keep, "votes", "at", "value"],
                )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


class LabelModel:
    """P(class) and, for each class, a tree of votes; ``parent``, ``accuracy`` and ``linked`` tell what was found."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray):
        """``counts`` of all documents by pattern, ``known`` (pattern, class) of the marked ones among them."""
        votes = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.int64)
        free = np.maximum(counts - known.sum(1), 0)[:, None]
        self.parent = [-1] * len(VOTERS)
        if known.sum(0).min() > 0:
            soft = (known + 0.1 * known.sum(0) / known.sum()) / (known.sum(1) + 0.1)[:, None]
        else:  # voters are trusted where no mark says more
            some = (votes[:, :5].sum(1) > 0).astype(float)
            soft = np.column_stack([1 - (0.02 + 0.9 * some), 0.02 + 0.9 * some])
        for n in range(ROUNDS):
            weight = known + free * soft
            if n == ROUNDS // 4:
                self.parent = self._tree(votes, weight)
            self._estimate(votes, weight)
            soft = self._posterior(votes)
        self.patterns, self.soft = patterns, soft
        total = weight.sum(0)
        self.accuracy = {v: float((weight[votes[:, j] == 1, 1].sum() + weight[votes[:, j] == 0, 0].sum()) / max(total.sum(), 1)) for j, v in enumerate(VOTERS)}
        self.linked = [(VOTERS[p], VOTERS[j]) for j, p in enumerate(self.parent) if p >= 0]

    @staticmethod
    def _tree(votes: np.ndarray, weight: np.ndarray) -> list[int]:
        """The spanning tree of greatest mutual information of votes given the class."""
        m = votes.shape[1]
        info = np.zeros((m, m))
        for y in (0, 1):
            w = weight[:, y] + 1e-12
            n = w.sum()
            one = [(votes == b).astype(float) for b in (0, 1)]
            for a in (0, 1):
                for b in (0, 1):
                    joint = (one[a] * w[:, None]).T @ one[b] / n
                    pa_, pb = (one[a] * w[:, None]).sum(0) / n, (one[b] * w[:, None]).sum(0) / n
                    with np.errstate(divide="ignore", invalid="ignore"):
                        term = joint * np.log(joint / np.outer(pa_, pb))
                    info += n / weight.sum() * np.nan_to_num(term)
        parent, inside = [-1] * m, [0]
        while len(inside) < m:
            rest = [j for j in range(m) if j not in inside]
            p, j = max(((p, j) for p in inside for j in rest), key=lambda e: (info[e], -e[0], -e[1]))
            parent[j] = p
            inside.append(j)
        return parent

    def _estimate(self, votes: np.ndarray, weight: np.ndarray) -> None:
        self.prior = (weight.sum(0) + 1) / (weight.sum() + 2)
        self.rate = np.empty((votes.shape[1], 2, 2))  # of a vote, by the parent's vote and the class
        for j, p in enumerate(self.parent):
            for b in (0, 1):
                rows = votes[:, p] == b if p >= 0 else np.ones(len(votes), bool)
                own = weight[rows]
                whole = (weight * votes[:, [j]]).sum(0) / np.maximum(weight.sum(0), 1e-9)
                self.rate[j, b] = ((own * votes[rows][:, [j]]).sum(0) + 0.5 * (0.02 + 0.96 * whole)) / (own.sum(0) + 0.5)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j, p in enumerate(self.parent):
            rate = self.rate[j][votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)]
            log += np.where(votes[:, [j]] == 1, np.log(rate), np.log(1 - rate))
        log -= log.max(1, keepdims=True)
        out = np.exp(log)
        return out / out.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior((patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.int64))[:, 1]


def trained(rows: np.ndarray, at: np.ndarray, value: np.ndarray, target: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and offset of least logistic loss against soft targets, with a ridge; accelerated gradient steps."""
    n = len(target)
    ahead = lambda w, b: np.bincount(rows, value * w[at], minlength=n) + b
    v = np.random.default_rng(SEED).normal(size=width)
    for _ in range(20):  # the largest curvature
        v = np.bincount(at, value * np.bincount(rows, value * v[at], minlength=n)[rows], minlength=width)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (0.25 * (size + n) + RIDGE)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    w_last, b_last, t = w, b, 1.0
    for _ in range(STEPS):
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        go = (t - 1) / t_next
        wy, by = w + go * (w - w_last), b + go * (b - b_last)
        gap = 1 / (1 + np.exp(-np.clip(ahead(wy, by), -30, 30))) - target
        w_last, b_last = w, b
        w, b, t = wy - step * (np.bincount(at, value * gap[rows], minlength=width) + RIDGE * wy), by - step * gap.sum(), t_next
    return w, b


class Model:
    def __init__(self, terms: Terms, labels: LabelModel, weights: np.ndarray | None, offset: float):
        self.terms, self.labels, self.weights, self.offset = terms, labels, weights, offset

    def score(self, part: pa.RecordBatch) -> np.ndarray:
        if self.weights is None:
            return self.labels.posterior(part.column("votes").to_numpy().astype(np.int64))
        rows, at, value = _flat(part)
        margin = np.bincount(rows, value * self.weights[at], minlength=part.num_rows) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _flat(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, value = part.column("at"), part.column("value")
    sizes = np.array([len(x) for x in at.to_pylist()], np.int64)
    return np.repeat(np.arange(part.num_rows), sizes), at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep: list[str]) -> tuple[Model, DataFrame]:
    """The model, and (``keep``, votes, at, value) of all of ``docs``, stored."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    marks = marks.where((F.col("low") == F.col("high")) & (fold() != 0)).select("doc_id", (F.col("low") >= 1).cast("int").alias("mark"))
    chosen = first_by_hash(marks, MARKED).select(F.col("doc_id").alias("id"), "mark", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).alias("half"))
    chosen = scratch.save(chosen, "chosen")
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # of MARKED rows at most
    sample = scratch.save(marked.groupBy("doc_id", "mark", "half").agg(F.min(text_of()).alias("text")), "sample")
    size = {r.mark: r["count"] for r in sample.groupBy("mark").count().collect()}
    both = size.get(0, 0) > 0 and size.get(1, 0) > 0
    terms = Terms(mined(sample, size[1] / sum(size.values())) if both else [])
    facts = scratch.save(looked(docs, terms, keep), "facts")
    own = scratch.save(looked(sample, terms, ["mark"]), "own")
    every = {r.votes: r["count"] for r in facts.groupBy("votes").count().collect()}  # 2**16 rows at most, as the next
    known = {(r.votes, r.mark): r["count"] for r in own.groupBy("votes", "mark").count().collect()}
    patterns = np.array(sorted({*every, *(v for v, _ in known), 0}), np.int64)
    model = LabelModel(patterns, np.array([every.get(p, 0) for p in patterns.tolist()], float), np.array([[known.get((p, y), 0) for y in (0, 1)] for p in patterns.tolist()], float))
    if not both:
        return Model(terms, model, None, 0.0), facts
    rows = own.select("votes", "at", "value").toArrow().combine_chunks()
    part = rows.to_batches(max_chunksize=max(1, rows.num_rows))[0]
    weights, offset = trained(*_flat(part), model.posterior(part.column("votes").to_numpy().astype(np.int64)), terms.width)
    return Model(terms, model, weights, offset), facts


def toxic_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs``."""
    model, facts = fit(docs, labels, scratch, ["doc_id"])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch), pa.float64())], ["doc_id", "score"])

    scored = facts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
