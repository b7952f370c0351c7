"""Hard negatives: the best of other labels within a window below a positive's score.

Components become floor(256 * x), so scores are integers. Anchors are the rows whose
vec_id ``ANCHOR_EVERY`` divides. An anchor's positives are its best ``K`` other rows of
its label; for each, the negatives are the best ``K`` rows of other labels whose score
is at least 80 % of the positive's and at most the same. Both searches go through
inverted lists (see ``inverted_lists``): first the lists of the highest bound, then
all others that reach into a window and don't end below the k-th score so far.

Before, a row whose vec_id ``SHIFT_EVERY`` divides takes the label (label + 1) % 10.

Defined cases: rows without vec_id or label take no part, nor do vectors that are
null, empty or hold nulls or non-finite numbers; vectors meet those of their own
length only; rows that repeat a vec_id are rows of their own: each is an anchor and each
a candidate of the other; ties go to the smaller vec_id, then to either row of an
equal vec_id; where a positive's score is negative no negative fits; scores beyond 64
bits are held at the limit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inverted_lists import LEAST, MOST, PIECE_ROWS, Lists, numbered, search
from .shared import Scratch, table

K, ANCHOR_EVERY, SHIFT_EVERY, LABELS = 5, 100, 7, 10


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def shifted(embeddings: DataFrame) -> DataFrame:
    kind = embeddings.schema["label"].dataType
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast(kind)
    return embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", label.alias("label"), "embedding")


def mine(embeddings: DataFrame, scratch: Scratch, anchor_every: int = ANCHOR_EVERY, piece_rows: int = PIECE_ROWS, lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = scratch.save(numbered(shifted(embeddings), quantise), "rows")
    index = Lists(rows, scratch, piece_rows, lists)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    window = lambda least, most: F.struct(F.lit(least).cast("long").alias("least"), most.cast("long").alias("most"), F.lit(LEAST).cast("long").alias("floor"))
    positives = scratch.save(search(index, anchors.withColumn("windows", F.array(window(LEAST, F.lit(MOST)))), K, True, "positives"), "positives")
    # the least whole number of at least 80 % of the score, without a product that could overflow
    kept = positives.where("score >= 0").withColumn("least", F.expr("score - score div 5"))
    wanted = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "least", "score"))).alias("p"))  # K at most
    windows = F.transform("p", lambda p: F.struct(p["least"].alias("least"), p["score"].alias("most"), F.lit(LEAST).cast("long").alias("floor")))
    queries = scratch.save(anchors.join(wanted, "row").select("row", "dim", F.col("vec_id").alias("anchor_id"), "label", "vec", "p", windows.alias("windows")), "queries")
    negatives = search(index, queries, K, False, "negatives")
    of = F.get("p", F.col("window"))
    return negatives.join(queries.select("row", "anchor_id", "p"), "row").select(
        "anchor_id", of["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), Scratch(spark))


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
