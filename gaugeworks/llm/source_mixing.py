"""Mixing sources to target weights by Poisson replication, on DataFrame functions only.

Every source gets a mean repetition rate, expansion * N * weight / n_source; a
document's number of copies is the inverse of that Poisson distribution at a
uniform number from a seeded hash of its doc_id; the copies are dealt out and
ordered by another seeded hash, which shuffles the whole corpus.

Defined cases: a null source is a source of its own; a null doc_id hashes as an
empty one; rows that repeat a doc_id get equal counts; a source whose weight is
0 or that ``targets`` omits vanishes; an empty table gives an empty one; further
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: Rates of up to so many sources (4 KB each at most) are broadcast, after a count; beyond it they are joined
#: under so many salts, so that a hot source's documents spread over as many keys.
FEW_SOURCES, SALTS = 2_000, 64
#: A larger rate is drawn as several independent parts: exp(-rate) must not vanish.
LARGEST_PART = 256.0
BITS = 52


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def rates(docs: DataFrame, targets: dict[str | None, float] | None = None, expansion: float = 1.0, power: float = 0.5) -> DataFrame:
    """(source, rate, parts, cdf), a row per source. Without ``targets`` a source's weight is its count to ``power``."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighted = counts.withColumn("weight", F.sqrt("n") if power == 0.5 else F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "key string, weight double")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    total = counts.agg(F.sum("n").alias("all_n")).crossJoin(weighted.agg(F.sum("weight").alias("all_w")))  # one row each
    rated = weighted.crossJoin(total).select("source", (F.lit(float(expansion)) * F.col("all_n") * (F.col("weight") / F.col("all_w")) / F.col("n")).alias("rate"))
    part = F.expr(f"rate / greatest(1, ceil(rate / {LARGEST_PART}))")
    cdf = F.expr(
        "aggregate(sequence(1, cast(ceil(part + 12 * sqrt(part) + 30) as int)),"
        " named_struct('p', exp(-part), 'c', exp(-part), 'all', array(exp(-part))),"
        " (s, k) -> named_struct('p', s.p * part / k, 'c', s.c + s.p * part / k, 'all', array_append(s.all, s.c + s.p * part / k)),"
        " s -> s.all)"
    )
    return rated.withColumn("part", part).select("source", "rate", F.expr(f"cast(greatest(1, ceil(rate / {LARGEST_PART})) as int)").alias("parts"), cdf.alias("cdf"))


def mix_sources(docs: DataFrame, targets: dict[str | None, float] | None = None, *, expansion: float = 1.0, power: float = 0.5, seed: int = 20240) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in a shuffled order; plus ``replica`` (from 1) and ``shuffle_key`` (with an underscore where ``docs`` has such a column)."""
    table = rates(docs, targets, expansion, power).select(F.col("source").alias("rate_source"), "parts", "cdf")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("source").alias("by"))
    same = F.col("by").eqNullSafe(F.col("rate_source"))
    if docs.select("source").distinct().limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        drawn = rows.join(F.broadcast(table), same)
    else:
        table = table.withColumn("salt_2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(table, same & (F.col("salt") == F.col("salt_2")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.lit("n"), "id", j.cast("string")))),
    )
    one = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    drawn = drawn.withColumn("u", uniform(seed, F.lit("n"), "id", F.lit("1"))).withColumn("copies", F.when(F.col("parts") == 1, one).otherwise(draw))
    copies = drawn.where("copies > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("replica"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("s"), "id", F.col("replica").cast("string"))))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns], *(F.col(c).alias(free_name(c, docs.columns)) for c in ("replica", "shuffle_key")))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table, text_of

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "replica", "shuffle_key", F.md5(text_of()).alias("text_md5"))


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * (sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n)) / n AS rate FROM n),
q AS (SELECT source, rate, greatest(1, ceil(rate / 256.0::DOUBLE))::INT AS parts, rate / greatest(1, ceil(rate / 256.0::DOUBLE)) AS part FROM r),
c AS (WITH RECURSIVE t AS (
        SELECT source, parts, part, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM q
        UNION ALL
        SELECT source, parts, part, k + 1 AS k, p * part / (k + 1) AS p, c + p * part / (k + 1) AS c FROM t WHERE k < ceil(part + 12 * sqrt(part) + 30))
      SELECT source, parts, list(c ORDER BY k) AS cdf FROM t GROUP BY source, parts),
d AS (SELECT d.doc_id AS doc_id, d.source AS source, md5(coalesce(d.text, '')) AS text_md5, c.cdf AS cdf, unnest(range(1, c.parts + 1)) AS j,
      coalesce(d.doc_id::VARCHAR, '') AS id FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
m AS (SELECT doc_id, source, text_md5, id,
      sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('20240|n|' || id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))::INT AS copies
      FROM d GROUP BY doc_id, source, text_md5, id)
SELECT doc_id, source, e::INT AS replica, md5('20240|s|' || id || '|' || e) AS shuffle_key, text_md5
FROM (SELECT *, unnest(range(1, copies + 1)) AS e FROM m)
"""
