"""Line dedup by overlapping three-line windows, on DataFrame functions only.

Each text is cut at line feeds; every three consecutive lines are hashed; a
window whose three lines occurred before, in the order of (doc_id, position),
is a later occurrence, and the lines that later occurrences cover are removed.

Defined cases: a null text counts as empty; a text under three lines, an empty
text and a row without doc_id stay as they are; rows that repeat a doc_id share
its places in the order, so a repeated row is no later occurrence of itself;
further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_of

WINDOW = 3


def repeated_windows(lines: DataFrame) -> DataFrame:
    """(id, key, at): the windows of ``lines`` (id, key, lines) that occurred before.

    96 bits name a window. The first occurrence is a minimum that each task takes
    before the shuffle; only names that repeat meet the windows again, in a
    sort-merge join whose hot keys adaptive execution splits.
    """
    windows = (
        lines.where(F.col("id").isNotNull() & (F.size("lines") >= WINDOW))
        .select(
            "id", "key",
            F.posexplode(
                F.expr(
                    f"transform(sequence(0, size(lines) - {WINDOW}), i -> named_struct("
                    "'a', xxhash64(lines[i], lines[i + 1], lines[i + 2]), 'b', hash(lines[i], lines[i + 1], lines[i + 2])))"
                )
            ).alias("at", "h"),
        )
        .select("id", "key", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("a", "b", "first")
    )
    return windows.join(first.hint("merge"), ["a", "b"]).where(F.struct("id", "at") > F.col("first")).select("id", "key", "at")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) after removal; plus n_lines and n_removed (with an underscore where ``docs`` has such a column)."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("key"), F.split(text_of(), "\n", -1).alias("lines"))
    starts = repeated_windows(lines).groupBy("id", "key").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    joined = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("key")).join(starts, ["id", "key"], "left")
    parts = joined.withColumn("lines", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))
    # The starts are in order, so what lies between one window's end and the next one's start stays: that merges what windows cover.
    kept = F.expr(
        "case when starts is null then lines else flatten(transform(sequence(0, size(starts)), k -> slice(lines,"
        f" case when k = 0 then 1 else starts[k - 1] + {WINDOW + 1} end,"
        " greatest(0, case when k = size(starts) then size(lines) else starts[k] end"
        f" - case when k = 0 then 0 else starts[k - 1] + {WINDOW} end)))) end"
    )
    done = parts.withColumn("kept", kept)
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    columns = [
        text.alias(c) if c == "text" else F.when(F.col("starts").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(dict(docs.dtypes)[c])).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    n_lines, n_removed = (free_name(c, docs.columns) for c in ("n_lines", "n_removed"))
    return done.select(*columns, F.size("lines").cast("long").alias(n_lines), (F.size("lines") - F.size("kept")).cast("long").alias(n_removed))


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(text_of()).alias("kept_md5"), F.length(text_of()).cast("long").alias("kept_chars"))


ORACLE = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM l),
w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos + 1], ls[pos + 2], ls[pos + 3] ORDER BY doc_id, pos) AS rn
      FROM p WHERE pos <= len(ls) - 3),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM w, (VALUES (0), (1), (2)) AS t(k) WHERE rn > 1),
k AS (SELECT p.doc_id AS doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
      coalesce(string_agg(CASE WHEN c.pos IS NULL THEN p.ls[p.pos + 1] END, chr(10) ORDER BY p.pos), '') AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT doc_id, n_lines, n_removed, md5(kept) AS kept_md5, length(kept) AS kept_chars FROM k
"""
