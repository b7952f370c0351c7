"""The corpus pipeline: quality, repeated lines, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of ``documents``. ``run`` writes each stage's result
to the shared folder and reads it again for the next, which cuts the lineage:
an executor lost later costs the stage it was in.

No SQL states the first, third and last stage, so ``ORACLE_SQL`` is None; the
tests hold each stage against a brute-force version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import bpe_lexicon, line_dedup, quality_pu, source_mixing, weighted_minhash
from gaugeworks.llm.shared import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the positive-unlabelled classifier rejects."""
    return quality_pu.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeated three-line windows cover; n_chars follows."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least doc_id."""
    return weighted_minhash.keep_one(docs, Scratch(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their tempered weights, in a shuffled order."""
    return source_mixing.mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and the digests of ids and decoded text; all columns but the text stay, whatever their names."""
    keep = tuple(c for c in docs.columns if c != "text")
    return bpe_lexicon.encode_documents(docs, bpe_lexicon.default_tokenizer(), keep=keep, with_decoded=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
