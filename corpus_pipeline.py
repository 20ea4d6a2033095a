"""Training-text pipeline: each stage works on the documents its predecessor kept.

Language ID drops texts without a letter, toxicity drops toxic texts, the n-gram Jaccard join keeps one text of
each near-duplicate class (five words, similarity 0.8), decontamination drops texts that hold a benchmark item,
and BPE gives token counts and digests of what is left. Learned stages learn from labelled rows only (toxicity:
those whose checksum rule does not hold them out) and judge every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, jaccard_join, langid, learning, queries, toxicity
from tickloom.llm.common import table
from tickloom.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs, langid.learn(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = learning.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", queries.not_held_out(), toxicity.PER_CLASS)
    return toxicity.clean(docs, toxicity.train(*sample))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, k=5, num=8, den=10)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("toxicity", not_toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("tokens", tokens)]
ORACLE_SQL = None  # the trained stages are no SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
