"""A five-stage corpus pipeline over ``documents``: each stage works on all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm import decontamination, near_dedup, packing, quality, surrogates
from wayspan.llm.common import Scratch, table
from wayspan.llm.queries import surrogate_key, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from all labels of the corpus. A null text is scored as an
    empty one; equal texts get equal scores, so rows that repeat stay or go together."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", quality.score(trees, F.col("text"), spark)).filter("__score >= 0.3").drop("__score")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id. Rows of
    one id with different texts are judged one by one; rows with a null id or no words stay."""
    return near_dedup.deduplicate(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, by id and text; null and empty texts hold none and stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the new text. A null text stays null, with its
    n_chars."""
    d = surrogates.replace_entities(docs, surrogate_key(spark)).drop("n_entities", "kinds")
    return d.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token alone, and of rows with
    one id each is a document."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trees, sketches and tokenizers have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
