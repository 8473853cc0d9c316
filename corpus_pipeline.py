"""Corpus pipeline: stages over whole tables of documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail.llm import decontaminate, lines, mixing, ngram_join, toxicity
from rowtrail.llm.common import stored, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded above 0 go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model).where("not toxic").select(*DOCUMENT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines go; the number of characters follows the text."""
    cleaned = lines.line_dedup(docs.select(*DOCUMENT))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs).select(*DOCUMENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document enters the mix."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram join", drop_near_copies),
          ("decontamination", drop_leaks), ("mixing", mix_sources)]
#: The toxicity model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
