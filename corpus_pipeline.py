"""From raw documents to token ids: the corpus pipeline.

Each stage reads what its predecessor wrote.  Filters take effect: documents
that a stage rejects, lines that it drops and copies that it leaves out are not
in its output.  The last stage adds the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import line_dedup, mixing, quality, sentencepiece, shingle_join
from lanewright.llm._state import Scratch, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labeller keep."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated line stays only in the first document that holds it."""
    done = line_dedup.line_dedup(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return shingle_join.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    model = mixing.train(docs, read_table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return mixing.mixed(docs, model, mixing.TARGETS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return sentencepiece.encode(docs, sentencepiece.model_bytes())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix_domains),
    ("SentencePiece", tokenize),
]

#: Trained models and rates are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written before the next reads it."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.cut(docs)
    return docs
