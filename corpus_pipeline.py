"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. quality rules: documents that the rules reject go;
2. line dedup: repeated blocks go from later documents, and documents of which nothing is left;
3. n-gram Jaccard join: one document of each group of near copies stays (five words, 0.8);
4. mixing to target weights: documents are drawn by calibrated probabilities;
5. SentencePiece encoding: the pieces of every document, decoded again as a check.

All but the last return the columns of `documents`. Nulls, empty texts, repeated rows, empty tables and extra
columns are treated as the operators' docstrings say; extra columns are carried along by stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import jaccard_join, line_dedup, mixture, piece_sampling, quality_rules
from loomstead.llm.common import cut

#: Expected share of the tokens that the fourth stage draws.
BUDGET = 0.7


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.sampled(docs, budget=BUDGET)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing to target weights", mixture_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: Patience diff and lattice sampling have no SQL form; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
