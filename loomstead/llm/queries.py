"""The queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import fill_in_middle, jaccard_join, mixture, piece_sampling, quality_rules, secret_scan, site_quality, token_alignment, token_counts
from .line_dedup import line_dedup
from .media_columns import media_columns
from .page_wrappers import main_text
from .suffix_dedup import suffix_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "word_index", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), "size", F.round("probability", 6).alias("probability"), "is_secret")


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mixture(table(spark, sf_dir, "documents"), carry=False)
    return out.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("evidence", "host_quality", "path_quality", "quality")]
    return out.select("doc_id", "host", "path", *rounded, "kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), stored=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *quality_rules.COLUMNS)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_mixture": op3_mixture,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_page_wrappers": op5_page_wrappers,
    "op6_site_quality": op6_site_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_media_columns": op9_media_columns,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_mixture": mixture.ORACLE,
    "op6_site_quality": site_quality.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
}
