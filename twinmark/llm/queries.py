"""The thin queries over the operators of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from twinmark.llm import clusters, jaccard, langid, linededup, packing, piecebpe, pii, quality, resample, secrets, tokenbin, topk, windowdedup

TOKENIZERS = os.environ.get("TWINMARK_TOKENIZERS", "/opt/tokenizers")
"""Folder of the public tokenizer files; must be there on every executor."""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, with_counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = tokenbin.write(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return tokenbin.read_back(spark, at)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "pages"), langid.train(_read(spark, sf_dir, "documents")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_read(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.encode(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.assess(_read(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowdedup.assess(_read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    **{f.__name__: f for f in (op1_best_fit_packing, op2_secret_scans, op3_line_dedup, op4_token_files, op5_quality_rules, op6_language_id, op7_personal_data, op8_exact_top_k, op9_ngram_jaccard_join, op10_piece_encoding, op11_centroid_clustering, op12_substring_dedup, op13_importance_resampling)},
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": linededup.SQL,
    "op9_ngram_jaccard_join": jaccard.SQL,
    "op11_centroid_clustering": clusters.SQL,
    "op12_substring_dedup": windowdedup.SQL,
    "op8_exact_top_k": """
        with v as materialized (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings where embedding is not null and vec_id is not null
        ), s as (
            select a.row, a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
            from v a join v b on a.row <> b.row where a.vec_id % 50 = 0
        ), r as (
            select *, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
}
