"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
folder that all executors share and reads it again for the next. All but the last return the columns
of documents.

1. quality          documents that fail the word rules or leave their language's perplexity band go
2. line_dedup       later copies of passages of three lines or more go; documents left without text go
3. near_duplicates  of texts with a Jaccard similarity of 0.8 or more one stays, by smallest id
4. secrets          secrets are masked in the text
5. packing          texts become token sequences of at most 4096
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from twinmark.llm import jaccard, linededup, packing, quality, secrets
from twinmark.llm.common import fresh_path, remove

TOKENIZER = os.path.join(os.environ.get("TWINMARK_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter(docs, quality.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.filter(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages' models and tokenizer have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. A stage's table goes when the next one is written, the last
    table when the pieces are: packing keeps those in the checkpoint folder and doesn't read texts again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return packed
