"""The corpus pipeline: quality rules, near-dedup, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes what a stage
returns as Parquet to the cluster's shared folder and reads it again for the next. All stages but the last
return the columns of ``docs``, which has doc_id, text, lang and source at least, whatever else is there.

Edge cases: a null or empty text has too few words for the quality rules and goes there; a row without doc_id is
linked with nothing and otherwise treated like any other; a null lang or source is a value of its own; repeated rows stay
or go together in near-dedup and the mixture; n_chars follows the text where secrets are replaced; a stage given
an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, near_dedup, piece_tokenizer, quality_rules, queries, secret_scan
from quillspark.plans.staging import new_folder, remove

#: Share of the tokens that reach the mixing stage which the mixture may spend, each document once at most.
BUDGET_SHARE = 0.9
#: Near copies from 80 % on; a link at exactly that shares no band with probability 6.7e-6.
NEAR = {"least_percent": 80, "bands": 30, "rows": 5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs, **NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by their kind."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the target weights, in tokens of the encoding's vocabulary, leave room for."""
    tokenizer = public_tokenizers.path(queries.PIECE_MODEL)
    return mixing.mixed(docs, queries.MIXTURE, levels=queries.mixture_levels(), budget_share=BUDGET_SHARE, seed=queries.MIX_SEED, tokenizer=tokenizer)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return piece_tokenizer.encode_documents(docs, public_tokenizers.path(queries.PIECE_MODEL), digests=True)


STAGES = [("quality rules", quality), ("near-dedup", near_duplicates), ("secret scans", secrets), ("mixing", mixture), ("encoding", encoding)]
#: SQL can't express the tokenizer's stage; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    folder = new_folder(spark, "pipeline")  # its last part goes when the driver ends, as the result reads it
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
