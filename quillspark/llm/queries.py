"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, media_columns, mixing, near_dedup, piece_tokenizer, quality_rules, secret_scan, suffix_dedup, token_counts, toxicity
from .common import documents

PIECE_MODEL = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokenizer.encode_documents(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL), digests=True)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir), digests=True)


def mixture_levels() -> list:
    """Domain (by number of the source), language and source of a document."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1), F.lit("999999999")).cast("long"), F.lit(0))
    domain = F.element_at(F.array(*map(F.lit, ("web", "books", "code", "reference"))), (F.pmod(number, F.lit(4)) + 1).cast("int"))
    return [domain, F.col("lang"), F.col("source")]


#: Weights of domains and, within each, of languages; a null or further language has its share of the domain's tokens,
#: and the four split the rest. Sources share by size.
MIXTURE = {("web",): 0.4, ("books",): 0.25, ("code",): 0.15, ("reference",): 0.2} | {
    (d, lang): w for d in ("web", "books", "code", "reference") for lang, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1), (mixing.OTHER, 1))
}
MIX_SEED = 20


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.select(documents(spark, sf_dir), MIXTURE, levels=mixture_levels(), budget_share=1.0, max_epochs=4, seed=MIX_SEED, tokenizer=public_tokenizers.path(PIECE_MODEL))
    return chosen.withColumnsRenamed({"level_0": "domain", "level_1": "lang", "level_2": "source"})


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store(documents(spark, sf_dir), digests=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 without its features, so that the payloads can be held against SQL."""
    return media_columns.payloads(documents(spark, sf_dir))


OPERATORS = (op1_quality_rules, op2_sentencepiece, op3_minhash_near_dedup, op4_suffix_dedup, op5_mixing, op6_token_counts, op7_media_columns, op8_license_scan, op9_toxicity, op10_secret_scan)
QUERIES = {f.__name__: f for f in (*OPERATORS, media_payloads)}
#: Queries that SQL can express over whole tables.
SQL = {
    "op1_quality_rules": quality_rules.sql(),
    "op3_minhash_near_dedup": near_dedup.sql(),
    "op4_suffix_dedup": suffix_dedup.sql(),
    "op8_license_scan": license_scan.sql(),
    "op10_secret_scan": secret_scan.sql(),
    "media_payloads": media_columns.sql(),
}
