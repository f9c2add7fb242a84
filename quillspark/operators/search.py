"""Batches of conjunctive and disjunctive queries, ranked by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.text import snippet, term_counts, tokenize
from ..plans.staging import cut

TOP = 10
AND, OR = 0, 1
#: Distinct query terms up to which they are constants of the scan, and (query, term) rows up to which the weights are
#: broadcast; beyond, joins shuffle.
CONSTANT_TERMS, BROADCAST_ROWS = 2_000, 100_000


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_idx, pos, term): repeated tokens stay."""
    return queries.select("query_idx", F.posexplode(tokenize(F.col("query"))).alias("pos", "term"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_idx, term, mult, n_tokens)."""
    split = queries.select("query_idx", tokenize(F.col("query")).alias("tokens")).where(F.size("tokens") > 0)
    return split.select("query_idx", F.size("tokens").alias("n_tokens"), F.explode(term_counts(F.col("tokens"))).alias("x")).select("query_idx", "x.term", F.col("x.freq").alias("mult"), "n_tokens")


def few(terms: DataFrame) -> list[str] | None:
    """The distinct terms, or None if there are more than may be constants."""
    rows = terms.select("term").distinct().limit(CONSTANT_TERMS + 1).collect()
    return sorted(r.term for r in rows) if len(rows) <= CONSTANT_TERMS else None


def matching(docs: DataFrame, terms: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, pid, freq, length) postings of the terms (None: all), and the statistics of the collection.

    One pass over the texts keeps a row of numbers per passage; both results come from those.
    """
    split = docs.select("doc_id", "pid", tokenize(F.col("text")).alias("tokens"))
    wanted = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(terms)) if terms else F.slice("tokens", 1, 0)
    narrow = cut(split.select("doc_id", "pid", F.size("tokens").alias("length"), term_counts(wanted).alias("hits")))
    stats = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_len"))
    stats = stats.withColumn("avg_len", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))
    hits = narrow.where(F.size("hits") > 0).select("doc_id", "pid", "length", F.explode("hits").alias("x"))
    return hits.select("x.term", "doc_id", "pid", "x.freq", "length"), stats


def scores(postings: DataFrame, stats: DataFrame, terms: DataFrame, mode: int) -> DataFrame:
    """(query_idx, doc_id, pid, score) of every passage with a positive score."""
    n, _, average = stats.first()
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(counts, "term").withColumn("idf", ranking.idf(F.lit(float(n)), F.col("df"))).select("query_idx", "term", "mult", "n_tokens", "idf")
    weights = F.broadcast(weights) if terms.count() <= BROADCAST_ROWS else weights
    share = ranking.contribution(F.col("idf"), F.col("freq"), F.col("length"), F.lit(float(average)))
    each = postings.join(weights, "term").withColumn("share", F.col("mult") * share)
    summed = each.groupBy("query_idx", "doc_id", "pid").agg(F.sum("share").alias("score"), F.sum("mult").alias("found"), F.max("n_tokens").alias("n_tokens"))
    if mode == AND:
        summed = summed.where("found = n_tokens")
    return summed.where("score > 0").select("query_idx", "doc_id", "pid", "score")


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """(query_idx, rank, doc_id, pid, score): the best k by score to six places, then doc_id."""
    by = Window.partitionBy("query_idx").orderBy(F.col("score").desc(), "doc_id")
    rounded = scored.withColumn("score", F.round("score", 6))
    return rounded.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_idx", "rank", "doc_id", "pid", "score")


def search(docs: DataFrame, queries: DataFrame, mode: int, k: int = TOP) -> DataFrame:
    """Top passages of each query straight from a collection."""
    terms = cut(query_terms(queries))
    found, stats = matching(docs, few(terms))
    return top(scores(found, stats, terms, mode), k)


def search_index(postings: DataFrame, passages: DataFrame, stats: DataFrame, queries: DataFrame, mode: int, k: int = TOP) -> DataFrame:
    """Top passages from a stored index: only row groups that may hold the query's terms are read, and only the best
    get their passage id."""
    terms = cut(query_terms(queries))
    wanted = few(terms)
    found = postings.where(F.col("term").isin(wanted)) if wanted is not None else postings.join(terms.select("term").distinct(), "term", "left_semi")
    best = top(scores(found.withColumn("pid", F.lit(0).cast("long")), stats, terms, mode), k).drop("pid")
    return best.join(passages.select("doc_id", "pid"), "doc_id").select("query_idx", "rank", "doc_id", "pid", "score")


def with_snippets(results: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Results with the marked window of each passage; few rows per query meet the texts."""
    terms = queries.select("query_idx", F.array_distinct(tokenize(F.col("query"))).alias("terms"))
    joined = results.join(docs.select("doc_id", "text"), "doc_id", "left").join(terms, "query_idx")
    return joined.withColumn("snippet", snippet(F.col("text"), F.col("terms"))).drop("text", "terms")
