"""Audits of an index, and latency statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.text import let, tokenize
from ..plans.ordinals import with_ordinal
from ..plans.staging import cut
from .index import CHUNK, FILE_HEAD, only, with_next


def audited_terms(lexicon: DataFrame, explicit: Sequence[str], stride: int = 89) -> DataFrame:
    """The explicit terms that exist and every stride-th term in order."""
    if stride < 1:
        raise ValueError("stride must be positive")
    sampled = with_ordinal(lexicon.select("term"), ["term"], "n").where(F.pmod("n", F.lit(stride)) == 0).select("term")
    return lexicon.where(F.col("term").isin(list(explicit))).select("term").union(sampled).distinct()


def bound_audit(chunks: DataFrame, scored: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row: postings checked against their chunk's bound, violations, and least and most slack."""
    bounds = chunks if terms is None else chunks.join(terms, "term", "left_semi")
    each = bounds.select("term", "max_score", F.explode("docids").alias("doc_id")).join(scored.select("term", "doc_id", "contribution"), ["term", "doc_id"])
    slack = F.col("max_score").cast("double") - F.col("contribution")
    checked = each.select(slack.alias("slack"))
    return checked.agg(F.count("*").alias("n_checked"), F.count_if(F.col("slack") < 0).alias("violations"), F.round(F.min("slack"), 5).alias("min_slack"), F.round(F.max("slack"), 5).alias("max_slack"))


def monotonic_audit(chunks: DataFrame) -> DataFrame:
    """One row: chunks, and those whose doc_ids don't strictly increase, within or up to the next one, or that are short before a next one."""
    inside = F.sort_array(F.array_distinct("docids")) != F.col("docids")
    edges = cut(chunks.select("term", "chunk_idx", "chunk_size", "last_docid", F.element_at("docids", 1).alias("first"), inside.alias("inside")))
    pairs = with_next(edges, F.col("first").alias("after"))
    bad = F.col("inside") | F.coalesce(F.col("after") <= F.col("last_docid"), F.lit(False))
    short = F.col("after").isNotNull() & (F.col("chunk_size") != CHUNK)
    return pairs.select(bad.alias("bad"), short.alias("short")).agg(F.count("*").alias("n_chunks"), F.count_if("bad").alias("violations"), F.count_if("short").alias("short_chunks"))


def max_score_audit(lexicon: DataFrame, docs: DataFrame, terms: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(term, doc_count, max_score, ok) of spot terms that the lexicon or the collection has, scored anew from the collection's texts."""
    known = F.array(*map(F.lit, terms))
    split = docs.select(tokenize(F.col("text")).alias("tokens"))
    # Only the spot terms' own tokens, few of all, are compared with each of them.
    each = let(only(F.col("tokens"), terms), lambda own: F.transform(known, lambda t: F.size(F.filter(own, lambda x: x == t)).cast("long")))
    seen = cut(split.select(F.size("tokens").alias("length"), each.alias("freqs")))
    n, total = seen.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    spots = seen.select("length", F.explode(F.arrays_zip(known.alias("term"), F.col("freqs").alias("freq"))).alias("x")).select("length", "x.term", "x.freq").where("freq > 0")
    df = F.count("*").alias("df")
    weighed = spots.join(F.broadcast(spots.groupBy("term").agg(df)), "term")  # a row per spot term
    share = ranking.contribution(ranking.idf(F.lit(float(n)), F.col("df")), F.col("freq"), F.col("length"), F.lit(total / n if n else 0.0))
    fresh = weighed.groupBy("term", "df").agg(F.max(share).alias("best"))
    near = F.abs(F.col("best") - F.col("max_score")) <= tolerance * F.greatest(F.lit(1.0), F.abs("best"))
    both = lexicon.where(F.col("term").isin(list(terms))).join(fresh, "term", "full")
    return both.select("term", "doc_count", F.round("max_score", 6).alias("max_score"), F.coalesce((F.col("df") == F.col("doc_count")) & near, F.lit(False)).alias("ok"))


def collection_mismatch(passages: DataFrame, stats: DataFrame, docs: DataFrame) -> str | None:
    """What tells an index from the collection that it should be of: numbers of passages, their lengths, or the average."""
    lengths = docs.select("doc_id", F.size(tokenize(F.col("text"))).alias("now"))
    joined = passages.select("doc_id", "length").join(lengths, "doc_id", "full")
    rows, kept, total, other = joined.agg(F.count("now"), F.count("length"), F.coalesce(F.sum("now"), F.lit(0)), F.min(F.when(~F.col("length").eqNullSafe(F.col("now")), F.col("doc_id")))).first()
    n, total_len, average = stats.select("n", "total_len", "avg_len").first()
    if rows != kept or n != rows:
        return f"the collection has {rows} passages, the index {kept} of {n}"
    if other is not None:
        return f"passage {other} differs in length"
    if total != total_len or abs(average * n - total) > 1e-9 * max(total, 1):
        return "the average length is wrong"
    return None


def latency_stats(timings: DataFrame, column: str = "ms") -> DataFrame:
    """Nearest-rank percentiles, mean, least and most of a column of times."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return timings.agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg(column), 6).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))


def index_summary(stats: DataFrame, lexicon: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: passages, tokens, terms, postings and chunks."""
    parts = [
        stats.select("n", "total_len"),
        lexicon.agg(F.count("*").alias("n_terms"), F.sum("doc_count").cast("long").alias("n_postings"), (F.coalesce(F.sum("length"), F.lit(0)) + FILE_HEAD).cast("long").alias("packed_bytes")),
        chunks.agg(F.count("*").alias("n_chunks")),
    ]
    names = [c for x in parts for c in x.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in names))
