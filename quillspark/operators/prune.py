"""Score bounds and pruning (MaxScore: Turtle and Flood, 1995; block-max: Ding and Suel, 2011), set at a time.

A lower bound theta of a query's tenth score is the best, over its terms, of multiplicity x the term's own tenth
contribution. A chunk that can't reach theta, even with all other terms at their best, is dropped before scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import TOP

#: Ties to six places must survive.
SLACK = 1e-6


def list_bounds(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_idx, pos, term, max_score, ub): per token occurrence the running sum of bounds, smallest bound first."""
    by = Window.partitionBy("query_idx").orderBy("max_score", "term", "pos").rowsBetween(Window.unboundedPreceding, 0)
    known = tokens.join(lexicon.select("term", "max_score"), "term")
    return known.withColumn("ub", F.sum("max_score").over(by)).select("query_idx", "pos", "term", "max_score", "ub")


def kth_contribution(terms: DataFrame, chunks: DataFrame, k: int = TOP) -> DataFrame:
    """(term, kth): the k-th contribution of each of the queries' terms, 0 with fewer; WindowGroupLimit cuts lists before they move."""
    by = Window.partitionBy("term").orderBy(F.col("contribution").desc())
    wanted = chunks.join(terms.select("term").distinct(), "term", "left_semi")
    best = wanted.select("term", F.explode("contributions").alias("contribution")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    return best.groupBy("term").agg(F.max(F.when(F.col("r") == k, F.col("contribution")).otherwise(F.lit(0.0))).alias("kth"))


def thresholds(terms: DataFrame, chunks: DataFrame, k: int = TOP) -> DataFrame:
    """(query_idx, theta)."""
    return terms.join(kth_contribution(terms, chunks, k), "term").groupBy("query_idx").agg(F.max(F.col("mult") * F.col("kth")).alias("theta"))


def essential_lists(bounds: DataFrame, theta: DataFrame) -> DataFrame:
    """(query_idx, n_lists, n_bounded, n_essential): lists whose running bound passes theta are essential."""
    return bounds.join(theta, "query_idx").groupBy("query_idx").agg(F.count("*").alias("n_lists"), F.count_if(F.col("ub") <= F.col("theta")).alias("n_bounded")).withColumn("n_essential", F.col("n_lists") - F.col("n_bounded"))


def chunk_verdicts(terms: DataFrame, chunks: DataFrame, lexicon: DataFrame, theta: DataFrame) -> DataFrame:
    """Each query's chunks (query_idx, term, mult, n_tokens, chunk_idx, chunk_size, ...) and whether each is ``needed``."""
    known = terms.join(lexicon.select("term", F.col("max_score").alias("term_max")), "term").join(theta, "query_idx")
    total = known.groupBy("query_idx").agg(F.sum(F.col("mult") * F.col("term_max")).alias("ub"))
    reach = F.col("mult") * F.col("max_score").cast("double") + (F.col("ub") - F.col("mult") * F.col("term_max"))
    return chunks.join(known.join(total, "query_idx"), "term").withColumn("needed", reach >= F.col("theta") - SLACK)


def surviving_postings(verdicts: DataFrame) -> DataFrame:
    """(query_idx, mult, contribution, doc_id) of the postings in chunks that are needed; the others are never unpacked.

    A document in a dropped chunk can't be among the best k, so what it lacks here doesn't matter.
    """
    each = F.explode(F.arrays_zip("docids", "contributions")).alias("x")
    return verdicts.where("needed").select("query_idx", "mult", each).select("query_idx", "mult", F.col("x.docids").alias("doc_id"), F.col("x.contributions").alias("contribution"))


def pruned_top(verdicts: DataFrame, k: int = TOP) -> DataFrame:
    """The disjunctive top k from the chunks that are needed."""
    summed = surviving_postings(verdicts).groupBy("query_idx", "doc_id").agg(F.sum(F.col("mult") * F.col("contribution")).alias("score")).where("score > 0")
    rounded = summed.withColumn("score", F.round("score", 6))
    by = Window.partitionBy("query_idx").orderBy(F.col("score").desc(), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_idx", "rank", "doc_id", "score")


def query_cost(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_idx, total_postings): what an exhaustive run would score."""
    return terms.join(lexicon.select("term", "doc_count"), "term").groupBy("query_idx").agg(F.sum(F.col("mult") * F.col("doc_count")).cast("long").alias("total_postings"))


def query_stats(verdicts: DataFrame, terms: DataFrame, lexicon: DataFrame, essential: DataFrame, queries: DataFrame) -> DataFrame:
    """Counters of the set-at-a-time pruning for each query; a query without known terms has zeros."""
    seen = verdicts.groupBy("query_idx").agg(
        F.sum(F.when(F.col("needed"), F.col("mult") * F.col("chunk_size")).otherwise(F.lit(0))).cast("long").alias("postings_kept"),
        F.sum(F.when(F.col("needed"), F.lit(0)).otherwise(F.lit(1))).cast("long").alias("chunks_dropped"),
    )
    joined = queries.select("query_idx").join(seen, "query_idx", "left").join(query_cost(terms, lexicon), "query_idx", "left").join(essential.select("query_idx", "n_essential"), "query_idx", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("query_idx", zero("postings_kept"), zero("total_postings"), zero("n_essential"), zero("chunks_dropped"))


def pruning_summary(stats: DataFrame) -> DataFrame:
    """Totals, share of postings not scored, and mean essential lists of a batch."""
    share = F.when(F.sum("total_postings") > 0, 100.0 * (F.sum("total_postings") - F.sum("postings_kept")) / F.sum("total_postings")).otherwise(F.lit(0.0))
    return stats.agg(F.count("*").alias("n_queries"), F.sum("postings_kept").alias("postings_kept"), F.sum("total_postings").alias("total_postings"), F.round(share, 6).alias("pruned_percent"), F.round(F.avg("n_essential"), 6).alias("mean_essential"), F.sum("chunks_dropped").alias("chunks_dropped"))
