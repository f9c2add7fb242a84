"""The inverted index as tables: passages, statistics, postings, chunks and lexicon.

A collection is a table of (doc_id, pid, text) with unique doc_id. Term frequencies come from each row's own
tokens, so postings are made without a shuffle; a posting carries its passage's length, so scoring joins no
passage table. A term may be in most passages: its postings are spread over many partitions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking, varbyte
from ..functions.text import n_tokens, run_freq, run_term, term_counts, term_runs, tokenize
from ..plans.ordinals import with_ordinal, with_running_sum
from ..plans.staging import cut

CHUNK = 64
#: Passages whose postings of a term make one list, and most blocks; beyond 2^25 passages blocks grow.
BLOCK, BLOCKS = 1 << 17, 256
#: Passages, about, from which it is guessed which terms have more than one block's postings.
SAMPLED = 1_000
#: Bytes of the file header and of each term's and chunk's header in the packed layout.
FILE_HEAD, TERM_HEAD, CHUNK_HEAD = 4, 4, 20


def collection(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, pid, text) of a table whose ids are unique whole numbers."""
    key = F.col(id_column).cast("long")
    return docs.select(key.alias("doc_id"), key.alias("pid"), F.col(text_column).alias("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pid, tokens)."""
    return docs.select("doc_id", "pid", tokenize(F.col("text")).alias("tokens"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, pid, length): passages numbered densely in the order of doc_id."""
    lengths = docs.select(F.col("doc_id").alias("_key"), "pid", F.size(tokenize(F.col("text"))).alias("length"))
    return with_ordinal(lengths, ["_key"], "doc_id").select("doc_id", "pid", "length")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, total_len and avg_len (0 for no passages) of a table with ``length``."""
    n, total = F.count("*"), F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    return lengths.agg(n.alias("n"), total.alias("total_len")).withColumn("avg_len", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))


def only(tokens: Column, terms: Sequence[str] | None) -> Column:
    """The tokens that are among ``terms`` (None: all)."""
    return tokens if terms is None else F.filter(tokens, lambda t: t.isin(list(terms))) if terms else F.slice(tokens, 1, 0)


def postings(docs: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """(term, doc_id, freq, length) of a collection, of all or of some terms, narrow: one pass over the texts."""
    split = tokens(docs)
    # The outer form: for the inner one the optimizer puts filters before it that compute the array again.
    runs = split.select("doc_id", F.size("tokens").alias("length"), F.explode_outer(term_runs(only(F.col("tokens"), terms))).alias("run"))
    return runs.where("run is not null").select(run_term(F.col("run")).alias("term"), "doc_id", run_freq(F.col("run")).alias("freq"), "length")


def counted(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, length, hits) of every passage, ``hits`` its counts of some terms, staged: one pass over the texts, rows of numbers."""
    return cut(tokens(docs).select("doc_id", F.size("tokens").alias("length"), term_counts(only(F.col("tokens"), terms)).alias("hits")))


def postings_of(narrow: DataFrame) -> DataFrame:
    """``postings`` of ``counted`` passages."""
    hits = narrow.where(F.size("hits") > 0).select("doc_id", "length", F.explode("hits").alias("x"))
    return hits.select("x.term", "doc_id", "x.freq", "length")


def terms_of(docs: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """(term): each passage's distinct terms, of all or of some; what document frequencies need, without counts in passages."""
    return tokens(docs).select(F.explode_outer(F.array_distinct(only(F.col("tokens"), terms))).alias("term")).where("term is not null")


def doc_freq(found: DataFrame) -> DataFrame:
    """(term, doc_count) of postings, or of ``terms_of`` passages."""
    return found.groupBy("term").agg(F.count("*").alias("doc_count"))


def contributions(found: DataFrame, stats: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Postings with doc_count (from ``counts``, if they are there already) and each one's share of its passage's score; the join on
    term is left to AQE, which splits hot terms."""
    n, _, average = stats.first() or (0, 0, 0.0)
    weighted = (doc_freq(found) if counts is None else counts).withColumn("idf", ranking.idf(F.lit(float(n)), F.col("doc_count")))
    share = ranking.contribution(F.col("idf"), F.col("freq"), F.col("length"), F.lit(float(average)))
    return found.join(weighted, "term").withColumn("contribution", share)


def outline(docs: DataFrame) -> tuple[DataFrame, list[int], Packing | None]:
    """Statistics of a collection, kept on the driver, the ids at which its blocks begin, and its packing: one pass over the texts."""
    return outline_of(docs.select("doc_id", n_tokens(F.col("text")).alias("length")))


def outline_of(sized: DataFrame) -> tuple[DataFrame, list[int], Packing | None]:
    """``outline`` of a table with doc_id and length."""
    n, total, edges, packed = _measured(sized)
    row = (n, total, total / n if n else 0.0)
    return sized.sparkSession.createDataFrame([row], "n long, total_len long, avg_len double"), edges, packed


def block_edges(ids: DataFrame) -> list[int]:
    """Ids at which blocks begin, of a table with doc_id."""
    return _measured(ids.select("doc_id", F.lit(0).alias("length")))[2]


def _measured(sized: DataFrame) -> tuple[int, int, list[int], Packing | None]:
    marks = F.percentile_approx("doc_id", [i / BLOCKS for i in range(1, BLOCKS)], F.lit(BLOCKS * 16))
    n, total, at, *bounds = sized.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)).cast("long"), marks, F.min("doc_id"), F.max("doc_id"), F.max("length")).first()
    k = min(BLOCKS, -(-n // BLOCK))
    return n, total, sorted({at[i * BLOCKS // k - 1] for i in range(1, k)}), _packing(*bounds)


class Packing(NamedTuple):
    """How a posting is one number, in the order of doc_id: the id less ``low``, then frequency and length of ``width`` bits each."""

    low: int
    width: int

    def entry(self) -> Column:
        return F.shiftleft(F.col("doc_id") - self.low, 2 * self.width).bitwiseOR(F.shiftleft(F.col("freq").cast("long"), self.width)).bitwiseOR(F.col("length").cast("long"))


def _packing(low: int | None, high: int | None, most: int | None) -> Packing | None:
    width = (most or 0).bit_length()
    return Packing(low, width) if low is not None and (high - low).bit_length() + 2 * width <= 63 else None


def _parts(x: Column, each, kind: str) -> tuple[Column, Column, Column]:
    """doc_id, freq and length of an entry, or of an array of them if ``each`` is F.transform; ``kind`` is the type of ``x`` in lists."""
    if kind != "array<bigint>":
        return x["doc_id"], x["freq"], x["length"]
    low, width = F.col("low"), F.col("width")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    return (
        each(x, lambda v: F.call_function("shiftrightunsigned", v, width * 2) + low),
        each(x, lambda v: F.call_function("shiftright", v, width).bitwiseAND(mask).cast("int")),
        each(x, lambda v: v.bitwiseAND(mask).cast("int")),
    )


def postings_of_lists(blocks: DataFrame, *more: str) -> DataFrame:
    """(term, doc_id, freq, length) of ``lists``, and columns of the list."""
    kind = dict(blocks.dtypes)["x"]
    doc_id, freq, length = _parts(F.col("y"), lambda x, f: f(x), kind)
    return blocks.select("term", "low", "width", *more, F.explode_outer("x").alias("y")).select("term", *more, doc_id.alias("doc_id"), freq.cast("long").alias("freq"), length.alias("length"))


def long_terms(docs: DataFrame, edges: Sequence[int]) -> list[str] | None:
    """Terms that may have more postings than a block has passages, guessed from passages chosen by a hash of their id. A guess decides
    which lists are kept in blocks, so how work is spread, and nothing else. None, all terms, where there is but one block."""
    if not edges:
        return None
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLED))) == 0).select("doc_id", "pid", "text")
    taken, least = some.count(), 0.5 / (len(edges) + 1)  # half a block's share, as it is a guess
    return sorted(r.term for r in doc_freq(terms_of(some)).where(F.col("doc_count") >= least * taken).collect())


def _block(edges: Sequence[int]) -> Column:
    """Number of the edges at or below doc_id, by halves."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < edges[middle], pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(edges))


def lists(found: DataFrame, edges: Sequence[int], long: Sequence[str] | None = None, packed: Packing | None = None) -> DataFrame:
    """(term, block, x, low, width) of postings, staged: lists of the ``long`` terms (None: all) in blocks of ids, others whole, as block 0.
    ``x`` holds a list's postings by id, as numbers if they are ``packed``. The only time that all postings move."""
    entry = packed.entry() if packed else F.struct("doc_id", F.col("freq").cast("int").alias("freq"), F.col("length").cast("int").alias("length"))
    block = _block(edges) if long is None else F.when(F.col("term").isin(list(long)), _block(edges)).otherwise(F.lit(0)) if long else F.lit(0)
    met = found.select("term", block.alias("block"), entry.alias("x")).groupBy("term", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    low, width = packed or (0, 0)
    return cut(met).select("*", F.lit(low).cast("long").alias("low"), F.lit(width).alias("width"))


def placed(blocks: DataFrame, edges: Sequence[int], long: Sequence[str] | None = None) -> DataFrame:
    """``lists`` with the term's postings in the blocks before, and in all. Lists move for it only if those of all terms are in blocks."""
    sized = blocks.withColumn("n", F.size("x").cast("long"))
    if not edges or long is not None and not long:
        return sized.select("*", F.lit(0).cast("long").alias("before"), F.col("n").alias("doc_count")).drop("block")
    by = Window.partitionBy("term")  # a row per block that a term is in
    before = F.coalesce(F.sum("n").over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = sized if long is None else sized.where(F.col("term").isin(list(long)))
    counts = split.select("term", "block", "n").select("term", "block", before.alias("before"), F.sum("n").over(by).alias("doc_count"))
    if long is None:
        return sized.join(counts, ["term", "block"])
    whole = F.coalesce("before", F.lit(0)).cast("long"), F.coalesce("doc_count", "n")
    return sized.join(F.broadcast(counts), ["term", "block"], "left").withColumns({"before": whole[0], "doc_count": whole[1]})


def contributions_of(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, doc_id, contribution) of the postings of ``placed`` lists, each scored by itself."""
    n, _, average = stats.first() or (0, 0, 0.0)
    each = postings_of_lists(blocks.select("*", ranking.idf(F.lit(float(n)), F.col("doc_count")).alias("idf")), "idf")
    share = ranking.contribution(F.col("idf"), F.col("freq"), F.col("length"), F.lit(float(average)))
    return each.select("term", "doc_id", share.alias("contribution"))


def chunks(found: DataFrame, stats: DataFrame, edges: Sequence[int] | None = None) -> DataFrame:
    """Runs of 64 postings of a term by doc_id, with bounds, byte sizes of the gap and frequency codes, and their arrays.

    Postings are gathered once, by term and block of ids (``edges``; sought in the postings if not given). Places and document
    frequencies come from a table of (term, block) counts; only chunks that begin in one block and end in a later one meet again.
    """
    edges = block_edges(found) if edges is None else edges
    return chunks_of(placed(lists(found, edges), edges), stats)


def chunks_of(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """Chunks of ``placed`` lists."""
    n, _, average = stats.first() or (0, 0, 0.0)
    end, size = F.col("before") + F.col("n"), F.lit(CHUNK).cast("long")
    first, last = F.call_function("div", F.col("before"), size), F.call_function("div", end - 1, size)
    weighed = blocks.select("*", ranking.idf(F.lit(float(n)), F.col("doc_count")).alias("idf"))
    low, high = F.greatest(F.col("at") * CHUNK - F.col("before"), F.lit(0)).cast("int"), F.least((F.col("at") + 1) * CHUNK - F.col("before"), F.col("n")).cast("int")
    pieces = lambda df, numbers: df.select("*", F.explode(numbers).alias("at")).select("term", F.col("at").cast("int").alias("chunk_idx"), "idf", "low", "width", F.slice("x", low + 1, high - low).alias("x"))
    # Chunks that a block holds only a part of are its first, its last, or both.
    begun, goes_on = F.col("before") % CHUNK != 0, (end % CHUNK != 0) & (end < F.col("doc_count"))
    whole_from, whole_to = first + begun.cast("int"), last - goes_on.cast("int")
    run = pieces(weighed.where(whole_from <= whole_to), F.sequence(whole_from, whole_to))
    if "block" in blocks.columns:
        parts = F.array_distinct(F.array_compact(F.array(F.when(begun, first), F.when(goes_on, last))))
        same = [F.first(c).alias(c) for c in ("idf", "low", "width")]
        met = pieces(weighed.where(begun | goes_on), parts).groupBy("term", "chunk_idx").agg(*same, F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
        run = run.union(met.select(*run.columns))
    kind = dict(blocks.dtypes)["x"]
    docids, freqs, _ = _parts(F.col("x"), F.transform, kind)
    share = lambda v: ranking.contribution(F.col("idf"), *_parts(v, lambda y, f: f(y), kind)[1:], F.lit(float(average)))
    arrays = run.select("term", "chunk_idx", docids.alias("docids"), freqs.cast("array<bigint>").alias("freqs"), F.transform("x", share).alias("contributions"))
    arrays = arrays.withColumn("gaps", gaps(F.col("docids")))
    return arrays.select(
        "term",
        "chunk_idx",
        F.size("docids").alias("chunk_size"),
        F.element_at("docids", -1).alias("last_docid"),
        ranking.up_to_float(F.array_max("contributions")).alias("max_score"),
        varbyte.total(F.col("gaps")).alias("docid_bytes"),
        varbyte.total(F.col("freqs")).alias("freq_bytes"),
        "docids",
        "freqs",
        "contributions",
    )


def with_next(chunked: DataFrame, *columns: Column) -> DataFrame:
    """``chunked`` with columns of the chunk that follows in the same list, null after the last; no list is in one task."""
    after = chunked.select("term", (F.col("chunk_idx") - 1).alias("chunk_idx"), *columns)
    return chunked.join(after, ["term", "chunk_idx"], "left")


def gaps(ids):
    """Differences of an increasing array, the first against zero."""
    return F.transform(ids, lambda v, i: v - F.coalesce(F.get(ids, i - 1), F.lit(0)))


def ungaps(differences):
    """The inverse of ``gaps``: running sums, folded once along the array."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, g: F.struct(F.array_append(s["out"], s["sum"] + g).alias("out"), (s["sum"] + g).alias("sum"))
    return F.aggregate(differences, start, step, lambda s: s["out"])


def list_figures(chunked: DataFrame) -> DataFrame:
    """(term, length, doc_count, max_score) of the lists that ``chunked`` holds, without their places in the layout."""
    packed = F.lit(CHUNK_HEAD) + F.col("docid_bytes") + F.col("freq_bytes")
    return chunked.groupBy("term").agg((F.lit(TERM_HEAD) + F.sum(packed)).cast("long").alias("length"), F.sum("chunk_size").alias("doc_count"), F.max(F.array_max("contributions")).alias("max_score"))


def lexicon(chunked: DataFrame) -> DataFrame:
    """(term, offset, length, doc_count, max_score) by term, with places in the packed layout."""
    placed = with_running_sum(cut(list_figures(chunked)), ["term"], F.col("length"), "_before")
    return placed.select("term", (F.col("_before") + FILE_HEAD).alias("offset"), "length", "doc_count", "max_score")


def next_geq(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (term, target) the smallest doc_id of the term at or after target, null if there is none."""
    hit = found.select("term", "doc_id").join(wanted, "term").where("doc_id >= target").groupBy("term", "target").agg(F.min("doc_id").alias("next_doc"))
    return wanted.join(hit, ["term", "target"], "left")
