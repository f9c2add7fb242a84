"""Collections and query files as text, result files, and stored indexes.

A collection has one passage a line, ``id TAB text``. Lines end at a line feed only; a line without TAB, or
whose id has no leading number or one beyond 64 bits, is skipped, but its bytes count towards later offsets.
Ids are taken modulo 2^32. Invalid UTF-8 becomes U+FFFD in terms; byte offsets stay those of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import n_tokens, tokenize
from ..operators import index
from ..plans.ordinals import with_ordinal, with_running_sum

FORMAT = "quillspark-index-2"


def parse_id(field: Column) -> Column:
    """The number that a field starts with (white space and a sign may come first), modulo 2^32; null if there is none."""
    found = F.regexp_extract(field, r"^[ \t\n\x0B\f\r]*([+-]?)0*([0-9]*)", 2)
    sign = F.regexp_extract(field, r"^[ \t\n\x0B\f\r]*([+-]?)[0-9]", 1)
    digits = F.regexp_extract(field, r"^[ \t\n\x0B\f\r]*[+-]?([0-9]+)", 1)
    value = F.when(F.length(found) > 20, F.lit(None)).otherwise(F.when(found == "", F.lit("0")).otherwise(found)).cast("decimal(38,0)")
    value = F.when((digits != "") & (value <= F.lit("18446744073709551615").cast("decimal(38,0)")), value)
    wrapped = F.pmod(F.when(sign == "-", -value).otherwise(value), F.lit(1 << 32).cast("decimal(38,0)"))
    return wrapped.cast("long")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): lines with what orders them as in the files."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with pid (null: skipped), text and bytes, the line feed included."""
    tab = F.instr("value", "\t")
    pid = F.when(tab > 0, parse_id(F.substring_index("value", "\t", 1)))
    return lines.withColumns({"pid": pid, "text": F.when(tab > 0, F.substr("value", tab + 1)), "bytes": (F.octet_length("value") + 1).cast("long")})


def scan_collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pid, text) of the accepted lines, numbered densely in file order."""
    accepted = parse_lines(read_lines(spark, path)).where("pid is not null").select("file", "block", "at", "pid", "text")
    return with_ordinal(accepted, ["file", "block", "at"], "doc_id").select("doc_id", "pid", "text")


def passage_table(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pid, length, file_offset) of the accepted lines; texts aren't sorted, only their sizes."""
    parsed = parse_lines(read_lines(spark, path)).select("file", "block", "at", "pid", "bytes", F.size(tokenize(F.col("text"))).alias("length"))
    placed = with_running_sum(parsed, ["file", "block", "at"], F.col("bytes"), "file_offset")
    return with_ordinal(placed.where("pid is not null"), ["file", "block", "at"], "doc_id").select("doc_id", "pid", "length", "file_offset")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, query): one per non-empty line, one trailing carriage return dropped."""
    lines = read_lines(spark, path).withColumn("query", F.regexp_replace("value", r"\r\z", "")).where("query <> ''")
    return with_ordinal(lines, ["file", "block", "at"], "query_idx").select(F.col("query_idx").cast("int"), "query")


def result_lines(results: DataFrame) -> DataFrame:
    """(value): query_idx, rank, pid, score to six places and, if there, the snippet, TAB between."""
    fields = [F.col("query_idx").cast("string"), F.col("rank").cast("string"), F.col("pid").cast("string"), F.format_string("%.6f", F.col("score"))]
    return results.select("query_idx", "rank", F.concat_ws("\t", *fields, *([F.col("snippet")] if "snippet" in results.columns else [])).alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    result_lines(results).orderBy("query_idx", "rank").select("value").write.mode("overwrite").text(path)


def save_index(docs: DataFrame, path: str) -> None:
    """Writes passages, statistics, postings, chunks, lexicon and, last, a manifest. Postings move once, as lists by term and block
    of ids, and both tables are cut from those."""
    spark = docs.sparkSession
    docs.select("doc_id", "pid", n_tokens(F.col("text")).alias("length")).write.mode("overwrite").parquet(f"{path}/passages")
    passages = spark.read.parquet(f"{path}/passages")
    index.corpus_stats(passages).write.mode("overwrite").parquet(f"{path}/stats")
    _, edges, packed = index.outline_of(passages)
    long = index.long_terms(docs, edges)
    lists = index.lists(index.postings(docs), edges, long, packed)
    ordered = lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    index.postings_of_lists(ordered).write.mode("overwrite").parquet(f"{path}/postings")
    chunks = index.chunks_of(index.placed(lists, edges, long), spark.read.parquet(f"{path}/stats"))
    chunks.sortWithinPartitions("term", "chunk_idx").write.mode("overwrite").parquet(f"{path}/chunks")
    lexicon = index.lexicon(spark.read.parquet(f"{path}/chunks"))
    lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
    longest = spark.read.parquet(f"{path}/lexicon").agg(F.max(F.octet_length("term"))).first()[0] or 0
    if longest > LONGEST_TERM:
        raise ValueError(f"a term has {longest} bytes, {LONGEST_TERM} are the most that an index can hold")
    counts = [(FORMAT, *(spark.read.parquet(f"{path}/{t}").count() for t in TABLES))]
    spark.createDataFrame(counts, "format string, " + ", ".join(f"{t} long" for t in TABLES)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


TABLES = ("postings", "passages", "stats", "chunks", "lexicon")
#: Bytes of a term that the packed layout's 16-bit length can say.
LONGEST_TERM = 65_535


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored index; fails if the format or a table's size isn't what the manifest says, or if passages and
    lists disagree. Counts come from the files' footers, the rest from one pass over narrow columns."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if manifest is None or manifest["format"] != FORMAT:
        raise ValueError(f"{path} holds no index of format {FORMAT}")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    for name, table in tables.items():
        if (n := table.count()) != manifest[name]:
            raise ValueError(f"{name} has {n} rows, the manifest says {manifest[name]}: the index is damaged or stale")
    n, total = tables["stats"].select("n", "total_len").first()
    passages, length = tables["passages"].agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if (passages, length) != (n, total):
        raise ValueError(f"passages have {length} tokens in {passages} rows, the statistics say {total} in {n}: the index is damaged or stale")
    postings = tables["chunks"].agg(F.coalesce(F.sum("chunk_size"), F.lit(0))).first()[0]
    listed = tables["lexicon"].agg(F.coalesce(F.sum("doc_count"), F.lit(0))).first()[0]
    if not postings == listed == manifest["postings"]:
        raise ValueError(f"chunks hold {postings} postings, the lexicon says {listed}: the index is damaged or stale")
    lost = tables["chunks"].select(F.col("last_docid").alias("doc_id")).distinct().join(tables["passages"], "doc_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a list has a passage that the passage table lacks: the index is damaged or stale")
    return tables
