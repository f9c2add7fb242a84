"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of characters other than ASCII white space. Edge cases: a null or empty text has zero
in every measure and fails the base rules; ratios over zero words or lines are zero; repeated rows
are judged each for itself; a null doc_id is carried along; other columns are neither read nor
mistaken for measures. A text is never cut, however long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
STOP_WORDS = tuple(
    "the and of to in is that for with on are was this as at by an a de la le les et en un une des est dans que pour el los las del y se por con der die das und ist von zu den mit im ein eine auf".split()
)
#: (rule, measure, least, most); None: no such bound. A kept document is within all bounds.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 10, None),
    ("word_length", "mean_word_chars", 1.5, 20),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.6),
    ("listed_lines", "bullet_line_ratio", None, 0.9),
    ("open_lines", "ellipsis_line_ratio", None, 0.3),
    ("repeated_words", "repeat_word_ratio", None, 0.2),
)
BASE = ("length", "repeated_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash of each window of ``size`` words, by doubling: windows of 1, 2, 4 words, then joined."""
    n = F.size(words)

    def joined(a: Column, b: Column, skip: int, span: int) -> Column:
        count = n - span + 1
        return F.zip_with(F.slice(a, F.lit(1), count), F.slice(b, F.lit(skip + 1), count), lambda x, y: F.xxhash64(x, y))

    def grow(current: Column, span: int) -> Column:
        if span == size:
            return current
        if 2 * span <= size:
            return _let(current, lambda c: grow(joined(c, c, span, 2 * span), 2 * span))
        return grow(joined(current, words, span, span + 1), span + 1)

    return grow(words, 1)


def covered_by_repeats(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the array, in n log n steps."""

    def count(ordered: Column) -> Column:
        twin = lambda a, b: F.get(ordered, a)["h"] == F.get(ordered, b)["h"]
        repeated = F.filter(ordered, lambda x, i: F.coalesce(twin(i, i - 1), F.lit(False)) | F.coalesce(twin(i, i + 1), F.lit(False)))
        starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        state = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"))
        return F.aggregate(starts, state, step, lambda s: s["n"])

    none = F.lit(0).cast("long")
    places = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(places(h), count)).otherwise(none)
    return F.when(F.size(words) > size, _let(words, lambda ws: _let(window_hashes(ws, size), found))).otherwise(none)


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and all measures of the table of thresholds, in one narrow stage."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    spaces = " \t\x0b\x0c\r"
    long = lambda c: c.cast("long")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    found = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text")).select(
        "doc_id",
        words_of(text).alias("_words"),
        F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(spaces))), lambda x: x != "").alias("_full"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(spaces)) != "").alias("_lines"),
        long(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
    )
    counted = found.select(
        "doc_id",
        long(F.size("_words")).alias("n_words"),
        long(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        "n_symbols",
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered_by_repeats(F.col("_words")).alias("n_repeat_words"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
        long(F.size(F.filter("_full", lambda x: F.substring(x, 1, 1).isin("•", "-", "*", "‣")))).alias("n_bullet_lines"),
        long(F.size(F.filter("_full", lambda x: x.endswith("...") | x.endswith("…")))).alias("n_ellipsis_lines"),
    )
    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words")).otherwise(F.lit(0.0)).alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def broken(rule: tuple[str, str, float | None, float | None]) -> Column:
    _, measure, least, most = rule
    checks = [F.col(measure) < least] * (least is not None) + [F.col(measure) > most] * (most is not None)
    return reduce(lambda a, b: a | b, checks)


def judge(docs: DataFrame, thresholds=THRESHOLDS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept`` of each row."""
    few = F.col("n_words") < 10
    much = 100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    failed = F.concat_ws(",", *(F.when(broken(r), F.lit(r[0])) for r in thresholds))
    return (
        measures(docs, id_column, text_column)
        .withColumns({"base_failed": few | much, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def accepted(docs: DataFrame, thresholds=THRESHOLDS, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns: a filter in the scan's stage, without a join."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col(text_column).alias("text"))
    return judge(whole, thresholds).where("kept").select("doc_id.*")


def sql(thresholds=THRESHOLDS) -> str:
    """The same judgement of ``documents`` in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ws = "[\\x20\\x09-\\x0D]+"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    one = lambda m, least, most: " OR ".join([f"{m} < {least}"] * (least is not None) + [f"{m} > {most}"] * (most is not None))
    failed = ", ".join(f"CASE WHEN {one(m, a, b)} THEN '{name}' END" for name, m, a, b in thresholds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{ws}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(ls, lambda x: left(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 1) IN ('•', '-', '*', '‣')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN rep USING (r)),
q AS (SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbols_per_word,
        {ratio("(n_stop_words + 1)", "n_words")} AS stop_word_ratio, {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio,
        {ratio("n_bullet_lines", "n_lines")} AS bullet_line_ratio, {ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio,
        {ratio("n_repeat_words", "n_words")} AS repeat_word_ratio FROM m),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM q)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM j"""
