"""Tokens and snippets."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, carriage return, form feed and ASCII punctuation; not vertical tab, NUL or NBSP.
DELIMITERS = r"""[ \t\n\r\f.,;:!?\[\]{}()<>"'`~@#$%^&*\-+=|\\/_]+"""
UNAVAILABLE = "[Snippet unavailable]"
MARK, UNMARK = "\x1b[1;33m", "\x1b[0m"
BEFORE, AFTER, DEFAULT_WORDS = 50, 50, 100
#: A line and the equal ones that follow it; possessive, so that no number of them needs a deeper stack.
RUN = r"(?<![^\n])([^\n]++)(?:\n\1(?![^\n]))*+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; the general function is taken where no other letter can be there."""
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(letters)


def tokenize(text: Column) -> Column:
    """Maximal runs of non-delimiters in order; null counts as empty."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def n_tokens(text: Column) -> Column:
    """The number of tokens; it doesn't depend on case."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), DELIMITERS), ""))


def term_runs(tokens: Column) -> Column:
    """Per distinct token, by term, its repeats joined by line feeds, which no token has; compiled, unlike lambdas over arrays."""
    return F.regexp_extract_all(F.array_join(F.sort_array(tokens), "\n"), F.lit(RUN), F.lit(0))


def run_term(run: Column) -> Column:
    return F.substring_index(run, "\n", 1)


def run_freq(run: Column) -> Column:
    """Times that a run holds its term."""
    return F.call_function("div", F.octet_length(run) + 1, F.octet_length(run_term(run)) + 1).cast("long")


def term_counts(tokens: Column) -> Column:
    """array<struct<term, freq>> of a token array, by term."""
    return F.transform(term_runs(tokens), lambda r: F.struct(run_term(r).alias("term"), run_freq(r).alias("freq")))


def snippet(text: Column, terms: Column) -> Column:
    """The window of words with most matches of the distinct ``terms``, narrowest first, then leftmost; matches marked."""

    def best(words: Column, hits: Column) -> Column:
        n = F.size(words)

        def window(c: Column, k: Column) -> Column:
            start, end = F.greatest(F.lit(0), c - BEFORE), F.least(n, c + AFTER)
            # Hits are distinct places, so those of the window are among its neighbours: linear in all hits.
            near = F.slice(hits, F.greatest(F.lit(1), k + 1 - BEFORE), F.lit(BEFORE + AFTER + 1))
            inside = F.filter(near, lambda h: (h >= start) & (h < end))
            worth = F.size(inside) * 1000 - (F.element_at(inside, -1) - F.element_at(inside, 1))
            return F.struct(worth.alias("worth"), (-c).alias("place"), start.alias("start"), end.alias("end"))

        default = F.struct(F.lit(0).alias("worth"), F.lit(0).alias("place"), F.lit(0).alias("start"), F.least(F.lit(DEFAULT_WORDS), n).alias("end"))
        return F.coalesce(F.array_max(F.transform(hits, window)), default)

    def shown(words: Column, hits: Column) -> Column:
        def render(w: Column) -> Column:
            part = F.slice(words, w["start"] + 1, w["end"] - w["start"])
            marked = F.transform(part, lambda x: F.when(F.array_contains(terms, x), F.concat(F.lit(MARK), x, F.lit(UNMARK))).otherwise(x))
            return F.concat(F.when(w["start"] > 0, F.lit("... ")).otherwise(F.lit("")), F.array_join(marked, " "), F.when(w["end"] < F.size(words), F.lit(" ...")).otherwise(F.lit("")))

        return let(best(words, hits), render)

    places = lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(terms, F.get(ws, i)))
    found = let(tokenize(text), lambda ws: F.when(F.size(ws) > 0, let(places(ws), lambda hits: shown(ws, hits))).otherwise(F.lit("")))
    return F.when(text.isNull(), F.lit(UNAVAILABLE)).otherwise(found)
