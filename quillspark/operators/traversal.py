"""Counters of a document-at-a-time walk (MaxScore with block-max): what a cursor-based engine would touch for each query.

Ranking never needs this; it is for comparing engines. A walk is sequential, so each query's lists go to one task,
which is why their size is checked first: more than ``most_postings`` for one query are refused, and the counters of
``prune`` are there at any size.
"""

from __future__ import annotations

import heapq
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .prune import query_cost
from .search import TOP, query_terms, query_tokens

MOST_POSTINGS = 20_000_000
_NONE = np.iinfo(np.int64).max
_SCHEMA = "query_idx int, postings_scored long, essential_after_warmup int, chunks_skipped long"


class Counts(NamedTuple):
    postings_scored: int
    essential_after_warmup: int
    chunks_skipped: int


class Cursor:
    """A list's place: ``doc`` is the smallest id that hasn't been passed."""

    def __init__(self, docs: np.ndarray, shares: np.ndarray, starts: np.ndarray, tops: np.ndarray):
        self.docs, self.shares, self.starts, self.tops = docs, shares, starts, tops
        self.bound = float(shares.max())
        self.at, self.doc = 0, int(docs[0])

    def seek(self, doc: int) -> None:
        """Goes on to the first id from ``doc`` on."""
        self.at += int(np.searchsorted(self.docs[self.at :], doc))
        self.doc = int(self.docs[self.at]) if self.at < len(self.docs) else _NONE

    def chunk(self) -> tuple[float, int]:
        """Bound and last id of the chunk that holds the place."""
        i = int(np.searchsorted(self.starts, self.at, side="right"))
        end = self.starts[i] if i < len(self.starts) else len(self.docs)
        return float(self.tops[i - 1]), int(self.docs[end - 1])


def walk(lists: list[Cursor], k: int = TOP) -> Counts:
    """Walks lists, given by rising bound, and counts contributions computed, chunks passed over, and lists that are still
    essential once k documents are held."""
    reach = list(accumulate(c.bound for c in lists))
    best: list[float] = []
    theta, scored, passed, warm = 0.0, 0, 0, len(lists)
    first = next((i for i, r in enumerate(reach) if r > theta), len(lists))
    while first < len(lists):
        essential = lists[first:]
        if theta > 0:
            for c in essential:
                while c.doc != _NONE:
                    top, last = c.chunk()
                    if top + (reach[-1] - c.bound) > theta:
                        break
                    c.seek(last + 1)
                    passed += 1
        doc = min(c.doc for c in essential)
        if doc == _NONE:
            break
        here = [c for c in essential if c.doc == doc]
        score = sum(float(c.shares[c.at]) for c in here)
        scored += len(here)
        for c, r in zip(reversed(lists[:first]), reversed(reach[:first])):
            if score + r <= theta:
                break
            c.seek(doc)
            if c.doc == doc:
                score += float(c.shares[c.at])
                scored += 1
        was_full = len(best) == k
        if not was_full or score > theta:
            (heapq.heappushpop if was_full else heapq.heappush)(best, score)
            theta = best[0] if len(best) == k else 0.0
        for c in here:
            c.seek(doc + 1)
        first = next((i for i, r in enumerate(reach) if r > theta), len(lists))
        if not was_full and len(best) == k:
            warm = len(lists) - first
    return Counts(scored, warm, passed)


def cursors(table: pa.Table) -> list[Cursor]:
    """Cursors of one query's chunks (pos, term, chunk_idx, docids, contributions, max_score), by rising bound."""
    found = []
    rows = table.sort_by([("pos", "ascending"), ("chunk_idx", "ascending")])
    pos = rows.column("pos").to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        part = rows.slice(a, b - a).combine_chunks()
        docs, shares = (np.concatenate([x.flatten().to_numpy() for x in part.column(c).chunks]) for c in ("docids", "contributions"))
        sizes = part.column("chunk_size").to_numpy()
        found.append((part.column("term")[0].as_py(), int(pos[a]), Cursor(docs, shares, np.cumsum(sizes) - sizes, part.column("max_score").to_numpy())))
    return [c for _, _, c in sorted(found, key=lambda x: (x[2].bound, x[0], x[1]))]


def traversal_stats(queries: DataFrame, chunks: DataFrame, lexicon: DataFrame, k: int = TOP, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """(query_idx, postings_scored, total_postings, essential_after_warmup, chunks_skipped) of each disjunctive query; one without
    known terms has zeros."""
    cost = query_cost(query_terms(queries), lexicon)
    if (most := cost.agg(F.max("total_postings")).first()[0] or 0) > most_postings:
        raise ValueError(f"a query has {most} postings, a walk takes {most_postings}; prune.query_stats counts at any size")

    def run(table: pa.Table) -> pa.Table:
        counts = walk(cursors(table), k)
        kinds = pa.schema([("query_idx", pa.int32()), ("postings_scored", pa.int64()), ("essential_after_warmup", pa.int32()), ("chunks_skipped", pa.int64())])
        return pa.Table.from_pydict({"query_idx": [table.column("query_idx")[0].as_py()]} | {name: [n] for name, n in counts._asdict().items()}, kinds)

    lists = query_tokens(queries).join(chunks.select("term", "chunk_idx", "chunk_size", "docids", "contributions", "max_score"), "term")
    ship(queries.sparkSession)
    walked = lists.groupBy("query_idx").applyInArrow(run, _SCHEMA)
    joined = queries.select("query_idx").join(walked, "query_idx", "left").join(cost, "query_idx", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return joined.select("query_idx", zero("postings_scored", "long"), zero("total_postings", "long"), zero("essential_after_warmup", "int"), zero("chunks_skipped", "long"))
