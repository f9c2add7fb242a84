"""Counters of a walk over documents, against one written out step by step."""

import random

import numpy as np
import pytest
from test_engine import asked, table

from quillspark.functions.text import tokenize
from quillspark.operators import index, search, traversal


def plain_walk(lists, k):
    """lists: [(bound, {doc: share}, [(docs, top)])] by bound. The same walk over sets of what is left of each list."""
    left = [sorted(shares) for _, shares, _ in lists]
    reach = [sum(b for b, *_ in lists[: i + 1]) for i in range(len(lists))]
    scored = skipped = 0
    held, warm = [], None

    def threshold():
        return sorted(held)[-k] if len(held) >= k else 0.0

    while True:
        theta = threshold()
        first = sum(r <= theta for r in reach)
        if len(held) >= k and warm is None:
            warm = len(lists) - first
        if first == len(lists):
            break
        if theta > 0:
            for i in range(first, len(lists)):
                while left[i]:
                    docs, top = next(c for c in lists[i][2] if left[i][0] in c[0])
                    if top + (reach[-1] - lists[i][0]) > theta:
                        break
                    left[i] = [d for d in left[i] if d > docs[-1]]
                    skipped += 1
        heads = [x[0] for x in left[first:] if x]
        if not heads:
            break
        doc, score = min(heads), 0.0
        for i in range(first, len(lists)):
            if left[i] and left[i][0] == doc:
                score += lists[i][1][doc]
                scored += 1
        for i in range(first - 1, -1, -1):
            if score + reach[i] <= theta:
                break
            left[i] = [d for d in left[i] if d >= doc]
            if left[i] and left[i][0] == doc:
                score += lists[i][1][doc]
                scored += 1
        if len(held) < k or score > theta:
            held.append(score)
        for i in range(first, len(lists)):
            left[i] = [d for d in left[i] if d > doc]
    return traversal.Counts(scored, len(lists) if warm is None else warm, skipped)


@pytest.mark.parametrize("seed", range(30))
def test_walks(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randrange(1, 5)):
        docs = sorted(rng.sample(range(300), rng.randrange(1, 200)))
        scale = rng.choice([0.0, 0.5, 1.0, 4.0])
        shares = {d: scale * rng.random() ** 4 for d in docs}
        size = rng.choice([1, 4, 16])
        chunks = [(docs[i : i + size], max(shares[d] for d in docs[i : i + size])) for i in range(0, len(docs), size)]
        lists.append((max(shares.values()), shares, chunks))
    lists.sort(key=lambda x: x[0])
    cursors = []
    for _, shares, chunks in lists:
        docs = sorted(shares)
        sizes = [len(c[0]) for c in chunks]
        cursors.append(traversal.Cursor(np.array(docs), np.array([shares[d] for d in docs]), np.cumsum(sizes) - sizes, np.array([c[1] for c in chunks])))
    assert traversal.walk(cursors, 10) == plain_walk(lists, 10)


def test_counters_of_queries(spark):
    rng = random.Random(4)
    texts = [" ".join(["rare"] * (9 if i < 40 else 0) + ["city"] * (i % 5 == 0) + ["water"] * (i % 3 == 0) * rng.randrange(1, 4) + ["hill"] * (i % 4 == 0) * (6 if i < 300 else 1) + ["pad"] * (rng.randrange(1, 30) + 60 * (i % 4 == 0 and i >= 300))) for i in range(2_000)]
    docs = table(spark, texts)
    found = index.postings(docs)
    stats = index.corpus_stats(docs.selectExpr("text").select(tokenize(docs["text"]).alias("t")).selectExpr("size(t) as length"))
    chunks = index.chunks(found, stats)
    queries = asked(spark, "city", "absent", "!!!", "rare water city", "water water", "pad", "hill")
    rows = {r["query_idx"]: r for r in traversal.traversal_stats(queries, chunks, index.lexicon(chunks)).collect()}
    assert len(rows) == 7
    assert all(tuple(rows[i])[1:] == (0, 0, 0, 0) for i in (1, 2))
    assert rows[0]["total_postings"] == 400 and 10 <= rows[0]["postings_scored"] <= 400
    assert rows[6]["chunks_skipped"] > 0 and all(rows[i]["postings_scored"] < rows[i]["total_postings"] for i in (3, 6))
    assert rows[4]["total_postings"] == 2 * sum("water" in t for t in texts)
    assert rows[5]["postings_scored"] == 0  # in more than half of the passages, so it scores nothing
    for i, text in ((0, "city"), (3, "rare water city"), (4, "water water"), (6, "hill")):
        parts = chunks.join(search.query_tokens(asked(spark, text)), "term").collect()
        lists = {}
        for r in sorted(parts, key=lambda r: (r["pos"], r["chunk_idx"])):
            shares, cs = lists.setdefault((r["term"], r["pos"]), ({}, []))
            shares.update(zip(r["docids"], r["contributions"]))
            cs.append((r["docids"], r["max_score"]))
        ordered = sorted((max(s.values()), t, p, s, c) for (t, p), (s, c) in lists.items())
        want = plain_walk([(b, s, c) for b, _, _, s, c in ordered], 10)
        assert (rows[i]["postings_scored"], rows[i]["essential_after_warmup"], rows[i]["chunks_skipped"]) == tuple(want)
    with pytest.raises(ValueError, match="postings"):
        traversal.traversal_stats(queries, chunks, index.lexicon(chunks), most_postings=100)
