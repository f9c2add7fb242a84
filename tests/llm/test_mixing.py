from fractions import Fraction

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import mixing as m
from quillspark.llm.token_counts import count_tokens


def levels():
    return [F.lit("d"), F.col("lang"), F.col("source")]


def words(t):
    return len((t or "").encode().split())


def plain_budgets(available, weights, total, max_epochs):
    """Budgets from the definition: at each node the level at which the children's weights, each up to its capacity, spend it."""

    def below(node):
        return {p: n for p, n in available.items() if p[: len(node)] == node}

    def names(node):
        return sorted({p[len(node)] for p in below(node)})

    def weight(node, name):
        own = [n for n in names(node) if (*node, n) in weights]
        return Fraction(weights.get((*node, name), 0)) if own else Fraction(sum(below((*node, name)).values()))

    def room(node):
        if node in available:
            return available[node] * max_epochs
        return sum(room((*node, n)) for n in names(node) if weight(node, n) > 0)

    def split(node, budget):
        children = [(n, room((*node, n)), weight(node, n)) for n in names(node)]
        children = [(n, r, w) for n, r, w in children if r and w]
        budget = min(budget, sum(r for _, r, _ in children))
        shares = dict.fromkeys(names(node), 0)
        # The level rises from one child's filling to the next.
        level = Fraction(0)
        for n, r, w in sorted(children, key=lambda c: Fraction(c[1]) / c[2]):
            filled = sum(min(Fraction(r2), Fraction(r) / w * w2) for _, r2, w2 in children)
            if filled >= budget:
                break
            level = Fraction(r) / w
        else:
            return shares | {n: r for n, r, _ in children}
        fixed = {n: r for n, r, w in children if Fraction(r) / w <= level}
        rest = [(n, w) for n, r, w in children if n not in fixed]
        left, sum_w = budget - sum(fixed.values()), sum(w for _, w in rest)
        exact = {n: left * w / sum_w for n, w in rest}
        floors = {n: int(x) for n, x in exact.items()}
        for n in sorted(exact, key=lambda n: (floors[n] - exact[n], n))[: left - sum(floors.values())]:
            floors[n] += 1
        return shares | fixed | floors

    found = {}

    def walk(node, budget):
        if node in available:
            found[node] = budget
        else:
            for n, share in split(node, budget).items():
                walk((*node, n), share)

    if available:
        walk((), total)
    return found


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 3), st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("pq")), st.integers(1, 300), max_size=10), st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")) | st.tuples(st.sampled_from("ab")), st.integers(0, 5), max_size=6))
def test_budgets_against_their_definition(total, epochs, available, weights):
    assert m.budgets(available, weights, total, epochs) == plain_budgets(available, weights, total, epochs)


def test_tokens_of_a_tokenizer_and_repeated_rows(spark, docs, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    weights = {("d", "en"): 1, ("d", "de"): 2, ("d", ""): 1}
    tokens = {repr(r["doc_id"]): r["n_tokens"] for r in count_tokens(docs, path).orderBy("n_tokens").collect()}  # of two without an id, that with a text
    got = m.select(docs, weights, levels=levels(), budget_share=2.0, max_epochs=4, seed=3, tokenizer=path).collect()
    assert all(r["n_tokens"] == tokens[repr(r["doc_id"])] and 0 < r["take_tokens"] <= r["n_tokens"] for r in got)
    leaves, spent = {}, {}
    for i, t, lang, source in corpus:
        if n := tokens[repr(i)] if words(t) else 0:
            leaf = ("d", lang or "", source or "")
            leaves[leaf] = leaves.get(leaf, 0) + n
    for r in got:
        leaf = (r["level_0"], r["level_1"], r["level_2"])
        spent[leaf] = spent.get(leaf, 0) + r["take_tokens"]
    want = plain_budgets(leaves, weights, 2 * sum(leaves.values()), 4)
    assert spent == {k: v for k, v in want.items() if v}  # rows that are there three times count three times
    kept = m.mixed(docs, weights, levels=levels(), budget_share=0.4, seed=1, tokenizer=path)
    chosen = m.select(docs, weights, levels=levels(), budget_share=0.4, max_epochs=1, seed=1, tokenizer=path)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in chosen.select("doc_id").collect()}


def plain_order(spark, rows, seed, epoch):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [r["doc_id"] for r in df.withColumn("at", F.xxhash64(F.lit(seed), F.lit(epoch).cast("long"), F.col("doc_id"))).orderBy("at", "doc_id").collect()]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 5)), min_size=1, max_size=6))
def test_shares(budget, children):
    capacity = {str(i): c for i, (c, _) in enumerate(children)}
    weights = {str(i): Fraction(w) for i, (_, w) in enumerate(children)}
    given_ = m.share(budget, capacity, weights)
    room = sum(c for k, c in capacity.items() if weights[k])
    assert sum(given_.values()) == min(budget, room)
    assert all(0 <= given_[k] <= capacity[k] and (weights[k] or not given_[k]) for k in capacity)
    open_ = [k for k in capacity if weights[k] and given_[k] < capacity[k]]
    assert all(abs(given_[a] * weights[b] - given_[b] * weights[a]) <= weights[a] + weights[b] for a in open_ for b in open_)


def test_shortages_go_to_siblings_before_ancestors():
    available = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    weights = {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1}
    assert m.budgets(available, weights, 400, 1) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    assert m.budgets({("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 1000}, weights, 400, 1) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 340}
    assert m.budgets({}, weights, 10, 1) == {}
    assert m.budgets({("a", "x"): 10}, {("b",): 1, ("a",): 0}, 10, 1) == {("a", "x"): 0}


@pytest.mark.parametrize("range_rows", [20_000, 2])
def test_passes_and_prefixes_against_plain_python(spark, docs, corpus, monkeypatch, range_rows):
    monkeypatch.setattr(m, "RANGE_ROWS", range_rows)
    rows = [r for r in dict.fromkeys(corpus) if r[0] is not None]
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    weights = {("d", "en"): 3, ("d", "de"): 1, ("d", ""): 1, ("d", "en", "src1"): 1, ("d", "en", "src0"): 2}
    got = m.select(unique, weights, levels=levels(), budget_share=1.5, max_epochs=3, seed=4).collect()
    leaves = {}
    for i, t, lang, source in rows:
        if words(t):
            leaves.setdefault(("d", lang or "", source or ""), []).append((i, t))
    available = {k: sum(words(t) for _, t in v) for k, v in leaves.items()}
    budget = plain_budgets(available, weights, int(1.5 * sum(available.values())), 3)
    want = []
    for leaf, members in leaves.items():
        size, left, epoch = {i: words(t) for i, t in members}, budget[leaf], 0
        while left > 0:
            for i in plain_order(spark, members, 4, epoch):
                if left > 0:
                    want.append((i, *leaf, epoch, size[i], min(left, size[i]), budget[leaf]))
                    left -= min(left, size[i])
            epoch += 1
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_mixed_takes_whole_documents_once(docs):
    weights = {("d", "en"): 1, ("d", "de"): 1}
    kept = m.mixed(docs, weights, levels=levels(), budget_share=0.3, seed=1)
    assert kept.schema == docs.schema
    chosen = m.select(docs, weights, levels=levels(), budget_share=0.3, max_epochs=1, seed=1).select("doc_id").distinct()
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in chosen.collect()}
    assert kept.where("lang is null").count() == 0
    assert m.mixed(docs.limit(0), weights, levels=levels(), budget_share=0.3).count() == 0
    assert m.select(docs, weights, levels=levels(), budget_share=0.0).count() == 0
