import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common
from quillspark.llm import near_dedup as near


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = {}
    for i, t, *_ in rows:
        words = [w.encode().lower() for w in (t or "").encode().split() for w in [w.decode()]]
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(i for i in sets if i is not None)
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i, *_ in rows if i is not None)


@pytest.mark.parametrize("block", [near.BLOCK, 2])
def test_components_against_all_pairs(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near.components(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == plain(corpus)
    unnumbered = [r for r in rows if r["doc_id"] is None]
    assert len(unnumbered) == 2 and all(r["component_id"] is None and r["kept"] for r in unnumbered)


def test_hot_group_of_chains(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(words)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.components(df).collect())
    assert got == plain(rows)


def test_deduplicated(docs):
    kept = near.deduplicated(docs)
    assert kept.schema == docs.schema
    assert kept.count() == near.components(docs).where("kept").count()
    assert near.deduplicated(docs.limit(0)).count() == 0


def sketched(*sets):
    rows = [(len(x), *near.odd_sketch(x)) for x in sets]
    return near.Sketches(pa.table(dict(zip(near.SKETCH, map(list, zip(*rows))))))


@pytest.mark.parametrize("n", [12, 300, 3_000, 5_000, 40_000])
def test_screen_passes_links_and_little_else(n):
    rng = np.random.default_rng(n)
    passed = {0.85: 0, 0.80: 0, 0.5: 0}
    tries = 40 if n > 10_000 else 200
    for similarity in passed:
        for _ in range(tries):
            union = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            equal = int(np.ceil(similarity * n))
            first = np.sort(union[: equal + (n - equal) // 5])
            second = np.sort(np.concatenate((union[:equal], union[equal + (n - equal) // 5 :])))
            passed[similarity] += bool(sketched(first, second).close(np.array([0]), np.array([1]), 85)[0])
    assert passed[0.85] == tries and (n < 100 or passed[0.5] == 0)
    assert n < 100 or passed[0.80] <= tries * 0.01  # a few shingles can't tell


def test_sketches_of_different_levels_and_lengths_meet():
    rng = np.random.default_rng(1)
    for small, large in ((250, 270), (500, 530), (1000, 1100), (4000, 4200), (16_000, 16_700), (32_000, 33_000)):
        second = np.sort(rng.integers(0, 1 << 63, large, np.uint64) * np.uint64(2))
        first, other = np.sort(rng.permutation(second)[:small]), np.sort(rng.integers(0, 1 << 63, small, np.uint64) * np.uint64(2))
        known = sketched(first, second, other)
        assert known.close(np.array([0, 1, 0]), np.array([1, 0, 2]), 85).tolist() == [True, True, False]
    assert len(set(known.level.tolist())) == 2


def test_family_without_links_sends_few_pairs_to_confirmation(spark, monkeypatch):
    """Every two documents are at 0.79 to 0.81; in blocks of 100 classes."""
    monkeypatch.setattr(near, "BLOCK", 100)
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(454)]
    rows = []
    for i in range(400):
        own = [f"v{i}x{k}" if k % 50 == 25 else w for k, w in enumerate(words)]  # 9 words of its own: 45 of 450 shingles
        rows.append((i, " ".join(own + [f"z{i}"] * 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    confirm = near.confirm
    monkeypatch.setattr(near, "confirm", lambda docs, pairs, percent: sent.append(pairs.count()) or confirm(docs, pairs, percent))
    assert near.components(df).where("kept").count() == 400
    assert sum(sent) < 0.01 * 400 * 399 / 2
    assert near.components(df, 75, 30, 5).where("kept").count() == 1


def test_joins_on_hot_keys_are_spread(spark, docs, corpus, monkeypatch):
    want = sorted(map(repr, near.components(docs).collect()))
    monkeypatch.setattr(common, "TOGETHER_ROWS", 2)
    assert sorted(map(repr, near.components(docs).collect())) == want
    left = spark.createDataFrame([(k, i) for i in range(30) for k in (1, 2, None)] + [(3, 0)], "k long, i long")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (4, "z"), (None, "n")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(repr, common.spread_join(left, right, "k", "i", how=how).select("k", "i", "v").collect())) == sorted(map(repr, left.join(right, "k", how).select("k", "i", "v").collect()))


def test_labels_of_long_paths(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 120)] + [(500, 501), (502, 501)]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in near.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 121)} | {500: 500, 501: 500, 502: 500}
