import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import suffix_dedup as s


def plain(rows):
    texts = sorted({(i, (t or "").encode()) for i, t, *_ in rows if i is not None})
    seen, found = {}, {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) != i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        found[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return sorted((i, *found[i]) for i, *_ in rows if i is not None)


#: Many blocks, windows, buckets a task, ranges, and arrays of one anchor that are merged.
SMALL = s.Limits(block_bytes=3_000, block_rows=20, slice_bytes=1_000, stretch_bytes=2_000, stretch_uses=40, window=700, bucket_text=5_000, range_bytes=2_000, array_bytes=200, tasks=3, hot=2)


@pytest.mark.parametrize("limits", [s.LIMITS, SMALL])
def test_against_all_windows(docs, corpus, limits):
    rows = s.deduplicate(docs, digests=True, limits=limits).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None) == plain(corpus)
    assert sum(r["n_removed"] for r in rows if r["doc_id"] is None) == 0 and sum(r["doc_id"] is None for r in rows) == 2


def test_real_output_and_empty_table(docs):
    assert s.deduplicate(docs.limit(0)).count() == 0
    row = s.deduplicate(docs).where("doc_id is not null and n_removed = 0 and n_bytes > 0").first()
    assert len(row["kept"]) == row["n_bytes"]


def test_suffix_array_and_prefixes():
    rng = random.Random(6)
    for text in ("banana" * 30, "a" * 200, "".join(rng.choices("ab", k=500)), "x"):
        data = np.frombuffer(text.encode(), np.uint8)
        order = s.suffix_array(data).tolist()
        cut = [text[i : i + 64] for i in order]
        assert sorted(order) == list(range(len(text))) and [c[:50] for c in cut] == sorted(c[:50] for c in cut)
        want = [0] + [next((k for k in range(50) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 50) for a, b in zip(order, order[1:])]
        assert s.common_prefixes(data, np.array(order)).tolist() == want


def test_arrays_of_one_hot_anchor_are_merged_by_binary_search():
    rng = random.Random(8)
    stem = "".join(rng.choices("abc", k=50)).encode()
    texts = sorted({stem[: rng.randrange(40, 50)] + bytes(rng.choices(b"xyz", k=25)) for _ in range(300)} | {b"q" * 15 + stem + bytes([97 + i]) for i in range(20)})
    least = np.array([rng.randrange(1000) for _ in texts])
    whole = s.classes(texts, least)
    (parts,) = list(s.arrays(list(range(len(texts))), [(5, t) for t in texts], 2_000))
    assert len(parts) > 5
    found = [s.classes([texts[i] for i in part], least[part]) for part in parts]
    merged = np.concatenate([low[f[0]] for f, low in zip(found, s.merged(found))])
    assert merged.tolist() == whole[1][whole[0]].tolist()


def test_anchors_are_shared_by_equal_strings():
    rng = random.Random(9)
    passage = bytes(rng.choices(b"abcdefgh ", k=50))
    seen = []
    for _ in range(20):
        text = bytes(rng.choices(b"abcdefgh ", k=rng.randrange(0, 80))) + passage + bytes(rng.choices(b"abcdefgh ", k=rng.randrange(0, 80)))
        data, at = np.frombuffer(text, np.uint8), text.index(passage)
        h, _, first, last, _ = s.anchors(data, np.array([len(text)]))
        assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
        seen.append({int(x) for x, a, b in zip(h, first, last) if a <= at <= b})
    assert len(set.intersection(*seen)) == 1


def test_anchors_do_not_depend_on_the_window():
    rng = random.Random(10)
    texts = [bytes(rng.choices(b"ab ", k=n)) for n in (0, 30, 49, 50, 51, 700, 3, 2_000, 0, 120, 40)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = [x.tolist() for x in s.anchors(data, ends)]
    for window in (1, 7, 50, 333, 2_900):
        assert [x.tolist() for x in s.anchors(data, ends, window)] == whole


def test_what_a_block_sends_does_not_grow_with_the_buckets():
    rng = random.Random(11)
    texts = [bytes(rng.choices(b"abcdefghij klmnop", k=6_000)).decode() for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [7 * i for i in range(300)], "key": list(range(300)), "text": texts})
    sent = [sum(len(x) for part in s.send_anchors(n)(iter([batch])) for row in zip(*(c.to_pylist() for c in part.columns[2:])) for x in row) for n in (13, 750, 7_500)]
    assert max(sent) == min(sent)
    assert sent[0] < 1.0 * sum(map(len, texts))


def test_one_id_with_several_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage, other = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))
    rows = [(1, f"{passage} one"), (2, f"two {passage}"), (2, f"{other} three {passage} four"), (2, other), (3, f"{other} five")]
    got = s.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == sorted([(1, f"{passage} one".encode()), (2, b"two "), (2, f"{other} three four".encode()), (2, other.encode()), (3, b"five")])


def test_removed_runs():
    assert s.removed(np.array([[60, 110], [0, 50], [50, 100], [200, 250], [205, 240]])).tolist() == [[0, 110], [200, 250]]


def test_hot_anchors_are_cut_by_their_neighbours(spark, monkeypatch):
    """A line that most documents have, between texts of their own, and some that share more of it."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    line = "Permission is hereby granted, free of charge, to any person."
    more = [" ".join(word() for _ in range(12)) for _ in range(3)]
    texts = [f"{' '.join(word() for _ in range(10))} {rng.choice(more)}\n{line}\n{rng.choice(more)} {' '.join(word() for _ in range(10))}" for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, line), (101, f"x{line}y"), (102, line * 3)]
    cuts = []
    monkeypatch.setattr(s, "send_stretches", lambda buckets, limits, hot: cuts.append(len(hot)) or send(buckets, limits, hot))
    got = s.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), digests=True, limits=SMALL).collect()
    assert cuts[0] > 3
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == plain(rows)


send = s.send_stretches
