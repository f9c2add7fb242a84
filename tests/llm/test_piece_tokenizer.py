import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import piece_tokenizer as p

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_as_the_library_does(docs, corpus, library):
    rows = p.encode_documents(docs, PATH, digests=True).collect()
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = []
    for i, t, *_ in corpus:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    full = p.encode_documents(docs, PATH).where("doc_id = 5").first()
    assert full["ids"] == library.encode(corpus[5][1] or "", add_bos=True, add_eos=True) and full["decoded"] == library.decode(full["ids"])
    assert p.encode_documents(docs.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abeing st=-\n\t▁0é中😀 ", "  ", "the", "\x00"]), max_size=60).map("".join) | st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_any_text(library, text):
    sp, m = library, p.model(PATH)
    ids = sp.encode(text, add_bos=True, add_eos=True)
    assert m.encode(text) == ids
    assert m.decode(ids) == sp.decode(ids)


def test_long_units_by_heap_and_by_rounds(library, monkeypatch):
    rng = random.Random(1)
    texts = ["a" * 3000, "ab" * 2500, "".join(rng.choices("abcdefghinorst", k=4000))]
    for limit in (10, 2048, 10**9):
        monkeypatch.setattr(p, "LONG_UNIT", limit)
        assert [p.model(PATH).encode(t) for t in texts] == library.encode(texts, add_bos=True, add_eos=True)


def test_decode_of_any_ids(library):
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(1, 400) if rng.random() < 0.5 else rng.randrange(259, 32000) for _ in range(rng.randrange(0, 12))]
        assert p.model(PATH).decode(ids) == library.decode(ids) or any(3 <= i < 259 for i in ids)


def test_units_that_repeat_over_texts(spark, library, monkeypatch):
    """Units are encoded once and gathered for each text, bytes in blocks."""
    monkeypatch.setattr(p, "DECODE_IDS", 3)
    m = p.model(PATH)
    texts = ["the cat the cat é漢", "", "the", "漢 the\n\tcat  the"]
    units = [u for t in texts for u in m.split(t)]
    ids, ends = m.encode_flat(np.array([ord(c) for u in units for c in u]), np.array([len(u) for u in units]))
    assert ids.tolist() == [i for t in texts for i in library.encode(t)]
    raw, places = m.decode_flat(ids)
    assert raw.decode() == "".join(" " + t for t in texts if t) and places[-1] == len(raw)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = p.encode_documents(df, PATH).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [r["decoded"] for r in rows] == texts and p.encode_documents(df.limit(0), PATH).count() == 0
