"""The model against its definition: scores, likelihood and its slope."""

import math
import random
import re

import numpy as np
import pytest
from test_text_operators import toxic_set

from quillspark.llm import toxicity


def plain_logits(text, bias, weights):
    """Log-odds of each sentence: distinct words, each with its first four to six letters."""
    found = []
    for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text):
        words = set(re.findall(r"\w+", m[0].lower()))
        if words:
            z = bias
            for w in words:
                z += weights.get(w, 0)
                z += sum(weights.get("^" + w[:n], 0) for n in (4, 5, 6) if len(w) >= n)
            found.append((m.start(), m.end(), z))
    return found


def plain_score(logits):
    clean = 1.0
    for _, _, z in logits:
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_and_places_against_plain_python(spark, docs, corpus):
    rng = random.Random(1)
    words = sorted({w for _, t, *_ in corpus for w in re.findall(r"\w+", (t or "").lower())[:200]})
    weights = {w: rng.uniform(-2, 3) for w in rng.sample(words, 150)} | {"^" + w[:n]: rng.uniform(-1, 2) for w in rng.sample(words, 60) for n in (4, 5, 6) if len(w) >= n}
    rows = toxicity.score(docs, toxicity.Model(-3.0, weights), threshold=0.3, sentence_threshold=0.4).collect()
    text_of = {i: t or "" for i, t, *_ in corpus}
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is not None:
            logits = plain_logits(text_of[r["doc_id"]], -3.0, weights)
            assert r["score"] == pytest.approx(plain_score(logits), abs=1e-9)
            assert r["predicted"] == int(r["score"] >= 0.3)
            assert r["offending"] == ",".join(f"{a}:{b}" for a, b, z in logits if 1 / (1 + math.exp(-z)) >= 0.4)


def test_likelihood_and_its_slope():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y = rng.integers(0, 2, 9).astype(float)
        doc = np.sort(rng.integers(0, 9, 25))
        z = rng.normal(-1, 2, 25)
        value, slope = toxicity.slopes(z, doc, y)
        plain = 0.0
        for d in range(9):
            clean = np.prod([1 - 1 / (1 + math.exp(-x)) for x in z[doc == d]])
            plain += math.log(max(1 - clean, 1e-9)) if y[d] else math.log(clean)
        assert value == pytest.approx(plain, rel=1e-9)
        for i in range(25):
            step = np.zeros(25)
            step[i] = 1e-5
            numeric = (toxicity.slopes(z + step, doc, y)[0] - toxicity.slopes(z - step, doc, y)[0]) / 2e-5
            assert slope[i] == pytest.approx(numeric, abs=1e-5)


def test_training_raises_the_likelihood():
    rows = toxic_set(400, 5)
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]

    def likelihood(model):
        total = 0.0
        for t, y in zip(texts, labels):
            s = min(max(plain_score(plain_logits(t, model.bias, model.weights)), 1e-9), 1 - 1e-9)
            total += math.log(s if y else 1 - s)
        return total

    fitted = toxicity.fit(texts, labels)
    assert likelihood(fitted) > 0.2 * likelihood(toxicity.Model(-4.0, {}))
    assert likelihood(fitted) > likelihood(toxicity.fit(texts, labels, steps=20))


def test_a_long_labelled_text_and_labels_without_documents(spark):
    """A text of 18 MB, beyond the sample's bytes, and far more labels than documents leave the model as it was."""
    rows = toxic_set(300, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = toxicity.train(df, df)
    long = spark.range(1).selectExpr("7000 + id as doc_id", "repeat('word ', 3700000) as text", "0 as toxic")
    labels = df.select("doc_id", "toxic").union(long.select("doc_id", "toxic")).union(spark.range(100_000, 130_000).selectExpr("id as doc_id", "1 as toxic"))
    assert toxicity.train(df.drop("toxic").union(long.drop("toxic")), labels) == want and want.weights
