"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic sum over its distinct words, each with its whole and its first four
to six letters as features; a document is toxic if any sentence
is (noisy-or), and document labels alone train the weights. The sentence probabilities then point
at the offending sentences. Training gathers at most ``sample_rows`` labelled texts and
``sample_bytes`` bytes of them, chosen by a hash of the id among those that have a text, so the driver's share is bounded;
a text that does not fit is left out alone, and long texts are taken after the others. The fitted word weights are
bounded by the sample. Scoring reads every whole text and only the text.

Edge cases: a null or empty text has no sentence and score 0; repeated rows score alike; labels that are
null or for which there is no document are left out; documents labelled twice count once for each label;
with no usable labels every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_LENGTH, CACHE_WORDS, map_slices

#: Documents whose crc32 of the id, modulo FOLDS, is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16_000_000
#: Texts of over so many times the mean room of a row are long.
LONG = 25
#: A feature is used if it is in so many toxic documents, and so many times as common there.
LEAST_DOCS, LEAST_LIFT = 4, 3
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\w+")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has a word."""
    found = []
    for m in SENTENCE.finditer(text):
        if words := set(WORD.findall(m[0].lower())):
            found.append((m.start(), m.end(), words))
    return found


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Log-odds of a sentence without known words, and what each feature of a word adds."""

    bias: float
    weights: dict[str, float]

    def scorer(self) -> Callable[[set[str]], float]:
        """Log-odds of a sentence's distinct words, with a bounded cache of words."""
        get, bias, seen = self.weights.get, self.bias, {}

        def logit(words: set[str]) -> float:
            if len(seen) > CACHE_WORDS:
                seen.clear()
            found = []
            for w in words:
                if (x := seen.get(w)) is None:
                    x = sum(get(f, 0.0) for f in features(w))
                    if len(w) <= CACHE_LENGTH:
                        seen[w] = x
                found.append(x)
            return bias + sum(sorted(found))

        return logit


def noisy_or(logits: np.ndarray) -> float:
    """1 - product of (1 - sigmoid), through softplus."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if logits.size else 0.0


def slopes(z: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of document labels under noisy-or, and its derivative by each sentence's log-odds; sentences are in the order of ``doc``."""
    at = np.searchsorted(doc, np.arange(len(y) + 1))
    full = np.flatnonzero(at[1:] > at[:-1])
    total = np.zeros(len(y))
    if full.size:
        total[full] = np.add.reduceat(np.logaddexp(0, z), at[full])
    p = np.maximum(-np.expm1(-total), 1e-9)
    slope = np.where(y == 1, np.exp(-total) / p, -1.0)
    return float(np.where(y == 1, np.log(p), -total).sum()), slope[doc] / (1 + np.exp(-z))


def fit(texts: list[str], labels: list[int], *, steps: int = 400, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Maximum likelihood of the document labels under noisy-or, by full-batch Adam with shrinkage."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for t, label in zip(texts, labels):
        seen[label].update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
    y = np.array(labels, np.float64)
    odds = LEAST_LIFT * (y.sum() + 1) / (len(y) - y.sum() + 1)
    number = {w: i for i, w in enumerate(sorted(w for w, n in seen[1].items() if n >= LEAST_DOCS and n > odds * seen[0][w]))}
    del seen
    if not number or not 0 < y.sum() < len(y):
        return Model(-50.0, {})
    cells, sizes, doc = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for _, _, words in sentences(t):
            before = len(cells)
            cells.extend(number[f] for w in words for f in features(w) if f in number)
            sizes.append(len(cells) - before)
            doc.append(d)
    cells, doc = np.frombuffer(cells, np.int32), np.frombuffer(doc, np.int32)
    rows = np.repeat(np.arange(len(doc), dtype=np.int32), np.frombuffer(sizes, np.int32))
    w, b = np.zeros(len(number)), -4.0
    m, v = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cells], len(doc))
        _, g = slopes(z, doc, y)
        grad = np.append(np.bincount(cells, g[rows], len(number)) / len(texts) - decay * w, g.sum() / len(texts))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return Model(float(b), {x: float(i) for x, i in zip(number, w) if abs(i) > 0.02})


def fitting(sizes: Sequence[int], room: int, long: float) -> list[int]:
    """Places of the sizes that fit the room together, taken in order but those over ``long`` last."""
    taken = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] > long):
        if sizes[i] <= room:
            room -= sizes[i]
            taken.append(i)
    return sorted(taken)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled documents outside the held-out fold; which of them is a matter of a hash."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("bytes"), "text")
    sized = texts.drop("text").where(F.col("bytes") <= sample_bytes)
    rows = usable.join(sized, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash", "toxic").limit(sample_rows).collect()
    rows = [rows[i] for i in fitting([r["bytes"] for r in rows], sample_bytes, LONG * sample_bytes / max(sample_rows, 1))]
    if not rows:
        return fit([], [])
    kind = texts.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["text_hash"]) for r in rows}), f"doc_id {kind}, text_hash long")
    found = texts.join(F.broadcast(wanted), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")).toArrow()
    text_of = {(r["doc_id"], r["text_hash"]): r["text"] for r in found.to_pylist()}
    return fit([text_of[r["doc_id"], r["text_hash"]] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, sentence_threshold: float = 0.3) -> DataFrame:
    """Score, prediction and offending sentences (start:end in code points, comma-joined) of each row."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        logit = given.value.scorer()
        def judge(text: str) -> tuple[float, int, str]:
            logits, places = [], []
            for start, end, words in sentences(text):
                logits.append(logit(words))
                places.append((start, end))
            z = np.array(logits)
            bad = [f"{a}:{b}" for (a, b), p in zip(places, 1 / (1 + np.exp(-z)) if logits else ()) if p >= sentence_threshold]
            return noisy_or(z), len(bad), ",".join(bad)

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(t or "") for t in part.column("text").to_pylist()]
            s = [r[0] for r in rows]
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])],
                names=["doc_id", "score", "predicted", "n_offending", "offending"],
            )

        return each

    scored = map_slices(docs.select("doc_id", "text"), work, "doc_id long, score double, predicted int, n_offending long, offending string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_offending", "offending")
