"""What the bounded training sample leaves out."""

import pytest
from pyspark.sql import functions as F
from test_text_operators import toxic_set

from quillspark.llm import toxicity


@pytest.fixture
def seen(monkeypatch):
    found = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: found.append(sorted(zip(texts, labels))) or toxicity.Model(0.0, {}))
    return found


def learnable(spark, rows):
    """The rows that may be learnt from, in the order of the sample."""
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return [tuple(r) for r in df.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]


@pytest.mark.parametrize("place", [0, 20])
def test_long_texts_leave_the_others_in(spark, seen, place):
    rows = learnable(spark, toxic_set(60, 1))
    rows[place] = (rows[place][0], "x" * 40_000, 0)
    rows[place + 1] = (rows[place + 1][0], "y" * 25_000, 0)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.train(df, df, sample_rows=60, sample_bytes=30_000)
    rest = [(t, y) for i, (_, t, y) in enumerate(rows) if i not in (place, place + 1)]
    assert 5_000 < sum(len(t) for t, _ in rest) < 30_000
    assert seen[0] == sorted(rest)  # neither fits beside the others


def test_limit_counts_only_rows_with_a_text(spark, seen):
    rows = learnable(spark, toxic_set(80, 2))
    texts = [(i, t if n % 4 == 3 else "" if n % 4 else None) for n, (i, t, _) in enumerate(rows)]
    docs = spark.createDataFrame(texts[2:], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    toxicity.train(docs, labels, sample_rows=10)
    assert seen[0] == sorted([(t, y) for n, (_, t, y) in enumerate(rows) if n % 4 == 3][:10])


def test_repeated_rows_count_each(spark, seen):
    rows = learnable(spark, toxic_set(20, 3))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, toxic int")
    toxicity.train(df.drop("toxic"), spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert seen[0] == sorted((t, y) for _, t, y in rows + rows[:3])


def test_fitting():
    assert toxicity.fitting([5, 90, 5, 40, 8], 60, 30) == [0, 2, 3, 4]
    assert toxicity.fitting([50, 5, 5], 55, 30) == [1, 2]
    assert toxicity.fitting([], 5, 1) == []
