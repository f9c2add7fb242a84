"""Languages that the mixture doesn't list."""

from fractions import Fraction

import corpus_pipeline
from quillspark.llm import mixing as m
from quillspark.llm import queries

ROWS = [(i, "some words of text here " * 4, lang, f"src{i % 8}", 96) for i, lang in enumerate(["en", "de", "fr", "es", "it", None] * 40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlisted_children_share_by_size():
    weights = {("en",): 3, ("de",): 1, (m.OTHER,): 1}
    available = {("en",): 400, ("de",): 400, ("it",): 150, ("",): 50}
    assert m.budgets(available, weights, 100, 1) == {("en",): 60, ("de",): 20, ("it",): 15, ("",): 5}
    assert m.budgets(available, weights, 1000, 1) == available
    listed = {k: n for k, n in available.items() if k in weights}
    assert m.budgets(listed, weights, 100, 1) == m.budgets(listed, {k: w for k, w in weights.items() if k != (m.OTHER,)}, 100, 1) == {("en",): 75, ("de",): 25}
    assert m.budgets({("it",): 7}, weights, 5, 1) == {("it",): 5}
    assert m.budgets({("en",): 0, ("it",): 0}, weights, 5, 1) == {("en",): 0, ("it",): 0}
    assert m.budgets({("en",): 10, ("it",): 10}, {("en",): 0, (m.OTHER,): Fraction(1)}, 20, 1) == {("en",): 0, ("it",): 10}


def test_op5_and_stage_choose_unlisted_languages(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    chosen = {r["lang"] for r in queries.op5_mixing(spark, str(tmp_path)).collect()}
    assert chosen == {"en", "de", "fr", "es", "it", ""}
    kept = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert {r["lang"] for r in kept.collect()} == {"en", "de", "fr", "es", "it", None}
