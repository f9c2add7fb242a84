import random

from comparing import SMALL
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.functions import varbyte
from quillspark.functions.text import term_counts, tokenize
from quillspark.operators import index, search, verify
from quillspark.sources import collection


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_count_terms_once_and_compiled(spark):
    docs = spark.createDataFrame([(1, 1, "b a b"), (2, 2, None), (3, 3, " ! ")], "doc_id long, pid long, text string")
    found = index.postings(docs)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1, 3), ("b", 1, 2, 3)]
    assert plan(found).count("regexp_extract_all") == 1 and "lambda" not in plan(found)


def test_many_repeats_and_prefixes(spark):
    texts = ["x " * 300_000, "ab a abc ab a.b", "é É é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(term_counts(tokenize(F.col("t")))).collect()
    assert [[tuple(x) for x in r[0]] for r in rows] == [[("x", 300_000)], [("a", 2), ("ab", 2), ("abc", 1), ("b", 1)], [("É", 1), ("é", 2)]]


def test_document_frequencies_need_no_counts_in_passages(spark):
    for name in ("idf", "query_cost", "list_order"):
        assert "array_distinct" in plan(queries.QUERIES[name](spark, SMALL))


def test_chunks_that_lie_in_several_blocks(spark):
    rng = random.Random(3)
    lists = {t: sorted(rng.sample(range(2_000), n)) for t, n in (("all", 2_000), ("half", 1_000), ("few", 70), ("chunk", 64), ("two", 2), ("one", 1))}
    found = spark.createDataFrame([(t, d, 1 + d % 200, 9) for t, ids in lists.items() for d in ids], "term string, doc_id long, freq long, length int").repartition(3)
    stats = spark.createDataFrame([(9_000, 99_000, 11.0)], "n long, total_len long, avg_len double")
    want = sorted((t, k, ids[64 * k : 64 * k + 64]) for t, ids in lists.items() for k in range(-(-len(ids) // 64)))
    for edges in ([], [64], [1, 63, 64, 65, 700, 701, 1_999], [5_000]):
        got = sorted(map(tuple, index.chunks(found, stats, edges).select("term", "chunk_idx", "docids", "freqs").collect()))
        assert [x[:3] for x in got] == want and all(x[3] == [1 + d % 200 for d in x[2]] for x in got)
        assert verify.monotonic_audit(index.chunks(found, stats, edges)).first()[1:] == (0, 0)


def test_blocks_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 100)
    ids = spark.createDataFrame([(i**3,) for i in range(1_000)], "doc_id long")
    edges = index.block_edges(ids)
    assert len(edges) == 9 and all(abs(r["count"] - 100) <= 5 for r in ids.groupBy(index._block(edges).alias("b")).count().collect())


def test_pruning_builds_only_the_lists_of_the_batch(spark):
    p = queries.Pruning(spark, SMALL)
    asked = {r.term for r in search.query_terms(queries.batch(spark)).collect()}
    assert {r.term for r in p.chunks.select("term").distinct().collect()} <= asked


def test_codes_are_not_folded_byte_by_byte(spark):
    values = [0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**32 - 1] * 30
    df = spark.createDataFrame([(values,)], "v array<long>").select(varbyte.decode(varbyte.encode(F.col("v"))).alias("d"), varbyte.total(F.col("v")).alias("n"), F.length(varbyte.encode(F.col("v"))).alias("m"))
    row = df.first()
    assert row["d"] == values and row["n"] == row["m"]
    assert "aggregate" not in plan(df.select("d"))


def test_stored_postings_are_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 20)
    docs = spark.createDataFrame([(i, i, f"all g{i % 3} u{i}") for i in range(100)], "doc_id long, pid long, text string")
    collection.save_index(docs, str(tmp_path / "x"))
    kept = spark.read.parquet(str(tmp_path / "x" / "postings"))
    assert sorted(kept.collect()) == sorted(index.postings(docs).collect())
    for file in (tmp_path / "x" / "postings").glob("*.parquet"):
        rows = [(r.term, r.doc_id) for r in spark.read.parquet(str(file)).collect()]
        assert rows == sorted(rows)


def test_audit_of_bounds_reads_the_texts_no_second_time(spark):
    built = queries.Built(spark, SMALL)
    scored = index.contributions_of(built.blocks, built.stats)
    assert "split(" not in plan(scored)
    want = {(r.term, r.doc_id): r.contribution for r in built.scored().collect()}
    assert {(r.term, r.doc_id): r.contribution for r in scored.collect()} == want


def test_lists_of_some_terms_and_statistics_come_from_one_pass(spark):
    built = queries.Built(spark, SMALL, queries.SPOT_TERMS)
    assert "split(" not in plan(built.postings) and built.stats.collect() == index.outline(built.docs)[0].collect()
    assert sorted(built.postings.collect()) == sorted(index.postings(built.docs, queries.SPOT_TERMS).collect())
    assert built.edges == index.outline(built.docs)[1] and queries.Built(spark, SMALL, ()).postings.isEmpty()


def test_audit_of_best_scores_compares_only_the_spot_terms_own_tokens(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(verify, "cut", lambda df: staged.append(df) or df)
    docs = spark.createDataFrame([(1, 1, "b a b"), (2, 2, "x y"), (3, 3, "x z"), (4, 4, None)], "doc_id long, pid long, text string")
    lexicon = spark.createDataFrame([("b", 1, 0.0)], "term string, doc_count long, max_score double")
    found = {r.term: (r.doc_count, r.ok) for r in verify.max_score_audit(lexicon, docs, ("b", "x", "absent")).collect()}
    assert found == {"b": (1, False), "x": (None, False)}
    assert " IN (" in plan(staged[0]) and [r.freqs for r in staged[0].orderBy("length", F.desc("freqs")).collect()] == [[0, 0, 0], [0, 1, 0], [0, 1, 0], [2, 0, 0]]


def test_lists_in_blocks_are_guessed_and_give_the_same_chunks_whatever_the_guess(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 20)
    docs = spark.createDataFrame([(i, i, f"all all g{i % 3} u{i}" + " late" * (i > 80)) for i in range(200)], "doc_id long, pid long, text string")
    stats, edges, _ = index.outline(docs)
    guess = index.long_terms(docs, edges)
    assert len(edges) == 9 and guess == ["all", "g0", "g1", "g2", "late"] and index.long_terms(docs, []) is None
    found, show = index.postings(docs), lambda df: sorted(map(repr, df.collect()))
    want = show(index.chunks(found, stats, []))
    for long in (None, [], ["all"], ["late", "absent", "u3"], guess):
        blocks = index.lists(found, edges, long)
        whole = blocks.where("term like 'u%'" if long is None or "u3" not in long else "term like 'g%'")
        assert long is None or whole.where("block <> 0").isEmpty() and whole.count() == whole.select("term").distinct().count()
        assert show(index.chunks_of(index.placed(blocks, edges, long), stats)) == want
    assert plan(index.placed(index.lists(found, edges, guess), edges, guess)).count("strategy=broadcast") == 1


def test_postings_move_as_numbers_where_63_bits_do(spark):
    for ids, fits in (([-5, 3, 1 << 40], True), ([3, 1 << 61], False), ([-(1 << 61), 1 << 61], False)):
        docs = spark.createDataFrame([(i, i, "b a b" + " c" * k) for k, i in enumerate(ids)], "doc_id long, pid long, text string")
        stats, edges, packed = index.outline(docs)
        found = index.postings(docs)
        blocks = index.lists(found, edges, None, packed)
        assert (packed is not None) == fits == (dict(blocks.dtypes)["x"] == "array<bigint>")
        assert sorted(index.postings_of_lists(blocks).collect()) == sorted(found.collect())
        same = [sorted(map(repr, index.chunks_of(index.placed(b, edges), stats).collect())) for b in (blocks, index.lists(found, edges))]
        assert same[0] == same[1]
