import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import ranking, varbyte
from quillspark.functions.text import MARK, UNAVAILABLE, UNMARK, snippet, term_counts, tokenize
from quillspark.operators import index, prune, search, verify
from quillspark.plans import staging
from quillspark.plans.ordinals import with_ordinal, with_running_sum
from quillspark.sources import collection
from quillspark.streaming.incremental import index_stream

DELIMITERS = " \t\n\r\f.,;:!?[]{}()<>\"'`~@#$%^&*-+=|\\/_"


def plain_tokens(text):
    out, word = [], ""
    for c in text:
        if c in DELIMITERS:
            out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return [w for w in (*out, word) if w]


def table(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, pid long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_idx int, query string")


def test_tokenize(spark):
    texts = [f"aB{c}Cd" for c in DELIMITERS] + ["a\x0bb", "a\xa0b", "É ÉTÉ don't", "", None, "...", "x" * 50_000, "K İ"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokenize(F.col("t"))).collect()]
    assert got == [plain_tokens(t or "") for t in texts]


def test_term_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 30, 500)]
    rows = table(spark, texts).orderBy("doc_id").select(term_counts(tokenize(F.col("text"))).alias("c")).collect()
    assert [{x["term"]: x["freq"] for x in r["c"]} for r in rows] == [dict(Counter(t.split())) for t in texts]


def plain_rank(texts, query, mode):
    docs = [plain_tokens(t or "") for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / max(1, len(docs))
    df = Counter(t for d in docs for t in set(d))
    words = plain_tokens(query)
    scores = {}
    for i, d in enumerate(docs):
        if not words or mode == search.AND and not all(w in d for w in words):
            continue
        s = sum(max(0, math.log((n - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * (f := d.count(w)) / (1.2 * (0.25 + 0.75 * len(d) / avg) + f)) for w in words if w in d)
        if s > 0:
            scores[i] = round(s, 6)
    return [(d, s) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]]


@pytest.mark.parametrize("mode", [search.AND, search.OR])
def test_ranking_against_plain_python(spark, mode):
    rng = random.Random(417)
    vocabulary = ["city", "water", "pizza", "brooklyn", "new", "york", "manhattan", "the", "café"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 10), k=rng.randrange(0, 30))) for _ in range(150)] + [None, "", "pizza " * 40] + ["tie city"] * 15
    queries = [*vocabulary, "absent", "CITY, pizza!", "!!!", "", *(" ".join(rng.choices([*vocabulary, "absent"], k=rng.randrange(2, 8))) for _ in range(40))]
    got = {}
    for r in search.search(table(spark, texts), asked(spark, *queries), mode).orderBy("query_idx", "rank").collect():
        got.setdefault(r["query_idx"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["query_idx"]])
    for i, q in enumerate(queries):
        want = plain_rank(texts, q, mode)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got.get(i, []), want))


def test_many_terms_take_the_shuffled_way(spark, monkeypatch):
    texts = ["a b c", "b c d", "c d e f", "x"]
    want = search.search(table(spark, texts), asked(spark, "a b", "c d e"), search.OR).collect()
    monkeypatch.setattr(search, "CONSTANT_TERMS", 2)
    assert sorted(search.search(table(spark, texts), asked(spark, "a b", "c d e"), search.OR).collect()) == sorted(want)


def test_empty_collection(spark):
    assert search.search(table(spark, ["x"]).limit(0), asked(spark, "x"), search.OR).count() == 0
    assert index.corpus_stats(spark.createDataFrame([], "length int")).first()["avg_len"] == 0


def test_varbyte_round_trip_and_truncation(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1]
    row = spark.createDataFrame([(values,)], "v array<long>").withColumn("c", varbyte.encode(F.col("v"))).select("c", varbyte.decode(F.col("c")).alias("d"), varbyte.decode(F.expr("substring(c, 1, length(c) - 1)")).alias("cut"), varbyte.decode(F.lit(b"")).alias("none")).first()
    assert row["d"] == values and row["cut"] == values[:-1] and row["none"] == []
    assert bytes(row["c"]) == b"".join(bytes(x) for x in ([0], [1], [127], [128, 1], [255, 127], [128, 128, 1], [128, 128, 128, 1], [128, 128, 128, 128, 1], [255, 255, 255, 255, 15]))


def test_up_to_float_is_the_least_upper_bound(spark):
    import numpy as np

    rng = random.Random(5)
    values = [rng.random() * 10 ** rng.randrange(-6, 6) for _ in range(500)] + [0.0, 1.0, 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranking.up_to_float(F.col("v")).cast("double").alias("f")).collect()
    for r in rows:
        near = np.float32(r["v"])
        assert r["f"] == float(near if float(near) >= r["v"] else np.nextafter(near, np.float32(np.inf)))


def plain_snippet(text, terms):
    ws = plain_tokens(text)
    hits = [i for i, w in enumerate(ws) if w in terms]
    start, end, best = 0, min(100, len(ws)), None
    for c in hits:
        a, b = max(0, c - 50), min(len(ws), c + 50)
        inside = [h for h in hits if a <= h < b]
        worth = len(inside) * 1000 - (inside[-1] - inside[0])
        if best is None or worth > best:
            best, start, end = worth, a, b
    shown = [MARK + w + UNMARK if w in terms else w for w in ws[start:end]]
    return ("... " if start else "") + " ".join(shown) + (" ..." if end < len(ws) else "")


def test_snippets(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["filler", "other", "words", "pizza", "café"], weights=[60, 30, 20, 1, 1], k=n)) for n in (0, 1, 5, 99, 100, 101, 250, 700)]
    texts.append("pizza " + "x " * 200 + "pizza café pizza" + " y" * 150)
    got = table(spark, texts).orderBy("doc_id").select(snippet(F.col("text"), F.array(F.lit("pizza"), F.lit("café")))).collect()
    assert [r[0] for r in got] == [plain_snippet(t, {"pizza", "café"}) for t in texts]
    assert spark.range(1).select(snippet(F.lit(None).cast("string"), F.array(F.lit("a")))).first()[0] == UNAVAILABLE


def test_ordinals_and_sums_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(100)) for i in rng.sample(range(10_000), 3_000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    assert [(r["k"], r["n"]) for r in with_ordinal(df, ["k"], "n").orderBy("k").collect()] == [(k, i) for i, (k, _) in enumerate(sorted(rows))]
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert {r["k"]: r["s"] for r in with_running_sum(df, ["k"], F.col("v"), "s").collect()} == want


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_chunks_of_lists_over_many_ranges(spark, partitions):
    """A third of all postings is one term's, so its list is in most ranges and chunks begin in one and end in the next."""
    rows = [("hot" if i % 3 else f"g{i % 50:02}", i, 1 + i % 7, 10 + i % 5) for i in range(4_000)] + [("last", 3, 2, 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spark.createDataFrame(rows, "term string, doc_id long, freq long, length int").repartition(5)
        stats = spark.createDataFrame([(9_000, 99_000, 11.0)], "n long, total_len long, avg_len double")
        chunks = index.chunks(found, stats).orderBy("term", "chunk_idx").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lists = {}
    for t, d, f, n in sorted(rows):
        lists.setdefault(t, []).append((d, f, n))
    want = [(t, k, x[64 * k : 64 * k + 64]) for t, x in sorted(lists.items()) for k in range(-(-len(x) // 64))]
    assert [(c["term"], c["chunk_idx"], c["docids"], c["freqs"]) for c in chunks] == [(t, k, [p[0] for p in x], [p[1] for p in x]) for t, k, x in want]
    scored = {(r["term"], r["doc_id"]): r["contribution"] for r in index.contributions(found, stats).collect()}
    assert all(abs(c["contributions"][i] - scored[c["term"], d]) < 1e-12 for c in chunks for i, d in enumerate(c["docids"]))
    broken = spark.createDataFrame(chunks[:3] + [chunks[3].asDict() | {"docids": chunks[3]["docids"][::-1]}], index.chunks(found, stats).schema)
    assert verify.monotonic_audit(broken).first()["violations"] >= 1


def test_folders_are_shared_or_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext, conf = Context, {"spark.checkpoint.dir": ""}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert staging.shared_folder(Session) == "hdfs://x/y"
    assert spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"


def lines(tmp_path, data):
    (tmp_path / "c.tsv").write_bytes(data)
    return str(tmp_path / "c.tsv")


def test_collection_lines(spark, tmp_path):
    data = "7\thello World\r\nno tab here\nabc\tx\n 12xyz\tcafé ÉTÉ\n-1\tneg\n5\t\n99\tlast\tone".encode()
    rows = collection.passage_table(spark, lines(tmp_path, data)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["pid"], r["length"]) for r in rows] == [(0, 7, 2), (1, 12, 2), (2, 4294967295, 1), (3, 5, 0), (4, 99, 2)]
    starts = [0]
    for line in data.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    assert [r["file_offset"] for r in rows] == [starts[i] for i in (0, 3, 4, 5, 6)]
    assert collection.scan_collection(spark, lines(tmp_path, data)).where("doc_id = 4").first()["text"] == "last\tone"


def test_ids(spark):
    cases = {"-1": 2**32 - 1, "4294967296": 0, "18446744073709551616": None, "18446744073709551615": 2**32 - 1, "0x10": 0, "+3": 3, "": None, "-": None, " \t8": 8, "00000000000000000000000012": 12, "1.5": 1}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", collection.parse_id(F.col("s")).alias("p")).collect()
    assert {r["s"]: r["p"] for r in rows} == cases


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_bytes(b"one\r\n\r\n\n!!!\ntwo\r\r\nlast")
    rows = collection.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_idx").collect()
    assert [(r["query_idx"], r["query"]) for r in rows] == [(0, "one"), (1, "!!!"), (2, "two\r"), (3, "last")]


def test_stored_index_command_line_and_guards(spark, tmp_path, monkeypatch, capsys):
    data = "".join(f"{5000 + 7 * i}\tmarker{i} café {'pizza ' * (i + 1) if i < 12 else 'filler'}\n" for i in range(40)).encode().rstrip(b"\n")
    source, at, out = lines(tmp_path, data), str(tmp_path / "index"), str(tmp_path / "out")
    (tmp_path / "q.txt").write_text("pizza\nmarker3 pizza\nabsent\n")
    assert cli.main(["build", source, at]) == 0
    assert cli.main(["query", at, "--collection", source, "--batch", str(tmp_path / "q.txt"), "--mode", "1", "--out", out, "--snippets"]) == 0
    got = [r["value"].split("\t") for r in spark.read.text(out).collect()]
    assert {x[0] for x in got} == {"0", "1"} and got[0][1] == "1" and all(len(x) == 5 and int(x[2]) >= 5000 for x in got)
    assert cli.main(["verify", at, "1"]) == 0
    answers = iter(["pizza", "0", "", "exit"])
    monkeypatch.setattr("builtins.input", lambda prompt="": next(answers))
    capsys.readouterr()
    assert cli.main(["query", at]) == 0
    said = capsys.readouterr().out
    assert "1. [5077]" in said and "2. [5070]" in said  # the passages' own ids, not their numbers
    assert cli.main(["query", at, "--batch", str(tmp_path / "q.txt"), "--mode", "1", "--out", out, "--time-each", "--walk"]) == 0
    said = capsys.readouterr().out
    assert "3 queries, mode 1 (OR)" in said and "latency (ms): n=3 p50=" in said and "25 of 25 postings needed" in said and "walk: 25 of 25 postings scored" in said
    assert cli.main(["query", at, "--batch", str(tmp_path / "q.txt"), "--mode", "0", "--out", out]) == 0 and "pruning" not in capsys.readouterr().out
    assert cli.main(["check", at, source, "pizza", "café", "absent"]) == 0
    said = capsys.readouterr().out
    assert "ok  pizza 12" in said and "ok  café 40 0.0" in said and "ok  absent is in neither" in said
    for n, other in enumerate((data.split(b"\n", 1)[1], data.replace(b"filler", b"filler more"), data.replace(b"caf", b"pizza-caf", 1), data.replace(b"filler", b"pizza", 3))):
        (tmp_path / f"other{n}.tsv").write_bytes(other)
        assert cli.main(["check", at, str(tmp_path / f"other{n}.tsv"), "pizza"]) == 1
    assert "BAD pizza" in capsys.readouterr().out
    for bad in (["verify", at, "0"], ["query", at, "--batch", "q"], ["query", at, "--batch", "q", "--mode", "2", "--out", "x"], ["query", at, "--snippets"]):
        assert cli.main(bad) == 1
    spark.read.parquet(f"{at}/postings").limit(3).write.mode("overwrite").parquet(f"{at}/other")
    spark.read.parquet(f"{at}/other").write.mode("overwrite").parquet(f"{at}/postings")
    with pytest.raises(ValueError, match="stale"):
        collection.load_index(spark, at)


@pytest.mark.parametrize("table, change", [("passages", "length + 1 as length"), ("stats", "n + 1 as n"), ("lexicon", "doc_count + 1 as doc_count"), ("chunks", "last_docid + 1000 as last_docid")])
def test_tables_that_disagree_are_refused(spark, tmp_path, table, change):
    at = str(tmp_path / "index")
    collection.save_index(table_of := spark.createDataFrame([(i, i, f"a b{i}") for i in range(9)], "doc_id long, pid long, text string"), at)
    assert collection.load_index(spark, at)["passages"].count() == table_of.count()
    column = change.split(" as ")[1]
    spark.read.parquet(f"{at}/{table}").withColumn(column, F.expr(change.split(" as ")[0])).write.parquet(f"{at}/changed")
    spark.read.parquet(f"{at}/changed").write.mode("overwrite").parquet(f"{at}/{table}")
    with pytest.raises(ValueError, match="stale"):
        collection.load_index(spark, at)


def test_terms_that_are_too_long_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="65536 bytes"):
        collection.save_index(table(spark, ["x" * 65_536]), str(tmp_path / "index"))


def test_pruning_drops_chunks_and_keeps_the_top(spark):
    rng = random.Random(9)
    texts = [" ".join(["rare"] * (1 + (9 if i < 60 else 0)) + ["pad"] * rng.randrange(1, 40)) if i % 3 == 0 else "common " * rng.randrange(1, 3) + "pad" for i in range(3_000)]
    docs = table(spark, texts)
    found = index.postings(docs)
    stats = index.corpus_stats(docs.select(F.size(tokenize(F.col("text"))).alias("length")))
    scored = index.contributions(found, stats)
    chunks = index.chunks(found, stats)
    lexicon = index.lexicon(chunks)
    queries = asked(spark, "rare", "rare rare", "absent")
    terms = search.query_terms(queries)
    verdicts = prune.chunk_verdicts(terms, chunks, lexicon, prune.thresholds(terms, chunks))
    assert verdicts.where("not needed").count() > 0
    want = search.search(docs, queries, search.OR).select("query_idx", "rank", "doc_id", "score")
    assert sorted(prune.pruned_top(verdicts).collect()) == sorted(want.collect())
    assert verify.bound_audit(chunks, scored).first()["violations"] == 0
    assert verify.monotonic_audit(chunks).first()["violations"] == 0


def test_stream_appends_and_repeats_no_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        table(spark, ["a b", "b c"]).selectExpr(f"doc_id + {10 * i} as doc_id", f"pid + {10 * i} as pid", "text").write.mode("append").parquet(source)
        query = index_stream(spark.readStream.schema("doc_id long, pid long, text string").parquet(source), out, str(tmp_path / "check"))
        query.awaitTermination()
    found = spark.read.parquet(f"{out}/postings").select("term", "doc_id", "freq", "length")
    batch = index.postings(spark.read.parquet(source))
    assert sorted(found.collect()) == sorted(batch.collect())
