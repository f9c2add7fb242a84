import re
from collections import Counter

import duckdb
from comparing import SMALL, assert_same, duck

from quillspark.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_plain_python(docs, corpus):
    rows = q.judge(docs).collect()
    assert len(rows) == len(corpus)
    got = sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    want = []
    for i, t, *_ in corpus:
        m = plain(t)
        want.append((repr(i), *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want)
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)


def test_sql_gives_the_same(spark):
    assert_same(q.judge(spark.read.parquet(f"{SMALL}/documents.parquet")), q.sql(), duck())


def test_sql_on_edge_cases(docs, corpus):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in corpus if not t or "\x00" not in t])
    assert_same(q.judge(docs.where("text is null or instr(text, chr(0)) = 0")), q.sql(), con)


def test_accepted_keeps_columns(docs):
    kept = q.accepted(docs)
    assert kept.schema == docs.schema
    assert kept.count() == q.judge(docs).where("kept").count() > 0


def test_empty_table_and_no_python_in_the_plan(docs):
    judged = q.judge(docs.limit(0))
    assert judged.count() == 0
    plan = q.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_custom_table(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert q.judge(df, (("short", "n_words", 4, None), ("long", "n_words", None, 2))).first()["failed_rules"] == "short,long"
