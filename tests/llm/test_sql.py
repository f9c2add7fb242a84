"""Every operator that SQL can express, over a small table and over edge cases."""

import duckdb
import pytest
from comparing import SMALL, assert_same, duck

from quillspark.llm import media_columns, near_dedup, queries, secret_scan, suffix_dedup

ON_EDGES = {
    "near": (near_dedup.components, near_dedup.sql()),
    "suffix": (lambda docs: suffix_dedup.deduplicate(docs, digests=True), suffix_dedup.sql()),
    "media": (media_columns.payloads, media_columns.sql()),
    "secrets": (secret_scan.report, secret_scan.sql()),
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_small_table(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.SQL[name], duck())


@pytest.mark.parametrize("name", sorted(ON_EDGES))
def test_edge_cases(spark, corpus, name):
    """Nulls, repeats, ids with several texts, odd characters."""
    shared = " ".join(f"w{i}" for i in range(60))
    more = [(700, f"{shared} a", None, None), (701, f"{shared} b", None, None), (701, "quite another text of its own", None, None), (702, "quite another text of its own", "s", "en"), (-5, f"{shared} c", None, None)]
    rows = [r for r in corpus if not r[1] or "\x00" not in r[1]] + more
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    run, sql = ON_EDGES[name]
    assert_same(run(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), sql, con)
