"""Lookups in licence tables of any size."""

from quillspark.llm import common, license_scan


def test_both_branches_give_the_same_rows(spark, docs, monkeypatch):
    said = "prose\nReleased under the MIT Licence.\nLicensed under CC BY 4.0.\nReleased under the MIT license"
    more = [(900, said), (900, said), (901, "No such license."), (902, license_scan.KNOWN[0][1]), (None, said), (None, None)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = lambda x: (x.schema.names, sorted(map(repr, x.collect())))
    want = rows(license_scan.scan(df))
    assert sum("CC-BY-4.0,MIT" in r for r in want[1]) == 3
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 1)
    assert rows(license_scan.scan(df)) == want
    assert license_scan.scan(df.limit(0)).count() == 0


def test_whole_texts_of_a_folder(spark, tmp_path):
    unlicense = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish or use this software."
    (tmp_path / "Unlicense.txt").write_text(unlicense)
    (tmp_path / "notes.md").write_text("not a licence")
    rows = [(1, "Copyright (c) 2021 A. Person\n" + unlicense.upper()), (2, license_scan.KNOWN[0][1]), (3, "not a licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["is_license"]) for r in license_scan.scan(df, license_scan.listed(tmp_path)).collect()}
    assert got == {1: ("Unlicense", True), 2: ("MIT", True), 3: (None, False)}
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(df).collect()} == {1: None, 2: "MIT", 3: None}
    assert {r["license_id"] for r in license_scan.scan(df, ()).collect()} == {None}


def test_common_licences_are_found_however_they_are_set(spark):
    texts = {p.stem: p.read_text() for p in license_scan.FOLDER.iterdir()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= texts.keys()
    changed = lambda t: "Copyright (c) 1999, 2001 A. Person\n\n" + "\n\n".join("  * " + line.upper().replace('"', "\u201c") for line in t.split("\n"))
    rows = [(name, t) for name, text in texts.items() for t in (text, changed(text))] + [("none", texts["MPL-2.0"][:-400])]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]), ("BSD-3-Clause", texts["BSD-3-Clause"].split("\n", 1)[1])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(df).collect()}
    assert [got[i] or "none" for i in range(len(rows))] == [name for name, _ in rows]


def test_large_tables_keep_the_licences_of_lines(spark, monkeypatch):
    """A table beyond the limit is joined by a shuffle, hot digests spread."""
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "TOGETHER_ROWS", 3)
    more = tuple((f"X-{i}", f"Terms of license number {i}.") for i in range(3_000))
    rows = [(i, f"prose\nReleased under the MIT License.\nTerms of license number {i}.\n") for i in range(40)] + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["line_licenses"] for r in license_scan.scan(df, license_scan.KNOWN + more).collect()}
    assert got == {i: f"MIT,X-{i}" for i in range(40)} | {None: ""}
