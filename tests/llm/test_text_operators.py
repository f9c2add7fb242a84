"""Token counts, media columns, licence scans, toxicity and secret scans."""

import hashlib
import io
import math
import random
import re
import time
import wave
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from comparing import SMALL, assert_same, duck
from pyspark.sql import functions as F

from quillspark.llm import common, license_scan, media_columns, secret_scan, token_counts, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(pieces, longest, word):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_token_counts_against_greedy_pieces(docs, corpus):
    m = token_counts.PieceModel(PATH)
    pieces = {p for p, byte, raw in zip(m.pieces, m.is_byte, m.raw) if raw and not byte}
    longest = max(map(len, pieces))
    want = []
    for i, t, *_ in corpus:
        found = [greedy(pieces, longest, "▁" + w.decode()) for w in (t or "").encode().split()]
        want.append((repr(i), len(found), sum(max(1, n) if n > 0 else 1 for n in found), found.count(-1)))
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_tokens"], r["n_unknown_words"]) for r in rows) == sorted(want)


def test_automaton_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(100):
        pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))} | {"▁" + "".join(rng.choices("abc", k=rng.randrange(0, 5))) for _ in range(4)}
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 14))) for _ in range(40)]
        assert token_counts.Automaton(sorted(pieces)).counts(words).tolist() == [greedy(pieces, 6, "▁" + w) for w in words]
    assert token_counts.Automaton(["a"]).counts([]).tolist() == []


@pytest.mark.parametrize("few", [0, 5, 10**6])
def test_rounds_and_plain_steps_agree(monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    rng = random.Random(3)
    run = token_counts.automaton(PATH)
    words = ["".join(rng.choices("theandionqz▁é", k=rng.randrange(1, 60))) for _ in range(200)] + ["ab" * 3_000, "\u0378" + "a" * 500, ""]
    monkeypatch.setattr(token_counts, "FEW", 64)
    want = run.counts(words).tolist()
    monkeypatch.setattr(token_counts, "FEW", few)
    assert run.counts(words).tolist() == want


def test_a_word_of_a_million_characters_takes_linear_time():
    run, took = token_counts.automaton(PATH), []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        assert run.counts(["ab" * (n // 2)])[0] > 0
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_lookups():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 5_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        asked = np.concatenate((keys, rng.integers(0, 1 << 40, 1_000)))
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert common.Lookup(keys)(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_long_words_score_alike_without_a_cache():
    score = toxicity.Model(-1.0, {"a": 2.0}).scorer()
    assert score({"a", "b" * 100}) == score({"b" * 100, "a"}) == 1.0


def test_media_round_trip(docs, corpus):
    rows = media_columns.store(docs, digests=True).collect()
    want = []
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        want.append((repr(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) + 44))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) for r in rows) == sorted(want)
    features = {}
    texts = {i: t for i, t, *_ in corpus}
    for r in rows:
        assert features.setdefault(texts[r["doc_id"]] if r["doc_id"] is not None else r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
    full = media_columns.store(docs).where("doc_id = 2").first()
    with wave.open(io.BytesIO(full["media"])) as w:
        assert w.readframes(w.getnframes()).startswith((corpus[2][1] or "").encode())
    assert len(full["times"]) == len(full["codes"]) and full["times"] == sorted(full["times"])
    assert media_columns.store(docs.limit(0)).count() == 0


def test_peaks_of_a_tone_and_blocks(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 24 * np.arange(192 * 40) / 192)).astype(np.uint8).tobytes()
    t, f = media_columns.peaks(tone)
    assert set(f[np.unique(t, return_index=True)[1]].tolist()) == {24}
    data = bytes(random.Random(1).randrange(256) for _ in range(192 * 50))
    whole = media_columns.peaks(data)
    monkeypatch.setattr(media_columns, "BLOCK_FRAMES", 7)
    assert all((a == b).all() for a, b in zip(whole, media_columns.peaks(data)))
    assert media_columns.peaks(b" " * 192)[0].size == 0


def plain_peaks(payload):
    """(frame, bin) of the two strongest local maxima of each frame, by a transform written out."""
    found = []
    turn = [[complex(math.cos(2 * math.pi * k * n / 192), -math.sin(2 * math.pi * k * n / 192)) for n in range(192)] for k in range(97)]
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * n / 191) for n in range(192)]
    for frame, at in enumerate(range(0, len(payload) - 191, 96)):
        x = [b - 128 for b in payload[at : at + 192]]
        mean = sum(x) / 192
        x = [(v - mean) * w for v, w in zip(x, hann)]
        level = [math.floor(8 * math.log2(1 + abs(sum(v * t for v, t in zip(x, row))))) for row in turn]
        best = sorted((-level[k], k) for k in range(1, 96) if level[k] > level[k - 1] and level[k] >= level[k + 1] and level[k] > 8)
        found += [(frame, k) for _, k in best[:2]]
    return found


def plain_pairs(found):
    """(frame, code) of all peaks with those of the next three frames."""
    return sorted((t, (f << 9) | (g << 2) | (u - t)) for t, f in found for u, g in found if 0 < u - t <= 3)


def test_peaks_and_pairs_against_plain_python():
    rng = random.Random(8)
    for payload in (bytes(rng.randrange(256) for _ in range(192 * 4)), ("the quick brown fox " * 40).encode()[:768], b" " * 192, b"a" * 100 + b" " * 92, "é日本語 ".encode() * 64):
        payload = media_columns.padded(payload)
        t, f = media_columns.peaks(payload)
        want = plain_peaks(payload)
        assert list(zip(t.tolist(), f.tolist())) == want
        times, codes = media_columns.pair_codes(t, f)
        assert list(zip(times.tolist(), codes.tolist())) == plain_pairs(want)


def test_licences(spark):
    mit = license_scan.KNOWN[7][1]
    texts = [mit, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace('"', "“"), mit.replace("sublicense", "sub-license"), mit + " And more.", "prose\nReleased under the MIT Licence.\nLicensed under CC BY 4.0.", None, "", "license"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    rows = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan.scan(df).collect()}
    assert [rows[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert rows[4][1] == "CC-BY-4.0,MIT" and rows[5][1] == ""
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licences_as_sql(spark, docs, corpus):
    assert_same(license_scan.scan(spark.read.parquet(f"{SMALL}/documents.parquet")), license_scan.sql(), duck())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in corpus if not t or "\x00" not in t])
    assert_same(license_scan.scan(docs.where("text is null or instr(text, chr(0)) = 0")), license_scan.sql(), con)


def test_large_licence_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 1)
    df = spark.createDataFrame([(1, "Released under the MIT license")], "doc_id long, text string")
    assert license_scan.scan(df).first()["license_id"] == "MIT"


def secret_docs():
    rng = random.Random(5)
    token = lambda n, a: "".join(rng.choices(a, k=n))
    mixed = "ABCDEFGHIJabcdefghij0123456789"
    example = "Ex0" + token(30, mixed)
    texts = [
        'say password="hunter22" now', "API_KEY: abc", "apikey=abcdef", "secret: token: abcdefghij", "AKIA" + token(16, "ABCDEF0123"), "AKIAKIA", "xAKIA" + token(10, "AB"),
        token(24, "0123456789abcdef"), token(23, "0123456789abcdef"), f"é😀 token = {token(40, 'abcdef0123')} end", "ſecret=abcdefgh toKen=abcdefgh", "passwd'='x/y+z-1.2_3", "Lv1" + token(30, mixed), None, "", "token=secret=abcdefg",
    ]
    rows = [(i, t, "src1", "en") for i, t in enumerate(texts)]
    return rows + [(100 + i, f"see {example} here", f"src{i}", "en") for i in range(4)]


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(?:p(?i:assword|asswd)|(?i:password|passwd|secret|token|api_key|apikey))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_and_ownership(spark):
    rows = secret_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in secret_scan.report(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = plain_spans(t or "")
        listed = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("opaque")] == listed
    assert got[12]["n_opaque"] == 1 and all(got[100 + i]["n_opaque"] == 0 for i in range(4))
    assert secret_scan.report(df.limit(0)).count() == 0


def test_ownership_against_plain_counts(spark, docs, corpus, monkeypatch):
    """Counts of every value over a corpus in which values are shared by some sources and languages."""
    rng = random.Random(6)
    values = ["Va1" + "".join(rng.choices("abcdefghijABCDEFGHIJ0123456789", k=30)) for _ in range(12)]
    rows = [(i, " x ".join(rng.choices(values[: 1 + i % 12], k=rng.randrange(3))), rng.choice(["s0", "s1", "s2", "s3", None]), rng.choice(["en", "de", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    seen = {v: (set(), set()) for v in values}
    for _, t, source, lang in rows:
        for v in t.split(" x "):
            if v:
                seen[v][0].add(source or "")
                seen[v][1].add("/".join(x for x in (source, lang) if x))
    wide = {v for v, (owners, places) in seen.items() if len(owners) >= 3 or len(places) >= 5}
    assert 0 < len(wide) < len([v for v in values if seen[v][0]])
    want = [(i, sum(v not in wide for v in t.split(" x ") if v)) for i, t, *_ in rows]
    masked = {i: " x ".join("<opaque>" if v and v not in wide else v for v in t.split(" x ")) for i, t, *_ in rows}
    for together in (common.TOGETHER_ROWS, 3):
        monkeypatch.setattr(common, "TOGETHER_ROWS", together)
        assert sorted((r["doc_id"], r["n_opaque"]) for r in secret_scan.report(df).collect()) == want
        assert {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()} == masked
    counts = {(s["start"], r["doc_id"]): (s["owners"], s["repositories"]) for r in secret_scan.scan(df).collect() for s in r["spans"]}
    for (start, i), found in counts.items():
        value = rows[i][1][start:].split(" x ")[0]
        assert found == tuple(map(len, seen[value]))


def test_secrets_as_sql(spark):
    rows = secret_docs() + [(200, "token=ab token=abcdef", None, None), (201, "x" * 40 + " Aa1" + "b" * 40 + " deadbeefdeadbeefdeadbeef01 api_key : 'qwertyuiop'", "src9", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert_same(secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")), secret_scan.sql(), con)
    assert_same(secret_scan.report(spark.read.parquet(f"{SMALL}/documents.parquet")), secret_scan.sql(), duck())


def test_edge_rows_of_secret_scans(docs, corpus):
    assert secret_scan.report(docs).count() == len(corpus)
    kept = secret_scan.redact(docs)
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert kept.count() == len(corpus)


def test_redaction(spark):
    df = spark.createDataFrame([(*r, 5) for r in secret_docs()], "doc_id long, text string, source string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    assert got[0]["text"] == 'say <assign>" now' and got[0]["n_chars"] == len(got[0]["text"])
    assert got[12]["text"] == "<opaque>" and got[9]["text"] == "é😀 <assign> end" and got[13]["text"] is None
    assert got[100]["text"].startswith("see Ex0") and got[100]["n_chars"] == 5


def toxic_set(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        said = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 9))]
        toxic = i % 8 == 0
        if toxic:
            rng.choice(said).extend(rng.sample(["zidiot", "zscum", "zgrumen"], 2))
        rows.append((i, ". ".join(map(" ".join, said)) + ".", int(toxic)))
    return rows


def test_toxicity_held_out_accuracy_and_places(spark):
    rows = toxic_set(1600, 3)
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    scored = toxicity.score(df, toxicity.train(df, labels)).collect()
    held = [r for r in scored if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in scored) and len(held) > 300
    truth = {i: (t, y) for i, t, y in rows}
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) / len(held) > 0.97
    for r in held:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        for a, b in (map(int, s.split(":")) for s in r["offending"].split(",") if s):
            assert "z" in truth[r["doc_id"]][0][a:b]


def test_toxicity_edges(spark, docs, corpus):
    model = toxicity.Model(-3.0, {"word": 4.0})
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(corpus) and {r["score"] for r in rows if r["doc_id"] is not None and not corpus[r["doc_id"]][1]} == {0.0}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("limit", [7, 10**6])
def test_training_sample_is_bounded(spark, limit, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(len(texts)) or toxicity.Model(0.0, {}))
    df = spark.createDataFrame(toxic_set(60, 1), "doc_id long, text string, toxic int")
    toxicity.train(df, df, sample_rows=limit)
    assert seen[0] <= limit and seen[0] > 0
