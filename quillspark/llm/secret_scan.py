"""Secret scans with corpus-wide ownership of what is found.

Base kinds: ``assign`` (a named value), ``access`` (AKIA keys) and ``hex`` (long hexadecimal runs). The
method adds ``opaque``: long mixed-case tokens with digits, whose hash is seen in few repositories and
owners across the corpus; widely copied ones are examples and add nothing. Every candidate is hashed,
hashes are counted by distinct repositories and owners, and the counts come back by a join that spreads hot hashes.

Edge cases: a null or empty text has no spans; a null owner or repository counts as one owner or
repository of its own; repeated rows each keep a row, and add no owner; a null doc_id is carried along;
other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, map_slices, spread_join

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Matches are maximal runs, so asking for the least length here is the same as dropping shorter matches.
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
OPAQUE = re.compile("[A-Za-z0-9_+/-]{28,}")
KINDS = ("assign", "access", "hex", "opaque")
#: A value in at least so many owners, or so many repositories, is a widely copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 5
FOUND = "array<struct<start:int,kind:int,end:int,hash:long>>"


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all candidates, by start and kind; in code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for m in OPAQUE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
            found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def _candidates(docs: DataFrame, repository: Column, owner: Column, text_key: Column) -> DataFrame:
    """A row per input row: row key, doc_id, owner, repository, key of the text and what was found."""
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), text_key.alias("text_key"),
    )
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))

    kept = ("row", "doc_id", "owner", "repository", "text_key")

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"start": s, "kind": k, "end": e, "hash": xxhash.xxh64_intdigest(v) - (1 << 63)} for s, k, e, v in find(t or "")] for t in part.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, kind)], names=[*kept, "found"])

        return each

    return map_slices(narrow, work, f"row long, doc_id long, owner string, repository string, text_key string, found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate; partial sums first, so a hot hash is small before it moves."""
    each = found.select(F.explode("found.hash").alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("pairs"))
    by_repository = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return by_owner.join(by_repository, "hash").select("hash", "owners", "repositories")


def scan(docs: DataFrame, *, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(row, doc_id, spans) of each input row; spans: (start, kind name, end, owners, repositories, wide), by start, then kind."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = cut(_candidates(docs, repository, owner, F.lit("")))
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).withColumn("hash", F.col("x.hash"))
    joined = spread_join(each, ownership(found), "hash", "row")
    wide = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.kind") + 1)
    span = F.struct(F.col("x.start").alias("start"), F.col("x.kind").alias("rank"), kind.alias("kind"), F.col("x.end").alias("end"), "owners", "repositories", wide.alias("wide"))
    spans = joined.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    chosen = F.filter(F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)), lambda s: (s["rank"] < 3) | ~s["wide"])
    return found.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", chosen.alias("spans"))


def masked(text: str, examples: set[int]) -> str:
    """The text with spans replaced, overlapping ones as one under the kind of the first."""
    out, at, until = [], 0, 0
    for start, kind, end, value in find(text):
        if kind == 3 and xxhash.xxh64_intdigest(value) - (1 << 63) in examples:
            continue
        if start >= until:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = until = max(until, end)
    return "".join(out) + text[at:] if out else text


def _replaced(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` after masking, without the helping column."""
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            columns = [part.column(i) for i in range(len(names))]
            old = columns[text_at].to_pylist()
            new = [t and masked(t, set(x)) for t, x in zip(old, part.column(len(names)).to_pylist())]
            columns[text_at] = pa.array(new, pa.string())
            if chars_at >= 0:
                before = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, before)], columns[chars_at].type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return map_slices(docs, work, docs.select(*names).schema)


def redact(docs: DataFrame, *, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``docs`` with each base span and each owner-specific token replaced by ``<kind>``; n_chars follows.

    Only rows with a long token are joined with the counts; their key is the digest of the text, as equal
    texts have equal spans.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    names = docs.columns
    has_token = F.coalesce(F.col("text").rlike(OPAQUE.pattern), F.lit(False))
    tokens, key = docs.where(has_token), F.sha2(F.col("text").cast("binary"), 256)
    found = cut(_candidates(tokens, repository, owner, key).select("owner", "repository", F.col("text_key").alias("_key"), F.filter("found", lambda x: x["kind"] == 3).alias("found")))
    wide = ownership(found).where((F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)).select("hash")
    keyed = cut(found.select("_key", F.explode("found.hash").alias("hash")).distinct())
    examples = spread_join(keyed, wide, "hash", "_key").groupBy("_key").agg(F.collect_set("hash").alias("_examples"))
    none = F.array().cast("array<bigint>").alias("_examples")
    joined = spread_join(tokens.withColumn("_key", key), examples, "_key", "doc_id", how="left", hot=hot_keys(found, "_key"))
    return _replaced(joined.select(*names, F.coalesce("_examples", none).alias("_examples")).unionByName(docs.where(~has_token).select(*names, none)), names)


def report(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans, of each input row."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < 3)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(3).alias("n_opaque"),
        F.size(F.filter("spans", lambda s: ~s["wide"])).cast("long").alias("n_owner_specific"),
        F.size(F.filter("spans", lambda s: s["wide"])).cast("long").alias("n_widely_copied"),
    )


def sql() -> str:
    """The same report on ``documents`` in DuckDB's SQL, for texts without the characters U+E000 and U+E001."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    assign = f"""({names})["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, ACCESS.pattern, HEX.pattern, OPAQUE.pattern)
    begin, end = "chr(57344)", "chr(57345)"
    marked = ", ".join(f"({k}, string_split(regexp_replace(t, '{p}', {begin} || '\\0' || {end}, 'g'), {begin}))" for k, p in enumerate(patterns))
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
split AS (SELECT r, k, ps FROM d, LATERAL (VALUES {marked}) v(k, ps) WHERE len(ps) > 1),
piece AS (SELECT r, k, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM split),
placed AS (SELECT r, k, i, split_part(p, {end}, 1) AS m, sum(length(p) - (i > 1)::INTEGER) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM piece),
found AS (SELECT r, k, {kinds}[k + 1] AS kind, start, start + length(m) AS stop, CASE WHEN k = 0 THEN regexp_extract(m, '{assign}', 2) ELSE m END AS value FROM placed WHERE i > 1),
good AS (SELECT * FROM found WHERE (k > 0 OR length(value) >= 6) AND (k < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
owned AS (SELECT value, count(DISTINCT owner) >= {WIDE_OWNERS} OR count(DISTINCT repository) >= {WIDE_REPOSITORIES} AS wide FROM good JOIN d USING (r) GROUP BY value),
chosen AS (SELECT * FROM good JOIN owned USING (value) WHERE k < 3 OR NOT wide),
said AS (SELECT r, {", ".join(f"count(*) FILTER (k = {k}) AS n{k}" for k in range(4))}, {listed} FILTER (k < 3), '') AS base, {listed}, '') AS spans,
  count(*) FILTER (NOT wide) AS own, count(*) FILTER (wide) AS copied FROM chosen GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n{k}, 0) AS n_{KINDS[k]}" for k in range(4))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(own, 0) AS n_owner_specific, coalesce(copied, 0) AS n_widely_copied FROM d LEFT JOIN said USING (r)"""
