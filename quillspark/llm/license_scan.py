"""License scans: whole texts found by the digest of their canonical form.

Case, punctuation, copyright lines and equivalent spellings are normalised by built-in functions, the
result is digested, and digests are hash-joined with those of known licences. Lines that speak of a
licence are digested and joined alike; only rows that have one are staged and grouped for that. The known texts are the
notices and short licences below and the files of ``licenses`` (SPDX names), each also without its title and
without what follows its terms.

Edge cases: a null or empty text has the digest of the empty text and no licence; repeated rows each have a
row; a null doc_id is carried along; columns other than those named are ignored; a text is digested whole,
however long; with no known texts every row has a digest and no licence.
"""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Lower-case lines with a match say who owns the text, not how it may be used.
OWNER_LINE = r"^[^\p{L}\p{N}]*((portions )?copyright[^\p{L}]*(\(c\)|©|[0-9])|\(c\) *[0-9]|© *[0-9]|all rights reserved)"
QUOTES = r"[\x{2018}\x{2019}\x{201C}\x{201D}\x{00AB}\x{00BB}\x22\x27\x60]+"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, replaced in order once punctuation is gone.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("wilful", "willful"),
    ("https", "http"),
)
#: Whole texts of short licences and of the notices that stand for long ones.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
)
#: Tables of up to so many known texts are broadcast, 100 bytes a row; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
FOLDER = Path(__file__).parent / "licenses"
TERMS_END = "END OF TERMS AND CONDITIONS"


def variants(text: str) -> list[str]:
    """A licence's text as it is passed on: whole, without its title, and up to the end of its terms."""
    title, _, rest = text.strip().partition("\n\n")
    found = [text] + [rest] * (len(title) < 40 and title.endswith("License") and bool(rest))
    if TERMS_END in text:
        terms = text.partition(TERMS_END)[0]
        found += [terms, terms + TERMS_END]
    return found


@cache
def listed(folder: str | Path = FOLDER) -> tuple[tuple[str, str], ...]:
    """KNOWN and the whole texts of a folder's files, each named by its licence, such as MPL-2.0.txt."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix == ".txt" and p.is_file())
    named = [*KNOWN, *((p.stem, p.read_text("utf-8")) for p in files)]
    return tuple((name, x) for name, text in named for x in variants(text))


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~x.rlike(OWNER_LINE))
    plain = F.regexp_replace(F.replace(F.array_join(lines, "\n"), F.lit("&"), F.lit(" and ")), QUOTES, "")
    return F.trim(reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), SPELLINGS, F.regexp_replace(plain, PUNCTUATION, " ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark, texts) -> DataFrame:
    """(license_digest, license_id), one row per digest."""
    raw = spark.createDataFrame(list(texts), "license_id string, text string")
    return raw.groupBy(digest(F.col("text")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts=None) -> DataFrame:
    """Digest and licence of each whole text, and the licences of its lines, sorted and comma-joined."""
    texts = listed() if texts is None else texts
    table = known(docs.sparkSession, texts)

    def looked_up(rows: DataFrame, by: str, how: str) -> DataFrame:
        if len(texts) <= BROADCAST_ROWS:
            return rows.join(F.broadcast(table), "license_digest", how)
        return spread_join(cut(rows), table, "license_digest", by, how=how)

    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole, speaks = digest(F.col("text")).alias("license_digest"), F.col("text").rlike("(?i)licen[cs]")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(?i)licen[cs]"))
    said = cut(ids.where(speaks).select(F.monotonically_increasing_id().alias("row"), "doc_id", whole, F.array_distinct(F.transform(lines, digest)).alias("lines")))
    each = looked_up(said.select("row", F.explode("lines").alias("license_digest")), "row", "inner")
    named = each.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("named"))
    seen = said.join(named, "row", "left").select("doc_id", "license_digest", F.coalesce("named", F.lit("")).alias("line_licenses"))
    rows = seen.union(ids.where(~speaks).select("doc_id", whole, F.lit("").alias("line_licenses")))
    return looked_up(rows, "doc_id", "left").select("doc_id", "license_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"), "line_licenses")


def sql(texts=None) -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""
    texts = listed() if texts is None else texts
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def shape(x: str) -> str:
        x = f"array_to_string(list_filter(string_split(lower({x}), chr(10)), lambda y: NOT regexp_matches(y, {quote(OWNER_LINE)})), chr(10))"
        x = f"regexp_replace(regexp_replace(replace({x}, '&', ' and '), {quote(QUOTES)}, '', 'g'), {quote(PUNCTUATION)}, ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return f"trim({x}, ' ')"

    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in texts)
    return f"""
WITH k AS (SELECT sha256({shape("t")}) AS license_digest, min(i) AS license_id FROM (VALUES {rows}) v(i, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, doc_id, sha256({shape("t")}) AS license_digest FROM d),
l AS (SELECT r, sha256({shape("x")}) AS license_digest FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(lower(x), 'licen[cs]')),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM l JOIN k USING (license_digest) GROUP BY r)
SELECT doc_id, license_digest, license_id, license_id IS NOT NULL AS is_license, coalesce(line_licenses, '') AS line_licenses
FROM e LEFT JOIN k USING (license_digest) LEFT JOIN n USING (r)"""
