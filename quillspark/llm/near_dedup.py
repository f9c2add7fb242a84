"""MinHash near-duplicates: bands find candidates, odd sketches screen them, full sets confirm them.

Texts are lower-cased (A-Z), cut into words at ASCII white space, and turned into sets of 64-bit hashes of
five-word shingles. Documents with equal sets form a class; everything after that handles classes only.
A class's MinHash samples by many permutations give band keys. Its samples by one permutation, the least hashes of
the set (all of up to 16,384, else those below a power of two that leaves as many at most), are folded into an odd
sketch (Mitzenmacher, Pagh and Pham, 2014): a parity bitmap, so that the population count of two sketches' XOR estimates
how many samples differ, precisely enough to tell 0.80 from 0.85 apart. The screen is set for each pair
from both sizes and counts of samples: a link at exactly the least percentage passes at 4.75 deviations.

Links between classes are found in two steps:

1. star: in each bucket every class is compared with the bucket's smallest document;
2. rest: buckets whose classes aren't all in one component by then are compared across components, in blocks
   and among classes of similar size. That takes time with the square of a bucket whose documents are similar but not
   linked, a few word operations a pair; only pairs that the sketches let through leave the comparison.

Both confirm on the full sets, and components come from label rounds with pointer jumping. Joins on what may be hot
(a bucket, its smallest document, a class, a component) are spread by salts where a key has many rows.

Edge cases: a null or empty text, or one without words, has no shingle and is linked with nothing; a text
of fewer than five words is one shingle; a row without doc_id is linked with nothing, has a null component
and is kept; repeated rows share a component (and are all kept or all dropped); one doc_id with several texts is
one document, linked if any of them is; columns other than doc_id and text are ignored by ``components`` and kept by
``deduplicated``; texts are read whole.

The least percentage is a parameter, 50 at least, and bands and samples a band go with it: they must leave links at that
percentage next to no chance of being missed. The defaults are those of op3_minhash_near_dedup.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, groups, hot_keys, map_slices, mix, shingle_hashes, ship, spread_join

WORDS = 5
BANDS, ROWS = 24, 6
#: A link: 100 * intersection >= LEAST_PERCENT * union.
LEAST_PERCENT = 85
#: Samples of a sketch at most, and bits of sketches: a power of two, four for each sample.
SAMPLES = 16_384
LEAST_BITS, MOST_BITS = 256, 16_384
DEVIATIONS = 4.75
#: Classes of a bucket that one task compares with as many others, and pairs that it compares at once.
BLOCK = 4096
PAIRS = 16_384
PAIR_BATCH_TEXTS = 64


@cache
def permutations(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, shifts, seeds) of so many samples."""
    rng = np.random.default_rng(0x0DD5)
    factors = rng.integers(1 << 31, 1 << 32, samples, np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 1 << 32, samples, np.uint32), mix(np.arange(1, samples + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; each distinct word of them all is hashed once."""
    words = [t.lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[coded.indices.to_numpy()]
    return [np.unique(shingle_hashes(x, WORDS)) for x in np.split(hashes, ends[:-1])] if texts else []


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of band keys for each non-empty set."""
    samples = bands * rows
    factors, shifts, seeds = permutations(samples)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    low = np.empty((samples, len(sets)), np.uint32)
    for i in range(samples):
        low[i] = np.minimum.reduceat(flat * factors[i] + shifts[i], starts)
    tagged = mix(low.astype(np.uint64) + seeds[:, None])
    keys = np.zeros((bands, len(sets)), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + tagged[r::rows])
    return keys.T


def parities(samples: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(samples) - 1).bit_length() if len(samples) else 0))
    odd = np.bincount((mix(samples) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_sketch(shingles: np.ndarray) -> tuple[int, int, bytes, int, bytes]:
    """Level, and twice number and parity bitmap of the samples of a sorted set: hashes below 2 ** (64 - level), and
    those of the next level if a set of up to twice the size may be there (else nothing)."""
    n = len(shingles)
    level = max(0, (-(-n // SAMPLES) - 1).bit_length())
    at = [n, *(int(np.searchsorted(shingles, np.uint64(1 << (64 - x)))) for x in (level or 1, level + 1))]
    own = shingles[: at[1] if level else n]
    above = shingles[: at[2]] if 2 * n > SAMPLES << level else None
    return level, len(own), parities(own), *((0, b"") if above is None else (len(above), parities(above)))


#: What a class carries to be compared.
SKETCH = ("n_shingles", "level", "samples", "sketch", "samples_up", "sketch_up")


def most_bits(percent: float, sizes, samples, bits) -> np.ndarray:
    """Differing bits up to which two sketches of so many bits may come from sets of that similarity.

    Equal samples are hypergeometric given the samples of either set; parities then collide like balls in bins.
    """
    j = percent / 100
    equal = [j * (sizes[0] + sizes[1]) / (1 + j) / np.maximum(n, 1) for n in sizes]  # share of either set
    equal = [np.minimum(x, 1) for x in equal]
    var = np.maximum(*(m * x * (1 - x) * (n - m) / np.maximum(n - 1, 1) for n, m, x in zip(sizes, samples, equal)))
    differ = np.maximum(samples[0] + samples[1] - (samples[0] * equal[0] + samples[1] * equal[1]), 0)
    once, twice = np.exp(-2 * differ / bits), np.exp(-4 * differ / bits)
    spread = bits / 4 * (1 - twice) - differ * twice + twice * 4 * var
    likely = bits / 2 * (1 - once) + DEVIATIONS * np.sqrt(np.maximum(spread, 0)) + 1
    # Parities only cancel, so never more bits differ than samples do.
    return np.minimum(likely, differ + 2 * DEVIATIONS * np.sqrt(np.maximum(var, 0)) + 1e-6)


class Sketches:
    """Sketches of several levels and lengths; a longer one is folded where it meets a shorter one."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, ends: tuple[str, ...] = ("",)):
        of = lambda name: [rows.column(name + end) for end in ends]
        numbers = lambda name: np.concatenate([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in of(name)])
        self.sizes, self.level = numbers("n_shingles").astype(np.float64), numbers("level")
        self.samples = np.concatenate((numbers("samples"), numbers("samples_up"))).astype(np.float64)
        self.raw = [x for name in ("sketch", "sketch_up") for c in of(name) for x in c.to_pylist()]
        self.bits = np.fromiter((8 * len(x) for x in self.raw), np.int64, len(self.raw))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of all sketches of at least so many bits, and each one's row among them."""
        if bits not in self.at:
            place, parts, n = np.full(len(self.raw), -1), [], 0
            for length in np.unique(self.bits[self.bits >= bits]).tolist():
                rows = np.flatnonzero(self.bits == length)
                words = np.frombuffer(b"".join([self.raw[i] for i in rows.tolist()]), "<u8").reshape(len(rows), -1)
                while words.shape[1] * 64 > bits:
                    half = words.shape[1] // 2
                    words = words[:, :half] ^ words[:, half:]
                place[rows] = n + np.arange(len(rows))
                n += len(rows)
                parts.append(words)
            self.at[bits] = np.concatenate(parts), place
        return self.at[bits]

    def close(self, a: np.ndarray, b: np.ndarray, percent: float) -> np.ndarray:
        """Whether the pairs of rows, each at most twice as large as the other, may be links."""
        level = np.maximum(self.level[a], self.level[b])
        sizes = self.sizes[a], self.sizes[b]
        a, b = (x + np.where(self.level[x] < level, len(self.level), 0) for x in (a, b))
        bits = np.minimum(self.bits[a], self.bits[b])
        differ = np.zeros(len(a), np.int64)
        for length in np.unique(bits).tolist():
            own = np.flatnonzero(bits == length)
            words, place = self.folded(length)
            differ[own] = np.bitwise_count(words[place[a[own]]] ^ words[place[b[own]]]).sum(axis=1, dtype=np.int64)
        return differ <= most_bits(percent, sizes, (self.samples[a], self.samples[b]), bits)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, sketch) of each row; all but the first two null for empty sets."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    names = ["n_shingles", "digest", "bands", *SKETCH[1:]]

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(as_bytes(part.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            columns: list[list] = [[len(s) for s in sets], *([None] * len(sets) for _ in names[1:])]
            if full:
                for i, k in zip(full, band_keys([sets[i] for i in full], bands, rows).astype(np.int64).tolist()):
                    for column, x in zip(columns[1:], (xxhash.xxh3_128_digest(sets[i].tobytes()), k, *odd_sketch(sets[i]))):
                        column[i] = x
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", *names])

        return each

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_shingles long, digest binary, bands array<long>, level int, samples int, sketch binary, samples_up int, sketch_up binary")


def confirm(docs: DataFrame, pairs: DataFrame, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """The (a, b) of ``pairs``, staged, whose full shingle sets are similar enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    hot = hot_keys(pairs, "a")
    joined = spread_join(spread_join(pairs, side("b"), "b", "a"), side("a"), "a", "b", hot=hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_BATCH_TEXTS):
                part = batch.slice(at, PAIR_BATCH_TEXTS)
                good = []
                left, right = as_bytes(part.column("text_a")), as_bytes(part.column("text_b"))
                own = list(dict.fromkeys(left))  # rows of one document come together
                sets = shingle_sets(own + right)
                of = dict(zip(own, sets))
                for a, second in zip(left, sets[len(own) :]):
                    first = of[a]
                    both = len(np.intersect1d(first, second, assume_unique=True))
                    good.append(100 * both >= least_percent * (len(first) + len(second) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ship(docs.sparkSession)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the (a, b) edges: the smallest node that can be reached.

    Each round takes the least label of the neighbours and then the label of the label, so rounds grow with the
    logarithm of a component's diameter on all but contrived graphs.
    """
    both = cut(edges.select(F.col("a").alias("node"), "b").union(edges.select("b", "a")).distinct())
    hubs = hot_keys(both, "node")
    labels = cut(both.groupBy("node").agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = spread_join(both, labels, "node", "b", hot=hubs).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        stepped = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("better")))
        ahead = labels.select(F.col("node").alias("better"), F.col("label").alias("ahead"))
        new = cut(spread_join(stepped, ahead, "better", "node").select("node", F.least("better", "ahead").alias("now"), (F.least("better", "ahead") < F.col("label")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        labels = new.select("node", F.col("now").alias("label"))
        if not moved:
            return labels


def screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs``, staged, that the sketches let through."""
    side = lambda x: sketches.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in SKETCH))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                rows = np.arange(part.num_rows)
                ok = Sketches(part, ("_a", "_b")).close(rows, rows + part.num_rows, percent)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    ship(pairs.sparkSession)
    joined = spread_join(pairs.join(side("b"), "b"), side("a"), "a", "b", hot=hot_keys(pairs, "a"))
    return joined.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in SKETCH)).mapInArrow(run, "a long, b long")


def cells(rest: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of different parts that may be links, from buckets' rows (key, n, id, part, sketch).

    A bucket's classes are hashed to blocks, and every two blocks (or one with itself) are a cell of one task.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rest.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    celled = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "part", *SKETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, "key", "low", "high"):
            rows = pa.Table.from_batches(cell).sort_by("n_shingles")
            sizes, ids, parts, block = (rows.column(c).to_numpy() for c in ("n_shingles", "id", "part", "block"))
            known = Sketches(rows)
            reach = np.searchsorted(sizes * percent, 100 * sizes, side="right") - np.arange(len(sizes)) - 1
            ends = np.cumsum(reach)
            across = cell[0].column("low")[0] != cell[0].column("high")[0]
            for at in range(0, int(ends[-1]), PAIRS):
                number = np.arange(at, min(at + PAIRS, int(ends[-1])))
                a = np.searchsorted(ends, number, side="right")
                b = a + 1 + number - (ends[a] - reach[a])
                ok = parts[a] != parts[b]
                if across:
                    ok &= block[a] != block[b]
                a, b = a[ok], b[ok]
                if len(a) and (ok := known.close(a, b, percent)).any():
                    x, y = ids[a[ok]], ids[b[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    ship(rest.sparkSession)
    return celled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long").distinct()


def of_one_document(signed: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b): parts that are one because a doc_id has texts of both."""
    known = signed.where("digest is not null and doc_id is not null")
    several = cut(known.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("doc_id", "first"))
    pairs = cut(spread_join(known, several, "doc_id", "digest", hot=[] if several.isEmpty() else None).where("digest <> first").select("first", "digest").distinct())
    named = spread_join(pairs, part.withColumnRenamed("part", "b"), "digest", "first")
    return spread_join(cut(named), part.select(F.col("digest").alias("first"), F.col("part").alias("a")), "first", "digest").select("a", "b")


def components(docs: DataFrame, least_percent: int = LEAST_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    signed = cut(sign(docs, bands, rows))
    best = F.min(F.struct("doc_id", "bands", *SKETCH))
    named = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(best.alias("x"))
    classes = cut(named.select("digest", F.col("x.doc_id").alias("id"), *(f"x.{c}" for c in ("bands", *SKETCH))))
    sketches = classes.select("id", *SKETCH)

    buckets = classes.select("id", "n_shingles", F.explode("bands").alias("key"))
    heads = cut(buckets.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("head"), F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(heads, "key", F.max("n"))
    shared = cut(spread_join(buckets, heads, "key", "id", hot=hot))
    alike = f"100 * least(n_shingles, head.n_shingles) >= {least_percent} * greatest(n_shingles, head.n_shingles)"
    stars = cut(shared.where("id <> head.id").where(alike).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct())
    links = cut(confirm(docs, cut(screened(stars, sketches, least_percent)), least_percent))
    labels = connected(links)

    placed = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    rest = spread_join(placed, mixed, "key", "id", hot=hot).join(sketches, "id")
    pairs = cut(cells(rest, least_percent).join(stars, ["a", "b"], "left_anti"))
    more = cut(confirm(docs, pairs, least_percent))
    label_of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias("label_" + side))
    renamed = spread_join(spread_join(more, label_of("a"), "a", "b", how="left"), label_of("b"), "b", "a", how="left", hot=hot_keys(more, "b"))
    part = cut(classes.select("digest", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("label", "id").alias("part")))
    again = of_one_document(signed.select("doc_id", "digest"), part)
    merged = connected(renamed.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).union(again))
    whole = spread_join(part, merged.select(F.col("node").alias("part"), F.col("label").alias("whole")), "part", "digest", how="left")
    member = spread_join(signed.select("doc_id", "n_shingles", "digest"), whole.select("digest", F.coalesce("whole", "part").alias("own")), "digest", "doc_id", how="left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id"))
    return member.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, least_percent: int = LEAST_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without the rows that aren't kept."""
    dropped = components(docs, least_percent, bands, rows).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def sql(least_percent: int = LEAST_PERCENT) -> str:
    """The components of ``documents`` in DuckDB's SQL, by the shingles that documents share; for small tables."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(1, len(ws) - {WORDS - 1}) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT DISTINCT a, b FROM shared JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= {least_percent} * (p.n + q.n - k)),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM d WHERE doc_id IS NOT NULL UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.doc_id = d.doc_id"""
