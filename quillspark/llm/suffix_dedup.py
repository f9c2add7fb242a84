"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in an earlier document go.

Sorting every suffix of the corpus would move every text many times over, so suffix arrays are built only
where strings can repeat at all:

1. Each 50-byte string has an anchor, the leftmost smallest hash among its 31 substrings of 20 bytes
   (winnowing; Schleimer, Wilkerson and Aiken, 2003), so equal strings have equal anchors. Anchor hashes go to
   hash buckets with their document's number, and those found in two documents come back to their documents.
2. The stretch of text around such an anchor (its strings and no others) goes to a shard by the anchor's
   hash; those of hot anchors are cut in two and go by eight more bytes, which all strings of a part hold. Copies of a stretch collapse before they move: within a task's block of text only the earliest
   document's stretch is sent, the others are covered by it whole.
3. A shard builds suffix arrays of its distinct stretches, in parts of bounded size, by Larsson-Sadakane
   refinement in numpy; common prefixes in Kasai's sense, capped at 50 and taken for all neighbours at once
   by words, split each array into classes of equal strings; the classes of several arrays are
   merged by binary search. A string is removed from all but the earliest document of its class.

Texts move only in the joins with their own anchors and spans; equal strings of a hot class meet as one row
per block of text, never as one row per document. What a block sends is the same bytes however many buckets
and shards there are; a task takes whole buckets and shards, one after the other.

Edge cases: a null or empty text has no bytes and the digest of the empty string; texts under 50 bytes lose
nothing; a row without doc_id neither loses nor removes anything; repeated rows (one doc_id) don't remove
from each other; one doc_id with several texts is one document, of which each row loses its own bytes;
columns other than doc_id and text are ignored; texts of any length are treated whole, anchors window by window.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, groups, mix, ship, slices

SPAN, GRAM = 50, 20
GRAMS = SPAN - GRAM + 1


class Limits(NamedTuple):
    """How much is held at once; results don't depend on any of it."""

    #: Text that a task takes together before it sends what it found, in bytes and rows.
    block_bytes: int = 8 << 20
    block_rows: int = 60_000
    slice_bytes: int = 1 << 20
    #: Distinct stretches, in bytes, and uses of them that a task takes together.
    stretch_bytes: int = 24 << 20
    stretch_uses: int = 1_000_000
    #: String starts whose anchors are found together.
    window: int = 1 << 20
    #: Text whose anchors a bucket holds, about.
    bucket_text: int = 24 << 20
    #: Stretches of a shard that are unpacked together, and those in one suffix array, in bytes.
    range_bytes: int = 4 << 20
    array_bytes: int = 1 << 20
    #: Tasks that buckets and shards are spread over at most; beyond, a task takes several one by one.
    tasks: int = 20_000
    #: Documents of an anchor from which it is hot (24 MB of stretches), or a millionth of the text's bytes, so that hot
    #: anchors are a million at most.
    hot: int = 300_000


LIMITS = Limits()

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = [int(x) | 1 for x in mix(np.arange(300, 306, dtype=np.uint64))]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each substring of 20 bytes, by doubling: 1, 2, 4, 8, 16 and 16 + 4 bytes."""
    h, four = _BYTE[data], None
    for i, span in enumerate((1, 2, 4, 8)):
        h = h[:-span] * np.uint64(_STEP[i]) + h[span:]
        if span == 2:
            four = h
    h = h[:-4] * np.uint64(_STEP[4]) + four[16:]
    return mix(h)


def anchors(data: np.ndarray, ends: np.ndarray, window: int = LIMITS.window) -> tuple[np.ndarray, ...]:
    """(hash, document, first string, last string, place) of each anchor of the texts that end at ``ends``."""
    found = [_anchors(data[a : a + window + SPAN - 1], a, ends) for a in range(0, max(1, len(data) - SPAN + 1), window)]
    h, at, owner, first, last = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:  # an anchor may go on in the next window
        head = np.flatnonzero(_changed(at) | _changed(owner))
        h, owner, first, last = h[head], owner[head], first[head], last[np.append(head[1:], len(last)) - 1] if len(head) else last
        at = at[head]
    return h, owner, first, last, at


def _anchors(data: np.ndarray, begin: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, document, first string, last string) of the anchors of strings that start in a window."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none, none, none
    h = gram_hashes(data)
    value, place = h, np.arange(len(h), dtype=np.int32)
    for shift in (1, 2, 4, 8, 15):
        later = value[shift:] < value[:-shift]
        value, place = np.where(later, value[shift:], value[:-shift]), np.where(later, place[shift:], place[:-shift])
    low, high = np.searchsorted(ends, (begin, begin + len(place) - 1), side="right")
    edges = np.clip(np.concatenate(([0], ends[low:high], [begin + len(place)])) - begin, 0, len(place))
    doc = np.repeat(np.arange(low, high + 1, dtype=np.int32), np.diff(edges))
    starts = np.flatnonzero(np.arange(begin + SPAN, begin + SPAN + len(place)) <= ends[doc])
    if not starts.size:
        return none.astype(np.uint64), none, none, none, none
    at, owner = place[starts], doc[starts]
    first = np.flatnonzero(_changed(at) | _changed(owner))
    last = np.append(first[1:], len(starts)) - 1
    return h[at[first]], at[first].astype(np.int64) + begin, owner[first].astype(np.int64), starts[first] + begin, starts[last] + begin


def short(h: np.ndarray) -> np.ndarray:
    """The high 32 bits of each hash, in its order; the bucket says some of the others. A bucket holds a few million, so one in
    a thousand or fewer meets another by chance, at any size of the corpus, and that costs only a comparison."""
    return (h >> np.uint64(32)).astype(np.int64)


def pack(h: np.ndarray) -> bytes:
    return h.astype("<u4").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers with their low 16 bits first: high ones are mostly zeros and compress to nothing."""
    return numbers.astype("<i8").view("<u2").reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "<u2").reshape(4, -1).T).reshape(-1).view("<i8")


class Block:
    """Documents of one task, up to a block's bytes of text, and what was found in them."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.ids: list[int] = []
        self.keys: list[int] = []
        self.parts: list = []
        self.bytes = 0

    def full(self, more: pa.RecordBatch, size: int) -> bool:
        return bool(self.ids) and (self.bytes + size > self.limits.block_bytes or len(self.ids) + more.num_rows > self.limits.block_rows)

    def add(self, more: pa.RecordBatch, size: int) -> None:
        self.ids += more.column("doc_id").to_pylist()
        self.keys += more.column("key").to_pylist()
        self.bytes += size


def as_batches(rows: list[tuple], kinds: list[pa.DataType], names: list[str], size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), kinds)], names=names)


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has some of the hashes, and where they are."""
    bucket = h % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    starts = _grouped(bucket[order]) if len(h) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(h))):
        yield int(bucket[order[a]]), order[a:b]


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    texts = part.column("text").cast(pa.binary()).to_pylist()
    joined = np.frombuffer(b"".join(texts), np.uint8)
    return joined, np.cumsum([len(t) for t in texts]), texts


def _changed(keys: np.ndarray) -> np.ndarray:
    """Where a value isn't that before it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array."""
    return np.flatnonzero(_changed(keys))


def send_anchors(buckets: int, limits: Limits = LIMITS):
    """(bucket, base, hashes, ids, counts): a block's anchor hashes for each bucket and the ids of their documents, or for
    the last ones how many of the block's documents have them; negative buckets hold the latter for each document (base).
    """

    def flush(block: Block) -> Iterator[pa.RecordBatch]:
        h, d = (np.concatenate([p[i] for p in block.parts]) for i in (0, 1))
        if not len(h):
            return
        ids = np.array(block.ids, np.int64)
        base, own = int(ids.min()), ids[d]
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        once = _changed(h) | _changed(own)
        h, own = h[once], own[once]
        run = _grouped(h)
        size = np.diff(np.append(run, len(h)))
        several = np.repeat(size > 1, size)
        rows = [(-1 - i % buckets, i, pack(short(x)), b"", b"") for i, x in per_document(own[several], h[several])]
        h, own, several = h[run], own[run], size > 1
        for b, at in by_bucket(h, buckets):
            at = np.concatenate((at[~several[at]], at[several[at]]))
            known = np.count_nonzero(~several[at])
            rows.append((b, base, planes(np.diff(short(h[at]), prepend=0)), planes(own[at[:known]] - np.int64(base)), planes(size[at[known:]])))
        yield from as_batches(rows, [pa.int32(), pa.int64(), *[pa.binary()] * 3], ["bucket", "base", "hashes", "ids", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(limits)
        for batch in batches:
            for part in slices(batch, "text", limits.slice_bytes):
                data, ends, _ = _texts(part)
                h, d, *_ = anchors(data, ends, limits.window)
                if block.full(part, len(data)):
                    yield from flush(block)
                    block = Block(limits)
                block.parts.append((h, d + len(block.ids)))
                block.add(part, len(data))
        if block.ids:
            yield from flush(block)

    return run


def per_document(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each document with its values, of arrays that go together."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    starts = _grouped(doc) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(doc))):
        yield int(doc[a]), values[a:b]


def meet(hot: int):
    """(doc_id, found): of each bucket's anchor hashes those in several documents, by document; without doc_id, those in over ``hot`` documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent in groups(batches, "bucket"):
            rows: list[tuple[int, bytes]] = []
            hashes, ids, counts = [], [], []
            for b, base, h, i, c in (row for part in sent for row in zip(*(c.to_pylist() for c in part.columns))):
                if b < 0:
                    rows.append((base, h))
                    continue
                hashes.append(np.cumsum(unplaned(h)))
                bucket = b
                known, more = unplaned(i) + np.int64(base), unplaned(c)
                ids.append(np.append(known, np.zeros(len(more), np.int64)))
                counts.append(np.append(np.ones(len(known), np.int64), more))
            if hashes:
                h, ids, counts = (np.concatenate(x) for x in (hashes, ids, counts))
                order = np.argsort(h, kind="stable")
                h, ids, counts = h[order], ids[order], counts[order]
                run, several = _grouped(h), counts > 1
                mixed = np.logical_or.reduceat(several, run) | (np.minimum.reduceat(ids, run) != np.maximum.reduceat(ids, run))
                size = np.diff(np.append(run, len(h)))
                ok = np.repeat(mixed, size) & ~several
                if (many := h[run[np.add.reduceat(counts, run) > hot]]).size:
                    rows.append((None, (many | (bucket << 32)).tobytes()))
                rows += [(i, pack(x)) for i, x in per_document(ids[ok], h[ok])]
            yield from as_batches(rows, [pa.int64(), pa.binary()], ["doc_id", "found"])

    return run


def split_hot(data: np.ndarray, h: np.ndarray, d: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Stretches (key, document, first string, last string, hash to look up) with those of hot anchors cut in two.

    Strings that begin eight bytes or more before the anchor hold those eight, the others hold the eight behind it:
    either goes into the key, so equal strings still have equal keys.
    """
    cut_h = short(h)
    is_hot = np.isin(cut_h | ((h % np.uint64(buckets)).astype(np.int64) << 32), hot) if len(hot) else np.zeros(len(h), bool)
    if not is_hot.any():
        return h, d, first, last, cut_h
    parts = [(h[~is_hot], d[~is_hot], first[~is_hot], last[~is_hot], cut_h[~is_hot])]
    eight = lambda at: data[at[:, None] + np.arange(8)].view("<u8").ravel()
    for sign, begin, shift in ((1, 0, -8), (2, -7, GRAM)):
        a = first[is_hot] if sign == 1 else np.maximum(first[is_hot], place[is_hot] + begin)
        z = np.minimum(last[is_hot], place[is_hot] - 8) if sign == 1 else last[is_hot]
        ok = np.flatnonzero(a <= z)
        key = mix(h[is_hot][ok] ^ mix(eight(place[is_hot][ok] + shift) + np.uint64(sign)))
        parts.append((key, d[is_hot][ok], a[ok], z[ok], cut_h[is_hot][ok]))
    whole = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(whole[1], kind="stable")
    return tuple(x[order] for x in whole)


class Stretches(Block):
    """Distinct stretches of up to a block's bytes, and where each is: (number, document, start) for every use. A long text may be in several."""

    def __init__(self, limits: Limits):
        super().__init__(limits)
        self.number: dict[bytes, int] = {}
        self.hashes, self.uses = array("Q"), array("q")

    def filled(self) -> bool:
        return self.bytes > self.limits.stretch_bytes or len(self.uses) > 3 * self.limits.stretch_uses

    def enter(self, doc_id: int, key: int) -> int:
        self.ids.append(doc_id)
        self.keys.append(key)
        return len(self.ids) - 1

    def put(self, h: int, doc: int, start: int, stretch: bytes) -> None:
        n = self.number.setdefault(stretch, len(self.number))
        if n == len(self.hashes):
            self.hashes.append(h)
            self.bytes += len(stretch)
        self.uses.extend((n, doc, start))


def send_stretches(buckets: int, limits: Limits = LIMITS, hot: np.ndarray = np.zeros(0, np.int64)):
    """Of documents with found anchors, the stretches that must be compared, by shard, and spans already known (negative shards)."""
    names = ["shard", "hashes", "sizes", "stretches", "uses", "ids", "keys"]

    def flush(block: Stretches) -> Iterator[pa.RecordBatch]:
        if not block.number:
            return
        ids, keys = np.array(block.ids, np.int64), np.array(block.keys, np.int64)
        hashes, uses, texts = np.array(block.hashes, np.uint64), np.array(block.uses, np.int64).reshape(-1, 3), list(block.number)
        size = np.array([len(t) for t in texts])
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, uses[:, 0], ids[uses[:, 1]])
        own = ids[uses[:, 1]] == least[uses[:, 0]]
        known, uses = uses[~own], uses[own]
        rows = []
        for d, spans in per_document(known[:, 1], np.column_stack((known[:, 2], known[:, 2] + size[known[:, 0]]))):
            rows.append((-1 - int(ids[d] % buckets), b"", b"", b"", spans.astype("<u4").tobytes(), planes(ids[d : d + 1]), keys[d].tobytes()))
        place = np.empty(len(texts), np.int64)
        for _, at in (shards := list(by_bucket(hashes, buckets))):
            at[:] = at[np.argsort(hashes[at], kind="stable")]
            place[at] = np.arange(len(at))
        used_by = dict(by_bucket(hashes[uses[:, 0]], buckets))
        for shard, at in shards:
            used = uses[used_by[shard]]
            used[:, 0] = place[used[:, 0]]
            used = used[np.argsort(used[:, 0], kind="stable")]
            docs, used[:, 1] = np.unique(used[:, 1], return_inverse=True)
            squeezed = zstandard.compress(b"".join(texts[i] for i in at.tolist()), 6)
            used[:, 0] = np.diff(used[:, 0], prepend=0)  # how far each use's stretch is from that of the use before: 0 or 1
            gaps = np.diff(short(hashes[at]), prepend=0)
            rows.append((shard, planes(gaps), size[at].astype(np.uint8).tobytes(), squeezed, planes(used.T.ravel()), planes(np.diff(ids[docs], prepend=0)), keys[docs].tobytes()))
        yield from as_batches(rows, [pa.int32(), *[pa.binary()] * 6], names, 32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Stretches(limits)
        for batch in batches:
            for part in slices(batch, "text", limits.slice_bytes):
                data, ends, texts = _texts(part)
                h, d, first, last, place = anchors(data, ends, limits.window)
                h, d, first, last, cut_h = split_hot(data, h, d, first, last, place, hot, buckets)
                raw, begins = data.tobytes(), ends - np.array([len(t) for t in texts])
                ids, keys = (part.column(c).to_pylist() for c in ("doc_id", "key"))
                edge = np.searchsorted(d, np.arange(len(texts) + 1))
                for i, found in enumerate(part.column("found").to_pylist()):
                    hit = np.flatnonzero(np.isin(cut_h[edge[i] : edge[i + 1]], unpack(b"".join(found)))) + edge[i]
                    doc, begin = -1, int(begins[i])
                    for x, a, b in zip(*(c[hit].tolist() for c in (h, first, last))):
                        if block.filled():
                            yield from flush(block)
                            block, doc = Stretches(limits), -1
                        doc = block.enter(ids[i], keys[i]) if doc < 0 else doc
                        block.put(x, doc, a - begin, raw[a : b + SPAN])
        yield from flush(block)

    return run


def suffix_array(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    Groups of equal prefixes carry the number of their first place; each round sorts only the members of groups
    that aren't single, by the group of the suffix one prefix length on, which doubles that length.
    """
    n = len(text)
    key = words(text)
    order = np.argsort(key, kind="stable")
    run = _grouped(key[order])
    size = np.diff(np.append(run, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(run, size)
    rank[n] = -1
    length = 8
    while length < depth:
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not open_.size:
            break
        members = order[open_]
        pair = (rank[members] << 32) + rank[np.minimum(members + length, n)] + 1
        by = np.argsort(pair, kind="stable")
        members, pair = members[by], pair[by]
        order[open_] = members
        start = np.zeros(n, bool)
        start[run] = True
        start[open_[_grouped(pair)]] = True
        run = np.flatnonzero(start)
        size = np.diff(np.append(run, n))
        rank[order] = np.repeat(run, size)
        length *= 2
    return order


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros after the end."""
    key = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for shift, span in ((8, 1), (16, 2), (32, 4)):
        key = (key[:-span] << np.uint64(shift)) | key[span:]
    return key[: len(text)]


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = SPAN) -> np.ndarray:
    """Common prefix of each position of ``order`` with the one before it, counted to ``cap`` at most.

    Kasai's array, found eight bytes a step for all neighbours that still agree.
    """
    found = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return found
    key = np.append(words(text), np.zeros(cap + 8, np.uint64))
    a, b, at = order[:-1], order[1:], np.arange(1, len(order))
    for done in range(0, cap, 8):
        differ = key[a + done] ^ key[b + done]
        same = differ == 0
        stop = ~same
        if stop.any():
            x = differ[stop]
            lead = np.zeros(len(x), np.int64)
            for shift in (32, 16, 8):
                high = (x >> np.uint64(64 - shift)) == 0
                lead += np.where(high, shift // 8, 0)
                x = np.where(high, x << np.uint64(shift), x)
            found[at[stop]] = np.minimum(done + lead, cap)
        a, b, at = a[same], b[same], at[same]
    found[at] = cap
    return found


def classes(stretches: list[bytes], least: np.ndarray, strings: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of the strings that start in each stretch, stretch after stretch: their class; and per class its smallest
    document and, sorted, its string (if ``strings``)."""
    size = np.array([len(x) for x in stretches])
    # One is added to each byte, as UTF-8 has no 255, so that zero can divide stretches.
    text = (np.frombuffer(b"".join(x + b"\xff" for x in stretches), np.uint8) + np.uint8(1)).astype(np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    count = size - SPAN + 1
    stretch = np.repeat(np.arange(len(size)), count)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[stretch]
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = suffix_array(text)
    order = order[number[order] >= 0]
    new = common_prefixes(text, order) < SPAN
    new[0] = True
    of = np.empty(len(starts), np.int64)
    of[number[order]] = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(least[stretch[number[order]]], np.flatnonzero(new))
    if not strings:
        return of, smallest, None
    view = np.lib.stride_tricks.sliding_window_view(text, SPAN)
    return of, smallest, np.ascontiguousarray(view[order[new]]).view(f"S{SPAN}").ravel()


def resolve(limits: Limits = LIMITS):
    """(doc_id, key, spans): of each shard's stretches those bytes whose strings start in a smaller document.

    A shard is taken in ranges of the anchor hash, so that only a few megabytes of stretches are unpacked at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups(batches, "shard"):
            rows: list[tuple[int, int, bytes]] = []
            sent, ids, keys, n, total = [], [], [], 0, 0
            for part in shard:
                # Views of the shard's own buffers: nothing is copied until a range is unpacked.
                for number, hs, sizes, squeezed, used, i, k in zip(part.column(0).to_pylist(), *([x.as_buffer() for x in c] for c in part.columns[1:])):
                    i, k = np.cumsum(unplaned(i)), np.frombuffer(k, np.int64)
                    if number < 0:
                        rows.append((int(i[0]), int(k[0]), used.to_pybytes()))
                        continue
                    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64)
                    used = unplaned(used).reshape(3, -1).astype("<u4").T
                    used[:, 0] = np.cumsum(used[:, 0])
                    sent.append((np.cumsum(unplaned(hs)), ends, squeezed, used, n))
                    ids.append(i)
                    keys.append(k)
                    n += len(i)
                    total += int(ends[-1])
            if sent:
                ids, keys = np.concatenate(ids), np.concatenate(keys)
                steps = -(-total // limits.range_bytes)
                edges = [(r << 32) // steps for r in range(steps + 1)]
                found = [x for lo, hi in zip(edges, edges[1:]) for x in _resolve_range(sent, ids, lo, hi - 1, limits.array_bytes)]
                if found:
                    x = np.concatenate(found)
                    rows += [(int(ids[d]), int(keys[d]), spans.astype("<u4").tobytes()) for d, spans in per_document(x[:, 0], x[:, 1:])]
            yield from as_batches(rows, [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "key", "spans"])

    return run


def _resolve_range(sent: list[tuple], ids: np.ndarray, low: int, high: int, array_bytes: int) -> Iterator[np.ndarray]:
    """(document, start, end) spans from the stretches whose anchor hash is in the range."""
    number: dict[tuple[int, bytes], int] = {}
    uses = []
    for hs, ends, squeezed, used, base in sent:
        a, b = np.searchsorted(hs, low), np.searchsorted(hs, high, side="right")
        if a == b:
            continue
        joined = zstandard.decompress(squeezed)
        at = ends[a - 1] if a else 0
        own = []
        for h, end in zip(hs[a:b].tolist(), ends[a:b].tolist()):
            own.append(number.setdefault((h, joined[at:end]), len(number)))
            at = end
        u = used[np.searchsorted(used[:, 0], a) : np.searchsorted(used[:, 0], b)].astype(np.int64)
        uses.append(np.column_stack((np.array(own)[u[:, 0] - a], u[:, 1] + base, u[:, 2])))
    if not uses:
        return
    used, items = np.concatenate(uses), list(number)
    least = np.full(len(items), np.iinfo(np.int64).max)
    np.minimum.at(least, used[:, 0], ids[used[:, 1]])
    by_hash = sorted(range(len(items)), key=items.__getitem__)
    size = np.array([len(x) for _, x in items])
    first_of = np.concatenate(([0], np.cumsum(size - SPAN + 1)))
    smallest = np.repeat(least, size - SPAN + 1)  # for a stretch that is alone with its anchor
    for parts in arrays(by_hash, items, array_bytes):
        found = [classes([items[i][1] for i in part], least[part], len(parts) > 1) for part in parts]
        for part, of, lowest in zip(parts, (f[0] for f in found), merged(found)):
            count = size[part] - SPAN + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_of[part], count)
            smallest[at] = lowest[of]
    yield from spans_of(used, ids, first_of, smallest)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest document of each class of each array, over all arrays: strings are looked up by binary search."""
    low = [f[1].copy() for f in found]
    for p in range(len(found)):
        for q in range(p + 1, len(found)):
            at = np.minimum(np.searchsorted(found[p][2], found[q][2]), len(found[p][2]) - 1)
            same = np.flatnonzero(found[p][2][at] == found[q][2])
            np.minimum.at(low[p], at[same], found[q][1][same])
            low[q][same] = np.minimum(low[q][same], found[p][1][at[same]])
    return low


def arrays(by_hash: list[int], items: list[tuple[int, bytes]], array_bytes: int) -> Iterator[list[list[int]]]:
    """Stretches that share an anchor with others, in arrays of bounded size: an anchor's in one, or if they
    are too many in several that are merged."""
    part: list[int] = []
    filled = 0
    at = 0
    while at < len(by_hash):
        end = at
        while end < len(by_hash) and items[by_hash[end]][0] == items[by_hash[at]][0]:
            end += 1
        group, at = by_hash[at:end], end
        if len(group) < 2:
            continue
        total = sum(len(items[i][1]) for i in group)
        if total > array_bytes:
            step = max(1, array_bytes // (2 * SPAN))
            yield [group[i : i + step] for i in range(0, len(group), step)]
            continue
        if part and filled + total > array_bytes:
            yield [part]
            part, filled = [], 0
        part += group
        filled += total
    if part:
        yield [part]


def spans_of(used: np.ndarray, ids: np.ndarray, first_of: np.ndarray, smallest: np.ndarray) -> Iterator[np.ndarray]:
    """(document, start, end) of the strings that a smaller document has, uses taken block by block."""
    for lo in range(0, len(used), 20_000):
        s, d, a = used[lo : lo + 20_000].T
        count = first_of[s + 1] - first_of[s]
        use = np.repeat(np.arange(len(s)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        go = np.flatnonzero(smallest[first_of[s[use]] + offset] < ids[d[use]])
        if not go.size:
            continue
        use, offset = use[go], offset[go]
        new = np.ones(len(go), bool)
        new[1:] = (use[1:] != use[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(go)) - 1
        yield np.column_stack((d[use[head]], a[use[head]] + offset[head], a[use[head]] + offset[tail] + SPAN))


def removed(spans: np.ndarray) -> np.ndarray:
    """The maximal removed runs, (start, end), from spans in any order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack((spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]))


def finish(digests: bool, limits: Limits = LIMITS):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
    kinds = [*[pa.int64()] * 3, pa.string() if digests else pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limits.slice_bytes):
                out = []
                for text, key, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("key").to_pylist(), part.column("spans").to_pylist()):
                    text, own = text or b"", [x["spans"] for x in spans or () if x["key"] == key]
                    runs = removed(np.frombuffer(b"".join(own), "<u4").reshape(-1, 2).astype(np.int64)) if own else np.zeros((0, 2), np.int64)
                    kept = b"".join(text[a:b] for a, b in zip([0, *runs[:, 1]], [*runs[:, 0], len(text)]))
                    out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digests else kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["doc_id", *names])

    return run


def by_task(df: DataFrame, number: str, count: int, most: int) -> DataFrame:
    """``df`` with all rows of a ``number`` together, and as few of the ``count`` numbers in a task as can be."""
    tasks = min(count, most)
    return df.repartitionById(tasks, F.pmod(number, F.lit(tasks))).sortWithinPartitions(number)


def deduplicate(docs: DataFrame, *, digests: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and the remaining bytes, or their digest, of each row."""
    ship(docs.sparkSession)
    # A plain column where it can be: an alias would keep the two joins from sharing their exchange.
    number = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    keyed = docs.select(number, F.xxhash64("text").alias("key"), "text")
    texts = keyed.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))
    total, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(4, -(-total // limits.bucket_text))
    anchors_of = texts.mapInArrow(send_anchors(buckets, limits), "bucket int, base long, hashes binary, ids binary, counts binary")
    many = max(limits.hot, total // 1_000_000)
    met = by_task(anchors_of, "bucket", buckets, limits.tasks).mapInArrow(meet(many), "doc_id long, found binary")
    hot = np.zeros(0, np.int64)
    if rows > many:  # else no anchor can be hot
        met = cut(met)
        listed = [np.frombuffer(r["found"], np.int64) for r in met.where("doc_id is null").select("found").toLocalIterator()]
        hot = np.concatenate([hot, *listed])
    found = met.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    stretches = texts.join(found, "doc_id").mapInArrow(send_stretches(buckets, limits, hot), "shard int, hashes binary, sizes binary, stretches binary, uses binary, ids binary, keys binary")
    resolved = by_task(stretches, "shard", buckets, limits.tasks).mapInArrow(resolve(limits), "doc_id long, key long, spans binary")
    spans = resolved.groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("spans"))
    kept = "kept_sha256 string" if digests else "kept binary"
    # The same exchange of texts serves this join and the one above; texts that can't lose anything don't move.
    long = texts.join(spans, "doc_id", "left").select("doc_id", "key", "text", "spans")
    none = F.lit(None).cast("array<struct<key:bigint,spans:binary>>").alias("spans")
    rest = keyed.where(F.col("doc_id").isNull() | (F.coalesce(F.octet_length("text"), F.lit(0)) < SPAN)).select("doc_id", "key", "text", none)
    return long.unionByName(rest).mapInArrow(finish(digests, limits), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}")


def sql() -> str:
    """The digests of what remains of ``documents`` in DuckDB's SQL, window by window; for small tables."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, p, b[p + 1:p + {SPAN}] AS s FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - {SPAN - 1})) AS p FROM d WHERE doc_id IS NOT NULL AND octet_length(b) >= {SPAN})),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + {SPAN}, -1) AS new FROM w JOIN f USING (s) WHERE doc_id > least),
n AS (SELECT r, p, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY p) AS run FROM g),
x AS (SELECT r, min(p) AS a, max(p) + {SPAN} AS z FROM n GROUP BY r, run),
k AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM x GROUP BY r),
t AS (SELECT r, doc_id, hex(b) AS h, octet_length(b)::BIGINT AS n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_append(coalesce(starts, []), octet_length(b)) AS starts, list_prepend(0, coalesce(ends, [])) AS ends FROM d LEFT JOIN k USING (r))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: substring(h, (2 * ends[i] + 1)::BIGINT, (2 * (starts[i] - ends[i]))::BIGINT)), ''))) AS kept_sha256 FROM t"""
