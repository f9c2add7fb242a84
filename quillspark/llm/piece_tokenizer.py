"""SentencePiece (BPE, byte fallback) encoding and decoding in vectorised merge rounds.

Texts are cut into units at word starts. The distinct units of a slice of texts are encoded together:
flat numpy symbol arrays, the smallest merge rank of each unit found by a segmented minimum, all
leftmost non-overlapping pairs of that rank merged at once, the arrays compacted, until no pair
remains. Edge cases: a null or empty text has just the begin and end ids and decodes to the empty
text; a text of any length is one row; repeated rows and nulls elsewhere pass through; columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Lookup, code_points, map_slices, ragged

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Units with more symbols than this merge by a heap, as rounds would then cost rounds x symbols.
LONG_UNIT = 2048
#: Ids whose bytes are gathered at once.
DECODE_IDS = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, integer or bytes)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError("not a sentencepiece model")
        yield key >> 3, value


class PieceModel:
    """A sentencepiece BPE model with byte fallback and identity normalisation; other kinds are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        scores, kinds = [], []
        kind_of_model, self.bos, self.eos = 1, 1, 2
        prefix, tidy, escape, charsmap = 1, 1, 1, b""
        for number, value in message:
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(x.get(3, 1))
            elif number == 2:
                x = dict(_fields(value))
                kind_of_model, self.bos, self.eos = x.get(3, 1), x.get(41, 1), x.get(42, 2)
                if x.get(24, 0):
                    raise ValueError("spaces as suffixes aren't supported")
            elif number == 3:
                x = dict(_fields(value))
                charsmap, prefix, tidy, escape = x.get(2, b""), x.get(3, 1), x.get(4, 1), x.get(5, 1)
        if kind_of_model != 2 or charsmap or tidy or not escape or not prefix or any(k in (4, 5) for k in kinds):
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        self.byte_id = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == 6:
                self.byte_id[int(p[3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.encode() if k == 1 else b"" for p, k in zip(self.pieces, kinds)]
        self.is_byte = np.array([k == 6 for k in kinds])
        spaced = [r.replace(SPACE.encode(), b" ") for r in self.raw]
        self.raw_size = np.array([len(r) for r in spaced])
        self.raw_start, self.raw_flat = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(spaced), np.uint8)
        self._index({p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}, scores)

    def _index(self, ids: dict[str, int], scores: list[float]) -> None:
        """Symbols are piece ids, and len(pieces) + code point for a character that is no piece."""
        base = len(self.pieces)
        self.base, self.width = base, base + 0x110000
        self.char = np.arange(base, base + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        symbol = lambda s: ids.get(s, base + ord(s) if len(s) == 1 else -1)
        keys, ranks, to, inside, parts = [], [], [], set(), []
        for p, i in ids.items():
            for j in range(1, len(p)):
                inside.add((ord(p[j - 1]), ord(p[j])))
                a, b = symbol(p[:j]), symbol(p[j:])
                if a >= 0 and b >= 0:
                    keys.append(a * self.width + b)
                    ranks.append(order[scores[i]])
                    to.append(i)
                    parts += [(a, ranks[-1]), (b, ranks[-1])]
        by = np.argsort(np.array(keys, np.int64))
        keys, self.ranks, self.to = np.array(keys, np.int64)[by], np.array(ranks, np.int32)[by], np.array(to, np.int32)[by]
        self.pair = Lookup(keys)
        self.pairs = {int(k): (int(r), int(t)) for k, r, t in zip(keys, self.ranks, self.to)}
        # A piece is unsafe if a pair that holds it ranks no later than the piece: then only one pair merges a round.
        self.unsafe = np.zeros(self.width, bool)
        for a, r in parts:
            if a < base and r <= order[scores[a]] and len(self.pieces[a]) > 1:
                self.unsafe[a] = True
        # No merge crosses two characters that are neighbours in no piece; a unit starts at a space after another character.
        self.bigram = Lookup(np.array(sorted(a * 0x110000 + b for a, b in inside), np.int64))
        cut_at_space = not any(b == ord(SPACE) and a != b for a, b in inside)
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(ord(c) in pair for pair in inside))
        body = f"[^{SPACE}{alone}]"
        single = f"[{alone}]|" if alone else ""
        self.units = re.compile(f"{single}{SPACE}+{body}*|{body}+" if cut_at_space else "(?s).+")

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit, without begin and end."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        ids, ends = self.encode_flat(points, np.fromiter(map(len, units), np.int64, len(units)))
        return np.split(ids, ends[:-1]) if units else []

    def encode_flat(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of so many code points each, one after the other, and where each one's end."""
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        points = points.astype(np.int64)
        unit = np.repeat(np.arange(len(lengths)), lengths)
        first = np.ones(len(points), bool)
        first[1:] = (self.bigram(points[:-1] * 0x110000 + points[1:]) < 0) | (unit[1:] != unit[:-1])
        segment = np.cumsum(first) - 1
        symbols, segments = self._merge(self.char[points], segment)
        # Back in order, with bytes for what is no piece.
        unit_of = unit[first][segments]
        if (missing := np.flatnonzero(symbols >= self.base)).size:
            spelled = [self.byte_id[list(chr(c).encode())] for c in (symbols[missing] - self.base).tolist()]
            count = np.ones(len(symbols), np.int64)
            count[missing] = [len(s) for s in spelled]
            ids, unit_of = np.repeat(symbols, count), np.repeat(unit_of, count)
            starts = np.cumsum(count) - count
            for s, x in zip(starts[missing].tolist(), spelled):
                ids[s : s + len(x)] = x
            symbols = ids
        return symbols.astype(np.int32), np.cumsum(np.bincount(unit_of, minlength=len(lengths)))

    def _merge(self, symbols: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.bincount(segments)
        if (sizes > LONG_UNIT).any():
            long = sizes[segments] > LONG_UNIT
            for s in np.flatnonzero(sizes > LONG_UNIT).tolist():
                merged = self._merge_long(symbols[segments == s].tolist())
                done.append((np.array(merged, np.int32), np.full(len(merged), s)))
            symbols, segments = symbols[~long], segments[~long]
        while symbols.size:
            last = np.ones(len(symbols), bool)
            last[:-1] = segments[1:] != segments[:-1]
            begin = np.flatnonzero(np.concatenate(([True], last[:-1])))
            keys = symbols[:-1].astype(np.int64) * self.width + symbols[1:]
            at = self.pair(keys)
            rank = np.full(len(symbols), NONE, np.int32)
            hit = (at >= 0) & ~last[:-1]
            rank[:-1][hit] = self.ranks[at[hit]]
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(symbols)))
            live = best != NONE
            stay = np.repeat(live, count)
            if not live.all():
                done.append((symbols[~stay], segments[~stay]))
            if not live.any():
                break
            pick = (rank == np.repeat(best, count)) & stay
            where = np.flatnonzero(pick)
            run = np.ones(len(where), bool)
            run[1:] = where[1:] != where[:-1] + 1
            start = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - start) % 2 == 0]
            new = self.to[at[where]]
            if (risky := self.unsafe[new]).any():
                head = np.ones(len(where), bool)
                head[1:] = segments[where[1:]] != segments[where[:-1]]
                lone = np.zeros(int(segments[-1]) + 1, bool)
                lone[segments[where[risky]]] = True
                ok = head | ~lone[segments[where]]
                where, new = where[ok], new[ok]
            symbols = symbols.copy()
            symbols[where] = new
            stay[where + 1] = False
            symbols, segments = symbols[stay], segments[stay]
        if not done:
            return symbols, segments
        symbols, segments = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(segments, kind="stable")
        return symbols[order], segments[order]

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges one by one, best rank then leftmost first, in n log n steps."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) >= 0 and (p := self.pairs.get(symbols[i] * self.width + symbols[j])):
                heapq.heappush(heap, (p[0], i, symbols[i], symbols[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a * self.width + b][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            offer(left[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def split(self, text: str) -> list[str]:
        """Units of the text; no merge crosses from one to the next."""
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        return [self.bos, *(i for x in self.encode_units(self.split(text)) for i in x.tolist()), self.eos]

    def decode_flat(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids, and how many there are before each id and after the last."""
        parts = (ids[i : i + DECODE_IDS] for i in range(0, len(ids), DECODE_IDS))
        raw = b"".join([self.raw_flat[ragged(self.raw_start[x], self.raw_size[x])].tobytes() for x in parts])
        return raw, np.concatenate(([0], np.cumsum(self.raw_size[ids])))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; invalid bytes give the replacement character."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if raw.startswith(SPACE.encode()):
            raw = raw[3:]
        return raw.replace(SPACE.encode(), b" ").decode("utf-8", "replace")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model at ``path``, read once per process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, *, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) per row; with ``digests`` SHA-256 of ids and text instead."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def work():
        m = model(model_path)
        begin, end = (np.array([i], np.int32) for i in (m.bos, m.eos))

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            split = [m.split(t or "") for t in part.column("text").to_pylist()]
            edges = np.concatenate(([0], np.cumsum([len(units) for units in split], dtype=np.int64)))
            coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
            known, ends = m.encode_flat(*code_points(coded.dictionary))
            unit, size = coded.indices.to_numpy(), np.diff(ends, prepend=0)
            flat = known[ragged((ends - size)[unit], size[unit])]
            edges = np.concatenate(([0], np.cumsum(size[unit])))[edges]
            raw, places = m.decode_flat(flat)
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), places[edges[:-1]].tolist(), places[edges[1:]].tolist()))
            counts = pa.array(np.diff(edges) + 2)
            # The first byte of a text stands for the space that its first unit begins with.
            if digests:
                ids = pa.array([hashlib.sha256(begin.tobytes() + flat[a:b].tobytes() + end.tobytes()).hexdigest() for a, b, _, _ in spans])
                decoded = pa.array([hashlib.sha256(raw[c + 1 : d]).hexdigest() for _, _, c, d in spans])
            else:
                ids = pa.array([np.concatenate((begin, flat[a:b], end)) for a, b, _, _ in spans], pa.list_(pa.int32()))
                decoded = pa.array([raw[c + 1 : d].decode() for _, _, c, d in spans], pa.string())
            names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), counts, ids, decoded], names=names)

        return each

    return map_slices(docs.select("doc_id", "text"), work, schema)
