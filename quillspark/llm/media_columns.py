"""Media columns: payloads stored as WAV, read back, and described by spectral-peak pairs.

Bytes become the 8-bit samples of a mono WAV; short-time Fourier transforms over frames of 192
samples give each frame's strongest local peaks, and each peak paired with peaks of the next frames
gives (time, code) arrays. Every payload is transformed for itself, in blocks of frames, so equal
payloads have equal features and memory is bounded. Edge cases: a null or empty text is 192 spaces; a
flat payload has no peak and empty arrays; repeated rows each have a row; a null doc_id is carried along;
columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_slices

UNIT = 192
HOP = 96
RATE = 8000
#: Peaks a frame, and how many frames ahead they are paired.
PEAKS, AHEAD = 2, 3
BLOCK_FRAMES = 4096
WINDOW = np.hanning(UNIT)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of up to PEAKS strongest local maxima of each frame, by frame then strength."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        block = frames[at : at + BLOCK_FRAMES]
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * WINDOW, axis=1)
        # Whole levels in steps of an eighth of an octave make ties definite.
        level = np.floor(8 * np.log2(1 + np.abs(spectrum))).astype(np.int64)
        inner = level[:, 1:-1]
        local = (inner > level[:, :-2]) & (inner >= level[:, 2:]) & (inner > 8)
        width = inner.shape[1]
        order = np.where(local, inner * width + np.arange(width)[::-1], -1)
        for _ in range(PEAKS):
            best = order.argmax(axis=1)
            rows = np.arange(len(order))
            found = order[rows, best] >= 0
            times.append(rows[found] + at)
            bins.append(best[found] + 1)
            order[rows, best] = -1
    t, f = np.concatenate(times), np.concatenate(bins)
    by = np.argsort(t, kind="stable")
    return t[by], f[by]


def pair_codes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of peak pairs at most AHEAD frames apart; code: both bins and the distance."""
    times, codes = [t[:0]], [f[:0]]
    for step in range(1, PEAKS * (AHEAD + 1)):
        gap = t[step:] - t[:-step]
        ok = (gap > 0) & (gap <= AHEAD)
        times.append(t[:-step][ok])
        codes.append((f[:-step][ok] << 9) | (f[step:][ok] << 2) | gap[ok])
    t2, c = np.concatenate(times), np.concatenate(codes)
    by = np.lexsort((c, t2))
    return t2[by], c[by]


def store(docs: DataFrame, *, digests: bool = False) -> DataFrame:
    """Per row the WAV and its (time, code) arrays; with ``digests`` their sizes and digests instead."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if not digests:
        schema = "doc_id long, n_bytes long, media binary, times array<long>, codes array<long>"

    def row(data: bytes) -> tuple:
        media = to_wav(padded(data))
        payload = from_wav(media)
        t, f = peaks(payload)
        times, codes = pair_codes(t, f)
        if not digests:
            return len(data), media, times, codes
        print_sha = hashlib.sha256(times.astype("<i8").tobytes() + codes.astype("<i8").tobytes()).hexdigest()
        feature = f"{1 + (len(payload) - UNIT) // HOP}:{len(t)}:{len(times)}:{print_sha}"
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row(data) for data in as_bytes(part.column("text"))]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(x)) for x in zip(*rows))], names=names)

        return each

    return map_slices(docs.select("doc_id", "text"), work, schema)


def payloads(docs: DataFrame) -> DataFrame:
    """What is stored of each row, without its features: all of it can be said in SQL."""
    return store(docs, digests=True).drop("feature")


def sql() -> str:
    """The payloads of ``documents`` in DuckDB's SQL: the container's header is written out, the checksum folded bit by bit."""
    word = lambda n: f"unhex(substring(printf('%08X', {n}), 7, 2) || substring(printf('%08X', {n}), 5, 2) || substring(printf('%08X', {n}), 3, 2) || substring(printf('%08X', {n}), 1, 2))"
    form = (b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + RATE.to_bytes(4, "little") * 2 + b"\1\0\10\0data").hex()
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, n + pad AS m, encode(t || repeat(' ', pad)) AS b FROM (SELECT *, (CASE WHEN n = 0 THEN {UNIT} ELSE ({UNIT} - n % {UNIT}) % {UNIT} END)::BIGINT AS pad FROM d)),
q AS (SELECT *, unhex(substring(hex(b), (2 * m - 31)::BIGINT, 32)) AS tail, encode('RIFF') || {word("m + 36")} || unhex('{form}') || {word("m")} || b AS media FROM p),
c AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 16), lambda i: ('0x' || substring(hex(tail), (2 * i + 1)::BIGINT, 2))::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(0, 8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc FROM q)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(b) AS payload_sha256, xor(crc, 4294967295)::BIGINT AS tail_crc32, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256 FROM c"""
