"""Media columns: texts as lossless PNG payloads, checked and hashed on the way back.

Writing: a text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are the 8-bit grey samples of a PNG that
is 576 samples wide.  Rows carry the filter (none, sub or up) with the least sum of absolute differences, and the
zlib stream is split into IDAT chunks of at most 32 KiB.  Reading: signature, chunk lengths and every chunk's CRC are
tested, IDAT is inflated, all five filter types are undone in numpy, and a perceptual hash comes from the low
frequencies of a cosine transform.

Defined results: a null or empty text is one row of 576 bytes of 255.  Equal texts give equal bytes, whatever the row
order (fixed compression level).  A stored blob that is null gives null columns; a damaged one raises ValueError in
`decode` and gives `error` in `read_media`.  Any text length is one image; only a row at a time is held decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 32_768
LEVEL = 1


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = UNIT) -> bytes:
    """A grey 8-bit PNG whose samples are payload (its length a positive multiple of width)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = np.zeros((3, *rows.shape), np.uint8)
    tried[0] = rows
    tried[1, :, 0], tried[1, :, 1:] = rows[:, 0], rows[:, 1:] - rows[:, :-1]
    tried[2, 0], tried[2, 1:] = rows[0], rows[1:] - rows[:-1]
    best = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    idat = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + idat + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """Samples (height, width) of a grey 8-bit PNG without interlace; ValueError if any test fails."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG: signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("chunk is cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != int.from_bytes(png[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"chunk {kind!r}: checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit PNG without interlace")
    width, height = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from None
    if len(lines) != height * (width + 1):
        raise ValueError("image data: size")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes filter types 0-4 (one byte a sample), row by row; samples of a row together where the filter allows."""
    out = np.empty_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        line = lines[y]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            left = corner = 0
            row = []
            for v, b in zip(line.tolist(), above.tolist(), strict=True):
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if da <= db and da <= dc else b if db <= dc else corner
                left, corner = (v + guess) & 255, b
                row.append(left)
            out[y] = row
        else:
            raise ValueError(f"filter type {kind}")
        above = out[y]
    return out


@cache
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """64-bit hash, 16 hex digits: the 8 x 8 lowest frequencies, without those that are constant along a row, against their median, of a 32 x 32 reduction."""
    h, w = samples.shape
    sums = np.add.reduceat(np.add.reduceat(samples, np.arange(32) * w // 32, 1, dtype=np.int64), np.minimum(np.arange(32) * h // 32, h - 1), 0)
    wide, high = np.diff(np.arange(33) * w // 32), np.maximum(1, np.diff(np.arange(33) * h // 32))
    small = sums / (wide * high[:, None])
    low = (_cosines(32, 8) @ small @ _cosines(32, 9)[1:].T).ravel().round(6)
    return f"{int(''.join('01'[int(x)] for x in low > np.median(low)), 2):016x}"


ENCODED = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media (the stored PNG) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, len(b), 256)):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(payload_of(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, ENCODED)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_media(media: DataFrame) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media): everything comes from the bytes read back, padding included."""

    def one(i: int, n: int, png: bytes | None) -> tuple:
        if png is None:
            return (i, n, None, None, None, None, None, None, None)
        try:
            samples = decode(png)
        except ValueError as e:
            return (i, n, None, None, None, len(png), hashlib.sha256(png).hexdigest(), None, str(e))
        p = samples.tobytes()
        return (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples), None)

    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.string() if "string" in x else pa.int64() for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, len(b), 256)):
                rows = [one(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
