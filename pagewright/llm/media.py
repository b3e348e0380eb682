"""Media columns: payload bytes as PNG images in a binary column, and perceptual hashes.

A payload is padded with bytes 255 to whole tiles of 24 x 24 grey samples, laid
out as near to square as its size allows up to 192 samples across, and written
as a PNG: signature, then chunks of length, type, data and CRC-32.  The
reader tests the signature, every chunk's CRC-32, the header, the Adler-32 of
the zlib stream (in zlib itself) and the size, and undoes the row filters with
numpy.  The hash is the sign of each low-frequency cosine coefficient of the
image, brought to 32 x 32 by area means, against their median.

Nulls and odd inputs: a null or empty text is one row of bytes 255; payloads
have no largest size (rows are filtered in blocks); equal payloads give equal
files and hashes; an empty table gives no rows; a file that is cut or changed
raises ValueError, naming the test that failed.  Columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT, TILE = 576, 24
#: zlib level and bytes of one IDAT chunk.
LEVEL, IDAT_BYTES = 3, 1 << 16
SIDE, LOW = 32, 8
#: Rows that are filtered or averaged at a time.
BLOCK = 2048


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + b"\xff" * (-len(payload) % unit or (0 if payload else unit))


def width_of(size: int) -> int:
    """Samples across for a padded payload: 24, 48, 96 or 192, which all divide it."""
    return TILE * max(w for w in (1, 2, 4, 8) if w * w <= max(size // UNIT, 1))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filter(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: of none, sub and up the one with the least sum of absolute values."""
    up = np.vstack([above[None], rows[:-1]])
    sub = np.zeros_like(rows)
    sub[:, 1:] = rows[:, :-1]
    made = [rows, rows - sub, rows - up]
    cost = np.stack([np.abs(m.view(np.int8).astype(np.int16)).sum(axis=1) for m in made])
    best = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    for kind, data in enumerate(made):
        out[best == kind, 1:] = data[best == kind]
    return out


def write_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit image (height x width) as a PNG file."""
    height, width = samples.shape
    packer, above, packed = zlib.compressobj(LEVEL), np.zeros(width, np.uint8), []
    for i in range(0, height, BLOCK):
        rows = samples[i : i + BLOCK]
        packed.append(packer.compress(_filter(rows, above).tobytes()))
        above = rows[-1]
    data = b"".join([*packed, packer.flush()])
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of a grey 8-bit image; runs of one filter are undone together where they can be."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind, block = kinds[start] if end > start else 0, data[start:end]
        above = data[start - 1] if start else np.zeros(data.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind in (3, 4):
            for row in block:
                _unfilter_row(row, above, kind)
                above = row
    return data


def _unfilter_row(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Average (3) and Paeth (4) depend on the sample to the left, so they go sample by sample."""
    left = corner = 0
    for i, up in enumerate(above.tolist()):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (int(row[i]) + guess) & 255, up
        row[i] = left


def read_png(file: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG, with all its tests."""
    if file[:8] != SIGNATURE:
        raise ValueError("signature")
    at, head, data, ended = 8, None, [], False
    while at < len(file):
        if at + 12 > len(file):
            raise ValueError("cut chunk")
        (size,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        body = file[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(file):
            raise ValueError("cut chunk")
        if struct.unpack_from(">I", file, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if not ended or head is None:
        raise ValueError("no header or no end")
    width, height, *rest = head
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("only grey 8-bit images without interlace")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _area(n: int, side: int) -> np.ndarray:
    """side x n weights that take n samples to side means over equal stretches."""
    edges = np.arange(side + 1) * (n / side)
    at = np.arange(n)
    over = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return over / over.sum(axis=1, keepdims=True)


def _cosines(n: int, low: int) -> np.ndarray:
    k = np.arange(low + 1)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


_DCT = _cosines(SIDE, LOW - 1)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest frequencies are above their median."""
    height, width = samples.shape
    across = _area(width, SIDE)
    small = np.concatenate([samples[i : i + BLOCK] @ across.T for i in range(0, height, BLOCK)])  # height x SIDE
    if height > 4 * SIDE:  # sums of whole rows first, in bounded memory; then the exact stretches
        edges = np.arange(SIDE + 1) * (height / SIDE)
        total = np.vstack([np.zeros(SIDE), np.cumsum(small, axis=0)])
        whole = np.floor(edges).astype(int)
        part = (edges - whole)[:, None] * np.vstack([small, np.zeros(SIDE)])[np.minimum(whole, height)]
        sums = total[whole] + part
        small = np.diff(sums, axis=0) * (SIDE / height)
    else:
        small = _area(height, SIDE) @ small
    low = np.round((_DCT @ small @ _DCT.T).ravel(), 6)
    bits = np.packbits(low > np.median(low))
    return bits.tobytes().hex()


def encode_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text in UTF-8, padded, as a PNG file in a binary column."""

    def make():
        def one(payload: bytes) -> bytes:
            whole = padded(payload)
            return write_png(np.frombuffer(whole, np.uint8).reshape(-1, width_of(len(whole))))

        def work(batch):
            data = [t.as_py() or b"" for t in batch.column(1)]
            return {doc_id: batch.column(0), "n_bytes": [len(d) for d in data], "media": [one(d) for d in data]}

        return work

    return by_batch(docs.select(doc_id, F.col(text).cast("binary").alias("text")), make, f"`{doc_id}` {_kind(docs, doc_id)}, n_bytes long, media binary")


def media_features(media: DataFrame, *, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored files."""

    def make():
        def one(file: bytes):
            samples = read_png(file)
            payload = samples.tobytes()
            return (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]),
                len(file),
                hashlib.sha256(file).hexdigest(),
                cosine_hash(samples),
            )

        def work(batch):
            rows = [one(f.as_py()) for f in batch.column(2)]
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return {doc_id: batch.column(0), "n_bytes": batch.column(1)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    schema = f"`{doc_id}` {_kind(media, doc_id)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return by_batch(media.select(doc_id, "n_bytes", column), make, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()
