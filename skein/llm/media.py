"""Media columns: PNG files in binary columns, read back chunk by chunk, with cosine-transform hashes.

A payload (UTF-8 text padded with zero bytes to a positive multiple of 64) is
stored as an 8-bit grey image 64 samples wide. The reader trusts nothing: the
signature, every chunk's checksum, the header's fields, the stream's length and
each row's filter are tested before samples are returned.

Defined cases: null text is an empty text (one row of 64 zero samples). A null
``doc_id`` stays null. Equal texts give equal files and features. Repeated rows
give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import slices, text_column

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 20  # most bytes of one IDAT chunk
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class BadPng(ValueError):
    """The bytes are not a PNG file that this reader accepts."""


# ---------------------------------------------------------------- writing
def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a two-dimensional array, rows filtered by difference to the row above."""
    h, w = samples.shape
    rows = np.empty((h, w + 1), dtype=np.uint8)
    rows[:, 0] = 2
    rows[0, 1:] = samples[0]
    np.subtract(samples[1:], samples[:-1], out=rows[1:, 1:])
    packed = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


# ---------------------------------------------------------------- reading
def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows of one byte a sample; runs of one filter are done at once where that is possible."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BadPng(f"filter {kinds.max()}")
    bounds = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *bounds], [*bounds, len(kinds)]):
        kind = kinds[a]
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind > 2:
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                out[y] = (_average if kind == 3 else _paeth)(out[y].tolist(), above)
    return out


def _average(row: list[int], above: list[int]) -> list[int]:
    left = 0
    for x, up in enumerate(above):
        row[x] = left = (row[x] + (left + up) // 2) & 255
    return row


def _paeth(row: list[int], above: list[int]) -> list[int]:
    left = corner = 0
    for x, up in enumerate(above):
        guess = left + up - corner
        near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
        row[x] = left = (row[x] + near) & 255
        corner = up
    return row


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlace; raises BadPng for anything else."""
    if data[:8] != SIGNATURE:
        raise BadPng("signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadPng("chunk cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            raise BadPng("chunk cut short")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise BadPng(f"checksum of {kind!r}")
        at += 12 + n
        if (head is None) != (kind == b"IHDR"):
            raise BadPng("header out of place")
        if kind == b"IHDR":
            if n != 13:
                raise BadPng("header")
            head = struct.unpack(">IIBBBBB", body)
            if head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
                raise BadPng("kind of image")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadPng(f"critical chunk {kind!r}")
    if not ended or at != len(data):
        raise BadPng("end")
    w, h = head[:2]
    try:
        unpack = zlib.decompressobj()
        raw = unpack.decompress(b"".join(packed), h * (w + 1) + 1)
    except zlib.error as e:
        raise BadPng("stream") from e
    if len(raw) != h * (w + 1) or not unpack.eof:
        raise BadPng("length of the stream")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(h, w + 1))


# ---------------------------------------------------------------- feature
@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """The eight lowest frequencies of a cosine transform of 32 samples."""
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))


def _means(samples: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the mean of an equal share of the rows (rows repeat where there are fewer)."""
    h = len(samples)
    if h <= n:
        return samples[np.arange(n) * h // n].astype(np.float64)
    at = np.arange(n + 1) * h // n
    return np.add.reduceat(samples, at[:-1], axis=0, dtype=np.float64) / np.diff(at)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine coefficients of the 32 x 32 reduction exceed their median."""
    small = _means(np.ascontiguousarray(_means(samples, 32).T), 32).T
    low = np.round(_basis() @ small @ _basis().T, 6).ravel()
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


# ---------------------------------------------------------------- operator
def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def store(docs: DataFrame, level: int = 1) -> DataFrame:
    """``doc_id``, ``n_bytes`` and the PNG file of each whole text in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            texts = [x.as_buffer().to_pybytes() for x in batch.column("text")]
            files = [write_png(np.frombuffer(payload(t), dtype=np.uint8).reshape(-1, WIDTH), level) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "png"])

    return text_column(docs).mapInArrow(run, "doc_id long, n_bytes long, png binary")


def features(images: DataFrame) -> DataFrame:
    """What is read back from the files of ``store``: digests of the samples, of the file, and the cosine hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("png"):
                file = file.as_buffer()
                samples = read_png(file.to_pybytes())
                body = samples.tobytes()
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return images.mapInArrow(run, FEATURES)
