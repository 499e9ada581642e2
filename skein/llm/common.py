"""What the operators share: session folders, sizing, and a vectorised word reader.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; because
those bytes never occur inside a multi-byte UTF-8 character this is the same as
the character class ``[^\\x20\\x09-\\x0D]+``. Texts are read straight from the
Arrow buffers: no Python string is made for them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import cut, shared_dir  # noqa: F401

SEGMENT = 1 << 20  # bytes hashed at a time
U = np.uint64


# ---------------------------------------------------------------- session
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimiser's statistics, or by one pass where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 50:
        return n
    row = df.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()
    return int(row[0] or 0)


def parts(df: DataFrame, each_mb: float, least: int = 64) -> int:
    """How many groups of about ``each_mb`` of input there are, ``least`` at least."""
    return max(least, math.ceil(input_bytes(df) / (each_mb * 1e6)))


def text_column(df: DataFrame) -> DataFrame:
    """Only what the operators read: the id and the text, null text as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


# ---------------------------------------------------------------- hashing
def _splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


BYTE = _splitmix(11, 256)
BYTE[[9, 10, 11, 12, 13, 32]] = 0
LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
SLOT = _splitmix(12, 64) | U(1)
_STEP = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64, made once per process."""
    if not _POWERS:
        with np.errstate(over="ignore"):
            for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                p = np.full(SEGMENT + 1, step, dtype=U)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of an Arrow string array: byte bounds, 64-bit hashes, rows' bounds.

    ``ptr[i]:ptr[i + 1]`` are row i's words. With ``lower`` A-Z become a-z first.
    With ``letters`` every ASCII character but letters and digits parts words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = True, hashes: bool = True, letters: bool = False):
        self.data, self.offsets = buffers(texts)
        data = self.data
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
        self.lowered = data
        word = LETTER[data] if letters else ~((data == 32) | ((data >= 9) & (data <= 13)))
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.ptr = np.searchsorted(self.start, self.offsets)
        if hashes:
            self.hash = _hash(data, self.start, self.end)

    def rows(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of an Arrow string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, body = texts.buffers()
    n = len(texts)
    if bounds is None or n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(bounds, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free polynomial hashes over random byte values, scrambled; bounded work space."""
    out = np.zeros(len(start), dtype=U)
    up, down = _powers()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            a = start[i]
            j = int(np.searchsorted(end, a + SEGMENT, side="right"))
            if j <= i:  # a single word longer than a segment
                h = U(0)
                for k in range(int(a), int(end[i]), SEGMENT):
                    piece = BYTE[data[k : min(k + SEGMENT, end[i])]]
                    h = mix(np.array([h + U(1)], dtype=U))[0] + (piece * up[: len(piece)]).sum(dtype=U)
                out[i] = h
                i += 1
                continue
            b = end[j - 1]
            total = np.zeros(b - a + 1, dtype=U)
            np.cumsum(BYTE[data[a:b]] * up[: b - a], out=total[1:])
            out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a]
            i = j
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive entries of ``h``."""
    if len(h) < n:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - n + 1, dtype=U)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * SLOT[k]
    return mix(total + SLOT[32 + n])


def shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text is one shingle; no words, none."""
    if not len(h):
        return np.zeros(0, dtype=U)
    if len(h) < n:
        return grams(h, len(h))
    return np.unique(grams(h, n))


# ---------------------------------------------------------------- batches
def slices(batches: Iterator[pa.RecordBatch], mb: float = 2.0, by: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut at rows into slices of about ``mb`` of text, so that work space stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(by))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + mb * 1e6)) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def crc_mod(ids: np.ndarray, m: int) -> np.ndarray:
    """crc32 of each id written in decimal, modulo ``m``."""
    return np.fromiter((zlib.crc32(str(i).encode()) % m for i in ids), dtype=np.int64, count=len(ids))


def crc_mod_column(name: str, m: int):
    """The same as a Spark column."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(m))
