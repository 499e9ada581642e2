"""Questions and answers: exact totals of hashed keys over all documents, back to where they occur.

Documents are dealt to *blocks* by a hash of their id. Each block asks, for its
distinct keys, what the whole corpus says about them; the questions go to
*buckets* (ranges of the key space), which add them up and answer each block in
the order it asked. So a frequent key costs one entry per block, not one per
occurrence, and neither side ever holds more than one block or one bucket.

Key lists are sorted, taken as differences, laid out byte plane by byte plane and
compressed; the shuffles move these binaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import U, input_bytes, parts

ASKED = "bucket long, blk long, keys binary, marks binary"


def squeeze(x: np.ndarray) -> bytes:
    """A compressed array of unsigned integers."""
    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T.tobytes())


def expand(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def squeeze_keys(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=U(0)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, U), dtype=U)


def key_bits(df: DataFrame) -> int:
    """Bits enough to tell nearly all keys of ``df`` apart: 14 more than its bytes need.

    For questions whose answer may err on the side of "seen elsewhere", such as
    which keys are worth a second look or come first in an order.
    """
    return min(64, max(1, input_bytes(df)).bit_length() + 14)


def narrow(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys with all but their first ``bits`` bits set to 0."""
    return keys & U(((1 << bits) - 1) << (64 - bits))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in the sorted ``keys``."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def asked(keys: np.ndarray, marks: np.ndarray, blk: int, buckets: int) -> pa.Table:
    """The questions of one block: sorted distinct keys with a mark each (any unsigned integers)."""
    at = bucket_bounds(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "bucket": pa.array(full, pa.int64()),
            "blk": pa.array(np.full(len(full), blk), pa.int64()),
            "keys": pa.array([squeeze_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
            "marks": pa.array([squeeze(marks[at[b] : at[b + 1]]) for b in full], pa.binary()),
        }
    )


def gathered(group: pa.Table, mark: type) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's questions, in the order of blocks: blocks, keys of each, all distinct keys, each question's place in them, all marks."""
    order = np.argsort(group.column("blk").to_numpy(), kind="stable")
    keys = [expand_keys(group.column("keys")[int(i)].as_py()) for i in order]
    marks = [expand(group.column("marks")[int(i)].as_py(), mark) for i in order]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return group.column("blk").to_numpy()[order].tolist(), keys, distinct, place, np.concatenate(marks)


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))


def ask_all(
    docs: DataFrame,
    block_mb: float,
    ask: Callable[[pa.Table, int, int], pa.Table],
    answer: Callable[[pa.Table], pa.Table],
    answer_schema: str,
    use: Callable[[pa.Table, pa.Table], pa.Table],
    use_schema: str,
) -> DataFrame:
    """Runs questions, answers and their use; the documents are shuffled once for both sides.

    ``ask`` gets a block's documents, its number and the number of buckets;
    ``answer`` a bucket's questions, and gives rows with ``blk``; ``use`` a block's
    documents and all answers to it. An answer may be sent to a negative block,
    which has no documents: such rows carry a bucket's own totals.
    """
    n = parts(docs, block_mb)
    held = in_blocks(docs, n)

    def ask_block(key: tuple, group: pa.Table) -> pa.Table:
        return ask(group, key[0].as_py(), n)

    def answer_bucket(key: tuple, group: pa.Table) -> pa.Table:
        return answer(group)

    def use_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left, right)

    answers = held.groupBy("blk").applyInArrow(ask_block, ASKED).groupBy("bucket").applyInArrow(answer_bucket, answer_schema)
    return held.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(use_block, use_schema)


def each_row(group: pa.Table, mb: float = 4.0) -> Iterator[pa.RecordBatch]:
    """A block's documents in slices of bounded work space, in a fixed order."""
    from skein.llm.common import slices

    yield from slices(iter(group.combine_chunks().to_batches()), mb)
