"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Every document's ids are cut into pieces of ``size`` and a tail. Pieces are dealt
to groups by a keyed hash; each group is packed on its own, so no task sees more
than one group, and a group's size does not depend on the corpus. Only one small
row per piece is shuffled, never the ids.

Defined cases: null text is an empty text, which still has its end id and so one
piece of length 1. A null ``doc_id`` stays null. Repeated rows are packed once
each. Ties in length are broken by id, start and checksum. Columns other than
``doc_id`` and ``text`` are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import parts, text_column
from skein.llm.vocab import byte_bpe, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, size: int, path: str) -> DataFrame:
    """One row per piece: ids of the whole text and then id 0, cut every ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        for batch in batches:
            ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = np.append(encode(text.as_py()), np.uint32(0)).astype("<u4")
                for s in range(0, len(own), size):
                    piece = own[s : s + size]
                    ids.append(doc)
                    starts.append(s)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return text_column(docs).mapInArrow(run, PIECES)


class Tournament:
    """Bins' free room at the leaves, the larger of two children above: leftmost fit in log time."""

    def __init__(self, leaves: int, room: int):
        self.n = 1 << max(0, leaves - 1).bit_length()
        self.tree = [room] * (2 * self.n)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length`` and that bin's room before."""
        tree, i = self.tree, 1
        while i < self.n:
            i *= 2
            if tree[i] < length:
                i += 1
        room = tree[i]
        tree[i] = room - length
        leaf = i - self.n
        while i > 1:
            i //= 2
            top = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == top:
                break
            tree[i] = top
        return leaf, room


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` are in decreasing order already."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    full = int(np.searchsorted(-lengths, -size, side="right"))  # whole pieces fill a bin each
    bins[:full] = np.arange(full)
    rest = lengths[full:].tolist()
    tree = Tournament(len(rest), size)
    for k, length in enumerate(rest, full):
        leaf, room = tree.place(length)
        bins[k], offsets[k] = full + leaf, size - room
    return bins, offsets


def pack(docs: DataFrame, size: int = 1024, group_mb: float = 4.0, seed: int = 7, path: str | None = None, groups: int | None = None) -> DataFrame:
    """Packs ``docs`` into sequences of ``size`` ids at most.

    ``group_mb`` is the input behind one group, by the optimiser's size of the input;
    ``groups`` sets their number instead, so that a table gives the same sequences
    whatever its statistics say; ``seed`` deals the groups anew.
    Returns one row per piece with its sequence and its place there.
    """
    groups = groups or parts(docs, group_mb, least=16)
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.floor(F.col("start") / (64 * size)), "doc_tokens"), F.lit(groups)).cast("long")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns(["bin_group"]).combine_chunks()
        order = np.lexsort([group.column(c).to_numpy() for c in ("ids_crc32", "start", "doc_id", "length")])
        length = group.column("length").to_numpy()
        order = order[np.argsort(-length[order], kind="stable")]
        group = group.take(pa.array(order))
        bins, offsets = first_fit_decreasing(length[order], size)
        sequence = (int(key[0].as_py()) << 32) + bins
        return group.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return cut_pieces(docs, size, path or vocabulary_path("byte_bpe_50k.json")).withColumn("bin_group", dealt).groupBy("bin_group").applyInArrow(run, PACKED)
