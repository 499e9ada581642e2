"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words and their first three to seven bytes,
lower-cased, hashed into ``2**bits`` slots. The score is the logistic of

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the slots that occur, so that two terms may say more together (an insult
and the mention of a group) than their weights add up to.

The model is fitted on a bounded sample: ``max_labelled`` labelled rows in the
order of a hash of their id, of which the ``max_terms`` slots that tell most of
the label are kept. Both bounds are parameters, and both hold however large the
corpus is; scoring reads every document whole.

Defined cases: a null or empty text has the score of no terms; null labels and
labels without a document teach nothing; if a document has several labels the
highest counts; where the labelled rows are none, or all of one label, nothing can
be told apart and every score is (nearly) 0, so that no document is rejected; a null ``doc_id`` is scored and never taught;
repeated rows are scored once each; other columns are ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BYTE, U, Words, _powers, crc_mod_column, cut, mix, slices, text_column

PREFIXES = (3, 4, 5, 6, 7)


@dataclass
class Machine:
    """Slots that the model knows, their weights and factors, and the base score."""

    bits: int
    slots: np.ndarray
    base: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, ptr: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Logistic scores of rows whose known terms (as positions in ``slots``) are ``known[ptr[i]:ptr[i + 1]]``."""
        return 1 / (1 + np.exp(-np.clip(self.margin(ptr, known)[0], -30, 30)))

    def margin(self, ptr: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        n, k = len(ptr) - 1, self.factor.shape[1]
        total = np.full(n, self.base) + np.bincount(rows, self.weight[known], n)
        v = self.factor[known]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(k)], 1)
        squares = np.bincount(rows, (v * v).sum(1), n)
        return total + 0.5 * ((sums**2).sum(1) - squares), sums


def terms(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word and prefix occurrence, with repeats."""
    words = Words(texts, letters=True)
    rows, up = words.rows(), _powers()[0]
    mask = U((1 << bits) - 1)
    found = [(rows, words.hash & mask)]
    length = words.end - words.start
    total = np.zeros(len(length), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(PREFIXES[-1]):
            keep = length > k
            rows, length, total = rows[keep], length[keep], total[keep]
            start = words.start[keep] if k == 0 else start[keep]  # noqa: F821
            total = total + BYTE[words.lowered[start + k]] * up[k]
            if k + 1 in PREFIXES:
                found.append((rows, mix(total + U(k + 1)) & mask))
    return np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found]).astype(np.int64)


def known_terms(texts: pa.Array, bits: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and distinct known terms of each row; ``place[slot]`` is a term's position or -1."""
    rows, slots = terms(texts, bits)
    at = place[slots]
    rows, at = rows[at >= 0], at[at >= 0]
    key = np.unique(rows * (1 << 32) + at)
    return np.searchsorted(key >> 32, np.arange(len(texts) + 1)), key & ((1 << 32) - 1)


def _place(bits: int, slots: np.ndarray) -> np.ndarray:
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[slots] = np.arange(len(slots))
    return place


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_terms: int = 4096, bits: int = 20, least_gain: float = 15.0, fold: tuple[int, int] = (4, 2)) -> Machine:
    """Learns from labelled rows whose crc32(id) modulo ``fold[0]`` is not ``fold[1]``.

    ``least_gain`` is the log-likelihood ratio that a term needs to be kept.
    """
    known_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod_column("doc_id", fold[0]) != fold[1]))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(known_ids, "doc_id", "left_semi")  # labels without a document use up none of the sample
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)  # at most max_labelled rows of 12 bytes: small enough to broadcast
    )

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, slots = terms(batch.column("text"), bits)
            key = np.unique(rows * (1 << 32) + slots)
            ptr = np.searchsorted(key >> 32, np.arange(batch.num_rows + 1))
            own = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(key & ((1 << 32) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), own], ["toxic", "slots"])

    sample = cut(text_column(docs).join(F.broadcast(taught), "doc_id").select("toxic", "text").mapInArrow(slots_of, "toxic int, slots array<int>"), "toxicity-sample")
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    if pos in (0, n):
        return Machine(bits, np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, 1)))
    a, b = F.col("a"), F.col("b")

    def part(x, row, col):
        return F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)

    gain = 2 * (part(a, a + b, F.lit(float(pos))) + part(b, a + b, F.lit(float(n - pos))) + part(pos - a, n - a - b, F.lit(float(pos))) + part(n - pos - b, n - a - b, F.lit(float(n - pos))))
    chosen = (
        sample.select(F.explode("slots").alias("slot"), "toxic")
        .groupBy("slot")
        .agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
        .filter(a + b >= 3)
        .withColumn("gain", gain)
        .filter(F.col("gain") >= least_gain)
        .orderBy(F.desc("gain"), "slot")
        .limit(max_terms)
    )
    slots = np.array(sorted(r["slot"] for r in chosen.select("slot").collect()), dtype=np.int64)
    place = _place(bits, slots)

    def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.asarray(place[x.values.to_numpy()], dtype=np.int32) for x in batch.column("slots")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x[x >= 0].tobytes() for x in own], pa.binary())], ["toxic", "known"])

    rows = sample.mapInArrow(chosen_only, "toxic int, known binary").collect()  # at most max_labelled rows of max_terms positions
    rows.sort(key=lambda r: (bytes(r["known"]), r["toxic"]))
    known = [np.frombuffer(r["known"], dtype=np.int32) for r in rows]
    return train(known, np.array([r["toxic"] for r in rows], dtype=np.float64), slots, bits)


def train(known: list[np.ndarray], y: np.ndarray, slots: np.ndarray, bits: int, factors: int = 8, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss by AdaGrad over small batches, the order of rows drawn from ``seed``."""
    rng = np.random.default_rng(seed)
    m = len(slots)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Machine(bits, slots, float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.01, (m, factors)))
    gw, gv, gb = np.full(m, 1e-8), np.full((m, factors), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            ptr = np.concatenate([[0], np.cumsum([len(known[r]) for r in batch])])
            at = np.concatenate([known[r] for r in batch]) if ptr[-1] else np.zeros(0, np.int32)
            margin, sums = model.margin(ptr, at)
            miss = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]
            rows = np.repeat(np.arange(len(batch)), np.diff(ptr))
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, miss[rows], len(used)) + l2 * model.weight[used]
            each = miss[rows][:, None] * (sums[rows] - model.factor[at])
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(factors)], 1) + l2 * model.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += miss.sum() ** 2
            model.weight[used] -= rate * dw / np.sqrt(gw[used])
            model.factor[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            model.base -= rate * miss.sum() / np.sqrt(gb)
    return model


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id`` and the score of every whole text."""
    bits, slots = model.bits, model.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _place(bits, slots)
        for batch in slices(batches):
            ptr, known = known_terms(batch.column("text"), bits, place)
            made = model.scores(ptr, known)
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), pa.array(made)], [*(n for n in batch.schema.names if n != "text"), "score"])

    return text_column(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or more; columns and order of columns unchanged."""
    names, bits, slots = docs.columns, model.bits, model.slots
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(names)))), names.index("text")  # names may hold dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _place(bits, slots)
        for batch in slices(batches, by=f"c{at}"):
            ptr, known = known_terms(batch.column(at).fill_null(""), bits, place)
            yield batch.filter(pa.array(model.scores(ptr, known) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
