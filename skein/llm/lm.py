"""LM scoring by deleted interpolation.

Tokens are words (A-Z lower-cased) and an end after each text; the end also stands
before the first word. The model mixes three estimates of a token w after h,

    P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1)

with weights l that depend on how often h was seen (buckets are powers of two of
c(h)). The weights are learned by expectation-maximisation on held-out counts: one
fold of the training documents is deleted from the counts, and its tokens say which
estimate would have served them. Scores then use the counts of all training
documents. The tokens of the fold are summed in a bounded table of bins (context
bucket, maximum-likelihood ratio, unigram count), so that the iterations cost
nothing that grows with the corpus; the counts themselves are exact over all of it.

Defined cases: a null or empty text is one end token; a null ``doc_id`` counts as
training data; repeated rows count each time; a token never seen has the mass of
l0 / (V + 1); without training tokens every score is that of V = N = 0; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SLOT, U, Words, crc_mod_column, cut, mix, text_column
from skein.llm.exchange import ask_all, asked, each_row, expand, gathered, squeeze

END = mix(np.array([0xE0D], dtype=U))[0]
ODD = U(1)
RATIO_BINS, COUNT_BINS = 64, 64
SCHEMA = "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, a double, b double, events binary"


def _tokens(group: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row bounds, token hashes (each row's end included) and folds of a block's rows."""
    ids, folds, hashes, sizes = [], [], [], []
    for batch in each_row(group):
        words = Words(batch.column("text"))
        counts = np.diff(words.ptr)
        own = np.full(len(words.hash) + len(counts), END, dtype=U)
        at = np.arange(len(words.hash)) + words.rows()
        own[at] = words.hash
        hashes.append(own)
        sizes.append(counts + 1)
        ids += batch.column("doc_id").to_pylist()
        folds.append(batch.column("fold").to_numpy())
    if not ids:
        return [], np.zeros(1, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(hashes), np.concatenate(folds)


def _keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token (odd) and of each token with the one before it (even)."""
    with np.errstate(over="ignore"):
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[ptr[:-1]] = END
        return h | ODD, mix(before * SLOT[0] + h * SLOT[1]) & ~ODD


def _bin(x: np.ndarray, scale: float, most: int) -> np.ndarray:
    """0 for nothing, else 1 + a step on a logarithmic scale."""
    out = np.zeros(len(x), dtype=np.int64)
    some = x > 0
    out[some] = 1 + np.minimum(most - 2, np.floor(np.abs(np.log2(x[some])) * scale).astype(np.int64))
    return out


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the integer part of log2 of its count."""
    out = np.zeros(len(c), dtype=np.int64)
    out[c > 0] = 1 + np.floor(np.log2(c[c > 0])).astype(np.int64)
    return out


def gather(docs: DataFrame, modulus: int, left_out: int, em_fold: int, block_mb: float) -> DataFrame:
    """Counts brought to every token: kind 0 documents, kind 1 bins of the fold, kind 2 totals of buckets."""
    rows = text_column(docs).withColumn("fold", F.coalesce(crc_mod_column("doc_id", modulus), F.lit(-1)).cast("long"))

    def ask(group: pa.Table, blk: int, buckets: int) -> pa.Table:
        _, ptr, h, folds = _tokens(group)
        fold = np.repeat(folds, np.diff(ptr))
        keys = np.concatenate(_keys(h, ptr))
        weight = np.where(fold == left_out, 0, np.where(fold == em_fold, (1 << 32) + 1, 1)).astype(np.int64)
        distinct, place = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, place, np.concatenate([weight, weight]))
        return asked(distinct, sums.astype(U), blk, buckets)  # low half: training count, high half: the fold's part of it

    def answer(group: pa.Table) -> pa.Table:
        blks, keys, distinct, place, marks = gathered(group, U)
        train, fold = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(train, place, (marks & U(0xFFFFFFFF)).astype(np.int64))
        np.add.at(fold, place, (marks >> U(32)).astype(np.int64))
        bucket = group.column("bucket")[0].as_py()
        single = (distinct & ODD) == 1
        own = np.array([np.count_nonzero(train[single]), train[single].sum(), fold[single].sum()], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        big = lambda x, i: squeeze(x[place[at[i] : at[i + 1]]].astype(U))
        n = len(blks)
        return pa.table(
            {
                "blk": pa.array([*blks, -1 - bucket], pa.int64()),
                "bucket": pa.array([bucket] * (n + 1), pa.int64()),
                "train": pa.array([*(big(train, i) for i in range(n)), own.tobytes()], pa.binary()),
                "fold_part": pa.array([*(big(fold, i) for i in range(n)), b""], pa.binary()),
            }
        )

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a bucket's totals
            v, n, f = (sum(int(np.frombuffer(x.as_py(), np.int64)[k]) for x in right.column("train")) for k in range(3))
            return _table([(2, None, None, v, n, float(f), 0.0, b"")])
        ids, ptr, h, folds = _tokens(left)
        one, two = _keys(h, ptr)
        distinct, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        order = np.argsort(right.column("bucket").to_numpy())
        full = lambda c: np.concatenate([expand(right.column(c)[int(i)].as_py(), U) for i in order]).astype(np.int64)
        train, fold = full("train"), full("fold_part")
        assert len(train) == len(distinct), "answers do not match the questions"
        c1, c2 = train[place[: len(h)]], train[place[len(h) :]]
        end = train[np.searchsorted(distinct, END | ODD)]
        out = []
        logs = np.log10(c1 + 1.0)
        for i, doc in enumerate(ids):
            a, b = ptr[i], ptr[i + 1]
            own = c1[a:b]
            out.append((0, doc, bool(folds[i] == left_out), int(b - a), int((own > 0).sum()), float(logs[a:b].sum()), float(end), squeeze(np.stack([own, c2[a:b]]).astype(U).reshape(-1))))
        inside = np.repeat(folds == em_fold, np.diff(ptr))
        if inside.any():
            kept = train - fold
            k1, k2 = kept[place[: len(h)]], kept[place[len(h) :]]
            before = np.empty_like(k1)
            before[1:] = k1[:-1]
            before[ptr[:-1]] = kept[np.searchsorted(distinct, END | ODD)]
            k1, k2, before = k1[inside], k2[inside], before[inside]
            ratio = k2 / np.maximum(before, 1)
            bins = (context_bucket(before) * RATIO_BINS + _bin(ratio, 4, RATIO_BINS)) * COUNT_BINS + _bin(k1.astype(float), 2, COUNT_BINS)
            n = np.bincount(bins)
            sums, counts = np.bincount(bins, ratio), np.bincount(bins, k1)
            out += [(1, int(b), None, int(n[b]), 0, float(sums[b]), float(counts[b]), b"") for b in np.flatnonzero(n)]
        return _table(out)

    return ask_all(rows, block_mb, ask, answer, "blk long, bucket long, train binary, fold_part binary", use, SCHEMA)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    names = ("kind", "doc_id", "held_out", "n_tokens", "n_known", "a", "b", "events")
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def learn_weights(bins: list[tuple[int, int, float, float]], n_kept: int, v: int, rounds: int = 50) -> np.ndarray:
    """Weights (l2, l1, l0) of each context bucket from (bin, tokens, sum of ratios, sum of counts).

    A bucket that no held-out token fell into takes the weights of all buckets together.
    """
    weights = np.tile([0.0, 0.9, 0.1], (64, 1))
    if not bins:
        return weights
    where, n, ratio, count = (np.array(x, dtype=np.float64) for x in zip(*bins))
    bucket = (where // (RATIO_BINS * COUNT_BINS)).astype(np.int64)
    p = np.stack([ratio / n, count / n / max(1, n_kept), np.full(len(n), 1.0 / (v + 1))], 1)

    def em(rows: np.ndarray, start: list[float]) -> np.ndarray:
        w = np.array(start)
        for _ in range(rounds):
            share = w * p[rows]
            share /= share.sum(1, keepdims=True)
            w = np.maximum((share * n[rows][:, None]).sum(0) / n[rows].sum(), [0.0, 0.0, 1e-6])
            w /= w.sum()
        return w

    weights[:] = em(np.arange(len(n)), [0.4, 0.4, 0.2])
    for b in np.unique(bucket):
        weights[b] = em(np.flatnonzero(bucket == b), [0.4, 0.4, 0.2] if b else [0.0, 0.8, 0.2])
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def score(docs: DataFrame, modulus: int = 7, left_out: int = 2, em_fold: int = 3, block_mb: float = 8.0) -> DataFrame:
    """Scores every text; learns from those whose crc32(id) modulo ``modulus`` is not ``left_out``."""
    held = cut(gather(docs, modulus, left_out, em_fold, block_mb), "lm-counts")
    row = held.filter("kind = 2").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_known", "a"))).first()
    v, n, folded = row["n_tokens"], row["n_known"], int(row["a"])
    bins = held.filter("kind = 1").groupBy("doc_id").agg(F.sum("n_tokens"), F.sum("a"), F.sum("b")).orderBy("doc_id").collect()  # bounded by the table of bins
    weights = learn_weights([tuple(r) for r in bins], n - folded, v)

    def run(batches):
        for batch in batches:
            scores = []
            for end, events in zip(batch.column("b").to_pylist(), batch.column("events")):
                c1, c2 = expand(events.as_py(), U).reshape(2, -1).astype(np.float64)
                before = np.concatenate([[end], c1[:-1]])
                w = weights[context_bucket(before)]
                p = w[:, 0] * c2 / np.maximum(before, 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] / (v + 1)
                scores.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "a")), pa.array(scores, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    made = held.filter("kind = 0").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
