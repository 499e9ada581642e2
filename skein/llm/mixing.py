"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations.

A source with share q of all tokens gets the weight q**a / sum(q**a). The exponent
a is the largest in [0, 1] whose weights reach ``target_entropy`` (a share of the
most possible), but never so small that one source is repeated more than
``max_repeats`` times as often as another. It is found by bisection, many exponents
at a time: each round asks the table of sources for the sums at 33 points.

Documents of a source are dealt to blocks of about ``block_tokens`` by a keyed hash.
Each epoch visits the blocks in another keyed permutation, and the last epoch stops
where the source's budget ends, so no sorting and no task per source is needed.
Without a ``budget`` the least repeated source is read exactly once: every document
is kept, and the others are repeated. ``order_key`` in [0, 1) interleaves the
sources: any prefix of that order holds them near their weights.

Defined cases: a null source is a source of its own, called ""; null text has no
tokens but is kept; a source without any token is read once; a null ``doc_id`` is
dealt like any other; repeated rows are dealt alike and each kept; clashing extra
columns are kept by ``mix_documents`` and ignored by ``plan``; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

#: Odd primes for the affine permutations (fixed values).
PRIMES = (10_007, 20_011, 30_011, 40_009, 50_021, 60_013, 70_001, 80_021, 90_001, 100_003, 110_017, 120_011)
BROADCAST_ROWS = 100_000  # of sources; with more, the join is by shuffle
SALTS = 16  # parts of a source in that join


def n_words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    """Tokens and share of each source (summed per task first)."""
    sums = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), n_words("text").alias("t")).groupBy("mix_source").agg(F.sum("t").alias("mix_tokens"))
    return cut(sums, "mixing-sources")


def _sums(shares: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: sum of q**a, and of q**a * ln q."""
    q = F.col("mix_tokens") / F.lit(float(total))
    row = shares.agg(*(F.sum(F.pow(q, F.lit(a))).alias(f"z{i}") for i, a in enumerate(exponents)), *(F.sum(F.pow(q, F.lit(a)) * F.log(q)).alias(f"l{i}") for i, a in enumerate(exponents))).first()
    return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(exponents))]


def entropy(a: float, z: float, weighted: float) -> float:
    """Entropy of the weights q**a / z, in nats."""
    return math.log(z) - a * weighted / z


def find_exponent(shares: DataFrame, target_entropy: float, max_repeats: float) -> tuple[float, float, float]:
    """The exponent, its normaliser, and the share of the source that is repeated least."""
    some = shares.filter(F.col("mix_tokens") > 0)
    row = some.agg(F.sum("mix_tokens").alias("total"), F.count("*").alias("n"), F.min("mix_tokens").alias("least"), F.max("mix_tokens").alias("most")).first()
    total, n = row["total"] or 0, row["n"]
    if n == 0:
        return 1.0, 1.0, 1.0
    spread = math.log(row["most"] / row["least"])
    low, high = 0.0, 1.0  # bisect the limit on repeats: (most / least) ** (1 - a) <= max_repeats
    for _ in range(60):
        a = (low + high) / 2
        low, high = (a, high) if (1 - a) * spread > math.log(max_repeats) else (low, a)
    floor, goal = high, target_entropy * math.log(n)
    at, step = floor, 0.0
    if n > 1 and floor < 1:
        left, right = floor, 1.0  # entropy falls as the exponent rises
        for _ in range(5):
            points = [left + (right - left) * i / 32 for i in range(33)]
            good = [p for p, (z, w) in zip(points, _sums(some, total, points)) if entropy(p, z, w) >= goal]
            if not good:
                left = right = floor
                break
            step = (right - left) / 32
            left, right = max(good), min(1.0, max(good) + step)
        at = left
    z = _sums(some, total, [at])[0][0]
    return at, z, row["most"] / total


def plan_sources(docs: DataFrame, target_entropy: float, max_repeats: float, block_tokens: int, budget: int | None) -> DataFrame:
    """One row per source: its weight, blocks, whole epochs, and blocks of the last epoch."""
    shares = source_shares(docs)
    a, z, most = find_exponent(shares, target_entropy, max_repeats)
    total = shares.agg(F.sum("mix_tokens")).first()[0] or 0
    q = F.col("mix_tokens") / F.lit(float(max(1, total)))
    weight = F.when(F.col("mix_tokens") > 0, F.pow(q, F.lit(a)) / F.lit(z)).otherwise(0.0)
    spend = float(budget) if budget is not None else total * most / (most**a / z)
    repeats = F.when(F.col("mix_tokens") > 0, F.lit(spend) * weight / F.col("mix_tokens")).otherwise(1.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("mix_tokens") / block_tokens)).cast("long")
    rows = shares.select("mix_source", weight.alias("mix_weight"), blocks.alias("mix_blocks"), F.round(repeats * blocks).cast("long").alias("mix_visits"))
    return cut(rows.withColumn("mix_visits", F.when(F.lit(budget is None), F.greatest("mix_visits", "mix_blocks")).otherwise(F.col("mix_visits"))), "mixing-plan")


def _permuted(block: Column, n: Column, source: Column, epoch: Column, seed: int) -> Column:
    """A keyed permutation of the numbers below ``n``: times a prime that does not divide n, plus a shift."""
    key = F.xxhash64(F.lit(seed), source, epoch)
    turn = F.pmod(key, F.lit(len(PRIMES))).cast("int")
    primes = F.array(*map(F.lit, PRIMES))
    turned = F.concat(F.slice(primes, turn + 1, F.lit(len(PRIMES))), F.slice(primes, F.lit(1), turn))
    prime = F.element_at(F.filter(turned, lambda p: F.pmod(n, p) != 0), 1)
    return F.pmod(block * F.coalesce(prime, F.lit(1)) + F.pmod(F.xxhash64(key), n), n)


def dealt(docs: DataFrame, target_entropy: float = 0.98, max_repeats: float = 2.0, block_tokens: int = 65_536, budget: int | None = None, seed: int = 17) -> DataFrame:
    """``row`` (the columns of ``docs``) once per visit, with mix_source, mix_weight, mix_epoch, mix_block and mix_order.

    The documents' own columns stay inside ``row``, so that no name can clash.
    """
    plan = plan_sources(docs, target_entropy, max_repeats, block_tokens, budget)
    inner = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(inner).select("row", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("mix_source"))
    if plan.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(plan), "mix_source")
    else:  # the plan's row of a source is met by documents in so many parts, so that none is a task by itself
        salted = plan.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"]).drop("mix_salt")
    n, visits, doc = F.col("mix_blocks"), F.col("mix_visits"), F.col("row.doc_id").cast("long")
    rows = rows.withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed), doc), n))
    epochs = F.ceil(visits / n).cast("int")
    rows = rows.withColumn("mix_epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))))
    place = F.col("mix_epoch") * n + _permuted(F.col("mix_block"), n, F.col("mix_source"), F.col("mix_epoch"), seed)
    jitter = F.pmod(F.xxhash64(F.lit(seed), doc, "mix_epoch"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.withColumn("mix_place", place).filter(F.col("mix_place") < visits).withColumn("mix_order", (F.col("mix_place") + jitter) / visits)


def plan(docs: DataFrame, **options) -> DataFrame:
    """One row per visit of a document: its source, tokens, epoch, block and place in the mixed order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))
    return dealt(rows, **options).select("row.doc_id", F.col("mix_source").alias("source"), n_words(F.col("row.text")).alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_order").alias("order_key"), F.col("mix_weight").alias("weight"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as its source's weight asks, in the columns of ``docs``."""
    return dealt(docs, **options).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
