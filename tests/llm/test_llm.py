"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import collections
import dataclasses
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chaining, chat, common, exchange, fertility, jaccard, lm, media, mixing, packing, queries, surrogates, toxicity, vocab

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, passage long, region string"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    full = [(d, t, lang, s, len(t or ""), 0.0, 1, "r") for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WS.findall(lower(text or ""))


def edge_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ünï", "日本"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    base = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(80)]
    near = base[:40] + ["changed"] + base[41:]
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "one two", "xx", None), (4, "one two", "en", "b"), (5, long, "de", "a"), (6, " ".join(base), "en", "b"), (7, " ".join(near), "en", "b"), (8, " ".join(base), "en", "b"), (8, " ".join(base), "en", "b"), (None, "lost words here now ok then", "en", "c"), (9, "ONE Two\x0bthree\x0cfour\x85five six", "en", "c"), (10, "x" * 3_000, "en", "a")]
    for i in range(11, 40):
        rows.append((i, " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))), "en", rng.choice("ab")))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ---------------------------------------------------------------- shared pieces
def test_words_match_the_pattern(spark):
    import pyarrow as pa

    texts = ["Ab c", "", "a\x0bB\x85 c  ", "É x", "one"]
    found = common.Words(pa.array(texts))
    for i, text in enumerate(texts):
        own = [found.lowered[a:b].tobytes().decode() for a, b in zip(found.start[found.ptr[i] : found.ptr[i + 1]], found.end[found.ptr[i] : found.ptr[i + 1]])]
        assert own == words(text)
    assert found.hash[0] != found.hash[1] and len(set(found.hash.tolist())) == len({w for t in texts for w in words(t)})


def test_hash_does_not_depend_on_place_or_segment(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(500)) + " " + "y" * 300
    plain = common.Words(pa.array([text])).hash
    monkeypatch.setattr(common, "SEGMENT", 64)
    common._POWERS.clear()
    small = common.Words(pa.array(["zz", text])).hash[1:]
    common._POWERS.clear()
    assert (plain[:-1] == small[:-1]).all()


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.uint64])
def test_squeeze_round_trip(kind):
    x = np.array([0, 1, 255, 7, np.iinfo(kind).max], dtype=kind)
    assert (exchange.expand(exchange.squeeze(x), kind) == x).all()
    keys = np.sort(common._splitmix(5, 1000))
    assert (exchange.expand_keys(exchange.squeeze_keys(keys)) == keys).all()
    assert exchange.bucket_bounds(keys, 7)[-1] == 1000


# ---------------------------------------------------------------- 1
def brute_lm(rows):
    tokens = [(d, [*words(t), None]) for d, t, *_ in rows]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 if d is not None else -1
    uni, bi, uni3, bi3 = (collections.Counter() for _ in range(4))
    for d, ts in tokens:
        if fold(d) == 2:
            continue
        uni.update(ts)
        bi.update(zip([None, *ts], ts))
        if fold(d) == 3:
            uni3.update(ts)
            bi3.update(zip([None, *ts], ts))
    return tokens, fold, uni, bi, uni3, bi3


def test_lm_against_brute_force(docs):
    rows = edge_rows()
    tokens, fold, uni, bi, uni3, bi3 = brute_lm(rows)
    n, v = sum(uni.values()), len(uni)
    bins = collections.defaultdict(lambda: [0, 0.0, 0])
    for d, ts in tokens:
        if fold(d) == 3:
            for h, w in zip([None, *ts], ts):
                c1, c2, ch = uni[w] - uni3[w], bi[h, w] - bi3[h, w], uni[h] - uni3[h]
                ratio = c2 / max(ch, 1)
                b = (lm.context_bucket(np.array([ch]))[0] * 64 + lm._bin(np.array([ratio]), 4, 64)[0]) * 64 + lm._bin(np.array([float(c1)]), 2, 64)[0]
                for k, x in enumerate((1, ratio, c1)):
                    bins[b][k] += x
    weights = lm.learn_weights([(b, *x) for b, x in sorted(bins.items())], n - sum(uni3.values()), v)
    expected = collections.Counter()
    for d, ts in tokens:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts)
        score = 0.0
        for h, w in zip([None, *ts], ts):
            l2, l1, l0 = weights[lm.context_bucket(np.array([uni[h]]))[0]]
            score += math.log10(l2 * bi[h, w] / max(uni[h], 1) + l1 * uni[w] / n + l0 / (v + 1))
        expected[(d, fold(d) == 2, len(ts), sum(uni[w] > 0 for w in ts), n, round(base, 6), round(score, 6))] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect())
    assert got == expected


def test_lm_weights_prefer_what_predicts():
    told = lm.learn_weights([(5 * 64 * 64, 100, 95.0, 100.0)], 10_000, 1000)
    assert told[5][0] > 0.9 and told[0][0] == 0 and np.allclose(told.sum(1), 1)


def test_lm_beats_its_base_on_held_out_texts(spark, sf):
    rows = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# ---------------------------------------------------------------- 2
def test_chaining_finds_planted_fuzzy_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    rows, planted = [], set()
    for d in range(40):
        own = [word() for _ in range(200)]
        if d % 4 == 0:
            copy = list(passage)
            if d:
                copy[20 + d // 4] = "edited"
                del copy[50]
            own[100:100] = copy
            planted.add(d)
        rows.append((d, " ".join(own), "en", "a"))
    found = chaining.passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == planted
    by = {d: t.split() for d, t, *_ in rows}
    for r in found:
        a, b = by[r.doc_id][r.start_word : r.end_word], by[r.partner][r.partner_start : r.partner_end]
        assert 60 <= len(a) <= 75 and r.matched == max(len(a), len(b)) - chaining.edit_distance(a, b)


def test_chaining_edge_cases(docs, empty):
    found = {(r.doc_id, r.partner) for r in chaining.passages(docs).collect()}
    assert found >= {(6, 7), (7, 6), (8, 6)} and {d for d, _ in found} == {6, 7, 8}
    assert chaining.passages(empty).count() == 0


def test_chaining_keeps_exact_passages_of_a_chain_that_is_not_alike_enough(spark):
    rng = random.Random(8)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    three, phrase = [some(50) for _ in range(3)], [some(14), some(50)]
    rows = [(d, " ".join(w for p in three for w in [*p, *some(25)]), "en", "a") for d in (1, 2)]
    rows += [(d, " ".join([*phrase[0], *some(25), *phrase[1]]), "en", "a") for d in (3, 4)]
    found = chaining.passages(frame(spark, rows)).collect()
    covered = collections.defaultdict(set)
    for r in found:
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 40
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    for d in (1, 2):
        assert covered[d] >= {75 * p + i for p in range(3) for i in range(50)}
    for d in (3, 4):
        assert covered[d] == set(range(39, 89))


def test_chaining_looks_past_the_first_two_holders(spark):
    rng = random.Random(9)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = some(60)
    parts = {1: passage[:30], 2: passage[:30], 3: passage[30:], 4: passage[30:], 100: passage, 101: passage}
    parts |= {5 + i: passage[i % 2 * 30 :][:30] for i in range(80)}  # more holders of the halves than one round asks for
    found = chaining.passages(frame(spark, [(d, " ".join([*some(50), *p, *some(50)]), "en", "a") for d, p in parts.items()])).collect()
    assert {(r.doc_id, r.partner, r.start_word, r.end_word, r.matched) for r in found} == {(100, 101, 50, 110, 60), (101, 100, 50, 110, 60)}


def test_chaining_of_documents_that_repeat_themselves(spark):
    rng = random.Random(10)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    quoted, twice = some(60), some(60)
    texts = {1: [*quoted[:30], *some(100), *quoted], 2: quoted, 3: [*twice, *some(50), *twice], 4: twice, 5: ["x", "y"] * 400, 6: ["y"] + ["x", "y"] * 300}
    found = chaining.passages(frame(spark, [(d, " ".join(t), "en", "a") for d, t in texts.items()])).collect()
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    assert covered[1] >= set(range(130, 190)) and covered[2] == set(range(60))
    assert covered[3] == {*range(60), *range(110, 170)} and covered[4] == set(range(60))
    assert len(covered[5]) >= 600 and len(covered[6]) == 601


def patchwork(seed, n=200):
    """Documents of lines that many have, passages edited or cut, and words of their own."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    lines, shared = [some(rng.randrange(6, 20)) for _ in range(12)], [some(rng.randrange(30, 90)) for _ in range(6)]
    rows = []
    for d in range(n):
        text = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.65:
                text += some(rng.randrange(5, 60)) if kind < 0.35 else rng.choice(lines)
                continue
            copy = list(rng.choice(shared))
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = some(1)[0]
            text += copy[rng.randrange(9) :] if rng.random() < 0.4 else copy
        rows.append((d, " ".join(text), "en", "a"))
    return rows


def brute_passages(rows):
    import pyarrow as pa

    hashes = {d: common.Words(pa.array([t])).hash for d, t, *_ in rows}
    found = []
    for a, b in itertools.combinations(sorted(hashes), 2):
        for x0, x1, y0, y1, _ in chaining.passages_between(hashes[a], hashes[b], chaining.Rule()):
            found += [(a, x0, x1, b), (b, y0, y1, a)]
    return found


def covered_words(found):
    out = collections.defaultdict(set)
    for d, a, b, *_ in found:
        out[d].update(range(a, b))
    return out


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 16), (3, 1)])
def test_chaining_against_all_pairs(spark, seed, most):
    rows = patchwork(seed)
    want = brute_passages(rows)
    got = [(r.doc_id, r.start_word, r.end_word, r.partner) for r in chaining.passages(frame(spark, rows), most=most).collect()]
    all_words, words_found = covered_words(want), covered_words(got)
    # an anchor is in one chain only, so of chains that part at it whole documents and segments may prefer another
    assert len(set(all_words) - set(words_found)) <= 1
    assert sum(len(all_words[d] - words_found[d]) for d in all_words) <= 0.01 * sum(map(len, all_words.values()))
    if most == 1000:  # all pairs, but for those of documents that have the same segment as another
        same = collections.defaultdict(set)
        for d, a, b, p in got:
            same[d].add(p)
        lost = [(d, p) for d, _, _, p in want if p not in same[d] and not same[d] & same[p]]
        assert len(lost) <= 0.01 * len(want)


def test_chaining_of_pieces_that_earlier_documents_hold(spark):
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, rows = some(105), []
    for i in range(0, 100, 20):  # each stretch of 20 words is in two earlier documents
        rows += [(i // 10 + j, " ".join([*some(40), *passage[i : i + 20], *some(40)]), "en", "a") for j in (0, 1)]
    copy = [w if i % 21 != 20 else "other" for i, w in enumerate(passage)]
    rows += [(10, " ".join(passage), "en", "a"), (11, " ".join(copy), "en", "a")]
    runs, left, right = (5, 3, 3, 3, 5, 3, 3, 2, 5), [], []
    for n in runs:  # 32 of 40 words, three seeds
        both = some(n)
        left += [*both, *some(1)]
        right += [*both, *some(1)]
    rows += [(20, " ".join(left[:-1]), "en", "a"), (21, " ".join(right[:-1]), "en", "a")]
    for most, cost in ((16, 0.01), (1, 0.1)):  # seeds so far apart are a chain only where gaps cost little
        found = {(r.doc_id, r.partner) for r in chaining.passages(frame(spark, rows), most=most, gap_cost=cost).collect()}
        assert found == {(10, 11), (11, 10)} | ({(20, 21), (21, 20)} if cost < 0.1 else set())


def test_chaining_of_many_copies_costs_a_row_each(spark):
    rng = random.Random(13)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, edge = some(60), some(36)
    rows = [(d, " ".join(one), "en", "a") for d in range(500)]
    rows += [(1000 + d, " ".join([*some(50), *edge, *some(50)]), "en", "a") for d in range(20)]  # too short but for the next
    rows += [(2000, " ".join([*edge[:18], *some(5), *edge[18:]]), "en", "a")]
    found = chaining.passages(frame(spark, rows)).collect()
    count = collections.Counter(r.doc_id for r in found)
    assert set(count) >= set(range(500)) and all(count[d] == 1 for d in range(500))
    assert {r.partner for r in found if r.doc_id < 500} == {0, 499}


@pytest.mark.parametrize("seed", range(20))
def test_all_anchors_are_all_diagonal_runs(seed):
    rng = random.Random(seed)
    sides = []
    for _ in range(2):
        places = sorted(rng.sample(range(60), rng.randrange(1, 50)))
        sides += [np.array([rng.randrange(1 + seed % 4) for _ in places], np.uint64), np.array(places)]
    ka, xa, kb, xb = sides
    same = {(x, y) for p, x in zip(ka.tolist(), xa.tolist()) for q, y in zip(kb.tolist(), xb.tolist()) if p == q}
    want = set()
    for x, y in same:
        if (x - 1, y - 1) not in same:
            n = 1
            while (x + n, y + n) in same:
                n += 1
            want.add((x, y, n))
    got = list(zip(*(v.tolist() for v in chaining.all_anchors(ka, xa, kb, xb))))
    assert len(got) == len(set(got)) and set(got) == want
    ka, kb = (np.array(rng.sample(range(60), 40)) for _ in range(2))  # each k-mer once
    (ia, xa), (ib, xb) = ((k[np.isin(k, o)], np.flatnonzero(np.isin(k, o))) for k, o in ((ka, kb), (kb, ka)))
    for one, many in zip(chaining.single_anchors(ia, xa, ib, xb, 60), chaining.all_anchors(ia, xa, ib, xb)):
        assert (one == many).all()


@pytest.mark.parametrize("seed", range(20))
def test_sub_chains_are_all_longest_runs(seed):
    rng = random.Random(seed)
    x, y, n, same, a, b = [], [], [], {}, 0, 0
    for i in range(rng.randrange(1, 15)):
        x.append(a), y.append(b), n.append(rng.randrange(1, 30))
        gap = rng.randrange(1, 26), rng.randrange(1, 26)
        same[i + 1] = rng.randrange(min(gap))
        a, b = a + n[-1] + 4 + gap[0], b + n[-1] + 4 + gap[1]
    same.pop(len(x))
    good = {}
    for i in range(len(x)):
        for j in range(i, len(x)):
            longer = max(x[j] + n[j] + 4 - x[i], y[j] + n[j] + 4 - y[i])
            matched = sum(n[i : j + 1]) + 4 * (j + 1 - i) + sum(same[t] for t in range(i + 1, j + 1))
            if longer >= 40 and matched >= 0.8 * longer:
                good[i, j] = matched
    longest = [(i, j, m) for (i, j), m in sorted(good.items()) if not any(p <= i and j <= q and (p, q) != (i, j) for p, q in good)]
    assert chaining.sub_chains(x, y, n, 5, same, 40, 80) == longest


def brute_chain(xs, ys, size, cost):
    best = [float(s) for s in size]
    for i in sorted(range(len(xs)), key=lambda i: (xs[i], ys[i])):
        for j in range(len(xs)):
            if xs[j] + size[j] <= xs[i] and ys[j] + size[j] <= ys[i]:
                best[i] = max(best[i], size[i] + best[j] - cost * (xs[i] - xs[j] - size[j] + ys[i] - ys[j] - size[j]))
    return max(best)


@pytest.mark.parametrize("seed", range(20))
def test_fenwick_chain_is_optimal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    xs, ys, size = ([rng.randrange(100) for _ in range(n)] for _ in range(3))
    size = [s % 9 + 1 for s in size]
    chains = chaining.chain_anchors(np.array(xs), np.array(ys), np.array(size), 0.1, 10**9, 1)
    score = lambda c: sum(size[i] for i in c) - 0.1 * sum(xs[b] - xs[a] - size[a] + ys[b] - ys[a] - size[a] for a, b in itertools.pairwise(c))
    assert math.isclose(max(map(score, chains)), brute_chain(xs, ys, size, 0.1))
    assert sorted(i for c in chains for i in c) == list(range(n))


# ---------------------------------------------------------------- 3
def test_mixing_weights_and_whole_corpus(spark):
    rows = [(i, "w " * 50, "en", "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(9000, None, "en", "none"), (9001, "x", "en", None)]
    docs = frame(spark, rows)
    got = mixing.plan(docs, block_tokens=200).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in rows}
    tokens, weight = collections.Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        weight[r.source] = r.weight
    assert math.isclose(sum(weight.values()), 1, abs_tol=1e-9)
    total = sum(tokens.values())
    for s in ("big", "s0", "s1"):
        assert abs(tokens[s] / total - weight[s]) < 0.02
    assert max(r.epoch for r in got) <= 2 and all(0 <= r.order_key < 1 for r in got)


def test_exponent_meets_entropy_and_repeat_limit(spark):
    shares = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "mix_source string, mix_tokens long")
    a, z, most = mixing.find_exponent(shares, 0.7, 1e9)
    q = np.array([0.9, 0.09, 0.01]) ** a / z
    assert abs(-(q * np.log(q)).sum() - 0.7 * math.log(3)) < 1e-4 and most == 0.9
    a, _, _ = mixing.find_exponent(shares, 1.0, 3.0)
    assert abs((9000 / 100) ** (1 - a) - 3) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 7, 10_007, 20_014])
def test_block_order_is_a_permutation(spark, n):
    rows = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(1), 17).alias("p"))
    assert rows.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (n, 0, n - 1)


def test_mixing_edge_cases(docs, empty):
    assert mixing.plan(empty).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.plan(docs, budget=10).count() < docs.count()


# ---------------------------------------------------------------- 4
def test_fertility_counts_against_brute_force(docs):
    expected = collections.Counter()
    for d, t, *_ in edge_rows():
        t = t or ""
        w = WS.findall(t)
        lines = [x for x in t.split("\n") if WS.search(x)]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = fertility.judge(docs).collect()
    assert collections.Counter(tuple(r[:7]) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)


def test_fertility_rejects_what_lies_outside_its_language(spark):
    rng = random.Random(1)
    plain = ["house", "green", "water", "people", "number", "under", "little", "great", "small", "world"]
    rows = [(i, " ".join(rng.choice(plain) + rng.choice(plain) for _ in range(100)), "en", "a") for i in range(200)]
    rows.append((500, " ".join("".join(rng.choice("ⱥƶ₿ꜩ") for _ in range(6)) for _ in range(100)), "en", "a"))
    got = {r.doc_id: r.kept for r in fertility.judge(frame(spark, rows)).collect()}
    assert not got[500] and sum(got.values()) >= 198


def test_scripts_and_empty_table(empty):
    assert [fertility.script_of(x) for x in ("abc", "Привет", "漢字", "12 !", "αβγ")] == ["latin", "cyrillic", "han", "none", "greek"]
    assert fertility.judge(empty).count() == 0


# ---------------------------------------------------------------- 5
def brute_components(rows):
    sets = []
    for d, t, *_ in rows:
        w = words(t)
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))))
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            top[root(i)] = root(j)
    name = collections.defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            name[root(i)].append(d)
    return collections.Counter((d, len(s), (min(name[root(i)], default=None) if s else d)) for i, (d, s) in enumerate(sets))


def families(seed, n):
    """Groups of near copies at distances around the threshold, some around shared passages."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(60)], []
    while len(rows) < n:
        base = [word() for _ in range(rng.randrange(5, 150))]
        if rng.random() < 0.4:
            base = passage + base[:15]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "en", "a"))
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"small": 8, "pivots": 2}), (3, {"small": 4, "pivots": 4})])
def test_jaccard_against_brute_force(spark, seed, options):
    rows = families(seed, 250)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows), **options).collect())
    assert got == brute_components(rows)


def test_jaccard_edge_cases(docs, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect())
    assert got == brute_components(edge_rows())
    assert jaccard.components(empty).count() == 0
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and {0, 1, 2, 3, 6} <= set(kept) and not {4, 7, 8} & set(kept)


def test_one_of_each_keeps_one_row_of_near_copies_without_ids_or_with_one_id(spark):
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    base = [text() for _ in range(4)]
    rows = [(d, " ".join([*b, *end]), "en", "a") for b, d in zip(base, (None, None, 5, 6)) for end in ([], ["one"], ["two", "more"])]
    rows += [(None, " ".join([*base[3], "unnamed"]), "en", "a"), (None, "", "en", "a"), (None, "", "en", "a")]
    kept = jaccard.one_of_each(frame(spark, rows)).collect()
    starts = collections.Counter((r.doc_id, r.text[:20]) for r in kept)
    assert starts == {**{(d, " ".join(b)[:20]): 1 for b, d in zip(base, (None, None, 5, 6))}, (None, ""): 2}


def test_set_packing_keeps_all_bits():
    x = np.sort(common._splitmix(9, 50))
    assert (jaccard.unpack(jaccard.pack(x)) == x).all()


def clashing(spark, rows):
    """Documents with columns named as those that the operators make inside."""
    names = ("row", "key", "id", "gone_id", "gone_key", "_text_key", "mix_source", "mix_weight", "mix_epoch", "mix_salt", "_pattern", "_found", "_made", "a.b", "count")
    data = frame(spark, rows).select("doc_id", "text", "lang", "source")
    return data.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})


def test_no_column_name_clashes(spark):
    data = clashing(spark, edge_rows())
    want = {(r.doc_id, *(r[c] for c in data.columns[4:])) for r in data.collect()}
    model = toxicity.Machine(20, np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, 1)))
    for out in (mixing.mix_documents(data), surrogates.anonymise(data, "k"), jaccard.one_of_each(data), toxicity.drop_toxic(data, model)):
        assert out.columns == data.columns and out.dtypes == data.dtypes
        got = {(r.doc_id, *(r[c] for c in data.columns[4:])) for r in out.collect()}
        assert got <= want and len(got) > 30


# ---------------------------------------------------------------- 6
def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1200):
        text = [rng.choice(vocabulary) for _ in range(60)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text[5:5] = ["awful"] * insult
        text[9:9] = ["groupx"] * group
        rows.append((i, " ".join(text), "en", "a"))
        marks.append((i, int(insult != group)))  # either alone: no weighted sum of the two can tell
    docs = frame(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    share = lambda got: np.mean([got[i] == (y == 1) for i, y in marks if zlib.crc32(str(i).encode()) % 4 == 2])
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert share(got) > 0.97
    plain = dataclasses.replace(model, factor=np.zeros_like(model.factor))
    assert share({r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, plain).collect()}) < 0.8
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score(docs, model).collect()}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, toxic in got.items() if not toxic}


def test_toxicity_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    for labels in (none, spark.createDataFrame([(6, 1)], "doc_id long, toxic int"), spark.createDataFrame([(6, 0)], "doc_id long, toxic int")):
        assert max(r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()) < 1e-9
    assert toxicity.drop_toxic(docs, model).count() == docs.count()
    odd = spark.createDataFrame([(5, None), (None, 1), (6, 1), (6, 0), (77777, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd)).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0


# ---------------------------------------------------------------- 7
def test_packing_is_whole(spark, docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))
    rows = [*edge_rows(), (70, "a <|endoftext|> b", "en", "a"), (71, " " * 1_000_000 + "a", "en", "a"), (72, "x" * 300_000, "en", "a")]
    got = packing.pack(frame(spark, rows)).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.start)].append(r)
    for d, t, *_ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        while at < len(ids):
            r = pieces[(d, at)].pop()
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    assert not any(pieces.values())
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endof<|endoftext|>", "퟿‍👩‍👩‍👧 x", "  \n\n\t x  ", "don't DON'T 12345", "a" * 100_000, " " * 1_000_000 + "a", " \n" * 200_000])
def test_ranks_give_the_same_ids(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))
    assert vocab.byte_bpe(vocab.vocabulary_path("byte_bpe_50k.json"))(text).tolist() == model.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_against_a_plain_loop():
    rng = np.random.default_rng(2)
    lengths = -np.sort(-rng.integers(1, 1025, 400))
    bins, offsets = packing.first_fit_decreasing(lengths, 1024)
    room: list[int] = []
    for k, n in enumerate(lengths):
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(1024)
        assert (bins[k], offsets[k]) == (b, 1024 - room[b])
        room[b] -= n


# ---------------------------------------------------------------- 8
def test_surrogates_keep_kind_format_and_identity(spark):
    text = "Mail ann.b7@mail3.example.com, call +1 (415) 555-0123 from 10.0.0.255; card 4111111111111111. token = \"40a0bcdef0123456789abcdef0123456789abcde\" Mr. John Smith and Mary Jones-Smith; Smith. ann.b7@mail3.example.com 3.14159 2024-01-02 Анна Петрова"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (1, text)], "doc_id long, text string")
    rows = surrogates.report(docs, "skein").collect()
    new = next(r for r in rows if r.doc_id == 1)
    for secret in ("ann.b7", "mail3", "555-0123", "10.0.0.255", "4111111111111111", "40a0bcdef", "John", "Smith", "Mary", "Петрова"):
        assert secret not in new.text
    assert "3.14159 2024-01-02" in new.text and new.n_distinct == new.n_surrogates
    mails = re.findall(r"\S+@\S+?example\.com", new.text)
    assert len(mails) == 2 and mails[0] == mails[1] and re.fullmatch(r"[a-z]{3}\.[a-z]\d@[a-z]{4}\d\.example\.com", mails[0])
    card = re.search(r"\b4\d{15}\b", new.text)[0]
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    first, last = re.search(r"Mr\. (\w+) (\w+) and", new.text).groups()
    assert first in surrogates.GIVEN["male latin"] and f"; {last}." in new.text
    assert re.search(r"and (\w+) ", new.text)[1] in surrogates.GIVEN["female latin"]
    assert re.search(r"(\w+) \w+$", new.text)[1] in surrogates.GIVEN["female cyrillic"]
    assert {r.text for r in rows if r.n_entities} == {new.text} and [r.text for r in rows if r.doc_id == 2] == [None]
    assert surrogates.collisions(docs, "skein").count() == 0
    assert surrogates.report(docs, "another key").filter("doc_id = 1").first().text != new.text


def test_bijection_is_one_to_one(spark):
    rows = spark.range(676).select(F.concat(F.char((F.col("id") / 26).cast("int") + 97), F.char(F.col("id") % 26 + 97)).alias("x"))
    got = rows.select(surrogates.bijection(F.col("x"), "k", "t").alias("y")).agg(F.count_distinct("y")).first()[0]
    hosts = spark.range(4000).select(surrogates._host(F.concat(F.lit("1.2."), (F.col("id") / 256).cast("int"), F.lit("."), F.col("id") % 256), "k").alias("y")).distinct().count()
    assert got == 676 and hosts == 4000


def test_moved_is_one_to_one_and_moves_all(spark):
    rows = spark.range(676).select(F.concat(F.char((F.col("id") / 26).cast("int") + 97), F.char(F.col("id") % 26 + 97)).alias("x"))
    got = rows.select("x", surrogates.moved(F.col("x"), "k", "t").alias("y"))
    assert got.agg(F.count_distinct("y")).first()[0] == 676 and got.filter("x = y").count() == 0
    back = surrogates.bijection(surrogates.bijection(F.col("x"), "k", "t"), "k", "t", back=True)
    assert rows.filter(back != F.col("x")).count() == 0
    hosts = spark.range(4000).select(F.concat(F.lit("1.2."), (F.col("id") / 256).cast("int"), F.lit("."), F.col("id") % 256).alias("x"))
    assert hosts.filter(surrogates._host(F.col("x"), "k") == F.col("x")).count() == 0
    names = [(a + b + c,) for a in "BDK" for b in "aeiou" for c in ("nna", "ria", "vid", "ul", "ry", "tra")]
    names = spark.createDataFrame([*names, *((n,) for listed in surrogates.GIVEN.values() for n in listed.split())], "x string").distinct()
    made = names.select("x", surrogates._name(F.col("x"), "k").alias("y"))
    assert made.select("y").distinct().count() == names.count() and made.filter("x = y").count() == 0


def iban_right(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_one_entity_in_two_formats_has_one_surrogate(spark):
    pairs = {"iban": ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), "phone": ("+49 30 1234 5678", "+49-30-1234-5678"), "mail": ("Ann.Lee@Mail.Example.com", "ann.lee@mail.example.com"), "card": ("4111 1111 1111 1111", "4111111111111111")}
    rows = [(i, f"see {a} or {b} now") for i, (a, b) in enumerate(pairs.values())] + [(9, "My name is Kwame Mensah. Ask Mensah.")]
    got = {r.doc_id: r for r in surrogates.report(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (kind, (a, b)) in enumerate(pairs.items()):
        x, y = re.fullmatch("see (.*) or (.*) now", got[i].text).groups()
        bare = lambda t: re.sub(r"[ -]", "", t).lower()
        assert bare(x) == bare(y) != bare(a) and [len(x), len(y)] == [len(a), len(b)], kind
        assert [c.isalnum() for c in x] == [c.isalnum() for c in a] and got[i].n_entities == 2 and got[i].n_distinct == got[i].n_surrogates == 1
        assert x.isupper() == a.isupper() and (kind != "iban" or iban_right(x) and x[:2] == "DE") and (kind != "phone" or x[:3] == "+49")
    first, last, again = re.fullmatch(r"My name is (\w+) (\w+)\. Ask (\w+)\.", got[9].text).groups()
    assert last == again and {first, last}.isdisjoint({"Kwame", "Mensah"})


@pytest.mark.parametrize("text", ["x@" + "a." * 500_000 + "com", "Mr. " + "Ab-" * 300_000, "7" * 1_000_000, "+1 " + "555 " * 250_000, "token = " + "k9" * 100_000, "AB12 " + "CD34 " * 20_000, "1." * 500_000, "a@" * 400_000])
def test_surrogates_of_very_long_entities(spark, text):
    begun = time.time()
    row = surrogates.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert len(row.text) == len(text) and time.time() - begun < 60
    if text.startswith("token"):
        assert row.n_entities == 1 and "k9" * 4 not in row.text


def test_surrogates_are_native_and_keep_columns(docs, empty):
    out = surrogates.anonymise(docs, "k")
    plan = out._jdf.queryExecution().toString()
    assert out.columns == docs.columns and out.count() == docs.count() and "Python" not in plan and "Arrow" not in plan
    assert surrogates.report(empty, "k").count() == 0


# ---------------------------------------------------------------- 9
def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "back\\slash \\<|im_start|>", "\n\n", "", "<", "|im_end|>", None]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(9) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]
    rows += [(50, 0, "assistant", "first"), (50, 0, "user", "tie"), (None, 1, None, "x"), (60, None, "user", "null turn"), (60, 3, "us\ner", "odd role")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_chats(data)
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    texts = collections.defaultdict(str)
    for r in segments.collect():
        texts[r.conv_id] += r.text
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, own in by.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(own, key=order)]
        assert chat.Template().parse(texts[conv]) == turns
        r = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(texts[conv]))
        assert r.valid == (conv is not None and conv < 9)
    assert chat.digests(chat.format_chats(data.limit(0))).count() == 0


def test_chat_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.OP9_SQL)
    names = [d[0] for d in want.description]
    got = queries.op9_chat_format(spark, sf).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


# ---------------------------------------------------------------- 10
def paeth_png(samples):
    """A PNG whose rows use each filter in turn, written the slow way."""
    h, w = samples.shape
    out = bytearray()
    for y in range(h):
        kind = y % 5
        out.append(kind)
        for x in range(w):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(samples[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return media.SIGNATURE + media._chunk(b"IHDR", media.struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", zlib.compress(bytes(out))) + media._chunk(b"IEND", b"")


def test_png_filters_and_checks():
    samples = np.random.default_rng(0).integers(0, 256, (23, 64), dtype=np.uint8)
    assert (media.read_png(media.write_png(samples)) == samples).all()
    good = paeth_png(samples)
    assert (media.read_png(good) == samples).all()
    for bad in (b"", good[:-5], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good[1:], good + b"x", good.replace(b"IDAT", b"IDAX")):
        with pytest.raises(media.BadPng):
            media.read_png(bad)


def test_media_round_trip(docs, empty):
    got = media.features(media.store(docs)).collect()
    texts = collections.defaultdict(list)
    for d, t, *_ in edge_rows():
        texts[d].append((t or "").encode())
    for r in got:
        raw = texts[r.doc_id][0]
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    assert len(got) == docs.count() and media.features(media.store(empty)).count() == 0
    same = {r.media_sha256 for r in got if r.doc_id in (6, 8)} | {r.feature for r in got if r.doc_id in (6, 8)}
    assert len(same) == 2


# ---------------------------------------------------------------- pipeline
def test_pipeline_against_its_stages_in_plain_python(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).filter("score >= 0.3").collect()}
    left = [r for r in rows if r[0] not in toxic]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in left)
    single = {d for d, _, c in brute_components(left) if d == c}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == single
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.replace_pii, corpus_pipeline.mix_sources):
        assert stage(spark, docs, sf).columns == docs.columns
