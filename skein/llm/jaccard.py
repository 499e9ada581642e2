"""Jaccard metric-space join on word shingles, exact, by pivots and regions.

The distance d = 1 - |x & y| / |x | y| is a metric, and two documents link when
d <= 0.2. Documents are compared with pivots only, and regions around pivots are
joined recursively:

* Level 0 has the single shingles as pivots. The nearest such pivot of a document
  is its rarest shingle in the corpus, and the triangle inequality's windows around
  it are prefixes of its rarest-first order: at home in the first n - ceil(8n/9) + 1
  shingles, a guest of the others up to n - ceil(0.8 n) + 1. Of a linked pair the
  smaller is at home in a region where the larger is at home or a guest. Windows
  over shingles that no other document has need no region at all, which settles
  nearly every document.
* Then documents are the pivots: the most central member of each region (the one
  whose shingles are most common), and several of a large one. Every member's
  distance to them is computed exactly; distances within 0.2 are links. A member of
  a large region is at home with its nearest pivot and a guest of each pivot that is
  at most 0.4 farther, so a linked pair meets where one of them is at home.
* Regions whose members are all connected already are finished; small ones are
  joined in one task, member by member; large ones recur with new pivots, as often as
  their windows make them smaller. Only a region that windows leave at three quarters
  of its size or more, whose members lie about as far from all pivots, is joined in
  squares of bounded size instead.

Documents with equal shingle sets are one representative from the start, and the
links found inside a region are a spanning forest, so a group of copies costs as
many rows as it has members. No group is ever gathered in one task, but for regions
below ``small``.

Defined cases: a text with fewer than five words is one shingle of all its words;
null, empty and blank texts have no shingles and are linked with nothing, not even
with each other; a null ``doc_id`` is linked like others and is never a component's
name unless all ids there are null; repeated rows are equal sets; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import SLOT, U, Words, cut, mix, shingle_set, text_column
from skein.llm.exchange import ask_all, asked, each_row, expand, gathered, key_bits, narrow, squeeze
from skein.operators.graph import connected_components

SETS = "doc_id long, text_key long, n_shingles long, sig binary, shared boolean, central double, members binary, window array<long>, inner array<boolean>"


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least size of an intersection with a set of ``n`` that may still link."""
    return (percent * n + 99) // 100


def _signature(members: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return b"".join(int(mix(members ^ SLOT[k]).sum(dtype=U)).to_bytes(8, "little") for k in (40, 41))


def _sets(group: pa.Table, words: int) -> tuple[list, list, list[np.ndarray]]:
    ids, keys, sets = [], [], []
    for batch in each_row(group):
        found = Words(batch.column("text"))
        ids += batch.column("doc_id").to_pylist()
        keys += batch.column("text_key").to_pylist()
        sets += [shingle_set(found.hash[found.ptr[i] : found.ptr[i + 1]], words) for i in range(batch.num_rows)]
    return ids, keys, sets


def shingle_sets(docs: DataFrame, words: int, percent: int, block_mb: float) -> DataFrame:
    """Each document's set size and signature, and for those that share a shingle in their window, set and window."""

    bits = key_bits(docs)

    def ask(group: pa.Table, blk: int, buckets: int) -> pa.Table:
        _, _, sets = _sets(group, words)
        keys, counts = np.unique(narrow(np.concatenate([*sets, np.zeros(0, U)]), bits), return_counts=True)
        return asked(keys, counts.astype(np.uint32), blk, buckets)

    def answer(group: pa.Table) -> pa.Table:
        blks, keys, distinct, place, marks = gathered(group, np.uint32)
        total = np.zeros(len(distinct), dtype=U)
        np.add.at(total, place, marks.astype(U))
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"blk": pa.array(blks, pa.int64()), "bucket": pa.array([bucket] * len(blks), pa.int64()), "total": pa.array([squeeze(total[place[at[i] : at[i + 1]]]) for i in range(len(blks))], pa.binary())})

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, text_keys, sets = _sets(left, words)
        keys = np.unique(narrow(np.concatenate([*sets, np.zeros(0, U)]), bits))
        order = np.argsort(right.column("bucket").to_numpy())
        seen = np.concatenate([*(expand(right.column("total")[int(i)].as_py(), U) for i in order), np.zeros(0, U)])
        assert len(seen) == len(keys), "answers do not match the questions"
        out = []
        for doc, text_key, own in zip(ids, text_keys, sets):
            n = len(own)
            often = seen[np.searchsorted(keys, narrow(own, bits))]
            first = np.lexsort((own, often))[: n - needed(n, percent) + 1] if n else np.zeros(0, np.int64)
            more = often[first] > 1
            window = own[first[more]]
            if not len(window):
                out.append((doc, text_key, n, _signature(own) if n else None, False, None, None, None, None))
                continue
            inner = np.arange(len(first))[more] < n - -(-2 * percent * n // (100 + percent)) + 1
            out.append((doc, text_key, n, _signature(own), True, float(np.log2(often.astype(float)).mean()), pack(own), window.view(np.int64).tolist(), inner.tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(("doc_id", "text_key", "n_shingles", "sig", "shared", "central", "members", "window", "inner"), kinds))})

    return ask_all(text_column(docs).withColumn("text_key", F.xxhash64("text")), block_mb, ask, answer, "blk long, bucket long, total binary", use, SETS)


# ---------------------------------------------------------------- distances
def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def links(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _distances(pairs: DataFrame, sets: DataFrame, most: int = 256) -> DataFrame:
    """``pairs`` (sig, pivot) with ``both``, ``n`` and ``m``: intersection and sizes.

    A pivot's pairs are dealt to groups of about ``most``; its own set comes first in
    each of them and the others are streamed past it, so that a pivot with very many
    members is no larger task than any other and no set is moved twice for a pair.
    """
    counts = cut(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("long").alias("salts")), "jaccard-pivots")
    dealt = pairs.join(counts, "pivot").select("sig", "pivot", F.pmod(F.xxhash64("sig"), F.col("salts")).alias("salt"), F.lit(1).alias("turn"))
    first = counts.select(F.col("pivot").alias("sig"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"))
    rows = dealt.unionByName(first).join(sets.select("sig", "members"), "sig")

    def run(batches):
        pivot, own = None, None
        for batch in batches:
            out = []
            for sig, p, turn, x in zip(*(batch.column(c) for c in ("sig", "pivot", "turn", "members"))):
                x = unpack(x.as_buffer())
                if turn.as_py() == 0:
                    pivot, own = p.as_py(), x
                    continue
                assert p.as_py() == pivot
                out.append((sig.as_py(), pivot, common(x, own), len(x), len(own)))
            kinds = (pa.int64(),) * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["sig", "pivot", "both", "n", "m"])

    streamed = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "turn")
    return streamed.mapInArrow(run, "sig long, pivot long, both long, n long, m long")


def pack(members: np.ndarray) -> bytes:
    """A sorted set, 64 bits a member."""
    return np.ascontiguousarray(members).tobytes()


def unpack(data) -> np.ndarray:
    return np.frombuffer(data, dtype=U)


def _by_region(group: pa.Table) -> list[np.ndarray]:
    """Rows of each region of a bucket, members in order."""
    region = group.column("region").to_numpy()
    order = np.lexsort((group.column("sig").to_numpy(), region))
    return np.split(order, np.flatnonzero(np.diff(region[order])) + 1)


def _open_pairs(component: np.ndarray, inner: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a region may still link two components: sizes, a smaller one at home, sides of a square."""
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    home = np.where(n[:, None] < n[None, :], inner[:, None], np.where(n[:, None] > n[None, :], inner[None, :], inner[:, None] | inner[None, :]))
    return (component[:, None] != component[None, :]) & (100 * small >= percent * large) & home & ((side[:, None] != side[None, :]) | (side[:, None] < 0))


def _columns(group: pa.Table, at: np.ndarray) -> tuple[np.ndarray, ...]:
    component = np.unique(group.column("component").to_numpy()[at], return_inverse=True)[1]
    return (component, *(group.column(c).to_numpy()[at] for c in ("inner", "n", "side")))


def _needed(percent: int):
    """What is left to do in each region, from sizes and components alone (no sets yet).

    A region with few open pairs for its members gives those pairs; of another the
    members that are in one come back, to be joined together.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sig = group.column("sig").to_numpy()
        whole, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in _by_region(group):
            pairs = np.triu(_open_pairs(*_columns(group, at), percent), 1)
            members = at[pairs.any(0) | pairs.any(1)]
            if pairs.sum() > 2 * len(members):
                whole.append(members)
            else:
                i, j = np.nonzero(pairs)
                left.append(at[i])
                right.append(at[j])
        a, b = np.concatenate(left), np.concatenate(right)
        out = group.take(pa.array(np.concatenate([*whole, a])))
        partner = np.concatenate([np.full(out.num_rows - len(a), -1), sig[b]])
        return out.append_column("partner", pa.array(partner, pa.int64()))

    return run


def _join_regions(percent: int):
    """Joins small regions: intersections by a product of matrices, links kept where they join components."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        edges: list[tuple[int, int]] = []
        for at in _by_region(group):
            component, inner, n, side = _columns(group, at)
            sets = [unpack(group.column("members")[int(i)].as_buffer()) for i in at]
            values, column = np.unique(np.concatenate(sets), return_inverse=True)
            shared = np.bincount(column) > 1
            rows = np.repeat(np.arange(len(sets)), n)[shared[column]]
            column = (np.cumsum(shared) - 1)[column[shared[column]]]
            both = np.zeros((len(sets), len(sets)), dtype=np.float32)
            width = 4096
            for start in range(0, int(shared.sum()), width):
                some = (column >= start) & (column < start + width)
                part = np.zeros((len(sets), min(width, int(shared.sum()) - start)), dtype=np.float32)
                part[rows[some], column[some] - start] = 1
                both += part @ part.T
            both = both.astype(np.int64)
            found = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & _open_pairs(component, inner, n, side, percent)
            top = list(range(int(component.max()) + 1))
            for i, j in zip(*np.nonzero(np.triu(found, 1))):
                a, b = component[i], component[j]
                while top[a] != a:
                    a = top[a]
                while top[b] != b:
                    b = top[b]
                if a != b:
                    top[a] = b
                    edges.append((group.column("sig")[int(at[i])].as_py(), group.column("sig")[int(at[j])].as_py()))
        return pa.table({"src": pa.array([a for a, _ in edges], pa.int64()), "dst": pa.array([b for _, b in edges], pa.int64())})

    return run


MEMBER = "region long, sig long, inner boolean, n long, component long, side int"


STUCK = 0.75  # a region with more of its parent's members than this is not parted again


def find_links(sets: DataFrame, percent: int, small: int, pivots: int) -> DataFrame:
    """Edges (src, dst) between sets whose components are those of the full link graph.

    ``sets`` has sig (here a number), n, central, members, window and inner, one row per set.
    """
    spark = sets.sparkSession
    reach = 1 - percent / 100
    at = sets.select(F.explode(F.arrays_zip("window", "inner")).alias("w"), "sig", "n", "central").select(F.col("w.window").alias("region"), "sig", F.col("w.inner").alias("inner"), "n", "central", F.lit(1 << 62).alias("parent"))
    members = sets.select("sig", "members")
    edges = spark.createDataFrame([], "src long, dst long")
    level = -1
    while True:
        level += 1
        many = pivots if level else 1
        key = F.xxhash64("sig", "inner")
        chosen = [F.max_by("sig", F.struct(F.col("central"), F.col("sig"))), *(F.min_by("sig", F.xxhash64("sig", F.lit(level * pivots + j))) for j in range(1, many))]
        held = at.groupBy("region").agg(F.count("*").alias("n_at"), F.max("inner").alias("home"), F.bit_xor(key).alias("same"), *(c.alias(f"p{j}") for j, c in enumerate(chosen)))
        # of regions with the same members one is enough; a region where none is at home joins nothing
        same = ["n_at", "same", *(f"p{j}" for j in range(many))]
        held = held.filter("n_at > 1 and home").groupBy(*same).agg(F.min("region").alias("region"))
        held = cut(held.select("region", "n_at", F.array_distinct(F.array(*(F.col(f"p{j}") for j in range(many)))).alias("pivots")), "jaccard-regions")
        at = cut(at.join(held, "region"), "jaccard-members")
        each = at.select("sig", "n_at", F.explode("pivots").alias("pivot")).filter("sig != pivot").groupBy("sig", "pivot").agg(F.count("*").alias("met"), F.max("n_at").alias("n_at"))
        ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("met"), "pivot")))
        # two pivots are enough to find most links early; large regions need every distance for their windows
        pairs = ranked.filter((F.col("place") <= 2) | (F.col("n_at") > small)).select("sig", "pivot")
        near = cut(_distances(pairs, sets), "jaccard-distances")
        linked = near.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n") + F.col("m") - F.col("both")))
        edges = cut(edges.unionByName(linked.select(F.col("sig").alias("src"), F.col("pivot").alias("dst"))), "jaccard-edges")
        labels = connected_components(edges).withColumnRenamed("node", "sig")
        # a region of one component is done with
        left = cut(at.join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig")), "jaccard-labelled")
        sized = left.groupBy("region").agg(F.count("*").alias("n_left"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("inner").alias("home")).filter("lo != hi and home").select("region", "n_left")
        left = cut(left.join(cut(sized, "jaccard-open"), "region"), "jaccard-open-members")
        stuck = F.lit(level > 0) & (F.col("n_left") > STUCK * F.col("parent"))  # level 0 knows its regions by shingles alone
        total = left.agg(F.count("*"), F.count_if((F.col("n_left") > small) & ~stuck), F.count_if((F.col("n_left") > small) & stuck)).first()
        if not total[0]:
            return edges
        big = left.filter((F.col("n_left") > small) & ~stuck)
        few = left.filter(F.col("n_left") <= small).select("region", "sig", "inner", "n", "component", F.lit(-1).alias("side"))
        if total[2]:  # what windows do not part: squares of bounded size
            few = few.unionByName(_squares(left.filter((F.col("n_left") > small) & stuck), small))
        bucket = F.pmod(F.xxhash64("region"), F.lit(max(64, -(-total[0] // 2048))))
        todo = cut(few.groupBy(bucket).applyInArrow(_needed(percent), MEMBER + ", partner long"), "jaccard-todo")
        found = todo.filter("partner < 0").drop("partner").join(members, "sig").groupBy(bucket).applyInArrow(_join_regions(percent), "src long, dst long")
        pairs = todo.filter("partner >= 0").select(F.greatest("sig", "partner").alias("sig"), F.least("sig", "partner").alias("pivot")).distinct()
        met = _distances(pairs, sets).filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n") + F.col("m") - F.col("both")))
        edges = cut(edges.unionByName(found).unionByName(met.select(F.col("sig").alias("src"), F.col("pivot").alias("dst"))), "jaccard-edges")
        if not total[1]:
            return edges
        far = near.select("sig", "pivot", (1 - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("d"))
        reached = big.select("region", "sig", "inner", "n", "central", F.col("n_left").alias("parent"), F.explode("pivots").alias("pivot")).join(far, ["sig", "pivot"])
        home = reached.groupBy("region", "sig").agg(F.min("d").alias("nearest"))
        at = cut(reached.join(home, ["region", "sig"]).filter(F.col("d") <= F.col("nearest") + 2 * reach + 1e-9).select(F.xxhash64("region", "pivot").alias("region"), "sig", "inner", "n", "central", "parent"), "jaccard-members")


def _squares(big: DataFrame, small: int) -> DataFrame:
    """Members of large regions in squares: each pair of chunks is a region of its own."""
    chunks = F.ceil(F.col("n_left") / (small // 2)).cast("long")
    mine = F.pmod(F.xxhash64("sig"), chunks)
    rows = big.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1)))
    return rows.select(F.xxhash64("region", low, high).alias("region"), "sig", "inner", "n", "component", side.cast("int").alias("side"))


def components(docs: DataFrame, words: int = 5, percent: int = 80, small: int = 512, pivots: int = 4, block_mb: float = 8.0) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``n_shingles`` and ``component_id`` of every document."""
    return _with_first(docs, words, percent, small, pivots, block_mb).drop("first")


def _with_first(docs: DataFrame, words: int = 5, percent: int = 80, small: int = 512, pivots: int = 4, block_mb: float = 8.0) -> DataFrame:
    """``components`` with the ``first`` row of each component: smallest id, null last, then ``text_key``."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    found = cut(shingle_sets(docs, words, percent, block_mb), "jaccard-sets", release=True)
    classes = found.filter("shared").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min(row).alias("first"), F.first("n_shingles").alias("n"), F.first("central").alias("central"), F.first("members").alias("members"), F.first("window").alias("window"), F.first("inner").alias("inner"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")  # written once, so the numbers stay
    sets = classes.select(F.col("node").alias("sig"), "n", F.round(F.col("central") * 100).cast("int").alias("central"), "members", "window", "inner")
    labels = connected_components(find_links(sets, percent, small, pivots))
    named = classes.select("sig", "rep", "first", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named, "jaccard-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    named = cut(named.drop("first").join(least, "component").select("sig", "component_id", "first"), "jaccard-names")
    alone = found.filter(~F.col("shared")).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), row.alias("first"))
    grouped = found.filter("shared").select("doc_id", "text_key", "n_shingles", "sig").join(named, "sig").select("doc_id", "text_key", "n_shingles", "component_id", "first")
    return alone.unionByName(grouped)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those linked, over any number of links, to a document with a smaller id.

    A null id counts as larger than all others; rows with one id go by a hash of their texts. Of rows that repeat an id and its text one stays. Rows without shingles all stay.
    """
    rows = cut(_with_first(docs, **options), "jaccard-components")
    gone = rows.filter(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("text_key") != F.col("first.text_key"))).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    # the documents' own columns stay inside ``row``, so that no name can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = keyed.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    kept = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    twice = rows.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1")
    if twice.limit(1).count():
        empty = text.rlike(r"^[\x20\x09-\x0D]*$")
        kept = kept.filter(~empty).dropDuplicates(["id", "key"]).unionByName(kept.filter(empty))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
