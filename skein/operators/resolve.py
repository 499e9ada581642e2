"""Entity resolution: grouping, choosing, merging and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.functions.text import expanded_name, is_truthy, jaccard, words


def duplicate_groups(entities: DataFrame, key: str, name: Column) -> DataFrame:
    """Normalised names that several entities carry."""
    return entities.select(key, name.alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.count("*").alias("members"), F.min(key).alias("first_id")).filter("members > 1")


def canonical_choice(entities: DataFrame, group: Column, key: str, rank: Column, richness: Column, name: str) -> DataFrame:
    """The member each group keeps: highest rank, most data, longest name, smallest id.

    A maximum over a struct: members combine before the shuffle, however large a group is.
    """
    best = F.max_by(F.struct(key, name), F.struct(rank, richness, F.length(name), -F.col(key)))
    return entities.groupBy(group.alias("grp")).agg(F.count("*").alias("members"), best.alias("b")).select("grp", "members", F.col(f"b.{key}").alias("canonical_id"), F.col(f"b.{name}").alias("canonical_name"))


def id_map(entities: DataFrame, group: Column, key: str) -> DataFrame:
    """Old id to kept id, for the members that are not kept."""
    least = entities.groupBy(group.alias("grp")).agg(F.min(key).alias("new_id"))
    return entities.select(F.col(key).alias("old_id"), group.alias("grp")).join(least, "grp").filter("old_id <> new_id").select("old_id", "new_id")


def remap(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with old ids replaced in the named columns."""
    for c in columns:
        rows = rows.join(ids.withColumnsRenamed({"old_id": c, "new_id": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rows


def merge_edges(edges: DataFrame, ids: DataFrame, src: str, dst: str, kind: str, key: str) -> DataFrame:
    """Edges after a merge: both ends remapped, no self-loops, the smallest id of equal edges."""
    moved = remap(edges, ids, src, dst).filter(F.col(src) != F.col(dst))
    return moved.groupBy(src, dst, kind).agg(F.min(key).alias(key))


def merge(entities: DataFrame, edges: DataFrame, ids: DataFrame, key: str, mode: str = "soft") -> tuple[DataFrame, DataFrame]:
    """Entities and edges after merging: soft keeps the merged ones with a duplicate_of edge, hard removes them."""
    moved = merge_edges(edges, ids, "source_id", "target_id", "relation_type", "edge_id")
    if mode == "hard":
        return entities.join(ids.select(F.col("old_id").alias(key)), key, "left_anti"), moved
    links = ids.select(F.col("old_id").alias("source_id"), F.col("new_id").alias("target_id"), F.lit("duplicate_of").alias("relation_type"), F.xxhash64("old_id", "new_id").cast(edges.schema["edge_id"].dataType).alias("edge_id"))
    marked = entities.join(ids.withColumnsRenamed({"old_id": key, "new_id": "merged_into"}), key, "left")
    return marked, moved.unionByName(links)


def cross_kind(entities: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """Entities of one exact name under several kinds: the kind of highest priority and what merges into it."""
    rows = entities.select(key, F.trim(F.lower(name)).alias("norm"), K.normalized_kind(F.col(kind)).alias("k"))
    best = rows.groupBy("norm").agg(F.max_by(F.struct(key, "k"), F.struct(K.priority(F.col("k")), -F.col(key))).alias("b"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(best, "norm").filter(F.col(key) != F.col(f"b.{key}"))
    generic = F.col("k").isin(*K.GENERIC) | F.col("b.k").isin(*K.GENERIC)
    same = (F.col("k") == F.col("b.k")) | K.more_specific(F.col("b.k"), F.col("k"))
    return joined.filter(generic | same).select("norm", F.col(key).alias("old_id"), F.col(f"b.{key}").alias("new_id"), F.col("b.k").alias("kind"))


def save_entities(incoming: DataFrame, order: str) -> DataFrame:
    """A batch of entities folded by lower-cased name: first truthy value per data key, best kind, last seen.

    ``incoming`` is (name, kind, data map, ``order``). Everything is an associative
    aggregate, so a name that fills a third of the batch is combined before the shuffle.
    """
    rows = incoming.withColumn("norm", F.trim(F.lower("name"))).withColumn("k", K.normalized_kind(F.col("kind")))
    head = rows.groupBy("norm").agg(F.min_by("name", order).alias("name"), F.max_by("k", F.struct(K.priority(F.col("k")), -F.col(order))).alias("kind"), F.count("*").alias("seen"), F.max(order).alias("last_seen"))
    values = rows.select("norm", order, F.explode("data").alias("field", "value")).filter(is_truthy("value"))
    first = values.groupBy("norm", "field").agg(F.min_by("value", order).alias("value"))
    data = first.groupBy("norm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("data"))  # one entry per distinct field
    return head.join(data, "norm", "left")


def sharing_words(a: DataFrame, b: DataFrame, id_a: str, id_b: str, words_a: str, words_b: str, least: float) -> DataFrame:
    """Pairs (id_a, id_b) that could share ``least`` of their words: they meet at one of their rarest.

    Of n words, shared at least ``least`` of all, one is among the n - ceil(least * n) + 1
    that fewest of ``b`` have. So a word that most names have brings nothing together
    unless a name has no rarer one, and no pair of enough overlap is lost.
    """
    df = b.select(F.explode(words_b).alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, key: str, words: str) -> DataFrame:
        one = rows.select(key, F.explode(words).alias("w")).join(df, "w", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("ws"))
        n = F.size("ws")
        return one.select(key, F.explode(F.slice("ws", F.lit(1), (n - F.ceil(F.round(n * least, 9)) + 1).cast("int"))).alias("x")).select(key, F.col("x.w").alias("w"))

    return rare(a, id_a, words_a).join(rare(b, id_b, words_b), "w").select(id_a, id_b).distinct()


def find_existing(names: DataFrame, entities: DataFrame, query: str, key: str, name: str, least: float = 0.9) -> DataFrame:
    """For each queried name: an exact match, else the best word overlap of ``least`` or more; ties go to the smaller key."""
    known = entities.groupBy(F.trim(F.lower(name)).alias("_n")).agg(F.min(key).alias(key))  # a name that many have is one row
    exact = names.join(known, F.trim(F.lower(query)) == F.col("_n")).select(query, key, F.lit(1.0).alias("similarity"))
    rest = names.join(exact.select(query), query, "left_anti").withColumn("_qw", words(query))
    known = known.withColumn("_nw", words("_n"))
    near = sharing_words(rest, known, query, "_n", "_qw", "_nw", least).join(rest, query).join(known, "_n")
    near = near.withColumn("similarity", F.round(jaccard(F.col("_qw"), F.col("_nw")), 6)).filter(F.col("similarity") >= least)
    best = near.groupBy(query).agg(F.max_by(F.struct(key, "similarity"), F.struct("similarity", -F.col(key))).alias("b")).select(query, f"b.{key}", "b.similarity")
    return exact.unionByName(best)


def semantic_duplicates(names: DataFrame, entities: DataFrame, query: str, kind: str, key: str, name: str, entity_kind: str, least: float = 0.85, most: int = 10) -> DataFrame:
    """For each queried name and kind the ``most`` entities of a compatible kind most alike: equal names first, then by word overlap with abbreviations written out.

    Kinds fit where they are equal, one is the other's parent, or either is generic.
    """
    asked = names.select(query, F.trim(F.lower(query)).alias("_q"), K.normalized_kind(F.col(kind)).alias("_qk")).withColumn("_qw", words(expanded_name("_q")))
    known = entities.groupBy(F.trim(F.lower(name)).alias("_n"), K.normalized_kind(F.col(entity_kind)).alias("_nk")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, most).alias("_keys"))
    forms = known.select("_n").distinct().withColumn("_nw", words(expanded_name("_n")))
    near = sharing_words(asked.select("_q", "_qw").distinct(), forms, "_q", "_n", "_qw", "_nw", least)
    rows = near.join(asked, "_q").join(forms, "_n").join(known, "_n")
    fits = (F.col("_qk") == F.col("_nk")) | F.col("_qk").isin(*K.GENERIC) | F.col("_nk").isin(*K.GENERIC) | K.more_specific(F.col("_qk"), F.col("_nk")) | K.more_specific(F.col("_nk"), F.col("_qk"))
    same = F.col("_q") == F.col("_n")
    rows = rows.withColumn("similarity", F.when(same, 1.0).otherwise(F.round(jaccard(F.col("_qw"), F.col("_nw")), 6))).filter(fits & (F.col("similarity") >= least))
    rows = rows.select(query, "_qk", "similarity", F.when(same, "exact").otherwise("semantic").alias("match_type"), F.explode("_keys").alias(key))
    w = Window.partitionBy(query, "_qk").orderBy(F.desc("similarity"), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r").withColumnRenamed("_qk", "kind")


def resolve_aliases(rows: DataFrame, entities: DataFrame, key: str, aliases: str, entity: str, name: str) -> DataFrame:
    """The entity of the first alias that matches a name exactly."""
    exploded = rows.select(key, F.posexplode(aliases).alias("pos", "alias"))
    hit = exploded.join(entities.select(F.col(entity).alias("entity_id"), F.trim(F.lower(name)).alias("_n")), F.trim(F.lower("alias")) == F.col("_n"))
    return hit.groupBy(key).agg(F.min_by("entity_id", F.struct("pos", "entity_id")).alias("entity_id"))


def merge_first(rows: DataFrame, key: str, data: str, order: list[Column]) -> DataFrame:
    """Per key and field the first truthy value by ``order``: what gap filling leaves."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    values = rows.select(key, rank.alias("_o"), F.explode(data).alias("field", "value")).filter(is_truthy("value"))
    return values.groupBy(key, "field").agg(F.min_by("value", "_o").alias("value"))


def field_values(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Field values with the one that is current: the last by ``order``."""
    last = values.groupBy(*keys).agg(F.max(order).alias("_last"))
    return values.join(last, keys).withColumn("is_current", F.col(order) == F.col("_last")).drop("_last")


def compare_names(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def dedup_scan(entities: DataFrame, key: str, name: str, kind: str, created: str, richness: Column, least: float = 0.9, dry_run: bool = True) -> DataFrame:
    """Groups of entities of one kind whose names are alike, in order of creation, and who stands for each.

    Names are alike by the overlap of their words with abbreviations written out. The
    first name of a group takes all later ones alike to it that none took before. For
    the group stands the entity of the highest kind, the richest data, the longest
    name, the smallest id, in this order. Entities of one name are one row until the end.
    """
    from skein.operators.graph import connected_components
    from skein.sources.storage import cut

    rows = entities.select(F.col(key).alias("id"), F.col(name).alias("name"), K.normalized_kind(F.col(kind)).alias("kind"), F.col(created).alias("at"), richness.alias("rich"))
    rows = rows.withColumn("form", F.array_join(F.array_sort(words(expanded_name("name"))), " "))  # equal sets of words are alike wholly
    forms = rows.groupBy("kind", "form").agg(F.min(F.struct("at", "id")).alias("born")).withColumn("f", F.concat_ws("\n", "kind", "form"))
    forms = cut(forms.withColumn("w", F.filter(F.split("form", " "), lambda w: w != "")).withColumn("w", F.transform("w", lambda x: F.concat_ws("\n", "kind", x))), "dedup-forms")
    other = forms.select(F.col("f").alias("f2"), F.col("born").alias("born2"), F.col("w").alias("w2"))
    met = sharing_words(forms.select("f", "w"), other.select("f2", "w2"), "f", "f2", "w", "w2", least).filter("f <> f2")
    pairs = met.join(forms.select("f", "born", "w"), "f").join(other, "f2").filter(F.col("born") < F.col("born2"))
    pairs = cut(pairs.withColumn("similarity", F.round(jaccard(F.col("w"), F.col("w2")), 6)).filter(F.col("similarity") >= least).select("f", "born", "f2", "born2", "similarity"), "dedup-pairs")
    block = connected_components(pairs, "f", "f2").select(F.col("node").alias("f"), F.col("component").alias("block"))
    flat = pairs.join(block, "f").select("block", "f", "f2", "similarity", F.col("born.at").alias("at"), F.col("born.id").alias("id"), F.col("born2.at").alias("at2"), F.col("born2.id").alias("id2"))

    def walk(group):
        import pandas as pd

        taken, heads, out = set(), set(), []
        for r in group.sort_values(["at", "id", "at2", "id2"]).itertuples():
            if r.f in taken or r.f2 in taken or r.f2 in heads:
                continue
            heads.add(r.f)
            taken.add(r.f2)
            out.append((r.f, r.f2, r.similarity))
        return pd.DataFrame(out, columns=["head", "f", "similarity"])

    taken = flat.groupBy("block").applyInPandas(walk, "head string, f string, similarity double")
    grouped = forms.select("kind", "form", "f").join(taken, "f", "left").select("kind", "form", F.coalesce("head", "f").alias("head"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    rows = rows.join(grouped, ["kind", "form"])
    best = rows.groupBy("head").agg(F.min_by("id", F.struct(-K.priority(F.col("kind")), -F.col("rich"), -F.length("name"), F.col("id"))).alias("canonical_id"))
    found = rows.join(best, "head").filter("id <> canonical_id").select("canonical_id", F.col("id").alias("duplicate_id"), "similarity")
    return found if dry_run else found.select(F.col("duplicate_id").alias("old_id"), F.col("canonical_id").alias("new_id"))


def containing_names(names: DataFrame, entities: DataFrame, query: str, key: str, name: str) -> DataFrame:
    """Entities whose name contains a queried one, or lies inside it: similarity 1 or .85."""
    from skein.functions.text import name_similarity

    q = names.select(query, F.explode(words(query)).alias("w"))
    known = entities.select(name).distinct()  # a name that many have is compared once
    e = known.select(name, F.explode(words(name)).alias("w"))
    x, y = F.trim(F.lower(query)), F.trim(F.lower(name))
    near = q.join(e, "w").select(query, name).distinct().filter(x.contains(y) | y.contains(x)).withColumn("similarity", name_similarity(query, name))
    return near.join(entities.select(key, name), name).select(query, key, name, "similarity")
