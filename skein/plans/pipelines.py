"""Composed jobs: what runs after a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import canonical_name
from skein.operators import edges as E
from skein.operators import inference as I
from skein.operators import intel as N
from skein.operators import planning as P
from skein.operators import resolve as R
from skein.sources.storage import cut


def post_crawl(entities: DataFrame, edges: DataFrame, intel: DataFrame) -> dict[str, DataFrame]:
    """Entities merged, edges remapped and deduplicated, findings consolidated, facts inferred, texts to embed.

    ``entities`` is (id, name, kind, data), ``edges`` (edge_id, source_id, target_id,
    relation_type), ``intel`` (entity_id, confidence, created, data).
    """
    group = canonical_name("name")
    ids = cut(R.id_map(entities, group, "id"), "post-ids")
    kept, moved = R.merge(entities, edges, ids, "id", mode="hard")
    kept, moved = cut(kept, "post-entities"), cut(moved, "post-edges")
    facts = I.infer(kept, moved)
    enriched = cut(I.apply_facts(kept, facts), "post-enriched")
    clean = N.quality_pass(intel.withColumn("kind", F.lit("unknown")), "data", "kind").withColumnRenamed("entity_id", "id")
    consolidated = N.consolidate(clean, "id", [-F.col("confidence"), -F.unix_timestamp("created")])
    texts = P.entity_views(enriched, "id", "name", "data")
    return {"ids": ids, "entities": enriched, "edges": moved, "degree": E.degree(moved, "source_id", "target_id"), "facts": facts, "intel": consolidated, "texts": texts}
