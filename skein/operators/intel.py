"""Findings: nested documents of ten sections, made rows, cleaned, merged and formatted."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skein.functions import kinds as K
from skein.functions.text import col, is_truthy

#: The sections of a finding, and for each list the field that names an item and the kind it makes (fixed values).
SECTIONS = ("basic_info", "persons", "jobs", "metrics", "locations", "financials", "products", "events", "relationships", "organizations")
ENTITY_SECTIONS = {"persons": ("name", "person"), "organizations": ("name", "org"), "products": ("name", "product"), "locations": ("address", "location"), "events": ("title", "event"), "jobs": ("title", "job")}
_STRINGS = lambda fields: ", ".join(f"{f}: string" for f in fields.split())
FINDING = (
    f"basic_info struct<{_STRINGS('official_name ticker industry description founded website entity_type parent_type')}>, "
    f"persons array<struct<{_STRINGS('name title role bio organization email phone')}>>, jobs array<struct<{_STRINGS('title location description')}>>, "
    f"metrics array<struct<{_STRINGS('type value unit date entity')}>>, locations array<struct<{_STRINGS('address street city state postal_code country type')}>>, "
    f"financials array<struct<{_STRINGS('year revenue currency profit entity')}>>, products array<struct<{_STRINGS('name description status manufacturer price')}>>, "
    f"events array<struct<{_STRINGS('title date description')}>>, organizations array<struct<{_STRINGS('name type industry')}>>, "
    f"relationships array<struct<{_STRINGS('source target relation_type description source_type target_type')}>>"
)
#: What models write for nothing (fixed values).
FILLERS = ("not mentioned", "not mentioned in the text", "not available", "not specified", "not provided", "not disclosed", "not found", "not applicable", "not known", "no information", "no data", "no data available", "none", "n/a", "na", "unknown", "unspecified", "undisclosed", "null", "-", "--", "---", "not mentioned in text", "not given", "not stated", "not listed", "information not available", "data not available")


def parse(text: str | Column) -> Column:
    """A finding from JSON text; broken text gives a finding of nulls."""
    return F.from_json(col(text), FINDING, {"mode": "PERMISSIVE"})


def section_rows(findings: DataFrame, key: str, finding: str) -> DataFrame:
    """Every item of every list section as (key, section, pos, item map): one pass, no cross product."""

    def rows(section: str) -> Column:
        one = lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), F.from_json(F.to_json(x), "map<string,string>").alias("item"))
        return F.coalesce(F.transform(F.col(f"{finding}.{section}"), one), F.array().cast("array<struct<section:string,pos:int,item:map<string,string>>>"))

    parts = [rows(s) for s in SECTIONS[1:]]
    return findings.select(key, F.explode(F.concat(*parts)).alias("x")).select(key, "x.*")


def is_filler(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.lower(col(c))).isin("", *FILLERS), F.lit(True))


def without_fillers(item: str | Column) -> Column:
    """A map without empty and filler values."""
    return F.map_filter(col(item), lambda k, v: ~is_filler(v))


def entities_of(rows: DataFrame, key: str) -> DataFrame:
    """Named entities of section rows with kind and remaining attributes."""
    name = F.coalesce(*(F.when(F.col("section") == s, F.try_element_at("item", F.lit(f))) for s, (f, _) in ENTITY_SECTIONS.items()), F.try_element_at("item", F.lit("name")))
    kind = reduce(lambda acc, s: acc.when(F.col("section") == s, ENTITY_SECTIONS[s][1]), ENTITY_SECTIONS, F.when(F.lit(False), ""))
    role = F.concat_ws(" ", F.try_element_at("item", F.lit("title")), F.try_element_at("item", F.lit("role")))
    exact = F.when(kind == "person", K.person_kind(role)).when(kind == "location", K.location_kind(F.try_element_at("item", F.lit("type")), F.col("name"))).otherwise(kind)
    rows = rows.filter(F.col("section").isin(*ENTITY_SECTIONS)).withColumn("name", F.trim(name)).withColumn("kind", exact)
    return rows.filter(~is_filler("name")).select(key, "section", "pos", "name", "kind", without_fillers("item").alias("data"))


def sub_entities(entities: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities looked up by name or made, and the edges from their owner."""
    found = entities.join(known.select(F.col("id").alias("_id"), F.trim(F.lower("name")).alias("_n")), F.trim(F.lower("name")) == F.col("_n"), "left")
    rows = found.withColumn("entity_id", F.coalesce("_id", F.sha1(F.concat_ws("|", F.lower("name"), "kind")))).withColumn("is_new", F.col("_id").isNull()).drop("_id", "_n")
    kind = F.when(F.col("section") == "persons", "has_person").when(F.col("section") == "locations", "has_location").when(F.col("section") == "products", "has_product").otherwise("related_to")
    return rows, rows.select(F.col(key).alias("source_id"), F.col("entity_id").alias("target_id"), kind.alias("relation_type")).distinct()


def consolidate(rows: DataFrame, key: str, best: list[Column]) -> DataFrame:
    """Per entity and field the first truthy value, best findings first."""
    from skein.operators.resolve import merge_first

    return merge_first(rows, key, "data", best)


def merge_lists(a: str | Column, b: str | Column) -> Column:
    """Both lists, each item once."""
    none = F.array()
    return F.array_distinct(F.concat(F.coalesce(col(a), none), F.coalesce(col(b), none)))


def first_by(items: str | Column, key) -> Column:
    """The first item of each key: later ones with a key seen before are dropped."""
    rows = col(items)
    keys = F.transform(rows, key)
    return F.filter(rows, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def formatted(sections: dict[str, Column]) -> Column:
    """``section: json`` of each filled section, joined by bars."""
    return F.concat_ws(" | ", *(F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), F.to_json(c))) for n, c in sections.items()))


def verification_parts(key: str, sections: dict[str, Column], most: int = 6000) -> Column:
    """One text, or one per section where the whole is longer than ``most``."""
    whole = formatted(sections)
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), F.to_json(c))) for n, c in sections.items())))
    return F.when(F.length(whole) > most, each).otherwise(F.array(whole))


def rule_based(text: str | Column) -> Column:
    """Revenue and head count by their usual phrases, or null."""
    revenue = F.regexp_extract(col(text), r"(?i)revenue\s+(?:us\$\s*)?([\d.]+)\s*billion", 1)
    people = F.regexp_replace(F.regexp_extract(col(text), r"(?i)(\d[\d,]+)\s+employees", 1), ",", "")
    return F.struct(F.nullif(revenue, F.lit("")).cast("double").alias("revenue_billions"), F.nullif(people, F.lit("")).cast("long").alias("employees"))


def corrected(df: DataFrame, issue: str = "fixes", data: str = "data") -> DataFrame:
    """A map column with suggested fixes put in their fields."""
    return df.withColumn(data, F.map_concat(F.map_filter(data, lambda k, v: ~F.array_contains(F.map_keys(issue), k)), F.col(issue)))


def consistent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether two sources agree on the founding year and the name of each entity."""
    from skein.functions.text import canonical_name, year

    j = a.select(key, F.col("founded").alias("fa"), F.col("name").alias("na")).join(b.select(key, F.col("founded").alias("fb"), F.col("name").alias("nb")), key)
    same_year = F.coalesce(F.abs(year("fa") - year("fb")) <= 1, F.lit(True))
    x, y = canonical_name("na"), canonical_name("nb")
    return j.select(key, same_year.alias("year_ok"), (x.contains(y) | y.contains(x)).alias("name_ok"))


# ---------------------------------------------------------------- JSON of unknown shape
HARVEST = "array<struct<path:string,value:string,kind:string>>"


def _walk(value, path: str, out: list) -> None:
    if isinstance(value, str):
        if value.strip():
            out.append((path, value.strip(), ""))
    elif isinstance(value, dict):
        name = value.get("name") or value.get("entity") or value.get("value")
        if isinstance(name, str) and name.strip():
            out.append((path, name.strip(), str(value.get("kind") or value.get("type") or "")))
        for k, v in value.items():
            if not (v is name and k in ("name", "entity", "value")) and k not in ("kind", "type"):
                _walk(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _walk(v, f"{path}[{i}]", out)


def _load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _harvest(s: pd.Series) -> pd.Series:
    def one(text):
        out: list = []
        _walk(_load(text), "$", out)
        return [dict(zip(("path", "value", "kind"), x)) for x in out]

    return s.map(one)


def harvest_entities(text: str | Column) -> Column:
    """Every string and every named object of a JSON text with its path (a recursion that Variant functions lack)."""
    return pandas_udf(_harvest, HARVEST)(col(text))


RELATIONS = "array<struct<source:string,target:string,relation_type:string>>"


def _relations(value, out: list) -> None:
    if isinstance(value, dict):
        if isinstance(value.get("source"), str) and isinstance(value.get("target"), str):
            out.append({"source": value["source"], "target": value["target"], "relation_type": str(value.get("relation_type") or value.get("type") or "related_to")})
        for v in value.values():
            _relations(v, out)
    elif isinstance(value, list):
        for v in value:
            _relations(v, out)


def _harvest_relations(s: pd.Series) -> pd.Series:
    def one(text):
        out: list = []
        _relations(_load(text), out)
        return out

    return s.map(one)


def harvest_relations(text: str | Column) -> Column:
    return pandas_udf(_harvest_relations, RELATIONS)(col(text))


IMAGE_KEYS = ("image", "images", "og:image", "twitter:image", "thumbnail", "logo", "photo")


def _harvest_images(s: pd.Series) -> pd.Series:
    def urls(v):
        if isinstance(v, str):
            return [v] if v.strip() else []
        if isinstance(v, dict):
            return urls(v.get("url") or v.get("src"))
        return [u for x in v for u in urls(x)] if isinstance(v, list) else []

    def one(text):
        meta = _load(text)
        return list(dict.fromkeys(u for k in IMAGE_KEYS for u in urls(meta.get(k)))) if isinstance(meta, dict) else []

    return s.map(one)


def harvest_images(text: str | Column) -> Column:
    return pandas_udf(_harvest_images, "array<string>")(col(text))


def discovered_fields(text: str | Column) -> Column:
    """Field proposals of a model: snake-case names, known importance, and a fallback of five fields."""
    parsed = F.from_json(col(text), "array<struct<field_name:string,description:string,importance:string>>", {"mode": "PERMISSIVE"})
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    rank = lambda x: F.when(F.lower(x).isin("critical", "important", "supplementary"), F.lower(x)).otherwise("supplementary")
    named = F.filter(F.transform(parsed, lambda x: F.struct(clean(x["field_name"]).alias("field_name"), rank(x["importance"]).alias("importance"))), lambda x: x["field_name"] != "")
    fallback = F.array(*(F.struct(F.lit(n).alias("field_name"), F.lit(i).alias("importance")) for n, i in (("name", "critical"), ("description", "important"), ("type", "important"), ("location", "supplementary"), ("website", "supplementary"))))
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(fallback)


def quality_pass(rows: DataFrame, data: str, kind: str) -> DataFrame:
    """Findings without empty data, their kinds normalised."""
    kept = rows.withColumn(data, F.map_filter(data, lambda k, v: is_truthy(v)))
    return kept.filter(F.size(data) > 0).withColumn(kind, K.normalized_kind(F.col(kind)))
