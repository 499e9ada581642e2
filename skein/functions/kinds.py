"""Entity kinds and relation types: a small dimension table, its closure, and rules over it."""

from __future__ import annotations

import colorsys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, priority, parent, aliases (fixed values).
KINDS = (
    ("entity", 10, None, ()), ("unknown", 5, None, ()), ("person", 50, None, ()), ("org", 50, None, ("organization", "organisation")), ("company", 55, "org", ()),
    ("location", 50, None, ("place", "address")), ("product", 50, None, ()), ("event", 50, None, ()), ("technology", 50, None, ("tech", "software")), ("document", 40, None, ("doc", "file")),
    ("concept", 30, None, ("idea", "topic")), ("infrastructure", 45, None, ("infra",)), ("project", 45, None, ()), ("ceo", 70, "person", ()), ("founder", 70, "person", ("co-founder",)),
    ("executive", 65, "person", ()), ("board_member", 65, "person", ()), ("employee", 55, "person", ()), ("headquarters", 60, "location", ("hq",)), ("office", 55, "location", ()),
    ("branch_office", 55, "location", ()), ("registered_address", 55, "location", ()), ("mailing_address", 55, "location", ()), ("billing_address", 55, "location", ()), ("shipping_address", 55, "location", ()),
    ("subsidiary", 60, "company", ()), ("parent_company", 60, "company", ()), ("division", 55, "org", ()), ("department", 55, "org", ()), ("page", 20, None, ()),
    ("intel", 25, None, ()), ("image", 20, None, ()), ("media", 20, None, ()), ("seed", 15, None, ()), ("semantic-snippet", 20, None, ()),
)
UNKNOWN_PRIORITY = 40
GENERIC = ("entity", "unknown", "general", "")
#: Expected fields by entity type and priority (fixed values).
EXPECTED = {
    "company": {"critical": ("official_name", "industry", "website"), "important": ("ticker", "founded", "description", "headquarters"), "supplementary": ("revenue", "employees", "ceo", "products")},
    "person": {"critical": ("full_name",), "important": ("title", "organization", "location"), "supplementary": ("bio", "education", "email", "social_media")},
    "product": {"critical": ("name", "manufacturer"), "important": ("description", "category", "launch_date"), "supplementary": ("price", "specifications", "reviews")},
    "organization": {"critical": ("name", "type"), "important": ("description", "location", "founded"), "supplementary": ("mission", "leadership", "size")},
    "location": {"critical": ("name", "country"), "important": ("coordinates", "type"), "supplementary": ("population", "area", "timezone")},
    "topic": {"critical": ("name", "description"), "important": ("category", "keywords"), "supplementary": ("related_topics", "references")},
    "news": {"critical": ("title", "date"), "important": ("source", "summary"), "supplementary": ("authors", "categories", "entities_mentioned")},
}
#: Categories of fields by substrings, in order (fixed values).
CATEGORIES = {"identity": ("name", "official_name", "full_name"), "business": ("industry", "ticker", "revenue", "employees"), "location": ("headquarters", "location", "address", "country"), "temporal": ("founded", "launch_date", "established"), "contact": ("website", "email", "phone", "social_media"), "descriptive": ("description", "bio", "mission"), "hierarchical": ("ceo", "leadership", "organization", "manufacturer")}
#: How easily a field is found, by substrings, in order (fixed values).
FINDABLE = ((0.9, ("website", "official_name", "industry", "description", "location")), (0.6, ("ticker", "founded", "ceo", "headquarters", "title")), (0.3, ("revenue", "employees", "email", "phone")))
#: Entity types by substrings of a kind, in order (fixed values).
TYPES = (("company", ("company", "corporation", "business")), ("person", ("person", "individual", "people")), ("product", ("product", "service")), ("organization", ("organization", "org", "ngo")), ("location", ("location", "place", "city", "country")), ("news", ("news", "event", "article")), ("topic", ("topic", "subject", "theme")))
NAME_SUFFIXES = ("inc", "corp", "ltd", "llc", "gmbh", "ag", "sa", "plc")


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def kind_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p, parent, list(a)) for k, p, parent, a in KINDS], "kind string, priority int, parent string, aliases array<string>")


def rank_table(spark: SparkSession) -> DataFrame:
    """Kind and rank: 0 generic, 2 with a parent and no children, else 1."""
    parents = {p for _, _, p, _ in KINDS if p}
    return spark.createDataFrame([(k, 0 if k in GENERIC else 2 if p and k not in parents else 1) for k, _, p, _ in KINDS], "kind string, rank int")


def closure_table(spark: SparkSession) -> DataFrame:
    """(kind, ancestor), each kind its own ancestor too."""
    parent = {k: p for k, _, p, _ in KINDS}
    rows = []
    for k in parent:
        at = k
        while at:
            rows.append((k, at))
            at = parent[at]
    return spark.createDataFrame(rows, "kind string, ancestor string")


def normalized_kind(kind: Column) -> Column:
    """Alias to canonical kind; unknown kinds stay as they are, lower-cased; null is unknown."""
    k = F.trim(F.lower(F.coalesce(kind, F.lit("unknown"))))
    out = F.when(k == "", "unknown")
    for name, _, _, aliases in KINDS:
        if aliases:
            out = out.when(k.isin(*aliases), name)
    return out.otherwise(k)


def priority(kind: Column) -> Column:
    pairs = [x for k, p, _, _ in KINDS for x in (F.lit(k), F.lit(p))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(UNKNOWN_PRIORITY))


def more_specific(new: Column, old: Column) -> Column:
    """Whether ``new`` may replace ``old``: the old one is generic, or the new one's ancestor."""
    pairs = [x for k, _, p, _ in KINDS if p for x in (F.lit(k), F.lit(p))]
    up = lambda c: F.element_at(F.create_map(*pairs), c)
    child = F.coalesce((up(new) == old) | (up(up(new)) == old), F.lit(False))
    return (new != old) & (~new.isin(*GENERIC)) & (old.isin(*GENERIC) | child)


def entity_type(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    out = F.when(k == "", "entity")
    for name, parts in TYPES:
        out = out.when(_any(k, parts), name)
    return out.otherwise("entity")


def type_of_name(name: Column) -> Column:
    """Company by suffix anywhere in the name, person by capitalised words, else entity."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    capital = F.forall(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    return F.when(_any(F.lower(name), NAME_SUFFIXES), "company").when((F.size(words) >= 2) & capital, "person").otherwise("entity")


def field_category(field: Column) -> Column:
    out = None
    for name, parts in CATEGORIES.items():
        hit = _any(F.lower(field), parts)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def findability(field: Column) -> Column:
    out = None
    for value, parts in FINDABLE:
        hit = _any(F.lower(field), parts)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(0.5)


def expected_fields(spark: SparkSession) -> DataFrame:
    rows = [(t, p, f) for t, by in EXPECTED.items() for p, fields in by.items() for f in fields]
    return spark.createDataFrame(rows, "entity_type string, priority string, field string")


#: Specialised kinds by substrings of name or context, in order, for each parent kind (fixed values).
SPECIAL = {
    "location": (("headquarters", ("headquarter", "hq", "head office", "main office", "corporate office")), ("branch_office", ("branch", "regional office", "local office")), ("registered_address", ("registered", "legal address"))),
    "person": (("ceo", ("ceo", "chief executive")), ("founder", ("founder", "co-founder", "founded by")), ("executive", ("cfo", "cto", "coo", "president", "vice president", "vp", "director")), ("board_member", ("board member", "board of directors", "chairman"))),
    "company": (("subsidiary", ("subsidiary", "acquired", "owned by")), ("division", ("division", "unit", "segment")), ("department", ("department", "dept"))),
}


def special_kind(parent: str, name: Column, context: Column | None = None) -> Column:
    """A more special kind of ``parent`` that name or context speaks of, else null."""
    t = F.lower(F.concat_ws(" | ", name, *([context] if context is not None else [])))
    out = F.when(F.lit(False), "")
    for kind, parts in SPECIAL[parent]:
        out = out.when(_any(t, parts), kind)
    return out


#: A person's kind by substrings of title and role, in order (fixed values).
PERSON = (("ceo", ("ceo", "chief executive officer")), ("founder", ("founder", "co-founder")), ("executive", ("cfo", "chief financial", "cto", "chief technology", "chief technical", "coo", "chief operating", "president", "vp", "vice president", "director")), ("board_member", ("board", "chairman", "chairwoman", "chair")))
#: A location's kind by substrings: of type, label and context; of type and label; of type only (fixed values).
PLACE = (("headquarters", 3, ("headquarter", "hq", "head office", "main office", "corporate office", "global office")), ("branch_office", 2, ("branch", "regional office")), ("registered_address", 1, ("registered", "legal", "statutory")), ("office", 2, ("office", "facility")))


def person_kind(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda acc, x: acc.when(_any(t, x[1]), x[0]), PERSON, F.when(F.lit(False), "")).otherwise("person")


def location_kind(kind: Column, label: Column | None = None, context: Column | None = None) -> Column:
    none = F.lit("")
    places = [F.lower(F.coalesce(c, none)) if c is not None else none for c in (kind, label, context)]
    out = F.when(F.lit(False), "")
    for name, reach, parts in PLACE:
        out = out.when(reduce(lambda a, b: a | b, [_any(c, parts) for c in places[:reach]]), name)
    return out.otherwise("location")


def child_color(parent: str, index: int) -> str:
    """A colour for the ``index``-th child of a kind: hue and lightness moved a little each time."""
    r, g, b = (int(parent[i : i + 2], 16) / 255 for i in (1, 3, 5))
    h, light, s = colorsys.rgb_to_hls(r, g, b)
    r, g, b = colorsys.hls_to_rgb((h + 0.04 * (index + 1)) % 1, min(0.9, light + 0.06), s)
    return "#" + "".join(f"{round(x * 255):02x}" for x in (r, g, b))


#: The parent that a new kind's own name suggests, in order (fixed values).
PARENT_WORDS = (("person", ("person", "people", "employee", "staff")), ("org", ("company", "corp", "inc", "ltd", "org")), ("location", ("location", "place", "address", "city")), ("product", ("product", "service", "tool")), ("event", ("event", "conference", "meeting")))


def resolved_kind(raw: Column, hint: Column) -> tuple[Column, Column]:
    """A kind that a model names, and its parent: the registry's, else the hint, else what the name suggests."""
    kind = F.trim(F.lower(F.coalesce(raw, F.lit(""))))
    known = normalized_kind(kind)
    names = [k for k, _, _, _ in KINDS]
    pairs = [x for k, _, p, _ in KINDS if p for x in (F.lit(k), F.lit(p))]
    told = F.nullif(F.trim(F.lower(hint)), F.lit(""))
    guess = reduce(lambda acc, x: acc.when(_any(kind, x[1]), x[0]), PARENT_WORDS, F.when(F.lit(False), ""))
    is_known = known.isin(*names) & (kind != "")
    parent = F.when(is_known, F.coalesce(F.element_at(F.create_map(*pairs), known), told)).otherwise(F.coalesce(told, guess))
    return F.when(kind == "", "entity").when(is_known, known).otherwise(kind), F.when(kind != "", parent)
