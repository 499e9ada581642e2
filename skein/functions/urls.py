"""URL expressions: parts, page types, content types and crawl scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import col

#: Patterns that end a URL's chances (fixed values).
BLACKLIST = (r"facebook\.com/sharer", r"twitter\.com/intent", r"linkedin\.com/share", "mailto:", "sms:", "tel:", "javascript:", "#$", r"/rss\.xml", r"/feed\.xml", "/privacy", "/terms", "/login", "/signup", "/register", "/newsletter")
TOPIC_WORDS = ("wiki", "encyclopedia", "journal", "edu", "theory", "science")
TYPE_WORDS = {"news": ("news", "headline", "breaking", "latest"), "person": ("bio", "profile", "interview"), "company": ("investor", "annual report", "leadership", "board", "sec"), "topic": ("about", "article", "story")}
#: Content types in their order, with path patterns, host patterns and signs in the HTML (fixed values).
CONTENT_PATHS = {
    "article": ("/blog/", "/news/", "/article/", "/post/", "/press/", "/insights/", "/stories/", "/publications/"),
    "profile": ("/profile/", "/people/", "/team/", "/about/", "/leadership/", "/person/", "/biography/", "/bio/", "/executive/"),
    "listing": ("/search", "/list", "/directory", "/catalog", "/results", "/companies", "/organizations", "/browse"),
    "forum": ("/forum/", "/discussion/", "/thread/", "/topic/", "/community/", "/question/", "/answers/"),
    "product": ("/product/", "/item/", "/shop/", "/store/", "/buy/", "/catalog/", "/marketplace/"),
    "documentation": ("/docs/", "/documentation/", "/manual/", "/guide/", "/api/", "/reference/", "/wiki/"),
}
CONTENT_HOSTS = {"forum": ("stackoverflow", "reddit", "quora", "discourse"), "profile": ("linkedin", "twitter", "github", "facebook"), "documentation": (r"docs\.", r"developer\.", r"api\.")}
CONTENT_SIGNS = {
    "article": ((("<article", 'class="article', 'id="article'), 0.3), (("<time", "datetime"), 0.2), (("author",), 0.1)),
    "profile": ((('class="profile', 'id="profile', 'class="bio'), 0.3),),
    "listing": ((('class="search', 'class="results', 'class="listing'), 0.3),),
    "forum": ((('class="comment', 'class="reply', 'class="thread'), 0.3),),
    "product": ((('class="price', "add to cart", "buy now"), 0.3), (('itemprop="price"',), 0.2)),
    "documentation": ((('class="doc', 'id="documentation', 'class="api'), 0.3),),
}
CONTENT_COUNTS = {"listing": ("<li", 10), "forum": ("posted by", 2), "documentation": ("<code>", 5)}
#: Page types of company pages by substrings, in order (fixed values).
COMPANY_PAGES = (("registry", ("opencorporates", "companies-house", "company-information", "northdata")), ("sec_filing", ("sec.gov",)), ("investor", ("/investor", "/annual-report", "/financials", "/earnings")), ("leadership", ("/leadership", "/management", "/board", "/executive", "/about")))


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain_key(url: str | Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def normalize_url(url: str | Column) -> Column:
    """Scheme, host and path; no query, no fragment, no final slash."""
    bare = F.regexp_replace(col(url), "[?#].*$", "")
    return F.regexp_replace(bare, "/+$", "")


def page_type(url: str | Column, entity_type: str) -> Column:
    u = F.lower(col(url))
    out = F.when(F.lit(False), "")
    if entity_type == "news":
        out = out.when(any_of(u, ("/news", "/article", "/story", "/press")), "news")
    if entity_type == "person":
        out = out.when(any_of(u, ("/bio", "/about", "/person", "/people")), "person_profile")
    if entity_type == "company":
        for name, parts in COMPANY_PAGES:
            out = out.when(any_of(u, parts), name)
    return out.when(u.contains("wikipedia.org"), "wikipedia").otherwise("general")


def _count(c: Column, part: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)


def content_scores(url: str | Column, html: str | Column | None = None) -> dict[str, Column]:
    """Score of each content type from path, host and, where there is one, the HTML."""
    lower = F.lower(col(url))
    p, h = path(lower), host(lower)
    scores = {}
    for kind, patterns in CONTENT_PATHS.items():
        s = sum((F.when(p.rlike(x), 0.4).otherwise(0.0) for x in patterns), F.lit(0.0))
        s = sum((F.when(h.rlike(x), 0.5).otherwise(0.0) for x in CONTENT_HOSTS.get(kind, ())), s)
        if html is not None:
            t = F.lower(F.coalesce(col(html), F.lit("")))
            s = sum((F.when(any_of(t, signs), w).otherwise(0.0) for signs, w in CONTENT_SIGNS[kind]), s)
            if kind in CONTENT_COUNTS:
                part, least = CONTENT_COUNTS[kind]
                s = s + F.when(_count(t, part) > least, 0.2).otherwise(0.0)
            if kind == "profile":
                s = s + F.when(t.rlike("(position|title|role).*:"), 0.2).otherwise(0.0)
        scores[kind] = F.round(s, 6)
    return scores


def content_type(url: str | Column, html: str | Column | None = None) -> tuple[Column, Column]:
    """Best content type (ties to the earlier) and its confidence; under .3 generic."""
    scores = content_scores(url, html)
    best = F.greatest(*scores.values())
    kind = F.when(best < 0.3, "generic")
    for name, s in scores.items():
        kind = kind.when(s == best, name)
    return kind, F.when(best < 0.3, best).otherwise(F.least(best, F.lit(1.0)))


def url_score(url: str | Column, text: str | Column, depth: Column, name_words: tuple[str, ...], entity_type: str, domains: tuple[tuple[str, float, bool], ...] = (), patterns: tuple[tuple[str, float], ...] = (), clean_name: str = "", learned: Column | None = None) -> tuple[Column, Column]:
    """Crawl score from 0 to 150 and the reasons for it."""
    u, t = F.lower(col(url)), F.lower(F.coalesce(col(text), F.lit("")))
    parts: list[tuple[Column, float | Column, str]] = [(F.lit(True), 40.0, "Base topic score")]
    if entity_type == "topic":
        parts += [(u.contains(w), 30.0, f"Topic-relevant domain: {w}") for w in TOPIC_WORDS]
    named = [(w, u.contains(w) | t.contains(w)) for w in name_words if len(w) > 3]
    parts += [(hit, 50.0, f"Match: {w}") for w, hit in named]
    seen = F.lit(False)
    for d, weight, official in domains:
        hit = ~seen & host(u).contains(d)
        parts += [(hit, float(weight), f"Domain pattern: {d}"), *([(hit, 150.0, "Official domain")] if official else [])]
        seen = seen | host(u).contains(d)
    if clean_name:
        sld = F.regexp_replace(F.element_at(F.split(domain_key(u), r"\."), 1), "[^a-z0-9]", "")
        parts.append((sld == clean_name, 40.0, "Exact company name match in domain"))
    seen = F.lit(False)
    for p, weight in patterns:
        parts.append((~seen & u.rlike(p), float(weight), f"Pattern match: {p}"))
        seen = seen | u.rlike(p)
    parts += [(u.contains(w) | t.contains(w), 20.0, f"Keyword: {w}") for w in TYPE_WORDS.get(entity_type, TYPE_WORDS["topic"])]
    parts += [(hit, 15.0, "Name match") for _, hit in named]
    score = sum((F.when(hit, w).otherwise(0.0) for hit, w, _ in parts), F.lit(0.0))
    if learned is not None:
        score = score + F.coalesce(learned, F.lit(0.0))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(hit, F.lit(r)) for hit, _, r in parts))), "; ")
    bad = reduce(lambda a, b: a | b, [u.rlike(p) for p in BLACKLIST])
    web = u.startswith("http://") | u.startswith("https://")
    value = F.greatest(F.lit(0.0), F.least(F.lit(150.0), score - depth * 5))
    return F.when(bad | ~web, 0.0).otherwise(value), F.when(bad, "Blacklisted pattern").when(~web, "Non-HTTP URL").otherwise(reasons)
