"""HTML: regular expressions inside the JVM for scans, a parser in Arrow batches where structure counts."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skein.functions.text import col, strip_prompt_lines

#: Containers whose content is no text (fixed values).
SILENT = ("script", "style", "noscript", "nav", "footer", "header", "form", "aside", "svg")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
WHITELIST = ("slideshare", "youtube", "vimeo", "medium", "substack", "linkedin", "twitter", "github", "wikipedia")


def title(html: str | Column) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def strip_tags(html: str | Column) -> Column:
    """Text without silent containers, comments and tags; white space collapsed."""
    bare = col(html)
    for tag in ("script", "style", "noscript", "nav", "footer", "header", "form"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))


def clean_text(text: str | Column) -> Column:
    """Text without tags (taken out only where both brackets occur) and prompt lines; paragraphs stay apart, blanks collapse."""
    t = F.coalesce(col(text), F.lit(""))
    bare = F.regexp_replace(strip_silent(t, ("script", "style", "noscript", "nav", "footer", "header", "form")), r"(?s)<[^>]+>", "\n")
    kept = strip_prompt_lines(F.when(t.contains("<") & t.contains(">"), bare).otherwise(t))
    narrow = F.regexp_replace(F.regexp_replace(kept, r"\n{2,}", "\n\n"), r"[^\S\n]+", " ")
    lines = F.transform(F.split(narrow, "\n"), lambda x: F.trim(x))
    return F.regexp_replace(F.trim(F.array_join(lines, "\n"), F.lit(" \n")), r"\n{3,}", "\n\n")


def html_to_text(html: str | Column, most: int | None = None) -> Column:
    """Text of a page: no silent containers, frames or tags, blanks collapsed, prompt lines stripped; cut at ``most`` characters if given."""
    bare = F.regexp_replace(strip_silent(F.coalesce(col(html), F.lit("")), ("script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript")), r"(?s)<[^>]+>", " ")
    text = strip_prompt_lines(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return text if most is None else F.substring(text, 1, most)


def strip_silent(html: Column, tags: tuple[str, ...]) -> Column:
    """Without comments and the containers ``tags`` and all in them."""
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def hrefs(html: str | Column) -> Column:
    return F.regexp_extract_all(col(html), F.lit("(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1))


def media_tags(html: str | Column) -> Column:
    """All media of a page as (media_type, url, alt, width, height), by the tags they stand in."""
    h = col(html)

    def found(kind: str, pattern: str, prefix: str = "") -> Column:
        tags = F.regexp_extract_all(h, F.lit(pattern), F.lit(0))
        url = lambda t: F.concat(F.lit(prefix), F.regexp_extract(t, pattern, 1))
        size = lambda t, n: F.coalesce(F.regexp_extract(t, rf"{n}=[\"']?(\d+)", 1).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract(t, rf"{n}=[\"']?(\d+)", 1).cast("int"), F.lit(0))
        return F.transform(tags, lambda t: F.struct(F.lit(kind).alias("media_type"), url(t).alias("url"), F.regexp_extract(t, "alt=[\"']([^\"']+)[\"']", 1).alias("alt"), size(t, "width").alias("width"), size(t, "height").alias("height")))

    return F.concat(
        found("image", "(?i)<img[^>]+src=[\"']([^\"']+)[\"'][^>]*>"),
        found("video", "(?i)<video[^>]+src=[\"']([^\"']+)[\"'][^>]*>"),
        found("video", "(?i)<source[^>]+src=[\"']([^\"']+)[\"'][^>]*type=[\"']video"),
        found("video", "(?i)youtube\\.com/embed/([a-zA-Z0-9_-]+)", "https://www.youtube.com/watch?v="),
        found("audio", "(?i)<audio[^>]+src=[\"']([^\"']+)[\"'][^>]*>"),
        found("pdf", "(?i)<a[^>]+href=[\"']([^\"']+\\.pdf)[\"'][^>]*>"),
    )


def media_score(m: Column, page_host: Column) -> Column:
    """How much a medium promises, from 0 to 1."""
    alt, u = F.lower(m["alt"]), F.lower(m["url"])
    has = lambda c, parts: F.concat_ws("|", *map(F.lit, parts)).isNotNull() & c.rlike("|".join(parts))
    size = F.when((m["width"] > 200) & (m["height"] > 200), 0.3).when((m["width"] > 100) & (m["height"] > 100), 0.1).otherwise(0.0)
    told = F.when(alt == "", 0.0).when(has(alt, ("screenshot", "diagram", "chart", "infographic", "slide")), 0.3).otherwise(0.1)
    cue = F.when(has(u, ("screenshot", "diagram", "chart", "slide", "infographic")), 0.2).otherwise(0.0)
    decor = F.when(has(u, ("icon", "logo", "button", "avatar", "thumbnail")), -0.3).otherwise(0.0)
    own = F.when(m["media_type"] == "image", F.greatest(F.lit(0.0), size + told + cue + decor)).when(m["media_type"] == "video", 0.6).when(m["media_type"] == "audio", 0.5).otherwise(0.7)
    return F.round(F.least(F.lit(1.0), own + F.when(page_host.rlike("|".join(WHITELIST)), 0.3).otherwise(0.0)), 6)


def worth_processing(m: Column, score: Column, least: float = 0.3) -> Column:
    return ~F.lower(m["url"]).rlike(r"\.css|\.js|\.woff|\.ttf|\.eot") & (score >= least)


# ---------------------------------------------------------------- parsed
class _Reader(HTMLParser):
    """Text, title, metadata, links and images of one page, tolerant of unclosed tags."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.silent, self.text = base, [], []
        self.title, self.in_title, self.meta, self.links, self.images, self.open_link, self.json_ld, self.in_ld = "", False, {}, [], [], None, [], False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SILENT and tag not in VOID:
            self.silent.append(tag)
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.in_ld = True
            self.json_ld.append("")
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = a.get("name") or a.get("property")
            if name:
                self.meta.setdefault(name.lower(), a.get("content", ""))
        elif tag == "a" and a.get("href"):
            self.open_link = [urljoin(self.base, a["href"]), ""]
            self.links.append(self.open_link)
        elif tag == "img" and a.get("src") and not a["src"].startswith("data:"):
            self.images.append((urljoin(self.base, a["src"]), a.get("alt", ""), a.get("title", "")))

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.open_link = None
        elif tag == "script":
            self.in_ld = False

    def handle_data(self, data):
        if self.in_ld:
            self.json_ld[-1] += data
        if self.in_title:
            self.title += data
        elif not self.silent:
            self.text.append(data)
        if self.open_link is not None:
            self.open_link[1] += data


PARSED = "title string, description string, author string, keywords string, text string, links array<struct<url:string,text:string>>, images array<struct<url:string,alt:string,title:string>>, json_ld array<string>"


def parse_page(html: str | Column, url: str | Column) -> Column:
    """A page taken apart: metadata, visible text (15,000 characters at most), links and images with absolute URLs."""
    return pandas_udf(_parsed, PARSED)(html, url)


def _parsed(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = []
    for h, u in zip(html, url):
        r = _Reader(u or "")
        r.feed(h or "")
        text = " ".join(" ".join(r.text).split())
        meta = r.meta
        rows.append((" ".join(r.title.split()), meta.get("description") or meta.get("og:description", ""), meta.get("author", ""), meta.get("keywords", ""), text, [{"url": x, "text": " ".join(t.split())[:500]} for x, t in r.links], [{"url": x, "alt": a, "title": t} for x, a, t in r.images], [x.strip() for x in r.json_ld]))
    return pd.DataFrame(rows, columns=["title", "description", "author", "keywords", "text", "links", "images", "json_ld"])
