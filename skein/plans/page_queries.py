"""Queries over pages: URLs, HTML, media, content types and crawl frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import pages as P
from skein.plans.catalog import query
from skein.sources.tables import table

HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(lower(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h,17,1))::BIGINT, 1)||substr(h,18,3)||'-'||substr(h,21,12)"


@query(f"SELECT page_id, {_UUID} AS id FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)")
def page_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.uuid5("url").alias("id"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS normal_url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.normalize_url("url").alias("normal_url"))


@query(f"SELECT replace({HOST}, 'www.', '') AS domain_key, count(*) AS n FROM pages GROUP BY 1")
def domain_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.domain_key("url").alias("domain_key")).agg(F.count("*").alias("n"))


@query("SELECT page_id, url, length(html) AS text_length FROM pages WHERE (url ILIKE '%a%' OR html ILIKE '%the%') AND length(html) >= 500 ORDER BY length(html) DESC NULLS LAST, page_id LIMIT 40")
def page_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).withColumn("text_length", F.length("html").cast("long"))
    found = rows.filter((F.col("url").ilike("%a%") | F.col("html").ilike("%the%")) & (F.col("text_length") >= 500))
    return found.select("page_id", "url", "text_length").orderBy(F.col("text_length").desc_nulls_last(), "page_id").limit(40)


def _any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(url), '{p}')" for p in parts) + ")"


_COMPANY = " ".join(f"WHEN {_any(parts)} THEN '{name}'" for name, parts in U.COMPANY_PAGES)


@query(f"SELECT page_id, CASE {_COMPANY} WHEN contains(lower(url), 'wikipedia.org') THEN 'wikipedia' ELSE 'general' END AS company_page, CASE WHEN {_any(('/news', '/article', '/story', '/press'))} THEN 'news' WHEN contains(lower(url), 'wikipedia.org') THEN 'wikipedia' ELSE 'general' END AS news_page FROM pages")
def page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.page_type("url", "company").alias("company_page"), U.page_type("url", "news").alias("news_page"))


def _content_sql() -> str:
    t = "lower(html)"
    scores = []
    for kind, patterns in U.CONTENT_PATHS.items():
        s = [f"CASE WHEN regexp_matches({PATH}, '{p}') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END" for p in patterns]
        s += [f"CASE WHEN regexp_matches({HOST}, '{p}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END" for p in U.CONTENT_HOSTS.get(kind, ())]
        s += ["CASE WHEN " + " OR ".join(f"contains({t}, '{x}')" for x in signs) + f" THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for signs, w in U.CONTENT_SIGNS[kind]]
        if kind in U.CONTENT_COUNTS:
            part, least = U.CONTENT_COUNTS[kind]
            s.append(f"CASE WHEN (length({t}) - length(replace({t}, '{part}', ''))) / {len(part)} > {least} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END")
        if kind == "profile":
            s.append(f"CASE WHEN regexp_matches({t}, '(position|title|role).*:') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END")
        scores.append(f"round({' + '.join(s)}, 6) AS {kind}")
    best = f"greatest({', '.join(U.CONTENT_PATHS)})"
    pick = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in U.CONTENT_PATHS)
    return f"SELECT page_id, CASE WHEN {best} < 0.3 THEN 'generic' {pick} END AS content_type, CASE WHEN {best} < 0.3 THEN {best} ELSE least({best}, 1.0) END AS confidence FROM (SELECT page_id, {', '.join(scores)} FROM pages)"


@query(_content_sql())
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, confidence = U.content_type("url", "html")
    return pages(spark, sf_dir).select("page_id", kind.alias("content_type"), confidence.alias("confidence"))


_SCORE_ARGS = {"name_words": ("example", "site3"), "entity_type": "company", "domains": (("example", 10.0, False), ("site1", 20.0, True)), "patterns": (("/a[a-z]*", 5.0), ("[0-9]+", 3.0)), "clean_name": "site2"}


def _score_sql() -> str:
    bad = " OR ".join(f"regexp_matches(lower(url), '{p}')" for p in U.BLACKLIST)
    u = "lower(url)"
    s = ["40"]
    for w in _SCORE_ARGS["name_words"]:
        s.append(f"CASE WHEN contains({u}, '{w}') THEN 65 ELSE 0 END")
    s.append(f"CASE WHEN contains({HOST}, 'example') THEN 10 WHEN contains({HOST}, 'site1') THEN 170 ELSE 0 END")
    s.append(f"CASE WHEN regexp_replace(string_split(replace({HOST}, 'www.', ''), '.')[1], '[^a-z0-9]', '', 'g') = 'site2' THEN 40 ELSE 0 END")
    s.append(f"CASE WHEN regexp_matches({u}, '/a[a-z]*') THEN 5 WHEN regexp_matches({u}, '[0-9]+') THEN 3 ELSE 0 END")
    s += [f"CASE WHEN contains({u}, '{w}') THEN 20 ELSE 0 END" for w in U.TYPE_WORDS["company"]]
    return f"SELECT page_id, CASE WHEN {bad} OR NOT ({u} LIKE 'http://%' OR {u} LIKE 'https://%') THEN 0.0 ELSE greatest(0.0, least(150.0, {' + '.join(s)} - (page_id % 4) * 5)) END::DOUBLE AS score FROM pages"


@query(_score_sql())
def url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, _ = U.url_score("url", F.lit(""), F.col("page_id") % 4, **_SCORE_ARGS)
    return pages(spark, sf_dir).select("page_id", score.alias("score"))


@query()
def url_score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, why = U.url_score("url", F.lit(""), F.col("page_id") % 4, **_SCORE_ARGS)
    return pages(spark, sf_dir).select("page_id", score.alias("score"), why.alias("reasons"))


def _strip_sql() -> str:
    out = "html"
    for tag in ("script", "style", "noscript", "nav", "footer", "header", "form"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_strip_sql()} AS page_text FROM pages")
def strip_tags_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.strip_tags("html").alias("page_text"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.title("html").alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"'']+)[\"'']', 1)) AS href FROM pages")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.explode(H.hrefs("html")).alias("href"))


@query()
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.parse_page("html", "url").alias("p")).select("page_id", "p.*")


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pages(spark, sf_dir).select("page_id", "url", H.parse_page("html", "url").alias("p"))
    return P.save_links(parsed.select("url", F.explode("p.links").alias("l")).select(F.col("url").alias("from_url"), F.col("l.url").alias("to_url"), F.col("l.text").alias("anchor_text")), pages(spark, sf_dir))


#: Media put behind every page, the same on both sides: the sample pages have none of their own.
_TAGS = ('<img src="/chart1.png" alt="A chart" width="300" height="250">', '<video src="v.mp4"></video><a href="f.pdf">x</a>', '<img src="logo.png"><audio src="a.mp3"></audio>')
_PAGES_SQL = "(SELECT page_id, url, html || CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAGS)) + " ELSE '' END AS html FROM pages)"


def _with_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    tags = F.when(k == 0, _TAGS[0]).when(k == 1, _TAGS[1]).when(k == 2, _TAGS[2]).otherwise("")
    return P.media(pages(spark, sf_dir).withColumn("html", F.concat("html", tags)))


_MEDIA = (("image", '(?i)<img[^>]+src=["\']([^"\']+)["\'][^>]*>', ""), ("video", '(?i)<video[^>]+src=["\']([^"\']+)["\'][^>]*>', ""), ("video", '(?i)<source[^>]+src=["\']([^"\']+)["\'][^>]*type=["\']video', ""), ("video", "(?i)youtube\\.com/embed/([a-zA-Z0-9_-]+)", "https://www.youtube.com/watch?v="), ("audio", '(?i)<audio[^>]+src=["\']([^"\']+)["\'][^>]*>', ""), ("pdf", '(?i)<a[^>]+href=["\']([^"\']+\\.pdf)["\'][^>]*>', ""))
_MEDIA_SQL = " UNION ALL ".join("SELECT page_id, url AS page_url, '{}' AS media_type, '{}' || regexp_extract(t, '{}', 1) AS media_url, t AS tag FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{}', 0)) AS t FROM {})".format(k, pre, p.replace("'", "''"), p.replace("'", "''"), _PAGES_SQL) for k, p, pre in _MEDIA)


@query(f"SELECT page_id, media_type, media_url FROM ({_MEDIA_SQL})")
def media_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_media(spark, sf_dir).select("page_id", "media_type", F.col("url").alias("media_url"))


@query(f"""
WITH m AS (SELECT *, lower(regexp_extract(tag, 'alt=["'']([^"'']+)["'']', 1)) AS alt, coalesce(try_cast(regexp_extract(tag, 'width=["'']?(\\d+)', 1) AS INT), 0) AS w, coalesce(try_cast(regexp_extract(tag, 'height=["'']?(\\d+)', 1) AS INT), 0) AS h, lower(media_url) AS u FROM ({_MEDIA_SQL})),
s AS (SELECT *, CASE media_type WHEN 'image' THEN greatest(0.0, CASE WHEN w > 200 AND h > 200 THEN 0.3 WHEN w > 100 AND h > 100 THEN 0.1 ELSE 0.0 END + CASE WHEN alt = '' THEN 0.0 WHEN regexp_matches(alt, 'screenshot|diagram|chart|infographic|slide') THEN 0.3 ELSE 0.1 END + CASE WHEN regexp_matches(u, 'screenshot|diagram|chart|slide|infographic') THEN 0.2 ELSE 0.0 END - CASE WHEN regexp_matches(u, 'icon|logo|button|avatar|thumbnail') THEN 0.3 ELSE 0.0 END) WHEN 'video' THEN 0.6 WHEN 'audio' THEN 0.5 ELSE 0.7 END AS own FROM m),
f AS (SELECT *, round(least(1.0, own + CASE WHEN regexp_matches(lower(regexp_extract(page_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '{"|".join(H.WHITELIST)}') THEN 0.3 ELSE 0.0 END), 6)::DOUBLE AS score FROM s)
SELECT page_id, media_type, media_url, score, NOT regexp_matches(u, '\\.css|\\.js|\\.woff|\\.ttf|\\.eot') AND score >= 0.3 AS process FROM f
""")
def media_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_media(spark, sf_dir).select("page_id", "media_type", F.col("url").alias("media_url"), "score", "process")


@query(f"SELECT media_type, count(*) AS items, sum(CASE media_type WHEN 'image' THEN 2 WHEN 'video' THEN 30 WHEN 'audio' THEN 15 ELSE 10 END)::BIGINT AS seconds FROM ({_MEDIA_SQL}) GROUP BY 1")
def media_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.media_cost(_with_media(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (page_id % 3 = 0) AS processed, count(*) FILTER (page_id % 3 = 1) AS pending, count(*) FILTER (page_id % 3 = 2) AS errors FROM ({_MEDIA_SQL})")
def media_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    rows = _with_media(spark, sf_dir)
    return rows.agg(F.count("*").alias("total"), F.count_if(k == 0).alias("processed"), F.count_if(k == 1).alias("pending"), F.count_if(k == 2).alias("errors"))


@query(f"SELECT page_id, domain, score, place FROM (SELECT page_id, replace({HOST}, 'www.', '') AS domain, page_id % 100 AS score, row_number() OVER (PARTITION BY replace({HOST}, 'www.', '') ORDER BY page_id % 100 DESC, page_id % 4, url) AS place FROM pages) WHERE place <= 5 AND score >= 25")
def frontier_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", "url", (F.col("page_id") % 100).alias("score"), (F.col("page_id") % 4).alias("depth"), U.domain_key("url").alias("domain"))
    return P.frontier(rows, "domain", 5, 25).select("page_id", "domain", "score", F.col("place").cast("long").alias("place"))


@query("SELECT page_id, url FROM pages ORDER BY coalesce(CASE WHEN page_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL (page_id % 90) DAY END, TIMESTAMP '1970-01-01'), page_id LIMIT 30")
def refresh_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.when(F.col("page_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).cast("timestamp_ntz"))
    return P.refresh_scan(pages(spark, sf_dir).withColumn("last_fetch_at", fetched), "page_id", 30).select("page_id", "url")


@query(f"SELECT url, min(pos) AS pos FROM (SELECT url, page_id AS pos FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id + 1000 AS pos FROM pages WHERE contains({HOST}, 'www')) WHERE regexp_matches(url, '[0-9]') GROUP BY url ORDER BY pos, url LIMIT 60")
def seeds_from_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    links = p.filter("page_id % 2 = 0").select("url", F.col("page_id").alias("pos"))
    fresh = p.filter(U.host("url").contains("www")).select("url", (F.col("page_id") + 1000).alias("pos"))
    return P.seeds([links, fresh], ["[0-9]", "("], 60)


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'https?://[^\\s<>\"'']*[^\\s<>\"''.]'))) AS url, 0.5::DOUBLE AS score FROM documents")
def urls_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.urls_in_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH u AS (SELECT page_id, url, html, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') ORDER BY page_id DESC) AS r FROM pages) SELECT page_id, url, length(html) AS n FROM u WHERE r = 1")
def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).withColumn("key", U.normalize_url("url"))
    return P.latest(rows, ["key"], [F.desc("page_id")]).select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("SELECT page_id, url, count(*) OVER () AS total FROM pages WHERE url ILIKE '%a%' ORDER BY page_id DESC LIMIT 20 OFFSET 10")
def local_files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.listing(pages(spark, sf_dir).filter(F.col("url").ilike("%a%")), F.desc("page_id"), 10, 20).select("page_id", "url", "total")
