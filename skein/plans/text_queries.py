"""Queries over documents, conversations and names: the scalar functions at work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.plans.catalog import query
from skein.sources.tables import table

SUFFIX_CASE = " ".join(f"WHEN b LIKE '% {s}' THEN trim(substr(b, 1, length(b) - {len(s) + 1}))" for s in T.SUFFIXES)
#: Names with company suffixes, made the same way on both sides.
NAMED = "c_name || CASE c_custkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Corp Ltd' WHEN 2 THEN ', GmbH' WHEN 3 THEN ' & Company' ELSE '' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    end = F.when(k == 0, " Inc.").when(k == 1, " Corp Ltd").when(k == 2, ", GmbH").when(k == 3, " & Company").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", end).alias("name"))


@query(f"SELECT c_custkey, CASE {SUFFIX_CASE} ELSE b END AS canonical FROM (SELECT c_custkey, trim(regexp_replace(lower({NAMED}), '[^a-z0-9]+', ' ', 'g')) AS b FROM customer)")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("c_custkey", T.canonical_name("name").alias("canonical"))


def _normalized_sql() -> str:
    out = f"trim(lower({NAMED}))"
    for s in T.SUFFIXES:
        out = f"regexp_replace(regexp_replace({out}, ' {s}$', ''), ' {s}\\.$', '')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, {_normalized_sql()} AS normalized FROM customer")
def normalized_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("c_custkey", T.normalized_name("name").alias("normalized"))


def _expanded_sql() -> str:
    out = f"trim(lower({NAMED}))"
    for a, b in T.ABBREVIATIONS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(f"SELECT c_custkey, {_expanded_sql()} AS expanded FROM customer")
def expanded_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("c_custkey", T.expanded_name("name").alias("expanded"))


HALVES = "(SELECT DISTINCT p_name AS a FROM part WHERE p_partkey <= 300), (SELECT DISTINCT p_name AS b FROM part WHERE p_partkey <= 300)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that share a word: blocked by word, so that no cross join is needed."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    word = names.select(F.col("p_name").alias("a"), F.explode(T.words("p_name")).alias("w"))
    return word.join(word.select(F.col("a").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()


_PAIR_SQL = "WITH n AS (SELECT DISTINCT p_name AS a, list_distinct(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '')) AS w FROM part), p AS (SELECT x.a, y.a AS b, x.w AS wa, y.w AS wb FROM n x JOIN n y ON x.a < y.a WHERE len(list_intersect(x.w, y.w)) > 0)"


@query(f"{_PAIR_SQL} SELECT a, b, round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 6) AS similarity FROM p WHERE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) >= 0.3")
def name_word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(T.word_similarity("a", "b"), 6).alias("similarity")).filter("similarity >= 0.3")


@query(f"{_PAIR_SQL}, l AS (SELECT a, b, lower(trim(a)) AS x, lower(trim(b)) AS y, list_distinct(string_split(replace(lower(trim(a)), ' ', ''), '')) AS la, list_distinct(string_split(replace(lower(trim(b)), ' ', ''), '')) AS lb FROM p) SELECT a, b, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 ELSE len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))) END, 6) AS similarity FROM l")
def name_char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(T.name_similarity("a", "b"), 6).alias("similarity"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, (i - 1) // 2 AS pos, array_to_string(s[i:i + 4], ' ') AS window_text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)) WHERE (i - 1) % 2 = 0 AND len(s) - i + 1 >= 2")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(T.sentences("text"))).alias("pos", "window_text"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH s AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
g AS (SELECT doc_id, (i - 1) // 3 AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS snippet FROM s GROUP BY ALL)
SELECT doc_id, chunk_index, snippet, coalesce(substr(lag(snippet) OVER w, 1, 80), '') AS prev_context, coalesce(substr(lead(snippet) OVER w, 1, 80), '') AS next_context
FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)
""")
def snippets_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.chunks import snippets

    return snippets(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH s AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE doc_id % 50 = 0)),
g AS (SELECT doc_id, (i - 1) // 3 AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS snippet FROM s GROUP BY ALL)
SELECT a.doc_id, a.chunk_index, b.chunk_index AS neighbour, b.snippet AS neighbour_text
FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2 AND a.chunk_index <> b.chunk_index
""")
def snippet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.chunks import neighbours, snippets

    hits = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0")  # the hits of a search: every fiftieth document
    return neighbours(snippets(hits, "doc_id", "text"), "doc_id", "chunk_index", "snippet", 2)


@query("SELECT doc_id, i AS pos, substr(text, i * 1500 + 1, 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, least(ceil(length(text) / 1500)::BIGINT, 10))) AS i FROM documents)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_chunks("text", 1500, 10)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, i * 1300 AS start, substr(text, i * 1300 + 1, 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 1300)::BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.overlap_chunks("text")).alias("pos", "chunk"))
    return rows.select("doc_id", (F.col("pos").cast("long") * 1300).alias("start"), "chunk")


@query()
def overlap_chunks_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.chunks import snapped_chunks

    return snapped_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.chunks import topic_chunks as chunks

    return chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
m AS (SELECT doc_id, s, coalesce(list_position(list_transform(range(1, len(s)), lambda i: NOT contains(lower(s[i]), 'the') AND NOT contains(lower(s[i + 1]), 'the')), true), 0) AS p FROM s)
SELECT doc_id, CASE WHEN p > 0 THEN p ELSE len(s) END AS kept FROM m
""")
def pretrim_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.pretrim(T.sentences("text"), "the")).cast("long").alias("kept"))


_LINES = "CASE conv_id % 4 WHEN 0 THEN 'Score 12 of it' || chr(10) WHEN 1 THEN 'plain line' || chr(10) || 'Instruction here' || chr(10) WHEN 2 THEN 'kept assistant: cut' || chr(10) ELSE '' END || text"


@query(f"""
WITH l AS (SELECT conv_id, turn, string_split_regex({_LINES}, '\\r\\n|\\r|\\n') AS l FROM conversations),
k AS (SELECT conv_id, turn, trim(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)(^|\\b)(instruction|prompt|assistant:|user:|###|score\\s*\\d+|uuid\\s+[0-9a-f-]{{8,}}|No extracted intel|depth\\s+\\d+)\\b')), chr(10)), ' ' || chr(10)) AS k FROM l)
SELECT conv_id, turn, trim(string_split_regex(k, '(?i)(instruction:|###\\s|assistant:|user:)')[1], ' ' || chr(10)) AS kept FROM k
""")
def prompty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 4
    head = F.when(k == 0, "Score 12 of it\n").when(k == 1, "plain line\nInstruction here\n").when(k == 2, "kept assistant: cut\n").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(T.strip_prompt_lines(F.concat(head, F.col("text"))), F.lit(" \n")).alias("kept"))


_ODD = "length(regexp_replace(text, '[a-zA-Z0-9\\s.,!?;:()\\-]', '', 'g')) / greatest(length(text), 1)"
_GOOD = "len(list_filter(string_split(text, '.'), lambda s: length(trim(s)) > 5 AND contains(trim(s), ' ')))"


@query(f"""
SELECT conv_id, turn, length(text) >= 10 AND NOT regexp_matches(lower(text), '(a user:|document|write a\\))|name_congraining|jsonleveraging|email_user') AND {_ODD} <= 0.3 AND ({_GOOD} > 0 OR length(text) <= 50) AS valid,
  {_ODD} > 0.25 OR text = '' OR regexp_matches(lower(text), 'no information|not have information|unable to find|does not contain|cannot provide details|i don''t have enough|no data|insufficient context|based solely on the given data|insufficient_data|a user:|document|write a\\)|name_congraining|beacon|jsonleveraging') AS refusal
FROM conversations
""")
def answer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_valid_answer("text").alias("valid"), T.is_refusal("text").alias("refusal"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, '\\b(1[89]\\d{2}|20\\d{2})\\b', 1), '') AS INTEGER) AS year, CAST(nullif(regexp_extract(replace(lower(text), ',', ''), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) * CASE WHEN contains(lower(text), 'b') THEN 1e9 WHEN contains(lower(text), 'm') THEN 1e6 WHEN contains(lower(text), 'k') THEN 1e3 ELSE 1.0 END AS number FROM documents")
def year_number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.year("text").alias("year"), T.number("text").alias("number"))


_ALPHA = "length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1)"
_BLANK = "length(regexp_replace(text, '[^ ]', '', 'g')) / greatest(length(text), 1)"


@query(f"""
SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 0.3 WHEN {_ALPHA} < 0.4 THEN 0.5 WHEN {_ALPHA} > 0.7 THEN 0.9 ELSE 0.7 END AS file_quality,
  CASE WHEN length(text) < 100 THEN 0.3 WHEN {_ALPHA} < 0.4 THEN 0.5 WHEN {_ALPHA} > 0.7 AND {_BLANK} > 0.1 THEN 0.95 ELSE 0.75 END AS pdf_quality FROM documents
""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.text_quality("text", "pdf").alias("file_quality"), T.pdf_quality("text").alias("pdf_quality"))


@query("SELECT doc_id, length(text) >= 10 AND round((doc_id % 10) / 10.0, 6) >= 0.3 AS valid FROM documents")
def document_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.round((F.col("doc_id") % 10) / 10.0, 6)
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") >= 10) & (confidence >= 0.3)).alias("valid"))


@query("SELECT conv_id, turn, len(list_intersect(string_split_regex(lower(text), '[^a-z0-9]+'), ['all', 'every', 'each', 'complete', 'full', 'list', 'entire'])) > 0 AS exhaustive, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short_text FROM conversations")
def exhaustive_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_exhaustive("text").alias("exhaustive"), T.truncate("text", 100).alias("short_text"))


@query()  # where a word ends beside letters beyond ASCII differs between engines; tests hold it against plain code
def question_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sort_array(T.mentions("text")).alias("mentioned"))


@query("SELECT doc_id, count(*) AS n_headings FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND (line LIKE '#%' OR (line LIKE '%:' AND length(line) < 80 AND len(string_split_regex(line, '\\s+')) <= 8 AND NOT regexp_matches(line, '[.!?]') AND NOT regexp_matches(lower(line), 'as follows:|are looking for|if you are|the official|you are looking')) OR regexp_matches(line, '^\\d+\\.\\s+[A-Z]') OR (line = upper(line) AND line <> lower(line) AND length(line) < 80 AND len(string_split_regex(line, '\\s+')) <= 10)) GROUP BY doc_id")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(T.is_heading("line")).groupBy("doc_id").agg(F.count("*").alias("n_headings"))


@query("SELECT o_orderkey, CAST(json_extract(j, '$.k') AS INTEGER) AS k FROM (SELECT event_id AS o_orderkey, replace(regexp_replace(replace(replace('```json' || chr(10) || replace(props, '}', ',}') || chr(10) || '```', '```json', ''), '```', ''), ',\\s*([}\\]])', '\\1', 'g'), chr(39), '\"') AS j FROM events)")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```"))
    fixed = F.try_parse_json(T.repaired_json(broken))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), F.try_variant_get(fixed, "$.k", "int").alias("k"))
