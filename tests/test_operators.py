"""Operators on small hand-made inputs, streams and sources."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import content, html, kinds, selectors, text, urls
from skein.operators import chunks, edges, gaps, graph, inference, intel, learn, pages, resolve, vectors
from skein.sources import adapters, databases, files
from skein.streaming import tasks, throttle, watcher, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uuid5_is_pythons(spark):
    for url in ("https://example.com/a", "é"):
        assert one(spark, text.uuid5(F.lit(url))) == str(uuid.uuid5(uuid.NAMESPACE_URL, url))


@pytest.mark.parametrize("name,want", [("Microsoft Corporation", "microsoft"), ("Acme Co Inc.", "acme co"), ("Café & Co", "caf"), ("", ""), ("Inc", "inc")])
def test_canonical_name(spark, name, want):
    assert one(spark, text.canonical_name(F.lit(name))) == want


def test_names(spark):
    assert one(spark, text.normalized_name(F.lit("Acme Inc. Ltd"))) == "acme inc"
    assert one(spark, text.name_similarity(F.lit("Acme"), F.lit("acme corp"))) == 0.85
    assert one(spark, text.number(F.lit("2.5K people"))) == 2500 and one(spark, text.year(F.lit("in 1998, 2001"))) == 1998
    assert one(spark, text.repaired_json(F.lit("```json\n{'a': 1,}\n```"))) == '{"a": 1}'


def test_prompt_lines_and_sentences(spark):
    assert one(spark, text.strip_prompt_lines(F.lit("keep\nscore 12\nlast assistant: gone"))) == "keep\nlast"
    assert one(spark, text.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.pretrim(F.array(*map(F.lit, ("Acme a.", "b.", "c.", "Acme d."))), "acme")) == ["Acme a.", "b."]
    assert one(spark, F.array_join(text.overlap_chunks(F.lit("x" * 3100)), "|")).count("|") == 2


def test_url_score(spark):
    score, why = urls.url_score(F.lit("https://www.acme.com/investor"), F.lit("Acme"), F.lit(1), ("acme",), "company", (("acme.com", 10, True),), (), "acme")
    assert one(spark, score) == 150 and "Official domain" in one(spark, why)
    bad, why = urls.url_score(F.lit("https://acme.com/login"), F.lit(""), F.lit(0), ("acme",), "company")
    assert (one(spark, bad), one(spark, why)) == (0, "Blacklisted pattern")


def test_content(spark):
    assert one(spark, urls.content_type(F.lit("https://a.com/blog/x"), F.lit("<article>"))[0]) == "article"
    s = " ".join(f"s{i}." for i in range(20))
    assert one(spark, content.main_content(F.lit(s), F.lit("article"))).split() == [f"s{i}." for i in range(2, 18)]
    assert one(spark, F.size(content.hierarchical_windows(F.lit("x" * 9000)))) == 3
    assert selectors.select('<div id="content"><p>a</p></div><p>b</p>', "#content p") == ["a"]


def test_parse_page(spark):
    page = "<title>T</title><meta name=description content=D><nav>no</nav><p>Hello <b>big <a href='/x'>link</a><img src=i.png alt=A><script>no</script>"
    row = spark.createDataFrame([(page, "http://h.com/d/")], "html string, url string").select(html.parse_page("html", "url").alias("p")).first()["p"]
    assert (row.title, row.description, row.text) == ("T", "D", "Hello big link") and row.links[0].url == "http://h.com/x" and row.images[0].url == "http://h.com/d/i.png"


def test_chunkers():
    body = "A. " * 2000
    cut = chunks._snapped(body, 1500, 200)
    assert cut[-1][1] == len(body) and all(a[1] > b[0] for a, b in zip(cut, cut[1:]))
    topics = chunks._topics("# One\ntext one. " + "x " * 100 + "\n# Two\n" + "y " * 3000, 4000, 100, 800)
    assert topics[0][2] == "# One" and "".join(c[3] for c in topics).replace("\n", "") and all(len(c[3]) <= 4000 for c in topics)


def test_kinds(spark):
    assert one(spark, kinds.normalized_kind(F.lit("Organisation"))) == "org" and one(spark, kinds.more_specific(F.lit("ceo"), F.lit("person")))
    assert one(spark, kinds.person_kind(F.lit("Vice President"))) == "executive" and one(spark, kinds.location_kind(F.lit("Head office"))) == "headquarters"
    assert kinds.child_color("#0ea5e9", 0).startswith("#") and kinds.rank_table(spark).filter("kind = 'ceo'").first()["rank"] == 2


def test_components_and_paths_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    top = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == {n: top[n] for p in pairs for n in p}
    line = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert {r.component for r in graph.connected_components(line).collect()} == {0}
    assert graph.shortest_path(line, 3, 6, "src", "dst") == [3, 4, 5, 6] and graph.shortest_path(line, 0, 9, "src", "dst") == [] and graph.shortest_path(line, 5, 5, "src", "dst") == [5]


def test_edge_confidence_closed_form(spark):
    rows = spark.createDataFrame([("a", "b", u) for u in ("u1", "u2", "u3")], "s string, t string, url string")
    r = edges.confidence(rows, ["s", "t"], source="url").first()
    assert (r.occurrence_count, r.confidence, r.n_sources) == (3, 0.595, 3)


def test_inference_and_application(spark):
    e = spark.createDataFrame([("p", "person", "Ann", {"x": "1"}), ("c", "company", "Acme", {"location": "Rome", "industry": "steel"})], "id string, kind string, name string, data map<string,string>")
    r = spark.createDataFrame([("p", "c", "works_at")], "source_id string, target_id string, relation_type string")
    facts = inference.infer(e, r)
    assert {(f.field, f.value, f.confidence) for f in facts.collect()} == {("probable_location", "Rome", 0.75), ("industry", "steel", 0.85)}
    assert inference.apply_facts(e, facts).filter("id = 'p'").first()["data"]["industry"] == "steel"
    inference.register_rule("always", lambda ents, eds: ents.select(F.col("id").alias("entity_id"), F.lit("seen").alias("field"), F.lit("yes").alias("value"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("via")))
    assert inference.infer(e, r, fields=["seen"]).count() == 2
    del inference.RULES["always"]
    assert {x.field for x in inference.missing_fields(e, r).collect()} == {"organization"}


def test_resolution(spark):
    rows = spark.createDataFrame([(1, "Acme", "company", 1), (2, "Acme Corp", "company", 2), (3, "Zeta", "company", 3), (4, "acme", "company", 4)], "id long, name string, kind string, at long")
    found = resolve.dedup_scan(rows, "id", "name", "kind", "at", F.lit(0)).collect()
    assert {(r.canonical_id, r.duplicate_id) for r in found} == {(1, 4)}
    found = resolve.dedup_scan(rows, "id", "name", "kind", "at", F.when(F.col("id") == 4, 1).otherwise(0), 0.5).collect()
    assert {(r.canonical_id, r.duplicate_id) for r in found} == {(4, 1), (4, 2)}  # the richest stands for the group
    ids = spark.createDataFrame([(2, 1)], "old_id long, new_id long")
    links = spark.createDataFrame([(10, 2, 3, "r"), (11, 1, 3, "r"), (12, 1, 2, "r")], "edge_id long, source_id long, target_id long, relation_type string")
    kept, moved = resolve.merge(rows, links, ids, "id", "hard")
    assert kept.count() == 3 and [tuple(r) for r in moved.select("source_id", "target_id", "edge_id").collect()] == [(1, 3, 10)]
    soft, linked = resolve.merge(rows, links, ids, "id", "soft")
    assert soft.filter("merged_into = 1").count() == 1 and linked.filter("relation_type = 'duplicate_of'").count() == 1


def test_findings(spark):
    doc = '{"basic_info": {"official_name": "Acme"}, "persons": [{"name": "Ann", "title": "CEO"}, {"name": "n/a"}], "locations": [{"address": "Rome", "type": "Head office"}]}'
    rows = spark.createDataFrame([(1, doc), (2, "broken")], "id long, text string").select("id", intel.parse("text").alias("f"))
    found = intel.entities_of(intel.section_rows(rows, "id", "f"), "id")
    assert {(r.name, r.kind) for r in found.collect()} == {("Ann", "ceo"), ("Rome", "headquarters")}
    known = spark.createDataFrame([("e1", "ann")], "id string, name string")
    made, links = intel.sub_entities(found, "id", known)
    assert {r.is_new for r in made.collect()} == {True, False} and links.count() == 2
    assert one(spark, intel.harvest_relations(F.lit('{"a": [{"source": "x", "target": "y"}]}')))[0]["target"] == "y"
    assert one(spark, intel.harvest_images(F.lit('{"image": {"url": "u"}, "images": ["v", "u"]}'))) == ["u", "v"]
    assert one(spark, F.size(intel.discovered_fields(F.lit("nonsense")))) == 5
    p = lambda n: F.struct(F.lit(n).alias("name"))
    assert len(one(spark, intel.first_by(F.array(p("A"), p("a"), p("b")), lambda x: F.lower(x["name"])))) == 2


def test_learning_and_gaps(spark):
    assert one(spark, learn.reliability(F.lit(1.0), F.lit(0.5), F.lit(0))) == 0.6 and one(spark, learn.domain_boost(F.lit(3), F.lit(0.5), F.lit(0.7))) == 15
    e = spark.createDataFrame([(1, "person", {"full name": "x", "title": ""})], "id long, kind string, data map<string,string>")
    assert "title" in {r.field for r in gaps.gaps(e, "id", "kind", "data").collect()} and gaps.category_completeness(e, "id", "data").first()["completeness"] == 0


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    made = spark.createDataFrame([("some words here",), ("short",)], "t string").select(vectors.hashing_embedder(16)("t").alias("v")).collect()
    assert len(made[0]["v"]) == 16 and made[1]["v"] == []


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"n,v\nx,1\n")
    (tmp_path / "b.txt").write_bytes("caf\xe9 is a fine place".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {r.ext: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"csv", "txt"} and "Row 1: n: x, v: 1" in got["csv"].text and "café" in got["txt"].text
    assert files.decode_bytes("hi".encode("utf-16")) == "hi"
    cells = files.find_tables("x\n| a | b |\n|---|---|\n| 1 | 2 |\nend\np\tq\nr\ts")
    assert {(c["table_id"], c["row"], c["col"]): c["value"] for c in cells}[(0, 1, 1)] == "2" and len(cells) == 8
    files.export(spark.range(3), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 3


def test_adapters(spark):
    adapters.register(spark, lambda url: [{"name": url, "v": 1}], "demo")
    row = spark.read.format("demo").option("urls", '["http://a", "http://b"]').load().orderBy("url").first()
    assert (row.title, row.confidence) == ("http://a", 0.8)
    raw = spark.createDataFrame([("u", '{"subject": "S"}'), ("w", "{}")], "url string, body string")
    assert [r.title for r in adapters.normalise(raw, "url", "body").orderBy("url").collect()] == ["S", None]


def test_databases(spark):
    db = databases.Databases(spark, "t1_")
    db.save("First one", "entities", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    db.save("second", "entities", spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string"))
    assert db.list() == ["t1_first_one", "t1_second"] and db.merge("second", "First one", {"entities": "id"}) == {"entities": 3}
    assert sorted(r.name for r in db.table("first one", "entities").collect()) == ["B", "a", "c"]
    assert db.search("b", {"entities": "name"}, 5).count() == 2
    db.drop("first one"), db.drop("second")
    assert db.list() == []


def test_watcher_and_upsert(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    before = spark.createDataFrame(watcher.snapshot(spark, str(inbox)).collect())
    query = watcher.ingest(watcher.new_files(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (inbox / "a.txt").write_text("two!")
    (inbox / "b.txt").write_text("new")
    assert {r.change for r in watcher.changes(before, watcher.snapshot(spark, str(inbox))).collect()} == {"modified", "new"}
    stored = spark.createDataFrame([(1, "a", None)], "id long, x string, y string")
    assert {tuple(r) for r in pages.upsert(stored, spark.createDataFrame([(1, "b"), (2, "c")], "id long, x string"), "id").collect()} == {(1, "b", None), (2, "c", None)}


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS k, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7) AS ts, id FROM range(60)")
    batch = throttle.throttle_batch(rows, "k", "ts", "id", 30)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = throttle.throttle_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts", 30, "k long, ts timestamp, id long")
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("throttled").collect()) == sorted(r.id for r in batch.collect())


def test_windows_stream(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, id AS v, 'a' AS k FROM range(120)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", ["k"], "v", late="10 minutes")
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [60, 60]
    assert windows.sessions(rows.filter("v < 10 or v > 60"), "ts", "30 minutes", ["k"]).count() == 2


def test_tasks(spark):
    log = spark.createDataFrame([("a", "running", 1), ("a", "done", 2), ("b", "running", 1)], "task_id string, status string, ts long")
    assert {(r.task_id, r.status) for r in tasks.latest_state(log, "task_id", ["ts"]).collect()} == {("a", "done"), ("b", "running")}
    assert tasks.lanes(log, F.col("task_id") == "a").filter("lane = 0").count() == 2


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def _overlap(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def test_names_alike_against_all_pairs(spark):
    rng = random.Random(4)
    parts = [f"n{i}" for i in range(14)] + ["of", "the"] * 4
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(150)})
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("w", text.words("name"))
    other = rows.select(F.col("id").alias("id2"), F.col("w").alias("w2"))
    for least in (0.5, 0.85, 0.9):
        met = {(r.id, r.id2) for r in resolve.sharing_words(rows, other, "id", "id2", "w", "w2", least).collect()}
        want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if _overlap(a, b) >= least}
        assert want <= met and len(met) < len(names) ** 2
    taken, want = set(), set()
    forms = {}
    for i, a in enumerate(names):
        forms.setdefault(" ".join(sorted(set(a.split()))), i)
    heads = {}
    for f, i in forms.items():
        if f in taken:
            continue
        for g in forms:
            if g != f and g not in taken and g not in heads and forms[g] > i and _overlap(f, g) >= 0.6:
                taken.add(g)
                heads[f] = heads.get(f, []) + [g]
    group = {f: h for h, own in heads.items() for f in own}
    for i, a in enumerate(names):
        f = " ".join(sorted(set(a.split())))
        members = [j for j, b in enumerate(names) if group.get(g := " ".join(sorted(set(b.split()))), g) == group.get(f, f)]
        best = min(members, key=lambda j: (-len(names[j]), j))
        if best != i:
            want.add((best, i))
    found = resolve.dedup_scan(rows.withColumn("kind", F.lit("company")), "id", "name", "kind", "id", F.lit(0), 0.6).collect()
    assert {(r.canonical_id, r.duplicate_id) for r in found} == want


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vecs = np.round(rng.normal(size=(120, 4)), 1)
    vecs[10:40] = vecs[5]  # more ties than places
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(vecs)], "id long, g int, v array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    got = {(r.query_id, r.place): r.id for r in vectors.top_k_each(rows, rows.filter("id % 10 = 5"), "v", "id", 6, batch=4, chunk=25).collect()}
    for q in range(5, 120, 10):
        assert [got[q, p] for p in range(1, 7)] == sorted(range(120), key=lambda i: (-scores[q, i], i))[:6]
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(rows, "id", "v", F.col("g"), 0.8, chunk=10).collect()}
    assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 3 == j % 3 and scores[i, j] >= 0.8}


def test_question_mentions_of_all_turns(spark):
    rows = spark.createDataFrame([("Who is Ann Lee in Paris?",), ("Où est Marie Curie – née?",), (None,), ("",)], "t string")
    got = [r.m for r in rows.select(F.sort_array(text.mentions("t")).alias("m")).collect()]
    assert got[0] == ["Ann Lee", "Paris"] and got[1] == ["Marie Curie"] and len(got) == 4


def test_components_that_do_not_settle_are_no_result(spark):
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(RuntimeError):
        graph.connected_components(path, rounds=2)
