"""Sources and sinks of the store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ledger
from tidewire.sources import discovery, export, pages, reports, store


def test_hydrate_is_all_or_nothing(spark):
    local = spark.createDataFrame([("a", 1)], "id string, n int")
    archive = spark.createDataFrame([("b", 2, "x"), ("b", 2, "x"), ("c", 3, "x"), ("z", 9, "x")], "id string, n int, extra string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("b",), (None,)], "id string")
    assert sorted(tuple(r) for r in store.hydrate(local, wanted, archive, "id").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(store.MissingRows) as e:
        store.hydrate(local, wanted.union(spark.createDataFrame([("q",)], "id string")), archive, "id")
    assert e.value.ids == ["q"] and e.value.count == 1


def test_pull_and_push(spark):
    local = {"t": spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, n int, own string")}
    remote = {"t": spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int"), "u": spark.createDataFrame([("k",), ("k",)], "id string")}
    got = store.pull_state(local, remote, {"t": ["id"], "u": ["id"]})
    assert sorted(tuple(r) for r in got["t"].collect()) == [("a", 1, "x"), ("b", 2, None), ("c", 3, None)] and got["u"].count() == 1
    tables = {
        "runs": spark.createDataFrame([("r1", 5), ("r0", 1)], "run_id string, started_at int"), "articles": spark.createDataFrame(
            [("a", 1), ("b", 6), ("c", 2)],
            "article_id string, first_seen_at int"
        ),
        "run_articles": spark.createDataFrame(
            [("r1", "a", 0), ("r1", "b", 0), ("r1", "c", 1), ("r0", "a", 1)],
            "run_id string, article_id string, fetched_now int"
        ), "results": spark.createDataFrame([("r1", "s")], "run_id string, source_id string"),
    }
    empty = {k: v.limit(0) for k, v in tables.items()}
    pushed, order = store.push_run("r1", tables, empty)
    assert order == ["runs", "articles", "run_articles", "results"]
    assert {r.article_id for r in pushed["articles"].collect()} == {"b", "c"} and pushed["run_articles"].count() == 3 and pushed["runs"].count() == 1
    again, _ = store.push_run("r1", tables, pushed)
    assert all(again[k].count() == pushed[k].count() for k in order)
    tables["run_articles"] = tables["run_articles"].union(spark.createDataFrame([("r1", "gone", 1)], tables["run_articles"].schema))
    with pytest.raises(store.MissingRows):
        store.push_run("r1", tables, empty)


def test_load_export(spark, tmp_path):
    schema = "id string, n int"
    (tmp_path / "a.csv").write_text('﻿payload\n"{""id"": ""x"", ""n"": 1}"\n"{""id"": ""two\\nlines"", ""n"": 2}"\n', encoding="utf-8")
    assert sorted((r.id, r.n) for r in store.load_export(spark, str(tmp_path / "a.csv"), schema).collect()) == [("two\nlines", 2), ("x", 1)]
    (tmp_path / "a.json").write_text(json.dumps([{"payload": {"id": "x", "n": 1}}, {"payload": json.dumps({"id": "y", "n": 2})}]))
    assert sorted((r.id, r.n) for r in store.load_export(spark, str(tmp_path / "a.json"), schema).collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError):
        store.load_export(spark, str(tmp_path / "b.json"), schema)


def test_backfill_and_read_only(spark, tmp_path):
    df = spark.createDataFrame([("Straße  Ⅳ", "One. Two. Three.", None), ("T", None, "given")], "title string, body string, title_key string")
    rows = store.backfilled(df).orderBy("title").collect()
    assert [r.title_key for r in rows] == ["strasse iv", "given"] and len(rows[0].opening_fingerprint) == 32 and rows[1].opening_fingerprint == ""
    df.write.parquet(str(tmp_path / "t"))
    only = store.ReadOnly(spark, str(tmp_path))
    assert only.read("t").count() == 2
    with pytest.raises(PermissionError):
        only.write("t")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456789, ["x"]), ("<a>", None, None)], "name string, v double, tags array<string>")
    paths = reports.write_report(df, str(tmp_path / "r"), "Pairs & more")
    assert spark.read.option("header", True).csv(paths["csv"]).orderBy("name").collect()[1].v == "1.234568"
    page = "".join(r[0] for r in spark.read.text(paths["html"]).collect())
    assert "&lt;a&gt;" in page and "Pairs &amp; more" in page and "<td><a>" not in page
    probes = spark.createDataFrame(
        [("s", "FULL", {"RSS": ("OK", 3, ""), "API": ("NONE", 0, "no endpoint")}, "all well")],
        "source_id string, status string, methods map<string,struct<status:string,items:int,notes:string>>, notes string"
    )
    assert sorted((r.method, r["items"], r.notes) for r in reports.flat_methods(probes).collect()) == [("API", 0, "no endpoint"), ("RSS", 3, "all well")]
    path = str(tmp_path / "jobs" / "state.json")
    assert reports.load_checkpoint(path) == {}
    reports.save_checkpoint(path, {"a": "pending"})
    reports.save_checkpoint(path, {"a": "completed"})
    assert reports.load_checkpoint(path) == {"a": "completed"}
    trail = spark.createDataFrame([], "run_id string, stage string, at string, counts string")
    trail = reports.audit(reports.audit(trail, "r", "merge", {"n": 1}, "t1"), "r", "merge", {"n": 2}, "t2")
    assert [(r.at, r.counts) for r in trail.collect()] == [("t2", '{"n": 2}')]


def test_publish(spark, tmp_path):
    docs = spark.createDataFrame([("a", "{}"), ("b", "{}")], "topic_id string, payload string")
    folder = str(tmp_path / "site")
    first = export.publish(spark, folder, docs, {"schema": 1})
    assert json.loads((tmp_path / "site" / "index.json").read_text())["snapshot"] == first.rsplit("/", 1)[-1]
    second = export.publish(spark, folder, docs.withColumn("payload", F.lit("{ }")), {"schema": 1})
    assert second != first and json.loads((tmp_path / "site" / "index.json").read_text())["snapshot"] == second.rsplit("/", 1)[-1]
    with pytest.raises(ValueError):
        export.publish(spark, folder, docs.limit(0), {})
    assert not (tmp_path / "site" / "index.json.tmp").exists()


def test_requests():
    packed = ledger.pack_requests([["a", "b"], ["c", "d", "e"], ["f"], list("ghijklm")], 4)
    assert [[x for x, _ in r] for r in packed] == [["a", "b"], ["c", "d", "e", "f"], ["g", "h", "i", "j"], ["k", "l", "m"]]
    assert {s for _, s in packed[1]} == {"local_2_1", "local_3_1"}
    overlap = ledger.pack_requests([["a", "b"], ["b", "c"]], 10, keep_overlap=True)
    assert [[x for x, _ in r] for r in overlap] == [["a", "b"], ["b", "c"]]
    assert ledger.split_request(packed[0], set()) == []
    assert sorted(map(len, ledger.split_request(packed[1], set()))) == [1, 3]
    rng = random.Random(1)
    ids = [f"n{k:02}" for k in range(12)]
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(20)}
    parts = ledger.split_request([(x, "one") for x in ids], edges)
    assert all(len(p) <= 6 for p in parts) and all(any({a, b} <= {x for x, _ in p} for p in parts) for a, b in edges)


GRAPH = """<html><head><title>Site | Story</title><meta property="og:title" content="The  story"><meta property="article:published_time" content="2026-01-02T03:04:05Z">
<link rel="canonical" href="/story"><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Site"},{"@type":"NewsArticle","headline":"Other","author":[{"name":"Ann Bell"}],"articleBody":"Linked body."}]}</script>
<script type="application/ld+json">broken {</script></head><body><nav><p>Menu</p></nav><article><h2>Part</h2><p>First <b>bold</b> text of the story, longer than the linked one.</p><figure><p>Caption</p></figure><ul><li>Item</li></ul></article>
<aside><p>More</p></aside><script>var p = "<p>no</p>";</script></body></html>"""
CLASSED = """<div class="teaser"><p>Teaser</p></div><div class="story text"><p>One.</p><div><p>Two.</p></div></div><p>After</p>"""
LINKED = """<script type="application/ld+json">[{"headline":"T","datePublished":"2026-05-06","description":"D","author":"Solo","articleBody":"A long body from the linked data of the page."}]</script><main><p>Short</p></main>"""


def test_pages_by_hand(spark):
    p = pages.read_page(GRAPH, "https://site.example/x")
    assert (p["title"], p["author"], p["published"], p["canonical"]) == ("The  story", "Ann Bell", "2026-01-02T03:04:05Z", "https://site.example/story")
    assert p["body"] == "Part\nFirst bold text of the story, longer than the linked one.\nItem"
    p = pages.read_page(LINKED, "u")
    assert (p["title"], p["author"], p["published"], p["description"], p["body"]) == ("T", "Solo", "2026-05-06", "D", "A long body from the linked data of the page.")
    df = spark.createDataFrame([("https://a.example/1", CLASSED), ("https://b.example/1", CLASSED), ("x", None)], "url string, html string")
    got = {r.url: r.body for r in pages.extract_pages(df, {"a.example": frozenset([".story"])}).collect()}
    assert got == {"https://a.example/1": "One.\nTwo.", "https://b.example/1": "", "x": ""}


def test_fragments_by_hand():
    assert discovery.fragment_text("<p>One <i>two</i></p><ul><li>Three<p>four</p></li></ul><nav><p>no</p></nav><script>x</script>") == "One two Three four"
    assert discovery.fragment_text("plain &amp; <b>bold</b>") == "plain & bold" and discovery.fragment_text("") == ""
