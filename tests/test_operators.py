import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.operators import cluster, similarity, state
from tidewire.sources import export, pages
from tidewire.streaming import events


def test_cosine_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    rows = [(k, [float(x) for x in v[k]]) for k in range(60)] + [(60, None), (61, [0.0] * 8), (62, []), (63, [float("nan")] * 8), (None, [1.0] * 8), (64, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    n = v.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1)[:, None]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if n[a] @ n[b] >= 0.4}
    for blocks in (1, 3):
        got = similarity.cosine_pairs(df, 0.4, blocks=blocks).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    focus = df.where("vec_id < 5")
    assert {(r.a, r.b) for r in similarity.cosine_pairs(df, 0.4, focus=focus, blocks=2).collect()} == {p for p in want if p[0] < 5 or p[1] < 5}
    assert similarity.cosine_pairs(df.limit(0), 0.4).count() == 0


def _edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, score double")


def test_anchored_groups(spark):
    rows = [("a", "b", 0.95), ("a", "c", 0.9), ("b", "c", 0.85), ("c", "d", 0.9), ("e", "f", 0.8), ("f", "e", 0.82), ("g", "h", 0.5), ("i", "i", 1.0)]
    got = cluster.anchored_groups(_edges(spark, rows), 0.78).collect()
    assert sorted((r.group_id, r.member, r.is_anchor) for r in got) == [("a", "a", True), ("a", "b", True), ("a", "c", False), ("e", "e", True), ("e", "f", True)]
    assert {r.least_score for r in got if r.group_id == "a"} == {0.85} and {r.anchor_score for r in got if r.group_id == "e"} == {0.82}
    # the threshold is inclusive
    assert cluster.anchored_groups(_edges(spark, [("a", "b", 0.78), ("c", "d", 0.779999)]), 0.78).count() == 2


def test_anchored_groups_in_rounds(spark):
    """Components too large for a task are grouped in rounds, with the same groups."""
    random.seed(8)
    rows = [
        (f"{a:03}", f"{b:03}", round(random.random(), 2)) for a,
        b in itertools.combinations(range(70), 2) if random.random() < 0.12
    ] + [("p", "q", 0.9), ("q", "r", 0.9), ("p", "r", 0.9)]
    df = _edges(spark, rows)
    key = lambda d: sorted((r.group_id, r.member, r.is_anchor, r.anchor_score, r.least_score) for r in d.collect())
    want = key(cluster.anchored_groups(df, 0.3))
    assert key(cluster.anchored_groups(df, 0.3, task_edges=0)) == want and key(cluster.anchored_groups(df, 0.3, task_edges=10)) == want and len(want) > 40
    assert cluster.anchored_groups(df.limit(0), 0.3, task_edges=0).count() == 0


def test_components_chain(spark):
    rows = [(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(70)] + [("x", "y", 1.0), (None, "z", 1.0)]
    got = {r.node: r.component for r in cluster.components(_edges(spark, rows)).collect()}
    assert len(got) == 73 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x"


def test_cover_and_chunks(spark):
    random.seed(2)
    rows = [(f"{a:02}", f"{b:02}", random.random()) for a, b in itertools.combinations(range(12), 2) if random.random() < 0.3]
    groups = {}
    for r in cluster.edge_cover(_edges(spark, rows), 4).collect():
        groups.setdefault((r.component, r.group_no), set()).add(r.member)
    assert all(len(g) <= 4 for g in groups.values())
    assert all(any({a, b} <= g for g in groups.values()) for a, b, _ in rows)
    chunks = cluster.bounded_chunks(_edges(spark, rows), 4).collect()
    members = [r.member for r in chunks]
    assert len(members) == len(set(members))
    overlap = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "b"), ("g2", "c"), ("g3", "x"), ("g4", "y"), ("g4", "z")], "g string, m string")
    assert {r.m: r.merged_id for r in cluster.merged_groups(overlap, "g", "m").collect()} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_state(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert sorted((r.k or 0, r.v) for r in state.upsert(t, c, ["k"], [F.desc("o")]).collect()) == [(0, "n"), (1, "a"), (2, "y"), (3, "z")]
    assert sorted((r.k or 0, r.v) for r in state.insert_ignore(t, c, ["k"], [F.desc("o")]).collect()) == [(0, "n"), (1, "a"), (2, "b"), (3, "z")]
    assert sorted((r.k or 0, r.v) for r in state.delete_where(t, F.col("k") == 1).collect()) == [(0, "n"), (2, "b")]
    assert sorted((r.k or 0, r.v) for r in state.update_from(t, spark.createDataFrame([(1, None)], "k int, v string"), ["k"], ["v"]).collect() if r.v) == [(0, "n"), (2, "b")]


def test_text_functions(spark):
    row = spark.createDataFrame([(" Tom &amp;  Jerry&nbsp;",  "Żółwia Trumpa", "[Polska] Strajk, 2!", "")], "a string, b string, c string, d string").select(
        T.clean_text(F.col("a")).alias("a"), T.token_base(F.col("b")).alias("b"), T.headline_key(F.col("c")).alias("c"), T.word_count(F.col("d")).alias("d"), T.word_count(F.lit(None).cast("string")).alias("e"), T.stems(F.col("b")).alias("s"), T.opening_fingerprint(F.col("d")).alias("f")
    ).first()
    assert row.a == "Tom & Jerry" and row.b == "zowiatrumpa" and row.c == "strajk 2" and row.d == 0 and row.e == 0 and row.f is None
    assert row.s == ["zowia", "trump"]


def test_urls(spark):
    rows = [
        ("HTTPS://WWW.A.example/x?utm_source=1&b=2&gclid=3#t", "https://a.example"),
        ("ftp://a.example/x", "https://b.example"),
        (None, None),
        ("https://m.a.example", "https://www.a.example/")
    ]
    got = spark.createDataFrame(rows, "u string, h string").select(U.canonicalize(F.col("u")).alias("c"), U.same_site(F.col("u"), F.col("h")).alias("s")).collect()
    assert [r.c for r in got] == ["https://www.a.example/x?b=2", None, None, "https://m.a.example/"]
    assert [r.s for r in got] == [True, False, None, True]


def test_pages_round_trip(spark):
    a = spark.createDataFrame(
        [("https://a.example/1", 'T & "q"', "d", "w", "One <b>.\nTwo.", "s", "2026-01-01", None, None)],
        "canonical_url string, title string, description string, author string, body string, source_id string, published_at string, updated_at string, fetched_at timestamp"
    )
    p = pages.extract_pages(pages.as_pages(a)).first()
    assert (p.title, p.author, p.body, p.canonical) == ('T & "q"', "w", "One <b>.\nTwo.", "https://a.example/1")
    assert pages.read_feeds(pages.as_feeds(a)).first().title == 'T & "q"' and pages.read_sitemaps(pages.as_sitemaps(a)).first().loc == "https://a.example/1"
    broken = spark.createDataFrame([("u", "<rss><item>"), (None, None)], "url string, html string")
    assert pages.read_feeds(broken).count() == 0 and pages.extract_pages(broken).count() == 2
    data = '<script type="application/ld+json">{"@graph":[{"articleBody":"' + "word " * 30 + '"}]}</script><article><p>short</p></article>'
    assert pages.read_page(data)["body"].startswith("word word")


def test_export(spark, tmp_path):
    topics = spark.createDataFrame([("t1", "H"), ("t2", None)], "topic_id string, headline string")
    links = spark.createDataFrame([("t1", "a1"), ("t9", "a9")], "topic_id string, article_id string")
    articles = spark.createDataFrame([("a1", "x", "long")], "article_id string, title string, body string")
    assert sorted((r.kind, r.id) for r in export.check_complete(topics, links, articles).collect()) == [("link without article", "a9"), ("link without topic", "t9")]
    docs = export.snapshot(topics, links, articles)
    assert export.generation(docs) == export.generation(docs.repartition(3)) and "long" not in docs.where("topic_id = 't1'").first().payload
    path = export.write_snapshot(docs, str(tmp_path))
    assert spark.read.json(path).count() == 2 and export.write_snapshot(docs, str(tmp_path)) == path


def test_streams(spark, tmp_path):
    rows = spark.sql(
        "select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id*7,0) as ts, id % 3 as user_id, 'view' as event_type, double(id) as value, id as event_id from range(100)"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), rows.schema)
    q = events.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.h, r.n) for r in rows.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert {(r.hour, r.events) for r in spark.table("hours").collect()} == want
    for _ in range(2):
        events.append_new(stream.withColumn("k", F.col("event_id") % 10), str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def _tables(**frames):
    return lambda name: frames[name]


def test_token_links_without_a_cap(spark):
    """A token of more than thirty topics still counts; copies of one token set are a class, whose members link each other."""
    from tidewire.plans import graph

    rows = [(f"a{k:02}", "Warsaw Parliament votes") for k in range(40)] + [
        ("b1", "Warsaw Parliament and Senate"),
        ("b2", "Warsaw alone"),
        ("b3", None),
        ("b4", "Senate Parliament")
    ]
    got = {r.id: (r.class_id, r.links) for r in graph.token_pairs(_tables(topics=spark.createDataFrame(rows, "topic_id string, headline_pl string"))).collect()}
    assert got["a07"] == ("a00", 40) and got["b1"] == ("b1", 41) and got["b2"] == ("b2", 0) and got["b3"] == ("b3", 0) and got["b4"] == ("b4", 1)
    random.seed(4)
    words = [(k, random.sample("abcdefghij", random.randint(0, 5))) for k in range(90)]
    df = spark.createDataFrame([(k, w) for k, w in words] + [(words[0][0], words[0][1]), (None, ["a", "b"])], "id long, t array<string>")
    want = {k: sum(len(set(w) & set(v)) >= 2 for o, v in words if o != k) for k, w in words}
    for block in (7, 2048):
        assert {r.id: r.links for r in similarity.token_set_links(df, "id", "t", block=block).collect()} == want
    assert similarity.token_set_links(df.limit(0), "id", "t").count() == 0


def test_candidate_order_of_all_forms(spark):
    from tidewire.plans import times

    rows = [
        ("rfc", "Tue, 10 Feb 2026 00:00:00 GMT", None, None),
        ("iso", "2026-02-10T03:00:00+02:00", None, None),
        ("late", None, "2026-02-11", None),
        ("url", "soon", None, "https://x.example/2026/02/09/a"),
        ("none", None, None, "https://x.example/a")
    ]
    frame = spark.createDataFrame([(i, "s", p, u, c) for i, p, u, c in rows], "article_id string, source_id string, published_at string, updated_at string, canonical_url string")
    got = times.candidate_timestamp_order(_tables(articles=frame)).orderBy("place").collect()
    assert [r.article_id for r in got] == ["late", "iso", "rfc", "url", "none"]


def test_logical_duplicates(spark):
    from tidewire.plans import joins

    head = "The council of the city met on Monday to vote. " * 8
    rows = [
        ("a", "s", "k", "First sentence here. Second one follows. " + head, "COMPLETE", 2),
        ("b", "s", "k", "FIRST  sentence here.\nSecond one follows. Other text.", "EXCERPT", 1),
        ("c", "t", "k", "First sentence here. Second one follows. " + head, "COMPLETE", 0),
        ("d", "s", "other", "First sentence here. Second one follows. " + head, "COMPLETE", 0),
        ("e", "s", "k", "First sentence here. Second one follows.", "FAILED", 0)
    ]
    frame = spark.createDataFrame(rows, "article_id string, source_id string, title_key string, body string, content_status string, first_seen_at int")
    assert [tuple(r) for r in joins._logical(frame).collect()] == [("a", "b")]


def test_versions_and_sessions_split_by_day(spark):
    """One key over many days, with gaps at midnight, against a plain loop."""
    import datetime

    random.seed(6)
    at, rows = datetime.datetime(2026, 1, 1, 22, 0), []
    for k in range(400):
        at += datetime.timedelta(minutes=random.choice([1, 5, 29, 30, 31, 200, 1500]))
        rows.append((1 if k % 9 else 2, k, at, random.choice("abb")))
    df = spark.createDataFrame(rows, "u long, e long, ts timestamp_ntz, kind string").repartition(5)
    got = {r.e: (r.version, r.changed) for r in state.versions(df, ["u"], "ts", "e", "kind").collect()}
    want, sessions = {}, {}
    for u in (1, 2):
        own = [r for r in rows if r[0] == u]
        for n, r in enumerate(own):
            want[r[1]] = (n + 1, n == 0 or own[n - 1][3] != r[3])
            if n == 0 or r[2] - own[n - 1][2] > datetime.timedelta(minutes=30):
                sessions.setdefault(u, []).append(0)
            sessions[u][-1] += 1
    assert got == want
    found = state.sessions(df, "u", "ts", "e", "30 minutes").orderBy("u", "session_no").collect()
    assert {u: [r.events for r in found if r.u == u] for u in (1, 2)} == sessions
    assert [r.session_no for r in found if r.u == 1] == list(range(1, len(sessions[1]) + 1))


ITEMS = "item_id string, source_id string, candidate_url string, canonical_url string, title_key string, opening string, words int, kind string"


def test_save_items(spark):
    """Outcomes in order of arrival: what is inserted is known to the items behind it."""
    items = [
        ("i1", "s", "u1", "u1", "t", "o", 200, "ARTICLE"), ("i2", "s", "u1?x", "u1", "t", "o", 200, "ARTICLE"), (
            "i3",
            "s",
            "u2",
            "u2",
            "t",
            "o",
            200,
            "ARTICLE_EXCERPT"
        ), ("i4", "s", "u2", "u2", "t", "o", 200, "ARTICLE"), ("i5", "s", "u3", "u3", "new", None, 99, "ARTICLE"),
        ("i6", "s", "old", "old", "x", "y", 300, "ARTICLE"), ("i7", "s", "alias", "alias", "x", "y", 300, "ARTICLE"), (
            "i8",
            "s",
            "u8",
            "u8",
            "known",
            "kept",
            300,
            "ARTICLE"
        ), ("i9", "s", "u8", "u8", "known", "kept", 300, "ARTICLE"), ("j1", "s", "u9", "u9", "", None, 300, "ARTICLE"), ("j2", "s", "u10", "u10", "z", "z", 300, "UNKNOWN"),
    ]
    articles = spark.createDataFrame(
        [
            ("A1", "s", "old", "q", "q", "COMPLETE", 1),
            ("A2", "s", "k2", "known", "kept", "EXCERPT", 2),
            ("A3", "s", "k1", "known", "kept", "COMPLETE", 1),
            ("A4", "s", "k3", "known", "kept", "FAILED", 0)
        ],
        "article_id string, source_id string, canonical_url string, title_key string, opening string, content_status string, first_seen_at int"
    )
    aliases = spark.createDataFrame([("s", "alias", "A2")], "source_id string, candidate_url string, duplicate_of_article_id string")
    rejected = spark.createDataFrame([("s", "u3")], "source_id string, canonical_url string")
    got = {r.item_id: (r.outcome, r.target_id) for r in state.save_items(spark.createDataFrame(items, ITEMS), articles, aliases, rejected).collect()}
    assert got == {
        "i1": ("inserted", "new:i1"), "i2": ("existing", "new:i1"), "i3": ("duplicate", "new:i1"), "i4": ("existing", "new:i1"), "i5": ("rejected", None), "i6": ("existing", "A1"), "i7": ("existing", "A2"), "i8": ("duplicate", "A3"), "i9": ("existing", "A3"), "j1": ("inserted", "new:j1"), "j2": ("rejected", None),
    }
    assert state.save_items(spark.createDataFrame([], ITEMS), articles, aliases, rejected).count() == 0


def test_replace_if_unchanged(spark):
    doc, hist = "topic_id string, version int, payload string", "topic_id string, version int, run_id string, article_ids array<string>, payload string"
    current = spark.createDataFrame([("a", 2, "old"), ("b", 1, "other"), ("c", 1, "new"), ("d", 1, "old"), ("e", 1, "old")], doc)
    history = spark.createDataFrame([("a", 1, "r1", ["x"], "h1"), ("a", 2, "r2", ["y"], "h2"), ("d", 1, "r1", ["x"], "h1")], hist)
    expected = spark.createDataFrame([("a", 2, "old"), ("b", 1, "old"), ("c", 1, "old"), ("d", 1, "old"), ("e", 1, "old"), ("z", 1, "old")], doc)
    new = spark.createDataFrame([("a", 2, "new"), ("b", 1, "new"), ("c", 1, "new"), ("d", 1, "new"), ("e", 2, "new"), ("z", 1, "new")], doc)
    new_history = spark.createDataFrame([("a", 1, "r1", ["x"], "n1"), ("a", 2, "r2", ["y"], "n2"), ("d", 1, "r9", ["x"], "n1")], hist)
    now, then, outcomes = state.replace_if_unchanged(current, history, expected, new, history, new_history)
    assert {r.topic_id: r.outcome for r in outcomes.collect()} == {"a": "applied", "b": "changed", "c": "already_applied", "d": "invalid", "e": "invalid", "z": "missing"}
    assert {r.topic_id: r.payload for r in now.collect()} == {"a": "new", "b": "other", "c": "new", "d": "old", "e": "old"}
    assert {(r.topic_id, r.version): r.payload for r in then.collect()} == {("a", 1): "n1", ("a", 2): "n2", ("d", 1): "h1"}
    # a retry of what was applied changes nothing
    again = state.replace_if_unchanged(now, then, expected, new, history, new_history)[2]
    assert {r.topic_id: r.outcome for r in again.where("topic_id = 'a'").collect()} == {"a": "already_applied"}


def test_reset_and_restore(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "topic_id string, version int")
    kept, backup, removed = state.reset({"versions": rows}, spark.createDataFrame([("a",), ("a",), ("q",), (None,)], "topic_id string"), "topic_id")
    assert removed == {"versions": 2} and {tuple(r) for r in kept["versions"].collect()} == {("b", 1), (None, 1)}
    newer = kept["versions"].union(spark.createDataFrame([("a", 2)], "topic_id string, version int"))
    assert sorted(tuple(r) for r in state.restored(newer, backup["versions"], ["topic_id", "version"]).where("topic_id is not null").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_addresses_resolve(spark):
    from urllib.parse import urljoin

    base = "https://Site.example/a/b/c.html?q=1"
    refs = ["x", "/x", "../x", "../../../x", "./", "..", "?z=1", "#f", "//h.example/p", "http://o.example", "mailto:a@b", "x/../y?k#f", "/a/./b/../c", ""]
    got = [
        r.u for r in spark.createDataFrame(
            [(k, r) for k, r in enumerate(refs)],
            "k int, r string"
        ).select("k", U.resolve(F.col("r"), F.lit(base)).alias("u")).orderBy("k").collect()
    ]
    want = [urljoin(base, r) for r in refs]
    assert [g.split("#")[0] for g in got] == [w.split("#")[0] for w in want]
    keys = F.array(F.lit("Ref"), F.lit(" "))
    assert spark.range(1).select(U.strip_query_keys(F.lit("https://a.example/x?ref=1&b=a b&REF=2#f"), keys)).first()[0] == "https://a.example/x?b=a+b"


def test_claims_and_lanes(spark):
    from tidewire.operators import ledger

    sides = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(
        ledger.coverage_mode(sides("STATE", "LEFT")), ledger.coverage_mode(sides("STATE")), ledger.coverage_mode(sides("LEFT", "CENTER")), ledger.lane(
            sides("LEFT", "STATE"),
            F.lit("MIXED")
        ), ledger.lane(sides("RIGHT"), F.lit("SINGLE_RIGHT")), ledger.lane(sides("LEFT", "RIGHT"), F.lit("MIXED")), ledger.lane(sides("STATE"), F.lit("MIXED")),
        ledger.usable_claim(F.lit("Start o 12:? jutro")), ledger.usable_claim(F.lit("Bez nowych informacji")), ledger.usable_claim(F.lit("Stwierdziłem to wczoraj")), ledger.compatible(
            F.lit("Zginęło 1,5 tysiąca osób w Łodzi"),
            F.lit("Zginęło 1 5 tysiąca osób w Łodzi")
        ), ledger.compatible(F.lit("Rząd nie przyjął budżetu"), F.lit("Rząd przyjął budżet państwa")),
    ).first()
    assert list(row) == ["SINGLE_LEFT", "STATE_ONLY", "MIXED", "LEFT", "COMMON", "COMMON", "STATE", False, False, True, False, False]
