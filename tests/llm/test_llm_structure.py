import itertools
import os
import random
import tracemalloc

import numpy as np
import pytest

from tidewire.llm import components, incremental, mixing, packing, tokens

PAIRS = "topic_id_a string, topic_id_b string, current double, threshold double, extra string"


def test_linking_pairs(spark):
    nan = float("nan")
    rows = [
        (" a", "b ", 0.8, None, ""),
        ("b", "a", 0.1, None, ""),
        ("b", "c", 0.78, 0.78, ""),
        ("c", "d", 0.779, 0.78, ""),
        ("d", "d", 0.9, None, ""),
        (None, "e", 0.9, None, ""),
        ("e", " ", 0.9, None, ""),
        ("f", "g", nan, None, ""),
        ("f", "h", None, None, ""),
        ("f", "i", 0.7, 0.6, "")
    ]
    df = spark.createDataFrame(rows, PAIRS)
    assert {(r.u, r.v) for r in components.linking_pairs(df).collect()} == {("a", "b"), ("b", "c"), ("f", "i")}
    assert {(r.topic_id, r.group_id) for r in components.topic_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("f", "f"), ("i", "f")}
    assert components.topic_groups(df.limit(0)).count() == 0


def _groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in up}


@pytest.mark.parametrize("edges", [
    [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)], [("hub", f"s{k}") for k in range(200)], [(f"a{a}", f"a{b}") for a, b in itertools.combinations(range(8), 2)] + [("z", "y")],
    [(f"r{a}", f"r{b}") for a, b in ((random.Random(7 * k).randrange(90), random.Random(7 * k + 1).randrange(90)) for k in range(80)) if a != b],
])
def test_components_against_union_find(spark, edges):
    got = {r.node: r.group_id for r in components.connected_groups(spark.createDataFrame(edges + edges[:3], "u string, v string")).collect()}
    want = _groups(edges)
    assert got == want


@pytest.mark.parametrize("a,b", [
    (
        "https://www.A.example:443/x/?b=2&a=1#f",
        "http://a.example/x?a=1&b=2&b=2&utm_source=q"
    ), ("http://a.example:80/", "a.example"), ("https://a.example/x?fbclid=1", "https://a.example/x"),
])
def test_addresses(spark, a, b):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(a, b)], "a string, b string").select(incremental.normal_address(F.col("a")).alias("a"), incremental.normal_address(F.col("b")).alias("b")).first()
    assert r.a == r.b


def test_hashes(spark):
    from pyspark.sql import functions as F

    h = "ab" * 32
    values = [h, "SHA256:" + h.upper(), "sha-256=" + h, incremental.EMPTY_HASHES[0], "sha256:" + incremental.EMPTY_HASHES[0].upper(), None, ""]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "h string").select(incremental.normal_hash(F.col("h")).alias("h")).collect()]
    assert got == [h, h, h, None, None, None, None]


def _text(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


INCOMING = "incoming_id string, source_id string, canonical_url string, content_hash string, body string, id string, key int"
ARTICLES = "article_id string, source_id string, canonical_url string, content_hash string, body string, other string"


def test_incremental_cases(spark):
    rng = random.Random(1)
    base, fresh = _text(rng), _text(rng)
    edited = base.split()
    for k in (10, 50, 90):
        edited[k] = "changed"
    a = [
        ("A", "s", "https://a.example/1", "11", base, "x"),
        ("A", "s", "https://a.example/1", "11", base, "x"),
        ("B", "s", "https://a.example/2", None, None, "x"),
        (None, "s", "https://a.example/9", "99", base, "x")
    ]
    i = [
        ("i1", "s", "http://www.a.example/1/?utm_x=1", None, None, "q", 1), ("i2", "t", "https://a.example/1", None, "", "q", 1), (
            "i3",
            "t",
            "https://b.example/3",
            None,
            " ".join(edited).upper().replace(" ", "\n"),
            "q",
            1
        ),
        (
            "i4",
            "t",
            "https://b.example/4",
            "sha256:22",
            fresh,
            "q",
            1
        ), ("i5", "u", "https://c.example/5", "22", None, "q", 1), ("i6", "u", "https://c.example/6", None, fresh, "q", 1), ("i6", "u", "https://c.example/6", None, fresh, "q", 1),
        ("i7", "s", "https://a.example/old", None, None, "q", 1), (None, "s", "https://a.example/1", None, None, "q", 1), ("i8", None, None, incremental.EMPTY_HASHES[0], None, "q", 1), (
            "i9",
            None,
            None,
            incremental.EMPTY_HASHES[0],
            "few words",
            "q",
            1
        ),
    ]
    alias = spark.createDataFrame([("s", "https://a.example/old", "B")], "source_id string, candidate_url string, duplicate_of_article_id string")
    df, art = spark.createDataFrame(i, INCOMING), spark.createDataFrame(a, ARTICLES)
    got = {r.incoming_id: r.duplicate_of for r in incremental.duplicates(df, art, alias).collect()}
    assert got == {"i1": "A", "i3": "A", "i5": "i4", "i6": "i4", "i7": "B"}
    assert incremental.duplicates(df.limit(0), art, alias).count() == 0
    assert {r.incoming_id for r in incremental.duplicates(df, art.limit(0), alias.limit(0)).collect()} == {"i5", "i6"}


def test_only_accepted_records_count(spark):
    """i2 repeats i1, which is a case itself, so i2 is accepted and i3 repeats i2; copies stay linear."""
    rows = [
        ("i1", "s", "u://x/1", "h1", None, "", 0),
        ("i2", "t", "u://x/2", "h1", None, "", 0),
        ("i3", "t", "u://x/2", None, None, "", 0)
    ] + [(f"j{k:02}", "v", f"u://x/j{k}", "same", None, "", 0) for k in range(30)]
    art = spark.createDataFrame([("A", "s", "u://x/1", None, None, "")], ARTICLES)
    got = {r.incoming_id: r.duplicate_of for r in incremental.duplicates(spark.createDataFrame(rows, INCOMING), art, None).collect()}
    assert got == {"i1": "A", "i3": "i2"} | {f"j{k:02}": "j00" for k in range(1, 30)}


def test_similarity_against_brute_force(spark):
    rng = random.Random(9)
    texts = {}
    for k in range(12):
        base = _text(rng, rng.choice([40, 150, 400])).split()
        texts[f"A{k}"] = " ".join(base)
        for rate in (0.01, 0.03, 0.1):
            texts[f"i{k:02}-{rate}"] = " ".join(w if rng.random() > rate else "zz" + w for w in base)
    art = spark.createDataFrame([(k, "s", None, None, v, "") for k, v in texts.items() if k[0] == "A"], ARTICLES)
    inc = spark.createDataFrame([(k, "t", None, None, v, "", 0) for k, v in texts.items() if k[0] == "i"], INCOMING)
    accepted, want = {k: v for k, v in texts.items() if k[0] == "A"}, {}
    for k in sorted(x for x in texts if x[0] == "i"):
        near = [o for o, v in accepted.items() if incremental.jaccard(texts[k], v) >= 0.6]
        if near:
            want[k] = near
        else:
            accepted[k] = texts[k]
    got = {r.incoming_id: r.duplicate_of for r in incremental.duplicates(inc, art, None).collect()}
    assert set(got) == set(want) and all(got[k] in want[k] for k in got)


def test_many_versions_of_a_story(spark):
    """Edits every few words leave hardly a paragraph whole, and what is left stands in many versions; none may be lost."""
    rng = random.Random(4)
    stories, new = {}, {}
    for k in range(25):
        base = _text(rng, 160).split()
        for v in range(8):
            stories[f"A{k:02}-{v}"] = " ".join(w if rng.random() > 0.01 else f"v{v}{w}" for w in base)
        new[f"i{k:02}"] = " ".join(w if (n + k) % 22 else "zz" + w for n, w in enumerate(base))
    want = {i: near for i, x in new.items() if (near := {o for o, y in stories.items() if o[1:3] == i[1:3] and incremental.jaccard(x, y) >= 0.6})}
    art = spark.createDataFrame([(k, "s", None, None, v, "") for k, v in stories.items()], ARTICLES)
    inc = spark.createDataFrame([(k, "t", None, None, v, "", 0) for k, v in new.items()], INCOMING)
    got = {r.incoming_id: r.duplicate_of for r in incremental.duplicates(inc, art, None).collect()}
    assert len(want) > 5
    assert got == {i: min(near) for i, near in want.items()}


def test_history_in_batches(spark):
    rng = random.Random(5)
    bodies = [_text(rng) for _ in range(4)]
    schema = "id string, source_id string, canonical_url string, content_hash string, body string"
    history = incremental.History(spark, "hist_test", buckets=4)
    history.append(spark.createDataFrame([("A1", "s", "u://x/1", "h1", bodies[0])], schema))
    one = spark.createDataFrame([("b1", "s", "u://x/2", None, bodies[0].upper()), ("b2", "s", "u://x/3", None, bodies[1]), ("b3", "s", "u://x/3", None, None)], schema)
    found = history.match(one)
    assert {(r.id, r.duplicate_of) for r in found.collect()} == {("b1", "A1"), ("b3", "b2")}
    history.append(one.join(found.select("id"), "id", "left_anti"))
    two = spark.createDataFrame([("c1", "t", None, "SHA256:H1", None), ("c2", "t", None, None, bodies[1]), ("c3", "t", None, None, bodies[2])], schema)
    assert {(r.id, r.duplicate_of) for r in history.match(two).collect()} == {("c1", "A1"), ("c2", "b2")}
    # the batch's keys are shuffled (once, for the distinct too); the stored ones stay in their buckets, with fewer and with more shuffle partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        wanted = incremental.at_home(incremental.piece_rows(two, None), history.buckets)
        plan = history.table("pieces").where("size > 0").join(wanted, "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    spark.conf.set("spark.sql.shuffle.partitions", before)
    history.drop()
    assert not spark.catalog.tableExists("hist_test_pieces")


@pytest.mark.parametrize("words", [20, 30, 45, 60, 150])
def test_recall_by_length(spark, words):
    """Random texts with evenly spread single-word edits against brute force: none is lost, none too many, at any length."""
    rng = random.Random(words)
    old, new = {}, {}
    for k in range(60):
        base = _text(rng, words).split()
        old[f"A{k:02}"] = " ".join(base)
        for edits in range(0, 1 + words // 12):
            changed, offset = list(base), rng.randrange(words)
            for e in range(edits):
                changed[(offset + e * words // max(1, edits)) % words] = f"new{e}"
            new[f"i{k:02}-{edits}"] = ", ".join(changed)
    want, accepted = {}, dict(old)
    for i in sorted(new):
        near = [o for o in accepted if o[1:3] == i[1:3] and incremental.jaccard(new[i], accepted[o]) >= 0.6]
        if near:
            want[i] = near
        else:
            accepted[i] = new[i]
    art = spark.createDataFrame([(k, "s", None, None, v, "") for k, v in old.items()], ARTICLES)
    inc = spark.createDataFrame([(k, "t", None, None, v, "", 0) for k, v in new.items()], INCOMING)
    got = {r.incoming_id: r.duplicate_of for r in incremental.duplicates(inc, art, None).collect()}
    assert len(want) >= 60 and set(got) == set(want) and all(got[i] in want[i] for i in got)


def test_pieces_against_plain_python():
    rng = random.Random(11)
    texts = [
        "",
        "few words here only",
        "a b c d e",
        "A, b; C d-e\nF!",
        "x " * 300,
        "ж" * 9 + " б в г д е"
    ] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    keys, owner, h = incremental.text_pieces(texts)
    by = {}
    for k, t in enumerate(texts):
        words = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in t).split()
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        assert (owner == k).sum() == len(own) and bool(keys[k]) == bool(own)
        for x in range(max(0, k - 3), k):
            ws = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in texts[x]).split()
            other = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
            assert len(set(h[owner == k].tolist()) & set(h[owner == x].tolist())) == len(own & other)
        by[k] = own


def test_order_of_pieces_is_small_on_the_driver(spark):
    texts = [" ".join(f"w{(k * 7 + j) % 97}" for j in range(40)) for k in range(60)] + ["", None, "four words no piece"]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    tracemalloc.start()
    often = incremental.piece_order(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # the table has 4 MB; with its counts as numbers of 4 and 8 bytes it was 84
    pieces = incremental.text_pieces([t for t in texts if t])[2]
    counts = np.bincount((pieces >> np.uint64(64 - incremental.COUNTER_BITS)).astype(np.int64), minlength=len(often))
    assert often.dtype == np.uint8 and (often == np.minimum(255, np.round(8 * np.log2(np.maximum(counts, 1))))).all()


def test_order_changes_no_result():
    """With any table of how often pieces are used, sets that have three fifths of their union in common share a stored piece."""
    import numpy as np

    rng = random.Random(12)
    for _ in range(30):
        base = _text(rng, rng.choice([12, 20, 45, 90])).split()
        other = [w if rng.random() > 0.04 else "z" + w for w in base]
        pair = [" ".join(base), " ".join(other)]
        often = np.random.default_rng(rng.randrange(99)).integers(0, 256, 1 << incremental.COUNTER_BITS).astype(np.uint8)
        _, owner, h = incremental.text_pieces(pair)
        own, left, _ = incremental.kept(owner, h, often)
        if incremental.jaccard(*pair) >= 0.6:
            assert set(left[own == 0].tolist()) & set(left[own == 1].tolist())


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([1, 3, 60, 60, 60, 200, 255, 256, 300, 700, 9000])) for k in range(900)] + [(900, 0), (901, None), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    for capacities in ([256], [256, 512, 1024, 4096]):
        got = packing.pack(df, capacities).collect()
        placed = [r for r in got if r.container_id is not None]
        fill, size = {}, {}
        for r in placed:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            assert size.setdefault(r.container_id, r.capacity_tokens) == r.capacity_tokens and r.capacity_tokens in capacities
        assert all(fill[c] <= size[c] for c in fill)
        assert all(size[c] == min(x for x in capacities if x >= fill[c]) for c in fill)
        by = {}
        for r in placed:
            by.setdefault(r.doc_id, []).append(r.tokens)
        assert all(sum(by[k]) == n and (len(by[k]) == 1 or n > max(capacities)) for k, n in rows[:900])
        assert {r.doc_id for r in got if r.container_id is None} == {900, 901}
        assert sum(fill.values()) / sum(size.values()) > 0.9
        assert {(r.doc_id, r.piece_no): r.container_id for r in packing.pack(df.repartition(3), capacities).collect()} == {(r.doc_id, r.piece_no): r.container_id for r in got}
    assert packing.pack(df.limit(0), [256]).count() == 0
    each = packing.pack_each(df, [256, 512]).where("container_id is not null")
    assert {r.capacity_tokens for r in each.select("capacity_tokens").distinct().collect()} == {256, 512}


def test_least_cost_opening():
    # 60 and 40 fill 100, so 128 for 60 alone would cost more; 256 takes 200 and 56
    assert packing.least_cost([40, 60], {40: 5, 60: 1}, 60, 1, [100, 128]) == 100
    assert packing.least_cost([56, 200], {56: 3, 200: 2}, 200, 2, [210, 256]) == 256
    assert packing.least_cost([7], {7: 1}, 7, 1, [10, 20]) == 10
    rng = random.Random(8)
    for _ in range(20):
        counts = {rng.randint(1, 300): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        best = packing.best_plan(counts, [256, 300, 512])
        assert best.used == sum(s * n for s, n in counts.items()) and best.total <= min(packing.plan_counts(counts, [256, 300, 512], x).total for x in (None, 0, 256, 300, 512))


def test_mixture(spark):
    rng = random.Random(3)
    sizes = {f"h{k}": rng.randint(5, 60) for k in range(700)}
    rows, n = [], 0
    for k in range(600):
        rows.append((n, rng.choice("aaaabbc"), f"h{k}", sizes[f"h{k}"]))
        n += 1
    for k in range(80):  # texts of two sources
        for s in "ac":
            rows.append((n, s, f"h{600 + k}", sizes[f"h{600 + k}"]))
            n += 1
    rows += [(n, "a", "h1", sizes["h1"]), (n + 1, None, "h2", 9), (n + 2, "zz", "h3", 9), (n + 3, "b", "h699", 0), (None, "b", "h650", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text_hash string, tokens long")
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4)}
    got = mixing.mixture(df, targets).collect()
    total, by = 0, {}
    for r in got:
        assert 1 <= r.uses <= targets[r.source][1]
        by[r.source] = by.get(r.source, 0) + r.uses * r.tokens
        total += r.uses * r.tokens
    assert all(abs(by[s] / total - share) < 0.02 for s, (share, _) in targets.items())
    assert len({(r.doc_id, r.source) for r in got}) == len(got)
    assert sorted(map(tuple, mixing.mixture(df.repartition(5), targets).collect())) == sorted(map(tuple, got))
    report = {
        r.source: r for r in mixing.reached_shares(
            spark.createDataFrame(got),
            spark.createDataFrame([(s, x, m) for s, (x, m) in targets.items()], "source string, target_share double, max_repeats int")
        ).collect()
    }
    assert abs(report["a"].share - by["a"] / total) < 1e-5
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_flow_is_largest():
    total, flows = mixing.route({("a",): 100, ("b",): 10, ("a", "b"): 20}, {"a": (0.5, 1), "b": (0.5, 3)})
    # b reaches 10 * 3 + 20 * 3 at most, a 100 of its own
    assert 178 <= total <= 181 and sum(v for (p, s), v in flows.items() if s == "b") == total // 2


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "żółw " * 500)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] >= 500


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["p3_repeated", "p4_found"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidewire.llm import queries

    con = duckdb.connect()
    for table in ("articles", "pairs"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(queries.ORACLES[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got) > 0
