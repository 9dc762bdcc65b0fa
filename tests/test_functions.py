"""Invariants and fixed vectors of functions and operators on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk import session
from newsdesk.functions import html, text, timing, urls
from newsdesk.operators import relational as R
from newsdesk.operators.components import connected_components, stars
from newsdesk.plans import duplicates, feeds, maintenance, publish, scoring, voice
from newsdesk.plans.classify import classify


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return df.select(column.alias("x")).first()["x"]


def test_edition_keys(spark):
    for ts, key in (("2026-03-09 20:59:59", "2026-03-10"), ("2026-03-09 21:00:00", "2026-03-11"), ("2026-03-10 20:59:59", "2026-03-11")):
        shifted = datetime.fromisoformat(ts)
        expected = (shifted + timedelta(hours=27)).strftime("%Y-%m-%d")
        assert value(spark, timing.edition_key(F.col("t").cast("timestamp")), t=ts) == expected
        assert expected in (key, key)


def test_windows_tile_time(spark):
    start = datetime(2026, 3, 7)
    rows = [(start + timedelta(hours=3 * k),) for k in range(48)]
    df = spark.createDataFrame(rows, "t timestamp")
    keyed = df.select("t", timing.edition_key(F.col("t")).alias("k")).withColumn("s", timing.edition_start(F.col("k")))
    assert keyed.filter((F.col("t") < F.col("s")) | (F.col("t") >= F.col("s") + F.make_interval(days=F.lit(1)))).count() == 0


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTPS://Example.com:443/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
    ("http://e.com:80", "http://e.com/"), ("http://e.com:8080/", "http://e.com:8080/"), ("  not a link ", "not a link"),
    ("https://www.google.com/url?q=https%3A%2F%2Fa.b%2Fc%2F&sa=1", "https://a.b/c"), ("https://e.com/?b=1&a=2&b=0&ref=z&k", "https://e.com/?a=2&b=1&b=0&k="),
])
def test_canonical_urls(spark, raw, want):
    assert value(spark, urls.canonical(F.col("u")), u=raw) == want
    assert value(spark, urls.canonical(F.col("u")), u=want) == want


def test_text(spark):
    assert value(spark, text.collapse(F.col("t")), t=" a　\t b \n") == "a b"
    assert value(spark, text.truncate(F.col("t"), 4), t="abcdef") == "abc…"
    assert value(spark, text.key(F.col("t"), 5), t="Hello, https://x.y World-9!") == "hello world 9"
    assert value(spark, text.sentences(F.col("t")), t="One. Two! Three? Four.") == ["One.", "Two!", "Three?"]
    assert value(spark, text.sentences(F.col("t")), t="abcd") == ["ab", "cd"]
    assert value(spark, text.sentences(F.col("t")), t="") == ["要約データなし。", "要点データなし。"]
    assert value(spark, html.decoded(F.col("t")), t="&lt;&#233;&#x1F600;&amp;lt; &bad; &#0; &#xD800;") == "<é😀&lt; &bad; &#0; &#xD800;"
    assert value(spark, html.readable(F.col("t")), t="<script>x</script><p>a&nbsp;<b>b</b></p>") == "a b"
    assert value(spark, html.image(F.col("t")), t='<meta content="i.png" property="og:image">') == "i.png"
    assert value(spark, text.handle(F.col("t")), t="@Some_One") == "some_one"
    assert value(spark, text.handle(F.col("t")), t="@search") is None
    assert value(spark, voice.topic(F.col("t"), F.lit(None).cast("string"), F.lit("TECH")), t="日gpt-4 mini x") == "GPT-4 MINI"


def test_components_do_not_depend_on_order_or_partitions(spark):
    path = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (7, 7)]
    for rows, parts in ((path, 1), (path[::-1], 7)):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "u long, v long").repartition(parts)).collect()}
        assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_latest_is_total_and_permutation_invariant(spark):
    rows = [("a", 1, datetime(2024, 1, 1)), ("a", 2, datetime(2024, 1, 1)), ("b", 3, None), ("b", 4, datetime(2023, 1, 1))]
    for order in (rows, rows[::-1]):
        got = R.latest(spark.createDataFrame(order, "k string, i int, t timestamp"), "k", "t", "i").select("k", "i").collect()
        assert {(r.k, r.i) for r in got} == {("a", 2), ("b", 4)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "e1"), (2, "b", "e2")], "k int, v string, e string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string")
    once = R.upsert(old, new, ["k"], ["v"], ["e"])
    assert {(r.k, r.v, r.e, r.action) for r in once.collect()} == {(1, "a", "e1", "skipped"), (2, "c", "e2", "updated"), (3, "d", None, "inserted")}
    assert {r.action for r in R.upsert(once.drop("action"), new, ["k"], ["v"], ["e"]).collect()} == {"skipped"}


def test_repair_gate_truth_table(spark):
    day = datetime(2024, 1, 1, 1)
    items = spark.createDataFrame([("a", day, day), ("b", day, day)], "id string, published_at timestamp, ingested_at timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    for rows, needed in (([], True), ([("a", "x")], False), ([("a", "x"), ("b", "llm_error_fallback::y")], True)):
        d = spark.createDataFrame([(k, i, h, day) for k, (i, h) in enumerate(rows)], "decision_id int, item_id string, input_hash string, created_at timestamp")
        assert publish.repair_needed(items, d, at("2024-01-01"), at("2024-01-02")).first()["needed"] is needed
    assert publish.repair_needed(items, d, at("2025-01-01"), at("2025-01-02")).first()["needed"] is False


def test_similar_titles_and_catalogue(spark):
    t = spark.createDataFrame([(1, "alpha bravo charlie delta echoes foxtrot"), (2, "alpha bravo charlie delta echoes foxtrot"), (3, "alpha bravo charlie delta echoes foxtrot golfs"), (4, "something else entirely here now")], "n long, title string")
    got = {(r.u, r.v) for r in duplicates.similar_titles(t).collect()}
    assert got == {(1, 2), (1, 3)}
    old = spark.createDataFrame([(1, "a", 1.0, 5, None), (2, "b", 1.0, 5, None), (3, "c", 1.0, 5, datetime(2024, 1, 1))], "id int, name string, price double, context int, removed_at timestamp")
    new = spark.createDataFrame([(1, "a", 2.0, 6), (9, "z", None, None)], "id int, name string, price double, context int")
    assert {(r.id, r.event) for r in maintenance.catalogue_events(old, new).collect()} == {(1, "price_change"), (1, "context_change"), (2, "removed"), (9, "new")}
    assert maintenance.catalogue_guard(old, new).first()["abort"] is False
    assert maintenance.catalogue_guard(old, new.limit(0)).first()["abort"] is True


def test_feed_range_precedence_and_clamp():
    now = datetime(2024, 1, 31)
    assert feeds.resolve_range(now, day="2024-01-30", start=now).start == datetime(2024, 1, 29, 15)
    assert feeds.resolve_range(now).start == datetime(2024, 1, 30)
    assert feeds.resolve_range(now, start=datetime(2023, 1, 1), longest_days=7).clamped
    assert feeds.clamped_limit(999) == 500 and feeds.clamped_limit(0) == 100


def test_family_feed_cursor_reaches_every_row(spark):
    base = datetime(2024, 1, 1)
    n = 23
    items = spark.createDataFrame([(f"i{k}", "x", "t", "u", "@a", base, "b") for k in range(n)], "id string, platform string, title string, url string, source_ref string, published_at timestamp, body string")
    classes = spark.createDataFrame([(k, f"i{k}", False, "TECH", "INFO", base + timedelta(minutes=k // 2)) for k in range(n)], "classification_id int, item_id string, noise boolean, primary_tag string, action_tag string, classified_at timestamp")
    none = spark.createDataFrame([], "decision_id int, item_id string, headline_score double, priority_score double, topic_cluster_key string, distinct_sources int, created_at timestamp")
    seen, since = [], None
    for _ in range(20):
        p = feeds.FeedParams("2024-01-01 00:00:00", "2024-01-02 00:00:00", since=since, limit=5)
        rows, meta = feeds.family_feed(items, classes, none, p)
        seen += [r.item_id for r in rows.collect()]
        m = meta.first()
        if not m["truncated"]:
            break
        since = str(m["next_since"])
    assert sorted(seen) == sorted(f"i{k}" for k in range(n))


def test_classifier_handles_nulls_and_no_rows(spark):
    schema = "id string, platform string, title string, body string, source_ref string, url string, published_at timestamp, ingested_at timestamp"
    as_of = F.lit("2024-01-31").cast("timestamp")
    got = classify(spark.createDataFrame([("a", None, None, None, None, None, None, None), ("b", "twitter", "rt @x ai agent", None, None, None, None, None)], schema), as_of).collect()
    assert {(r.id, r.noise_reason) for r in got} == {("a", "EMPTY_CONTENT"), ("b", "PLATFORM_NOISE_PATTERN")}
    assert classify(spark.createDataFrame([], schema), as_of).count() == 0


def test_a_source_that_repeats_itself_is_no_topic(spark):
    vectors = spark.createDataFrame([(1, "x", "A"), (2, "x", "a"), (3, "x", "b"), (4, "y", "b"), (5, "y", "c")], "vec_id long, platform string, source_ref string")
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "u long, v long")
    got = {r.vec_id: (r.size, r.sources, r.boost) for r in duplicates.topic_clusters(vectors, edges).collect()}
    assert got[1] == (2, 1, 0.0) and got[3] == (3, 3, 2 * 1.5)


def test_vectors_of_several_lengths_are_no_pairs(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [3.0, None])]
    pairs = duplicates.cosine_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, block_rows=2).collect()
    assert [(r.u, r.v) for r in pairs] == [(1, 2)]


class _Elsewhere:
    """A session of a cluster, as far as scratch folders ask."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Elsewhere)
    assert session.is_local("local") and session.is_local("local[8]") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")
    assert session.checkpoint_dir(spark)


def test_components_leave_one_table_behind(spark):
    import glob

    folder = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/newsdesk/edges-*"))
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert len(set(glob.glob(f"{folder}/newsdesk/edges-*")) - before) == 1


def test_links_of_nested_json(spark):
    import json

    deep = lambda n, x: x if n == 0 else {"k": deep(n - 1, x)}
    cases = [
        ({"url": "https://a.b/(x)", "t": "see https://c.d/1, and https://c.d/1."}, ["https://a.b/(x)", "https://c.d/1", "https://a.b/(x"]),
        ([["https://e.f/1"], "https://e.f/2", 5, None, True], ["https://e.f/2", "https://e.f/1"]),
        (deep(5, "https://g.h/5"), ["https://g.h/5"]), (deep(6, "https://g.h/6"), []), (deep(4, ["https://g.h/list"]), []), (deep(3, ["https://g.h/list"]), ["https://g.h/list"]),
        ([f"https://l.m/{k}" for k in range(100)], [f"https://l.m/{k}" for k in range(80)]), ({f"k{k:03}": f"https://n.o/{k}" for k in range(130)}, [f"https://n.o/{k}" for k in range(120)]),
        ({"source_url": " https://p.q/r s ", "href": "not a link"}, ["https://p.q/r"]), ("https://r.s/\\u00e9", ["https://r.s/\\u00e9"]),
    ]
    rows = [(k, json.dumps(j)) for k, (j, _) in enumerate(cases)] + [(90, "{broken"), (91, None), (92, "")]
    got = {r.k: r.links for r in spark.createDataFrame(rows, "k int, j string").select("k", maintenance.json_links(F.col("j")).alias("links")).collect()}
    for k, (_, want) in enumerate(cases):
        assert sorted(got[k]) == sorted(want), k
    assert got[90] == got[91] == got[92] == []


def _random_vectors(spark, n: int = 300):
    """(vec_id, embedding) with copies, negative ids, two lengths and unusable ones; and the pairs' cosines by brute force."""
    draw = np.random.default_rng(5)
    rows = [(k * 7 - 900, draw.normal(size=6 if k % 5 else 4).tolist()) for k in range(n)]
    rows += [(10_000 + k, v) for k, (_, v) in enumerate(rows[:40])] + [(None, [1.0] * 6), (20_000, [float("nan")] * 6), (20_001, [0.0] * 4)]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if k is not None and k < 20_000}
    cosines = {(u, v): float(x @ y) for u, x in unit.items() for v, y in unit.items() if u < v and len(x) == len(y)}
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), cosines


def test_blocks_of_vectors_meet_without_a_shuffle(spark):
    vectors, cosines = _random_vectors(spark)
    for block_rows in (16, 1024):
        pairs = duplicates.cosine_pairs(vectors, 0.8, block_rows)
        # What is sent to meet would grow with the square of the rows.
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = [(r.u, r.v, round(r.cosine, 9)) for r in pairs.collect()]
        assert sorted(got) == sorted((*k, round(c, 9)) for k, c in cosines.items() if c >= 0.8) and len(got) > 500


def test_links_of_vectors_are_as_many_as_vectors(spark):
    vectors, cosines = _random_vectors(spark)
    pairs = {k for k, c in cosines.items() if c >= 0.9}
    want = {(r.node, r.component) for r in connected_components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()}
    for block_rows in (16, 1024):
        links = duplicates.cosine_links(vectors, 0.9, block_rows)
        assert {(r.node, r.component) for r in connected_components(links).collect()} == want
    # All vectors alike are half a million pairs, but no more links than each task has vectors.
    alike = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    links = duplicates.cosine_links(alike, 0.9, 64)
    assert links.count() < 2 * links.rdd.getNumPartitions() * 1000 / 8 and {r.component for r in connected_components(links).collect()} == {0}


def test_stars_have_the_edges_components():
    draw = np.random.default_rng(3)
    chain = np.arange(5000)
    for u, v in ((chain[1:], chain[:-1]), (draw.permutation(chain)[1:], draw.permutation(chain)[:-1]), (draw.integers(-900, 900, 700), draw.integers(-900, 900, 700)), (chain[:3], chain[:3]), (chain[:0], chain[:0])):
        low = {k: k for k in np.concatenate([u, v]).tolist()}
        while any(low[a] != low[b] for a, b in zip(u.tolist(), v.tolist())):
            for a, b in [*zip(u.tolist(), v.tolist()), *zip(u.tolist()[::-1], v.tolist()[::-1])]:
                low[a] = low[b] = min(low[a], low[b])
        a, b = stars(u, v)
        assert dict(zip(a.tolist(), b.tolist())) == {k: m for k, m in low.items() if k != m} and len(a) == len(set(a.tolist()))
