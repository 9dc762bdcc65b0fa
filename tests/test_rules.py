"""Rules by hand-made cases, each expectation taken from the rule's definition before any query."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import text, urls, variants
from newsdesk.plans import evaluation, lifecycle, maintenance, publish, scoring
from newsdesk.sources import community


def one(spark, schema, rows, **columns):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    got = df.select(*[c.alias(k) for k, c in columns.items()]).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in got]


LADDER = [
    # score, confidence, trusted, sample, flags -> status
    (90.0, 0.9, 5, "good", ["spam links"], "rejected"), (90.0, 0.9, 5, "good", ["IMPERSONATES a lab"], "rejected"), (44.9, 1.0, 9, "good", [], "rejected"), (45.0, 1.0, 9, "good", [], "watch"), (64.9, 1.0, 9, "good", [], "watch"),
    (65.0, 0.0, 1, "mixed", [], "needs_review"), (65.0, 1.0, 1, "poor", [], "watch"), (77.9, 1.0, 0, "good", [], "watch"), (77.9, 0.1, 2, "good", ["noisy"], "needs_review"),
    (78.0, 0.65, 2, "poor", [], "needs_review"), (78.0, 0.65, 1, "good", [], "needs_review"), (78.0, 0.65, 1, "mixed", [], "watch"), (78.0, 0.64, 9, "good", [], "watch"), (100.0, 1.0, 0, "good", [], "watch"),
]


def test_candidate_ladder_never_approves(spark):
    got = one(
        spark, "score double, sure double, n int, sample string, flags array<string>, want string", LADDER,
        status=evaluation.candidate_status(F.col("score"), F.col("sure"), F.col("n"), F.col("sample"), F.col("flags")),
    )
    assert got == [r[-1] for r in LADDER]


def test_prefilter_of_candidates(spark):
    rows = [(None, None, None, True), (" ", 99, [], True), ("", 100, [], False), ("bio", 0, [], False), (None, 3, ["x"], False), (None, 50, None, True)]
    got = one(spark, "bio string, n int, samples array<string>, want boolean", rows, poor=evaluation.prefiltered(F.col("bio"), F.col("n"), F.col("samples")))
    assert got == [r[-1] for r in rows]


def test_predictions_take_no_value_of_another_type(spark):
    rows = [
        '{"score":120,"confidence":-1,"category":"ads","recommendation":"reject","riskFlags":[" a ","",3,"b"],"sampleQuality":"good","reason":"  why  "}',
        '{"score":"70","confidence":null,"category":"cars","riskFlags":"spam","sampleQuality":1,"reason":7}', "{}", "no", "", None, "[1]", json.dumps({"score": 1.5, "riskFlags": [str(k) for k in range(20)], "reason": "r" * 300}),
    ]
    got = one(spark, "a string", rows, p=evaluation.prediction(F.col("a")))
    default = (0.0, 0.5, "other", "watch", [], "mixed", "")
    want = [(100.0, 0.0, "ads", "reject", ["a", "b"], "good", "why"), default, default, None, None, None, default, (1.5, 0.5, "other", "watch", [str(k) for k in range(12)], "mixed", "r" * 200)]
    assert [None if p is None else tuple(p) for p in got] == want


def test_pending_candidates_are_the_most_mentioned(spark):
    rows = [(f"h{k:02d}", "pending" if k != 3 else "watch", k != 4, None if k != 5 else 1, k // 2) for k in range(30)]
    df = spark.createDataFrame(rows, "handle string, status string, profile_fetched boolean, evaluated_at int, mention_count int")
    want = sorted((r for r in rows if r[1] == "pending" and r[2] and r[3] is None), key=lambda r: (-r[4], r[0]))[:20]
    assert [r.handle for r in evaluation.pending(df).collect()] == [r[0] for r in want]


def test_trust_is_unknown_for_young_sources(spark):
    base = (30, 30, 0, 0.9, 15, 80.0, 0.5, 50.0)
    rows = [(1, "2024-01-01", "high", *base), (2, "2024-01-17 00:00:00", "high", *base), (3, "2024-01-17 00:00:01", "high", *base), (4, "2024-01-30", "blocked", *base), (5, "2024-01-01", "high", 30, 14, *base[2:])]
    df = spark.createDataFrame(rows, "source_id int, made string, trust_label string, classes_28 int, classified_28 int, noise_28 int, mean_score double, adopted_28 int, mean_priority double, mean_originality double, ai_score double")
    df = df.withColumn("created_at", F.col("made").cast("timestamp")).withColumn("latest_at", F.lit("2024-01-30").cast("timestamp"))
    got = {r.source_id: (r.new_label == "unknown", r.cold_start, r.new_label == "blocked") for r in scoring.trust_scores(df, F.lit("2024-01-31").cast("timestamp")).collect()}
    assert got == {1: (False, False, False), 2: (False, False, False), 3: (True, True, False), 4: (False, True, True), 5: (True, True, False)}


AS_OF = "2024-03-01 00:00:00"


def summary(spark, rows):
    """source_id, type, active, created, cooldown, classified, classes, noise, priority, trust."""
    df = spark.createDataFrame(rows, "source_id int, type string, active boolean, made string, until string, classified_28 int, classes_28 int, noise_28 int, mean_priority double, trust_score int")
    return df.withColumn("created_at", F.col("made").cast("timestamp")).withColumn("cooldown_until", F.col("until").cast("timestamp"))


def test_lifecycle_acts_on_old_active_discovered_sources_out_of_cooldown(spark):
    ok = ("discovered", True, "2024-01-01", None, 20, 20, 0, 50.0)
    rows = [
        (1, *ok, 44), (2, *ok, 45), (3, "seed", *ok[1:], 10), (4, "discovered", False, *ok[2:], 10), (5, *ok[:2], "2024-02-16 00:00:00", *ok[3:], 10), (6, *ok[:2], "2024-02-15 23:59:59", *ok[3:], 10),
        (7, *ok[:3], "2024-03-02", *ok[4:], 10), (8, *ok[:3], "2024-03-01", *ok[4:], 10), (9, *ok[:4], 19, *ok[5:], 10), (10, *ok[:6], 18, 50.0, 80), (11, *ok[:7], 1.0, 80), *[(k, *ok, 90) for k in range(20, 40)],
    ]
    got = {r.source_id: (r.condition_keys, r.severe, r.should_act) for r in lifecycle.flags(summary(spark, rows), F.lit(AS_OF).cast("timestamp")).collect()}
    # The bottom decile is that of the scanned sources, 50 but for one; everyone at it counts as low.
    assert 3 not in got and 4 not in got
    assert {k: v[2] for k, v in got.items() if k < 20} == {1: True, 2: True, 5: False, 6: True, 7: False, 8: True, 9: False, 10: True, 11: True}
    assert got[1][0] == ["low_priority", "low_trust"] and got[2][0] == ["low_priority"] and got[10][:2] == (["noisy", "low_priority"], True)


def events(spark, rows):
    df = spark.createDataFrame(rows, "source_id int, day string, event_id long, action string, severe boolean, condition_keys array<string>")
    return df.withColumn("at", F.col("day").cast("timestamp")).drop("day")


def test_lifecycle_confirms_waits_and_demotes(spark):
    flagged = spark.createDataFrame([(k, ["noisy"], k == 2, k != 9) for k in range(1, 10)], "source_id int, condition_keys array<string>, severe boolean, should_act boolean")
    history = events(spark, [
        (1, "2024-02-23", 1, "demote", False, ["low_trust", "noisy"]), (2, "2024-02-22", 2, "demote", False, ["noisy"]), (3, "2024-02-21 23:59:59", 3, "demote", False, ["noisy"]), (4, "2024-02-25", 4, "demote", False, ["noisy"]),
        (5, "2024-02-23", 5, "demote", False, ["low_trust"]), (6, "2024-02-23", 6, "demote", False, ["noisy"]), (6, "2024-02-24", 7, "restore", False, []), (7, "2024-02-20", 8, "restore", False, []), (7, "2024-02-23", 9, "demote", False, ["noisy"]),
        (9, "2024-02-23", 10, "demote", False, ["noisy"]),
    ])
    as_of = F.lit(AS_OF).cast("timestamp")
    acted = lifecycle.actions(flagged, history, as_of)
    got = {r.source_id: (r.action, r.reason) for r in acted.collect()}
    off, again, wait = ("deactivate", "lifecycle:noisy"), ("demote", "lifecycle:noisy"), ("skip", "lifecycle:noisy:awaiting_second_window")
    assert got == {1: off, 2: off, 3: again, 4: wait, 5: again, 6: again, 7: off, 8: again}
    sources = spark.createDataFrame([(k, True, "high") for k in range(1, 10)], "source_id int, active boolean, trust_label string").withColumns({c: F.lit(None).cast("timestamp") for c in ("cooldown_until", "deactivated_at")})
    log = lifecycle.written(history, acted, as_of)
    assert log.count() == history.count() + 7
    kept = lifecycle.applied(lifecycle.folded(sources, history), acted, as_of)
    order = lambda df: sorted(map(tuple, df.select("source_id", "active", "trust_label", "cooldown_until", "deactivated_at").collect()))
    assert order(lifecycle.folded(sources, log)) == order(kept)
    state = {r[0]: r[1:3] for r in order(kept)}
    assert state[1] == (False, "high") and state[2] == (False, "blocked") and state[6] == (True, "high")


def test_restored_sources_are_no_longer_blocked(spark):
    sources = spark.createDataFrame([(1, False, "blocked"), (2, False, "low")], "source_id int, active boolean, trust_label string").withColumns({c: F.lit("2024-02-01").cast("timestamp") for c in ("cooldown_until", "deactivated_at")})
    got = lifecycle.folded(sources, events(spark, [(1, "2024-02-20", 1, "restore", False, [])])).select("source_id", "active", "trust_label", F.col("cooldown_until").cast("string"), F.col("deactivated_at").cast("string")).collect()
    assert sorted(map(tuple, got)) == [(1, True, "unknown", "2024-03-21 00:00:00", None), (2, False, "low", "2024-02-01 00:00:00", "2024-02-01 00:00:00")]


@pytest.mark.parametrize("title,badge,want", [
    ("a  b", "[2媒体が言及]", "[2媒体が言及] a b"), (None, "[x]", "[x]"), ("  ", "[x]", "[x]"), ("old [x] news", "[x]", "[x] old news"), ("[x] news [x]", "[x]", "[x] news [x]"), ("[x]", "[x]", "[x]"), ("kept  as is", None, "kept  as is"),
])
def test_badges_move_to_the_front(spark, title, badge, want):
    assert one(spark, "t string, b string", [(title, badge)], v=text.prepend_badge(F.col("t"), F.col("b"))) == [want]


@pytest.mark.parametrize("value,want", [(None, "[x]"), ("", "[x]"), ("a [x] b", "a [x] b"), ("a", "a [x]")])
def test_badges_are_appended_once(spark, value, want):
    assert one(spark, "t string, b string", [(value, "[x]")], v=text.append_badge(F.col("t"), F.col("b"))) == [want]


ROWS = "id string, section string, title string, platform string, url string, position int, topic_cluster_key string, distinct_sources int, trust_label string, final_headline_score double, priority_score double, score double"


def test_representative_is_weighed_by_trust(spark):
    row = lambda i, p, key, n, label, f, pr, s: (i, "4_tech", f"t{i}", "github", f"https://github.com/O/{key or i}.git#{i}", p, key, n, label, f, pr, s)
    rows = [
        row("a", 1, "k1", 2, "low", 100.0, 0.0, 0.0), row("b", 2, "k1", 3, "high", 79.0, 0.0, 0.0),  # 80 against 85.32
        row("c", 3, "k2", 2, "medium", 5.0, 10.0, 0.1), row("d", 4, "k2", 1, "medium", 5.0, 11.0, 0.0),  # priority
        row("e", 6, "k3", 2, "medium", 5.0, 1.0, None), row("f", 5, "k3", None, "medium", 5.0, 1.0, 0.0),  # position
        row("g", 7, "k4", 1, "medium", 1.0, 1.0, 1.0), row("h", 8, "k4", 1, "medium", 2.0, 1.0, 1.0),  # one source: stays
        row("i", 9, "", 5, "medium", 1.0, 1.0, 1.0), row("j", 10, "", 5, "medium", 1.0, 1.0, 1.0), row("k", 11, None, 5, None, 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: (r.section == "1_latest_ai_news", r.title, r.distinct_sources) for r in publish.collapsed_topics(df).collect()}
    same = {r[0]: (False, f"t{r[0]}", r[7]) for r in rows if r[0] in "ghijk"}
    assert got == {"b": (True, "[3媒体が言及] tb", 3), "d": (True, "[2媒体が言及] td", 2), "f": (True, "[2媒体が言及] tf", 2), **same}
    repos = {r.id: r.title for r in publish.collapsed_repositories(df).collect()}
    assert repos == {"b": "[o/k1 更新2件] tb", "d": "[o/k2 更新2件] td", "f": "[o/k3 更新2件] tf", "h": "[o/k4 更新2件] th", **{k: f"t{k}" for k in "ijk"}}


@pytest.mark.parametrize("url,want", [
    (" https://E.com/Path/?a=B#Frag ", "https://e.com/Path/?a=B#Frag"), ("HTTP://E.com:80", "http://e.com"), ("https://e.com/a/", "https://e.com/a"), ("https://e.com/a//", "https://e.com/a/"), ("https://e.com:443/?q=/", "https://e.com/?q="),
    ("https://e.com/?utm_source=x&b=2", "https://e.com/?utm_source=x&b=2"), ("not a url/", "not a url"), ("  ", None), (None, None),
])
def test_article_keys_keep_queries_and_case(spark, url, want):
    assert one(spark, "u string", [(url,)], v=urls.article_key(F.col("u"))) == [want]


@pytest.mark.parametrize("value,want", [
    ("see [a](https://a.com/x) https://b.com", "https://a.com/x"), ("see https://b.com/) and [a](https://a.com)", "https://b.com/"), ("[t](HTTP://Q.com/y z)", "HTTP://Q.com/y"), ("none", None), (None, None), ("[a](ftp://x) [b](https://c.d)", "https://c.d"),
])
def test_first_links(spark, value, want):
    assert one(spark, "t string", [(value,)], v=urls.first_link(F.col("t"))) == [want]


def test_article_badges_take_the_first_marked_item(spark):
    bound = spark.createDataFrame([("https://e.com/a", 3, "low"), ("https://E.com/a/", 2, "unknown"), ("https://e.com/a", 1, "high"), ("https://e.com/b", 4, "medium"), (None, 5, "low")], "url string, position int, trust_label string")
    articles = spark.createDataFrame([(1, "[x](https://e.com/a)"), (2, "https://e.com/b"), (3, "no link"), (4, None), (5, "https://e.com/A")], "n int, source string")
    assert {r.n: r.badge for r in publish.article_badges(articles, bound).collect()} == {1: "未検証/単一ソース", 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("raw,number,label", [
    (None, None, "free"), ("", None, "free"), ("x1", None, "free"), ("0", 0.0, "free"), (" 0.0 ", 0.0, "free"), ("0.0000015", 1.5e-6, "$1.50/M"), ("2e-6 per token", 2e-6, "$2.00/M"), (".5x", 0.5, "$500000.00/M"), ("-1", -1.0, "$-1000000.00/M"), ("1.", 1.0, "$1000000.00/M"),
])
def test_prices(spark, raw, number, label):
    assert one(spark, "r string", [(raw,)], p=maintenance.price(F.col("r")), m=maintenance.per_million(maintenance.price(F.col("r")))) == [(number, label)]


def test_missing_prices_are_free(spark):
    rows = [(None, None, True), (0.0, None, True), (0.0, 0.0, True), (1.0, None, False), (None, 1.0, False), (0.0, -1.0, False)]
    assert one(spark, "p double, c double, w boolean", rows, free=maintenance.is_free(F.col("p"), F.col("c"))) == [r[-1] for r in rows]


GOOD = {"schema_version": 1, "platform": "x", "identifier": "Acc_1", "topic": "AI & ads", "language": "en", "submitted_by": "octo-cat", "first_seen": "2024-01-30"}
FILES = [
    # content, name, (check, path) of each failure
    (GOOD, "x--acc_1.json", []), ({**GOOD, "identifier": "a" * 16}, "x--" + "a" * 16 + ".json", [("C5", "identifier")]), ({**GOOD, "identifier": "Home"}, "x--home.json", [("C5", "identifier")]), ({**GOOD, "identifier": "Zz"}, "x--zz.json", [("C5", "identifier")]),
    ({**GOOD, "identifier": "a_b2", "topic": "ab"}, "x--a_b2.json", [("C7", "topic")]), ({**GOOD, "identifier": "a_b3", "topic": "x" * 81}, "x--a_b3.json", [("C7", "topic")]), ({**GOOD, "identifier": "a_b4", "topic": "bad​one"}, "x--a_b4.json", [("C7", "topic")]),
    ({**GOOD, "identifier": "a_b5", "topic": "two\nlines"}, "x--a_b5.json", [("C7", "topic")]), ({**GOOD, "identifier": "a_b6", "topic": "日本の広告"}, "x--a_b6.json", []), ({**GOOD, "identifier": "a_b7", "topic": "emoji 😀 no"}, "x--a_b7.json", [("C7", "topic")]),
    ({**GOOD, "identifier": "a_b8", "language": "EN", "submitted_by": "a--b", "first_seen": "2024-02-01"}, "x--a_b8.json", [("C4", "language"), ("C4", "submitted_by"), ("C4", "first_seen")]),
    ({**GOOD, "identifier": "a_b9", "first_seen": "2006-01-01"}, "x--a_b9.json", []), ({**GOOD, "identifier": "a_c1", "first_seen": "2023-02-29"}, "x--a_c1.json", [("C4", "first_seen")]), ({**GOOD, "identifier": "a_c2"}, "x--A_c2.json", [("C4", "name")]),
    ({**GOOD, "schema_version": "1", "platform": 3}, "x--acc_1b.json", [("C4", "schema_version"), ("C4", "platform")]), ({k: v for k, v in GOOD.items() if k != "topic"}, "x--acc_1c.json", [("C4", "topic")]), ({**GOOD, "more": 1}, "x--acc_1d.json", [("C4", "root")]),
    ([1], "x--l.json", [("C4", "root")]), (b"{", "x--j.json", [("C4", "file")]), (b"\xff{}", "x--u.json", [("C4", "file")]), (b"\xef\xbb\xbf{}", "x--b.json", [("C4", "file")]), (b" " * 2049, "x--s.json", [("C4", "file")]), (None, "x--n.json", [("C4", "file")]),
    ({**GOOD, "identifier": "Twin"}, "x--twin.json", [("C6", "identifier")]), ({**GOOD, "identifier": "tWIN", "language": "e"}, "x--twin.json", [("C4", "language"), ("C6", "identifier")]),
]


def test_community_files_tell_every_failure(spark):
    rows = [(n, str(k), c if isinstance(c, bytes) or c is None else json.dumps(c, ensure_ascii=False).encode()) for k, (c, n, _) in enumerate(FILES)]
    df = spark.createDataFrame(rows, "name string, note string, content binary").repartition(3)
    got = sorted((r.name, sorted((f.check, f.path) for f in r.failures)) for r in community.validated(df, F.lit("2024-01-31")).collect())
    assert got == sorted((n, sorted(f)) for _, n, f in FILES)


@pytest.mark.parametrize("value", [0, 1, -1, 10, 100, 1.5, -0.25, 1e20, 1e21, 123456789012345680000, 1.5e21, 1e-6, 1.5e-7, 123e-9, 0.000001234, 1e300, 2.5e-308, 12345.678, 1e5, -1e21, 100.50])
def test_numbers_print_as_in_javascript(spark, value):
    import decimal

    # The shortest digits that give the double, laid out by the language's rule.
    digits = decimal.Decimal(repr(float(value))).normalize().as_tuple()
    d, n = "".join(map(str, digits.digits)), len(digits.digits) + digits.exponent
    if float(value) == 0:
        want = "0"
    elif len(d) <= n <= 21:
        want = d + "0" * (n - len(d))
    elif 0 < n <= 21:
        want = d[:n] + "." + d[n:]
    elif -6 < n <= 0:
        want = "0." + "0" * -n + d
    else:
        want = d[0] + ("." + d[1:] if len(d) > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    assert one(spark, "x double", [(float(value),)], v=variants.number_text(F.col("x"))) == [("-" if value < 0 else "") + want]


def test_canonical_json_is_the_same_for_permuted_keys(spark):
    rows = ['{"b":[{"z":1.0,"a":null},2],"a":"x \\" 1.0 y"}', '{"a":"x \\" 1.0 y","b":[{"a":null,"z":1},2.00]}', '{"k":{"é":1e3,"e":1e21,"d":[]}}', "[1, 2.50, -0.0, true, null, \"1\"]", "3", "no json", None]
    want = ['{"a":"x \\" 1.0 y","b":[{"a":null,"z":1},2]}'] * 2 + ['{"k":{"d":[],"e":1e+21,"é":1000}}', '[1,2.5,0,true,null,"1"]', "3", None, None]
    assert one(spark, "j string", rows, v=variants.canonical(F.try_parse_json("j"))) == want


def test_a_text_is_scanned_once_for_all_keywords(spark, sf):
    from newsdesk.queries import QUERIES

    for name in ("rules_classify", "voice_sentiment", "matched_signals"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        # The operator stands in the tree and in the list of the plan's nodes at most.
        assert plan.count("ArrowEvalPython") == 1, name


def test_held_keywords_are_substrings(spark):
    words = ["ai", "agent", "agentic ai", "AI act", "規制", "c++", "a.i"]
    texts = ["", None, "agentic ai act", "the ai-agent", "規制と ai", "c+ a-i", "c++ said a.i.", "aiai"]
    got = one(spark, "t string", texts, v=text.held(F.col("t"), words))
    assert [sorted(v) for v in got] == [sorted({w.lower() for w in words if t and w.lower() in t}) for t in texts]
    counts = one(spark, "t string", texts, n=text.hits(text.held(F.col("t"), words), ["AI", "ai", "agent"]), m=text.matches(text.held(F.col("t"), words), ["Agent", "AI"], "p"))
    assert [n for n, _ in counts] == [2 * ("ai" in (t or "")) + ("agent" in (t or "")) for t in texts]
    assert [m for _, m in counts] == [[f"p:{w}" for w in ("agent", "ai") if w in (t or "")] for t in texts]


def test_sweeps_fail_wholly_or_in_part(spark):
    rows = [
        ("a", "collector", True, 3, 0), ("a", "collector", True, 0, 0), ("a", "summary", False, 0, 0), ("b", "collector", True, 2, 2), ("c", "collector", False, 0, 0), ("c", "collector", True, 0, 0),
        ("d", "collector", False, 0, 0), ("d", "collector", True, 5, 1), ("e", "collector", True, 0, 0), ("f", "summary", True, 0, 0), ("f", "summary", True, 9, 9),
    ]
    df = spark.createDataFrame(rows, "sweep string, kind string, ok boolean, sources int, errors int")
    got = {r.sweep: (r.collectors, r.failed, r.sources, r.errors, r.has_failures, r.all_failed) for r in maintenance.sweeps(df).collect()}
    assert got == {"a": (2, 0, 3, 0, True, False), "b": (1, 0, 2, 2, True, True), "c": (2, 1, 0, 0, True, True), "d": (2, 1, 5, 1, True, False), "e": (1, 0, 0, 0, False, False), "f": (0, 0, 0, 0, False, False)}


def test_only_unsettled_rows_are_asked_again(spark):
    from newsdesk.plans.models import settled

    rows = spark.createDataFrame([(k, k % 4) for k in range(20)], "k int, hard int")
    seen = []

    def ask(d):
        seen.append(sorted((r.k, r.problem) for r in d.select("k", "problem").collect()))
        return d.withColumn("answer", F.concat_ws("|", F.col("k").cast("string"), F.coalesce("problem", F.lit(""))))

    judged = lambda d: d.withColumn("problem", F.when(F.length("answer") - F.length(F.replace("answer", F.lit("x"), F.lit(""))) < F.col("hard"), F.concat(F.lit("x"), F.element_at(F.split("answer", "[|]"), 2))))
    got = {r.k: (r.attempts, r.problem is None) for r in settled(rows, ask, judged, 3).collect()}
    assert got == {k: (min(k % 4 + 1, 3), k % 4 < 3) for k in range(20)}
    assert [len(s) for s in seen] == [20, 15, 10] and {p for _, p in seen[0]} == {None} and {p for _, p in seen[1]} == {"x"}


def test_digest_ranges():
    from datetime import datetime, timedelta, timezone

    from newsdesk.plans.feeds import digest_range

    now = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
    at = lambda d, h=0: datetime(2024, 3, d, h, tzinfo=timezone.utc)
    assert digest_range(now) == (at(9, 12), now, "rolling-24h", False)
    assert digest_range(now, date="2024-03-05") == (at(4, 15), at(5, 15) - timedelta(milliseconds=1), "jst-date", False)
    assert digest_range(now, start=at(4)) == (at(4), now, "explicit-range", False)
    assert digest_range(now, start=at(1), stop=at(9)) == (at(2), at(9), "explicit-range", True)
    assert digest_range(now, date="2024-03-05", start=at(1))[2] == "jst-date"


def test_topics_by_brute_force(spark, sf):
    import re

    from newsdesk import config as C
    from newsdesk.queries import _topics

    flat = lambda t: " ".join((t or "").split())

    def titled(t):
        out = []
        for w in flat(t).split():
            out.append(w.upper() if re.fullmatch(r"(?i)[a-z]{1,4}\d+(\.\d+)?", w) else w if re.fullmatch("[A-Z]{1,6}", w) else w[0].upper() + w[1:].lower())
        return " ".join(out)

    def topic(named, source, tag):
        find = lambda p: (m := re.search(rf"(?<![A-Za-z0-9_])({p})", named, re.I | re.A)) and m[1]
        if v := find(C.TOPIC_GPT):
            return flat(v).upper()
        for p in [f + C.TOPIC_REST for f in C.TOPIC_FAMILIES] + [C.TOPIC_LLAMA]:
            if v := find(p):
                return titled(v)
        for p, name in C.TOPIC_NAMES:
            if find(rf"(?:{p})(?![A-Za-z0-9_])"):
                return name
        return re.sub("^@", "", flat(source)) or C.TOPIC_FALLBACK.get(tag or "OTHER", "AI General")

    begin = ("gpt-4 mini ", "Claude opus ", "日gpt-5 ", "", "use cursor ", "LLAMA 3 ", "mcp server ", "")
    rows = _topics(spark, sf).select("id", "n", "body", "source_ref", "primary_tag", "topic").collect()
    want = {r.id: topic(begin[r.n % 8] + (r.body or ""), r.source_ref if r.n % 3 else None, r.primary_tag)[:60] for r in rows}
    assert {r.id: r.topic for r in rows} == want and len(set(want.values())) > 5
