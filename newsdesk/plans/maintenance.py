"""Discovery, catalogue diffs, retention, link sets, collector health, seeds and community files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import text, urls
from newsdesk.operators.relational import densely_numbered


def mentioned(body: Column) -> Column:
    """Distinct accounts a text mentions or links a status of."""
    at = F.transform(F.regexp_extract_all(body, F.lit(r"@([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"), F.lit(1)), text.handle)
    linked = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)(?:x|twitter)\.com/([A-Za-z0-9_]{1,15})/status/\d+"), F.lit(1)), text.handle)
    return F.array_distinct(F.array_compact(F.concat(at, linked)))


#: Where a stored post names the author it refers to.
AUTHOR_PATHS = (
    "user.screen_name", "user.username", "user.legacy.screen_name", "author.screen_name", "author.username", "author.handle", "core.user_results.result.legacy.screen_name",
    "core.user_results.result.username", "user_results.result.legacy.screen_name", "user_results.result.username", "author_results.result.legacy.screen_name", "author_results.result.username", "legacy.user.screen_name",
)
REPLY_PATHS = ("legacy.in_reply_to_screen_name", "in_reply_to_screen_name", "reply_to.screen_name", "reply_to.username")
REFERENCE_PATHS = (
    "retweeted_status", "quoted_status", "retweeted_tweet", "quoted_tweet", "replied_to_tweet", "retweeted_status_result.result", "quoted_status_result.result", "replied_to_status_result.result",
)
REFERENCE_ARRAYS = ("referenced_tweets", "referencedTweets", "includes.tweets")


def _author(post: Column) -> Column:
    """The first account that a variant names at one of the paths, null if none is well-formed."""
    return F.coalesce(*[text.handle(F.try_variant_get(post, f"$.{p}", "string")) for p in AUTHOR_PATHS])


def referenced(json: Column) -> Column:
    """Distinct accounts that a stored post's JSON replies to, quotes or repeats; the JSON is parsed once."""
    post = F.try_parse_json(json)
    replied = F.array(*[text.handle(F.try_variant_get(post, f"$.{p}", "string")) for p in REPLY_PATHS])
    quoted = F.transform(F.array(*[F.try_variant_get(post, f"$.{p}", "variant") for p in REFERENCE_PATHS]), _author)
    listed = [F.transform(F.coalesce(F.try_variant_get(post, f"$.{a}", "array<variant>"), F.array().cast("array<variant>")), _author) for a in REFERENCE_ARRAYS]
    return F.array_distinct(F.array_compact(F.concat(replied, quoted, *listed)))


def mention_counts(posts: DataFrame, known: DataFrame, minimum: int = 2) -> DataFrame:
    """(handle, posts, mentioned_by, mentioners, qualified) of unknown accounts that posts mention; self-mentions don't count.

    Several posts or several accounts qualify one.
    """
    by = posts.select("id", text.handle(F.col("source_ref")).alias("by"), F.explode(mentioned(F.col("body"))).alias("handle")).filter("by is null or handle <> by")
    fresh = by.join(known.select(text.handle(F.col("handle")).alias("handle")).filter("handle is not null").distinct(), "handle", "left_anti")
    counted = fresh.groupBy("handle").agg(F.countDistinct("id").alias("posts"), F.array_join(F.array_sort(F.collect_set("by")), ",").alias("mentioned_by"), F.countDistinct("by").alias("mentioners"))
    return counted.withColumn("qualified", (F.col("posts") >= minimum) | (F.col("mentioners") >= minimum))


def mention_signals(posts: DataFrame, known: DataFrame, minimum: int = 2) -> DataFrame:
    """The accounts that enough posts or accounts mention."""
    return mention_counts(posts, known, minimum).filter("qualified").drop("qualified")


def candidates_updated(existing: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates after a discovery round: counts are replaced, few or many, absent ones fall to 0; new ones start as pending if they qualify."""
    met = existing.join(counts, "handle", "full_outer").filter(F.col("status").isNotNull() | F.col("qualified"))
    return met.select("handle", F.coalesce("posts", F.lit(0)).alias("mentions"), F.coalesce("mentioned_by", F.lit("")).alias("mentioned_by"), F.coalesce("status", F.lit("pending")).alias("status"))


def catalogue_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether a fetched snapshot is too small to be believed."""
    a, b = old.filter("removed_at is null").agg(F.count("*").alias("active")), new.agg(F.count("*").alias("fetched"))
    return a.crossJoin(b).withColumn("abort", (F.col("fetched") == 0) | ((F.col("active") > 0) & (F.col("fetched") < F.ceil(F.col("active") / 2))))


def catalogue_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, event, old_value, new_value) between two snapshots (id, name, price, context; old with removed_at): new, removed, price_change, context_change."""
    o = old.select("id", F.col("price").alias("op"), F.col("context").alias("oc"), "removed_at", F.lit(True).alias("_o"))
    n = new.select("id", F.col("price").alias("np"), F.col("context").alias("nc"), F.lit(True).alias("_n"))
    both, s = F.col("_o").isNotNull() & F.col("_n").isNotNull(), lambda c: F.col(c).cast("string")
    event = lambda when, name, a, b: F.when(when, F.struct(F.lit(name).alias("event"), a.alias("old_value"), b.alias("new_value")))
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(
        event(F.col("_o").isNull(), "new", none, none), event(F.col("_n").isNull() & F.col("removed_at").isNull(), "removed", none, none),
        event(both & ~F.col("op").eqNullSafe(F.col("np")), "price_change", s("op"), s("np")), event(both & ~F.col("oc").eqNullSafe(F.col("nc")), "context_change", s("oc"), s("nc")),
    ))
    return o.join(n, "id", "full_outer").select("id", F.inline(found))


def retained(rows: DataFrame, at: str, as_of: Column, days: int, bound: DataFrame | None = None, key: str = "id", floor: int = 1) -> DataFrame:
    """Rows young enough, or bound to something; ``days`` is at least ``floor``."""
    young = F.col(at) >= as_of - F.make_interval(days=F.lit(max(days, floor)))
    if bound is None:
        return rows.filter(F.coalesce(young, F.lit(True)))
    marked = rows.join(bound.select(key).distinct().withColumn("_bound", F.lit(True)), key, "left")
    return marked.filter(F.coalesce(young, F.lit(True)) | F.col("_bound").isNotNull()).drop("_bound")


def cascaded(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(kept.select(key).distinct(), key, "left_semi")


def detached(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """All children; the key of those whose parent goes becomes null."""
    marked = children.join(kept.select(key).distinct().withColumn("_kept", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("_kept"), F.col(key))).drop("_kept")


def collector_health(runs: DataFrame) -> DataFrame:
    """Per kind: sources, errors, and whether the sweep counts as good: no source, or fewer errors than sources."""
    sums = runs.groupBy("kind").agg(F.sum("sources").alias("sources"), F.sum("errors").alias("errors"))
    return sums.withColumn("ok", (F.col("sources") == 0) | (F.col("errors") < F.col("sources")))


def sweeps(results: DataFrame) -> DataFrame:
    """(sweep, collectors, failed, sources, errors, has_failures, all_failed): what a sweep's tasks (sweep, kind, ok, sources, errors) come to.

    Only ``collector`` tasks count as such; a summary's failure is a failure of the sweep.  All have failed if errors
    reach the sources, or if no collector that took part, with sources or by failing, is well.
    """
    own, bad = F.col("kind") == "collector", ~F.col("ok")
    part = own & ((F.col("sources") > 0) | bad)
    sums = results.groupBy("sweep").agg(
        F.count_if(own).alias("collectors"), F.count_if(own & bad).alias("failed"), F.sum(F.when(own, F.col("sources")).otherwise(0)).alias("sources"), F.sum(F.when(own, F.col("errors")).otherwise(0)).alias("errors"),
        F.count_if(bad).alias("_bad"), F.count_if(part).alias("_part"), F.count_if(part & bad).alias("_part_bad"),
    )
    every = ((F.col("sources") > 0) & (F.col("errors") >= F.col("sources"))) | ((F.col("_part") > 0) & (F.col("_part") == F.col("_part_bad")))
    return sums.withColumn("has_failures", (F.col("errors") > 0) | (F.col("_bad") > 0)).withColumn("all_failed", every).drop("_bad", "_part", "_part_bad")


def stale_runs(runs: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Runs with those aborted that have been running too long."""
    late = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_interval(hours=F.lit(hours)))
    return runs.withColumn("status", F.when(late, "aborted").otherwise(F.col("status")))


def rate_limited(submissions: DataFrame, as_of: Column, days: int = 30, most: int = 3) -> DataFrame:
    """(login, files, limited): files of each login, whatever its case, within the last days."""
    recent = submissions.filter(F.col("at") >= as_of - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.lower("login").alias("login")).agg(F.count("*").alias("files")).withColumn("limited", F.col("files") >= most)


def enriched(enrichment: Column, fresh: Column, keep: int = 20) -> Column:
    """Maps of url key to (fetched_at, ...) merged, fresh ones first, the newest ``keep`` left."""
    merged = F.map_concat(F.map_filter(enrichment, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    newest = F.reverse(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.struct(e["value"]["fetched_at"].alias("at"), e["key"].alias("key"), e["value"].alias("value")))))
    return F.map_from_entries(F.transform(F.slice(newest, 1, keep), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def key_links(url: Column, canonical: Column, others: Column, limit: int = 6) -> Column:
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(url, canonical), others))), 1, limit)


#: How deep a stored post is searched for links, how many entries of a list and of an object, and what keys hold links.
JSON_DEPTH, JSON_LIST, JSON_OBJECT, LINK_KEY = 4, 80, 120, "(^|_)(url|link|href|sourceurl|articleurl|rawlink)$"


def json_links(json: Column) -> Column:
    """Distinct http(s) links in the strings of a JSON document, level by level; whole values of keys that name links count too.

    Lists and objects are read to ``JSON_DEPTH`` levels below the top, the first entries of each.  What isn't JSON has none.
    """
    none = F.array().cast("array<struct<key:string,value:variant>>")

    def children(entry: Column) -> Column:
        listed = F.transform(F.slice(F.try_variant_get(entry["value"], "$", "array<variant>"), 1, JSON_LIST), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
        named = F.transform(F.slice(F.map_entries(F.try_variant_get(entry["value"], "$", "map<string,variant>")), 1, JSON_OBJECT), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        return F.concat(F.coalesce(listed, none), F.coalesce(named, none))

    def found(entry: Column) -> Column:
        text = F.when(F.schema_of_variant(entry["value"]) == "STRING", F.try_variant_get(entry["value"], "$", "string"))
        whole = F.when(entry["key"].rlike(LINK_KEY) & F.trim(text).rlike(r"(?i)^https?://\S+$"), F.array(F.trim(text)))
        empty = F.array().cast("array<string>")
        return F.concat(F.coalesce(whole, empty), F.coalesce(urls.links(text), empty))

    level = F.filter(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("value"))), lambda e: e["value"].isNotNull())
    out = []
    for depth in range(JSON_DEPTH + 2):
        # The deepest object's own strings are still read, a list's no longer.
        here = level if depth <= JSON_DEPTH else F.filter(level, lambda e: e["key"].isNotNull())
        out.append(F.flatten(F.transform(here, found)))
        level = F.flatten(F.transform(level, children))
    return F.array_distinct(F.concat(*out))


def seeded(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """Accounts after a seed import (handle, tags): new ones added, tags of known ones appended once each."""
    e, s = existing.select("handle", F.col("tags").alias("_e")), seeds.select("handle", F.col("tags").alias("_s"))
    none = F.array().cast("array<string>")
    return e.join(s, "handle", "full_outer").select("handle", F.array_union(F.coalesce("_e", none), F.coalesce("_s", none)).alias("tags"))


def batches(items: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Items with the number of the request batch they go to, ``size`` a batch in a total order."""
    return densely_numbered(items, order, "_number").withColumn("batch", F.floor(F.col("_number") / size)).drop("_number")


def price(raw: Column) -> Column:
    """The number that a price begins with, after white space; null if it begins with none."""
    return F.nullif(F.regexp_extract(raw, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).cast("double")


def is_free(prompt: Column, completion: Column) -> Column:
    """Whether neither price (a number) is above or below zero; a missing one counts as none."""
    return (F.coalesce(prompt, F.lit(0.0)) == 0) & (F.coalesce(completion, F.lit(0.0)) == 0)


def per_million(value: Column) -> Column:
    """A price per token as dollars per million; none and zero are free."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, "free").otherwise(F.format_string("$%.2f/M", value * 1_000_000))


def trusted_mentions(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """(handle, trusted): how many of an account's mentioners (comma-joined) are trusted sources."""
    each = signals.select("handle", F.explode(F.split("mentioned_by", ",")).alias("by"))
    good = sources.filter(F.col("trust_label").isin("high", "medium")).select(text.handle(F.col("handle")).alias("by")).distinct()
    return each.join(good, "by", "left_semi").groupBy("handle").agg(F.countDistinct("by").alias("trusted"))
