"""Serving: feed search, the family feed with its cursor, digests, counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk import config as C
from newsdesk.functions.hashes import instant
from newsdesk.functions.text import compact_number, handle
from newsdesk.operators.relational import first_per_key, latest, with_ties


def contains_any(columns: Sequence[Column], words: Sequence[str]) -> Column:
    """One of the words in one of the columns, whatever the case; nulls hold nothing."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower())) for c in columns for w in words], F.lit(False))


@dataclass(frozen=True)
class Range:
    start: datetime
    stop: datetime
    basis: str
    clamped: bool = False


def resolve_range(as_of: datetime, day: str | None = None, start: datetime | None = None, stop: datetime | None = None, since: datetime | None = None, rolling_hours: int = 24, longest_days: int | None = None) -> Range:
    """A request's range: a local day, else an explicit range, else since, else the last hours; longer ones are cut at their start."""
    if day is not None:
        begin = datetime.fromisoformat(day) - timedelta(hours=9)
        out = Range(begin, begin + timedelta(days=1) - timedelta(milliseconds=1), "day")
    elif start is not None:
        out = Range(start, stop or as_of, "range")
    elif since is not None:
        out = Range(since, as_of, "since")
    else:
        out = Range(as_of - timedelta(hours=rolling_hours), as_of, "rolling")
    if longest_days is not None and out.stop - out.start > timedelta(days=longest_days):
        return Range(out.stop - timedelta(days=longest_days), out.stop, out.basis, True)
    return out


def clamped_limit(value: int | None, default: int = 100, most: int = 500) -> int:
    return default if value is None or value <= 0 else min(value, most)


def search(items: DataFrame, keyword: str | None = None, source: str | None = None, per_platform: int = 500, limit: int = 2000, platforms: Sequence[str] = ()) -> DataFrame:
    """Newest items of each platform up to ``per_platform``, then filtered, then merged and cut: filters see what the first cut left, on clipped texts.

    Author and metrics come along where the items have them; both filters look at the author too.
    """
    rows = items.filter(F.col("platform").isin(*platforms)) if platforms else items
    newest = [F.col("published_at").desc_nulls_last(), F.col("id")]
    from newsdesk.operators.relational import top_per_group

    author = F.col("author") if "author" in items.columns else F.lit(None).cast("string")
    cut = top_per_group(rows, ["platform"], newest, per_platform).select(
        "id", "platform", "source_ref", author.alias("author"), "published_at", F.when(F.length("title") > 100, F.concat(F.substring("title", 1, 100), F.lit("…"))).otherwise(F.col("title")).alias("title"), F.substring("body", 1, 500).alias("text"), "url",
        *(["metrics"] if "metrics" in items.columns else []),
    )
    if keyword:
        cut = cut.filter(contains_any([F.col(c) for c in ("title", "text", "author", "source_ref")], [keyword]))
    if source:
        cut = cut.filter(contains_any([F.col("source_ref"), F.col("author")], [source]))
    return cut.orderBy(*newest).limit(limit)


def counts(page: DataFrame, column: str = "platform") -> DataFrame:
    return page.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("items"))


@dataclass(frozen=True)
class FeedParams:
    start: str
    stop: str
    since: str | None = None
    categories: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    action: str | None = None
    platform: str | None = None
    limit: int = 100
    dedup: bool = True


def tag_filter(p: FeedParams) -> Column:
    out = ~F.col("noise")
    if p.categories:
        out = out & F.col("primary_tag").isin(*p.categories)
    elif not p.tags:
        out = out & F.col("primary_tag").isNotNull()
    if p.tags:
        out = out & reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*p.tags), F.lit(False)) for c in ("primary_tag", "sub_tag", "action_tag")])
    return out & (F.col("action_tag") == p.action) if p.action else out


def family_feed(items: DataFrame, classes: DataFrame, decisions: DataFrame, p: FeedParams) -> tuple[DataFrame, DataFrame]:
    """(rows, meta) of a feed page.

    The newest classification among those that match the filter counts, not the newest of all.  Matching rows
    are read oldest first up to ten pages; at that cap the newest tie group goes, unless it is all there is.
    A page that is cut is the oldest prefix with ties, so a cursor at its newest time misses nothing.
    """
    limit = clamped_limit(p.limit)
    cap = min(limit * 10, 5000)
    at = F.col("classified_at")
    within = (at > F.lit(p.since).cast("timestamp")) & (at <= F.lit(p.stop).cast("timestamp")) if p.since and p.since >= p.start else at.between(F.lit(p.start).cast("timestamp"), F.lit(p.stop).cast("timestamp"))
    i = items.select(F.col("id").alias("item_id"), "platform", "title", "url", "source_ref", "published_at", "body")
    rows = classes.filter(tag_filter(p) & within).join(i.filter(F.col("platform") == p.platform) if p.platform else i, "item_id")
    if p.keywords:
        rows = rows.filter(contains_any([F.col("title")], p.keywords))
    read = rows.orderBy("classified_at", "classification_id").limit(cap)
    # One row.
    ends = read.agg(F.count("*").alias("_n"), F.max("classified_at").alias("_max"), F.min("classified_at").alias("_min"))
    safe = read.crossJoin(F.broadcast(ends)).filter((F.col("_n") < cap) | (F.col("_max") == F.col("_min")) | (F.col("classified_at") < F.col("_max"))).drop("_max", "_min")
    newest = latest(safe, "item_id", "classified_at", "classification_id")
    d = latest(decisions, "item_id", "created_at", "decision_id").select("item_id", "headline_score", "priority_score", "topic_cluster_key", "distinct_sources")
    full = newest.join(d, "item_id", "left").withColumn("summary", F.substring("body", 1, 200)).drop("body")
    if p.dedup:
        group = F.when(F.col("topic_cluster_key").isNotNull() & (F.col("distinct_sources") >= 2), F.col("topic_cluster_key")).otherwise(F.concat(F.lit("id:"), "item_id"))
        full = first_per_key(full.withColumn("_g", group), ["_g"], [F.coalesce("headline_score", F.lit(0.0)).desc(), F.coalesce("priority_score", F.lit(0.0)).desc(), F.col("classified_at"), F.col("item_id")]).drop("_g")
    cut = with_ties(full, "classified_at", limit)
    page = cut.orderBy(F.coalesce("published_at", "classified_at").desc(), "item_id")
    total = full.agg(F.count("*").alias("before_limit"), F.coalesce(F.max("_n"), F.lit(0)).alias("read"))
    meta = page.agg(F.count("*").alias("total_items"), F.max("classified_at").alias("next_since")).crossJoin(F.broadcast(total)).withColumn("truncated", (F.col("read") >= cap) | (F.col("before_limit") > limit)).drop("read")
    return page.drop("_n"), meta


def engagement(metrics: Column) -> Column:
    """bookmark x 5 + like x 2 + retweet x 3 + view x 0.001; null without metrics."""
    of = lambda k: F.coalesce(F.try_element_at(metrics, F.lit(k)), F.lit(0.0))
    return F.when(metrics.isNotNull(), of("bookmark") * 5 + of("like") * 2 + of("retweet") * 3 + of("view") * 0.001)


def digest(items: DataFrame, limit: int = 2000) -> DataFrame:
    """Scored items first by score, the others by time."""
    return items.orderBy(F.col("engagement").isNull(), F.col("engagement").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("id")).limit(limit)


def digest_range(now: datetime, date: str | None = None, start: datetime | None = None, stop: datetime | None = None) -> tuple[datetime, datetime, str, bool]:
    """(from, to, basis, clamped) of a digest: a local day, else an explicit range, else the last 24 hours; at most ``C.DIGEST_DAYS`` long, counted back from its end.  All times have a zone."""
    if date:
        first = datetime.fromisoformat(f"{date}T00:00:00+09:00")
        start, stop, basis = first, first + timedelta(days=1) - timedelta(milliseconds=1), "jst-date"
    elif start:
        stop, basis = stop or now, "explicit-range"
    else:
        start, stop, basis = now - timedelta(days=1), now, "rolling-24h"
    clamped = stop - start > timedelta(days=C.DIGEST_DAYS)
    return (stop - timedelta(days=C.DIGEST_DAYS) if clamped else start), stop, basis, clamped


def digest_items(tweets: DataFrame, alerts: DataFrame, limit: int = 2000) -> DataFrame:
    """A digest's items in their order, as an API returns them (``payload`` makes the JSON of them).

    ``tweets`` holds tweet_id, text, url, handle, created_at, is_note and metrics, ``alerts`` alert_id, title, snippet,
    article_url, source_name, published_at and fetched_at.  Scored ones come first, the others by time; equal ones by id.
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = tweets.select(
        F.col("tweet_id").cast("string").alias("id"), F.lit("tweet").alias("platform"), F.concat(F.substring("text", 1, 100), F.when(F.length("text") > 100, "…").otherwise("")).alias("title"), F.substring("text", 1, 500).alias("text"), "url",
        F.col("handle").alias("author"), none("string").alias("sourceName"), F.col("created_at").alias("published_at"), "metrics", engagement(F.col("metrics")).alias("engagement"), F.col("is_note").alias("isNote"),
    )
    other = alerts.select(
        F.col("alert_id").cast("string").alias("id"), F.lit("alert").alias("platform"), "title", F.coalesce("snippet", F.lit("")).alias("text"), F.col("article_url").alias("url"), none("string").alias("author"), F.col("source_name").alias("sourceName"),
        F.coalesce("published_at", "fetched_at").alias("published_at"), none("map<string,double>").alias("metrics"), none("double").alias("engagement"), none("boolean").alias("isNote"),
    )
    rows = digest(own.unionByName(other), limit)
    # At most ``limit`` rows are numbered.
    numbered = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("engagement").isNull(), F.col("engagement").desc_nulls_last(), F.col("published_at").desc_nulls_last(), "id")))
    return numbered.withColumnRenamed("engagement", "engagementScore").withColumn("publishedAt", instant(F.col("published_at"))).drop("published_at")


def edition_payload(editions: DataFrame, bindings: DataFrame, items: DataFrame, trust: DataFrame) -> DataFrame:
    """(edition, json) of editions with their items in order of section and position, as an API returns them.

    ``editions`` holds edition, title, slug, status, edition_at and content, ``bindings`` edition, item_id, section,
    position and title_ja, ``items`` id, platform, source_ref, title, url and canonical_url, ``trust`` (_h, trust_label) one row an
    account.  The label of a blocked or unknown account, and of another platform than X, is null.  A selection is bounded, so one row holds it.
    """
    known = F.when(F.col("trust_label").isin("high", "medium", "unknown", "low", "blocked"), F.col("trust_label")).otherwise("unknown")
    labelled = trust.select("_h", known.alias("_label"))
    met = bindings.join(items.withColumnRenamed("id", "item_id"), "item_id").withColumn("_h", F.when(F.col("platform") == "twitter", handle(F.col("source_ref")))).join(labelled, "_h", "left")
    item = F.struct(
        F.col("item_id").alias("pipelineItemId"), "section", "position", "title", F.nullif("title_ja", F.lit("")).alias("titleJa"), F.coalesce(F.nullif("url", F.lit("")), F.nullif("canonical_url", F.lit("")), F.lit("")).alias("url"), "platform",
        F.col("source_ref").alias("sourceRef"), F.when(F.col("_label") != "blocked", F.col("_label")).alias("trustLabel"),
    )
    order = F.struct("section", "position", "item_id", item.alias("item"))
    listed = met.groupBy("edition").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item"]).alias("items"))
    rows = editions.join(listed, "edition", "left")
    whole = F.struct(
        F.col("edition").alias("id"), F.date_format("edition_at", "yyyy-MM-dd").alias("editionDate"), "title", "slug", "status", F.coalesce("n", F.lit(0)).alias("bindingsCount"),
        F.coalesce(F.length("content"), F.lit(0)).alias("contentChars"), F.nullif("content", F.lit("")).alias("contentMd"), F.col("items"),
    )
    return rows.select("edition", F.to_json(F.struct(whole.alias("edition")), {"ignoreNullFields": "false"}).alias("json"))


def busiest(items: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("items")).orderBy(F.desc("items"), column).limit(limit)


def calendar(first: str, last: str) -> DataFrame:
    """One row for each day from ``first`` to ``last`` with its weekday, Sunday 1."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.withColumn("weekday", F.dayofweek("day"))


def payload(page: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``json``: the page's items as an API returns them, in order of ``rank``, with their number, all and by platform; a page is bounded by its limit."""
    item = F.struct("rank", F.struct(*(columns or page.columns)).alias("item"))
    by_platform = page.groupBy("platform").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("counts"))
    rows = page.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(item), lambda a, b: a["rank"] - b["rank"]), lambda x: x["item"]).alias("items"))
    # One row each.
    met = rows.crossJoin(F.broadcast(by_platform))
    return met.select(F.to_json(F.struct(F.struct(F.col("n").alias("totalItems"), "counts").alias("meta"), "items")).alias("json"))


def daily_summary(posts: DataFrame, day: str, title: str, best: int = 10) -> DataFrame:
    """One row ``summary``: the posts (id, handle, text, url, created_at, is_note, metrics) of a day by engagement, and each account's number of posts, the busiest first.

    Accounts are a bounded dimension, so one row holds them.  Of equal posts the newer comes first, of equal
    accounts the one with the newer post.
    """
    scored = posts.withColumn("score", F.coalesce(engagement(F.col("metrics")), F.lit(0.0)))
    order = [F.desc("score"), F.desc("created_at"), F.col("id")]
    # At most ``best`` rows are numbered.
    head = scored.orderBy(*order).limit(best).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    medal = F.when(F.col("rank") == 1, "🥇").when(F.col("rank") == 2, "🥈").when(F.col("rank") == 3, "🥉").otherwise(F.concat(F.col("rank").cast("string"), F.lit(".")))
    n = lambda k: compact_number(F.coalesce(F.try_element_at("metrics", F.lit(k)), F.lit(0.0)))
    clipped = F.concat(F.regexp_replace(F.substring("text", 1, 120), "\n", " "), F.when(F.length("text") > 120, "…").otherwise(""))
    entry = F.concat(medal, F.lit(" *@"), "handle", F.lit("* "), F.when(F.col("is_note"), "📝").otherwise(""), F.lit("\n> "), clipped, F.lit("\n> 👁"), n("view"), F.lit(" ❤️"), n("like"), F.lit(" 🔖"), n("bookmark"), F.lit(" 🔄"), n("retweet"), F.lit("\n> <"), "url", F.lit(">\n"))
    top = head.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("entries"))
    each = posts.groupBy("handle").agg(F.count("*").alias("posts"), F.max("created_at").alias("latest"))
    accounts = each.agg(F.sum("posts").alias("posts"), F.count("*").alias("accounts"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("posts")).alias("by"), (-F.col("latest").cast("double")).alias("at"), "handle"))), lambda x: F.concat(F.lit("• @"), x["handle"], F.lit(": "), (-x["by"]).cast("string"), F.lit(" tweets\n"))).alias("lines"))
    # One row each.
    met = top.crossJoin(F.broadcast(accounts))
    text = F.concat(
        F.lit(f"📡 *{title} — Daily Summary ({day})*\nCollected "), F.col("posts").cast("string"), F.lit(" tweets from "), F.col("accounts").cast("string"), F.lit(" accounts\n\n*🏆 Top "), F.col("n").cast("string"),
        F.lit(" by Engagement Score*\n_(score = bookmark×5 + like×2 + RT×3 + view×0.001)_\n\n"), "entries", F.lit("\n*📊 Per Account*\n"), F.array_join("lines", ""),
    )
    return met.select(F.when(F.col("n") > 0, text).otherwise("No new tweets in last 24h").alias("summary"))
