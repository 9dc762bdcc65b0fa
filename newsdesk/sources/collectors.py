"""Collected posts of seven platforms: parsing of landed JSON and the projection into one candidate table.

Fetching itself belongs to a client outside this library; what it lands is read here as files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import text, timing, urls
from newsdesk.operators.relational import first_per_key

#: Schemas of landed JSON, one object a line.
LANDED = {
    "twitter": "id string, text string, note_text string, url string, handle string, created_at timestamp, fetched_at timestamp, metrics struct<like:double,retweet:double,reply:double,quote:double,view:double,bookmark:double>",
    "alerts": "id bigint, title string, snippet string, article_url string, published_at timestamp, fetched_at timestamp, feed_url string",
    "facebook": "post_id string, text string, url string, author struct<name:string>, publish_time string, page_slug string, page_url string, fetched_at timestamp",
    "reddit": "id string, title string, selftext string, permalink string, subreddit string, created_utc double, score bigint, fetched_at timestamp",
    "qiita": "id string, title string, body string, url string, tag string, created_at timestamp, likes_count bigint, fetched_at timestamp",
    "github": "kind string, repo string, query string, tag_name string, name string, body string, html_url string, published_at timestamp, stars bigint, fetched_at timestamp",
    "instagram": "shortcode string, captions array<string>, handle string, taken_at double, like_count bigint, fetched_at timestamp",
}


def landed(spark: SparkSession, path: str, platform: str) -> DataFrame:
    return spark.read.schema(LANDED[platform]).json(path)


def instant(raw: Column) -> Column:
    """An epoch in seconds or an ISO time, as text."""
    return F.when(raw.rlike(r"^\d{9,11}$"), F.timestamp_seconds(raw.try_cast("bigint"))).otherwise(F.try_to_timestamp(raw))


def plain(html: Column, limit: int | None = None) -> Column:
    """A title or snippet without tags."""
    out = text.collapse(F.regexp_replace(html, "<[^>]*>", ""))
    return F.trim(F.substring(out, 1, limit)) if limit else out


def _candidate(platform: str, id_: Column, kind: str, ref: Column, title: Column, body: Column, url: Column, published: Column) -> list[Column]:
    link = F.coalesce(text.blank_to_null(url), F.concat(F.lit(f"https://item.invalid/{platform}/"), F.url_encode(id_)))
    return [
        F.lit(platform).alias("platform"), id_.alias("external_id"), F.lit(kind).alias("source_type"), ref.alias("source_ref"), text.blank_to_null(title).alias("title"), text.blank_to_null(body).alias("body"), body.alias("raw_body"),
        link.alias("url"), urls.canonical(link).alias("canonical_url"), timing.clamped(published, F.col("fetched_at")).alias("published_at"), F.col("fetched_at").alias("ingested_at"),
    ]


def candidates(raw: dict[str, DataFrame]) -> DataFrame:
    """All platforms' posts as one table; a missing date is the fetch's, but X has its own; of alerts with one article the oldest stays.

    ``body`` has no white space at its ends and is null if blank; ``raw_body`` is the body as it was collected.
    """
    c, at = F.col, lambda name: F.coalesce(F.col(name), F.col("fetched_at"))
    out: list[DataFrame] = []
    for platform, df in raw.items():
        if platform == "twitter":
            body = F.when(text.blank_to_null(c("note_text")).isNotNull(), c("note_text")).otherwise(c("text"))
            cols = _candidate(platform, c("id"), "x_account", F.concat(F.lit("@"), "handle"), text.truncate(body, 140), body, c("url"), c("created_at"))
        elif platform == "alerts":
            df = first_per_key(df, ["article_url"], [c("id")])
            cols = _candidate(platform, c("id").cast("string"), "alert_feed", c("feed_url"), plain(c("title")), plain(c("snippet"), 1000), c("article_url"), at("published_at"))
        elif platform == "facebook":
            cols = _candidate(platform, c("post_id"), "fb_page", F.coalesce(text.blank_to_null(c("page_slug")), c("page_url")), text.truncate(c("text"), 140), c("text"), c("url"), F.coalesce(instant(c("publish_time")), c("fetched_at")))
        elif platform == "reddit":
            cols = _candidate(platform, c("id"), "subreddit", F.concat(F.lit("r/"), "subreddit"), c("title"), c("selftext"), F.concat(F.lit("https://www.reddit.com"), "permalink"), F.coalesce(F.timestamp_seconds("created_utc"), c("fetched_at")))
        elif platform == "qiita":
            cols = _candidate(platform, c("id"), "qiita_tag", c("tag"), c("title"), c("body"), c("url"), at("created_at"))
        elif platform == "github":
            # A bare release tag would collide across repositories.
            own = F.when(c("kind") == "release", F.concat_ws(":", "repo", "tag_name")).otherwise(c("repo"))
            cols = _candidate(platform, own, "gh_source", F.coalesce(c("repo"), c("query"), c("name")), c("name"), c("body"), c("html_url"), at("published_at"))
        else:
            caption = F.try_element_at("captions", F.lit(1))
            cols = _candidate(platform, c("shortcode"), "ig_account", c("handle"), text.truncate(caption, 140), caption, F.concat(F.lit("https://www.instagram.com/p/"), "shortcode", F.lit("/")), F.coalesce(F.timestamp_seconds("taken_at"), c("fetched_at")))
        out.append(df.select(cols))
    return reduce(DataFrame.unionByName, out)


def due(sources: DataFrame, as_of: Column) -> DataFrame:
    """Active sources whose fetch interval has passed."""
    last = F.col("last_fetched_at")
    return sources.filter(F.col("active") & (last.isNull() | (last <= as_of - F.make_interval(hours=F.col("fetch_interval_hours")))))
