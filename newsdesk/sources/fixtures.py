"""The driver's tables read as the tables of the domain, by deterministic rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk.config import ACTION_ORDER, FALLBACK_HASH_PREFIX, PLATFORMS, PRIMARY_ORDER
from newsdesk.functions.text import collapse
from newsdesk.functions.timing import hours

EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; its zoneless times are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def nth(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def minutes_after_epoch(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + n * 60)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: id, platform, source_ref, title, body, url, canonical_url, published_at, ingested_at, created_at."""
    d = table(spark, sf_dir, "documents")
    at, i = minutes_after_epoch(F.col("doc_id")), F.col("doc_id")
    return d.select(
        F.concat(F.lit("d"), i).alias("id"), i.alias("n"), nth(PLATFORMS, i % 7).alias("platform"), F.concat(F.lit("@"), "source").alias("source_ref"),
        F.substring(collapse(F.col("text")), 1, 140).alias("title"), F.col("text").alias("body"),
        F.concat(F.lit("https://Example.com/"), "source", F.lit("/"), i - i % 3, F.lit("/?utm_source=feed&b=2&a="), i % 2, F.lit("#top")).alias("url"),
        F.when(i % 10 != 0, at).alias("published_at"), (at + hours(6)).alias("ingested_at"), (at + hours(6)).alias("created_at"), "lang", "n_chars",
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a classification for each labelled document."""
    v, i = F.col("v"), F.col("doc_id")
    return table(spark, sf_dir, "labels").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (i * 10 + v).alias("classification_id"), F.concat(F.lit("d"), i).alias("item_id"), i.alias("n"),
        F.when(v == 1, (F.col("quality") == 0) & (F.col("toxic") == 1)).otherwise(F.col("quality") == 0).alias("noise"),
        ((1 + F.col("quality")) / 2.0).alias("score"), nth(PRIMARY_ORDER, (i + v) % 11).alias("primary_tag"), nth(ACTION_ORDER, i % 4).alias("action_tag"), F.when(i % 5 != 0, nth(("PROMPT", "PAPER", "MCP"), (i + v) % 3)).alias("sub_tag"),
        (i % 13 == 0).alias("is_headline"), (i % 19 == 0).alias("is_dup"), (i % 23 == 0).alias("is_published"),
        (minutes_after_epoch(i) + F.make_interval(hours=v)).alias("classified_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One editorial decision for each document."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("decision_id"), F.concat(F.lit("d"), i).alias("item_id"), (F.col("n_chars") % 101).cast("double").alias("priority_score"), (i % 100).cast("double").alias("headline_score"),
        ((i % 10) / 10.0).alias("dup_score"), (i % 17 == 0).alias("headline_candidate"), F.when(i % 3 == 0, F.concat(F.lit("tc_"), i % 50)).alias("topic_cluster_key"), (i % 4).alias("distinct_sources"),
        F.when(i % 29 == 0, F.concat(F.lit(FALLBACK_HASH_PREFIX), i)).otherwise(F.concat(F.lit("h"), i)).alias("input_hash"), (minutes_after_epoch(i) + hours(8)).alias("created_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts behind the documents, trust labels by turns."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("handle")).distinct()
    # A dimension of a few rows; numbered over all of them.
    rank = F.row_number().over(Window.orderBy("handle")) - 1
    return names.withColumn("rank", rank).select("handle", nth(("high", "medium", "low", "unknown", "blocked"), F.col("rank") % 5).alias("trust_label"), F.col("rank").cast("bigint").alias("source_id"), (F.col("rank") * 7 % 100).cast("double").alias("ai_score"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lifecycle knows of the sources: kind, activity, age, and the end of a cooldown that some have."""
    i = F.col("source_id")
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + n * 86400)
    return sources(spark, sf_dir).select(
        "source_id", "handle", "trust_label", F.when(i % 6 == 5, "seed").otherwise("discovered").alias("type"), (i % 7 != 6).alias("active"), day(-(i * 11 % 31)).alias("created_at"),
        F.when(i % 4 == 1, day(i % 12)).alias("cooldown_until"), F.when(i % 7 == 6, day(-2)).alias("deactivated_at"),
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: platform is the event's type, author the user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_id").alias("n"), F.col("event_type").alias("platform"), F.concat(F.lit("u"), "user_id").alias("handle"), F.concat(F.lit("@u"), "user_id").alias("source_ref"),
        F.col("ts").alias("published_at"), (F.col("ts") + hours(1)).alias("ingested_at"), F.col("value").alias("score"), F.from_json("props", "map<string,double>").alias("metrics"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue as stored and as fetched later; an id is (added, key), as an added entry's key may be a stored part's too."""
    p = table(spark, sf_dir, "part")
    own = lambda added, key: F.struct(F.lit(added).alias("added"), key.alias("key")).alias("id")
    old = p.select(own(False, F.col("p_partkey")), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("bigint").alias("context"), F.lit(None).cast("timestamp").alias("removed_at"))
    k = F.col("id.key")
    kept = old.filter(k % 13 != 0).select("id", "name", F.when(k % 7 == 0, F.round(F.col("price") * 1.1, 4)).otherwise(F.col("price")).alias("price"), F.when(k % 5 == 0, F.col("context") + 1).otherwise(F.col("context")).alias("context"))
    new = old.filter(k % 19 == 0).select(own(True, k + 1_000_000), "name", "price", "context")
    return old, kept.unionByName(new)
