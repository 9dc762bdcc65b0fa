"""Scores: headlines, source trust, lifecycle, topic boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk import config as C
from newsdesk.operators.relational import latest


def weight(of: Column, weights: dict[str, float], default: float = 0) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def freshness(at: Column, as_of: Column) -> Column:
    age = (as_of.cast("double") - at.cast("double")) / 3600
    return F.when(age <= 24, 20).when(age <= 72, 14).when(age <= 168, 8).when(age <= 336, 4).otherwise(0)


def headline_scores(items: DataFrame, classes: DataFrame, as_of: Column) -> DataFrame:
    """(id, headline_score) of items with their latest classification."""
    rows = items.join(latest(classes, "item_id", "classified_at", "classification_id"), F.col("id") == F.col("item_id"))
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    score = (
        10 + F.coalesce("score", F.lit(0.5)) * 40 + weight(F.coalesce("primary_tag", F.lit("OTHER")), C.HEADLINE_PRIMARY) + weight(F.coalesce("action_tag", F.lit("INFO")), C.HEADLINE_ACTION)
        + F.least(size("body"), F.lit(1200)) / 120 + F.least(size("title"), F.lit(120)) / 30 + freshness(F.coalesce("published_at", "ingested_at", "created_at"), as_of)
        + F.when(F.col("platform").isin("qiita", "github", "alerts"), 2).otherwise(0) + F.when(size("body") > 900, 3).otherwise(0) - F.when(size("body") < 60, 4).otherwise(0)
    )
    return rows.select("id", F.round(clamp(score, 0, 120), 3).alias("headline_score"))


def headline_slots(scores: DataFrame) -> DataFrame:
    """The headlines among ``scores``: a fifth of the items, 1 to 5, that reach the minimum, or else the best one."""
    n = scores.agg(F.count("*").alias("n"))
    best = scores.orderBy(F.desc("headline_score"), "id").limit(C.MAX_HEADLINES)
    # At most five rows are numbered; the other side is one row.
    rows = best.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("headline_score"), "id"))).crossJoin(F.broadcast(n))
    slots = F.least(F.lit(C.MAX_HEADLINES), F.greatest(F.lit(1), F.ceil(F.col("n") * 0.2)))
    return rows.filter(((F.col("slot") <= slots) & (F.col("headline_score") >= C.MIN_HEADLINE_SCORE)) | (F.col("slot") == 1)).select("id", "headline_score", "slot")


# --- trust -------------------------------------------------------------------


def item_summary(items: DataFrame, stop: Column) -> DataFrame:
    """Per source: items of 28 and of 7 days, and the latest; ``items`` has source_id and created_at."""
    days = lambda n: stop - F.make_interval(days=F.lit(n))
    at = F.col("created_at")
    return items.filter((at >= days(28)) & (at < stop)).groupBy("source_id").agg(F.count("*").alias("items_28"), F.count_if(at >= days(7)).alias("items_7"), F.max(at).alias("latest_at"))


def class_summary(items: DataFrame, classes: DataFrame, stop: Column) -> DataFrame:
    """Per source: classifications, classified items, noise and mean score of 28 days; 7-day counts need item and classification within 7 days."""
    days = lambda n: stop - F.make_interval(days=F.lit(n))
    i = items.select("source_id", "item_id", F.col("created_at").alias("item_at")).filter((F.col("item_at") >= days(28)) & (F.col("item_at") < stop))
    c = classes.filter((F.col("classified_at") >= days(28)) & (F.col("classified_at") < stop))
    week = (F.col("item_at") >= days(7)) & (F.col("classified_at") >= days(7))
    return i.join(c, "item_id").groupBy("source_id").agg(
        F.count("*").alias("classes_28"), F.count_if(week).alias("classes_7"), F.countDistinct("item_id").alias("classified_28"), F.countDistinct(F.when(week, F.col("item_id"))).alias("classified_7"),
        F.count_if("noise").alias("noise_28"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def adoption_summary(items: DataFrame, classes: DataFrame, bound: DataFrame) -> DataFrame:
    """Per source: distinct classified items that an edition holds."""
    used = items.join(classes.select("item_id").distinct(), "item_id", "left_semi").join(bound.select("item_id").distinct(), "item_id", "left_semi")
    return used.groupBy("source_id").agg(F.countDistinct("item_id").alias("adopted_28"))


def decision_summary(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per source: mean priority and mean originality of decided items."""
    return items.select("source_id", "item_id").join(decisions, "item_id").groupBy("source_id").agg(F.round(F.avg("priority_score"), 6).alias("mean_priority"), F.round(F.avg(1 - F.col("dup_score")), 6).alias("mean_originality"))


def source_summary(sources: DataFrame, *parts: DataFrame) -> DataFrame:
    """Sources with every summary, counts of 0 where one has nothing."""
    out = sources
    for p in parts:
        out = out.join(p, "source_id", "left")
    counts = [c for c, t in out.dtypes if t == "bigint" and c != "source_id"]
    return out.fillna(0, counts)


def trust_medians(summary: DataFrame) -> DataFrame:
    """One row: medians of adoption and priority over sources with enough classified items, null if there is none."""
    eligible = summary.filter(F.col("classified_28") >= C.MIN_CLASSIFIED)
    return eligible.agg(F.round(F.median(F.col("adopted_28") / F.col("classified_28")), 6).alias("median_adoption"), F.round(F.median(F.col("mean_priority") / 100), 6).alias("median_priority"))


def trust_scores(summary: DataFrame, stop: Column) -> DataFrame:
    """(source_id, trust_score, new_label, cold_start) of every source; ``summary`` has its ``created_at``, too.

    Cold are sources of few classified items and those younger than ``MIN_SOURCE_AGE_DAYS``.
    """
    total = sum(C.TRUST_WEIGHTS.values())
    w = {k: v / total for k, v in C.TRUST_WEIGHTS.items()}
    unit = lambda x: clamp(x, 0, 1)
    above = lambda v, m: F.when(v.isNull() | m.isNull() | (v <= m) | (m >= 1), 0.5).otherwise(unit(0.5 + 0.5 * (v - m) / (1 - m)))
    # One row.
    rows = summary.crossJoin(F.broadcast(trust_medians(summary)))
    share = lambda a, b: F.when(F.col(b) > 0, unit(F.col(a) / F.col(b)))
    non_noise = F.coalesce(1 - share("noise_28", "classes_28"), F.lit(0.5))
    quality = 0.6 * non_noise + 0.4 * unit(F.coalesce("mean_score", F.lit(0.5)))
    selection = 0.6 * above(unit(F.col("mean_priority") / 100), F.col("median_priority")) + 0.4 * above(F.coalesce(share("adopted_28", "classified_28"), F.lit(0.0)), F.col("median_adoption"))
    decay = unit(1 - F.col("classified_28") / C.PRIOR_DECAY_ITEMS)
    days = F.greatest(F.lit(0.0), (stop.cast("double") - F.col("latest_at").cast("double")) / 86400)
    fresh = 0.6 * F.coalesce(F.exp(-days / 14), F.lit(0.5)) + 0.4 * unit(F.coalesce("mean_originality", F.lit(0.5)))
    score = quality * (w["item_quality"] + w["prior"] * (1 - decay)) + selection * w["selection"] + unit(F.coalesce(F.col("ai_score") / 100, F.lit(0.5))) * w["prior"] * decay + fresh * w["freshness"]
    points = F.floor(F.round(unit(score) * 100, 6) + 0.5).cast("int")
    young = F.coalesce(F.col("created_at") > stop - F.make_interval(days=F.lit(C.MIN_SOURCE_AGE_DAYS)), F.lit(False))
    cold = (F.col("classified_28") < C.MIN_CLASSIFIED) | young
    label = F.when(F.col("trust_label") == "blocked", "blocked").when(cold, "unknown").when(points >= 75, "high").when(points >= 50, "medium").otherwise("low")
    return rows.select("source_id", points.alias("trust_score"), label.alias("new_label"), cold.alias("cold_start"))


def trust_factor(label: Column) -> Column:
    return F.coalesce(weight(label, C.TRUST_MULTIPLIERS, 1.0), F.lit(1.0))
