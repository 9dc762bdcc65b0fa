"""Evaluation of discovered accounts: what a model's answer may say, the prefilter, and the ladder of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions import text, variants
from newsdesk.plans.scoring import clamp


def prediction(answer: Column) -> Column:
    """The struct (score, confidence, category, recommendation, risk_flags, sample_quality, reason) of a model's JSON answer; null if it is no JSON.

    What is missing or of another type falls to its default: score 0, confidence 0.5, other, watch, mixed.
    """
    v = F.try_parse_json(F.nullif(F.trim(answer), F.lit("")))
    one_of = lambda path, values, default: F.when(variants.string_at(v, path).isin(*values), variants.string_at(v, path)).otherwise(default)
    flags = F.filter(F.transform(variants.strings_at(v, "$.riskFlags"), lambda f: F.trim(f)), lambda f: f != "")
    return F.when(v.isNotNull(), F.struct(
        clamp(F.coalesce(variants.number_at(v, "$.score"), F.lit(0.0)), 0, 100).alias("score"), clamp(F.coalesce(variants.number_at(v, "$.confidence"), F.lit(0.5)), 0, 1).alias("confidence"),
        one_of("$.category", C.CANDIDATE_CATEGORIES, "other").alias("category"), one_of("$.recommendation", C.RECOMMENDATIONS, "watch").alias("recommendation"),
        F.slice(flags, 1, C.MAX_RISK_FLAGS).alias("risk_flags"), one_of("$.sampleQuality", C.SAMPLE_QUALITIES, "mixed").alias("sample_quality"),
        F.substring(F.trim(F.coalesce(variants.string_at(v, "$.reason"), F.lit(""))), 1, 200).alias("reason"),
    ))


def candidate_status(score: Column, confidence: Column, mentioners: Column, sample_quality: Column, risk_flags: Column) -> Column:
    """Where an evaluated account goes: rejected, watch or needs_review; only a reviewer approves."""
    low, high = C.LADDER
    severe = F.exists(risk_flags, lambda f: F.lower(f).rlike(C.SEVERE_RISK))
    vouched = (mentioners >= 2) | ((mentioners >= 1) & (sample_quality == "good"))
    return (
        F.when(F.coalesce(severe, F.lit(False)) | (score < C.REJECTED_BELOW), "rejected").when(score < low, "watch")
        .when(score < high, F.when((mentioners >= 1) & (sample_quality != "poor"), "needs_review").otherwise("watch"))
        .when((confidence >= C.REVIEW_CONFIDENCE) & vouched, "needs_review").otherwise("watch")
    )


def prefiltered(bio: Column, followers: Column, samples: Column) -> Column:
    """Whether an account shows too little to ask about: no description, few followers and no sample."""
    return (F.trim(F.coalesce(bio, F.lit(""))) == "") & (F.coalesce(followers, F.lit(0)) < C.PREFILTER_FOLLOWERS) & (F.coalesce(F.size(samples), F.lit(0)) < 1)


def pending(candidates: DataFrame, limit: int = C.EVALUATION_LIMIT) -> DataFrame:
    """The next accounts to evaluate: pending, fetched, not evaluated yet, most mentioned first."""
    rows = candidates.filter((F.col("status") == "pending") & F.col("profile_fetched") & F.col("evaluated_at").isNull())
    return rows.orderBy(F.desc("mention_count"), "handle").limit(limit)


def evaluated(candidates: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(handle, status, ai_score, reason, trusted) of each account, after the prefilter and the model's ``answers`` (handle, answer).

    ``candidates`` holds handle, bio, followers, samples and mentioned_by (an array of names).  Trusted are
    mentioners that are active sources.  An account without an answer, or with one that is no JSON, stays pending.
    """
    # One row a name, compared by size before it is broadcast.
    known = sources.filter("active").select(text.name(F.col("handle")).alias("_by")).filter("_by is not null").distinct()
    by = candidates.select("handle", F.explode("mentioned_by").alias("_by")).select("handle", text.name(F.col("_by")).alias("_by")).distinct()
    trusted = by.join(known, "_by", "left_semi").groupBy("handle").agg(F.count("*").cast("int").alias("trusted"))
    rows = candidates.join(trusted, "handle", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0))).join(answers.select("handle", prediction(F.col("answer")).alias("p")), "handle", "left")
    poor = prefiltered(F.col("bio"), F.col("followers"), F.col("samples"))
    status = candidate_status(F.col("p.score"), F.col("p.confidence"), F.col("trusted"), F.col("p.sample_quality"), F.col("p.risk_flags"))
    return rows.select(
        "handle", F.when(poor, "rejected").when(F.col("p").isNull(), "pending").otherwise(status).alias("status"),
        F.when(~poor, F.col("p.score")).alias("ai_score"), F.when(poor, C.PREFILTER_REASON).otherwise(F.col("p.reason")).alias("reason"), "trusted",
    )
