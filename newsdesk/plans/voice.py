"""Voices: which posts speak, their topic, sentiment, use, weight, and summaries of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions import text
from newsdesk.operators.relational import first_per_key, top
from newsdesk.plans.classify import best
from newsdesk.plans.scoring import clamp


def primary_text() -> Column:
    return F.coalesce(*[F.nullif(text.collapse(F.col(c)), F.lit("")) for c in ("body", "title", "source_ref")], F.lit(""))


def is_social() -> Column:
    return F.col("platform").isin(*C.SOCIAL_PLATFORMS)


def speaks() -> Column:
    """Long enough to say something, short enough to be a voice: up to 420 characters on social platforms, 180 elsewhere."""
    n = F.length(primary_text())
    return (n >= 20) & F.when(is_social(), n <= 420).otherwise(n <= 180)


def candidate_score(recency: Column, as_of: Column) -> Column:
    n, age = F.length(primary_text()), (as_of.cast("double") - recency.cast("double")) / 3600
    score = (
        F.when(F.col("is_dup"), -24).otherwise(30) + F.when(F.col("is_published"), -6).otherwise(8) + F.when(is_social(), 18).otherwise(0)
        + F.when(n.between(40, 260), 12).when(n <= 420, 5).otherwise(0) + F.coalesce("score", F.lit(0.5)) * 12 + F.when(F.col("action_tag").isin("APPLY", "EVAL"), 3).otherwise(0)
        + F.when(age <= 24, 8).when(age <= 72, 4).when(age <= 168, 1).otherwise(0)
    )
    return F.when(speaks(), F.round(score, 3)).otherwise(-999.0)


def selected(items: DataFrame, as_of: Column, limit: int, over_fetch: int = 8) -> DataFrame:
    """The voices to analyse, with voice_score and rank: of the newest ``over_fetch`` times ``limit`` items those that speak and aren't noise, best first, the newer of equal ones first."""
    newest = [F.col("recency").desc_nulls_last(), F.col("id")]
    taken = items.orderBy(*newest).limit(limit * over_fetch)
    scored = taken.filter(~F.coalesce("noise", F.lit(True))).withColumn("voice_score", candidate_score(F.col("recency"), as_of)).filter("voice_score >= 0")
    return top(scored, [F.desc("voice_score"), *newest], limit)


def topic(combined: Column, source_ref: Column, primary_tag: Column) -> Column:
    """The first product or company a text names, else its source, else its tag's topic; at most 60 characters.

    Word borders are those of ASCII words, so a name may follow a letter of another script.
    """
    of = lambda p: F.nullif(F.regexp_extract(combined, f"(?i)(?<![A-Za-z0-9_])({p})", 1), F.lit(""))
    end = r"(?![A-Za-z0-9_])"
    named = [F.upper(text.collapse(of(C.TOPIC_GPT)))]
    named += [text.title_case(of(f + C.TOPIC_REST)) for f in C.TOPIC_FAMILIES]
    named += [text.title_case(of(C.TOPIC_LLAMA))]
    named += [F.when(of(f"(?:{p}){end}").isNotNull(), F.lit(name)) for p, name in C.TOPIC_NAMES]
    source = F.nullif(F.regexp_replace(text.collapse(source_ref), "^@", ""), F.lit(""))
    fallback = F.lit("AI General")
    for tag, name in C.TOPIC_FALLBACK.items():
        fallback = F.when(F.coalesce(primary_tag, F.lit("OTHER")) == tag, name).otherwise(fallback)
    return F.substring(F.coalesce(*[F.nullif(x, F.lit("")) for x in named], source, fallback), 1, 60)


#: All keywords of any list: a text is scanned once for them.
KEYWORDS = {*C.POSITIVE, *C.NEGATIVE, *[k for words in C.USAGE_CONTEXTS.values() for k in words]}


def with_sentiment(rows: DataFrame, lower: Column) -> DataFrame:
    """``rows`` with sentiment, usage_context and the confidence of both; ``lower`` is collapsed lower-case text."""
    rows = rows.withColumn("_held", text.held(lower, KEYWORDS))
    found = F.col("_held")
    rows = rows.withColumn("_pos", text.hits(found, C.POSITIVE)).withColumn("_neg", text.hits(found, C.NEGATIVE))
    d, p, n = F.col("_pos") - F.col("_neg"), F.col("_pos"), F.col("_neg")
    base = 0.54 + F.least(F.abs(d), F.lit(4)) * 0.09 - F.when((p > 0) & (n > 0), 0.08).otherwise(0.0) - F.when((d == 0) & (p == 0) & (n == 0), 0.08).otherwise(0.0)
    rows = rows.withColumn("sentiment", F.when(d >= 1, "positive").when(d <= -1, "negative").otherwise("neutral")).withColumn("_base", clamp(base, 0.42, 0.93))
    rows = rows.withColumn("_use", best([(k, text.hits(found, w)) for k, w in C.USAGE_CONTEXTS.items()])).withColumn("usage_context", F.when(F.col("_use.score") > 0, F.col("_use.tag")).otherwise("general"))
    final = F.col("_base") + F.when(F.col("usage_context") == "general", -0.04).otherwise(0.04) + (F.coalesce("score", F.lit(0.5)) - 0.5) * 0.2
    return rows.withColumn("confidence", F.round(clamp(final, 0.4, 0.95), 3)).drop("_held", "_pos", "_neg", "_base", "_use")


def sample_size(engagement: Column) -> Column:
    """1 to 9 by the order of magnitude of the positive engagement."""
    return F.when(engagement > 0, F.least(F.lit(9), F.greatest(F.lit(1), 1 + F.floor(F.log10(engagement + 1))))).otherwise(1).cast("int")


def total_engagement(metrics: Column, *direct: Column) -> Column:
    """The sum of all positive numbers among the metrics and the direct counts."""
    out = F.coalesce(F.aggregate(F.map_values(metrics), F.lit(0.0), lambda a, v: a + F.when(v > 0, v).otherwise(0.0)), F.lit(0.0))
    for d in direct:
        out = out + F.when(d > 0, d).otherwise(0.0)
    return out


def topic_summary(signals: DataFrame, limit: int = 12) -> DataFrame:
    """Per topic: counts of each sentiment, the most frequent use (earliest in a tie), the first two samples; the largest topics."""
    per = signals.groupBy("topic", "usage_context").agg(F.count("*").alias("n"), F.min("n").alias("first"))
    use = first_per_key(per, ["topic"], [F.desc("n"), F.col("first")]).select("topic", "usage_context")
    totals = signals.groupBy("topic").agg(F.count("*").alias("total"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")])
    from newsdesk.operators.relational import top_per_group

    samples = top_per_group(signals, ["topic"], [F.col("n")], 2).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]), ",").alias("samples"))
    return totals.join(use, "topic").join(samples, "topic").orderBy(F.desc("total"), "topic").limit(limit)


def upsert_targets(fresh: DataFrame, stored: DataFrame, model: str = C.VOICE_MODEL) -> DataFrame:
    """(item_id, signal_id, kind, action) of each fresh signal (item_id, edition_id, topic, sentiment, usage_context).

    The stored signal (those columns, signal_id, model, created_at, frozen) that it replaces is one of its
    own model: kind 1 agrees in edition, topic, sentiment and use, 2 in the edition, 3 is any; the newest of
    the best kind counts.  One of another edition that is frozen stays as it is: the fresh signal is skipped.
    """
    met = fresh.alias("f").join(stored.filter(F.col("model") == model).alias("s"), F.col("f.item_id") == F.col("s.item_id"), "left")
    agrees = lambda *names: reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in names])
    kind = F.when(F.col("s.signal_id").isNull(), None).when(agrees("edition_id", "topic", "sentiment", "usage_context"), 1).when(agrees("edition_id"), 2).otherwise(3)
    skipped = F.coalesce(F.col("s.frozen") & ~agrees("edition_id"), F.lit(False))
    rows = met.select(F.col("f.item_id").alias("item_id"), F.col("s.signal_id").alias("signal_id"), kind.alias("kind"), skipped.alias("skipped"), F.col("s.created_at").alias("created_at"))
    target = first_per_key(rows, ["item_id"], [F.col("kind").asc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("signal_id").desc()])
    action = F.when(F.col("kind").isNull(), "created").when(F.col("skipped"), "skipped").otherwise("updated")
    return target.select("item_id", F.when(~F.col("skipped"), F.col("signal_id")).alias("signal_id"), "kind", action.alias("action"))
