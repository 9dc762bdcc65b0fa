"""Rule classification: noise, primary, sub and action tags, confidence, signals.

One projection: every keyword count is an expression over one lower-cased text, so no row leaves
its task and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions.text import collapse, held, hits, matches
from newsdesk.operators.relational import first_per_key, latest


def text_of(*parts: Column) -> Column:
    """Non-blank parts joined by lines, lower-cased and collapsed."""
    return collapse(F.lower(F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])))


#: All keywords of any list: a text is scanned once for them.
KEYWORDS = {
    k for lists in (C.PRIMARY_KEYWORDS.values(), C.ACTION_KEYWORDS.values(), C.SUB_KEYWORDS.values(), *[b.values() for b in C.PRIMARY_BOOSTS.values()], *[b.values() for b in C.ACTION_BOOSTS.values()], [C.AI_KEYWORDS]) for words in lists for k in words
}


def boosted(found: Column, platform: Column, tag: str, base: tuple[str, ...], boosts: dict) -> Column:
    total = hits(found, base)
    for name, words in boosts.items():
        if tag in words:
            total = total + F.when(platform == name, hits(found, words[tag])).otherwise(0)
    return total


def best(scores: list[tuple[str, Column]]) -> Column:
    """(score, tag) of the highest score, earlier ones first in a tie."""
    return F.array_max(F.array(*[F.struct(s.cast("int").alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("tag")) for k, (t, s) in enumerate(scores)]))


def scored(items: DataFrame, as_of: Column) -> DataFrame:
    """``items`` (id, platform, title, body, source_ref, url, published_at, ingested_at) with text, the keywords it holds (``held``), counts and the noise reason."""
    text = text_of(*(F.col(c) for c in ("title", "body", "source_ref", "url")))
    t, p = F.col("text"), F.col("platform")
    age = as_of.cast("double") - F.coalesce("published_at", "ingested_at").cast("double")
    minimum = F.lit(C.DEFAULT_LOW_INFO_MIN_CHARS)
    for name, n in C.LOW_INFO_MIN_CHARS.items():
        minimum = F.when(p == name, n).otherwise(minimum)
    reason = (
        F.when(t == "", "EMPTY_CONTENT").when((p == "twitter") & t.rlike(C.TWITTER_NOISE), "PLATFORM_NOISE_PATTERN")
        .when((F.length(t) < minimum) & (F.col("ai") < 2), "LOW_INFORMATION_DENSITY").when(age > C.STALE_DAYS * 86400, "STALE_INFORMATION").when(F.col("ai") == 0, "OUT_OF_SCOPE")
    )
    return items.withColumn("text", text).withColumn("held", held(t, KEYWORDS)).withColumn("ai", hits(F.col("held"), C.AI_KEYWORDS)).withColumn("noise_reason", reason).withColumn("noise", F.col("noise_reason").isNotNull())


def primary(found: Column, platform: Column) -> Column:
    return best([(tag, boosted(found, platform, tag, C.PRIMARY_KEYWORDS[tag], C.PRIMARY_BOOSTS)) for tag in C.PRIMARY_ORDER])


def classify(items: DataFrame, as_of: Column) -> DataFrame:
    """Each item's classification; tags are null for noise."""
    rows = scored(items, as_of)
    t, p, ok = F.col("held"), F.col("platform"), ~F.col("noise")
    rows = rows.withColumn("_p", F.when(ok, primary(t, p))).withColumn("_a", F.when(ok, best([(tag, boosted(t, p, tag, C.ACTION_KEYWORDS[tag], C.ACTION_BOOSTS)) for tag in C.ACTION_ORDER])))
    rows = rows.withColumn("primary_tag", F.when(F.col("_p.score") > 0, F.col("_p.tag")).otherwise("OTHER")).withColumn("_ps", F.greatest(F.col("_p.score"), F.lit(1)))
    rows = rows.withColumn("action_tag", F.when(F.col("_a.score") > 0, F.col("_a.tag")).otherwise("INFO"))
    sub = F.lit(None).cast("struct<score:int,order:int,tag:string>")
    for tag, subs in C.SUB_BY_PRIMARY.items():
        sub = F.when(F.col("primary_tag") == tag, best([(s, hits(t, C.SUB_KEYWORDS[s])) for s in subs])).otherwise(sub)
    rows = rows.withColumn("_s", sub).withColumn("sub_tag", F.when(F.col("_s.score") > 0, F.col("_s.tag")))
    low = F.length("text") < 120
    confidence = (
        0.5 + F.least("_ps", F.lit(4)) * 0.08 + F.when(F.col("sub_tag").isNotNull(), 0.08).otherwise(0.0) + F.when(F.col("action_tag") != "INFO", 0.06).otherwise(0.0)
        + F.when(F.col("ai") > 2, 0.08).otherwise(0.0) - F.when(low, 0.12).otherwise(0.0)
    )
    return rows.select(
        "id", "noise", "noise_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("primary_tag", "sub_tag", "action_tag")], (ok & low).alias("low_info"),
        F.round(F.when(F.col("noise"), F.when(F.col("noise_reason") == "LOW_INFORMATION_DENSITY", 0.72).otherwise(0.92)).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(0.99), confidence))), 6).alias("confidence"),
    )


def signals(items: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """(id, signals): the keywords behind a classification, at most ``limit``; noise keeps those of the domain."""
    rows = scored(items, as_of)
    t = F.col("held")
    domain = matches(t, C.AI_KEYWORDS, "domain:ai")
    rest = F.concat(*[matches(t, words, f"primary:{tag}") for tag, words in C.PRIMARY_KEYWORDS.items() if words], *[matches(t, words, f"action:{tag}") for tag, words in C.ACTION_KEYWORDS.items() if words])
    return rows.select("id", F.when(F.col("noise"), domain).otherwise(F.slice(F.concat(domain, rest), 1, limit)).alias("signals"))


def normalised_tags(rows: DataFrame) -> DataFrame:
    """Tags as an external model gave them, forced into their domains: unknown primary OTHER, sub tags only of their primary, unknown action INFO."""
    clean = lambda c: F.regexp_replace(F.upper(F.trim(F.col(c))), "[^A-Z0-9]+", "_")
    rows = rows.withColumns({c: clean(c) for c in ("primary_tag", "sub_tag", "action_tag")})
    allowed = F.lit(False)
    for tag, subs in C.SUB_BY_PRIMARY.items():
        allowed = allowed | ((F.col("primary_tag") == tag) & F.col("sub_tag").isin(*subs))
    return rows.withColumn("primary_tag", F.when(F.col("primary_tag").isin(*C.PRIMARY_ORDER), F.col("primary_tag")).otherwise("OTHER")).withColumn("sub_tag", F.when(allowed, F.col("sub_tag"))).withColumn("action_tag", F.when(F.col("action_tag").isin(*C.ACTION_ORDER), F.col("action_tag")).otherwise("INFO"))


def carried_forward(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """Fresh classifications with the flags of the item's latest earlier one, false where it has none."""
    flags = ["is_headline", "is_dup", "is_published"]
    last = latest(earlier, "item_id", "classified_at", "classification_id").select("item_id", *[F.col(f).alias(f"_{f}") for f in flags])
    return fresh.drop(*flags).join(last, "item_id", "left").select(*[c for c in fresh.columns if c not in flags], *[F.coalesce(f"_{f}", F.lit(False)).alias(f) for f in flags])


def pending(items: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Items without a completed run whose output names ``version``."""
    done = runs.filter((F.col("status") == "completed") & (F.get_json_object("output", "$.result.promptVersion") == version)).select("item_id")
    return items.join(done.distinct(), F.col("id") == F.col("item_id"), "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last attempt of each item and step."""
    return first_per_key(runs, ["item_id", "step"], [F.desc("attempt")])


def runs_appended(runs: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger ``runs`` (item_id, step, attempt, input_hash, status) with what was ``done`` (without attempt) as each item's next attempt of a step."""
    last = runs.groupBy("item_id", "step").agg(F.max("attempt").alias("_last"))
    new = done.join(last, ["item_id", "step"], "left").withColumn("attempt", F.coalesce("_last", F.lit(0)) + 1)
    return runs.unionByName(new.select(*runs.columns))


def unchanged(done: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of ``done`` whose last attempt of the step succeeded on the same input: there is nothing to do for them."""
    good = latest_runs(runs).filter("status = 'success'").select("item_id", "step", "input_hash")
    return done.join(good, ["item_id", "step", "input_hash"], "left_semi")
