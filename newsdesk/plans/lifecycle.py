"""Lifecycle of discovered sources: conditions, actions, and the events that a source's state is folded from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk import config as C

RESETS = ("restore", "deactivate")


def flags(summary: DataFrame, as_of: Column) -> DataFrame:
    """(source_id, condition_keys, severe, should_act) of active discovered sources: noisy, low-priority and low-trust ones against the median and bottom decile of those with enough items.

    ``summary`` has counts and means, trust_score, type, active, created_at and cooldown_until.  Acted on are
    sources of at least ``MIN_SOURCE_AGE_DAYS`` whose cooldown, if they have one, is over.
    """
    rate = F.when(F.col("classes_28") > 0, F.col("noise_28") / F.col("classes_28"))
    scanned = summary.filter((F.col("type") == "discovered") & F.col("active")).withColumn("rate", rate)
    enough = F.col("classified_28") >= C.MIN_CLASSIFIED_28D
    # One row.
    bars = scanned.filter(enough).agg(F.median("rate").alias("_noise"), F.percentile("mean_priority", 0.1).alias("_low"))
    rows = scanned.crossJoin(F.broadcast(bars))
    keys = F.array_compact(F.array(
        F.when((F.col("rate") >= C.MIN_NOISE) & (F.col("rate") >= F.col("_noise") + C.NOISE_DELTA), "noisy"),
        F.when(F.col("mean_priority") <= F.col("_low"), "low_priority"), F.when(F.col("trust_score") < C.LOW_TRUST, "low_trust"),
    ))
    rested = F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= as_of)
    old = F.col("created_at") < as_of - F.make_interval(days=F.lit(C.MIN_SOURCE_AGE_DAYS))
    act = rested & old & enough & (F.size(keys) > 0)
    return rows.select("source_id", keys.alias("condition_keys"), (F.coalesce("rate", F.lit(0.0)) >= C.SEVERE_NOISE).alias("severe"), F.coalesce(act, F.lit(False)).alias("should_act"))


def due(flagged: DataFrame, as_of: Column) -> DataFrame:
    """The sources that may be acted on: those whose cooldown, if they have one, is over."""
    return flagged.filter(F.col("should_act") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= as_of)))


def cooled(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources just acted on or restored, left alone from now for ``COOLDOWN_DAYS``."""
    return sources.withColumn("cooldown_until", as_of + F.make_interval(days=F.lit(C.COOLDOWN_DAYS)))


def standing(events: DataFrame) -> DataFrame:
    """(source_id, reset, demotion): each source's last restore or deactivation, and its last demotion since, as structs of at, event_id and what the event says.

    ``events`` holds source_id, at, event_id, action, severe and condition_keys (an array).  Both are greatest
    values, which tasks take before anything is sent: a source may have any number of events.
    """
    said = F.struct("at", "event_id", "action", "severe", "condition_keys")
    last = events.groupBy("source_id").agg(F.max(F.when(F.col("action").isin(*RESETS), said)).alias("reset"), F.max(F.when(F.col("action") == "demote", said)).alias("demotion"))
    since = F.col("reset").isNull() | (F.col("demotion.at") > F.col("reset.at"))
    return last.withColumn("demotion", F.when(since, F.col("demotion")))


def actions(flagged: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """(source_id, action, reason, severe, condition_keys) for every source of ``flags`` that may be acted on.

    A demotion of 6 to 8 days ago that shares a condition is confirmed by deactivation; a younger one is
    waited for; else the source is demoted.
    """
    low, high = C.DEMOTE_DAYS
    rows = flagged.filter("should_act").join(standing(events).select("source_id", "demotion"), "source_id", "left")
    shared = F.coalesce(F.arrays_overlap("condition_keys", "demotion.condition_keys"), F.lit(False))
    age = (as_of.cast("double") - F.col("demotion.at").cast("double")) / 86400
    action = F.when(shared & age.between(low, high), "deactivate").when(shared & (age < low), "skip").otherwise("demote")
    reason = F.concat(F.lit("lifecycle:"), F.array_join("condition_keys", "+"))
    return rows.select("source_id", action.alias("action"), F.when(action == "skip", F.concat(reason, F.lit(":awaiting_second_window"))).otherwise(reason).alias("reason"), "severe", "condition_keys")


def written(events: DataFrame, acted: DataFrame, as_of: Column) -> DataFrame:
    """``events`` and one for each action but skips, its id told by its source, time and action."""
    new = acted.filter("action <> 'skip'").withColumn("at", as_of).withColumn("event_id", F.xxhash64("source_id", "at", "action"))
    return events.unionByName(new.select(*events.columns))


def folded(sources: DataFrame, events: DataFrame) -> DataFrame:
    """``sources`` (with active, cooldown_until, trust_label, deactivated_at) in the state that their events lead to, whatever they were in.

    The last restore or deactivation decides: activity, time of deactivation and cooldown.  A severe
    deactivation blocks the account, a restore makes a blocked one unknown.  Sources without such an event stay as they are.
    """
    met = sources.join(standing(events).select("source_id", "reset"), "source_id", "left")
    off, on = F.col("reset.action") == "deactivate", F.col("reset.action") == "restore"
    cooled = F.col("reset.at") + F.make_interval(days=F.lit(C.COOLDOWN_DAYS))
    some = F.col("reset").isNotNull()
    label = F.when(off & F.col("reset.severe"), "blocked").when(on & (F.col("trust_label") == "blocked"), "unknown").otherwise(F.col("trust_label"))
    return met.withColumns({
        "active": F.when(some, on).otherwise(F.col("active")), "cooldown_until": F.when(some, cooled).otherwise(F.col("cooldown_until")),
        "deactivated_at": F.when(off, F.col("reset.at")).when(on, F.lit(None)).otherwise(F.col("deactivated_at")), "trust_label": label,
    }).select(*sources.columns)


def applied(sources: DataFrame, acted: DataFrame, as_of: Column) -> DataFrame:
    """``sources`` after the actions themselves: the state kept beside the events."""
    met = sources.join(acted.filter("action = 'deactivate'").select("source_id", F.col("severe").alias("_severe")), "source_id", "left").withColumn("_until", as_of + F.make_interval(days=F.lit(C.COOLDOWN_DAYS)))
    off = F.col("_severe").isNotNull()
    return met.withColumns({
        "active": F.col("active") & ~off, "cooldown_until": F.when(off, F.col("_until")).otherwise(F.col("cooldown_until")),
        "deactivated_at": F.when(off, as_of).otherwise(F.col("deactivated_at")), "trust_label": F.when(F.col("_severe"), "blocked").otherwise(F.col("trust_label")),
    }).select(*sources.columns)


def demotions(events: DataFrame) -> DataFrame:
    """Demotions that confirm an earlier one: the same source's last demotion 6 to 8 days before, unless restored or deactivated in between, sharing a condition.

    ``events`` holds source_id, at, event_id, action and condition_keys (an array).
    """
    order = Window.partitionBy("source_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, when: F.last(F.when(when, c), ignorenulls=True).over(order)
    is_demotion, is_reset = F.col("action") == "demote", F.col("action").isin("restore", "deactivate")
    rows = events.withColumn("_at", last(F.col("at"), is_demotion)).withColumn("_keys", last(F.col("condition_keys"), is_demotion)).withColumn("_reset", last(F.col("at"), is_reset))
    age = (F.col("at").cast("double") - F.col("_at").cast("double")) / 86400
    good = is_demotion & age.between(6, 8) & (F.col("_reset").isNull() | (F.col("_reset") < F.col("_at"))) & F.arrays_overlap("condition_keys", "_keys")
    return rows.filter(good).select("source_id", "event_id", "at")
