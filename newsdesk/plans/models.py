"""External models behind a small interface, with offline stand-ins that give the same answer every time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions import variants
from newsdesk.operators.relational import first_per_key, latest
from newsdesk.operators.versioned import Versioned
from newsdesk.plans import classify, publish
from newsdesk.session import stored as kept


class ModelClient(Protocol):
    """Anything that answers a batch of prompts; it is built in the task, so it needs no pickling of connections."""

    def answer(self, prompts: list[str]) -> list[str]: ...


def asked(rows: DataFrame, prompt: str, client: type[ModelClient], batch: int = 45) -> DataFrame:
    """``rows`` with ``answer``, asked in batches within each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for part in parts:
            prompts = part[prompt].fillna("").tolist()
            part["answer"] = [a for k in range(0, len(prompts), batch) for a in own.answer(prompts[k : k + batch])]
            yield part

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string")


def settled(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], judged: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """``rows`` with ``answer``, ``attempts`` and ``problem``, asked again until an answer has no problem, at most ``rounds`` times.

    ``ask`` adds answers; ``judged`` adds a text column ``problem``, null for a good answer.  Each round asks only for
    rows that are not settled, and they carry the last ``problem`` with them, null at first.  Answers are stored as
    they come, so that reading the result asks nothing again.  Rows without a good answer keep the last one.
    """
    columns = rows.columns
    open_, done = rows.withColumn("problem", F.lit(None).cast("string")), []
    for k in range(1, rounds + 1):
        answered = kept(judged(ask(open_).drop("problem")).withColumn("attempts", F.lit(k)), "answers")
        good = F.col("problem").isNull()
        done.append(answered if k == rounds else answered.filter(good))
        open_ = answered.filter(~good).select(*columns, "problem")
        if k < rounds and open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def classified(items: DataFrame, as_of: Column, ask: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """(id, primary_tag, sub_tag, action_tag, by, attempts): a model's tags forced into their domains, the rules' where it gives no object."""
    v = F.try_parse_json("answer")
    judged = settled(items, ask, lambda d: d.withColumn("problem", F.when(F.coalesce(variants.kind(v) == "object", F.lit(False)), None).otherwise("answer with one JSON object")), rounds)
    good = F.col("problem").isNull()
    given = judged.filter(good).select("id", "attempts", *[F.coalesce(variants.string_at(v, f"$.{c}"), F.lit("")).alias(c) for c in ("primary_tag", "sub_tag", "action_tag")])
    rules = classify.classify(items, as_of).select("id", "primary_tag", "sub_tag", "action_tag").join(judged.filter(~good).select("id", "attempts"), "id")
    names = ["id", "primary_tag", "sub_tag", "action_tag", "by", "attempts"]
    return classify.normalised_tags(given).withColumn("by", F.lit("model")).select(names).unionByName(rules.withColumn("by", F.lit("rules")).select(names))


def composed(editions: DataFrame, selected: DataFrame, ask: Callable[[DataFrame], DataFrame], retries: int = 1) -> DataFrame:
    """(edition, content, attempts, shortages) of editions as a model writes them, asked again with their shortages while a dense section is thin.

    ``selected`` holds edition, section, candidates and one row an article.  The last text stays, thin or not.
    """
    sizes = selected.groupBy("edition", "section").agg(F.max("candidates").alias("candidates"), F.count("*").alias("selected"))
    need = kept(sizes.withColumn("required", publish.required_articles(F.col("candidates"), F.col("selected"))).filter("required > 0"), "required")

    def judged(answered: DataFrame) -> DataFrame:
        printed = publish.parsed(answered.select("edition", F.col("answer").alias("content")), "edition").groupBy("edition", "section").agg(F.count("*").alias("actual"))
        short = need.join(printed, ["edition", "section"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).filter("actual < required")
        said = short.groupBy("edition").agg(F.array_join(F.array_sort(F.collect_list(F.concat("section", F.lit("("), "actual", F.lit("/"), "required", F.lit(")")))), " ").alias("problem"))
        return answered.join(said, "edition", "left")

    return settled(editions, ask, judged, retries + 1).select("edition", F.col("answer").alias("content"), "attempts", F.col("problem").alias("shortages"))


def embedded(items: DataFrame, texts: Column, ask: Callable[[DataFrame], DataFrame], cache: Versioned) -> tuple[DataFrame, int]:
    """``items`` with ``text_hash`` and ``vector``, and how many texts were asked for.

    ``cache`` holds text_hash and vector.  Texts that it lacks are asked for once each, however many items have
    them, by ``ask``, which adds ``vector`` to (text_hash, text); their vectors are added before the result is read.
    """
    hashed = items.withColumn("_text", F.coalesce(texts, F.lit(""))).withColumn("text_hash", F.sha2("_text", 256))
    missing = hashed.select("text_hash", F.col("_text").alias("text")).dropDuplicates(["text_hash"]).join(cache.read().select("text_hash"), "text_hash", "left_anti")
    new = kept(ask(missing).select("text_hash", "vector"), "vectors")
    counts = cache.upsert(new, ["vector"])
    return hashed.drop("_text").join(cache.read(), "text_hash", "left"), counts["inserted"]


def fallback_decisions(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Decisions without a model: priority is 50 times the latest score, no headline, and a hash that says so."""
    c = latest(classes, "item_id", "classified_at", "classification_id")
    rows = items.join(c, F.col("id") == F.col("item_id"))
    return rows.select("item_id", F.round(F.coalesce("score", F.lit(0.5)) * 50, 3).alias("priority_score"), F.lit(False).alias("headline_candidate"), F.concat(F.lit(C.FALLBACK_HASH_PREFIX), F.sha2("item_id", 256)).alias("input_hash"))


def clamped_decisions(raw: DataFrame) -> DataFrame:
    """A model's scores forced into 0 to 100 and 0 to 1; missing ones become neutral."""
    between = lambda c, high, default: F.greatest(F.lit(0.0), F.least(F.lit(high), F.coalesce(F.col(c).try_cast("double"), F.lit(default))))
    return raw.select("item_id", between("priority_score", 100.0, 50.0).alias("priority_score"), between("headline_score", 100.0, 0.0).alias("headline_score"), between("dup_score", 1.0, 0.0).alias("dup_score"))


def decisions_upserted(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored decisions with fresh ones in place of those of the same key; the newest of a key wins."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return first_per_key(rows, keys, [F.desc("_new"), F.col("created_at").desc_nulls_last(), F.col("input_hash")]).drop("_new")


def embeddings_missing(items: DataFrame, stored: DataFrame, texts: Column) -> DataFrame:
    """Items whose text has no stored vector yet, by the hash of the text."""
    hashed = items.withColumn("text_hash", F.sha2(F.coalesce(texts, F.lit("")), 256))
    return hashed.join(stored.select("text_hash").distinct(), "text_hash", "left_anti")


def untranslated(classes: DataFrame, limit: int) -> DataFrame:
    """Latest classifications without a title of their own, newest first."""
    rows = latest(classes, "item_id", "classified_at", "classification_id").filter("title_ja is null and not noise")
    return rows.orderBy(F.desc("classified_at"), F.desc("classification_id")).limit(limit)
