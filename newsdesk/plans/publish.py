"""Publishing: candidates of an edition, ranking, sections, positions, and the Markdown edition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk import config as C
from newsdesk.functions import text, timing, urls
from newsdesk.operators.counters import counted
from newsdesk.operators.relational import latest, top, union_first_wins
from newsdesk.plans.scoring import trust_factor


def mapped(of: Column, names: dict[str, str], default: str | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), of), F.lit(default))


def section(headline: Column, primary: Column) -> Column:
    return F.when(headline, C.HEADLINE_SECTION).otherwise(mapped(F.coalesce(primary, F.lit("OTHER")), C.SECTION_OF, "9_other"))


def subsection(headline: Column, sub: Column) -> Column:
    return F.when(~headline, mapped(sub, C.SUBSECTION_OF))


def is_fallback(input_hash: Column) -> Column:
    return F.coalesce(F.startswith(input_hash, F.lit(C.FALLBACK_HASH_PREFIX)), F.lit(False))


def trust_by_handle(sources: DataFrame) -> DataFrame:
    """(_h, trust_label): one row for each account name, whatever its case and sign; of several sources the last counts."""
    named = sources.select(text.handle(F.col("handle")).alias("_h"), "trust_label", "source_id").filter("_h is not null")
    return named.groupBy("_h").agg(F.max_by("trust_label", "source_id").alias("trust_label"))


def eligible(items: DataFrame, classes: DataFrame, decisions: DataFrame, sources: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Items that may be published with their weighted priority: latest classification clean, unpublished, not blocked, and headline or tagged.

    ``seen`` gets all rows that are judged and returns them.
    """
    c = latest(classes, "item_id", "classified_at", "classification_id").withColumnRenamed("item_id", "id")
    d = latest(decisions, "item_id", "created_at", "decision_id").select(F.col("item_id").alias("id"), "decision_id", "priority_score", "headline_candidate", "input_hash")
    # A dimension: one row an account, compared by size before it is broadcast.
    trust = trust_by_handle(sources)
    rows = items.join(c, "id").join(d, "id", "left").withColumn("_h", F.when(F.col("platform") == "twitter", text.handle(F.col("source_ref")))).join(trust, "_h", "left")
    decided = F.col("decision_id").isNotNull()
    headline = F.coalesce(decided & ~is_fallback(F.col("input_hash")) & F.col("headline_candidate"), F.lit(False))
    ok = ~F.col("noise") & ~F.col("is_dup") & ~F.col("is_published") & ~F.col("trust_label").eqNullSafe(F.lit("blocked")) & (F.when(decided, headline).otherwise(F.col("is_headline")) | F.col("primary_tag").isNotNull())
    priority = F.when(decided, F.coalesce("priority_score", F.lit(0.0))).otherwise(F.coalesce("score", F.lit(0.0)) * 100) * trust_factor(F.col("trust_label"))
    placed = F.when(decided, headline).otherwise(F.col("is_headline"))
    return seen(rows).filter(ok).select("id", "platform", "title", "body", "url", "published_at", timing.recency(F.col("published_at"), F.col("ingested_at"), F.col("created_at")).alias("recency"), "primary_tag", "action_tag", headline.alias("headline"), F.round(priority, 6).alias("priority"), section(placed, F.col("primary_tag")).alias("section"))


def order() -> list[Column]:
    return [F.desc("headline"), F.desc("priority"), F.desc("recency"), F.col("id")]


def plan(candidates: DataFrame, limit: int = C.SELECTION_LIMIT, offset: int = 0) -> DataFrame:
    """The selection in total order, with rank and position after ``offset`` earlier ones."""
    return top(candidates, order(), min(limit, C.SELECTION_LIMIT)).withColumn("position", F.col("rank") + offset)


def appended(planned: DataFrame, bindings: DataFrame, edition: str) -> DataFrame:
    """``planned`` with positions after the last one that ``edition`` has among ``bindings`` (edition, id, section, position)."""
    last = bindings.filter(F.col("edition") == edition).agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))
    # One row.
    return planned.crossJoin(F.broadcast(last)).withColumn("position", F.col("rank") + F.col("_last")).drop("_last")


def counted_plan(items: DataFrame, classes: DataFrame, decisions: DataFrame, sources: DataFrame, limit: int = C.SELECTION_LIMIT) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``plan`` of what is ``eligible``, and the run's counters once an action has run it: scanned, eligible, selected, and of these headlines and tagged ones."""
    counts: list[Callable[[], dict[str, int]]] = []

    def watched(rows: DataFrame, **values: Column) -> DataFrame:
        out, count = counted(rows, **values)
        counts.append(count)
        return out

    found = watched(eligible(items, classes, decisions, sources, lambda rows: watched(rows, scanned=F.count("*"))), eligible=F.count("*"))
    planned = watched(plan(found, limit), selected=F.count("*"), headline_selected=F.count_if("headline"), tagged_selected=F.count_if(~F.col("headline")))
    return planned, lambda: {k: v for count in counts for k, v in count().items()}


def windowed(items: DataFrame, start: Column, stop: Column, classes: DataFrame, main: int = C.MAIN_LIMIT, rescue: int = C.RESCUE_LIMIT) -> DataFrame:
    """An edition's window, at most ``main`` items newest first (nulls last), and up to ``rescue`` late ones; main rows win.

    Late are items published in the two days before that came in, or were classified, within the window.
    ``clamped`` tells on every row whether the main window held more.
    """
    newest = [F.col("published_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("id")]
    within = lambda c: (F.col(c) >= start) & (F.col(c) < stop)
    inside = items.filter(timing.in_window(F.col("published_at"), F.col("ingested_at"), start, stop))
    classified = classes.filter(within("classified_at")).select(F.col("item_id").alias("id")).distinct().withColumn("_classified", F.lit(True))
    before = items.filter((F.col("published_at") >= start - F.make_interval(days=F.lit(2))) & (F.col("published_at") < start))
    late = before.join(classified, "id", "left").filter(F.coalesce(within("ingested_at"), F.lit(False)) | F.col("_classified")).drop("_classified")
    more = inside.limit(main + 1).agg((F.count("*") > main).alias("clamped"))
    rows = union_first_wins(inside.orderBy(*newest).limit(main).withColumn("origin", F.lit("main")), late.select(items.columns).orderBy(*newest).limit(rescue).withColumn("origin", F.lit("rescue")), "id")
    # One row.
    return rows.crossJoin(F.broadcast(more))


def per_section(planned: DataFrame, limit: int = C.SECTION_LIMIT) -> DataFrame:
    """At most ``limit`` of each section, in order of position."""
    numbered = planned.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("position", "id")))
    return numbered.filter(F.col("place") <= limit)


def composed(rows: DataFrame, clustered: bool = True) -> DataFrame:
    """Each section's articles in the order an edition prints them, up to the section's limit, with ``place`` and the section's ``candidates``.

    ``rows`` holds id, section, position, priority_score, headline_score, final_headline_score, score and
    trust_label.  All scores are weighed by trust.  Sections go by priority, then headline score, then score;
    the headlines, if topics are clustered, by final headline score first.  Equal ones go by position.
    """
    factor = trust_factor(F.col("trust_label"))
    weighed = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * factor
    foremost = F.lit(clustered) & (F.col("section") == C.HEADLINE_SECTION)
    first = F.when(foremost, weighed("final_headline_score")).otherwise(weighed("priority_score"))
    second = F.when(foremost, weighed("priority_score")).otherwise(weighed("headline_score"))
    group = Window.partitionBy("section")
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.SECTION_LIMITS.items() for x in kv]), F.col("section")), F.lit(C.SECTION_LIMIT))
    place = F.row_number().over(group.orderBy(first.desc(), second.desc(), weighed("score").desc(), "position", "id"))
    return rows.withColumn("candidates", F.count("*").over(group)).withColumn("place", place).filter(F.col("place") <= limit)


def required_articles(candidates: Column, selected: Column, least: int | Column = C.DENSE_ITEMS, dense: int | Column = C.DENSE_ITEMS) -> Column:
    """How many articles a section has to print: ``least`` of a dense one that has as many, else none."""
    return F.when((candidates >= dense) & (selected >= least), F.least(F.lit(least), selected)).otherwise(0)


def density(selected: DataFrame, printed: DataFrame, least: int = C.DENSE_ITEMS, dense: int = C.DENSE_ITEMS) -> DataFrame:
    """(section, candidates, selected, required, actual, short) of each section of a composed edition.

    A section of at least ``dense`` candidates and ``least`` articles has to print ``least``; ``printed``
    (section, articles) counts what the text has, nothing where a section is missing.
    """
    sizes = selected.groupBy("section").agg(F.max("candidates").alias("candidates"), F.count("*").alias("selected"))
    required = required_articles(F.col("candidates"), F.col("selected"), least, dense)
    met = sizes.withColumn("required", required).join(printed.select("section", F.col("articles").alias("actual")), "section", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return met.withColumn("short", (F.col("required") > 0) & (F.col("actual") < F.col("required")))


def blurb() -> Column:
    value = F.coalesce(F.nullif(text.collapse(F.col("body")), F.lit("")), F.nullif(text.collapse(F.col("title")), F.lit("")))
    return F.when(F.length(value) <= 280, value).otherwise(F.concat(F.substring(value, 1, 279), F.lit("…")))


def markdown(planned: DataFrame, edition_date: str, limit: int = C.SECTION_LIMIT, summary_chars: int = 280) -> DataFrame:
    """One row ``content``: an edition of all sections, each with its articles; sections and selections are bounded, so one row holds them."""
    clipped = F.rtrim(F.substring(blurb(), 1, summary_chars))
    days = F.datediff(F.lit(edition_date).cast("date"), F.to_date("published_at"))
    recency = F.when(days.isNull(), "公開日未設定").when(days <= 0, "当日公開").when(days <= 2, F.concat(F.lit("直近"), days, F.lit("日"))).when(days <= 7, F.concat(days, F.lit("日前"))).otherwise("7日超")
    why = F.concat(F.lit("Why it matters: "), "platform", F.lit("由来の"), F.coalesce("primary_tag", F.lit("未分類")), F.lit("領域（"), F.coalesce("action_tag", F.lit("INFO")), F.lit("）。"), recency, F.lit("の更新で、優先度判断の材料になる。"))
    block = F.concat_ws("\n", F.concat(F.lit("### "), F.coalesce(F.nullif(text.collapse(F.col("title")), F.lit("")), F.lit("Untitled"))), F.array_join(text.sentences(F.coalesce(clipped, F.lit("概要情報なし。"))), "\n"), why, F.concat(F.lit("引用元: ["), "platform", F.lit("]("), "url", F.lit(")")), F.lit(""))
    articles = per_section(planned, limit).withColumn("block", block).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("blocks"))
    spark = planned.sparkSession
    sections = spark.createDataFrame([(i + 1, k, f"## {i + 1}. {t}\n") for i, (k, t) in enumerate(C.SECTION_TITLES.items())], "no int, section string, heading string")
    lines = sections.join(articles, "section", "left").select("no", F.concat_ws("\n", "heading", F.array_join(F.transform(F.coalesce("blocks", F.array().cast("array<struct<place:int,block:string>>")), lambda b: b["block"]), "\n")).alias("part"))
    return lines.agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda p: p["part"]), "\n")).alias("content"))


def parsed(editions: DataFrame, key: str | None = None) -> DataFrame:
    """(section, article, title, url) of Markdown editions (``content``): each article under the heading before it; with ``edition``, too, if ``key`` names what tells them apart."""
    # Numbered before the lines are dealt out: beside a generator the number would be one a line.
    lines = editions.withColumn("edition", F.col(key) if key else F.monotonically_increasing_id()).select("edition", F.posexplode(F.split("content", "\n")))
    order = Window.partitionBy("edition").orderBy("pos")
    of = lambda p: F.nullif(F.regexp_extract("col", p, 1), F.lit(""))
    filled = lines.withColumn("section", F.last(of(r"^## (.*)$"), ignorenulls=True).over(order)).withColumn("article", F.count(of("^### (.*)$")).over(order)).withColumn("title", F.last(of("^### (.*)$"), ignorenulls=True).over(order))
    # An article's section and title are those of its own heading line; the lines up to the next one are its text.
    own = filled.filter("article > 0").groupBy("edition", "article").agg(F.min_by("section", "pos").alias("section"), F.min_by("title", "pos").alias("title"), F.max(of(r"^引用元: \[[^\]]*\]\((.*)\)$")).alias("url"))
    return own.select(*["edition"] * bool(key), "section", "article", "title", "url")


def section_counts(editions: DataFrame) -> DataFrame:
    return parsed(editions).groupBy("section").agg(F.count("*").alias("articles"))


def representative() -> list[Column]:
    """The order in which a group's rows stand for it: by final headline score, priority and score, each weighed by trust, then by position."""
    weighed = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * trust_factor(F.col("trust_label"))
    return [weighed("final_headline_score").desc(), weighed("priority_score").desc(), weighed("score").desc(), F.col("position"), F.col("id")]


def _collapsed(rows: DataFrame, key: Column, *more: Column) -> DataFrame:
    """``rows`` with ``_n`` rows of their key, ``_best`` (1 for the key's representative) and ``more`` over the key; a row without a key is alone."""
    own = F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("i"), "id"))
    keyed = rows.withColumn("_own", own).withColumn("_key", key)
    group = Window.partitionBy("_own")
    over = {f"_more{k}": c.over(group) for k, c in enumerate(more)}
    return keyed.withColumns({"_n": F.count("*").over(group), "_best": F.row_number().over(group.orderBy(*representative())), **over}).drop("_own")


def collapsed_topics(rows: DataFrame) -> DataFrame:
    """One row of each topic cluster of two or more rows and sources, moved to the headlines with a badge; other rows pass.

    ``rows`` holds id, section, title, position, topic_cluster_key, distinct_sources, trust_label and the
    scores that ``representative`` weighs.
    """
    key = F.nullif(F.col("topic_cluster_key"), F.lit(""))
    sized = _collapsed(rows, key, F.max(F.coalesce("distinct_sources", F.lit(0)))).withColumn("_many", F.col("_key").isNotNull() & (F.col("_n") > 1) & (F.col("_more0") >= 2))
    badge = F.concat(F.lit("["), F.col("_more0"), F.lit("媒体が言及]"))
    kept = sized.filter("not _many or _best = 1")
    return kept.withColumns({
        "section": F.when(F.col("_many"), C.HEADLINE_SECTION).otherwise(F.col("section")), "title": F.when(F.col("_many"), text.prepend_badge(F.col("title"), badge)).otherwise(F.col("title")),
        "distinct_sources": F.when(F.col("_many"), F.col("_more0")).otherwise(F.col("distinct_sources")),
    }).drop("_many", "_n", "_best", "_key", "_more0")


def collapsed_repositories(rows: DataFrame) -> DataFrame:
    """One row of each GitHub repository with the number of its updates before the title."""
    sized = _collapsed(rows, F.when(F.col("platform") == "github", urls.repo_key(F.col("url"))))
    many = F.col("_key").isNotNull() & (F.col("_n") > 1)
    badge = F.concat(F.lit("["), "_key", F.lit(" 更新"), F.col("_n"), F.lit("件]"))
    kept = sized.filter(~many | (F.col("_best") == 1))
    return kept.withColumn("title", F.when(many, text.prepend_badge(F.col("title"), badge)).otherwise(F.col("title"))).drop("_n", "_best", "_key")


def article_badges(articles: DataFrame, bound: DataFrame) -> DataFrame:
    """``articles`` (with their text as ``source``) and ``badge``: the mark of the edition's first item of that link, if its trust calls for one.

    ``bound`` holds url, position and trust_label of the edition's items.
    """
    marked = bound.filter(F.col("trust_label").isin(*C.TRUST_BADGES)).select(urls.article_key(F.col("url")).alias("_key"), "position", mapped(F.col("trust_label"), C.TRUST_BADGES).alias("_badge"))
    first = marked.filter("_key is not null").groupBy("_key").agg(F.min_by("_badge", F.struct("position", "_badge")).alias("badge"))
    return articles.withColumn("_key", urls.article_key(urls.first_link(F.col("source")))).join(first, "_key", "left").drop("_key")


def repair_needed(items: DataFrame, decisions: DataFrame, start: Column, stop: Column) -> DataFrame:
    """One row: window items, decided ones, fallbacks, and whether decisions must be made again before publishing."""
    rows = items.filter(timing.in_window(F.col("published_at"), F.col("ingested_at"), start, stop)).select("id")
    d = latest(decisions, "item_id", "created_at", "decision_id").select(F.col("item_id").alias("id"), is_fallback(F.col("input_hash")).alias("fallback"))
    counts = rows.join(d, "id", "left").agg(F.count("*").alias("items"), F.count("fallback").alias("decided"), F.count_if(F.col("fallback")).alias("fallbacks"))
    return counts.withColumn("needed", (F.col("items") > 0) & ((F.col("fallbacks") > 0) | (F.col("decided") == 0)))


def edition_lookup(editions: DataFrame, slug: str | None = None, day: str | None = None) -> DataFrame:
    """The edition asked for: by slug, else newest of the local day, else newest published with content, else newest with content."""
    has = F.length(F.coalesce("content", F.lit(""))) > 0
    rank = F.when(F.lit(slug is not None) & (F.col("slug") == F.lit(slug or "")), 1).when(F.lit(day is not None) & (timing.local_day(F.col("edition_at")) == F.lit(day or "")), 2).when(has & (F.col("status") == "published"), 3).when(has, 4)
    return editions.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", F.desc("updated_at"), "slug").limit(1).drop("_rank")



def bindings_upserted(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Bindings (edition, id, section, position): planned ones replace those of the same item, others stay."""
    kept = existing.join(planned.select("edition", "id"), ["edition", "id"], "left_anti")
    return kept.unionByName(planned.select(existing.columns))


def published_marked(classes: DataFrame, planned: DataFrame) -> DataFrame:
    """Classifications with the published flag set where the item has been planned."""
    marked = classes.join(planned.select(F.col("id").alias("item_id")).distinct().withColumn("_on", F.lit(True)), "item_id", "left")
    return marked.withColumn("is_published", F.col("is_published") | F.coalesce("_on", F.lit(False))).drop("_on")


def orphans_adopted(signals: DataFrame, items: DataFrame, edition: str, start: Column, stop: Column) -> DataFrame:
    """Voice signals without an edition get ``edition`` if their item lies in its window."""
    inside = items.filter(timing.in_window(F.col("published_at"), F.col("ingested_at"), start, stop)).select(F.col("id").alias("item_id"), F.lit(True).alias("_in"))
    met = signals.join(inside, "item_id", "left")
    return met.withColumn("edition_id", F.when(F.col("edition_id").isNull() & F.col("_in"), F.lit(edition)).otherwise(F.col("edition_id"))).drop("_in")


def edition_labels(day: Column) -> tuple[Column, Column]:
    """An edition's slug and title by its delivery date."""
    return F.concat(F.lit("daily-ai-news-"), F.date_format(day, "yyyy-MM-dd")), F.concat(F.lit("Daily AI News "), F.date_format(day, "yyyy/MM/dd"))
