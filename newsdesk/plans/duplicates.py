"""Duplicates: shared keys, similar titles, similar vectors, their components and masters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk import config as C
from newsdesk.functions import text, urls
from newsdesk.operators.components import connected_components, stars
from newsdesk.operators.relational import densely_numbered, first_per_key
from newsdesk.session import stored


def detail_score(profile: str = "rules") -> Column:
    """How much an item tells, from body, title, canonical_url, published_at and platform; two crosslinkers weigh it differently."""
    body, title, link, dated = (4000, 1.8, 20, 14) if profile == "rules" else (3500, 1.6, 18, 12)
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) if profile == "rules" else F.length(text.collapse(F.coalesce(F.col(c), F.lit(""))))
    score = F.least(size("body"), F.lit(body)) + F.least(size("title"), F.lit(220)) * title + F.when(F.col("canonical_url").isNotNull(), link).otherwise(0) + F.when(F.col("published_at").isNotNull(), dated).otherwise(0)
    if profile == "rules":
        bonus = F.lit(0)
        for p, n in C.DETAIL_PLATFORM.items():
            bonus = F.when(F.col("platform") == p, n).otherwise(bonus)
        score = score + bonus
    return F.round(score, 3)


def keys(items: DataFrame, profile: str = "rules") -> DataFrame:
    """(id, reason, key) of every key that may tie items together."""
    url, minimum = (urls.rules_key, 24) if profile == "rules" else (urls.prefilter_key, 20)
    pairs = F.array(
        F.struct(F.lit("canonical_url_match").alias("reason"), url(F.coalesce("canonical_url", "url")).alias("key")),
        F.struct(F.lit("url_match").alias("reason"), url(F.col("url")).alias("key")),
        F.struct(F.lit("title_exact_match").alias("reason"), text.key(F.col("title"), minimum).alias("key")),
    )
    return items.select("id", F.inline(pairs)).filter("key is not null")


def numbered(items: DataFrame) -> DataFrame:
    """(id, node): the numbers by which components are found; ``n`` is an item's own number."""
    return items.select("id", F.col("n").alias("node"))


def star_edges(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, reason): every item of a key tied to the key's smallest one, never all pairs."""
    k = keyed.join(nodes, "id")
    low = k.groupBy("reason", "key").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return k.join(low, ["reason", "key"]).filter("node <> v").select(F.col("node").alias("u"), "v", "reason").distinct()


def clusters(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items of components of more than one: ``items`` with component and size."""
    found = connected_components(edges)
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")
    return items.join(sized, F.col("n") == F.col("node")).drop("node")


def masters(members: DataFrame, profile: str = "rules") -> DataFrame:
    """Each cluster's members with its master: the most telling, then the newest, then the smallest id."""
    scored = members.withColumn("detail", detail_score(profile))
    order = [F.desc("detail"), F.coalesce("published_at", "ingested_at", "created_at").desc(), F.col("id")]
    return scored.join(first_per_key(scored, ["component"], order).select("component", F.col("id").alias("master_id")), "component")


def _with_master(members: DataFrame) -> DataFrame:
    """``members`` (with master_id) beside their master's links and title, as ``_m`` columns."""
    told = members.filter("id = master_id").select(F.col("id").alias("master_id"), *[F.col(c).alias(f"_m_{c}") for c in ("canonical_url", "url", "title")])
    return members.join(told, "master_id")


def _shared(profile: str) -> list[tuple[str, Column]]:
    """(reason, whether a member shares its key with its master), the strongest first."""
    url, minimum = (urls.rules_key, 24) if profile == "rules" else (urls.prefilter_key, 20)
    of = lambda p: [url(F.coalesce(f"{p}canonical_url", f"{p}url")), url(F.col(f"{p}url")), text.key(F.col(f"{p}title"), minimum)]
    return [(r, F.coalesce(a == b, F.lit(False))) for r, a, b in zip(("canonical_url_match", "url_match", "title_exact_match"), of(""), of("_m_"), strict=True)]


def member_reasons(members: DataFrame) -> DataFrame:
    """(id, master_id, reasons, score) of each cluster member but its master: the keys it shares with the master, or that only the cluster ties them."""
    found = F.array_compact(F.array(*[F.when(same, F.lit(r)) for r, same in _shared("rules")]))
    reasons = F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("cluster_match")))
    return _with_master(members).filter("id <> master_id").select("id", "master_id", reasons.alias("reasons")).withColumn("score", match_score(F.col("reasons")))


def prefilter_seeds(items: DataFrame, edges: DataFrame, day: str) -> DataFrame:
    """(id, cluster_id, canonical_id, seed_score, seed_reason, pruned) of every item, alone or in a cluster.

    Clusters are numbered in the order of their first item (``n``).  A pruned item's score is its strongest
    tie to the canonical item itself, or ``C.CLUSTER_SEED`` where only others tie the two.
    """
    met = items.join(connected_components(edges), F.col("n") == F.col("node"), "left").withColumn("component", F.coalesce("component", "n")).drop("node")
    serial = densely_numbered(met.select("component").distinct(), [F.col("component")], "serial")
    label = F.concat(F.lit(f"{day}-c"), F.when(F.col("serial") < 9999, F.lpad((F.col("serial") + 1).cast("string"), 4, "0")).otherwise((F.col("serial") + 1).cast("string")))
    rows = _with_master(masters(met, "prefilter")).join(serial, "component")
    words, theirs = text.tokens(F.col("title")), text.tokens(F.col("_m_title"))
    near = F.when((F.size(words) >= 4) & (F.size(theirs) >= 4), F.round(text.jaccard(words, theirs), 3))
    ties = [F.when(same, F.struct(F.lit(v).alias("score"), F.lit(-k).alias("order"), F.lit(r).alias("reason"))) for k, ((r, same), v) in enumerate(zip(_shared("prefilter"), C.SEED_SCORES, strict=True))]
    ties.append(F.when(near >= C.TITLE_JACCARD, F.struct(near.alias("score"), F.lit(-3).alias("order"), F.lit("title_similarity").alias("reason"))))
    tie, pruned = F.array_max(F.array_compact(F.array(*ties))), F.col("id") != F.col("master_id")
    return rows.select(
        "id", label.alias("cluster_id"), F.col("master_id").alias("canonical_id"), F.when(pruned, F.coalesce(tie["score"], F.lit(C.CLUSTER_SEED))).otherwise(0.0).alias("seed_score"),
        F.when(pruned, F.coalesce(tie["reason"], F.lit("cluster_similarity"))).otherwise("cluster_canonical").alias("seed_reason"), pruned.alias("pruned"),
    )


def match_score(reasons: Column) -> Column:
    score = F.lit(0.7)
    for reason, value in reversed(C.DUP_MATCH_SCORES):
        score = F.when(F.array_contains(reasons, reason), value).otherwise(score)
    return score


def published_matches(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """(id, published_id, reasons, score): candidates that share a key with a published item, by equi-join on (reason, key)."""
    mine = keys(candidates).unionByName(candidates.select("id", F.lit("direct_binding").alias("reason"), F.col("id").alias("key")))
    theirs = keys(published).unionByName(published.select("id", F.lit("direct_binding").alias("reason"), F.col("id").alias("key"))).withColumnRenamed("id", "published_id")
    met = mine.join(theirs, ["reason", "key"]).groupBy("id", "published_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return met.withColumn("score", match_score(F.col("reasons")))


def similar_titles(items: DataFrame, threshold: float = C.TITLE_JACCARD, first: int = 4, cap: int | None = None) -> DataFrame:
    """(u, v, similarity) of items whose titles' words overlap by ``threshold`` and share one of the earlier item's ``first`` words.

    Of k words in order of rarity, two lists at the threshold share one of the first k - ceil(threshold k) + 1
    of each: only items that share one of these rare words meet, by id alone.  ``cap`` keeps that many
    candidates of an item, in order of number.
    """
    # Read by every step below, so the words are made once.
    t = stored(items.select(F.col("n").alias("node"), text.tokens(F.col("title")).alias("words")), "title-words").filter(F.size("words") >= first)
    # Equal word lists collapse: candidates are found between distinct lists only.
    lists = t.groupBy("words").agg(F.min("node").alias("node"))
    each = lists.select("node", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("df"))
    by_rarity = each.join(counts, "word").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    telling = F.size("ranked") - F.ceil(F.size("ranked") * threshold - 1e-9).cast("int") + 1
    rare = by_rarity.select("node", F.size("ranked").alias("size"), F.inline(F.slice("ranked", 1, telling))).filter("df > 1").drop("df")
    other = rare.select(F.col("node").alias("v"), F.col("size").alias("sv"), "word")
    # A pair at the threshold has sizes within it: what differs more is never compared.
    fits = (F.col("sv") >= threshold * F.col("size")) & (F.col("size") >= threshold * F.col("sv"))
    pairs = rare.withColumnRenamed("node", "u").join(other, "word").filter((F.col("u") < F.col("v")) & fits).select("u", "v").distinct()
    met = pairs.join(lists.select(F.col("node").alias("u"), F.col("words").alias("wu")), "u").join(lists.select(F.col("node").alias("v"), F.col("words").alias("wv")), "v")
    met = met.filter(F.arrays_overlap(F.slice("wu", 1, first), F.col("wv")))
    if cap:
        from newsdesk.operators.relational import top_per_group

        met = top_per_group(met, ["u"], [F.col("v")], cap).drop("rank")
    found = met.withColumn("similarity", text.jaccard(F.col("wu"), F.col("wv"))).filter(F.col("similarity") >= threshold).select("u", "v", F.round("similarity", 3).alias("similarity"))
    same = t.join(lists.withColumnRenamed("node", "v"), "words").filter("node <> v").select(F.col("v").alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("similarity"))
    return found.unionByName(same)


BLOCK = "dim int, block long, ids binary, x binary"
#: Of a stored part of blocks; a task holds two.
PART_BYTES = 64 << 20


def _blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """(dim, block, ids, x): usable vectors, of unit length, as rows of at most ``block_rows``, stored; ids and x are bytes of longs and doubles.

    Their parts, which meet in pairs, are as many as give eight tasks a core, more where a part would be larger than ``PART_BYTES``.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).filter("id is not null and x is not null")
    doubles = usable.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0
    parts = max(math.ceil(math.sqrt(8 * vectors.sparkSession.sparkContext.defaultParallelism)), math.ceil(8 * doubles / PART_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique, as a part is stored by one attempt of its task.
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.column("x")
            lengths = pc.list_value_length(rows).to_numpy()
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                ids, x = batch.column("id").to_numpy()[at], rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                ids, x = ids[good], x[good] / norm[good, None]
                for k in range(0, len(ids), block_rows):
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [block], "ids": [ids[k : k + block_rows].tobytes()], "x": [x[k : k + block_rows].tobytes()]})
                    block += 1

    return stored(usable.repartition(parts, "id").mapInArrow(pack, BLOCK), "vector-blocks")


def _met(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Every two blocks of vectors of one length, and each with itself, once: (own, a, x, b, y).

    A Cartesian product by tasks that read two stored parts each, so that nothing is shuffled however many pairs there are.
    """
    blocks = _blocks(vectors, block_rows)
    one = blocks.select(F.col("dim").alias("d"), F.col("block").alias("p"), F.col("ids").alias("a"), "x")
    other = blocks.select(F.col("dim").alias("e"), F.col("block").alias("q"), F.col("ids").alias("b"), F.col("x").alias("y"))
    p, q = F.col("p"), F.col("q")
    # Of the two orders of a pair one is taken, by turns, as then all tasks have about the same to do.
    once = (p == q) | ((p < q) == ((p + q) % 2 == 0))
    return one.hint("shuffle_replicate_nl").join(other, (F.col("d") == F.col("e")) & once).select((p == q).alias("own"), "a", "x", "b", "y")


def _products(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, cosine) of the pairs at the threshold, one matrix product for each two blocks."""
    for batch in batches:
        for own, *sides in zip(*[batch.column(c) for c in ("own", "a", "x", "b", "y")], strict=True):
            a, x, b, y = (np.frombuffer(s.as_buffer(), t) for s, t in zip(sides, (np.int64, np.float64) * 2, strict=True))
            c = x.reshape(len(a), -1) @ y.reshape(len(b), -1).T
            i, j = np.divmod(np.flatnonzero(c >= threshold), len(b))
            u, v, c = a[i], b[j], c[i, j]
            keep = u < v if own.as_py() else u != v
            if keep.any():
                yield np.minimum(u, v)[keep], np.maximum(u, v)[keep], c[keep]


def cosine_pairs(vectors: DataFrame, threshold: float = C.COSINE_THRESHOLD, block_rows: int = 1024) -> DataFrame:
    """(u, v, cosine) for u < v with cosine at least ``threshold``, of vectors (vec_id, embedding).

    Blocks of rows meet in pairs, each pair one matrix product in one task: memory is bounded by two
    parts of the stored blocks.  Null, zero and non-finite vectors are left out; vectors of other lengths are no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, c in _products(batches, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(c)], ["u", "v", "cosine"])

    return _met(vectors, block_rows).mapInArrow(run, "u long, v long, cosine double")


def cosine_links(vectors: DataFrame, threshold: float = C.COSINE_THRESHOLD, block_rows: int = 1024) -> DataFrame:
    """(u, v) with the components of ``cosine_pairs``, however many pairs there are: a task's pairs come as its components' stars.

    A task holds the stars of its two parts' vectors and, besides, as many pairs or a million.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 1 << 20
        for u, v, _ in _products(batches, threshold):
            held.append((u, v))
            n += len(u)
            if n > most:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                most = max(1 << 20, 2 * n)
        if held:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _met(vectors, block_rows).mapInArrow(run, "u long, v long")


def topic_clusters(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id, topic_key, size, sources, platforms, boost) of every vector; single ones are clusters too."""
    members = vectors.join(connected_components(edges), F.col("vec_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "vec_id"))
    stats = members.groupBy("component").agg(
        F.concat(F.lit("tc_"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("vec_id").cast("string"))), "|"), 256), 1, 16)).alias("topic_key"),
        F.count("*").alias("size"), F.countDistinct(F.concat_ws(":", "platform", F.lower("source_ref"))).alias("sources"), F.countDistinct("platform").alias("platforms"),
    )
    # What counts is how many sources tell of it: a source repeating itself is no topic.
    boost = F.when(F.col("sources") >= 2, F.log2(1 + F.col("sources")) * (1 + C.CLUSTER_GAMMA * (F.col("platforms") - 1))).otherwise(0.0)
    return members.select("vec_id", "component").join(stats, "component").select("vec_id", "topic_key", "size", "sources", "platforms", F.round(boost, 6).alias("boost"))

