"""Relational building blocks: latest per key, top per group, pages, set differences, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsdesk.session import stored


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; Spark keeps one row a key per task before the shuffle."""
    return ranked(df, keys, order, "_rank").filter("_rank = 1").drop("_rank")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, ties by ``tie`` descending; rows without a time are oldest."""
    return first_per_key(df, [key], [F.col(at).desc_nulls_last(), F.col(tie).desc()])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    return ranked(df, group, order, "rank").filter(F.col("rank") <= limit)


def top(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank; the limit bounds what one task numbers."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` (1 to 100) rows, with the total and the number of pages on each."""
    size, number = min(max(size, 1), 100), max(number, 1)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    # One row of counts.
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / size))


def with_ties(df: DataFrame, at: str, limit: int) -> DataFrame:
    """The oldest rows up to ``limit``, and all that share the last one's time."""
    bound = df.select(at).orderBy(at).limit(limit).agg(F.max(at).alias("_bound"))
    # One row.
    return df.join(F.broadcast(bound), F.col(at) <= F.col("_bound")).drop("_bound")


def densely_numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``df`` with 0, 1, 2 ... in ``order``, which has to be total; rows are ranged, never gathered in one task.

    Ranges are sorted and stored with each row's place in them; a range's first number is how many rows the
    ranges before it hold, one number a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    # The identifier's lower 33 bits count the rows of a partition.
    kept = stored(ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    first, before = [], 0
    for r in kept.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        first.append((r["_range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(first, "_range int, _first long")
    # One row a range.
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def union_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables' rows, one a key: the first table's where both have it."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def difference(wanted: DataFrame, existing: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What turns ``existing`` into ``wanted``: rows with ``change`` insert, update or delete; equal ones are left out."""
    w, e = wanted.select(*keys, *[F.col(v).alias(f"_w_{v}") for v in values], F.lit(True).alias("_w")), existing.select(*keys, *[F.col(v).alias(f"_e_{v}") for v in values], F.lit(True).alias("_e"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_w_{v}").eqNullSafe(F.col(f"_e_{v}"))
    change = F.when(F.col("_e").isNull(), "insert").when(F.col("_w").isNull(), "delete").when(~same, "update")
    return w.join(e, list(keys), "full_outer").withColumn("change", change).filter("change is not null").select(*keys, *[F.coalesce(F.col(f"_w_{v}"), F.col(f"_e_{v}")).alias(v) for v in values], "change")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The table after an upsert, with ``action`` inserted, updated, skipped or kept; columns in ``keep`` never change."""
    e = existing.select(*keys, *[F.col(v).alias(f"_e_{v}") for v in [*values, *keep]], F.lit(True).alias("_e"))
    i = incoming.select(*keys, *[F.col(v).alias(f"_i_{v}") for v in values], F.lit(True).alias("_i"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_i_{v}").eqNullSafe(F.col(f"_e_{v}"))
    both = e.join(i, list(keys), "full_outer")
    action = F.when(F.col("_i").isNull(), "kept").when(F.col("_e").isNull(), "inserted").when(same, "skipped").otherwise("updated")
    return both.select(*keys, *[F.when(F.col("_i").isNotNull(), F.col(f"_i_{v}")).otherwise(F.col(f"_e_{v}")).alias(v) for v in values], *[F.col(f"_e_{v}").alias(v) for v in keep], action.alias("action"))


def identified(incoming: DataFrame, existing: DataFrame, ident: str, *key_sets: Sequence[str]) -> DataFrame:
    """``incoming`` with the ``ident`` of the existing row that agrees in the first set of keys, else in the next one; null if none does.

    Of several existing rows of a key the smallest counts; null keys agree with nothing.
    """
    out, found = incoming, []
    for k, keys in enumerate(key_sets):
        known = existing.groupBy(*keys).agg(F.min(ident).alias(f"_{ident}{k}"))
        out = out.join(known, list(keys), "left")
        found.append(F.col(f"_{ident}{k}"))
    return out.withColumn(ident, F.coalesce(*found)).select(*incoming.columns, ident)


def unchanged_skipped(incoming: DataFrame, ledger: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """Incoming rows whose key and hash no earlier run has."""
    return incoming.join(ledger.select(*keys, hash_col).distinct(), [*keys, hash_col], "left_anti")
