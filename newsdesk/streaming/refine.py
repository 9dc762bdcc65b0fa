"""An optional streaming layer: the batch functions over unbounded input.

The batch plans stay authoritative; a stream keeps first sightings, skips what a ledger has already
seen unchanged, counts editions as they fill, and leaves frozen editions alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsdesk.operators.relational import unchanged_skipped
from newsdesk.session import hadoop_file


def landing(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Files as they arrive in a landing folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(items: DataFrame, keys: list[str], at: str = "ingested_at", delay: str = "2 days") -> DataFrame:
    """Each key once; state older than the delay is dropped."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def edition_counts(items: DataFrame, at: str = "published_at", delay: str = "2 days") -> DataFrame:
    """Items per edition window (24 hours from 21:00 UTC); rows up to two days late still count."""
    counted = items.withWatermark(at, delay).groupBy(F.window(at, "1 day", "1 day", "21 hours"))
    return counted.agg(F.count("*").alias("items")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "items")


def fresh(items: DataFrame, at: str, now: Column, lag_seconds: int = 2) -> DataFrame:
    """Rows old enough to be complete: a cursor just behind now never skips a row still being written."""
    return items.filter(F.col(at) <= now - F.make_interval(secs=F.lit(lag_seconds)))


def unfrozen(rows: DataFrame, editions: DataFrame, key: str = "edition") -> DataFrame:
    """Rows whose edition isn't published yet."""
    return rows.join(editions.filter("status = 'published'").select(key).distinct(), key, "left_anti")


def ledgered(process: Callable[[DataFrame], DataFrame], ledger_path: str, sink_path: str, keys: list[str], hash_col: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that processes only rows whose key and hash no earlier batch has, and records them.

    A batch that is run again writes to the same place and changes nothing.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(*keys, hash_col).schema
        files, at = hadoop_file(spark, ledger_path)
        others = [str(f.getPath()) for f in files.listStatus(at) if f.getPath().getName() != f"epoch={epoch}"] if files.exists(at) else []
        new = unchanged_skipped(batch, spark.read.schema(schema).parquet(*others), keys, hash_col) if others else batch
        process(new).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")
        new.select(*keys, hash_col).write.mode("overwrite").parquet(f"{ledger_path}/epoch={epoch}")

    return step
