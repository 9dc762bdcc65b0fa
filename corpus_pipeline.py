"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, secret scans, packing.

Every stage works on all that the one before kept and returns the columns of documents, the last
one the packed pieces.  Stages meet as Parquet in the shared folder, so a lost executor costs a
re-read of the stage before, not a recomputation of the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import decontaminate, packing, secret_scan, simhash, toxicity
from newsdesk.llm.queries import WINDOW_TOKENS, table, word_tokenizer
from newsdesk.session import stored

#: What a task holds of a table at once, on either side of Python: whole texts and vectors of sentences are large rows,
#: of which Spark's own 10,000 and 4,096 rows are tens of MB in each of several buffers.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session whose batches are small, unless the session has been given sizes of its own.

    They stay set, as what a stage returns is run later.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, size in BATCHES.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, size)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id."""
    return simhash.deduplicated(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark and ``n_chars`` with them."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return packing.pack(docs, word_tokenizer(), window=WINDOW_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The trained stages and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
