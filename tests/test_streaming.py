from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsdesk.streaming import refine


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()


def test_first_seen_and_counts(spark, tmp_path):
    base = datetime(2024, 1, 1, 20)
    rows = [(k % 5, base + timedelta(minutes=30 * k)) for k in range(10)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, at timestamp").write.parquet(path)
    stream = refine.landing(spark, path, "id int, at timestamp")
    run(refine.first_seen(stream, ["id"], "at"), "seen")
    assert spark.table("seen").count() == 5
    run(refine.edition_counts(refine.landing(spark, path, "id int, at timestamp"), "at"), "counts", "complete")
    assert sorted(r["items"] for r in spark.table("counts").collect()) == [2, 8]


def test_ledger_skips_unchanged_rows(spark, tmp_path):
    source, ledger, sink = (str(tmp_path / n) for n in ("src", "ledger", "sink"))
    step = refine.ledgered(lambda d: d.withColumn("done", F.lit(True)), ledger, sink, ["id"], "hash")
    step(spark.createDataFrame([(1, "a"), (2, "b")], "id int, hash string"), 0)
    second = spark.createDataFrame([(1, "a"), (2, "c")], "id int, hash string")
    step(second, 1)
    step(second, 1)
    got = spark.read.parquet(f"{sink}/epoch=1").select("id", "hash").collect()
    assert [(r.id, r.hash) for r in got] == [(2, "c")]
    assert source


def test_frozen_editions_reject_rows(spark):
    rows = spark.createDataFrame([(1, "e1"), (2, "e2")], "id int, edition string")
    editions = spark.createDataFrame([("e1", "published"), ("e2", "draft")], "edition string, status string")
    assert [r.id for r in refine.unfrozen(rows, editions).collect()] == [2]
