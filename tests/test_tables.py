"""The versioned table, counters, and dense numbers."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from newsdesk.operators.counters import counted
from newsdesk.operators.relational import densely_numbered
from newsdesk.operators.versioned import Conflict, Versioned, retire

SCHEMA = "k long, v string, made string"


def table(spark, tmp_path, name="t"):
    return Versioned(spark, str(tmp_path / name), ("k",), SCHEMA, 8)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_keep_versions_and_untouched_files(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and held(t.read()) == []
    assert t.upsert(rows(spark, *[(k, f"a{k}", "first") for k in range(40)]), ["v", "made"]) == {"inserted": 40, "updated": 0, "skipped": 0}
    before = t.folders()
    again = rows(spark, (3, "b3", None), (4, "a4", "second"), (99, "b99", "second"))
    assert t.upsert(again, ["v"], ["made"]) == {"inserted": 1, "updated": 1, "skipped": 1}
    assert t.version() == 2
    touched = {str(r[0]) for r in again.select(t._bucket()).collect()}
    assert {b for b in before if t.folders()[b] != before[b]} <= touched and len(touched) < len(before)
    want = {k: (k, f"a{k}", "first") for k in range(40)} | {3: (3, "b3", "first"), 99: (99, "b99", None)}
    assert held(t.read()) == sorted(want.values(), key=str)
    assert held(t.read(1)) == sorted([(k, f"a{k}", "first") for k in range(40)], key=str)


def test_a_job_that_dies_before_its_manifest_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", "x"), (2, "b", "x")), ["v", "made"])
    staged = t.stage_upsert(rows(spark, (1, "new", "y"), (5, "e", "y")), ["v", "made"])
    # The rename never comes: a new reader, and a new writer, see the version before.
    later = table(spark, tmp_path)
    assert later.version() == 1 and held(later.read()) == [(1, "a", "x"), (2, "b", "x")]
    (tmp_path / "t" / "manifests" / ".draft").write_text("{")
    assert later.upsert(rows(spark, (2, "c", "z")), ["v", "made"])["updated"] == 1
    with pytest.raises(Conflict):
        t.publish(staged)
    assert held(t.read()) == [(1, "a", "x"), (2, "c", "z")]


def test_null_keys_and_nothing_incoming(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(rows(spark, (1, "a", "x")).limit(0), ["v", "made"]) == {"inserted": 0, "updated": 0, "skipped": 0}
    t.upsert(rows(spark, (1, None, None)), ["v", "made"])
    assert t.upsert(rows(spark, (1, None, None)), ["v", "made"])["skipped"] == 1
    assert held(t.read()) == [(1, None, None)]


def test_retention_is_a_checked_deletion(spark, tmp_path):
    raw, child = table(spark, tmp_path, "raw"), table(spark, tmp_path, "child")
    for t in (raw, child):
        t.upsert(rows(spark, *[(k, f"v{k}", "bound" if k % 4 == 0 else "free") for k in range(30)]), ["v", "made"])
    bound = lambda tables: tables[raw.path].filter("made = 'bound'").join(tables[child.path].select("k"), "k")
    gone = {raw: raw.read().filter("k < 10 and made = 'free'"), child: child.read().filter("k < 5 and made = 'free'")}
    assert retire(gone, [bound], dry_run=True) == {"raw": 7, "child": 3}
    assert raw.version() == 1 and raw.read().count() == 30
    with pytest.raises(ValueError, match="has to stay"):
        retire({raw: raw.read().filter("k < 10"), child: gone[child]}, [bound])

    def few(counts):
        if sum(counts.values()) > 5:
            raise ValueError("too many")

    with pytest.raises(ValueError, match="too many"):
        retire(gone, [bound], check=few)
    assert raw.version() == child.version() == 1
    assert retire(gone, [bound]) == {"raw": 7, "child": 3}
    assert raw.read().count() == 23 and child.read().count() == 27 and raw.read().filter("k = 8").count() == 1


def test_counters_come_with_the_job_and_beside_a_forest(spark, tmp_path):
    df = spark.range(100).withColumn("label", (F.col("id") % 2).cast("double"))
    model = RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=3).fit(VectorAssembler(inputCols=["id"], outputCol="f").transform(df))
    for n in (100, 40):
        seen, counts = counted(model.transform(VectorAssembler(inputCols=["id"], outputCol="f").transform(df.limit(n))), scanned=F.count("*"), odd=F.count_if(F.col("label") == 1))
        seen.select("id").write.mode("overwrite").parquet(str(tmp_path / "out"))
        assert counts() == {"scanned": n, "odd": n // 2}


def test_dense_numbers_need_no_single_task(spark):
    values = list(range(500)) * 2
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = [(r.v, r.i, r.number) for r in densely_numbered(df, [F.col("v"), F.col("i").desc()]).orderBy("number").collect()]
    assert [g[2] for g in got] == list(range(1000)) and [g[:2] for g in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0], -x[1]))
    assert densely_numbered(df.limit(0), [F.col("v")]).collect() == []
