"""The pipeline stage by stage: each one's effect on the small tables, and the whole against its parts."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from newsdesk.llm import common, decontaminate, packing, secret_scan, simhash, tokens
from newsdesk.llm.queries import ORACLE_SQL, QUERIES, table, word_tokenizer
from newsdesk.session import stored
from tests.llm.test_operators import brute_components, brute_contamination, brute_fingerprint, check_pieces


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_stages_of_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_stages_of_awkward_rows(spark, sf):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", None, 0), (None, "x y", "en", "s", 3), (3, "x y", None, "s", None)]
    state = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf).cache()
        counts.append(state.count())
    # Nothing is toxic; equal rows become one, as do rows without words, those of an id before those without.
    assert counts == [7, 3, 3, 3] and sorted((r.doc_id, r.text) for r in state.collect()) == [(1, "a b c"), (2, ""), (3, "x y")]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, state, sf).collect()} == {1, 2, 3}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    state = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in state.collect()}
        state = stage(spark, state, sf).cache()
        assert state.columns == columns
        after = {r.doc_id: r.text for r in state.collect()}
        assert set(after) <= set(before)
        seen.append(name)
        if name == "toxicity":
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in clean) >= 0.97 * len(clean)
        elif name == "near_dedup":
            label = brute_components([(i, brute_fingerprint(t)) for i, t in before.items()])
            assert set(after) == set(label.values())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            want = {r[0] for r in brute_contamination(list(before.items()), items) if not r[5]}
            assert set(after) == want
        else:
            assert set(after) == set(before)
            changed = {i for i in after if after[i] != before[i]}
            found = {r.doc_id for r in secret_scan.scan(docs).filter("is_secret").collect()}
            assert changed == found & set(after)
    # What a stage reads is what the one before wrote, in the order of its files.
    pieces = corpus_pipeline.STAGES[-1][1](spark, stored(state, "test-stage"), sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in state.collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    # Which documents share a shard depends on the order of files; each document's ids don't.
    ids = lambda rows: {k: b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start)) for k, own in by_doc(rows).items()}
    assert ids(whole) == ids(pieces) and {r.doc_id: r.doc_tokens for r in whole} == {r.doc_id: r.doc_tokens for r in pieces}
    check_pieces(whole, [(r.doc_id, r.text) for r in state.collect()])
    state.unpersist()


def test_stages_run_in_small_batches(spark, sf):
    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"bytes": b.nbytes}])

    large = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    sizes = lambda: [r.bytes for r in large.mapInArrow(measured, "bytes long").collect()]
    for _, stage in corpus_pipeline.STAGES:
        for key in corpus_pipeline.BATCHES:
            spark.conf.unset(key)
        assert max(sizes()) > 16e6
        stage(spark, table(spark, sf, "documents").limit(0), sf)
        assert max(sizes()) < 5e6
    key = next(iter(corpus_pipeline.BATCHES))
    spark.conf.set(key, 1 << 20)
    stage(spark, table(spark, sf, "documents").limit(0), sf)
    assert max(sizes()) < 1.3e6
    spark.conf.unset(key)


def test_tokenizer_goes_with_its_encoder():
    # Workers of the packing stage live on beside the next run's first stage.
    tokens.tokenizer.cache_clear()
    gone = weakref.ref(packing.encoder(word_tokenizer()))
    common.release()
    assert tokens.tokenizer.cache_info().currsize == 0
    gc.collect()
    assert gone() is None


def test_redacted_documents_have_their_own_length(spark, sf):
    texts = ['and the token = "0c497b5014f705c0be648d68b816f88c209136eb" then', "no secret", None]
    docs = spark.createDataFrame([(k, t, "en", "src0", t and len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.redact_secrets(spark, docs, sf)
    rows = out.collect()
    assert out.schema == docs.schema and "[SECRET]" in next(r.text for r in rows if r.doc_id == 0)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_every_operator_is_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_sql_agrees(spark, sf):
    import duckdb

    from tests.test_queries import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).df()), name


def test_stage_functions_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (2, None, "y", 2)], "doc_id long, text string, n string, node long")
    assert simhash.deduplicated(docs).columns == docs.columns
    bench = spark.createDataFrame([(1, "q r s")], "item_id long, text string")
    assert decontaminate.uncontaminated(docs, bench).count() == 3
