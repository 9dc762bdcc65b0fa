"""Kneser-Ney character models against plain dictionaries, and language identification on held-out documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred int, score string, entropy string"


def plain(text):
    """The definition of ``letters`` by characters."""
    out = " "
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out += low if len(low) == 1 else low[0] if low[0].isalpha() else c
        elif out[-1] != " ":
            out += " "
    if out == " ":
        return ""
    return out if out[-1] == " " else out + " "


class Plain:
    """One language's interpolated Kneser-Ney model by dictionaries."""

    def __init__(self, texts, alphabet):
        n = language.ORDER
        self.alphabet = alphabet
        self.counts = [Counter() for _ in range(n)]
        for t in texts:
            padded = "\0" * (n - 1) + plain(t)
            for i in range(n, len(padded)):
                self.counts[n - 1][padded[i - n + 1 : i + 1]] += 1
        for k in range(n - 2, -1, -1):
            for run in self.counts[k + 1]:
                self.counts[k][run[1:]] += 1
        self.cut, self.total, self.kinds = [], [], []
        for counts in self.counts:
            one, two = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            self.cut.append(min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5)
            total, kinds = Counter(), Counter()
            for run, c in counts.items():
                total[run[:-1]] += c
                kinds[run[:-1]] += 1
            self.total.append(total)
            self.kinds.append(kinds)

    def probability(self, run):
        k = len(run) - 1
        lower = self.probability(run[1:]) if k else 1 / self.alphabet
        total = self.total[k][run[:-1]]
        if not total:
            return lower
        return max(self.counts[k][run] - self.cut[k], 0) / total + self.cut[k] * self.kinds[k][run[:-1]] / total * lower

    def entropy(self, text):
        padded = "\0" * (language.ORDER - 1) + plain(text)
        runs = [padded[i - language.ORDER + 1 : i + 1] for i in range(language.ORDER, len(padded))]
        return -sum(math.log(self.probability(r)) for r in runs) / len(runs)


TEACH = {
    "en": ["the cat sat on the mat and the dog ran", "a good day for the dog, the cat and me", "there is nothing like the sea in winter", "Then they went to the market, and there was rain"],
    "de": ["der Hund und die Katze saßen auf der Matte", "ein schöner Tag für den Hund und die Straße", "nichts ist wie das Meer im Winter", "Dann gingen sie über den Markt, und es regnete"],
    "fr": ["le chat et le chien étaient sur le tapis", "une belle journée pour le chien, le chat et moi", "rien n'est comme la mer en hiver", "Puis ils allèrent au marché, où il pleuvait"],
}


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in TEACH.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return language.train(docs)


def test_letters_match_their_definition():
    for t in ["", " \n1.", "a", "A b", "  Ünïcode İstanbul 日本語 😀 x1y ", "don't STOP!", "ǅ ß ŉ"]:
        assert "".join(map(chr, language.letters(t.encode()))) == plain(t)
    assert language.letters(None).size == 0


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_model_against_dictionaries(taught, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    alphabet = len({c for ts in TEACH.values() for t in ts for c in plain(t)[1:]}) + 1
    texts = ["the dog", "der Hund läuft", "zzz qqq", "Привет, world", "x", *TEACH["fr"], "une mer " * 50]
    got = taught.entropies([language.letters(t.encode()) for t in texts])
    assert taught.languages == ["de", "en", "fr"]
    for k, lang in enumerate(taught.languages):
        model = Plain(TEACH[lang], alphabet)
        for row, t in zip(got, texts, strict=True):
            assert abs(row[k] - model.entropy(t)) < 1e-5, (lang, t)
    for run, lang in (("the", "en"), ("\0\0\0 d", "de")):
        model = Plain(TEACH[lang], alphabet)
        following = sum(model.probability(("\0\0\0\0" + run)[-4:] + c) for c in sorted({x for ts in TEACH.values() for t in ts for x in plain(t)[1:]} | {"?"}))
        assert abs(following - 1) < 1e-9


def test_tables_are_sorted(taught):
    for t in [*taught.runs, *taught.contexts]:
        assert (np.diff(t.keys.astype(object)) > 0).all() and t.rows.shape == (len(t.keys), 3)


def test_held_out_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op12_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {i for i, r in got.items() if r["held_out"]}
    right = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]
    assert sum(right) >= 0.98 * len(right)
    scores = defaultdict(list)
    for d, ok in zip(held, right, strict=True):
        scores[ok].append(got[d["doc_id"]]["score"])
    assert np.mean(scores[True]) > 0.85 and all(s < np.median(scores[True]) for s in scores[False])


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    odd = spark.createDataFrame([("Съешь ещё этих мягких французских булок, да выпей же чаю",), ("日本語の文章です。これは長い文です",), ("xqzvk wjxq zzkq vvxw qjq",)], "text string")
    assert [r["accepted"] for r in language.identified(odd, model).collect()] == [False] * 3
    # A language left out of the training is answered wrongly, and mostly rejected.
    fewer = language.train(docs.filter("lang <> 'es'"))
    es = language.identified(docs.filter("lang = 'es' and n_chars > 200"), fewer)
    known = language.identified(docs.filter("lang <> 'es' and n_chars > 200"), fewer)
    share = lambda df: df.agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert share(known) > 0.9 and share(es) < 0.2


def test_held_back_rows_and_other_columns_do_not_teach(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    back = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoiled = docs.withColumn("lang", F.when(back, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    of = lambda df: sorted(map(tuple, language.languages(df).collect()))
    assert of(docs) == of(spoiled)
    ids = docs.select((F.col("doc_id") + 1).alias("x"), "text", "lang", "source").collect()
    model = language.train(docs.filter(~back))
    text = docs.withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r["score"] for r in language.identified(text, model).collect()) == sorted(r["score"] for r in language.identified(docs, model).collect()) and ids


def test_awkward_rows(spark):
    long = "the sea and the dog " * 60_000
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in TEACH.items() for t in ts * 4)]
    odd = [(100, None, "en"), (101, "", "en"), (102, " 12 .;\n", None), (103, long, None), (103, long, None), (None, "der Hund", "de"), (None, None, None), (104, "das Meer", None), (105, "a\x00b", None), (106, "١٢٣ 😀", "fr")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "x", "y") for i, t, lang in rows + odd], SCHEMA).repartition(3)
    out = language.languages(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted", "entropy"]
    got = sorted(map(tuple, out.collect()), key=str)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == len(rows + odd) and sum(r[0] == 103 for r in got) == 2
    for i in (100, 101, 102, 106):
        assert by_id[i][2:] == ("und", 0.0, False, None)
    assert by_id[103][2] == "en" and by_id[104][2] == "de"
    assert all(0 <= r[3] <= 1 and r[2] in ("en", "de", "fr", "und") for r in got)
    assert sorted(r[1:3] for r in got if r[0] is None) == [(False, "de"), (False, "und")]


def test_nothing_or_one_language_to_learn(spark):
    none = spark.createDataFrame([(1, "hello there", None), (3, None, "en"), (5, "...", "fr")], "doc_id long, text string, lang string")
    assert {r[2:4] for r in map(tuple, language.languages(none).collect())} == {("und", 0.0)}
    assert language.languages(none.limit(0)).collect() == []
    one = spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEACH["en"])], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.languages(one).collect()} == {"en"}


def test_the_sample_bounds_what_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, sample = language._sample(docs, "doc_id", "text", "lang", 50_000, 10**9, None)
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    assert set(sizes) == {"de", "en", "es", "fr"} and all(10_000 < s < 120_000 for s in sizes.values())
    out = language.languages(docs, characters=50_000).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang = lang_pred").count() > 0.97 * docs.count()
