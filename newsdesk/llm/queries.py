"""One registered query per corpus operator, over whole tables with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import chat_format, decontaminate, embedding_dedup, language, license_scan, packing, quality, secret_scan, simhash, substring_dedup, toxicity, vector_codes, whitening

WINDOW_TOKENS = 2048
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), window=WINDOW_TOKENS, with_ids=False).drop("ids")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    return decontaminate.contamination(index, table(spark, sf_dir, "benchmark")).drop("spans", "items", "text_hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ok = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(ok)
    return chat_format.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"), with_text=False).drop("formatted", "token_ids", "loss")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept_text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's verdict; the candidate itself only as a digest."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("secret_sha256"), F.round("score", 9).alias("score"), "is_secret")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that every third labelled row taught nothing."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, table(spark, sf_dir, "labels"), allowed=f"not ({HELD_OUT})")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "text_score", "meta_score", "score", "keep")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS k, least(10, len(w)) AS n
  FROM b, unnest(range(greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, s.n, array_to_string(w[i + 1 : i + s.n], ' ') AS k FROM d, sizes s, unnest(range(len(w) - s.n + 1)) AS t(i)) x
  JOIN win USING (k, n)
),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM d, unnest(range(len(w) - 49)) AS t(i)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings
),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (SELECT u AS x, v AS y FROM link UNION SELECT r.x, l.v FROM reach r JOIN link l ON r.y = l.u),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
cnt AS (SELECT u, count(*) AS c FROM link GROUP BY u)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN low ON x = vec_id LEFT JOIN cnt ON u = vec_id
""",
}

_TEMPLATES = ", ".join("({}, '{}', {}, {}, {}, '{} {} {}')".format(*r) for r in license_scan.template_rows())
ORACLE_SQL["op4_license_scan"] = rf"""
WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
tpl(template, label, base, runs, place, gram) AS (VALUES {_TEMPLATES}),
hit AS (
  SELECT doc_id, template, label, base, runs, pos - place AS diagonal, pos, place
  FROM (SELECT doc_id, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM d, unnest(range(len(w) - 2)) AS t(i)) g JOIN tpl USING (gram)
),
diag AS (SELECT doc_id, template, label, base, runs, diagonal, bit_or(CAST(1 AS UBIGINT) << place) AS mask, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM hit GROUP BY ALL),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {license_scan.GAP} THEN 0 ELSE 1 END AS new FROM diag WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
num AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM cut),
spans AS (
  SELECT doc_id, template, label, base, runs, bit_count(bit_or(mask)) / runs AS merged, min(lo) AS lo, max(hi) AS hi, max(votes / runs) AS best,
    count(*) FILTER (votes = runs) AS places, min(diagonal) FILTER (votes = runs) AS low, max(diagonal) FILTER (votes = runs) AS high
  FROM num GROUP BY doc_id, template, label, base, runs, span
),
judged AS (
  SELECT *, CASE WHEN hi - lo + 1 <= {license_scan.STRETCH} * runs + {license_scan.GAP} THEN greatest(best, merged) ELSE best END AS cover FROM spans
),
found AS (SELECT *, CASE WHEN base THEN places > 0 ELSE cover >= {license_scan.COVER} END AS ok FROM judged),
per AS (
  SELECT doc_id, sum(CASE WHEN base THEN places ELSE 0 END) AS n_base, min(low) FILTER (base) AS first_word, max(high) FILTER (base) AS last_word,
    max(CASE WHEN ok THEN CASE WHEN base THEN 1.0 ELSE cover END WHEN NOT base THEN cover / 2 END) AS score
  FROM found GROUP BY doc_id
),
lab AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (is_base) AS base_labels
  FROM (SELECT doc_id, label, bool_or(base) AS is_base FROM found WHERE ok GROUP BY doc_id, label) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN lab USING (doc_id)
"""
