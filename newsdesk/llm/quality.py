"""Quality by co-training: a text classifier and a metadata classifier teach each other, then vote.

Every document's features are measured once and stored.  Both views start from the same labelled sample.
In each round either one scores all unlabelled documents and labels the ones that it is surest of; those
join the other's training rows.  Each view is then calibrated on labelled documents kept out of training,
and a last regression weighs the two calibrated views and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import bounded, space_words, utf8
from newsdesk.llm.toxicity import logistic
from newsdesk.session import stored

#: Bound of the labelled sample.
LABELLED = 6000
ROUNDS = 3
#: Share of all unlabelled documents that a view may label in a round, the confidence it needs, and how many of
#: a label are fitted at most: the surest ones of the whole table.
SHARE, SURE, FITTED = 0.05, 0.9, 600
#: Kinds of three successive bytes, by hash.
GRAMS = 64
META_BUCKETS = 64
BATCH_BYTES = 4 << 20
#: Byte classes of the text view: each printable ASCII sign that is no letter or digit on its own, then groups.
_CLASS = np.full(256, 0, np.int64)
for _b in range(256):
    if 0x61 <= _b <= 0x7A:
        _CLASS[_b] = 0
    elif 0x41 <= _b <= 0x5A:
        _CLASS[_b] = 1
    elif 0x30 <= _b <= 0x39:
        _CLASS[_b] = 2
    elif _b >= 0x80:
        _CLASS[_b] = 3
    elif _b in (9, 10, 11, 12, 13):
        _CLASS[_b] = 4
    elif _b == 32:
        _CLASS[_b] = 5
    elif _b < 32 or _b == 127:
        _CLASS[_b] = 6
    else:
        _CLASS[_b] = 7 + sum(1 for c in range(33, _b) if not chr(c).isalnum())
CLASSES = int(_CLASS.max()) + 1
_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint32)
TEXT_SIZE = 2 * CLASSES + 10 + GRAMS


def text_features(text: bytes | None) -> np.ndarray:
    """The content view: shares of byte classes and of hashed triples of bytes, how words repeat, their lengths, lines and length."""
    out = np.zeros(TEXT_SIZE)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=CLASSES)
    low = _LOWER[raw]
    triple = (low[:-2] * np.uint32(31) + low[1:-1]) * np.uint32(31) + low[2:]
    out[-GRAMS:] = np.sqrt(np.bincount((triple * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=GRAMS) / max(1, len(triple)))
    share = counts / len(text)
    out[:CLASSES] = np.sqrt(share)
    out[CLASSES : 2 * CLASSES] = np.log1p(1000 * share) / 7
    words = space_words(text)
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x]
    out[2 * CLASSES : -GRAMS] = (
        np.log1p(len(words)) / 10, len(set(words)) / n, lengths.mean() / 10 if len(words) else 0, (lengths.std() / 5) if len(words) else 0,
        (lengths == 1).sum() / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines) / n * 100) / 5,
        sum(w[-1:].isalpha() or w[-1:] >= b"\x80" for w in words) / n, sum(w.isupper() for w in words) / n, 1.0,
    )
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: language, source and size, hashed and binned; nulls are values of their own."""
    out = np.zeros(META_BUCKETS + 28)
    out[zlib.crc32(f"l:{lang}".encode()) % (META_BUCKETS // 2)] += 1
    out[META_BUCKETS // 2 + zlib.crc32(f"s:{source}".encode()) % (META_BUCKETS // 2)] += 1
    if n_chars is None or n_chars < 0:
        out[META_BUCKETS + 27] = 1
    else:
        size = np.log1p(n_chars)
        out[META_BUCKETS + min(24, int(1.6 * size))] = 1
        out[META_BUCKETS + 25], out[META_BUCKETS + 26] = size / 10, (size / 10) ** 2
    return out


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    combined: np.ndarray

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their combination."""
        a = _apply(self.text_scale, _logit(self.text, text)[:, None])
        b = _apply(self.meta_scale, _logit(self.meta, meta)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(_apply(self.combined, np.stack([a, b], axis=1)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -40, 40)


_logit = _apply


#: For each view, given both models and the round: rows that it labels, as (text features, metadata features, label).
Surest = Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> Model:
    """Both classifiers after ``rounds`` of exchange, calibrated on every fourth labelled row, which neither trains on."""
    kept = np.arange(len(y)) % 4 == 3 if min((y == 0).sum(), (y == 1).sum()) >= 16 else np.zeros(len(y), bool)
    fit, held = ~kept, kept if kept.any() else ~kept
    views = [text, meta]
    given: list[tuple[np.ndarray, np.ndarray]] = [(x[:0], y[:0]) for x in views]  # what the other view labels for each
    models = [np.zeros(0), np.zeros(0)]
    for step in range(rounds + 1):
        models = [logistic(np.concatenate([x[fit], u]), np.concatenate([y[fit], v]), ridge=1.0) for x, (u, v) in zip(views, given, strict=True)]
        if step < rounds:
            by_text, by_meta = surest(models)
            given = [(by_meta[0], by_meta[2]), (by_text[1], by_text[2])]
    scales = [logistic(_apply(m, x[held])[:, None], y[held]) for m, x in zip(models, views, strict=True)]
    both = np.stack([_apply(s, _apply(m, x[held])[:, None]) for s, m, x in zip(scales, models, views, strict=True)], axis=1)
    return Model(models[0], models[1], scales[0], scales[1], logistic(both, y[held], ridge=0.1))


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)`` of every row, stored: the features of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(batch)], ["doc_id", "x"])

    return stored(_input(docs, id_col, text_col).mapInArrow(run, "doc_id long, x binary"), "quality-features")


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, TEXT_SIZE + META_BUCKETS + 28).astype(np.float64)


def _surest(pool: DataFrame, total: int, base: float) -> Surest:
    """Of all rows of ``pool``: those that either view is surest of, the other view's next training rows."""

    def of(models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unpacked(batch.column(1).to_pylist())
                    p = [_sigmoid(_apply(m, v)) for m, v in zip(models, (x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p)], ["doc_id", "x", "p0", "p1"])

        scored = pool.mapInArrow(run, "doc_id long, x binary, p0 double, p1 double")
        out = []
        for p in ("p0", "p1"):
            found = []
            for label, share, sure, order in ((1.0, base, F.col(p) >= SURE, F.desc(p)), (0.0, 1 - base, F.col(p) <= 1 - SURE, F.asc(p))):
                top = scored.filter(sure).orderBy(order, "doc_id", "x").limit(min(FITTED, max(1, int(SHARE * share * total)))).select("x").collect()
                found.append((_unpacked([bytes(r["x"]) for r in top]), np.full(len(top), label)))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            out.append((x[:, :TEXT_SIZE], x[:, TEXT_SIZE:], y))
        return out

    return of


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", allowed: str | None = None) -> Model | None:
    """A model from at most ``LABELLED`` labelled documents, taken by the smallest hashes of ids, and of all others those that a view is surest of.

    Labels other than 0 and 1 are ignored; ``allowed`` (SQL on doc_id) says which rows may teach, labelled or
    not.  Of rows that repeat a labelled id one teaches.  None if a label is missing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    may = features.filter(F.col("doc_id").isNotNull() & F.expr(allowed or "true"))
    ranked = known.groupBy("doc_id").agg(F.min("y").alias("y")).filter(allowed or "true").withColumn("rank", F.xxhash64("doc_id"))
    labelled = [ranked.filter(f"y = {k}").orderBy("rank", "doc_id").limit(LABELLED // 2) for k in (1, 0)]
    # At most LABELLED rows of 12 bytes.
    picked = F.broadcast(labelled[0].unionByName(labelled[1]).drop("rank"))
    rows = may.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["y"] for r in rows], float)
    if not ((y == 0).any() and (y == 1).any()):
        return None
    x = _unpacked([bytes(r["x"]) for r in rows])
    pool = may.join(picked.select("doc_id"), "doc_id", "left_anti")
    return co_train(x[:, :TEXT_SIZE], x[:, TEXT_SIZE:], y, _surest(pool, pool.count(), float(y.mean())))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_features(t) for t in batch.column(1).to_pylist()])
    meta = np.stack([meta_features(*m) for m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)])
    return text, meta


def _packed(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([r.tobytes() for r in np.concatenate(_matrices(batch), axis=1).astype("<f4")], pa.binary())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: str | None = None) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` of every row of ``docs``; a score is the probability of quality 1.

    Nulls in any column are values of their own; a null, empty or wordless text has no content and is
    judged by that.  Repeated rows and null ids each come back.  Without labels of both kinds every score
    is 0.5.  An empty table gives an empty result.
    """
    features = measured(docs, id_col, text_col)
    model = train(features, labels, id_col, label_col, allowed)
    if model is None:
        return features.select("doc_id", *[F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")], F.lit(0.5 >= threshold).alias("keep"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, held.value.views(x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]))], ["doc_id", "text_score", "meta_score", "score"])

    return features.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double").withColumn("keep", F.col("score") >= threshold)
