"""Toxicity: a subsequence string-kernel SVM over sentences, with Nyström landmarks.

Words are compared by their gapped subsequences of three characters, weighted by how far they stretch,
so an insult with characters inserted, dropped or swapped for look-alikes stays close to the plain one.
A sentence's kernel with a landmark is the sum, over its words, of the cube of that kernel: one near hit
counts, many faint likenesses don't.  Training is by sentences whose label is their document's.  As most
sentences of a toxic document are harmless, each round of the SVM takes of such a document the sentences
that the round before places on the toxic side, its foremost one at least.  Then documents are calibrated
by their foremost sentences, as scored by models that other documents trained.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.llm.common import Interner, bounded, release, spare, utf8
from newsdesk.llm.common import held as kept
from newsdesk.session import stored

#: Bound of the labelled sample for training, of each label.
SAMPLE_DOCS = 1500
#: Size of the model: landmarks that tell toxic documents apart, ordinary ones most like them, and frequent ones.
TELLING, LIKE, FREQUENT = 96, 48, 48
DECAY, SPAN, BASE, POWER = 0.5, 5, 32, 3
LONGEST = 48
#: Length of the word beginnings whose counts stand in for inflected words too rare to count alone.
STEM = 5
#: Words of a sentence; one without an end is cut there.
SENTENCE_WORDS = 40
#: Rounds of the SVM, its ridge, and what all harmless sentences weigh against all toxic ones.
ROUNDS, RIDGE, HARMLESS = 6, 1e-3, 10.0
#: Parts of the labelled sample; a document is calibrated by a model of the other parts.
FOLDS = 3
#: What calibration sees of a document: its foremost sentences' scores, within these bounds.
FOREMOST, LOW, HIGH = 3, -3.0, 8.0
BATCH_BYTES = 2 << 20
#: Characters that stand in for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
#: What ends a sentence, at the end of a word.
ENDS = (b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode(), "…".encode())
_LINE = b"\x00"
_STEPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_LETTERS = re.compile(r"[a-z~]+")


def chunks(text: bytes | None) -> list[bytes]:
    """What stands between white space, with a mark of its own for each line end."""
    return text.replace(b"\n", b" \x00 ").split() if text else []


class _Fold(dict):
    """Characters beyond ASCII: accents go, other letters become one sign, the rest spaces."""

    def __missing__(self, code: int) -> str | int | None:
        c = chr(code)
        self[code] = out = code if c.isascii() else None if unicodedata.combining(c) else "~" if c.isalpha() else " "
        return out


_FOLD = _Fold()
#: Signs around a word.
_SIGNS = "!|+.,;:?\"'()[]{}<>*#%&-_=/\\~`^$@"


def folded(chunk: bytes) -> list[str]:
    """The words a chunk between spaces may stand for: its letter runs, all its letters, and its look-alikes read as letters."""
    plain = chunk.strip(_SIGNS.encode())
    if plain.isalpha() and len(plain) <= LONGEST and b"~" not in chunk:
        # Letters of ASCII alone, which is what bytes call letters: one reading.
        return [plain.lower().decode()]
    text = chunk.decode("utf-8", "replace")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
    text = text.lower()
    runs = _LETTERS.findall(text)
    words = list(runs)
    if len(runs) > 1:
        words.append("".join(runs))
    inner = text.strip(_SIGNS)
    seen = "".join(_LETTERS.findall(inner.translate(LOOK_ALIKE)))
    if seen and seen not in words and any(c.isalpha() for c in inner):
        words.append(seen)
    return [w[i : i + LONGEST] for w in words for i in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)] if any(len(w) > LONGEST for w in words) else words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value) of all words, values combined; words of one length at a time share arrays."""
    rows, codes, values = [], [], []
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer("".join(words[i] for i in at.tolist()).encode("ascii"), np.uint8).reshape(len(at), n)
        c = np.concatenate([np.full((len(at), 1), 28, np.int64), np.where(raw == 0x7E, 27, raw - 0x60).astype(np.int64), np.full((len(at), 1), 29, np.int64)], axis=1)
        parts, weight = [], []
        for a, b in _STEPS:
            if b < n + 2:
                x = (c[:, :-b] * BASE + c[:, a : a + n + 2 - b]) * BASE + c[:, b:]
                parts.append(x)
                weight.append(np.full(x.shape[1], DECAY ** (b - 2)))
        if not parts:
            continue
        x, w = np.concatenate(parts, axis=1), np.concatenate(weight)
        order = np.argsort(x, axis=1, kind="stable")
        x, v = np.take_along_axis(x, order, 1), w[order]
        new = np.concatenate([np.ones((len(at), 1), bool), x[:, 1:] != x[:, :-1]], axis=1).ravel()
        first = np.flatnonzero(new)
        rows.append(np.repeat(at, x.shape[1])[first])
        codes.append(x.ravel()[first])
        values.append(np.add.reduceat(v.ravel(), first))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


class Landmarks:
    """Landmark words opened for comparison with others: the few of them that have a subsequence, by subsequence."""

    def __init__(self, words: list[str]) -> None:
        self.names = words
        row, code, value = features(words)
        norm = np.sqrt(np.bincount(row, value**2, len(words)))
        order = np.argsort(code, kind="stable")
        self.owner, self.value = row[order], (value / norm[row])[order]
        self.count = np.bincount(code, minlength=BASE**3)
        self.first = np.cumsum(self.count) - self.count

    def kernel(self, words: list[str], power: int = POWER) -> np.ndarray:
        """Powers of the normalised kernel of words against the landmarks."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        for start in range(0, len(words), 512):
            part = words[start : start + 512]
            row, code, value = features(part)
            norm = np.sqrt(np.bincount(row, value**2, len(part)))
            n = self.count[code]
            end = np.cumsum(n)
            at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[code] - end + n, n)
            place = np.repeat(row, n) * len(self.names) + self.owner[at]
            dot = np.bincount(place, np.repeat(value / norm[row], n) * self.value[at], len(part) * len(self.names))
            out[start : start + len(part)] = dot.reshape(len(part), -1)
        return out**power

    def chunks(self, found: list[bytes]) -> np.ndarray:
        """The same for chunks between spaces, of whose readings the nearest counts; letterless ones are near nothing."""
        words, sizes = [], []
        for c in found:
            w = folded(c)
            words += w
            sizes.append(len(w))
        sizes = np.array(sizes, np.int64)
        out = np.zeros((len(found), len(self.names)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.maximum.reduceat(self.kernel(words), (np.cumsum(sizes) - sizes)[some], axis=0)
        return out


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Where sentences start in a text of chunks, given which chunks end one; long ones are cut."""
    start = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    size = np.diff(np.append(start, len(ends)))
    pieces = -(-size // SENTENCE_WORDS)
    return np.repeat(start, pieces) + SENTENCE_WORDS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))


def spaced(single: np.ndarray) -> list[tuple[int, str]]:
    """(place, word) of words spelt with spaces: runs of four or more single letters, long ones in overlapping parts of eight."""
    on = np.flatnonzero(np.diff(np.concatenate([[0], (single > 0).view(np.int8), [0]])))
    runs = [(s, e) for s, e in on.reshape(-1, 2).tolist() if e - s >= 4]
    return [(a, single[a : min(e, a + 8)].tobytes().decode().lower()) for s, e in runs for a in range(s, max(s + 1, e - 4), 4)]


class Chunks:
    """Numbers of chunks, kept up to a bound, with what is known of each: a value, whether it ends a sentence, its letter if it is one."""

    KEEP = 120_000

    def __init__(self, value, width: int) -> None:
        self.value, self.width = value, width
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = Interner(), 0
        self.values, self.ends, self.single = np.zeros((1 << 14, self.width), np.float32), np.zeros(1 << 14, bool), np.zeros(1 << 14, np.uint8)

    def _learn(self) -> None:
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - self.known))[::-1]
        while len(self.ends) < len(self.numbers):
            self.values, self.ends, self.single = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.ends, self.single))
        for k in range(0, len(fresh), 4096):
            part, at = fresh[k : k + 4096], slice(self.known + k, self.known + min(k + 4096, len(fresh)))
            self.values[at] = self.value(part)
            self.ends[at] = [c == _LINE or c.endswith(ENDS) for c in part]
            self.single[at] = [c[0] if len(c) == 1 and c.isalpha() else 0 for c in part]
        self.known = len(self.numbers)

    def sentences(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Each text's (sentences x width) sums of values."""
        if len(self.numbers) > self.KEEP:
            self._forget()
        numbers = [self.numbers.numbers(chunks(t)) for t in texts]
        if len(self.numbers) > self.known:
            self._learn()
        for n in numbers:
            if not len(n):
                yield np.zeros((0, self.width), np.float32)
                continue
            start = sentence_starts(self.ends[n])
            sentence = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
            # Each distinct word of a sentence counts once.
            key = np.unique(sentence << 32 | n)
            out = np.add.reduceat(self.values[key & 0xFFFFFFFF], np.searchsorted(key >> 32, np.arange(len(start))), axis=0)
            if found := spaced(self.single[n]):
                np.add.at(out, np.searchsorted(start, [a for a, _ in found], "right") - 1, self.value([w.encode() for _, w in found]))
            yield out


@dataclass
class Model:
    """Landmarks with a weight each, a bias, and the calibration of documents."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    calibration: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:-1] + self.calibration[-1], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """Scores of sentences under a model, and what calibration sees of documents."""

    #: Words that stay known: those met since, and those met in as long a time before.
    KEEP = 120_000

    def __init__(self, model: Model) -> None:
        self.model, self.landmarks, self.weights = model, Landmarks(model.landmarks), model.weights.astype(np.float32)
        self.words: dict[str, float] = {}
        self.earlier: dict[str, float] = {}
        self.chunks = Chunks(self._values, 1)

    def _values(self, found: list[bytes]) -> np.ndarray:
        """Chunks' shares in a sentence's score.  Many chunks are one word in other cases and signs, which is compared once."""
        readings = [folded(c) for c in found]
        if len(self.words) > self.KEEP:
            self.words, self.earlier = {}, self.words
        fresh = []
        for w in {r[0] for r in readings if len(r) == 1} - self.words.keys():
            if (known := self.earlier.get(w)) is None:
                fresh.append(w)
            else:
                self.words[w] = known
        if fresh:
            self.words.update(zip(fresh, (self.landmarks.kernel(fresh) @ self.weights).tolist(), strict=True))
        out = np.array([[self.words[r[0]] if len(r) == 1 else 0.0] for r in readings], np.float32)
        several = [k for k, r in enumerate(readings) if len(r) > 1]
        if several:
            out[several, 0] = self.landmarks.chunks([found[k] for k in several]) @ self.weights
        return out

    def documents(self, texts: list[bytes | None]) -> np.ndarray:
        return np.array([foremost(s[:, 0].astype(float) + self.model.bias) for s in self.chunks.sentences(texts)]).reshape(-1, FOREMOST + 2)


def foremost(scores: np.ndarray) -> np.ndarray:
    """Of a document's sentences: the foremost scores, how many are on the toxic side, and how many there are, the last two as logarithms."""
    out = np.full(FOREMOST + 2, LOW)
    top = np.sort(np.clip(scores, LOW, HIGH))[::-1][:FOREMOST]
    out[: len(top)] = top
    out[FOREMOST:] = np.log1p((scores > 0).sum()), np.log1p(len(scores))
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: str | None) -> DataFrame:
    """A bounded, stored sample of labelled documents: (text, y, part), for each label the ``SAMPLE_DOCS`` smallest hashes of ids; of an id that repeats, the least text."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if allowed:
        rows = rows.filter(allowed)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("rank", F.xxhash64("doc_id"))
    picked = rows.filter("y = 1").orderBy("rank", "doc_id").limit(SAMPLE_DOCS).unionByName(rows.filter("y = 0").orderBy("rank", "doc_id").limit(SAMPLE_DOCS))
    # At most 2 * SAMPLE_DOCS rows of 12 bytes.
    met = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).join(F.broadcast(picked.drop("rank")), "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return stored(one.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int").alias("part")), "toxicity-sample")


def _landmarks(fit: DataFrame) -> list[str]:
    """Words of the sample: those that tell toxic documents apart, the other ones most like them, and frequent ones."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in bounded(batches, 0, BATCH_BYTES):
            found = [sorted({w for c in set(chunks(t)) for w in folded(c)}) for t in batch.column(0).to_pylist()]
            found = [f + sorted({f"{w[:STEM]}*" for w in f if len(w) > STEM}) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["words", "y"])
        spare()

    count = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = count.get(1, 0), count.get(0, 0)
    if not p or not n:
        return []
    seen = (
        fit.select("text", "y").mapInArrow(words, "words array<string>, y int").select("y", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    )
    total, df = float(p + n), F.col("p") + F.col("n")
    gain = F.col("p") * F.log((F.col("p") + 1e-9) * total / (df * p)) + F.col("n") * F.log((F.col("n") + 1e-9) * total / (df * n))
    seen = stored(seen.withColumn("gain", 2 * gain), "toxicity-words")
    telling, is_stem = F.col("p") * n > 8 * F.col("n") * p, F.col("word").endswith("*")
    # A word counts by its own gain or, weaker, by that of its beginning, which it shares with its other forms.
    stems = seen.filter(telling & is_stem & (F.col("gain") > 10)).select(F.col("word").alias("stem"), F.col("gain").alias("stem_gain"))
    words_ = seen.filter(telling & ~is_stem).withColumn("stem", F.when(F.length("word") > STEM, F.concat(F.substring("word", 1, STEM), F.lit("*"))))
    raised = words_.join(stems, "stem", "left").withColumn("gain", F.greatest("gain", F.coalesce("stem_gain", F.lit(0.0)) / 2))
    top = raised.orderBy(F.desc("gain"), "word").limit(TELLING).collect()
    strong = [r["word"] for r in top if r["gain"] > max(5.0, top[0]["gain"] / 20)] or [r["word"] for r in top[:20]]
    if not strong:
        return []
    ordinary = seen.filter(~is_stem & (F.col("n") > 0) & ~F.col("word").isin(strong)).select("word", "n")

    def likened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = Landmarks(strong)
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("like", pa.array(against.kernel(batch.column(0).to_pylist(), 1).max(axis=1).astype(float)))

    like = ordinary.mapInArrow(likened, "word string, n long, like double").orderBy(F.desc("like"), "word").limit(LIKE).collect()
    frequent = ordinary.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return list(dict.fromkeys([*strong, *(r["word"] for r in like), *(r["word"] for r in frequent)]))


def _sums(batches: Iterator[pa.RecordBatch], w: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """A task's part of one round of several models, each of which leaves out the documents of its own number.

    Per model and label: the second moments and sums of the sentences within the margin, and how much all
    of them weigh.  In the first round all sentences of a toxic document count, together as one.  Later those
    on the toxic side do, or else the foremost one.  Every sentence of a clean document counts as harmless.
    """
    models, size = w.shape
    square, right, weight = np.zeros((models, 2, size, size)), np.zeros((models, 2, size)), np.zeros((models, 2))
    for batch in batches:
        for y, part, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(raw, "<f4").reshape(-1, size - 1)
            if not len(x):
                continue
            x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
            scores = x @ w.T.astype(np.float32)
            for m in range(models):
                if m == part:
                    continue
                score, own = scores[:, m], np.ones(len(x), bool)
                if y and not first:
                    own = score > 0
                    own[score.argmax()] = True
                each = 1 / own.sum() if y else 1.0
                weight[m, y] += each * own.sum()
                active = x[own if first else own & (score * (1 if y else -1) < 1)]
                square[m, y] += each * (active.T @ active)
                right[m, y] += each * (1 if y else -1) * active.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in (square, right, weight)], ["square", "right", "weight"])


def svm(sentences: DataFrame, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Linear SVMs with squared hinge loss over stored sentences ``(y, part, x)``, by Newton steps: for each part one
    without it, then one of all; a row of weights and the bias each.

    A step sums over the active sentences in tasks, for all models at once; the driver gets matrices of the
    models' size from each of at most eight tasks.
    """
    rows, w = sentences.select("y", "part", "x").coalesce(8), np.zeros((FOLDS + 1, size))
    ridge = RIDGE * np.eye(size)
    ridge[-1, -1] = 1e-6
    for k in range(rounds):
        now, first = w, k == 0
        parts = rows.mapInArrow(lambda batches, now=now, first=first: _sums(batches, now, first), "square binary, right binary, weight binary").collect()
        square, right, weight = (reduce(np.add, [np.frombuffer(bytes(p[c]), "<f8") for p in parts]) for c in ("square", "right", "weight"))
        scale = np.array([HARMLESS, 1.0]) / np.maximum(weight.reshape(-1, 2), 1e-9)
        w = np.stack([np.linalg.solve(np.tensordot(a, q, 1) + ridge, a @ r) for a, q, r in zip(scale, square.reshape(-1, 2, size, size), right.reshape(-1, 2, size), strict=True)])
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed: str | None = None) -> Model | None:
    """A model from at most ``SAMPLE_DOCS`` labelled documents of each label that ``allowed`` (SQL on doc_id) admits, with all their sentences.

    None if either label has no document or no word; scores are then all 0.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, allowed)
    names = _landmarks(sample)
    if not names:
        return None
    values, vectors = np.linalg.eigh(Landmarks(names).kernel(names).astype(np.float64))
    good = values > 1e-6 * values[-1]
    nystroem = vectors[:, good] / np.sqrt(values[good])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        landmarks, into = Landmarks(names), nystroem.astype(np.float32)
        for batch in bounded(batches, 0, BATCH_BYTES // 4):
            found = Chunks(lambda c: landmarks.chunks(c) @ into, into.shape[1])
            x = [x.astype("<f4").tobytes() for x in found.sentences(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.binary())], ["y", "part", "x"])
            del found, x
            spare()

    size = nystroem.shape[1] + 1
    sentences = stored(sample.mapInArrow(mapped, "y int, part int, x binary"), "toxicity-sentences")
    w = svm(sentences, size)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [foremost(np.frombuffer(raw, "<f4").reshape(-1, size - 1) @ w[k, :-1] + w[k, -1]) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist() for v in x], pa.list_(pa.float64())), batch.column(2)], ["x", "y"])

    rows = sorted((r["x"], r["y"]) for r in sentences.select("part", "x", "y").coalesce(8).mapInArrow(measured, "x array<double>, y int").collect())
    return Model(names, nystroem @ w[-1, :-1], float(w[-1, -1]), logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float)))


def scorer_of(mark: str, model: Model) -> Scorer:
    """One scorer per Python worker and model: what it has met stays known to the worker's later tasks."""
    return kept(("scorer", mark), lambda: Scorer(model))


def scored(docs: DataFrame, model: Model | None, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``score_col``; null and empty texts get the score of a text without words."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(mark, held.value)
        for batch in bounded(batches, at, BATCH_BYTES):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.append_column(score_col, pa.array(scorer.model.probability(scorer.documents(texts))))
        spare()

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row, repeated and null ids too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return scored(rows, model, "score").drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns as they were; every labelled row may teach.

    Each row is judged by its own text, repeated ids and null ids too; an empty table gives an empty result.
    """
    return scored(docs, train(docs, labels, id_col, text_col, label_col), "__newsdesk_score", text_col).filter(F.col("__newsdesk_score") < threshold).drop("__newsdesk_score")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int | None = 1, folds: int = 3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` teach nothing; None holds none out.
    Only words of texts enter a score.  An empty table gives an empty result; without labels of both
    kinds every score is 0.  A null id is never held out.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    model = train(docs, labels, id_col, text_col, label_col, None if held_out is None else f"crc32(cast(doc_id as string)) % {folds} <> {held_out}")
    out = F.lit(False) if held_out is None else F.coalesce(fold == held_out, F.lit(False))
    return scores(docs, model, id_col, text_col).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
