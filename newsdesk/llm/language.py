"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased letters with one space for whatever stands between.  Spark counts the runs of five
characters of the training texts by language; lower orders count in how many ways a run is preceded.  A
model keeps, for each order, a sorted array of 64-bit hashes of runs with a column of log probabilities a
language, and the same for contexts with what they leave to the next lower order.  A text's cross-entropy in
a language is the mean over its characters; the lowest wins.

Rejection is calibrated on training documents that a model without them scored: once as they are, and once
with their own language left out, where any answer is wrong.  From the entropy, its lead over the next
language and the length a logistic regression tells how likely the answer is right.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import bounded, utf8
from newsdesk.session import stored

ORDER = 5
#: Bound of what is learned: characters a language, and hashes times languages that follow from all of them.
CHARACTERS = 2_000_000
TOTAL_CELLS = 200_000_000
#: Parts of the training documents; one of them is scored by a model of the others, to calibrate.
FOLDS = 4
#: Ridge of the calibration, and the probability below which an answer is rejected.
RIDGE, ACCEPTED = 1e-4, 0.5
UNDETERMINED = "und"
#: Characters that are scored at a time, and bytes of text in a batch.
BLOCK = 1 << 18
BATCH_BYTES = 1 << 20
#: Odd multipliers of the hash, one a place from the last character back; fixed so that all workers agree.
_FACTORS = np.random.default_rng(0x5EED).integers(1, 1 << 63, ORDER + 1, np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _table() -> np.ndarray:
    """Code point -> its lower-case letter, 32 where there is none."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else ord(low[0]) if low[0].isalpha() else code
    return out


def letters(text: bytes | None) -> np.ndarray:
    """Lower-case code points of a text in UTF-8, framed by spaces and with one space between words; empty where no letter is."""
    if not text:
        return np.zeros(0, np.uint32)
    points = _table()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    if space.all():
        return np.zeros(0, np.uint32)
    keep = ~space
    keep[1:] |= ~space[:-1]
    # One place more on either side: the space before, and one after if there is none yet.
    return np.pad(points[keep], (1, int(not space[-1])), constant_values=32)




def framed(texts: list[np.ndarray]) -> np.ndarray:
    """Texts one after another, ORDER - 1 zeros before each, as what no character is."""
    none = np.zeros(ORDER - 1, np.uint32)
    return np.concatenate([x for t in texts for x in (none, t)]).astype(np.uint64)


def places(points: np.ndarray) -> list[np.ndarray]:
    """Of each character that ORDER - 1 others precede: itself, and the ones 1 to ORDER - 1 before it."""
    return [points[ORDER - 1 - k : len(points) - k] for k in range(ORDER)]


def hashed(grams: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the runs of 1 to ORDER characters that end here, and of what stands before the last one in them."""
    terms = [g * f for g, f in zip(grams, _FACTORS, strict=False)]
    runs = [terms[0]]
    for t in terms[1:]:
        runs.append(runs[-1] + t)
    return runs, [r - terms[0] for r in runs]


def by_language(language: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell runs of one language from those of another."""
    return hashes + (language + 1).astype(np.uint64) * _FACTORS[ORDER]


@dataclass
class Table:
    """Sorted hashes, and a row for each: a number a language."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and whether the hash is there."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


@dataclass
class Model:
    """``runs[n - 1]`` log probabilities of runs of n characters, ``contexts[n - 1]`` log weights left by their contexts; ``floor`` of an unknown character."""

    languages: list[str]
    runs: list[Table]
    contexts: list[Table]
    floor: np.ndarray
    #: Calibration: weights of ``features``, and the median entropy of right answers.
    weights: np.ndarray | None = None
    usual: float = 0.0

    def chance(self, entropies: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability that the lowest entropy is the right language's."""
        return 1 / (1 + np.exp(-np.clip(features(entropies, lengths, self.usual) @ self.weights, -30, 30)))

    def log_probabilities(self, points: np.ndarray) -> np.ndarray:
        """(characters that ORDER - 1 others precede, languages)."""
        grams = places(points)
        run = grams[0] * _FACTORS[0]
        for g, f in zip(grams[1:], _FACTORS[1:], strict=False):
            run += g * f
        at, there = self.runs[-1].find(run)
        out = self.runs[-1].rows[at]
        left = np.flatnonzero(~there)
        if len(left):
            runs, contexts = hashed([g[left] for g in grams])
            rest = np.zeros((len(left), len(self.languages)), np.float32)
            open_ = np.arange(len(left))
            for n in range(ORDER - 1, -1, -1):
                at, there = self.contexts[n].find(contexts[n][open_])
                rest[open_[there]] += self.contexts[n].rows[at[there]]
                if n == 0:
                    rest[open_] += self.floor
                    break
                at, there = self.runs[n - 1].find(runs[n - 1][open_])
                rest[open_[there]] += self.runs[n - 1].rows[at[there]]
                open_ = open_[~there]
            out[left] = rest
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): nats a character; texts hold a letter.  Long ones are taken in blocks, each with the context before it."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.array([len(t) - 1 for t in texts], np.float64)
        context = ORDER - 1
        pieces: list[np.ndarray] = []
        spans: list[tuple[int, int, int]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if pieces:
                found = self.log_probabilities(np.concatenate(pieces))
                for text, start, stop in spans:
                    sums[text] -= found[start:stop].sum(axis=0, dtype=np.float64)
                pieces.clear()
                spans.clear()
                size = 0

        for k, t in enumerate(texts):
            points = framed([t])
            # The opening space says nothing.
            for start in range(context + 1, len(points), BLOCK):
                pieces.append(points[start - context : start + BLOCK])
                spans.append((k, size, size + len(pieces[-1]) - context))
                size += len(pieces[-1])
                if size >= BLOCK:
                    settle()
        settle()
        return sums / counts[:, None]


#: Where ``features`` has the entropy.
ENTROPY = 3


def features(entropies: np.ndarray, lengths: np.ndarray, usual: float = 0.0) -> np.ndarray:
    """Of each text: the lead over the next language, the same by the root of the length, the entropy beyond what is usual, and what short texts are excused by.

    Less entropy than usual is no better sign: stock phrases have it in any language.
    """
    low = np.sort(entropies, axis=1)
    lead = np.minimum(low[:, 1] - low[:, 0], 3.0) if low.shape[1] > 1 else np.zeros(len(low))
    n = np.maximum(lengths, 1.0)
    return np.column_stack([np.ones(len(low)), lead, np.minimum(lead * np.sqrt(n), 30.0) / 10, np.maximum(low[:, 0], usual), 1 / np.sqrt(n)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton's steps; both outcomes weigh the same."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y <= 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * w
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def discount(counts: np.ndarray) -> float:
    """The absolute discount of counts, from how many are one and two."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def smoothed(languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counted runs: ``grams`` (runs, ORDER) last character first, ``language`` and ``counts`` of each."""
    size = len(languages)
    letters_known = len(np.unique(grams[:, 0])) + 1
    runs, contexts = [Table(np.zeros(0, np.uint64), np.zeros((0, size)))] * ORDER, [Table(np.zeros(0, np.uint64), np.zeros((0, size)))] * ORDER
    # A run's language, hash, context, the run one shorter, and its count; of the highest order first.
    h, c = hashed([g.astype(np.uint64) for g in grams.T])
    level = [(language, h[-1], c[-1], h[-2], counts)]
    for n in range(ORDER - 1, 0, -1):
        # In how many ways a run is preceded: of the runs one longer, each counts once.
        _, first = np.unique(by_language(language, h[n]), return_index=True)
        _, at, ways = np.unique(by_language(language, h[n - 1])[first], return_index=True, return_counts=True)
        rows = first[at]
        level.append((language[rows], h[n - 1][rows], c[n - 1][rows], h[max(n - 2, 0)][rows], ways))
    floor = None
    for n in range(1, ORDER + 1):
        lang, run, context, lower, cnt = level[ORDER - n]
        keys, run_at = np.unique(run, return_inverse=True)
        around, context_at = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(around), size)), np.zeros((len(around), size))
        np.add.at(total, (context_at, lang), cnt)
        np.add.at(kinds, (context_at, lang), 1)
        cut = np.array([discount(cnt[lang == k]) for k in range(size)])
        seen = total > 0
        weight = np.where(seen, cut * kinds / np.maximum(total, 1), 1.0)
        own = np.zeros((len(keys), size))
        own[run_at, lang] = np.maximum(cnt - cut[lang], 0) / total[context_at, lang]
        one = np.zeros(len(keys), np.int64)
        one[run_at] = np.arange(len(run_at))
        if n == 1:
            before = np.full((len(keys), size), 1 / letters_known)
        else:
            at, there = runs[n - 2].find(lower[one])
            assert there.all()
            before = np.exp(runs[n - 2].rows[at])
        runs[n - 1] = Table(keys, np.log(own + weight[context_at[one]] * before))
        contexts[n - 1] = Table(around, np.log(weight))
        if n == 1:
            floor = np.full(size, -np.log(letters_known))
    small = lambda t: Table(t.keys, t.rows.astype(np.float32))
    return Model(languages, [small(t) for t in runs], [small(t) for t in contexts], floor.astype(np.float32))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, characters: int, cells: int, allowed: str | None) -> tuple[list[str], DataFrame]:
    """The languages and ``(lang, fold, text)`` of about ``characters`` of each, by the hash of whole rows; copies of a text share a fold."""
    rows = docs.filter(F.expr(allowed)) if allowed else docs
    rows = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.sum(F.octet_length(text_col)).alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], docs.limit(0).select(F.lit("").alias("lang"), F.lit(0).alias("fold"), utf8(text_col).alias("text"))
    each = min(characters, cells // len(languages) ** 2)
    # A language's share of rows to take, in millionths; all of them where they are few.
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1_000_000, -(-each * 1_000_000 // max(1, r["n"]))))])
    lang = F.col(lang_col).cast("string")
    picked = rows.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) < share[lang])
    return languages, picked.select(lang.alias("lang"), F.pmod(F.hash(text_col), F.lit(FOLDS)).cast("int").alias("fold"), utf8(text_col).alias("text"))


def counted(sample: DataFrame, languages: list[str]) -> DataFrame:
    """``(lang int, calibration boolean, c0 .. c4, n)``: runs of ORDER characters, the last one first, by language and whether they are the calibration's."""
    number = {x: k for k, x in enumerate(languages)}
    names = [f"c{k}" for k in range(ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2, BATCH_BYTES):
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True))
            found: dict[tuple[str, bool], list[np.ndarray]] = {}
            for (lang, fold), text in zip(keys, batch.column("text").to_pylist(), strict=True):
                found.setdefault((lang, fold == 0), []).append(letters(text))
            for (lang, aside), texts in found.items():
                texts = [t for t in texts if len(t)]
                if not texts:
                    continue
                grams = np.stack(places(framed(texts)), axis=1)
                # Neither what stands between texts nor their opening spaces are counted.
                grams = grams[(grams[:, 0] > 0) & (grams[:, 1] > 0)]
                _, first, n = np.unique(hashed(list(grams.T))[0][-1], return_index=True, return_counts=True)
                rows = grams[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), number[lang], np.int32)), pa.array(np.full(len(n), aside)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T], pa.array(n.astype(np.int64))],
                    ["lang", "calibration", *names, "n"],
                )

    out = sample.mapInArrow(run, "lang int, calibration boolean, " + ", ".join(f"{c} int" for c in names) + ", n long")
    return out.groupBy("lang", "calibration", *names).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed: str | None = None, characters: int = CHARACTERS, cells: int = TOTAL_CELLS) -> Model | None:
    """The model of the rows that ``allowed`` lets teach; None if none does.

    What the driver gets is bounded: distinct runs of at most ``characters`` a language, fewer where there are
    many languages, and five numbers of each calibration text.
    """
    spark = docs.sparkSession
    languages, sample = _sample(docs, id_col, text_col, lang_col, characters, cells, allowed)
    if not languages:
        return None
    sample = stored(sample, "language-sample")
    found = counted(sample, languages).toArrow()
    column = lambda c: found.column(c).to_numpy()
    if not found.num_rows:
        return None
    # toArrow comes in no order that can be relied on.
    grams = np.stack([column(f"c{k}") for k in range(ORDER)], axis=1)
    order = np.lexsort([*grams.T, column("calibration"), column("lang")])
    grams, lang, n, aside = grams[order], column("lang")[order].astype(np.int64), column("n")[order], column("calibration")[order].astype(bool)
    taught = np.unique(lang).tolist()
    languages = [languages[k] for k in taught]
    lang = np.searchsorted(taught, lang)

    def model(of: np.ndarray) -> Model:
        key = by_language(lang[of], hashed([g.astype(np.uint64) for g in grams[of].T])[0][-1])
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return smoothed(languages, lang[of][first], grams[of][first], np.bincount(at, n[of]).astype(np.int64))

    whole = model(np.ones(len(lang), bool))
    parted = model(~aside) if (~aside).any() else whole
    shared = spark.sparkContext.broadcast(parted)
    number = {x: k for k, x in enumerate(languages)}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, BATCH_BYTES):
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            some = [k for k, t in enumerate(texts) if len(t)]
            if not some:
                continue
            true = np.array([number[x] for x in batch.column("lang").take(pa.array(some)).to_pylist()])
            entropy, length = shared.value.entropies([texts[k] for k in some]), np.array([len(texts[k]) for k in some], np.float64)
            x, right = [features(entropy, length)], [entropy.argmin(axis=1) == true]
            if entropy.shape[1] > 1:
                others = entropy.copy()
                others[np.arange(len(true)), true] = np.inf
                others = np.sort(others, axis=1)[:, :-1]
                x.append(features(others, length))
                right.append(np.zeros(len(true), bool))
            x, right = np.concatenate(x), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in x.T], pa.array(right.astype(np.float64))], [f"x{k}" for k in range(x.shape[1])] + ["right"])

    width = features(np.zeros((1, 1)), np.ones(1)).shape[1]
    seen = sample.filter("fold = 0").select("lang", "text").mapInArrow(judged, ", ".join(f"x{k} double" for k in range(width)) + ", right double").toArrow()
    data = np.column_stack([c.to_numpy() for c in seen.columns]) if seen.num_rows else np.zeros((0, width + 1))
    data = data[np.lexsort(data.T)]
    right = data[data[:, width] > 0, ENTROPY]
    whole.usual = float(np.median(right)) if len(right) else 0.0
    data[:, ENTROPY] = np.maximum(data[:, ENTROPY], whole.usual)
    whole.weights = logistic(data[:, :width], data[:, width]) if len(data) else np.zeros(width)
    shared.unpersist()
    return whole


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` string, ``score`` double, ``accepted`` boolean and ``entropy`` double (nats a character, null for ``und``); columns of those names are replaced."""
    added = {"lang_pred": "string", "score": "double", "accepted": "boolean", "entropy": "double"}
    keep = [c for c in docs.columns if c not in added and (with_text or c != text_col)]
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(text_col, *[c for c in keep if c != text_col])
    schema = rows.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches, 0, BATCH_BYTES):
            texts = [letters(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            some = [k for k, t in enumerate(texts) if len(t)]
            names, score, entropy = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if some:
                found, length = model.entropies([texts[k] for k in some]), np.array([len(texts[k]) for k in some], np.float64)
                score[some] = model.chance(found, length)
                for k, best, e in zip(some, found.argmin(axis=1).tolist(), found.min(axis=1).tolist(), strict=True):
                    names[k], entropy[k] = model.languages[best], e
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(score), pa.array(score >= ACCEPTED), pa.array(entropy, pa.float64())], [*keep, *added]
            )

    return rows.mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether a row is kept from teaching: by the CRC of its id as text; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, characters: int = CHARACTERS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted, entropy)`` of every row.

    Rows whose CRC falls into ``part`` of ``parts``, and those without an id, teach nothing.  A null text, one without any letter, and every
    text where nothing taught, is ``und`` with score 0.  Of equally likely languages the first by name wins.  Repeated
    rows get a row each, and very long texts are scored whole, in blocks.  Where one language is all that
    was taught, only the entropy can reject.  An empty table gives an empty result; further columns are ignored.
    """
    model = train(docs, id_col, text_col, lang_col, f"crc32(cast(cast({id_col} as string) as binary)) % {parts} <> {part}", characters)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).alias("text"))
    return identified(rows, model, with_text=False).select("doc_id", "held_out", "lang_pred", "score", "accepted", "entropy")
