"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: each row is a segment of consecutive documents and holds, for
every term of theirs, its postings (positions within the segment, one number apart per word, a gap
between documents).  A phrase is looked up per segment: the postings of its rarest term, less that
term's offset, are the candidates, and each further term, by rising frequency, keeps those found in
its own offset-adjusted list.  Nothing is shuffled; the index is written once and can be searched again.

Phrases reach the segments by broadcast, in blocks of a bounded number of words that are searched one
after the other: whatever the size of a benchmark, one block at a time is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import Interner, alnum_words, regrouped, release, utf8
from newsdesk.session import stored

#: Text bytes of a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 6 << 20
#: Words of phrases that are broadcast at once, on average; a larger benchmark is searched in blocks.
BLOCK_WORDS = 500_000
#: Windows of an item that stay together; a longer item comes in pieces that overlap by a window less one word.
PIECE_WINDOWS = 4096
CANDIDATES = 1 << 20
ROWS = 1 << 16
SCHEMA = "segment long, doc_ids binary, null_ids binary, text_hashes binary, starts binary, lengths binary, terms binary, counts binary, postings binary"


def build_segment(ids: list[int | None], texts: list[bytes | None], hashes: list[int]) -> dict[str, bytes]:
    """One segment: documents, terms in order of first sight and their ascending postings."""
    terms = Interner()
    numbers, lengths = [], []
    for text in texts:
        words = alnum_words(text)
        lengths.append(len(words))
        numbers.append(terms.numbers(words))
    lengths = np.array(lengths, np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    place = np.arange(len(number)) + np.repeat(np.arange(len(lengths)), lengths)
    keys = np.sort(number << 32 | place)
    counts = np.bincount(number, minlength=len(terms))
    null = np.array([i is None for i in ids])
    return {
        "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
        "null_ids": np.packbits(null).tobytes(),
        "text_hashes": np.array(hashes, "<i8").tobytes(),
        "starts": starts.astype("<i8").tobytes(),
        "lengths": lengths.astype("<i8").tobytes(),
        "terms": b" ".join(terms),
        "counts": counts.astype("<u4").tobytes(),
        "postings": (keys & 0xFFFFFFFF).astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The positional inverted index of all ``docs``, stored as a table of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(regrouped(batches, 1, segment_bytes)):
            yield pa.RecordBatch.from_pylist([{"segment": first + k} | build_segment(*(table.column(k).to_pylist() for k in range(3)))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return stored(rows.mapInArrow(run, SCHEMA), "positional-index")


@dataclass
class Phrases:
    """Distinct word sequences and the items that each belongs to, as arrays."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (phrases x length term numbers, phrase numbers)
    start: np.ndarray  # phrase number -> where its items start
    items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], window: int) -> Phrases:
        """``rows`` are (item, words joined by spaces); every ``window`` consecutive words are a phrase, or all of fewer."""
        vocabulary = Interner()
        found: dict[int, tuple[list, list]] = {}
        for item, words in rows:
            number = vocabulary.numbers(words.split()).astype(np.int32)
            runs = np.lib.stride_tricks.sliding_window_view(number, min(window, len(number)))
            terms, owners = found.setdefault(runs.shape[1], ([], []))
            terms.append(runs)
            owners.append(np.full(len(runs), item, np.int64))
        by_length, phrase, owner, n = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for length, (terms, owners) in found.items():
            all_terms = np.concatenate(terms)
            terms.clear()
            _, first, number = np.unique(all_terms.view(np.dtype((np.void, 4 * length))).ravel(), return_index=True, return_inverse=True)
            by_length[length] = (all_terms[first], np.arange(n, n + len(first)))
            phrase.append(number + n)
            owner.append(np.concatenate(owners))
            n += len(first)
        phrase, owner = np.concatenate(phrase), np.concatenate(owner)
        order = np.lexsort((owner, phrase))
        phrase, owner = phrase[order], owner[order]
        new = np.ones(len(phrase), bool)
        new[1:] = (phrase[1:] != phrase[:-1]) | (owner[1:] != owner[:-1])
        return cls(dict(vocabulary), by_length, np.searchsorted(phrase[new], np.arange(n + 1)), owner[new])

    def items_of(self, numbers: np.ndarray) -> np.ndarray:
        """The distinct items of some phrases, ascending."""
        return np.unique(np.concatenate([self.items[self.start[p] : self.start[p + 1]] for p in numbers.tolist()]))


class Segment:
    """A segment opened for lookups of one set of phrases."""

    def __init__(self, row: dict[str, bytes], vocabulary: dict[bytes, int]) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(self.doc_ids)).astype(bool)
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        self.count = np.zeros(len(vocabulary), np.int64)
        chosen, wanted = [], []
        for here, term in enumerate(row["terms"].split(b" ") if row["terms"] else ()):
            there = vocabulary.get(term)
            if there is not None:
                self.count[there] = counts[here]
                chosen.append(here)
                wanted.append(there)
        postings = np.frombuffer(row["postings"], "<u4")
        order = np.argsort(np.array(wanted, np.int64))
        lists = [postings[ends[h] - counts[h] : ends[h]].astype(np.int64) | (wanted[k] << 32) for k in order.tolist() for h in (chosen[k],)]
        #: (term, position) of all wanted postings, ascending.
        self.keys = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count

    def size(self) -> int:
        return int(self.lengths.sum() + len(self.lengths))

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For rows of terms that all occur here: (row, position of its rarest term, its terms' order by frequency), in bounded parts."""
        for k in range(0, len(terms), ROWS):
            for row, at, order in self._candidates(terms[k : k + ROWS]):
                yield row + k, at, order

    def _candidates(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        frequency = self.count[terms]
        alive = np.flatnonzero(frequency.min(axis=1) > 0)
        order = np.argsort(frequency[alive], axis=1, kind="stable")
        rarest = np.take_along_axis(terms[alive], order[:, :1], 1)[:, 0]
        n = self.count[rarest]
        ends = np.cumsum(n)
        start = 0
        while start < len(alive):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CANDIDATES, "right")))
            part = np.repeat(np.arange(start, stop), n[start:stop])
            within = np.arange(len(part)) - np.repeat(ends[start:stop] - n[start:stop] - base, n[start:stop])
            for k in range(0, len(part), CANDIDATES):
                p, w = part[k : k + CANDIDATES], within[k : k + CANDIDATES]
                yield alive[p], self.keys[self.first[rarest[p]] + w] & 0xFFFFFFFF, order[p]
            start = stop

    def exact(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``terms``, first position) of every place where a row's terms stand consecutively."""
        for row, at, order in self.candidates(terms):
            begin = at - order[:, 0]
            for k in range(1, terms.shape[1]):
                if not len(row):
                    break
                offset = order[:, k]
                key = terms[row, offset].astype(np.int64) << 32 | (begin + offset)
                key[begin < 0] = -1
                found = np.searchsorted(self.keys, key)
                good = (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == key)
                row, begin, order = row[good], begin[good], order[good]
            if terms.shape[1] == 1:
                row, begin = row[begin >= 0], begin[begin >= 0]
            if len(row):
                yield row, begin

    def close(self, terms: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position of its rarest term) where every other term of the row stands within ``distance`` words in the same document."""
        for row, at, order in self.candidates(terms):
            doc = np.searchsorted(self.starts, at, "right") - 1
            low = np.maximum(at - distance, self.starts[doc])
            high = np.minimum(at + distance, self.starts[doc] + self.lengths[doc] - 1)
            for k in range(1, terms.shape[1]):
                if not len(row):
                    break
                term = terms[row, order[:, k]].astype(np.int64) << 32
                found = np.searchsorted(self.keys, term | low)
                good = (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] <= (term | high))
                row, at, order, low, high = row[good], at[good], order[good], low[good], high[good]
            if len(row):
                yield row, at


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans merged, as rows of (start, stop)."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], stop[last]], axis=1)


def search_segment(row: dict[str, bytes], phrases: Phrases) -> list[tuple[int | None, int, np.ndarray, list[int], int]]:
    """(doc_id, words, merged hit spans, items, text hash) of every document of a segment."""
    segment = Segment(row, phrases.vocabulary)
    begins, ends, owners = [], [], []
    for length, (terms, numbers) in phrases.by_length.items():
        for found, begin in segment.exact(terms):
            begins.append(begin)
            ends.append(begin + length)
            owners.append(numbers[found])
    n = len(segment.doc_ids)
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * n
    items: list[list[int]] = [[]] * n
    if begins:
        begin, end, owner = np.concatenate(begins), np.concatenate(ends), np.concatenate(owners)
        doc = np.searchsorted(segment.starts, begin, "right") - 1
        merged = _spans(begin, end)
        where = np.searchsorted(segment.starts, merged[:, 0], "right") - 1
        for d in np.unique(where).tolist():
            spans[d] = merged[where == d] - segment.starts[d]
        pairs = np.unique(np.stack([doc, owner], axis=1), axis=0)
        cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        for group in np.split(pairs, cut):
            items[int(group[0, 0])] = phrases.items_of(group[:, 1]).tolist()
    hashes = np.frombuffer(row["text_hashes"], "<i8").tolist()
    return [(None if null else i, w, s, t, h) for i, null, w, s, t, h in zip(segment.doc_ids.tolist(), segment.null.tolist(), segment.lengths.tolist(), spans, items, hashes, strict=True)]


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                own = [words[k : k + PIECE_WINDOWS + window - 1] for k in range(0, max(1, len(words) - window + 1), PIECE_WINDOWS)] if words else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(own), pa.int64()), pa.array(range(len(own)), pa.int64()), pa.array([b" ".join(w) for w in own], pa.binary()), pa.array([len(w) for w in own], pa.int64())], ["item_id", "nth", "words", "n"]
                )

    return run


def phrase_blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list[DataFrame]:
    """``(item_id, words)`` of the items in blocks of about ``block_words`` words; long items in overlapping pieces, equal pieces of an item once."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), utf8(text_col).alias("text")).filter("item_id is not null and text is not null")
    pieces = stored(rows.mapInArrow(_pieces(window), "item_id long, nth long, words binary, n long").dropDuplicates(["item_id", "words"]), "phrases")
    blocks = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words) or 1
    parts = [pieces] if blocks == 1 else [pieces.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b) for b in range(blocks)]
    return [p.select("item_id", "words") for p in parts]


def broadcast(block: DataFrame, window: int) -> Broadcast[Phrases]:
    """A block's phrases for all tasks; the block's size bounds them."""
    return block.sparkSession.sparkContext.broadcast(Phrases.of([(r["item_id"], bytes(r["words"])) for r in block.collect()], window))


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>, items array<long>, text_hash long"
KEYED = OUT + ", segment long, slot long"


def _result(rows: list[tuple[int | None, int, np.ndarray, list[int], int]]) -> pa.RecordBatch:
    hits = [int((r[2][:, 1] - r[2][:, 0]).sum()) for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(hits, pa.int64()),
            pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([_digest(r[3]) for r in rows]), pa.array([h > 0 for h in hits]),
            pa.array([r[2].tolist() for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            pa.array([r[4] for r in rows], pa.int64()),
        ],
        [c.split()[0] for c in OUT.split(", ")],
    )


def _keyed(batch: pa.RecordBatch, segment: int, slots: list[int]) -> pa.RecordBatch:
    return batch.append_column("segment", pa.array([segment] * len(slots), pa.int64())).append_column("slot", pa.array(slots, pa.int64()))


def _searched(index: DataFrame, held: Broadcast[Phrases]) -> DataFrame:
    """What the phrases hit in every document of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                result = _result(search_segment(row, held.value))
                yield _keyed(result, row["segment"], list(range(result.num_rows)))

    return index.mapInArrow(run, KEYED)


def _merged(table: pa.Table) -> pa.Table:
    """One document's hits from several blocks as one row."""
    rows = table.to_pylist()
    spans = np.array([s for r in rows for s in r["spans"]], np.int64).reshape(-1, 2)
    one = (rows[0]["doc_id"], rows[0]["n_words"], _spans(spans[:, 0], spans[:, 1]), sorted({i for r in rows for i in r["items"]}), rows[0]["text_hash"])
    return pa.Table.from_batches([_keyed(_result([one]), rows[0]["segment"], [rows[0]["slot"]])])


def contamination(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items, text_hash)`` of every indexed document.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Documents and
    items of null, empty or wordless text have no words and hit nothing; items with a null id are not
    searched.  Items that repeat an id count once; repeated documents each come back.  ``spans`` are the
    maximal hit runs of words.  A benchmark beyond ``block_words`` is searched block by block, each block's
    hits stored before the next one is broadcast, and a document's spans and items are merged at the end.
    """
    blocks = phrase_blocks(benchmark, item_col, text_col, window, block_words)
    if len(blocks) == 1:
        return _searched(index, broadcast(blocks[0], window)).drop("segment", "slot")
    hits = []
    for block in blocks:
        held = broadcast(block, window)
        hits.append(stored(_searched(index, held).filter("n_hit > 0"), "hits"))
        held.destroy()
    hit = reduce(DataFrame.unionByName, hits).groupBy("segment", "slot").applyInArrow(_merged, KEYED)
    clean = _searched(index, broadcast(blocks[0].limit(0), window)).join(hit.select("segment", "slot"), ["segment", "slot"], "left_anti")
    return clean.unionByName(hit).drop("segment", "slot")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, all columns as they were.

    A row goes if a row of its id, null ids included, and its text holds a window; repeated rows go or stay
    together.  Null, empty and wordless texts stay.  An empty table gives an empty result.
    """
    hit = contamination(build_index(docs, id_col, text_col), benchmark, window=window).filter("contaminated").select(F.col("doc_id").alias("__newsdesk_id"), F.col("text_hash").alias("__newsdesk_hash"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__newsdesk_id")) & (F.xxhash64(F.col(text_col)) == F.col("__newsdesk_hash"))
    return docs.join(hit.distinct(), same, "left_anti")


def proximity(index: DataFrame, phrases: DataFrame, distance: int, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, position)`` where all words of an item stand within ``distance`` words of its rarest one, in any order.

    ``position`` is that rarest word's place in its document, from 0; which word is rarest is decided per
    segment, ties by the first.  Items of null, empty or wordless text match nothing, those of a null id are
    not searched; an item that stands twice in ``phrases`` counts once.
    Documents that repeat come back each for itself.
    """
    whole = 1 << 30

    def searched(held: Broadcast[Phrases]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(batch.slice(i, 1).to_pylist()[0], found.vocabulary)
                    for terms, numbers in found.by_length.values():
                        for row, at in segment.close(terms, distance):
                            doc = np.searchsorted(segment.starts, at, "right") - 1
                            n = np.diff(found.start)[numbers[row]]
                            doc, at = np.repeat(doc, n), np.repeat(at, n)
                            item = np.concatenate([found.items[found.start[p] : found.start[p + 1]] for p in numbers[row].tolist()])
                            yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids[doc], mask=segment.null[doc]), pa.array(item), pa.array(at - segment.starts[doc])], ["doc_id", "item_id", "position"])

        return index.mapInArrow(run, "doc_id long, item_id long, position long")

    blocks = phrase_blocks(phrases, item_col, text_col, whole, block_words)
    if len(blocks) == 1:
        return searched(broadcast(blocks[0], whole))
    out = []
    for block in blocks:
        held = broadcast(block, whole)
        out.append(stored(searched(held), "near"))
        held.destroy()
    return reduce(DataFrame.unionByName, out)
