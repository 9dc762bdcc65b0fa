"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours that fill each seed's window.

Two passes.  The first encodes every document once, stores its ids and counts, over all documents, in
how many each term (token id) occurs; that table is bounded by the vocabulary and is broadcast.  The
second walks the stored ids in shards of bounded size.  Each shard builds an inverted index of BM25
weights; the next unused document seeds a window, its strongest terms are looked up, and the best
unused neighbours fill the window in order.  The last one is cut, and its rest seeds the next window,
so every window but a shard's last is full.  That last one is cut into sequences whose lengths are
powers of two, which need no padding.  No document is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import held, regrouped, release, spare
from newsdesk.llm.tokens import WordEncoder
from newsdesk.session import stored

BATCH_BYTES = 4 << 20
#: Bytes of stored ids (4 a token) of a shard; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: How many of a seed's strongest terms are looked up.
QUERY_TERMS = 12
K1, B = 1.2, 0.75

def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: what it has met stays known to the worker's later tasks."""
    return held(("encoder", path), lambda: WordEncoder(path))


TOKENS = "doc_id long, n_tokens int, ids binary, terms array<int>, in_docs array<int>"
_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("terms", pa.list_(pa.int32())), ("in_docs", pa.list_(pa.int32()))])


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row, stored; besides, rows without ``n_tokens`` that count documents by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        in_docs = np.zeros(1 << 16, np.int32)
        for table in regrouped(batches, 1, BATCH_BYTES):
            ids, sizes = encode(table.column(1).combine_chunks())
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, np.uint32(end_id))
            sizes, ends = sizes + 1, ends + np.arange(1, len(ends) + 1)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key = np.sort(ids.astype(np.int64) << 32 | doc)
            term, times = np.unique(key[np.concatenate([[True], key[1:] != key[:-1]])] >> 32, return_counts=True)
            if term[-1] >= len(in_docs):
                in_docs = np.concatenate([in_docs, np.zeros(int(term[-1]) + 1 - len(in_docs), np.int32)])
            in_docs[term] += times.astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            n = table.num_rows
            del key, doc, ids
            spare()
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks(), pa.array(sizes.astype(np.int32)), raw, pa.nulls(n, _TOKENS.field(3).type), pa.nulls(n, _TOKENS.field(4).type)],
                schema=_TOKENS,
            )
        terms = np.flatnonzero(in_docs)
        yield pa.RecordBatch.from_pylist([{"terms": terms.tolist(), "in_docs": in_docs[terms].tolist()}], schema=_TOKENS)

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TOKENS), "tokens")


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


class Shard:
    """BM25 weights of a shard's documents: by term for lookups, by document for the seeds' own terms."""

    def __init__(self, lists: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.n = len(lists)
        lengths = np.array([len(x) for x in lists], np.int64)
        # In place, and parts go as soon as they are used: a shard's tokens are many.
        key = np.concatenate(lists).astype(np.int64)
        key <<= 32
        key |= _runs(lengths)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        del first
        term, self.doc = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        del key
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean_length))
        counts = np.bincount(term, minlength=len(idf))
        self.stop = np.cumsum(counts)
        self.start = self.stop - counts
        del tf, counts
        order = np.argsort(self.doc, kind="stable")
        self.terms, self.strength = term[order], self.weight[order]
        self.doc_stop = np.cumsum(np.bincount(self.doc, minlength=self.n))
        self.used = np.zeros(self.n, bool)

    def neighbours(self, doc: int, query_terms: int = QUERY_TERMS) -> Iterator[int]:
        """Unused documents that share one of the strongest terms of ``doc``, by BM25 score, best first; ties by position."""
        low, high = int(self.doc_stop[doc - 1]) if doc else 0, int(self.doc_stop[doc])
        best = np.argsort(-self.strength[low:high], kind="stable")[:query_terms]
        slices = [slice(self.start[t], self.stop[t]) for t in self.terms[low:high][best].tolist()]
        touched, gain = np.concatenate([self.doc[s] for s in slices]), np.concatenate([self.weight[s] for s in slices])
        # Sums by position in the shard, or, where few of very many documents are touched, by those alone.
        if 16 * len(touched) > self.n:
            touched, score = np.arange(self.n), np.bincount(touched, gain, self.n)
        else:
            touched, of = np.unique(touched, return_inverse=True)
            score = np.bincount(of, gain)
        open_ = ~self.used[touched] & (score > 0)
        touched, score, ahead = touched[open_], score[open_], 16
        # A few fill most windows: the rest is ordered only when it is asked for.
        while len(touched):
            bar = np.partition(score, -ahead)[-ahead] if len(score) > ahead else -np.inf
            now = score >= bar
            yield from touched[now][np.lexsort((touched[now], -score[now]))].tolist()
            touched, score, ahead = touched[~now], score[~now], 4 * ahead


def pack_shard(lists: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int, query_terms: int = QUERY_TERMS) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, seed document) of a shard; sequences count from 0."""
    shard = Shard(lists, idf, mean_length)
    pieces: list[tuple[int, int, int, int, int, int]] = []
    sequence = filled = 0
    seed, later, rest = -1, 0, None  # rest: (document, start) cut at the last window's end

    def place(doc: int, start: int) -> int | None:
        """A document's ids from ``start`` on; what doesn't fit comes back as the start of its rest."""
        nonlocal sequence, filled
        n = min(len(lists[doc]) - start, window - filled)
        pieces.append((doc, start, n, sequence, filled, seed))
        filled += n
        if filled == window:
            sequence, filled = sequence + 1, 0
        return start + n if start + n < len(lists[doc]) else None

    while True:
        if rest is None:
            while later < shard.n and shard.used[later]:
                later += 1
            if later == shard.n:
                break
            rest = (later, 0)
            shard.used[later] = True
        seed, at = rest
        rest = None
        while (at := place(seed, at)) is not None:
            pass
        if not filled:
            continue
        for doc in shard.neighbours(seed, query_terms):
            shard.used[doc] = True
            if (at := place(doc, 0)) is not None:
                rest = (doc, at)
            if not filled:
                break
    if filled & (filled - 1):
        pieces = _halved(pieces, sequence, filled)
    return pieces


def _halved(pieces: list[tuple], last: int, filled: int) -> list[tuple]:
    """The last, partly filled sequence cut into ones whose lengths are powers of two, longest first."""
    done = [p for p in pieces if p[3] != last]
    room, offset, sequence = 1 << (filled.bit_length() - 1), 0, last
    for doc, start, length, _, _, seed in (p for p in pieces if p[3] == last):
        while length:
            n = min(length, room - offset)
            done.append((doc, start, n, sequence, offset, seed))
            start, length, offset, filled = start + n, length - n, offset + n, filled - n
            if offset == room and filled:
                room, offset, sequence = 1 << (filled.bit_length() - 1), 0, sequence + 1
    return done


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = True, shard_bytes: int = SHARD_BYTES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, seed_doc_id, ids)`` of all rows.

    Every id of every row, its ``end_id`` included, lies in exactly one piece; a sequence's pieces follow
    each other from offset 0.  Null and empty texts are the end id alone.  Rows that repeat an id, or
    have a null one, are packed like any other; very long texts fill windows of their own.  A seed's
    ``query_terms`` strongest terms are looked up in its shard, and every unused document with one of them
    may fill the window, equal scores in order of position; once none is left, the next unused document
    seeds the rest of it.  ``ids`` are little-endian uint32, null unless ``with_ids``.  Other columns are
    ignored.  An empty table gives no piece.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, tokenizer_path, id_col, text_col, end_id)
    total = tokens.filter("n_tokens is not null").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    n, mean_length = total["n"], (total["t"] or 0) / max(1, total["n"])
    # At most one row per entry of the vocabulary.
    counted = tokens.filter("n_tokens is null").select(F.explode(F.arrays_zip("terms", "in_docs")).alias("x")).groupBy("x.terms").agg(F.sum("x.in_docs").alias("df")).collect()
    df = np.zeros(max((r["terms"] for r in counted), default=0) + 1)
    for r in counted:
        df[r["terms"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = TaskContext.get().partitionId() << 36
        for table in regrouped(batches, 1, shard_bytes):
            ids = table.column(0).to_pylist()
            lists = [np.frombuffer(x, "<u4") for x in table.column(1).to_pylist()]
            pieces = pack_shard(lists, idf.value, mean_length, window, query_terms)
            raw = [lists[d][s : s + k].tobytes() for d, s, k, *_ in pieces]
            cols = [np.array(c, np.int64) for c in zip(*pieces, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[p[0]] for p in pieces], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([len(lists[p[0]]) for p in pieces], pa.int64()), pa.array(cols[3] + first), pa.array(cols[4]), pa.array([ids[p[5]] for p in pieces], pa.int64()),
                    pa.array(raw, pa.binary()) if with_ids else pa.nulls(len(raw), pa.binary()),
                ],
                [c.split()[0] for c in PIECES.split(", ")],
            )
            first += int(cols[3].max()) + 1
            del lists, pieces, raw, cols
            spare()

    return tokens.filter("n_tokens is not null").select("doc_id", "ids").mapInArrow(run, PIECES)
