"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt to chunks of a few megabytes by a hash, and every window of every document is
hashed.  What Spark counts are plain rows, one per distinct hash and chunk, so a passage shared by any
number of documents costs one row a chunk and all rows grow with the text alone.  It counts twice.  First
anchors: the smallest hash of any 16 words within a window.  Neighbouring windows mostly have one anchor,
which makes them few, and equal windows have equal anchors, so a window whose anchor stands nowhere else
is known to be the only one of its kind.  Then all other windows: for those that occur again the chunks
that don't hold the smallest document learn of it.  There windows that touch merge into maximal
intervals of words, which are removed.

Rows of windows go to partitions by a second, independent hash: 64 bits and the partition's bits tell
windows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from newsdesk.llm.common import Interner, held, parts, space_words, utf8
from newsdesk.session import stored

#: Bytes of text of a chunk, on average; a document is never parted.
CHUNK_BYTES = 4 << 20
#: Bytes of text at most, on average, per partition of documents and of windows; the session may ask for more partitions.
PARTITION_BYTES = 128 << 20
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: What a null id, which comes after all others, is sorted by; a flag tells it from the id of this value.
LAST = (1 << 63) - 1


class Rolling:
    """Polynomial hashes, modulo 2**64, of all windows of a sequence of 64-bit word hashes."""

    def __init__(self, base: int, window: int) -> None:
        self.window, self.base, self.inverse = window, base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                n = max(n, 1 << 16)
                one = np.ones(1, np.uint64)
                self.powers = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, self.base, np.uint64)]))
                self.inverses = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, self.inverse, np.uint64)]))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n < self.window:
            return np.zeros(0, np.uint64)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[:n], dtype=np.uint64)])
            x = (sums[self.window :] - sums[: n - self.window + 1]) * self.inverses[: n - self.window + 1]
            x ^= x >> np.uint64(32)
            return x * np.uint64(0xD6E8FEB86659FD93)


class Windows:
    """Hashes of the windows of documents; keeps the hashes of words it has met, up to a bound."""

    KEEP = 500_000

    def __init__(self, window: int) -> None:
        self.window, self.inner = window, max(1, window // 3)
        self.rollers = [Rolling(b, window) for b in BASES]
        self.within = Rolling(BASES[0], self.inner)
        self.numbers, self.hashes = Interner(), np.zeros(0, np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.KEEP:
            self.numbers, self.hashes = Interner(), np.zeros(0, np.uint64)
        known = len(self.numbers)
        number = self.numbers.numbers(words)
        if len(self.numbers) > known:
            fresh = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
            more = np.fromiter(map(xxh3_64_intdigest, fresh, repeat(11)), np.uint64, len(fresh))
            if len(self.numbers) > len(self.hashes):
                room = np.zeros(max(2 * len(self.hashes), len(self.numbers), 1 << 14), np.uint64)
                room[:known] = self.hashes[:known]
                self.hashes = room
            self.hashes[known : known + len(more)] = more
        return self.hashes[number]

    def anchors(self, words: np.ndarray) -> np.ndarray:
        """Each window's smallest hash of ``inner`` words in it."""
        if len(words) < self.window:
            return np.zeros(0, np.uint64)
        least, have, need = self.within(words), 1, self.window - self.inner + 1
        while have < need:
            step = min(have, need - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        return least

    def texts(self, table: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, hashes of words) of the documents of a chunk."""
        for i, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
            yield i, self.words(space_words(text))


class Owners:
    """Whose the windows of a chunk are: ids, and which are null, one by one."""

    def __init__(self, ids: list[int | None], sizes: list[int]) -> None:
        self.ids = np.repeat(np.array([LAST if i is None else i for i in ids], np.int64), sizes)
        self.null = np.repeat(np.array([i is None for i in ids], bool), sizes)

    def least(self, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of ``order`` the smallest id, and whether all are null."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return np.minimum.reduceat(self.ids[order], begin), np.logical_and.reduceat(self.null[order], begin)


def hasher_of(window: int) -> Windows:
    """One per Python worker: the words it has met stay known from chunk to chunk."""
    return held(("windows", window), lambda: Windows(window))


def _spans(marked: np.ndarray, window: int) -> np.ndarray:
    """Start positions of windows (ascending) as merged word intervals, flat (start, stop, start, stop, ...)."""
    if not len(marked):
        return np.zeros(0, np.int32)
    new = np.concatenate([[True], marked[1:] > marked[:-1] + window])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(marked) - 1]])
    return np.stack([marked[new], marked[last] + window], axis=1).astype(np.int32).ravel()


ROWS = "chunk int, n int, doc long, hash long, bucket int"


def _rows(chunk: int, h: np.ndarray, owners: Owners, bucket: np.ndarray) -> pa.Table:
    """A chunk's distinct hashes: how often it has each (below zero if only rows with null ids do), the smallest document that does, and the partition to count it in."""
    order = np.argsort(h)
    begin = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])) if len(h) else np.zeros(0, np.int64)
    least, null = owners.least(order, begin)
    n = np.diff(np.append(begin, len(h))).astype(np.int32) * np.where(null, -1, 1).astype(np.int32)
    place = order[begin]
    # In the order of the texts, neighbours share their document, which packs well.
    back = np.argsort(place)
    place = place[back]
    columns = [pa.array(np.full(len(place), chunk, np.int32)), pa.array(n[back]), pa.array(least[back]), pa.array(h[place].view(np.int64)), pa.array(bucket[place].astype(np.int32))]
    return pa.Table.from_arrays(columns, ["chunk", "n", "doc", "hash", "bucket"])


def _anchors(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        hasher, found, ids = hasher_of(window), [], []
        for i, words in hasher.texts(table):
            a = hasher.anchors(words)
            a = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a
            found.append(a)
            ids.append(i)
        h = np.concatenate(found)
        return _rows(table.column("chunk")[0].as_py(), h, Owners(ids, [len(a) for a in found]), (h >> np.uint64(17)) % np.uint64(buckets))

    return run


def _windows(window: int, buckets: int):
    """The windows of a chunk whose anchor stands elsewhere too."""

    def run(table: pa.Table, again: pa.Table) -> pa.Table:
        hasher, anchors = hasher_of(window), np.sort(again.column("hash").to_numpy().view(np.uint64))
        found, second, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [None]
        for i, words in hasher.texts(table) if len(anchors) else ():
            a = hasher.anchors(words)
            at = np.flatnonzero(anchors[np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)] == a)
            if len(at):
                found.append(hasher.rollers[0](words)[at])
                second.append(hasher.rollers[1](words)[at])
                ids.append(i)
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return _rows(chunk, np.concatenate(found), Owners(ids, [len(a) for a in found]), (np.concatenate(second) >> np.uint64(33)) % np.uint64(buckets))

    return run


def counted(sent: DataFrame, buckets: int) -> DataFrame:
    """``sent`` with ``copies``, how often a hash occurs in all chunks, and ``later``, whether a smaller document than this chunk's has it."""
    same = Window.partitionBy("bucket", "hash")
    later = (F.col("doc") > F.min("doc").over(same)) | ((F.col("n") < 0) & (F.max("n").over(same) > 0))
    return sent.repartitionById(buckets, F.col("bucket")).withColumns({"copies": F.sum(F.abs("n")).over(same), "later": later})


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept_text string"


def _lost(h: np.ndarray, owners: Owners, elsewhere: np.ndarray) -> np.ndarray:
    """Which windows of a chunk some smaller document has: one of the chunk, or one that ``elsewhere`` (sorted hashes) tells of."""
    order = np.argsort(h)
    begin = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(h)))
    foreign = np.zeros(len(begin), bool)
    if len(elsewhere) and len(h):
        first = h[order[begin]]
        foreign = elsewhere[np.minimum(np.searchsorted(elsewhere, first), len(elsewhere) - 1)] == first
    out = np.zeros(len(h), bool)
    least, null = owners.least(order, begin)
    out[order] = (owners.ids[order] > np.repeat(least, size)) | (owners.null[order] & np.repeat(~null, size)) | np.repeat(foreign, size)
    return out


def _cut(window: int, with_text: bool):
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(docs: pa.Table, lost: pa.Table) -> pa.Table:
        hasher = hasher_of(window)
        own = [hasher.rollers[0](words) for _, words in hasher.texts(docs)]
        sizes = np.array([len(h) for h in own], np.int64)
        marked = _lost(np.concatenate([np.zeros(0, np.uint64), *own]), Owners(docs.column("doc_id").to_pylist(), sizes), np.sort(lost.column("hash").to_numpy().view(np.uint64)))
        n_words, n_removed, digest, spans, kept_text = [], [], [], [], []
        for text, stop, size in zip(docs.column("text").to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            words = space_words(text)
            pairs = _spans(np.flatnonzero(marked[stop - size : stop]), window)
            kept, removed, start = [], 0, 0
            for a, b in pairs.reshape(-1, 2).tolist():
                kept += words[start:a]
                removed += b - a
                start = b
            joined = b" ".join(kept + words[start:])
            n_words.append(len(words))
            n_removed.append(removed)
            digest.append(hashlib.sha256(joined).hexdigest())
            spans.append(pairs.tolist())
            kept_text.append(joined.decode("utf-8", "replace") if with_text else None)
        return pa.Table.from_arrays(
            [docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept_text, pa.string())], names
        )

    return run


def dealt(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, partition_bytes: int) -> tuple[DataFrame, int]:
    """``(chunk, doc_id, text)`` of all rows, together by chunk, and the number of partitions that their text needs.

    Equal rows of different input splits go to different chunks, so that no chunk gathers a row that repeats without end.
    What deals them is stored with the rows: they stay in their chunk however often and by whatever partitions they are read.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = stored(docs.select(F.xxhash64(doc_id, text, F.spark_partition_id()).alias("deal"), doc_id.alias("doc_id"), utf8(text_col).alias("text")), "dealt-texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = parts(docs.sparkSession)
    chunks, n = max(least, -(-size // chunk_bytes)), max(least, -(-size // partition_bytes))
    return rows.select(F.pmod("deal", F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text").repartition(n, "chunk"), n


def windows(rows: DataFrame, n: int, window: int) -> tuple[DataFrame, DataFrame]:
    """What Spark counts of dealt documents: all distinct anchors of each chunk, and its windows whose anchor occurs again."""
    anchors = rows.groupBy("chunk").applyInArrow(_anchors(window, n), ROWS)
    again = counted(anchors, n).filter("copies > 1").select("chunk", "hash")
    return anchors, rows.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(_windows(window, n), ROWS)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, spans, kept_text)`` of every row.

    A word goes if a window of ``window`` words over it also starts in a document of smaller id; the
    input decides, not what is left.  ``spans`` are the removed intervals (start, stop, start, stop, ...)
    in words; ``kept_text`` is null unless ``with_text``.  Null, empty and short texts lose nothing.
    Rows that repeat an id are no smaller documents to one another.  A row with a null id comes after
    all others: it loses what any document with an id has, and takes nothing from them.  Other columns
    are ignored.  An empty table gives an empty result.
    """
    rows, n = dealt(docs, id_col, text_col, chunk_bytes, partition_bytes)
    # Every row of a chunk that has a smaller document elsewhere; what its own documents have, a chunk sees itself.
    lost = counted(windows(rows, n, window)[1], n).filter("copies > 1 and later").select("chunk", "hash")
    return rows.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(_cut(window, with_text), OUT)
