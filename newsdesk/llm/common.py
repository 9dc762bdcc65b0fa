"""Shared pieces of the corpus operators: byte-level words, Arrow batches, bounded tiles."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word of the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` kind become spaces, A-Z become a-z.
_ALNUM = bytes(
    (b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased runs of ASCII digits, letters and non-ASCII characters; null has none."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, unchanged; null has none."""
    return text.split() if text else []


def utf8(name: str) -> Column:
    """A text column as UTF-8 bytes, so that Python tasks need not decode it."""
    return F.col(name).cast("binary")


class Interner(dict):
    """Word -> dense number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bounded(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` (strings or bytes) holds about ``limit`` bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def regrouped(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.Table]:
    """Consecutive rows gathered into tables of about ``limit`` bytes of ``column``, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in bounded(batches, column, limit):
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal ``key``; rows come sorted by it.

    Only the run at hand is held, so callers bound the rows of a key.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, stop in itertools.pairwise([0, *cuts.tolist(), table.num_rows]):
            if held and keys[start] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(start, stop - start))
            last = keys[start]
    if held:
        yield pa.concat_tables(held)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that what another operator kept goes."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def spare() -> None:
    """Memory that Arrow and the C library hold without need goes back to the system: workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    # Only glibc has this; other C libraries give memory back by themselves.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release() -> None:
    """Nothing of an earlier operator's is kept any longer, and spare memory is given back; for tasks that need it themselves."""
    _HELD.clear()
    spare()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tiled(rows: DataFrame, group: list[str], cells: list[str], radius: int, tile_rows: int, salt: str) -> DataFrame:
    """Rows dealt to tiles: ``rows`` plus ``tile`` long and ``side`` int, sorted by tile within partitions.

    Two rows of one ``group`` whose ``cells`` (integers) differ by at most ``radius`` on every
    axis meet in exactly one tile: within side 0 of a tile that has no side 1, or as side 0
    against side 1.  Cell pairs further apart are never formed.  A crowded cell is split by a
    hash of ``salt`` into parts of about ``tile_rows``, so a tile's size is bounded whatever a
    group holds, and a hot group is spread over many tiles.
    """
    keys = [*group, *cells]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_n"))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=len(cells)) if d >= (0,) * len(cells)]
    left = sizes.select(*keys, F.col("_n").alias("_na"), F.explode(F.array(*[
        F.struct(*[(F.col(c) + step).cast("long").alias(f"_b{i}") for i, (c, step) in enumerate(zip(cells, d, strict=True))], F.lit(d == (0,) * len(cells)).alias("_own"))
        for d in steps
    ])).alias("_s")).select(*keys, "_na", "_s.*")
    right = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.col(c).cast("long").alias(f"_c{i}") for i, c in enumerate(cells)], F.col("_n").alias("_nb"))
    on = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)] + [F.col(f"_b{i}") == F.col(f"_c{i}") for i in range(len(cells))]
    pairs = (
        left.join(right, on)
        .withColumn("_sa", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
        .withColumn("_sb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .filter("not _own or _sb >= _sa")
        .withColumn("tile", F.xxhash64(*keys, *[f"_b{i}" for i in range(len(cells))], "_sa", "_sb"))
    )
    seats = pairs.select(*keys, F.col("_sa").alias("_s"), "tile", F.lit(0).alias("side")).unionByName(
        pairs.filter("not _own or _sb <> _sa").select(
            *group, *[F.col(f"_b{i}").cast(dict(rows.dtypes)[c]).alias(c) for i, c in enumerate(cells)], F.col("_sb").alias("_s"), "tile", F.lit(1).alias("side")
        )
    )
    placed = rows.join(sizes, keys).withColumn("_s", F.pmod(F.xxhash64(F.col(salt)), F.col("_n")).cast("int")).drop("_n")
    dealt = placed.join(seats, [*keys, "_s"]).drop("_s")
    return dealt.repartition(parts(rows.sparkSession), "tile").sortWithinPartitions("tile", "side")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star from each component's smallest vertex, for links between vertices 0 to n - 1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if np.array_equal(before, label):
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]
