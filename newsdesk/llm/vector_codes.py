"""Product codes of vectors by Elkan's version of Lloyd's iterations.

Each part of a vector keeps an upper bound of the distance to its own codebook entry and a lower bound of the
distance to every entry.  The bounds are stored with the vectors from round to round and shifted by how far
entries moved.  By the triangle inequality an entry is passed over when its lower bound, or half its distance
from the part's own entry, is strictly above the upper bound; what is left is compared in whole numbers, so
ties go to the lower index whatever the bounds' rounding.

Rows are never shuffled: a task sends its counts and sums by entry, and the driver gets one codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.vectors import halves, joined, lists, matrix, on_grid, summed
from newsdesk.session import discardable, stored

STEPS = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Beyond this, distances are taken in Python's integers instead of longs.
LONG_SAFE = 1 << 22
#: Room for rounding in bounds, as a share; doubles and their square roots lose far less.
ROOM = 1e-9
#: Bound of the rows of label sums that are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def parted(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width): consecutive parts of equal width; the last is filled with zeros where they don't divide the vector."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if max(int(np.abs(v).max(initial=0)) for v in (a, b)) >= LONG_SAFE:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Bounds:
    """Of a batch: codes (rows, parts), upper bounds (rows, parts), lower bounds (rows, parts, entries) in steps of ``unit`` (rows, parts)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    unit: np.ndarray

    @classmethod
    def measured(cls, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> Bounds:
        """Lower bounds rounded down to 255 steps of their largest, upper bounds up."""
        unit = (lower.max(axis=2) / 255 * (1 + 1e-6)).astype(np.float32)
        step = np.where(unit > 0, unit, 1).astype(np.float64)
        steps = np.minimum(np.floor(lower / step[:, :, None] * (1 - ROOM)), 255).astype(np.uint8)
        return cls(code, np.nextafter(upper.astype(np.float32), np.float32(np.inf)), steps, unit)

    def moved(self, movement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds after entries moved by up to ``movement`` (parts, entries)."""
        own = movement[np.arange(len(movement)), self.code]
        upper = (self.upper.astype(np.float64) + own) * (1 + ROOM)
        lower = np.maximum(self.lower * self.unit.astype(np.float64)[:, :, None] - movement[None], 0) * (1 - ROOM)
        return upper, lower


def first_assignment(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bounds]:
    """(codes, squared distances, bounds) with every distance taken, as there are no bounds yet."""
    codes, found, upper, lower = [], [], [], []
    for p in range(books.shape[0]):
        d = squares(x[:, p, None, :], books[p][None])
        best = d.argmin(axis=1)
        codes.append(best)
        found.append(np.take_along_axis(d, best[:, None], axis=1)[:, 0])
        r = roots(d)
        lower.append(r)
        upper.append(np.take_along_axis(r, best[:, None], axis=1)[:, 0])
    code = np.stack(codes, axis=1)
    return code, np.stack(found, axis=1), Bounds.measured(code, np.stack(upper, axis=1), np.stack(lower, axis=1))


def next_assignment(x: np.ndarray, books: np.ndarray, bounds: Bounds, movement: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bounds, int]:
    """(codes, squared distances, bounds, distances taken) for entries that moved; only what bounds leave open is compared."""
    upper, lower = bounds.moved(movement)
    code = bounds.code.astype(np.int64)
    kept, found = code.copy(), np.zeros(code.shape, object if code.size and _wide(x, books) else np.int64)
    taken = 0
    for p in range(books.shape[0]):
        rows = np.arange(len(x))
        own = squares(x[:, p], books[p][code[:, p]])
        taken += len(x)
        # The distance to the own entry is exact from here on.
        exact = roots(own)
        lower[rows, p, code[:, p]] = exact
        top = exact * (1 + ROOM)
        apart = roots(squares(books[p][:, None, :], books[p][None])) * (0.5 * (1 - ROOM))
        open_ = (lower[:, p] * (1 - ROOM) <= top[:, None]) & (apart[code[:, p]] <= top[:, None])
        open_[rows, code[:, p]] = False
        i, c = np.nonzero(open_)
        best, at = own.copy(), code[:, p].copy()
        if len(i):
            d = squares(x[i, p], books[p][c])
            taken += len(i)
            lower[i, p, c] = roots(d)
            # Of a row's candidates the nearest, of equals the lowest index: the last written wins.
            order = np.lexsort((-c, -d, i)) if d.dtype != object else np.array(sorted(range(len(i)), key=lambda k: (i[k], -d[k], -c[k])))
            row, entry, near = i[order], c[order], d[order]
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
            row, entry, near = row[last], entry[last], near[last]
            better = (near < best[row]) | ((near == best[row]) & (entry < at[row]))
            best[row[better]], at[row[better]] = near[better], entry[better]
        kept[:, p], found[:, p] = at, best
        upper[:, p] = roots(best)
    return kept, found, Bounds.measured(kept, upper, lower), taken


def _wide(*arrays: np.ndarray) -> bool:
    return any(int(np.abs(a).max(initial=0)) >= LONG_SAFE for a in arrays)


STATE = "vec_id long, label string, x array<long>, code binary, upper binary, lower binary, unit binary"


def _packed(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    return pa.array([r.tobytes() for r in a.reshape(len(a), -1)], pa.binary())


def _unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _bounds(batch: pa.RecordBatch, parts: int, entries: int) -> Bounds:
    return Bounds(
        _unpacked(batch.column("code"), np.uint8, parts), _unpacked(batch.column("upper"), np.float32, parts),
        _unpacked(batch.column("lower"), np.uint8, parts, entries), _unpacked(batch.column("unit"), np.float32, parts),
    )


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _state(batch: pa.RecordBatch, bounds: Bounds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("vec_id"), batch.column("label"), batch.column("x"), _packed(bounds.code.astype(np.uint8)), _packed(bounds.upper), _packed(bounds.lower), _packed(bounds.unit)],
        ["vec_id", "label", "x", "code", "upper", "lower", "unit"],
    )


def seeds(given: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the smallest ids, ascending; of equal ids the smaller vector first, null ids last."""
    first = given.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    return parted(np.array([r["x"] for r in first], np.int64), parts).transpose(1, 0, 2)


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry the floor of its parts' mean, component by component; entries of no part stay."""
    parts, entries, width = books.shape

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x, code = parted(matrix(batch.column("x")), parts), _unpacked(batch.column("code"), np.uint8, parts).astype(np.int64)
        at = (code + np.arange(parts) * entries).ravel()
        out = np.zeros((parts * entries, 1 + 2 * width), np.int64)
        np.add.at(out, at, np.concatenate([np.ones((len(at), 1), np.int64), halves(x.reshape(-1, width)).reshape(-1, 2 * width)], axis=1))
        return out

    total = summed(state.select("x", "code"), sums, 1 + 2 * width, whole=True)
    new = books.copy()
    for at, (n, *s) in total.items():
        if n:
            new[at // entries, at % entries] = [joined(s[2 * k], s[2 * k + 1]) // n for k in range(width)]
    return new


def digest(books: np.ndarray) -> str:
    """Of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code binary, error)`` of every usable vector, a byte of code a part, and the final codebooks (parts, entries, width).

    The codebooks start with the vectors of the smallest ids; there are fewer entries where there are fewer
    vectors.  After ``rounds`` of assigning and replacing, parts are assigned once more.  Without any
    vector the result is empty, as are the codebooks.
    """
    if not 0 < entries <= 256 or parts < 1 or rounds < 1:
        raise ValueError("1 to 256 entries, at least one part and one round")
    given = on_grid(rows, STEPS, 0, id_col, vector_col, label_col).withColumn("label", F.col(label_col).cast("string"))
    given = given.select("vec_id", "x", "label")
    books = seeds(given, parts, entries)
    if not books.size:
        return rows.sparkSession.createDataFrame([], "vec_id long, label string, code binary, error long"), books
    entries = books.shape[1]

    def begin(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 512):
            yield _state(batch, first_assignment(parted(matrix(batch.column("x")), parts), books)[2])

    state, discard = discardable(given.mapInArrow(begin, STATE), "codes")
    for left in reversed(range(rounds)):
        new = updated(state, books)
        # Movements are rounded up, so that shifted bounds hold.
        movement, books = roots(squares(new, books)) * (1 + ROOM), new
        if left:

            def again(batches: Iterator[pa.RecordBatch], books: np.ndarray = books, movement: np.ndarray = movement) -> Iterator[pa.RecordBatch]:
                for batch in _sliced(batches):
                    yield _state(batch, next_assignment(parted(matrix(batch.column("x")), parts), books, _bounds(batch, parts, entries), movement)[2])

            before, (state, discard) = discard, discardable(state.mapInArrow(again, STATE), "codes")
            before()
    most = (1 << 63) - 1

    def finish(batches: Iterator[pa.RecordBatch], books: np.ndarray = books, movement: np.ndarray = movement) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            code, found, *_ = next_assignment(parted(matrix(batch.column("x")), parts), books, _bounds(batch, parts, entries), movement)
            errors = [e if e <= most else None for e in found.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _packed(code.astype(np.uint8)), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    out = stored(state.mapInArrow(finish, "vec_id long, label string, code binary, error long"), "vector-codes")
    discard()
    return out, books


def decoded(found: DataFrame, books: np.ndarray) -> DataFrame:
    """``found`` with ``x array<long>``, the vector that the code stands for (with the zeros that filled the last part)."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = _unpacked(batch.column("code"), np.uint8, parts)
                x = np.stack([books[p][code[:, p]] for p in range(parts)], axis=1).reshape(len(code), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(x, pa.int64())], [*batch.schema.names, "x"])

    return found.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", x array<long>")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable vector.

    Rows go whose vector is null, empty, of another length than most, or holds null or non-finite components
    or one of 2^53 or more.  A length that the parts don't divide is filled up with zeros.  Repeated rows and
    null ids are rows like any other, only that null ids seed the codebooks last.  Among entries equally
    near the lowest index wins.  Null labels count together.  An error, or a sum of errors, beyond a long is
    null.  An empty table gives an empty result.  Further columns are ignored.
    """
    found, books = codes(rows, parts, entries, rounds, id_col, vector_col, label_col)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    known = F.count("*") == F.count("error")
    sums = stored(found.groupBy("label").agg(F.when(known & (total <= F.lit((1 << 63) - 1)), total).cast("long").alias("label_error")), "label-errors")
    small = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "_label")
    return found.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
