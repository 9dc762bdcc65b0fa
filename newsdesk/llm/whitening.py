"""Embedding whitening by matrix-free block Lanczos.

The covariance is never formed: a step multiplies it with a block of directions in one pass over the
distinct vectors, each centred before it is multiplied.  The driver keeps the basis, ``dim`` numbers a
direction, orthogonal by full reorthogonalisation.  Where a new block has lost rank, random directions
orthogonal to the basis restart it.  The steps end when the residuals of all wanted components, known from
the products at hand, are at the level of rounding, or the basis is the whole space.

Vectors lie on a grid of whole numbers, so means and squared deviations are exact, and what the components
explain is told against the trace that the deviations add up to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.vectors import halves, joined, lists, matrix, on_grid, summed
from newsdesk.session import stored

STEPS, OFFSET = 64, 1_000_000
#: Residual, against the largest eigenvalue, at which a component is settled.
SETTLED = 2e-14
#: A component with less than this share of the trace counts as none.
NOTHING = 1e-11
#: A direction of a new block with less than this share of its length outside the basis is lost.
LOST = 1e-10


@dataclass(frozen=True)
class Centre:
    """The distinct vectors' number and sums, by way of a whole number near each mean."""

    n: int
    near: np.ndarray
    rest: tuple[int, ...]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), tuple(s % n for s in sums))

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or Python's integers where a long wouldn't do."""
        y = x - self.near
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return y * self.n - np.array(self.rest, np.int64)
        return y.astype(object) * self.n - np.array(self.rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.times_n(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - S)^2 of each row, exact."""
        z = self.times_n(x)
        if z.dtype != object and z.shape[1] * int(np.abs(z).max(initial=0)) ** 2 >= 1 << 63:
            z = z.astype(object)
        return (z * z).sum(axis=1).tolist()


@dataclass(frozen=True)
class Whitening:
    """A fitted model: eigenvalues falling, and the components as columns."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.vectors / np.sqrt(self.values))


def orthogonal(block: np.ndarray, basis: np.ndarray, draw: Callable[[], np.ndarray]) -> tuple[np.ndarray, int]:
    """Orthonormal directions of ``block`` outside ``basis``, as many as there is room for; and how many had to be drawn anew."""
    dim, lost = basis.shape[0], 0
    out = np.zeros((dim, 0))
    for k in range(min(block.shape[1], dim - basis.shape[1])):
        v, drawn = block[:, k], False
        while True:
            before = np.linalg.norm(v)
            for _ in range(3):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if np.isfinite(left) and left > (1e-3 if drawn else LOST) * before > 0:
                break
            v, drawn = draw(), True
        lost += drawn
        out = np.column_stack([out, v / left])
    return out, lost


def lanczos(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues and their vectors of the symmetric ``product``, and the number of products of blocks."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    basis = images = np.zeros((dim, 0))
    block, _ = orthogonal(rng.standard_normal((dim, wanted)), basis, lambda: rng.standard_normal(dim))
    passes = 0
    while True:
        image = product(block)
        passes += 1
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        projected = basis.T @ images
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
        residual = np.linalg.norm(images @ turn - basis @ (turn * values), axis=0)
        if basis.shape[1] == dim or residual.max() <= SETTLED * abs(values[0]):
            vectors = basis @ turn
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        block, _ = orthogonal(image, basis, lambda: rng.standard_normal(dim))


def fit(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The model of all distinct vectors on the grid, each counted once; None without any or if all are equal."""
    found = stored(on_grid(rows, STEPS, OFFSET, id_col, vector_col).select("x").distinct(), "distinct-vectors")
    n = found.count()
    if not n:
        return None
    column = lambda batch: matrix(batch.column("x"))
    sums = summed(found, lambda batch: halves(column(batch)).sum(axis=0), 2, whole=True)
    dim = len(sums)
    centre = Centre.of(n, [joined(*sums[k]) for k in range(dim)])
    squares = summed(found, lambda batch: np.array([[sum(map(float, centre.deviations(column(batch))))]]), 1)
    trace = squares[0][0] / n / n / n
    if trace == 0:
        return None

    def product(block: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            y = centre.centred(column(batch))
            return y.T @ (y @ block)

        out = summed(found, part, block.shape[1])
        return np.array([out[k] for k in range(dim)]) / n

    values, vectors, passes = lanczos(product, dim, components)
    some = values > NOTHING * trace
    model = Whitening(centre, values[some], vectors[:, some], trace, 0.0, passes)
    k = int(some.sum())

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.apply(column(batch))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = summed(found, moments, k)
    second, mean = np.array([got[i] for i in range(k)]) / n, np.array(got[k]) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(centre, model.values, model.vectors, trace, error, passes)


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, deviation, whitened array<double>)`` of every usable vector."""
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("x"))
            deviation = [d if d <= most else None for d in model.centre.deviations(x)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists(model.apply(x), pa.float64())], ["vec_id", "deviation", "whitened"])

    return on_grid(rows, STEPS, OFFSET, id_col, vector_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each usable vector and component.

    Rows go whose vector is null, empty, of another length than most, or holds null or non-finite components
    or one of 2^53 or more, which no grid of longs holds.  Repeated rows and null ids get rows of their own, and equal vectors count
    once in the fit.  There are as many components as asked for, or as the distinct vectors span: equal
    vectors, or a single one, span none, and then, as for an empty table, the result is empty.  Among equal
    eigenvalues any orthonormal vectors will do.  A deviation beyond a long is null.  Further columns are ignored.
    """
    spark = rows.sparkSession
    model = fit(rows, components, id_col, vector_col)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (
        transform(rows, model, id_col, vector_col)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
        .select(
            "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
            shares[F.col("k")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
        )
    )
