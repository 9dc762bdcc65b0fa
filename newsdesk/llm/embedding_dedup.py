"""Embedding near-dedup: int8 tile products with per-vector error bounds, exact recomputation near the threshold.

Vectors are scaled to length one, u = s q + e with int8 q.  For two of them
``|u.v - s s' q.q'| <= |e| + |e'| + |e||e'|``, so a quantised product that is further than that from the
threshold decides for certain; the pairs between are recomputed in double precision from the given
components.  Equal vectors of a label collapse first.  Each vector is quantised once, and tiles get int8
vectors, scales and errors; whole vectors only follow to the tiles where one of their pairs is open.

A label of up to a tile's rows is one tile, a larger one is parted.  Unit vectors with cosine of at least t
lie within sqrt(2 - 2 t), and so do their projections on any unit vector: in labels of many parts only
rows in equal or neighbouring cells of principal directions meet, of the more the larger the label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import forest, parts, runs, tiled
from newsdesk.operators.components import connected_components
from newsdesk.session import stored

PIVOTS = 3
#: Bound of the sample of vectors, the smallest keys, that principal directions are taken from; any directions give the same result.
PIVOT_SAMPLE = 2048
#: Room for rounding in the bound itself; far above what double precision loses at these sizes.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, by way of their largest components, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(sample: np.ndarray | None, dim: int) -> np.ndarray:
    """``PIVOTS`` unit vectors: principal directions of a sample, drawn at random without one."""
    if sample is not None and len(sample) > dim >= PIVOTS:
        return np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][:PIVOTS]
    p = np.random.default_rng(20240101).standard_normal((PIVOTS, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, scales and lengths of what quantisation left out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, threshold: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of pairs of ``a`` against ``b`` (or within ``a``) that may reach ``threshold``; sure ones do.

    Sums of int8 products are whole numbers that the matrix product holds exactly, so a pair is judged alike
    wherever it is looked at.
    """
    own = b is None
    (qa, sa, ea), (qb, sb, eb) = a, a if own else b
    exact = np.float32 if qa.shape[1] <= 1024 else np.float64
    for i in range(0, len(qa), block):
        left = qa[i : i + block].astype(exact)
        for j in range(i if own else 0, len(qb), block):
            product = (left @ qb[j : j + block].astype(exact).T).astype(np.float64) * np.outer(sa[i : i + block], sb[j : j + block])
            x, y = ea[i : i + block, None], eb[None, j : j + block]
            room = x + y + x * y + SLACK
            p, q = np.nonzero(product + room >= threshold)
            if own and i == j:
                keep = p < q
                p, q = p[keep], q[keep]
            yield p + i, q + j, product[p, q] - room[p, q] >= threshold


CELLS = [f"cell{k}" for k in range(PIVOTS)]
CELLED = "key binary, node long, label string, copies long, dim int, q binary, scale double, error double, " + ", ".join(f"{c} long" for c in CELLS)
FOUND = "key binary, weight long, u long, v long, tile long, side int, node long, copies long"
_FOUND = pa.schema([("key", pa.binary()), ("weight", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("tile", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64())])


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a batch's lists, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def _celled(threshold: float, pivots: dict[int, np.ndarray]):
    """Each group's vector quantised, and the cells of its projections."""
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch.column("v")):
                u = unit(x)
                q, scale, error = quantised(u)
                cell = np.floor(u @ (pivots[x.shape[1]] if x.shape[1] in pivots else directions(None, x.shape[1])).T / width).astype(np.int64)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("key", "node", "label", "copies")), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(error), *map(pa.array, cell.T)],
                    ["key", "node", "label", "copies", "dim", "q", "scale", "error", *CELLS],
                )

    return run


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _links(table: pa.Table, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Linked copies by key, and a spanning forest of a tile's links."""
    if not len(i):
        return
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    linked = np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
    hit = np.flatnonzero(linked)
    member, root = forest(len(node), i, j)
    yield _rows(len(hit), key=table.column("key").combine_chunks().take(pa.array(hit)), weight=pa.array(linked[hit]))
    yield _rows(len(member), u=pa.array(node[member]), v=pa.array(node[root]))


def _compared(side: np.ndarray, values: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``possible`` pairs of a tile's rows: within it, or its one side against the other."""
    if not side.any():
        yield from possible(values, None, threshold)
        return
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for i, j, sure in possible(tuple(v[first] for v in values), tuple(v[second] for v in values), threshold):
        yield first[i], second[j], sure


def _joined(pairs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *pairs])


def _tile(threshold: float):
    """A tile of int8 vectors: its sure links, and the rows of pairs that stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "tile"):
            if table.num_rows < 2:
                continue
            side = table.column("side").to_numpy()
            q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(table.num_rows, -1)
            left, right, open_ = [], [], np.zeros(table.num_rows, bool)
            for i, j, sure in _compared(side, (q, table.column("scale").to_numpy(), table.column("error").to_numpy()), threshold):
                left.append(i[sure])
                right.append(j[sure])
                open_[i[~sure]] = open_[j[~sure]] = True
            yield from _links(table, _joined(left), _joined(right))
            if open_.any():
                rows = table.filter(pa.array(open_)).combine_chunks()
                yield _rows(rows.num_rows, **{c: rows.column(c).combine_chunks() for c in ("key", "tile", "side", "node", "copies")})

    return run


def _recomputed(threshold: float, block: int = 1 << 16):
    """The open pairs of a tile, from whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "tile"):
            u = unit(next(_vectors(table.column("v")))[1])
            left, right = [], []
            for i, j, sure in _compared(table.column("side").to_numpy(), quantised(u), threshold):
                i, j = i[~sure], j[~sure]
                for k in range(0, len(i), block):
                    p, q = i[k : k + block], j[k : k + block]
                    good = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                    left.append(p[good])
                    right.append(q[good])
            yield from _links(table, _joined(left), _joined(right))

    return run


def grouped(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, key)`` of all rows, null where a vector links with nothing, and a stored row for each key: its vector, label, smallest id and copies."""
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", finite), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    # Equal vectors have equal keys, whatever the sign of their zeros.
    text = F.concat_ws("|", F.length("label"), "label", F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","))
    keyed = given.withColumn("key", F.when(usable, F.unhex(F.sha2(text, 256))))
    groups = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    return keyed.select("vec_id", "key"), stored(groups, "vectors")


def dealt(groups: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """Quantised vectors dealt to tiles."""
    sample: dict[int, list] = {}
    for r in groups.orderBy("key").limit(PIVOT_SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {dim: directions(unit(np.array(v)), dim) for dim, v in sample.items()}
    celled = stored(groups.mapInArrow(_celled(threshold, pivots), CELLED), "vector-cells")
    # A direction sends a row to three cells: it pays once a label has more parts than that to compare with.
    sizes = celled.groupBy("label", "dim").agg(F.count("*").alias("_n")).filter(F.col("_n") > 3 * tile_rows)
    used = {c: F.when(F.col("_n") > tile_rows * 3 ** (k + 1), F.col(c)).otherwise(F.lit(0).cast("long")) for k, c in enumerate(CELLS)}
    placed = celled.join(sizes, ["label", "dim"], "left").withColumns(used).drop("_n")
    return tiled(placed, ["label", "dim"], CELLS, 1, tile_rows, "key").select("tile", "side", "key", "node", "copies", "q", "scale", "error")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile_rows: int = 2048) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row; only rows of an equal, non-null label are compared.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of other lengths; finite components may be of any size.  A row with a null id links with nothing
    and has a null component.  Rows that repeat an id count as one vector each, with links of their own.
    Further columns are ignored.  An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    keyed, groups = grouped(rows, id_col, vector_col, label_col)
    judged = stored(dealt(groups, threshold, tile_rows).mapInArrow(_tile(threshold), FOUND), "vector-links")
    unsettled = judged.filter("tile is not null").select("key", "tile", "side", "node", "copies").join(groups.select("key", "v"), "key")
    unsettled = unsettled.repartition(parts(rows.sparkSession), "tile").sortWithinPartitions("tile", "side")
    settled = stored(unsettled.mapInArrow(_recomputed(threshold), FOUND), "vector-links")
    found = judged.filter("tile is null").unionByName(settled)
    weights = found.filter("weight is not null").groupBy("key").agg(F.sum("weight").alias("weight"))
    component = connected_components(found.filter("u is not null"))
    group = (
        groups.select("key", "node", "copies").join(weights, "key", "left").join(component, "node", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    return (
        keyed.join(group, "key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
