"""SimHash near-dedup: exact tiled comparison of 64-bit fingerprints by exclusive-or and bit counts.

Equal fingerprints collapse first, so copies cost nothing further.  Two fingerprints within
``radius`` bits agree on one of ``radius + 1`` blocks of bits, so only those that share a block
are compared, in tiles of bounded size; a crowded block is split by population count, and
pairs of tiles whose counts differ by more than the radius are never formed.  Each tile
returns a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from newsdesk.llm.common import bounded, forest, parts, release, runs, space_words, tiled, utf8
from newsdesk.operators.components import connected_components
from newsdesk.session import stored

BATCH_BYTES = 4 << 20


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles of the ASCII-lower-cased text; 0 without words."""
    words = space_words(text.lower()) if text else []
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle_words + 1
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, text_hash long, fp long)`` of every row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in bounded(batches, 1, BATCH_BYTES):
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def near(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``a`` against ``b`` (or within ``a``) that differ in at most ``radius`` bits.

    Both sides are walked in order of population count, and blocks too far apart are skipped.
    """
    own = b is None
    oa = np.argsort(np.bitwise_count(a), kind="stable")
    ob = oa if own else np.argsort(np.bitwise_count(b), kind="stable")
    sa, sb = a[oa], a[oa] if own else b[ob]
    ca, cb = np.bitwise_count(sa).astype(np.int16), np.bitwise_count(sb).astype(np.int16)
    left, right = [], []
    for i in range(0, len(sa), block):
        x, last = sa[i : i + block], min(i + block, len(sa)) - 1
        for j in range(i if own else 0, len(sb), block):
            end = min(j + block, len(sb)) - 1
            if cb[j] - ca[last] > radius:
                break
            if ca[i] - cb[end] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ sb[None, j : j + block]) <= radius)
            if own and i == j:
                keep = p < q
                p, q = p[keep], q[keep]
            left.append(oa[i + p])
            right.append(ob[j + q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _tile_links(radius: int):
    def links(table: pa.Table) -> pa.RecordBatch | None:
        node = table.column("node").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        if side.any():
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = near(fp[first], fp[second], radius)
            i, j = first[i], second[j]
        else:
            i, j = near(fp, None, radius)
        if not len(i):
            return None
        member, root = forest(len(node), i, j)
        return pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[root])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "tile"):
            if table.num_rows > 1 and (found := links(table)) is not None:
                yield found

    return run


def _block(fp: Column, index: int, blocks: int) -> Column:
    low, high = 64 * index // blocks, 64 * (index + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 2048) -> DataFrame:
    """``(u, v)``: links that connect all fingerprints within ``radius`` bits.

    ``distinct`` holds ``(node long, fp long)``, each fingerprint once.
    """
    blocks = radius + 1
    banded = distinct.withColumn("band", F.explode(F.array(*map(F.lit, range(blocks))))).withColumn(
        "block", F.coalesce(*[F.when(F.col("band") == i, _block(F.col("fp"), i, blocks)) for i in range(blocks)])
    )
    sizes = banded.groupBy("band", "block").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(banded.join(sizes, ["band", "block"]), "simhash-blocks")
    small = (
        met.filter(F.col("n") <= tile_rows)
        .select("node", "fp", F.xxhash64("band", "block").alias("tile"), F.lit(0).alias("side"))
        .repartition(parts(distinct.sparkSession), "tile").sortWithinPartitions("tile")
    )
    large = met.filter(F.col("n") > tile_rows).withColumn("ones", F.bit_count("fp"))
    dealt = tiled(large.select("node", "fp", "band", "block", "ones"), ["band", "block"], ["ones"], radius, tile_rows, "fp")
    run = _tile_links(radius)
    columns = ["node", "fp", "tile", "side"]
    return small.select(columns).mapInArrow(run, "u long, v long").unionByName(dealt.select(columns).mapInArrow(run, "u long, v long")).distinct()


def grouped(each: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``(fp, node, component_id)`` of every distinct fingerprint; node is its smallest id."""
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = connected_components(links(distinct.filter("node is not null"), radius, tile_rows))
    return distinct.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, tile_rows: int = 2048) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` of every row of ``docs``.

    Null, empty and wordless texts share fingerprint 0 and link like any other.  Rows that repeat
    an id each come back.  A row with a null id is returned with its fingerprint and the component
    of that fingerprint, null if only null ids have it; it bridges nothing.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    return each.join(grouped(each, radius, tile_rows), "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, tile_rows: int = 2048) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest id, all columns as they were.

    Rows of a null id stay only where no row with an id has their fingerprint, one for each fingerprint.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    groups = grouped(each, radius, tile_rows).filter("node <=> component_id")
    chosen = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("fp").alias("fp"))
    rows = each.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = (
        rows.join(chosen.select("fp", F.col("component_id").alias("node")), "fp").filter("doc_id <=> node")
        .groupBy("fp").agg(F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("row"), F.min_by("n", "text_hash").alias("n"))
        .select(F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), "n")
    )
    named = lambda t: t.select(F.col("doc_id").alias("__newsdesk_id"), F.col("text_hash").alias("__newsdesk_hash"))
    gone = rows.join(kept.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_anti")
    # Only rows repeated word for word, id included, need numbering; what goes is mostly far less than what stays.
    repeated = named(kept.filter("n > 1"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__newsdesk_id")) & (F.xxhash64(F.col(text_col)) == F.col("__newsdesk_hash"))
    again = docs.join(repeated, same).withColumn("__newsdesk_row", F.row_number().over(Window.partitionBy("__newsdesk_id", "__newsdesk_hash").orderBy(F.lit(0))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(named(gone).unionByName(repeated), same, "left_anti").unionByName(again.filter("__newsdesk_row = 1").select(columns))
