"""Product codes against Lloyd's iterations in Python's integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, x string, upper int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, "x", 2) for i, v, label in rows], SCHEMA).repartition(3)


def lloyd(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error) of each usable row, and the codebooks' digest; plain loops."""
    good = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**53 for c in v)]
    if not good:
        return [], None
    lengths = [len(x) for _, x, _ in good]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    width = -(-dim // parts)
    good = [(i, x + [0] * (width * parts - dim), label) for i, x, label in good if len(x) == dim]
    piece = lambda x, p: tuple(x[p * width : (p + 1) * width])
    seeds = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[piece(x, p) for _, x, _ in seeds] for p in range(parts)]
    distance = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    cache = {}

    def nearest(p, a):
        if (p, a) not in cache:
            cache[p, a] = min((distance(a, b), k) for k, b in enumerate(books[p]))
        return cache[p, a]

    for _ in range(rounds):
        members = [[[] for _ in seeds] for _ in range(parts)]
        for _, x, _ in good:
            for p in range(parts):
                members[p][nearest(p, piece(x, p))[1]].append(piece(x, p))
        books = [[tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else b for m, b in zip(members[p], books[p], strict=True)] for p in range(parts)]
        cache.clear()
    out = []
    for i, x, label in good:
        near = [nearest(p, piece(x, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    return out, hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def check(got, rows, **size):
    true, sha = lloyd(rows, **size)
    sums = {}
    for _, label, _, error in true:
        sums[label] = sums.get(label, 0) + error
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(((i, code, error, sums[label], sha) for i, label, code, error in true), key=order)
    assert sorted((tuple(r) for r in got.collect()), key=order) == expected


def test_codes_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(queries.op13_vector_codes(spark, sf), rows)


def awkward(dim=8, n=150):
    rng = np.random.default_rng(13)
    # Coarse values, so that parts tie between entries and entries repeat.
    rows = [(k, (rng.integers(-3, 4, dim) / 256).tolist(), int(k % 3)) for k in range(n)]
    rows += [(None, [0.5] * dim, None), (None, [-0.5] * dim, None), (7, rows[9][1], 1), (7, rows[2][1], None), (n, [-0.0] * dim, 2), (n + 1, [-1e-9] * dim, 2)]
    return rows, [(n + 2, None, 0), (n + 3, [], 0), (n + 4, [1.0], 0), (n + 5, [None] * dim, 1), (n + 6, [float("nan")] * dim, 1), (n + 7, [float("-inf")] * dim, None), (n + 8, [1e200] * dim, 1)]


@pytest.mark.parametrize("size", [{"parts": 4, "entries": 6, "rounds": 3}, {"parts": 3, "entries": 16}, {"parts": 8, "entries": 2, "rounds": 1}, {}])
def test_awkward_rows_and_ties(spark, size):
    good, bad = awkward()
    check(vector_codes.compress(table(spark, good + bad), **size), good + bad, **size)


def test_components_beyond_what_longs_square(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(4) * 1e6).tolist(), 0) for k in range(40)]
    check(vector_codes.compress(table(spark, rows), parts=2, entries=5), rows, parts=2, entries=5)
    far = [(k, [k * 1e14, 0.0], k % 2) for k in range(9)]
    assert {r["error"] for r in vector_codes.compress(table(spark, far), parts=1, entries=2).collect()} >= {None}


def test_nothing_and_fewer_vectors_than_entries(spark):
    assert vector_codes.compress(table(spark, [(1, None, 2)])).collect() == []
    rows = [(2, [1.0, 2.0], 1), (1, [1.0, 2.0], None)]
    check(vector_codes.compress(table(spark, rows), parts=2), rows, parts=2)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    good, _ = awkward()
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    check(vector_codes.compress(table(spark, good), parts=4, entries=6), good, parts=4, entries=6)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x = vector_codes.parted(rng.integers(-90, 90, (600, 32)).astype(np.int64), 8)
    books = x[:40].transpose(1, 0, 2).copy()
    code, found, bounds = vector_codes.first_assignment(x, books)
    taken = []
    for _ in range(4):
        new = books.copy()
        for p in range(8):
            for k in range(40):
                mine = x[code[:, p] == k, p]
                if len(mine):
                    new[p, k] = mine.sum(axis=0) // len(mine)
        movement = vector_codes.roots(vector_codes.squares(new, books)) * (1 + vector_codes.ROOM)
        books = new
        upper, lower = bounds.moved(movement)
        true = np.stack([vector_codes.roots(vector_codes.squares(x[:, p, None], books[p][None])) for p in range(8)], axis=1)
        assert (lower <= true).all() and (upper >= np.take_along_axis(true, bounds.code[:, :, None].astype(int), axis=2)[:, :, 0]).all()
        code, found, bounds, n = vector_codes.next_assignment(x, books, bounds, movement)
        brute = np.stack([vector_codes.squares(x[:, p, None], books[p][None]) for p in range(8)], axis=1)
        assert (code == brute.argmin(axis=2)).all() and (found == brute.min(axis=2)).all()
        taken.append(n / brute.size)
    assert taken[-1] < 0.6 and taken[-1] < taken[0]


def test_a_code_decodes_to_its_entries(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found, books = vector_codes.codes(rows)
    back = vector_codes.decoded(found, books).withColumnRenamed("x", "y")
    whole = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    errors = back.join(whole, "vec_id").select("error", F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d).alias("sum"))
    assert errors.count() == rows.count() and errors.filter("error <> sum").count() == 0
