from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetstorm.llm import bit_sliced
from sheetstorm.llm.bit_sliced import search_block, slice_block, top_k

from .helpers import SF

RNG = np.random.default_rng(5)


def brute(rows, k, asks=lambda i: i % 100 == 0):
    """rows: (id, whole components or None)."""
    usable = [(i, v) for i, v in rows if i is not None and v is not None]
    found = Counter()
    for i, q in {(i, tuple(v)) for i, v in usable if asks(i)}:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in usable if j != i)
        found.update((i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1))
    return found


def whole(v):
    if v is None or any(x is None or not np.isfinite(x) or abs(x) >= 65536 for x in v):
        return None
    return [int(np.floor(1024 * float(x))) for x in v]


def answers(df, **kw):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, **kw).collect())


@pytest.mark.parametrize("width,rows,size", [(1, 10, 3), (3, 200, 5), (16, 700, 300), (64, 1500, 300), (64, 300, 1 << 25), (200, 130, 40)])
def test_blocks_against_brute_force(width, rows, size):
    values = RNG.integers(-size, size + 1, (rows, width)).astype(np.int32)
    values[:, 0] = 7  # an attribute that is the same in all rows
    values[rows // 2 :] = values[: rows - rows // 2]  # ties
    ids = np.sort(RNG.integers(0, rows, rows)).astype(np.int64)
    block = slice_block(ids, values)
    for query_id in (-1, int(ids[0]), int(ids[-1])):
        query = RNG.integers(-size, size + 1, width).astype(np.int32)
        exact = values.astype(np.int64) @ query.astype(np.int64)
        for k in (1, 10, rows + 5):
            want = sorted((-int(s), int(i)) for s, i in zip(exact, ids, strict=True) if i != query_id)[:k]
            scores, found = search_block(block, query_id, query, k)
            assert [(-int(s), int(i)) for s, i in zip(scores, found, strict=True)] == want
            floor = -want[len(want) // 2][0]
            scores, found = search_block(block, query_id, query, k, floor)
            assert [(-int(s), int(i)) for s, i in zip(scores, found, strict=True) if s >= floor] == [x for x in want if -x[0] >= floor]


def test_boundary_is_small():
    """Sums of slices leave few rows to be resolved."""
    values = np.floor(128 * RNG.standard_normal((16384, 64))).astype(np.int32)
    block, resolved = slice_block(np.arange(16384), values), []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[0], np.ndarray):
                resolved.append(len(at[0]))
            return np.asarray(super().__getitem__(at))

    block.values = values.view(Watched)
    for query in values[:20]:
        search_block(block, -1, np.asarray(query), 10)
    assert len(resolved) == 20 and max(resolved) < 16384 // 20


def test_real_vectors(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, whole(r.embedding)) for r in df.collect()]
    assert answers(df) == brute(rows, 10)
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 70)
    monkeypatch.setattr(bit_sliced, "QUERY_ROWS", 2)
    monkeypatch.setattr(bit_sliced, "LANE_BLOCKS", 2)
    assert answers(df.repartition(3), k=7, asks=F.col("vec_id") % 50 == 0) == brute(rows, 7, lambda i: i % 50 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, -0.5]), (0, [0.25]), (0, [0.5, -0.5]), (100, [0.5, 0.5]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, []), (None, [1.0, 1.0]), (700, [70000.0, 1.0]),
        (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [60000.0, -60000.0]), (3, [0.00097, 0.00098]), (4, [-0.0001, 0.0, 3.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, query string")
    assert answers(df) == brute([(i, whole(v)) for i, v in rows], 10)
    assert answers(df, k=2) == brute([(i, whole(v)) for i, v in rows], 2)
    assert top_k(df.limit(0)).count() == 0


def test_one_common_vector(spark):
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 else [float(x) for x in RNG.standard_normal(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(df) == brute([(i, whole(v)) for i, v in rows], 10)
