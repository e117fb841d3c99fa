from __future__ import annotations

import numpy as np
from helpers import SMALL

from sylva.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k, step=50):
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids], np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in (i for i in ids if i % step == 0):
        x = np.asarray(vectors[q], np.float64)
        score = (x * v).sum(axis=1) / (np.sqrt((x * x).sum()) * norm)
        out[q] = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
    return out


def found(df, **o):
    out: dict = {}
    for r in sorted(ann.nearest(df, df.filter("vec_id % 50 = 0"), **o).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = brute({r.vec_id: r.embedding for r in df.collect()}, 5)
    for o in ({}, {"leaf_rows": 16, "sample_rows": 300}):
        got = found(df, **o)
        assert set(got) == set(want) and all(len(x) == 5 and x == sorted(x) for x in got.values())
        hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)


def test_recall_on_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute({r.vec_id: r.embedding for r in df.collect()}, 5), found(df)
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_visits_fall_with_size():
    """The share of leaves that hold the nearest of rows without any structure, the worst case."""
    r, shares = np.random.default_rng(4), []
    for n in (500, 4_000, 20_000):
        points = ann.unit(r.normal(size=(n, 32)))
        apart = np.arange(n) % ann.HELD_OUT == 0
        tree = ann.Tree(points[~apart], 16, 16)
        shares.append(ann.calibrated_visits(tree, points[apart], 1, 0.91) / tree.n_leaves)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.4


def test_copies_fill_cells_and_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    monkeypatch.setattr(ann, "CELL_QUERIES", 2)
    r = np.random.default_rng(0)
    vectors = {i: r.normal(size=8).astype(np.float32).tolist() for i in range(1000)}
    for i in range(0, 1000, 2):
        vectors[i] = vectors[0]
    got = found(spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA), leaf_rows=16)
    want = brute(vectors, 5)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]


def test_edges(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [2.0, 0.0]), (50, [0.0, 1.0]), (None, [1.0, 2.0]), (8, [2.0, 0.0])]
    got = found(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).selectExpr("*", "1 as leaf", "2 as rank"))
    assert [i for _, i in got[0]] == [8, 8, 1, 50] and len(got[50]) == 4
    assert found(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)) == {}
