from __future__ import annotations

import random

import numpy as np
import pytest

from sylva.llm import common, components
from sylva.llm import jaccard as J
from sylva.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(a), find(d)) for d, a in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect())


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(50)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5 and rows:  # an edited copy, near the threshold or far from it
            text = list(r.choice(rows)[1].split())
            for _ in range(int(len(text) * r.choice([0, 0.01, 0.02, 0.025, 0.05, 0.2]))):
                text[r.randrange(len(text))] = r.choice(words)
            text = text[r.choice([0, 0, 3, 9]) :]
        else:
            text = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 40, 90, 200, 400]))]
            text += passage if kind > 0.75 else []
        rows.append((i * 3 + 1, " ".join(text), "en", "s"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(documents, seed):
    rows = corpus(seed)
    assert got(documents(rows)) == expected(rows)


def test_small_cells_and_no_rounds_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(J, "CELL_ROWS", 8)
    monkeypatch.setattr(J, "CHUNK", 3)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    rows = corpus(7)
    assert got(documents(rows)) == expected(rows)
    monkeypatch.setattr(J, "NEAREST_ROUNDS", 0)
    assert got(documents(rows)) == expected(rows)


def test_edges(documents):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(9, "A b", "en", "s"), (4, "a  B\n", "en", "s"), (5, "a b c", "en", "s"), (6, None, None, None), (7, "", "en", "s"), (8, " \t", "en", "s"), (2, long, None, "s"), (3, long + " more", "en", None), (3, long + " more", "en", None), (1, "Ä b", "en", "s"), (0, "ä b", "en", "s")]
    want = sorted([(9, 1, 4), (4, 1, 4), (5, 1, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (2, 29_996, 2), (3, 29_997, 2), (3, 29_997, 2), (1, 1, 1), (0, 1, 0)])
    assert got(documents(rows, extra=True)) == want
    assert got(documents([])) == []
    kept = J.deduplicated(documents(rows + [(None, "x", None, None)], extra=True))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (4, 5, 6, 7, 8, 2, 1, 0, None)))


def test_rows_that_repeat_a_doc_id(documents):
    x = " ".join(f"a{i}" for i in range(60))
    rows = [(0, x), (1, x), (1, "unrelated"), (1, "unrelated"), (2, "z"), (2, x + " more"), (3, ""), (3, ""), (None, x), (0, x + " end")]
    kept = J.deduplicated(documents([(d, t, "en", "s") for d, t in rows], extra=True)).collect()
    got = sorted((str(r.doc_id), r.text) for r in kept)
    of_x = [t for d, t in got if d == "0"]
    assert len(of_x) == 1 and of_x[0] in (x, x + " end")
    assert [g for g in got if g[0] != "0"] == sorted([("1", "unrelated"), ("2", "z"), ("3", ""), ("3", ""), ("None", x)])


def test_frequent_keys_lose_nothing(documents, monkeypatch):
    """Every key that three rows of a chunk share travels apart."""
    monkeypatch.setattr(J.block_groups, "__defaults__", (J.BUCKET_KEYS, 3))
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(J, "CHUNK_ROWS", 7)
    for seed in (11, 12):
        rows = corpus(seed)
        assert got(documents(rows).repartition(3)) == expected(rows)


def test_bounds_hold():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 8, 17, 60, 500, 3000):
        for _ in range(20):
            d = r.integers(0, J.differ_at_most(n) + 1)
            shared = r.integers(0, 1 << 48, n, dtype=np.uint64)
            a, b = shared, np.concatenate([shared[d:], r.integers(0, 1 << 48, 0, dtype=np.uint64)])
            if not len(b) or len(b) * 100 < 80 * n:
                continue
            assert set(J.block_keys(a)) & set(J.block_keys(b))
            x, y = (np.frombuffer(J.small_sketch(s, 1024), np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= d


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    looped = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    for few in (0, None):  # in rounds, and by one task
        got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long"), few_edges=few).collect()}
        assert got == {k: v for k, v in root.items() if k not in looped}
        assert connected_components(spark.createDataFrame([], "u long, v long"), few_edges=few).count() == 0
