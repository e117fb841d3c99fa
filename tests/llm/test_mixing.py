from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from sylva.llm import mixing
from sylva.llm.mixing import mix_plan, mixed


def plan(df, **o):
    return [r.asDict() for r in mix_plan(df, **o).collect()]


def targets(sizes: dict) -> dict:
    """Weights 3, 1, 2 by code point, null last; 150 % of all; stop at twice the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_sums(documents, seed):
    r = random.Random(seed)
    names = [None, "", "a", "B", "é", "zz", "hot"][: r.randint(1, 7)]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 50])), "en", "hot" if r.random() < 0.4 and "hot" in names else r.choice(names)) for i in range(300)]
    got = plan(documents(rows))
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        mine = [g for g in got if g["source"] == s]
        assert all(g["source_size"] == sizes[s] and abs(g["target"] - want[s]) < 1e-6 * max(1, want[s]) for g in mine)
        assert abs(sum(g["taken"] for g in mine) - want[s]) <= 1
    assert all(0 <= g["taken"] <= 2 * g["size"] for g in got)


def test_many_sources_in_ranges(documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    r = random.Random(9)
    rows = [(i, "w " * r.choice([0, 1, 3, 40]), "en", None if i % 150 == 0 else f"{r.randint(0, 120):x}") for i in range(500)]
    got = plan(documents(rows))
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    assert len(sizes) > 100 and all(abs(g["target"] - want[g["source"]]) < 1e-6 * max(1, want[g["source"]]) for g in got)
    taken: dict = {}
    for g in got:
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    monkeypatch.undo()
    key = lambda g: g["doc_id"]
    assert sorted(got, key=key) == sorted(plan(documents(rows)), key=key)


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = {r.x: (r.n, r.s) for r in mixing.running_sums(rows, [F.col("x").desc()], {"n": F.lit(1), "s": F.col("x")}).collect()}
    assert got == {x: (999 - x, sum(range(x + 1, 1000))) for x in range(1000)}
    assert mixing.running_sums(rows.limit(0), [F.col("x").asc()], {"n": F.lit(1)}).collect() == []


def test_reruns_and_order_dont_matter(documents):
    rows = [(i, "a b " * (i % 9), "en", f"s{i % 4}") for i in range(200)]
    a = sorted(map(str, plan(documents(rows))))
    assert a == sorted(map(str, plan(documents(rows[::-1]).repartition(7))))


def test_smaller_budgets_are_subsets(documents):
    rows = [(i, "a b c", "en", "s") for i in range(200)]
    small = {g["doc_id"] for g in plan(documents(rows), share=(1, 4), cut_boundary=False) if g["taken"]}
    large = {g["doc_id"] for g in plan(documents(rows), share=(1, 2), cut_boundary=False) if g["taken"]}
    assert small < large


def test_edges(documents):
    assert plan(documents([])) == []
    got = plan(documents([(None, None, None, None), (1, "", "en", "a"), (1, "x y", "en", "a"), (1, "x y", "en", "a"), (2, "w " * 100_000, None, "b")], extra=True))
    assert sorted(g["size"] for g in got) == [0, 0, 2, 2, 100_000]
    assert all(g["taken"] == 0 for g in got if not g["size"])


def test_mixed_documents(documents):
    rows = [(i, "a b " * (1 + i % 9), "en", f"s{i % 3}") for i in range(300)] + [(999, None, None, None)]
    df = documents(rows, extra=True)
    out = mixed(df)
    assert out.columns == df.columns
    counts: dict = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    whole = {g["doc_id"]: g["taken"] // g["size"] if g["size"] else 1 for g in plan(df, cut_boundary=False)}
    assert counts == {d: n for d, n in whole.items() if n}
