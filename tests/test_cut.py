"""The cut held against the properties that define it, on a made tree and on random ones."""

from __future__ import annotations

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from sylva.functions.paths import ESTIMATES
from sylva.operators.cut import with_parts
from sylva.operators.parts import part_index, parts_holding, rebuilt_paths, stems, with_node_ids
from sylva.operators.tree import entries_of


def key(path):
    return path.encode().split(b"/")


def uppers(path):
    """All directories above a path, outermost first; the root is the empty path."""
    names = path.split("/")
    return ["/".join(names[:i]) for i in range(len(names))]


class Measures:
    """What the rule speaks of: weights of rows, sums below directories, which are divided, and units."""

    def __init__(self, kinds: dict[str, str], budget: int):
        self.weight = {p: ESTIMATES[k] + len(p.rsplit("/", 1)[-1].encode()) for p, k in kinds.items()}
        self.below = dict.fromkeys(kinds, 0)
        for p, w in self.weight.items():
            for d in (*uppers(p)[1:], p):
                self.below[d] += w
        self.divided = {p for p, k in kinds.items() if k == "directory" and self.below[p] > budget}

    def unit(self, path):
        """The outermost entry at or above a path that isn't divided; None for a divided directory."""
        return next((p for p in (*uppers(path)[1:], path) if p not in self.divided), None)


def holds(kinds: dict[str, str], budget: int, parts: list[list[str]]) -> None:
    """Parts (paths in walk order) are the ones that the rule allows. Each check alone is about one cut, and together
    they leave no choice."""
    m = Measures(kinds, budget)
    assert [p for part in parts for p in part] == sorted(kinds, key=key), "parts follow each other in walk order, and none is empty"
    made_of = []
    for part in parts:
        units = list(dict.fromkeys(u for p in part if (u := m.unit(p)) is not None))
        heads = [p for p in part if p in m.divided]
        assert part[: len(heads)] == heads, "divided directories only open a part"
        assert len({u.rpartition("/")[0] for u in units}) <= 1, "the units of a part are siblings"
        assert all(a in uppers(b) for a, b in pairwise([*heads, *units[:1]])), "heads lead down to the first unit"
        assert sum(m.below[u] for u in units) <= budget or len(units) == 1, "only a unit alone passes the budget"
        if not units:
            assert not any(p.startswith(heads[-1] + "/") for p in kinds), "a part without units is a bare divided directory"
        made_of.append((heads, units))
    where = {u: i for i, (_, units) in enumerate(made_of) for u in units}
    for p in kinds:
        if (u := m.unit(p)) is not None:
            assert p in parts[where[u]], "a unit is in one part as a whole"
    for (_, before), (heads, after) in pairwise(made_of):
        if before and after and not heads and before[0].rpartition("/")[0] == after[0].rpartition("/")[0]:
            assert sum(m.below[u] for u in before) + m.below[after[0]] > budget, "a run ends only where the next unit doesn't fit or a divided sibling comes between"


def made(spark, kinds):
    return entries_of(spark.createDataFrame([(p, k, len(p) if k == "file" else None) for p, k in kinds.items()], "path string, kind string, size long"))


def museum() -> dict[str, str]:
    """Halls of unequal size, a staircase, names that sort unlike their paths, a bare cellar, and links."""
    files = [f"halls/{hall}/{room}/{n * 7 % 100:02}-{'x' * (n % 5)}.obj" for hall, rooms in (("east", 3), ("north", 1), ("west", 5)) for room in "pqrst"[:rooms] for n in range(4 + rooms)]
    files += ["stairs/" + "".join(f"step{i}/" for i in range(n)) + f"rail{n}" for n in range(9)]
    files += [f"{shelf}/{side}book{n}" for shelf in ("m", "m-", "m.1", "m0", "ñ") for side in ("", "back/") for n in range(3)]
    files += [f"catalogue/card{n:04}" for n in range(35)] + ["guide"]
    kinds = dict.fromkeys(files, "file") | {"way-out": "symlink", "halls/way-up": "symlink", "cellar/locked": "directory"}
    for path in list(kinds):
        kinds |= {d: "directory" for d in uppers(path)[1:]}
    return kinds


def budgets(kinds):
    """Below any row, at and beside some of the tree's own sums, and above the whole."""
    sums = sorted(set(Measures(kinds, 0).below.values()))
    picked = {sums[len(sums) * i // 6] for i in range(6)}
    return sorted({0, 3, *picked, *(x - 1 for x in picked), sums[-1] + 1, 1 << 61})


def check(spark, kinds, chosen):
    entries = made(spark, kinds)
    for budget in chosen:
        got: dict[int, list[str]] = {}
        for r in with_parts(entries, budget).select("part_no", "path").collect():
            got.setdefault(r.part_no, []).append(r.path)
        holds(kinds, budget, [sorted(got[n], key=key) for n in range(len(got))])


def test_made_tree_at_many_budgets(spark):
    check(spark, museum(), budgets(museum())[::2])


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    pick = random.Random(100 + seed)
    kinds: dict[str, str] = {}
    for _ in range(70):
        above = pick.choice(["", *(f"{p}/" for p, k in kinds.items() if k == "directory")])
        name = pick.choice(["k", "k-", "k.q", "ñ", "l" * 25]) + str(pick.randrange(40))
        kinds.setdefault(above + name, pick.choices(["directory", "file", "symlink"], (4, 3, 1))[0])
    check(spark, kinds, budgets(kinds)[::3])


def test_the_properties_refuse_other_cuts():
    kinds = {"a": "file", "b": "file", "c": "directory", "c/d": "file"}
    holds(kinds, 300, [["a", "b"], ["c", "c/d"]])
    for wrong in ([["a"], ["b"], ["c", "c/d"]], [["a", "b", "c", "c/d"]], [["a", "b", "c"], ["c/d"]], [["a", "b"], ["c/d", "c"]], [["a", "b"]]):
        with pytest.raises(AssertionError):
            holds(kinds, 300, wrong)


def test_node_ids_rebuild_all_paths(spark):
    numbered = with_node_ids(with_parts(made(spark, museum()), 320))
    assert sorted(r.path for r in rebuilt_paths(numbered).collect()) == sorted(museum())


def test_stem_is_what_lies_above_the_first_row(spark):
    for r in stems(with_parts(made(spark, museum()), 320)).collect():
        assert "/".join(r.stem) == r["first"].rpartition("/")[0]


def test_lookup_finds_every_part_of_a_directory(spark):
    parted = with_parts(made(spark, museum()), 320).cache()
    index = part_index(parted).cache()
    for d in ("catalogue", "m", "m-", "m.1/back", "stairs/step0", "cellar/locked"):
        may = {r.part_no for r in parts_holding(index, F.lit(d)).collect()}
        has = {r.part_no for r in parted.filter((F.col("path") == d) | F.col("path").startswith(d + "/")).collect()}
        assert has <= may and len(may) <= len(has) + 2


def test_no_rows_no_parts(spark):
    assert with_parts(made(spark, {"x": "file"}).filter("false"), 300).count() == 0


def test_leaves_of_odd_paths(spark):
    rows = [("a//b/", 1), ("a/b", 2), ("a/b/c", 5), ("", 1), (None, 1), ("z", None)]
    got = {r.path: (r.kind, r["size"]) for r in entries_of(spark.createDataFrame(rows, "path string, size long")).collect()}
    assert got == {"a": ("directory", None), "a/b": ("directory", None), "a/b/c": ("file", 5), "z": ("file", None)}
