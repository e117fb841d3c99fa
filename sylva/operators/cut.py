"""Cutting the rows of a tree, in walk order, into parts of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.paths import DIRECTORY, components, parent_of, prefixes
from sylva.operators.staging import staged
from sylva.operators.tree import subtree_sums, with_estimates

#: Fixed value: bytes of estimated JSON of a part, unless told otherwise.
DEFAULT_BUDGET = 4 << 20


def _number_runs(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Children (parent, path, unit, over), sorted by parent and name, with the number of their run.

    A run closes before a unit that would take it over the budget and before a directory that is
    itself divided. State is a parent, a number and a sum, carried from batch to batch; within a batch
    the end of each run is found in the running sum.
    """
    parent, run, used, empty = None, 0, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        parents, over = batch.column(0), np.array(batch.column(3).to_pylist(), bool)
        unit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(unit)])
        names = parents.dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        breaks = np.concatenate([[0], np.nonzero(code[1:] != code[:-1])[0] + 1, [len(code)]])
        out = np.zeros(len(code), np.int64)
        for s, e in zip(breaks[:-1], breaks[1:]):
            if (name := names.dictionary[int(code[s])].as_py()) != parent:
                parent, run, used, empty = name, 0, 0, True
            at = s
            splits = np.nonzero(over[s:e])[0] + s
            for stop in (*splits, e):
                while at < stop:
                    # As many units as fit beside what the run holds, but one at least if it is empty.
                    end = int(np.searchsorted(sums, sums[at] + budget - used, side="right")) - 1
                    end = min(stop, max(end, at + 1) if empty else max(end, at))
                    if end > at:
                        out[at:end] = run
                        used += int(sums[end] - sums[at])
                        empty = False
                        at = end
                    if at < stop:
                        run, used, empty = run + 1, 0, True
                if stop < e:
                    out[stop] = -1
                    run, used, empty, at = run + 1, 0, True, stop + 1
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out)], names=["path", "run"])


def with_parts(entries: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """The entries with ``estimate`` and ``part_no``, from 0 in walk order.

    A directory is divided when its rows and those below come to more than ``budget``; the root always is.
    Children of a divided directory that aren't divided themselves are units, taken together in name order while
    they fit; a larger one stands alone. The row of a divided directory goes with the first part of its
    contents and doesn't count; without contents it is a part of its own.

    Sizes are summed below every directory at once. Only the children of divided directories are
    put in order, by directory, and streamed through; all else is joins by directory. A global order
    is needed over the parts alone.
    """
    names = [*entries.columns, "estimate"]
    # The walk key is cheaper made again from the path than written and read.
    again = lambda df: df.withColumn("comps", components(F.col("path")))
    rows = again(staged(with_estimates(entries).drop("comps"), "cut-rows"))
    sums = subtree_sums(rows.select("path", "kind", "comps", "estimate"), "estimate")
    directories = staged(sums, "cut-sums")
    over = staged(directories.filter(F.col("total") > budget).select("path"), "cut-over")
    # How many directories above and at each directory are divided: they are the outermost ones.
    ancestors = directories.select(F.col("path").alias("holder"), F.explode(prefixes(components(F.col("path")), own=True)).alias("path"))
    divided = ancestors.join(over, "path").groupBy("holder").agg(F.count("*").cast("int").alias("depth_over"))
    keyed = rows.join(divided, rows.parent == divided.holder, "left").drop("holder")
    keyed = keyed.join(over.select(F.col("path").alias("over_path")), F.col("path") == F.col("over_path"), "left")
    unit = F.array_join(F.slice("comps", F.lit(1), F.coalesce("depth_over", F.lit(0)) + 1), "/")
    keyed = keyed.select("*", F.col("over_path").isNotNull().alias("over"), unit.alias("unit")).drop("comps", "over_path", "depth_over")
    keyed = again(staged(keyed, "cut-units"))
    children = keyed.filter("path = unit").select("parent", "path", "name", "estimate", "over").join(directories, "path", "left")
    children = children.select("parent", "path", F.coalesce("total", "estimate").alias("size"), "over", "name")
    children = children.repartition("parent").sortWithinPartitions("parent", "name").select("parent", "path", "size", "over")
    runs = children.mapInArrow(lambda batches: _number_runs(batches, budget), "path string, run long").filter("run >= 0")
    runs = staged(runs.select(F.col("path").alias("unit"), parent_of(components(F.col("path"))).alias("in_dir"), "run"), "cut-runs")
    # The first row of a run is its first unit.
    firsts = runs.groupBy("in_dir", "run").agg(F.min(components(F.col("unit"))).alias("first"))
    # A divided directory without rows below is a part, under a run that no other has.
    bare = over.join(rows.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")
    firsts = firsts.unionByName(bare.select(F.col("path").alias("in_dir"), F.lit(-1).cast("long").alias("run"), components(F.col("path")).alias("first")))
    # One row per part.
    parts = staged(firsts.withColumn("part_no", (F.row_number().over(Window.orderBy("first")) - 1).cast("long")).select("in_dir", "run", "part_no"), "cut-parts")
    # The row of a divided directory goes with the first part at or below it.
    carried = parts.select("part_no", F.explode(prefixes(components(F.col("in_dir")), own=True)).alias("path")).groupBy("path").agg(F.min("part_no").alias("carried_no"))
    carried = staged(carried.join(over, "path"), "cut-carried")
    units = staged(runs.join(parts, ["in_dir", "run"]).select("unit", "part_no"), "cut-unit-parts")
    out = keyed.join(units, "unit", "left").join(carried, "path", "left")
    return out.withColumn("part_no", F.coalesce("part_no", "carried_no")).select(*names, "part_no")
