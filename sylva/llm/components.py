"""Connected components of a table of edges, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import Stages, join_each


#: Edges up to which one task joins them, in memory; more are joined in rounds.
FEW_EDGES = 1 << 18


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by smaller number over all edges."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in list(above)], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, few_edges: int | None = None) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (u, v: long): node, root.

    Alternates two rounds until nothing changes, which is after about log(nodes) of them: every node's larger
    neighbours are tied to its smallest one, then its smaller neighbours are. Minima are summed up in
    each task first, and the edges of a node with very many meet its minimum in several tasks. Each round
    is written to the shared folder, and the one before it is dropped. A table of ``few_edges`` at most, a bound that is
    measured, is joined by one task instead, to the same result.
    """
    stages = Stages(edges.sparkSession, "components")
    now = stages.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "0")
    if now.count() <= (FEW_EDGES if few_edges is None else few_edges):
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    seen, n = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "least")
        large = join_each(both.filter("v > u"), least, "u", "v", stages).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stages.write(large, "large")
        least = stages.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_each(large, least, "u", "v", stages).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        n += 1
        now = stages.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), str(n))
        stages.drop(str(n - 1), "least", "large", "hot")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
