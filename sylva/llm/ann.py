"""Approximate nearest neighbours by cosine: a k-means tree, searched best bin first.

A query goes on to the leaf whose rows are most similar to it on average: the inner product with the
mean of a leaf's unit vectors, which is short where the leaf is wide. Small leaves tell more, so the
tree has thousands; their rows travel in cells of many leaves, and a query goes to a cell once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import Stages, hash_sample

#: Rows that the tree is fitted on at most. Every row is indexed.
SAMPLE_ROWS = 20_000
#: Rows of a cell at most, about: larger leaves are divided, and so are the queries that visit them.
CELL_ROWS, CELL_QUERIES = 2_048, 8_192
#: Queries that meet a cell's rows together, and rows that a task passes on together.
BLOCK, BATCH = 512, 4_096
#: One of so many sample rows is kept from the tree, to calibrate it, which takes so many of these at least.
HELD_OUT, LEAST_HELD = 4, 256


class Tree:
    """Nodes in arrays: the unit centre of each, the mean of its points, its children, and for a leaf its number."""

    def __init__(self, points: np.ndarray, branches: int, leaf_rows: int, seed: int = 7):
        centers, means = [np.zeros(points.shape[1])], [points.mean(axis=0) if len(points) else np.zeros(points.shape[1])]
        self.children: list[list[int]] = [[]]
        random = np.random.default_rng(seed)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            found, label = _k_means(points[rows], branches, random)
            used = np.unique(label)
            if len(used) < 2:
                continue
            for c in used:
                below = rows[label == c]
                self.children[node].append(len(centers))
                todo.append((len(centers), below))
                centers.append(found[c])
                means.append(points[below].mean(axis=0))
                self.children.append([])
        self.centers, self.means = np.array(centers), np.array(means)
        leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of_node = {node: i for i, node in enumerate(leaves)}
        self.n_leaves = len(leaves)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: at every node on to the nearest child."""
        node = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[at]:
                node[rows] = self.leaf_of_node[at]
                continue
            best = (points[rows] @ self.centers[self.children[at]].T).argmax(axis=1)
            todo += [(c, rows[best == i]) for i, c in enumerate(self.children[at])]
        return node

    def nearest_leaves(self, point: np.ndarray) -> Iterator[int]:
        """Leaves from a priority queue of the nodes met so far, the most similar first."""
        near = self.means @ point
        queue = [(-near[0], 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if not self.children[at]:
                yield self.leaf_of_node[at]
            for c in self.children[at]:
                heapq.heappush(queue, (-near[c], c))


def _k_means(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and the centre of each point."""
    centers = points[random.choice(len(points), size=min(k, len(points)), replace=False)]
    label = np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        label = (points @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers, (points @ centers.T).argmax(axis=1)


def unit(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.float64)
    largest = np.abs(points).max(axis=1, keepdims=True, initial=0)
    points = points / np.where(largest > 0, largest, 1)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def calibrated_visits(tree: Tree, held: np.ndarray, k: int, recall: float, tries: int = 400) -> int:
    """Leaves to visit so that the k nearest of held-out points among themselves are found to ``recall``.

    Visits are widened leaf by leaf; the number returned is where the share found reaches the target. The tree wasn't
    fitted on these points, as it isn't on most rows. A share of the ranks of few points is chance: all leaves are visited then.
    """
    if len(held) < LEAST_HELD:
        return tree.n_leaves
    picked = np.linspace(0, len(held) - 1, min(tries, len(held))).astype(int)
    near = held[picked] @ held.T
    near[np.arange(len(picked)), picked] = -np.inf
    k = min(k, len(held) - 1)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    leaf, ranks = tree.leaf(held), []
    for i, p in enumerate(picked):
        wanted = set(leaf[true[i]].tolist())
        place = {}
        for r, x in enumerate(tree.nearest_leaves(held[p]), 1):
            if x in wanted:
                place[x] = r
                if len(place) == len(wanted):
                    break
        ranks += [place[x] for x in leaf[true[i]]]
    return int(np.quantile(ranks, recall, method="higher"))


def usable(vector: str, dimension: int | None = None):
    """Vectors of the dimension, if it is given, that aren't zero and have finite components only."""
    v = F.col(vector)
    dimension = F.size(v) if dimension is None else dimension
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each row, from left to right: the same wherever the row lies, and in other engines."""
    return np.add.accumulate(rows, axis=1)[:, -1]


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int, visits: list[tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest vectors of a cell for each of its queries: (query, vec_id, cosine). ``visits`` are the rows of each leaf, and the queries (in order) that visit it."""
    out: list[tuple] = []
    units, norms = unit(vectors), np.sqrt(_sums(vectors * vectors))
    for at in range(0, len(queries), BLOCK):
        q, ids = queries[at : at + BLOCK], query_ids[at : at + BLOCK]
        near, asking = np.full((len(q), len(vectors)), -np.inf), unit(q)
        for rows, who in visits:
            who = who[np.searchsorted(who, at) : np.searchsorted(who, at + BLOCK)] - at
            near[who, rows] = asking[who] @ units[rows].T
        near[ids[:, None] == vec_ids[None, :]] = -np.inf
        edge = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
        # All that come as near, up to rounding; the exact measure below decides among them.
        row, col = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -np.inf))
        score = np.empty(len(row))
        q_norms = np.sqrt(_sums(q * q))
        for i in range(0, len(row), 65_536):
            r, c = row[i : i + 65_536], col[i : i + 65_536]
            score[i : i + 65_536] = _sums(q[r] * vectors[c]) / (q_norms[r] * norms[c])
        order = np.lexsort((vec_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        out.append((ids[row[top]], vec_ids[col[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def cells_of(held: dict[int, int], n_leaves: int) -> dict[int, int]:
    """The cell of each leaf that holds rows: neighbouring leaves together up to ``CELL_ROWS``, a larger leaf alone."""
    out, cell, rows = {}, 0, 0
    for leaf in range(n_leaves):
        n = held.get(leaf, 0)
        if rows and rows + n > CELL_ROWS:
            cell, rows = cell + 1, 0
        if n:
            out[leaf] = cell
            rows += n
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.91, branches: int = 16, leaf_rows: int = 16, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k vectors found nearest to each query by cosine: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding. A tree of k-means centres is fitted on a
    sample of ``sample_rows`` at most and sent to the executors: its size depends on that bound alone.
    Every vector goes to its leaf. A query visits leaves best bin first, as many as held-out rows of the sample
    needed for ``recall`` and on until they hold k candidates. Cells of leaves and their queries are dealt
    out in blocks of bounded size, so that a vector with very many copies fills many blocks.

    Scores are the cosines in double precision; ties go to the smaller vec_id. Vectors that are
    null, zero, of another dimension than most of the sample, or hold null or non-finite components take no part;
    a query's candidates are the rows with another vec_id; rows that repeat a query ask once.
    With no usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    pool = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).filter("vec_id is not null")
    ids = F.approx_count_distinct(F.when(usable("embedding"), F.col("vec_id")))
    sizes = pool.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("count"), ids.alias("ids")).orderBy(F.desc("count"), "d").first()
    if sizes is None or sizes.d == 0:
        return spark.createDataFrame([], schema)
    dimension = sizes.d
    pool = pool.filter(usable("embedding", dimension))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(pool.schema["embedding"].dataType).alias("embedding")).filter("vec_id is not null").filter(usable("embedding", dimension)).dropDuplicates()
    sample = hash_sample(pool, "vec_id", sample_rows, sizes.ids).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    points = unit(_matrix(sample["embedding"], dimension))
    apart = np.arange(len(points)) % HELD_OUT == 0
    tree = Tree(points[~apart] if len(points) >= HELD_OUT else points, branches, leaf_rows)
    # As near as a query's k nearest of all rows are so many of the rows held out, or nearer.
    visits = calibrated_visits(tree, points[apart], max(1, round(k * int(apart.sum()) / sizes["count"])), recall)
    sent = spark.sparkContext.broadcast(tree)
    placed = T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("vec_id", T.LongType()), pool.schema["embedding"]])
    arrow = to_arrow_schema(placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.leaf(unit(_matrix(b.column(1), dimension)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column(0), b.column(1).cast(arrow.field(2).type)], schema=arrow)

    stages = Stages(spark, "ann")
    index = stages.write(pool.mapInArrow(place, placed), "index")
    # As many rows as the tree has leaves.
    held = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}
    cell_of = cells_of(held, tree.n_leaves)
    known = spark.sparkContext.broadcast((held, cell_of))
    going_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("vec_id", T.LongType()), pool.schema["embedding"], T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    going_arrow = to_arrow_schema(going_schema)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, cells = known.value
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []

            def flush() -> pa.RecordBatch:
                who = pa.array([i for i, _, _ in out], pa.int64())
                columns = [pa.array([c for _, c, _ in out], pa.int32()), b.column(0).take(who), b.column(1).take(who).cast(going_arrow.field(2).type), pa.array([x for _, _, x in out], going_arrow.field(3).type)]
                return pa.RecordBatch.from_arrays(columns, schema=going_arrow)

            for i, point in enumerate(unit(_matrix(b.column(1), dimension))):
                seen = candidates = 0
                going: dict[int, list[int]] = {}
                for leaf in sent.value.nearest_leaves(point):
                    if seen >= visits and candidates > k:
                        break
                    seen += 1
                    if n := rows_of.get(leaf, 0):
                        candidates += n
                        going.setdefault(cells[leaf], []).append(leaf)
                out += [(i, c, leaves) for c, leaves in going.items()]
                if len(out) >= BATCH:
                    yield flush()
                    out = []
            yield flush()

    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    going = stages.write(asked.mapInArrow(visit, going_schema), "visits")
    came = {r.cell: r["count"] for r in going.groupBy("cell").count().collect()}
    in_cell: dict[int, int] = {}
    for leaf, c in cell_of.items():
        in_cell[c] = in_cell.get(c, 0) + held[leaf]
    blocks = spark.createDataFrame([(c, -(-n // CELL_ROWS), -(-came[c] // CELL_QUERIES)) for c, n in in_cell.items() if c in came], "cell int, blocks int, q_blocks int")
    blocks = F.broadcast(blocks)  # a row per leaf at most
    cells = F.broadcast(spark.createDataFrame(list(cell_of.items()), "leaf int, cell int"))  # a row per leaf at most
    left = index.join(cells, "leaf").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("q_block", F.explode(F.expr("sequence(0, q_blocks - 1)")))
    right = going.join(blocks, "cell").withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.col("q_blocks")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))

    def score(one: pa.Table, two: pa.Table) -> pa.Table:
        q, v, s = (np.zeros(0, np.int64),) * 3
        if one.num_rows and two.num_rows:
            leaf = one["leaf"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, vectors, ids = leaf[order], _matrix(one["embedding"], dimension)[order], one["vec_id"].to_numpy()[order]
            to = two["leaves"].combine_chunks()
            who, to = np.repeat(np.arange(two.num_rows), to.value_lengths().to_numpy()), to.flatten().to_numpy()
            by_leaf = np.argsort(to, kind="stable")
            who, to = who[by_leaf], to[by_leaf]
            visited = [(slice(*np.searchsorted(leaf, [x, x + 1])), who[slice(*np.searchsorted(to, [x, x + 1]))]) for x in np.unique(leaf)]
            q, v, s = _best(_matrix(two["embedding"], dimension), two["vec_id"].to_numpy(), vectors, ids, k, visited)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ("cell", "block", "q_block")
    found = left.select(*key, "leaf", "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding", "leaves").groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")
    # k rows at most of each block that a query visits; those beyond the k best are dropped in each task first.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
