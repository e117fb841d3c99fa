"""Near-duplicate join by the Jaccard similarity of word shingles, exact, with parity sketches.

A parity sketch has a bit for every hash value, and each shingle flips one: two sketches differ in
no more bits than the sets differ in elements. Sets of n and up to n / 0.8 elements that are similar
to 0.8 differ in floor(n / 4) at most. So, of the blocks of their sketches, no more blocks
differ, and one of the first floor(n / 4) + 1 blocks, in any order that depends on blocks alone, is
equal: the pigeonhole. The fullest blocks go first, as they say most about a set. As these blocks
hold two or three shingles each, their bits are kept as the XOR of the shingles' 64-bit codes:
equal where the bits of a wide block are.

Blocks are made by size band, so that both sets of a pair have as many. Equal texts are one
class from the start. Candidates that share a block are first tied to one of them, verified
and joined to components; only pairs that then still lie in different components are
compared, first by the Hamming distance of a smaller sketch. No link is lost by that: a pair within
one component adds nothing to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import Stages, arrow_rows, join_each
from sylva.llm.components import connected_components

SHINGLE_WORDS = 5
#: Similarity as a fraction, 80 / 100.
ALIKE = (80, 100)
#: Distinct words whose hash a worker keeps; keys that a task holds before it passes them on.
CACHED_WORDS, HELD_KEYS = 1 << 17, 1 << 19
#: Texts or sets that go to Python at a time.
BATCH_ROWS = 1_000
#: Keys that are sorted together, about, however many there are; the rows that a chunk of keys can name by 16 bits.
BUCKET_KEYS, CHUNK_ROWS = 1 << 20, 1 << 16
#: Rows of a chunk that share a key from which they are a group of their own, tied to the key's by its first row.
HOT_ROWS = 64
#: Rows of a block's group that are compared in one task; larger groups are divided.
CELL_ROWS = 4_096
#: Pairs that a task finds before it drops those that another stands for.
HELD_PAIRS = 1 << 17
#: Members in a row of a group.
CHUNK = 4_096
#: Rounds that tie components to their nearest, before all pairs that are left are compared.
NEAREST_ROUNDS = 5
#: Rows up to which a list of them is broadcast, 16 bytes each; beyond that it is joined.
BROADCAST_ROWS = 1_000_000
MIX_1, MIX_2, MIX_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * MIX_2
    x = (x ^ (x >> U(27))) * MIX_3
    return x ^ (x >> U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict[bytes, int], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; A-Z are lower-cased, nothing else."""
    # Bytes are lower-cased in A-Z only and split at just the characters of the contract.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), U)
    for i in range(min(width, len(h))):
        out = out * MIX_1 + mixed(h[i : i + n])
    return np.unique(mixed(out))


def differ_at_most(n: int) -> int:
    """Elements in which a set of n and a similar, not smaller one differ at most: 0.2 / 0.8 of n."""
    return n * (ALIKE[1] - ALIKE[0]) // ALIKE[0]


def blocks_of(band: int) -> int:
    """Blocks of the sketches of a band, whose sets have 2**band to 2**(band + 1) - 1 elements."""
    return max(8, (36 << (band + 1)) // 100)


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's first blocks, in its own band and in the next if a similar set can lie there."""
    n = len(hashes)
    hashes = mixed(hashes)
    band = n.bit_length() - 1
    out = []
    for b in (band, band + 1):
        if b > band and n * ALIKE[1] < ALIKE[0] << b:
            continue
        m = blocks_of(b)
        block = (((hashes >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        codes = np.zeros(m, U)
        np.bitwise_xor.at(codes, block, hashes)
        held = np.bincount(block, minlength=m)
        first = np.argsort(-held, kind="stable")[: differ_at_most(n) + 1]
        out.append(mixed(codes[first] * MIX_1 + mixed((first + (held[first] << 24)).astype(U) + U(b << 56))))
    return np.concatenate(out)


def small_sketch(hashes: np.ndarray, bits: int) -> bytes:
    """Parities of the elements by hash value modulo ``bits``, a multiple of 64."""
    place = ((mixed(hashes) >> U(32)) * U(bits)) >> U(32)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).tobytes()


def packed(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each."""
    return (hashes >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _batch(rows: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)


def document_sets(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """A row per document: doc_id, text_hash, row, node (a hash of its set, null if empty), n_shingles, and the
    elements of the set for the first document of a node in each task."""
    fields = [("text_hash", T.LongType()), ("row", T.LongType()), ("node", T.LongType()), ("n_shingles", T.LongType()), ("elements", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*f) for f in fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[list] = [[] for _ in arrow]
                for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    h = shingles(text.as_py(), hashes, width)
                    node = int.from_bytes(blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) if len(h) else None
                    new = node is not None and node not in seen
                    seen.add(node)
                    for c, v in zip(rows, (doc_id, text_hash, row, node, len(h), packed(h) if new else None)):
                        c.append(v)
                    row += 1
                yield _batch(rows, arrow)

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, schema)


def block_groups(sets: DataFrame, tasks: int, stages: Stages, bucket_keys: int = BUCKET_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of sets (row, n_shingles, elements) that share a block: group, center (one of them), members (others, in chunks).

    Keys travel in chunks of a task's rows, sorted, by bucket: four bytes a key and two for its row. Each bucket is sorted by
    itself; blocks of one row alone, nearly all, end there. Blocks of the same rows are one group, by a hash of them. Where
    ``hot_rows`` rows of a chunk share a key, its bucket gets their first and a hash of them; the rows travel apart and get
    the group's number from there, so that no task gets all rows of a frequent key.
    """
    # About n / 4 keys a set, and those of sets near the end of their band twice.
    keys = sets.agg(F.sum(F.col("n_shingles") / 4 + 1)).first()[0] or 0
    buckets = max(4 * tasks, int(1.4 * keys) // bucket_keys)
    # Without hot, keys and their rows; with hot, a key's first row and hash, or without keys its rows in the chunk.
    sent = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("hot", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("rows", T.BinaryType())])
    sent_arrow = to_arrow_schema(sent)

    def chunk(base: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        k = np.concatenate([x for _, x in held])
        v = np.repeat(np.array([r - base for r, _ in held], np.uint16), [len(x) for _, x in held])
        k = ((k >> U(32)) % U(buckets)) << U(32) | k & U(0xFFFFFFFF)
        order = np.argsort(k, kind="stable")
        k, v = k[order], v[order]
        start = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
        length = np.diff(np.append(start, len(k)))
        stay = np.ones(len(k), bool)
        out: list[list] = [[], [], [], [], []]

        def put(*row) -> None:
            for c, x in zip(out, row):
                c.append(x)

        for s, n in zip(start[length >= hot_rows], length[length >= hot_rows]):
            stay[s : s + n] = False
            key, rows = int(k[s]), v[s : s + n].tobytes()
            digest = blake2b(rows, digest_size=8, salt=base.to_bytes(8, "little")).digest()
            put(key >> 32, base, key, digest, rows[:2])
            put(int.from_bytes(digest[:4], "little") % buckets, base, key, None, rows)
        k, v = k[stay], v[stay]
        bucket = (k >> U(32)).astype(np.int64)
        used, start = np.unique(bucket, return_index=True)
        for b, s, e in zip(used, start, np.append(start[1:], len(k))):
            put(int(b), base, None, k[s:e].astype("<u4").tobytes(), v[s:e].tobytes())
        return _batch(out, sent_arrow)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and (n >= HELD_KEYS or not 0 <= row - held[0][0] < CHUNK_ROWS):
                    yield chunk(held[0][0], held)
                    held, n = [], 0
                held.append((row, block_keys(unpacked(data.as_py()))))
                n += len(held[-1][1])
        if held:
            yield chunk(held[0][0], held)

    # ``hot`` is the key that rows await their group's number by, or with center null that a group's number is for.
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("hot", T.LongType()), T.StructField("center", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def group(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]

        def put(*row) -> None:
            for c, x in zip(out, row):
                c.append(x)

        def put_rows(number: int | None, hot: int | None, rows: np.ndarray) -> None:
            for at in range(1, len(rows), CHUNK):
                put(number, hot, rows[0], rows[at : at + CHUNK])

        keys: list[np.ndarray] = [np.zeros(0, np.uint32)]
        rows: list[np.ndarray] = [np.zeros(0, np.int64)]
        digests: dict[int, list[bytes]] = {}
        for r in table.select(["base", "hot", "keys", "rows"]).to_pylist():
            named = np.frombuffer(r["rows"], np.uint16).astype(np.int64) + r["base"]
            if r["hot"] is not None and r["keys"] is None:
                put_rows(None, r["hot"], named)
                continue
            if r["hot"] is not None:
                digests.setdefault(r["hot"] & 0xFFFFFFFF, []).append(r["keys"])
                r["keys"] = (r["hot"] & 0xFFFFFFFF).to_bytes(4, "little")
            keys.append(np.frombuffer(r["keys"], "<u4"))
            rows.append(named)
        k, v = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        start = np.nonzero(np.append(True, k[1:] != k[:-1]))[0] if len(k) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(k)).astype(np.int64)
        done = set()
        high = table["bucket"][0].as_py() << 32
        many = end - start > 1
        if digests:
            many |= np.isin(k[start], np.array(list(digests), np.uint32))
        for s, e in zip(start[many], end[many]):
            found = digests.get(int(k[s]), [])
            number = int.from_bytes(blake2b(v[s:e].tobytes() + b"".join(sorted(found)), digest_size=8).digest(), "little", signed=True)
            if found:
                put(number, high | int(k[s]), None, None)
            if number not in done:
                done.add(number)
                put_rows(number, None, v[s:e])
        return pa.Table.from_batches([_batch(out, arrow)])

    made = stages.write(sets.select("row", "elements").mapInArrow(deal, sent).groupBy("bucket").applyInArrow(group, schema), "found")
    numbers = made.filter("center is null").select("hot", F.col("group").alias("number"))
    apart = made.filter("group is null").join(numbers, "hot").select(F.col("number").alias("group"), "center", "members")
    found = made.filter("group is not null and center is not null").select("group", "center", "members").union(apart)
    return found.withColumn("least", F.element_at("members", 1)).dropDuplicates(["group", "center", "least"]).drop("least")


def _near(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (row and more) that ``wanted`` (row, distinct) lists; broadcast if they are few."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "row", "left_semi")


def grouped_sets(groups: DataFrame, sets: DataFrame, stages: Stages) -> DataFrame:
    """The sets of all groups' rows, with small sketches: row, n, elements, sketch."""
    rows = stages.write(groups.select(F.explode("members").alias("row")).union(groups.select("center")).distinct(), "rows")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            # As many bits as the power of two that holds the set.
            short = [small_sketch(unpacked(d.as_py()), max(64, 1 << max(0, n - 1).bit_length())) for n, d in zip(x.column(1).to_pylist(), x.column(2))]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(short, pa.binary())], names=["row", "n", "elements", "sketch"])

    near = _near(sets.select("row", "n_shingles", "elements"), rows)
    return near.mapInArrow(sketch, "row long, n long, elements binary, sketch binary")


def verified(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs of rows (u, v) whose sets are similar, by their whole sets."""
    elements = _near(near.select("row", "n", "elements"), pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    left = pairs.join(elements.select(F.col("row").alias("u"), "n", F.col("elements").alias("a")), "u")
    both = left.join(elements.select(F.col("row").alias("v"), F.col("n").alias("m"), F.col("elements").alias("b")), "v")
    schema = "u long, v long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for n, a, m, b in zip(*(x.column(i).to_pylist() for i in range(2, 6))):
                common = len(np.intersect1d(unpacked(a), unpacked(b), assume_unique=True))
                ok.append(ALIKE[1] * common >= ALIKE[0] * (n + m - common))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    # Only sizes that can be similar are compared.
    both = both.filter((F.least("n", "m") * ALIKE[1] >= F.greatest("n", "m") * ALIKE[0])).select("u", "v", "n", "a", "m", "b")
    return both.mapInArrow(check, schema)


class Sketches:
    """The sketches of a table's rows, by width, each also folded to half of it."""

    def __init__(self, data: list[bytes]):
        self.width = np.array([len(d) for d in data], np.int64)
        self.place = np.zeros(len(data), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            rows = np.nonzero(self.width == w)[0]
            self.place[rows] = np.arange(len(rows))
            bits = np.frombuffer(b"".join(data[r] for r in rows), np.uint8).reshape(len(rows), w)
            self.whole[w] = bits.view(np.uint64)
            if w > 8:
                self.half[w] = folded(bits).view(np.uint64)

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of rows x and y, where y has the width of x or twice that."""
        out = np.zeros(len(x), np.int64)
        for w in np.unique(self.width[x]).tolist():
            for other, wide in ((w, self.whole), (2 * w, self.half)):
                pick = np.nonzero((self.width[x] == w) & (self.width[y] == other))[0]
                step = max(1, (1 << 22) // w)
                for at in range(0, len(pick), step):
                    p = pick[at : at + step]
                    out[p] = np.bitwise_count(self.whole[w][self.place[x[p]]] ^ wide[other][self.place[y[p]]]).sum(axis=1, dtype=np.int64)
        return out


def near_enough(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of n and m can be similar when their sketches differ in so many bits."""
    return distance * (ALIKE[1] + ALIKE[0]) <= (n + m) * (ALIKE[1] - ALIKE[0])


def star_pairs(groups: DataFrame, near: DataFrame) -> DataFrame:
    """For each row the one with which it shares most groups as their center, if their sketches are near enough."""
    shared = groups.select("center", F.explode("members").alias("u")).groupBy("u", "center").count()
    stars = shared.groupBy("u").agg(F.max_by("center", F.struct("count", (-F.col("center")).alias("c"))).alias("v"))
    stars = stars.join(near.select(F.col("row").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("s_u")), "u")
    stars = stars.join(near.select(F.col("row").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("s_v")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column(2).to_numpy(), t.column(4).to_numpy()
            both = Sketches([*t.column(3).to_pylist(), *t.column(5).to_pylist()])
            i, j = np.arange(len(n)), np.arange(len(n)) + len(n)
            x, y = np.where(n <= m, i, j), np.where(n <= m, j, i)
            ok = (np.minimum(n, m) * ALIKE[1] >= np.maximum(n, m) * ALIKE[0]) & near_enough(n, m, both.distances(x, y))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["u", "v"]).filter(pa.array(ok))

    return stars.select("u", "v", "n_u", "s_u", "n_v", "s_v").mapInArrow(check, "u long, v long")


def remaining_pairs(groups: DataFrame, roots: DataFrame, near: DataFrame, stages: Stages, nearest: bool) -> DataFrame:
    """Pairs of a group's rows in different components whose sketches are near enough; or only
    that with the nearest sketches of each component."""
    member = groups.select("group", F.explode("members").alias("node")).union(groups.select("group", F.col("center").alias("node")).distinct())
    member = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    divided = member.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("held")).filter("a <> b").select("group", "held")
    member = stages.write(member.join(divided, "group"), "open")
    # A large group is compared block by block: a row meets its own block and every other once.
    rows = member.join(near.select(F.col("row").alias("node"), "n", "sketch"), "node").withColumn("blocks", F.ceil(F.col("held") / CELL_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), F.when(F.col("blocks") > 1, F.col("own") != F.col("other")).otherwise(False).alias("across"), "own", "node", "root", "n", "sketch")
    # Small groups are many: each task call compares those of a bucket together.
    buckets = max(1, member.count() // (4 * CELL_ROWS))

    def compare(table: pa.Table) -> pa.Table:
        cell, node, root, n, own = (table[c].to_numpy() for c in ("cell", "node", "root", "n", "own"))
        order = np.lexsort((n, cell))
        cell, node, root, n, own = cell[order], node[order], root[order], n[order], own[order]
        across = np.array(table["across"].to_pylist(), bool)[order]
        sketch = table["sketch"].take(pa.array(order)).to_pylist()
        known = Sketches(sketch)
        start = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
        end = np.repeat(np.append(start[1:], len(cell)), np.diff(np.append(start, len(cell))))
        # A cell of two blocks compares these with each other only.
        two = np.repeat(np.logical_or.reduceat(across, start), np.diff(np.append(start, len(cell))))
        alive, step, held = np.arange(len(cell)), 0, 0
        found: list[np.ndarray] = []

        def reduced() -> np.ndarray:
            """Distinct columns (root, u, v, distance): for all pairs once, or for each root its nearest."""
            x, y, d = np.concatenate(found, axis=1)
            u, v = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
            if not nearest:
                _, once = np.unique(np.stack([u, v]), axis=1, return_index=True)
                return np.stack([x, y, d])[:, once]
            side, to = np.concatenate([root[x], root[y]]), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((v[to], u[to], d[to], side))
            first = order[np.append(True, side[order][1:] != side[order][:-1])]
            return np.stack([x, y, d])[:, np.unique(to[first])]

        while len(alive):
            step += 1
            alive = alive[alive + step < end[alive]]
            # By size: once the next is too large, all after it are.
            alive = alive[n[alive + step] * ALIKE[0] <= n[alive] * ALIKE[1]]
            x, y = alive, alive + step
            pick = (root[x] != root[y]) & (~two[x] | (own[x] != own[y]))
            x, y = x[pick], y[pick]
            distance = known.distances(x, y)
            ok = near_enough(n[x], n[y], distance)
            if ok.any():
                found.append(np.stack([x[ok], y[ok], distance[ok]]))
                held += int(ok.sum())
                if held > HELD_PAIRS:
                    found = [reduced()]
                    held = 0
        x, y, d = reduced() if found else np.zeros((3, 0), np.int64)
        columns = (root[x], root[y], np.maximum(node[x], node[y]), np.minimum(node[x], node[y]), d)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["root_x", "root_y", "u", "v", "distance"])

    pairs = rows.groupBy(F.pmod("cell", F.lit(buckets))).applyInArrow(compare, "root_x long, root_y long, u long, v long, distance long")
    if not nearest:
        return pairs.select("u", "v").distinct()
    sides = pairs.select(F.explode(F.array("root_x", "root_y")).alias("root"), "u", "v", "distance")
    best = F.min_by(F.struct("u", "v"), F.struct("distance", "u", "v"))
    return sides.groupBy("root").agg(best.alias("best")).select("best.u", "best.v").distinct()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (bytes of packed bits) at half the width: neighbouring bits become their parity."""
    wide = np.unpackbits(bits, axis=1)
    return np.packbits(wide[:, 0::2] ^ wide[:, 1::2], axis=1)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when the Jaccard similarity of their sets of ``width``-word shingles is
    0.8 or more; with fewer words the whole sequence is the one shingle. Null and empty texts and
    those without words have no shingles and link with nothing: their component is their own id.
    Rows stay, repeated ones too; rows without doc_id have the component of the others of their class, null
    if there are none. Shingles are compared by 48 bits of a 64-bit hash.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, width).select("doc_id", "n_shingles", "component_id")


def _links(sets: DataFrame, copies: DataFrame, stages: Stages) -> DataFrame:
    """The root of each row that links join to others: node, root. ``copies`` (u, v) are links known from the start."""
    sets = sets.filter("elements is not null").select("row", "n_shingles", "elements")
    if copies.count() <= BROADCAST_ROWS:
        # What a copy links to, its first row links to; where there are more, they go on as sets of their own.
        sets = sets.join(F.broadcast(copies.select(F.col("u").alias("row"))), "row", "left_anti")
    groups = stages.write(block_groups(sets, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), stages), "groups")
    near = stages.write(grouped_sets(groups, sets, stages), "near")
    stages.drop("sets", "found")
    links, more = copies.union(stages.write(verified(stages.write(star_pairs(groups, near), "pairs"), near), "links")), True
    # Each component is tied to its nearest one while that brings links, which leaves few of a large group's pairs.
    for _ in range(NEAREST_ROUNDS):
        roots = stages.write(connected_components(links), "roots")
        pairs = stages.write(remaining_pairs(groups, roots, near, stages, nearest=True), "pairs")
        if not (more := not pairs.isEmpty()):
            break
        new = stages.write(verified(pairs, near), "links")
        links = links.union(new)
        if new.count() * 10 < pairs.count():
            break
    # Pairs that were nearest and not similar may hide others: all that are left are compared.
    if more:
        roots = stages.write(connected_components(links), "roots")
        pairs = stages.write(remaining_pairs(groups, roots, near, stages, nearest=False), "pairs")
        links = links.union(stages.write(verified(pairs, near), "links"))
    roots = stages.write(connected_components(links), "labels")
    stages.drop("groups", "near", "rows", "pairs", "open", "links", "roots")
    return roots


def _components(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and class, a number that the documents of a component share."""
    stages = Stages(docs.sparkSession, "jaccard")
    sets = stages.write(document_sets(docs, width), "sets")
    # The first row of a node in each task has its set, so that the first of all has it.
    each = stages.write(sets.select("doc_id", "text_hash", "row", "node", "n_shingles", F.col("elements").isNotNull().alias("held")), "documents")
    nodes = each.filter("node is not null").groupBy("node").agg(F.min("row").alias("owner"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.count_if("held").alias("n_held"))
    nodes = stages.write(nodes, "nodes")
    copies = each.filter("held").join(nodes.filter("n_held > 1").select("node", "owner"), "node").filter("row <> owner")
    roots = _links(sets, stages.write(copies.select(F.col("row").alias("u"), F.col("owner").alias("v")), "copies"), stages)
    linked = stages.write(nodes.join(roots, nodes.owner == roots.node).select(nodes.node, "least", "root", F.col("n").alias("documents")), "linked")
    smallest = stages.write(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    # The nodes of one component may be a third of all, and so may be the documents of one text.
    linked = join_each(linked, smallest, "root", "node", stages).select("node", "component_id", F.col("root").alias("class"), F.col("documents").alias("n"))
    alone = nodes.filter("n > 1").join(roots, nodes.owner == roots.node, "left_anti").select("node", F.col("least").alias("component_id"), F.col("owner").alias("class"), "n")
    labels = stages.write(linked.union(alone), "classes")
    # Documents whose text is of one document alone, most of them, find no label; those without words don't look for one.
    columns = ("doc_id", "text_hash", "n_shingles")
    out = join_each(each.filter("node is not null"), labels, "node", "row", stages, "left")
    out = out.select(*columns, F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("component_id"), F.coalesce("class", "row").alias("class"))
    return out.union(each.filter("node is null").select(*columns, F.col("doc_id").alias("component_id"), F.col("row").alias("class")))


def deduplicated(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, with all columns.

    Of a group's rows that repeat that doc_id, one stays: with the text of the smallest hash. Rows are told apart by doc_id and
    text, so that other texts under a doc_id that goes stay. Rows without doc_id and documents without words stay.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        stages = Stages(docs.sparkSession, "deduplicated")
        labels = stages.write(_components(docs, width), "labels")
        gone = labels.filter("doc_id <> component_id").select("doc_id", "text_hash")
        # Groups whose smallest doc_id is that of several rows.
        first = labels.filter("doc_id = component_id and n_shingles > 0").groupBy("class", "doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("kept_hash")).filter("n > 1")
        first = stages.write(first.select("class", "doc_id", "kept_hash"), "repeated")
        other = labels.join(first, ["class", "doc_id"]).filter("text_hash <> kept_hash").select("doc_id", "text_hash")
        gone = stages.write(gone.union(other).distinct().select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")), "gone")
        rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
        few = gone.count() <= BROADCAST_ROWS
        kept = rows.join(F.broadcast(gone) if few else gone, (F.col("_id") == F.col("_gone")) & (F.col("_text") == F.col("_hash")), "left_anti")
        if not first.isEmpty():
            same = first.select(F.col("doc_id").alias("_id"), F.col("kept_hash").alias("_text"))
            once = kept.join(same, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_doc")
            return kept.join(same, ["_id", "_text"], "left_anti").select("_doc").union(once).select("_doc.*")
        return kept.select("_doc.*")
