"""Audio fingerprints from pitch classes, and the alignment of recordings by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import staged

PITCHES = 12
#: Sixteen filters of two bits each: shape, lowest band, bands, frames. Widest first and over all bands in turn.
FILTERS = tuple((i % 5, (5 * i) % (PITCHES - h + 1), h, w) for i, (h, w) in enumerate((h, w) for w in (16, 12, 8, 4) for h in (12, 8, 6, 4)))
WIDTH = max(f[3] for f in FILTERS)
#: The thresholds that make two bits of a filter's log ratio, as ratios, and their Gray code.
CUTS = np.exp([-0.12, 0.0, 0.12])
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Steps of a scaled frame's values; frames whose prints are made together, about.
ROUNDED, TOGETHER = 1 << 20, 1 << 16
#: The offsets of a fingerprint value that occurs more often in a recording are counted by FFT.
MOST_PLACES = 16
#: Distinct values of a recording that are its landmarks at least, if it has as many, and how many times as many are looked up.
LANDMARKS, WIDENED = 32, 4
#: Landmarks looked up that are sent to every executor at most, about 30 MB; more are joined.
BROADCAST_ROWS = 500_000


def chroma_frames(samples: np.ndarray, rate: int = 11025, frame: int = 4096, hop: int = 1365, lowest: float = 28.0, highest: float = 3520.0) -> np.ndarray:
    """Energies of the twelve pitch classes (A first) of each frame of mono samples."""
    if len(samples) < frame:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float64), frame)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(frame), axis=1)) ** 2
    freq = np.fft.rfftfreq(frame, 1 / rate)
    use = (freq >= lowest) & (freq <= highest)
    pitch = np.round(PITCHES * np.log2(freq[use] / 440.0)).astype(int) % PITCHES
    out = np.zeros((len(frames), PITCHES))
    np.add.at(out.T, pitch, power[:, use].T)
    return out


def voiced_frames(text: str | None, hop: int = 2, window: int = 12) -> np.ndarray:
    """Pitch-class frames of a text as a score: each byte is a note, a frame holds ``window`` notes."""
    notes = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(notes) < window:
        return np.zeros((0, PITCHES))
    sums = np.zeros((len(notes) + 1, PITCHES), np.int32)
    sums[np.arange(1, len(notes) + 1), notes * 7 % PITCHES] = 1
    np.cumsum(sums, axis=0, out=sums)
    starts = np.arange(0, len(notes) - window + 1, hop)
    return (sums[starts + window] - sums[starts]).astype(np.float64)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place where all filters fit: the quantised answers of the filters. Long recordings are taken in stretches."""
    parts = [fingerprint_many([frames[at : at + TOGETHER + WIDTH - 1]])[0] for at in range(0, max(1, len(frames)), TOGETHER)]
    return np.concatenate(parts)


def fingerprint_many(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """The fingerprints of several recordings' frames, by one integral image of all of them.

    Frames are scaled to length one and rounded to 2**-20, so that all sums are exact: the same
    frames give the same integers wherever they lie."""
    sizes = [len(f) for f in recordings]
    n = sum(sizes) - WIDTH + 1
    if n <= 0:
        return [np.zeros(0, np.uint32) for _ in recordings]
    frames = np.concatenate([f.reshape(-1, PITCHES) for f in recordings])
    norm = np.linalg.norm(frames, axis=1, keepdims=True)
    # Bands in rows: a box is four stretches of memory.
    image = np.zeros((PITCHES + 1, len(frames) + 1))
    np.cumsum(np.round(frames / np.where(norm > 0, norm, 1) * ROUNDED).T / ROUNDED, axis=1, out=image[1:, 1:])
    np.cumsum(image, axis=0, out=image)

    def box(x: int, y: int, w: int, h: int) -> np.ndarray:
        upto = image[y + h] - image[y]
        return upto[x + w : x + w + n] - upto[x : x + n]

    out = np.zeros(n, np.uint32)
    for i, (shape, y, h, w) in enumerate(FILTERS):
        whole = box(0, y, w, h)
        if shape == 0:  # lower half of the bands
            part = box(0, y, w, h // 2)
        elif shape == 1:  # first half of the time
            part = box(0, y, w // 2, h)
        elif shape == 2:  # two opposite quarters
            part = box(0, y, w // 2, h // 2) + box(w // 2, y + h // 2, w - w // 2, h - h // 2)
        elif shape == 3:  # middle of the bands
            part = box(0, y + h // 4, w, h // 2)
        else:  # middle of the time
            part = box(w // 4, y, w // 2, h)
        over, under = 1 + part, 1 + (whole - part)
        level = (over >= CUTS[0] * under).astype(np.uint8)
        level += over >= under
        level += over >= CUTS[2] * under
        out |= GRAY[level] << np.uint32(2 * i)
    starts = np.cumsum([0, *sizes])
    return [out[s : max(s, s + size - WIDTH + 1)] for s, size in zip(starts, sizes)]


def landmarks(values: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The landmarks among a print's values, with the first and last place of each.

    Those are the distinct values whose hash ends in so many zero bits that ``LANDMARKS`` or up to twice as many stay, about: an equal value
    in two recordings is a landmark of both, whatever lies around it, and of a longer one only if of a shorter one. ``times`` (a power of two) asks for as many more."""
    found = np.unique(values)
    order = np.argsort(values, kind="stable")
    first = order[np.searchsorted(values[order], found, "left")]
    last = order[np.searchsorted(values[order], found, "right") - 1]
    bits = max(0, (len(found) // (LANDMARKS * times)).bit_length() - 1)
    hashed = found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    keep = hashed & np.uint64((1 << bits) - 1) == 0
    return found[keep], first[keep], last[keep]


def _votes(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All offsets, and how many equal values each has: the sum over ``values`` of their indicator rows' correlations."""
    size = 1 << (len(a) + len(b) - 1).bit_length()
    total = np.zeros(size // 2 + 1, np.complex128)
    for value in values:
        total += np.conj(np.fft.rfft(a == value, size)) * np.fft.rfft(b == value, size)
    counts = np.rint(np.fft.irfft(total, size)).astype(np.int64)
    offsets = np.arange(-len(a) + 1, len(b))
    return offsets, counts[offsets % size]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int]:
    """(offset, bit error rate, overlap): a[i] meets b[i + offset] at the offset that most equal values have.

    Ties go to the smaller shift, then to the left. Without equal values, offset 0 is tried. Values of over
    ``MOST_PLACES`` places are counted by FFT."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    places = np.where(high - low <= MOST_PLACES, high - low, 0)
    i = np.repeat(np.arange(len(a)), places)
    j = order[np.repeat(low, places) + np.arange(len(i)) - np.repeat(np.cumsum(places) - places, places)]
    offset = 0
    if (high > low).any():
        offsets, count = np.unique(j - i, return_counts=True)
        frequent = np.unique(a[high - low > MOST_PLACES])
        if len(frequent):
            every, more = _votes(a, b, frequent)
            more[offsets + len(a) - 1] += count
            offsets, count = every, more
        best = offsets[count == count.max()]
        offset = int(best[np.lexsort((best, np.abs(best)))[0]])
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if end <= start:
        return offset, 1.0, 0
    return offset, int(np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum()) / (32 * (end - start)), end - start


def _together(framed: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Recordings in groups of a bounded number of frames; a longer one alone."""
    held, n = [], 0
    for f in framed:
        if held and n + len(f) > TOGETHER:
            yield held
            held, n = [], 0
        held.append(f)
        n += len(f)
    if held:
        yield held


def fingerprints(media: DataFrame, keys: Sequence[str], column: str, frames: Callable[[object], np.ndarray]) -> DataFrame:
    """The key columns, row (a number), n_frames, ``print`` (little-endian 32-bit integers) and ``class``, a hash of the print.

    Recordings shorter than the widest filter have no print and a null class."""
    extra = [("row", T.LongType()), ("n_frames", T.LongType()), ("print", T.BinaryType()), ("class", T.LongType())]
    schema = T.StructType([*(media.schema[k] for k in keys), *(T.StructField(*x) for x in extra)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for some in _together(frames(v.as_py()) for v in batch.column(len(keys))):
                for f, p in zip(some, fingerprint_many(some) if len(some) > 1 else [fingerprint(some[0])]):
                    data = p.astype("<u4").tobytes()
                    found = (row, len(f), data, int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)) if len(p) else (row, len(f), None, None)
                    row += 1
                    for c, v in zip(rows, found):
                        c.append(v)
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(rows)], schema=arrow)

    return media.select(*keys, F.col(column).alias("_media")).mapInArrow(run, schema)


def _landmark_rows(classes: DataFrame, times: int) -> DataFrame:
    """class, n (values of its print), key, first, last: a row for each landmark."""
    arrow = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("key", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in arrow]
                for c, p in zip(batch.column(0)[at : at + 1024].to_pylist(), batch.column(1)[at : at + 1024]):
                    values = np.frombuffer(p.as_py(), "<u4")
                    key, first, last = landmarks(values, times)
                    for held, x in zip(columns, (np.full(len(key), c), np.full(len(key), len(values)), key.view(np.int32), first, last)):
                        held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(f.type.to_pandas_dtype()), f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return classes.select("class", "print").mapInArrow(run, "class long, n int, key int, first int, last int")


def candidates(classes: DataFrame, asked: DataFrame, least_overlap: float) -> DataFrame:
    """Pairs (a, b) of an asked class and another that share two landmarks, or one if either is short, at offsets by which they can overlap enough."""
    look = _landmark_rows(asked, WIDENED).select(F.col("class").alias("a"), F.col("n").alias("n_a"), "key", F.col("first").alias("first_a"), F.col("last").alias("last_a"))
    look = staged(look, "media-asked")
    look = F.broadcast(look) if look.count() <= BROADCAST_ROWS else look
    need = least_overlap * F.greatest("n_a", "n")
    # b lies later than a by an offset between these; it leaves n_a + offset or n_b - offset values to meet.
    fits = (F.col("first") - F.col("last_a") <= F.col("n") - need) & (F.col("last") - F.col("first_a") >= need - F.col("n_a"))
    pairs = _landmark_rows(classes, 1).join(look, "key").filter((F.col("class") != F.col("a")) & (F.least("n_a", "n") >= need) & fits)
    # Short phrases bring many pairs one landmark; two recordings that align share several.
    found = pairs.groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("n_a", "n")).alias("shorter"))
    return found.filter(F.col("shared") >= F.when(F.col("shorter") >= 2 * LANDMARKS, 2).otherwise(1)).select("a", "b")


def aligned(media: DataFrame, asked: Column, keys: Sequence[str], column: str, frames: Callable[[object], np.ndarray], most_errors: float = 0.1, least_overlap: float = 0.8) -> DataFrame:
    """For each recording that is ``asked``: its class, copies, and the recordings that align with it.

    Two recordings align when, at the offset that most of their equal fingerprints have, at least
    ``least_overlap`` of the longer one overlaps and at most ``most_errors`` of the bits there differ.
    Recordings with equal prints are one class, and classes are compared. Candidates share landmarks
    (:func:`candidates`); that a pair doesn't is the one way to miss it. With errors spread evenly, an eighth of the values are still equal at 9% of the bits
    and of 32 landmarks and more two nearly always are; so ``most_errors`` shouldn't be above 0.1.

    Columns: the keys, n_frames, class, n_copies (others of the class), n_aligned (recordings of other
    classes), and of the best of these (fewest errors, then smallest class) best_class, best_offset,
    best_errors, best_overlap. Recordings too short for a print, null or empty ones among them, have
    null classes and align with nothing. Rows that repeat are copies of each other.
    """
    prints = staged(fingerprints(media.withColumn("_asked", asked), [*keys, "_asked"], column, frames), "media-prints")
    # One row per class, whatever its number of copies: its first. Prints stay where they are unless there are too many copies to list.
    known = prints.filter("class is not null")
    sizes = staged(known.groupBy("class").agg(F.count("*").alias("size"), F.max("_asked").alias("asked"), F.min("row").alias("first")), "media-sizes")
    copies = known.select("class", "row").join(sizes.filter("size > 1").select("class", "first"), "class").filter("row <> first").select("row")
    copies = staged(copies, "media-copies")
    classes = known.select("class", "print", "row").join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti").select("class", "print")
    asked_for = sizes.filter("asked").select("class")
    few = asked_for.count() <= BROADCAST_ROWS
    pairs = staged(candidates(classes, classes.join(F.broadcast(asked_for) if few else asked_for, "class", "left_semi"), least_overlap), "media-pairs")
    # Prints travel only if they are of a pair.
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    near = classes.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "class", "left_semi")
    one = near.select(F.col("class").alias("a"), F.col("print").alias("print_a"))
    two = near.join(sizes, "class").select(F.col("class").alias("b"), F.col("print").alias("print_b"), F.col("size").alias("size_b"))
    both = pairs.join(one, "a").join(two, "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("size_b", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("errors", T.DoubleType()), T.StructField("overlap", T.LongType())])
    arrow = to_arrow_schema(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for a, b, size, p, q in zip(*(x.column(i).to_pylist() for i in range(5))):
                p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
                offset, errors, overlap = align(p, q)
                if errors <= most_errors and overlap >= least_overlap * max(len(p), len(q)):
                    rows.append((a, b, size, offset, errors, overlap))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = both.select("a", "b", "size_b", "print_a", "print_b").mapInArrow(check, schema)
    best = F.min_by(F.struct("b", "offset", "errors", "overlap"), F.struct("errors", "b"))
    found = found.groupBy("a").agg(F.sum("size_b").alias("n_aligned"), best.alias("best"))
    found = sizes.filter("asked").select("class", (F.col("size") - 1).alias("n_copies")).join(found.withColumnRenamed("a", "class"), "class", "left")
    out = prints.filter("_asked").join(staged(found, "media-found"), "class", "left")
    none = F.lit(0).cast("long")
    return out.select(
        *keys, "n_frames", "class", F.coalesce("n_copies", none).alias("n_copies"), F.coalesce("n_aligned", none).alias("n_aligned"), F.col("best.b").alias("best_class"),
        F.col("best.offset").alias("best_offset"), F.col("best.errors").alias("best_errors"), F.col("best.overlap").alias("best_overlap"),
    )
