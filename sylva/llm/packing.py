"""Packing token sequences into windows: best fit, decreasing, with a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.tokens import BYTE_BPE, BYTE_BPE_JSON, encoder

#: Documents and token bytes that are packed together, which bounds a task's memory.
BLOCK_DOCUMENTS, BLOCK_BYTES = 8_192, 24 << 20

Piece = tuple[int, int, int]  # document, start, length


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts, and a stack for each capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += by
            at >>= 1

    def push(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least room of at least ``length``: (room, window)."""
        at, counts = self.leaves + length, self.counts
        if not counts[at]:
            # Up to the first subtree on the right that holds a window, then down its left edge.
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of pieces of at most ``capacity`` each; equal lengths go in their given order."""
    open_, windows = OpenWindows(capacity), []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        found = open_.pop_tightest(piece[2])
        if found is None:
            room, window = capacity, len(windows)
            windows.append([])
        else:
            room, window = found
        windows[window].append(piece)
        if room > piece[2]:
            open_.push(room - piece[2], window)
    return windows


def close_gaps(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cuts up the emptiest windows to fill the gaps of the fullest, until none or one has a gap.

    The last is divided into sequences whose lengths are powers of two, which need no padding.
    """
    full, gaps = [], []
    for window in windows:
        used = sum(p[2] for p in window)
        (full if used == capacity else gaps).append((used, window))
    out = [window for _, window in full]
    gaps.sort(key=lambda x: x[0])
    low, high = 0, len(gaps) - 1
    stock: list[Piece] = []  # pieces of the emptiest window
    while low <= high:
        used, window = gaps[high]
        while used < capacity:
            if not stock:
                if low >= high:
                    break
                stock = gaps[low][1][::-1]
                low += 1
            doc, start, length = stock.pop()
            take = min(length, capacity - used)
            window.append((doc, start, take))
            used += take
            if take < length:
                stock.append((doc, start + take, length - take))
        if used < capacity:
            stock = window[::-1]
            break
        out.append(window)
        high -= 1
    left = sum(p[2] for p in stock)
    for bit in range(left.bit_length() - 1, -1, -1):
        need, window = left & (1 << bit), []
        while need:
            doc, start, length = stock.pop()
            take = min(length, need)
            window.append((doc, start, take))
            need -= take
            if take < length:
                stock.append((doc, start + take, length - take))
        if window:
            out.append(window)
    return out


def _schema(doc_id: T.DataType, with_ids: bool) -> T.StructType:
    fields = [("doc_id", doc_id), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    return T.StructType([T.StructField(*f) for f in fields + [("ids", T.BinaryType())] * with_ids])


def pack(docs: DataFrame, capacity: int = 1024, ranks: str = BYTE_BPE, end_id: int = 0, with_ids: bool = False, added: str | None = BYTE_BPE_JSON) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row per piece.

    ``added`` names a tokenizer's JSON file whose added tokens stand for their strings; with None these are ordinary text.
    A document is the ids of its text and ``end_id``; a null or empty text is ``end_id`` alone.
    Overlong documents are first cut into full windows. What remains of them and shorter
    documents are packed best fit decreasing, in blocks of a bounded number of documents of one
    partition, so that nothing is shuffled and the loss by blocks is that of their last window.
    Windows that keep a gap are filled by cutting up the emptiest, and the last is divided at
    powers of two, so that no sequence is padded. Lengths that tie go in the order of the rows.

    Columns: doc_id, start and length in the document, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens, sequence_id (partition and number in it), offset in the sequence and,
    ``with_ids``, the ids themselves. Rows that share a doc_id are documents of their own.
    """
    kind = docs.schema["doc_id"].dataType
    schema = _schema(kind, with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(ranks, added)
        encode = partial(tokenizer.encode, allowed_special="all") if added else tokenizer.encode_ordinary
        sequence = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, ids, tokens, held
            windows, rest = [], []
            for i, data in enumerate(tokens):
                n = len(data) // 4
                windows += [[(i, at, capacity)] for at in range(0, n - n % capacity, capacity)]
                if n % capacity:
                    rest.append((i, n - n % capacity, n % capacity))
            windows += close_gaps(best_fit_decreasing(rest, capacity), capacity)
            columns: list[list] = [[] for _ in range(len(arrow))]
            for window in windows:
                offset = 0
                for doc, start, length in window:
                    data = memoryview(tokens[doc])[4 * start : 4 * (start + length)]
                    row = (ids[doc], start, length, zlib.crc32(data), len(tokens[doc]) // 4, sequence, offset)
                    for column, value in zip(columns, row + (bytes(data),) * with_ids):
                        column.append(value)
                    offset += length
                sequence += 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4").tobytes()
                ids.append(doc)
                tokens.append(data)
                held += len(data)
                if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
