"""Packing token sequences by the sum-of-squares online rule.

Documents arrive one by one. Whole windows of a document become sequences of their own; what is left
of it is placed at the fill level for which the sum over levels of (number of partially filled
windows at that level) squared becomes least. The counts live in one array over levels, so a
placement costs the array's length whatever the number of windows.

Each task packs the documents of its input split in one pass, without a shuffle, and holds the ids of
partially filled windows only. At a split's end the emptiest windows are cut up to fill the fullest,
and the one window that stays partial is cut into sequences whose lengths are powers of two, which
need no padding.

Defined cases: a null or empty text is a document of the end id alone; repeated ids are packed as
separate documents, null ids as documents of a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

CAPACITY, END_ID = 2048, 1
#: Sequences that one task may make: the task's number is above these bits of a sequence id.
LOCAL_BITS = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class SumOfSquares:
    """Open windows by fill level. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The level at which an item of this size makes the sum of squares least; 0 opens a window, ties go to the fuller level."""
        n, room = self.counts, self.capacity - size
        cost = 2 * (n[size:] - n[: room + 1]) + 2  # (n[h]-1)^2 + (n[h+size]+1)^2 against before
        cost[room] = 1 - 2 * n[room]  # a full window leaves the counts
        cost[0] = 2 * n[size] + 1
        cost[1:][n[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put the piece into a window; the window's pieces if it is full now."""
        size = len(piece[2])
        if size == self.capacity:
            return [piece]
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.open[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """The windows that are still open, cut up so that at most one lacks ids; that one as powers of two."""
        left = [w for level in reversed(self.open) for w in level]
        fills = [sum(len(p[2]) for p in w) for w in left]
        first, last = 0, len(left) - 1
        while first < last:
            room = self.capacity - fills[first]
            while room and first < last:
                doc, start, ids, total = left[last].pop()
                take = min(room, len(ids))
                left[first].append((doc, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    left[last].append((doc, start, ids[: len(ids) - take], total))
                fills[last] -= take
                room -= take
                if not fills[last]:
                    last -= 1
            fills[first] = self.capacity - room
            if not room:
                yield left[first]
                first += 1
        if first == last and fills[first]:
            yield from powers_of_two(left[first])


def powers_of_two(window: list[tuple]) -> Iterator[list[tuple]]:
    """Cut a window into sequences whose lengths are the binary digits of its own length."""
    rest = sum(len(p[2]) for p in window)
    queue = window[::-1]
    while rest:
        room, out = 1 << (rest.bit_length() - 1), []
        rest -= room
        while room:
            doc, start, ids, total = queue.pop()
            take = min(room, len(ids))
            out.append((doc, start, ids[:take], total))
            if take < len(ids):
                queue.append((doc, start + take, ids[take:], total))
            room -= take
        yield out


def padded(length: int, capacity: int) -> int:
    return length if length & (length - 1) == 0 else capacity


def pack(documents: Iterable[tuple[int, np.ndarray]], capacity: int = CAPACITY, first_sequence: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA for documents given as (doc_id, ids with the end id)."""
    packer, sequence = SumOfSquares(capacity), first_sequence

    def rows(window: list[tuple]) -> Iterator[tuple]:
        nonlocal sequence
        offset, length = 0, padded(sum(len(p[2]) for p in window), capacity)
        for doc, start, ids, total in window:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, length
            offset += len(ids)
        sequence += 1

    for doc, ids in documents:
        for start in range(0, len(ids), capacity):
            full = packer.place((doc, start, ids[start : start + capacity], len(ids)))
            if full:
                yield from rows(full)
    for window in packer.close():
        yield from rows(window)


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids with the end id) of every document of a task."""
    t = tokens.tokenizer(path)
    end = np.array([end_id], t.dtype)
    for b in common.slices(batches, owner="pieces"):
        for doc, ids in zip(b.column(0).to_pylist(), t.encode(b.column(1).to_pylist()), strict=True):
            yield doc, np.concatenate([ids, end])


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their sequence and offset. Columns: SCHEMA."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out = TaskContext.get().partitionId() << LOCAL_BITS, []
        for row in pack(encoded(batches, tokenizer_path, end_id), capacity, first):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)

    return common.texts(docs).mapInArrow(run, SCHEMA)
