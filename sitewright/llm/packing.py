"""Packing of token streams into windows by best-fit decreasing.

Overlong documents are cut into full windows; what remains of each is placed, longest first, into the open window with the
least sufficient room, found in a segment tree indexed by remaining capacity. All pieces of one length are alike, so the plan
runs over the histogram of lengths (at most one entry per possible length, whatever the number of documents) and yields
ranges: the pieces ranked a..b of length L go to windows w.. at offset o. Ranks are assigned in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewright.llm.common import text_buffers, written
from sitewright.llm.tokens import RANKS, VOCABULARY, encoder

CAPACITY, END_ID = 1024, 0
#: ranges that the plan may have; every range but one per length uses up a range of open windows, so they stay few
MAX_RANGES = 1_000_000


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells the least capacity that suffices."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]  # (first window, number) per capacity

    def _mark(self, r: int) -> None:
        i = self.size + r
        self.any[i] = bool(self.groups[r])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, r: int, first: int, number: int) -> None:
        if r and number:
            self.groups[r].append((first, number))
            self._mark(r)

    def take(self, r: int) -> tuple[int, int]:
        got = self.groups[r].pop()
        self._mark(r)
        return got

    def tightest(self, need: int) -> int | None:
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:  # up to the first right sibling with a window, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: ranges (length, first rank, first window, pieces per window, offset)."""
    windows, opened, out = OpenWindows(capacity), 0, []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"piece of {length} in windows of {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = windows.tightest(length)
            if room is None:
                room, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            else:
                first, number = windows.take(room)
            each = room // length  # a window stays the tightest one until the length no longer fits
            whole = min(number, left // each)
            if whole:
                out.append((length, rank, first, each, capacity - room))
                windows.add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < number:
                rest = number - whole
                if left:  # fewer pieces than fit into the next window
                    out.append((length, rank, first + whole, left, capacity - room))
                    windows.add(room - left * length, first + whole, 1)
                    rank, left, whole, rest = rank + left, 0, whole + 1, rest - 1
                windows.add(room, first + whole, rest)
    if len(out) > MAX_RANGES:
        raise ValueError("the plan outgrew its bound")
    return out


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, content: str = "ids",
    vocabulary: str = VOCABULARY, ranks: str | None = RANKS, special: bool = False,
) -> DataFrame:
    """Rows (key, start, length, doc_tokens, chunk, rank, and ids as little-endian uint32 bytes or their crc32).

    Each document is encoded once, ends with ``end_id`` and is cut at multiples of ``capacity``. ``rank`` numbers the pieces
    of one length within the task ``chunk``. The result must be written before ranks are used.
    """
    if content not in ("ids", "crc32"):
        raise ValueError("content must be ids or crc32")
    kind = docs.schema[key].dataType.simpleString()
    last = "ids binary" if content == "ids" else "ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = encoder(vocabulary, ranks, special), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            row, start, length, total, rank, made = [], [], [], [], [], []
            for i in range(batch.num_rows):
                ids = np.append(enc.ids(raw[off[i] : off[i + 1]].tobytes()), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity].tobytes()
                    n = len(piece) // 4
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    total.append(len(ids))
                    rank.append(seen[n])
                    seen[n] += 1
                    made.append(piece if content == "ids" else zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)),
                 pa.array([chunk] * len(row), pa.int64()), pa.array(rank, pa.int64()), pa.array(made, pa.binary() if content == "ids" else pa.int64())],
                [key, "start", "length", "doc_tokens", "chunk", "rank", last.split()[0]],
            )

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, chunk bigint, rank bigint, {last}"
    )


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, content: str = "ids", **how) -> DataFrame:
    """Pack every document's ids into sequences of at most ``capacity`` tokens.

    Returns one row per piece: key, start, length, doc_tokens, ids (or ids_crc32), sequence_id (from 0, no gaps), offset.
    Null and empty texts are the end id alone; a text longer than a window fills windows of its own, its rest is placed like
    a short document; repeated rows are packed each; an empty table gives no rows; other columns are ignored. Pieces of the
    same length are interchangeable, ties go by (task, place in the task).
    """
    pieces = written(token_pieces(docs, key, text, capacity, end_id, content, **how), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = counts.select(
        "length", "chunk",
        (F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"),
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    placed = pieces.join(before, ["length", "chunk"])
    names = [key, "start", "length", "doc_tokens", "ids" if content == "ids" else "ids_crc32"]
    kinds = dict(pieces.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = ranges[:, 0] << 44 | ranges[:, 1]  # ranks below 2**44
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (len(names), len(names) + 1))
            at = ranges[np.searchsorted(lows, length << 44 | rank, side="right") - 1]
            i = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(at[:, 2] + i // at[:, 3]), pa.array(at[:, 4] + i % at[:, 3] * length)], [*names, "sequence_id", "offset"]
            )

    return placed.select(*names, F.col("length").alias("__length"), (F.col("before") + F.col("rank")).alias("__rank")).mapInArrow(
        place, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", sequence_id bigint, offset bigint"
    )
