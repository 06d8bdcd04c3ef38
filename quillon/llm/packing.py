"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids (and its end id) fill whole windows first; what is
left goes to the open window it fits best, and when it fits none, the fullest window is emitted and a new one opened. The
windows still open at a partition's end are merged with those of its neighbours, a bounded number of partitions at a time,
placing pieces from the longest down. Texts are never shuffled; only pieces of the open windows move.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed as often as they occur;
texts of any length are cut into as many pieces as they need; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, slices
from .tokens import encoder

WINDOW = 4096
#: Windows that a partition keeps open.
OPEN = 32
#: Partitions whose open windows are merged together: at most FAN * OPEN windows meet in a task.
FAN = 16
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Windows:
    """Best-fit placement into a bounded number of open windows."""

    def __init__(self, size: int = WINDOW, most: int = OPEN):
        self.size, self.most = size, most
        self.fill: list[int] = []
        self.held: list[list[tuple]] = []

    def place(self, piece: tuple, length: int) -> list[tuple] | None:
        """Put a piece of ``length`` (at most the window's size); the window emitted to make room, if any."""
        room = self.size - length
        best = max((f for f in self.fill if f <= room), default=-1)
        if best >= 0:
            at = self.fill.index(best)
            self.held[at].append(piece)
            self.fill[at] += length
            if self.fill[at] < self.size:
                return None
            self.fill.pop(at)
            return self.held.pop(at)
        emitted = None
        if len(self.fill) >= self.most:
            at = self.fill.index(max(self.fill))
            self.fill.pop(at)
            emitted = self.held.pop(at)
        if length == self.size:  # never left open
            raise ValueError("a full piece is a window of its own")
        self.fill.append(length)
        self.held.append([piece])
        return emitted


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, most: int = OPEN, fan: int = FAN, ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``."""
    end = struct.pack("<I", end_id)
    names = [*_COLUMNS, *["ids"] * ids, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode_all
        windows, made = Windows(window, most), 0
        rows: list[tuple] = []

        def emit(pieces: list[tuple], closed: bool = True) -> None:
            nonlocal made
            at = 0
            for piece in pieces:
                rows.append((*piece[:5], (part << 32) + made, at, *piece[5:], None if closed else part))
                at += piece[2]
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)
            rows.clear()
            return out

        for batch in slices(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in batch.column("text").to_pylist()])):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    item = (doc_id, start, length, zlib.crc32(piece), n, *[piece] * ids)
                    if length == window:
                        emit([item])
                    elif (full := windows.place(item, length)) is not None:
                        emit(full)
            if rows:
                yield flush()
        for pieces in windows.held:
            emit(pieces, closed=False)
        yield flush()

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    placed = arrow_pass(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)
    # The pass runs once: closed and open pieces are told apart after it, in one grouped step over the open ones alone.
    placed = cut(placed)
    columns = [n for n in names if n != "part"]

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        order = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        free: list[tuple[int, int]] = []  # (room, window)
        sequence, offset, fills = [], [], []
        for length in order["length"].tolist():
            at = bisect_left(free, (length, -1))
            if at < len(free):
                room, which = free.pop(at)
            else:
                room, which = window, len(fills)
                fills.append(0)
            sequence.append((1 << 62) + (int(key[0]) << 32) + which)
            offset.append(fills[which])
            fills[which] += length
            if room > length:
                insort(free, (room - length, which))
        return order.assign(sequence_id=sequence, offset=offset)[columns]

    merged = placed.where("part is not null").groupBy((F.col("part") / fan).cast("bigint").alias("g")).applyInPandas(merge, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in columns))
    return placed.where("part is null").select(*columns).unionByName(merged)
