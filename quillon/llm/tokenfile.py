"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of whole documents. Blocks of 128 ids store their minimum and each id's offset from it at the width that
a percentile of the offsets needs; larger offsets go to an exception list behind the block. An index of block starts makes
any range of ids readable without the blocks before it, and a directory lists the documents and their lengths.

Layout, little-endian: magic, five unsigned 64-bit counts (ids, blocks, documents, data bytes, block length), then per block
u32 minimum, u8 width, u8 exceptions, u64 start of its data; the data (packed bits, then u8 positions and u32 offsets of the
exceptions); per document i64 id, u8 whether the id is null, u64 number of ids.

Documents are dealt by ranges of their id and each task writes its own files in order, under names that a rerun of the task
repeats, first under a hidden name; only the rows that the tasks return tell where a file's ids begin in the whole.

Defined results: null ids sort first; a null text is empty and leaves the end id only; rows that share an id follow each
other in the order of a hash of their text; texts of any length are taken whole; an empty table gives no file and no row.
Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_pass, cut, shared_path, slices
from .tokens import encoder

MAGIC = b"QPFOR\x00\x01\n"
BLOCK = 128
#: Share of a block's offsets that the chosen width holds.
PERCENTILE = 0.9
#: Ids after which a file is closed, at a document's end (about 4 MB).
FILE_IDS = 1 << 21
#: Blocks that are packed or unpacked together.
AT_A_TIME = 2048
#: Most tasks that read files back.
MOST_TASKS = 20_000
_HEAD = struct.Struct("<8s5Q")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _to_bits(gaps: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of every row of offsets as one little-endian bit string a row; one offset of all rows at a time."""
    columns = gaps.T.astype(np.uint64, order="C") & np.uint64((1 << width) - 1)
    words = np.zeros((BLOCK * width // 64, len(gaps)), np.uint64)
    for i, column in enumerate(columns):
        at, shift = divmod(i * width, 64)
        words[at] |= column << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= column >> np.uint64(64 - shift)
    return words.T.astype("<u8", order="C").view(np.uint8)


def _from_bits(raw: np.ndarray, width: int) -> np.ndarray:
    words = raw.view("<u8").T.astype(np.uint64, order="C")
    columns = np.empty((BLOCK, len(raw)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        value = words[at] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[at + 1] << np.uint64(64 - shift)
        columns[i] = value & mask
    return columns.T


def _runs(which: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of block numbers that stay in a core's cache."""
    for at in range(0, len(which), AT_A_TIME):
        yield which[at : at + AT_A_TIME]


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: float = PERCENTILE) -> bytes:
    """A file's bytes."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    rows = np.zeros((0, BLOCK), np.uint32)
    if n:
        rows = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], ids.dtype)]).astype(np.uint32, copy=False).reshape(blocks, BLOCK)
    least = rows.min(1) if n else np.zeros(0, np.uint32)
    gaps = rows - least[:, None]
    at = int(np.ceil(percentile * BLOCK)) - 1
    width = _bits(np.partition(gaps, at, 1)[:, at])
    outlier = gaps > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    count = outlier.sum(1).astype(np.int64)
    packed = width.astype(np.int64) * (BLOCK // 8)
    size = packed + 5 * count
    starts = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        for which in _runs(np.flatnonzero(width == w)):
            data[starts[which, None] + np.arange(w * BLOCK // 8)] = _to_bits(gaps[which], w)
    block, position = np.nonzero(outlier)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(count) - count)[block]
        at = starts[block] + packed[block]
        data[at + nth] = position
        data[(at + count[block] + 4 * nth)[:, None] + np.arange(4)] = gaps[outlier].astype("<u4").view(np.uint8).reshape(-1, 4)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        _HEAD.pack(MAGIC, n, blocks, len(doc_ids), len(data), BLOCK), least.astype("<u4").tobytes(), width.tobytes(), count.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), data.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes(),
    ]
    return b"".join(parts)


class TokenFile:
    """A file's bytes, read in place."""

    def __init__(self, raw: bytes):
        magic, self.n, blocks, docs, size, length = _HEAD.unpack_from(raw)
        if magic != MAGIC or length != BLOCK:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.least, self.width, self.count, self.starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
        self.data = take("u1", size)
        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, nulls)]
        self.lengths = take("<u8", docs).astype(np.int64)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``begin`` to ``end``; only their blocks are unpacked."""
        end = self.n if end is None else end
        first, last = begin // BLOCK, -(-end // BLOCK)
        if end <= begin:
            return np.zeros(0, np.uint32)
        width, starts = self.width[first:last], self.starts[first:last].astype(np.int64)
        out = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            for which in _runs(np.flatnonzero(width == w)):
                out[which] = _from_bits(self.data[starts[which, None] + np.arange(w * BLOCK // 8)], w)
        count = self.count[first:last].astype(np.int64)
        if total := int(count.sum()):
            block = np.repeat(np.arange(last - first), count)
            nth = np.arange(total) - (np.cumsum(count) - count)[block]
            at = starts[block] + width[block].astype(np.int64) * (BLOCK // 8)
            values = self.data[(at + count[block] + 4 * nth)[:, None] + np.arange(4)]
            out[block, self.data[at + nth]] = np.ascontiguousarray(values).view("<u4").ravel()
        out += self.least[first:last, None]
        return out.ravel()[begin - first * BLOCK : end - first * BLOCK]


def _store(folder: str, name: str, raw: bytes) -> None:
    """Write under a hidden name, then move: readers never see half a file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    hidden = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(hidden) as out:
        out.write(raw)
    store.move(hidden, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents in ascending order of id; the manifest (``part, seq, file, n_ids``), computed and kept.

    ``folder`` must be a URI that all executors can write to.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode_all
        raw, ids, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:08d}-{seq:06d}.pfor"
            _store(folder, name, pack(np.frombuffer(b"".join(raw), "<u4"), ids, lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_ids": [held]}, schema=_MANIFEST)

        for batch in slices(batches, BATCH_ROWS):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in batch.column("text").to_pylist()])):
                found += end
                raw.append(found)
                ids.append(doc_id)
                lengths.append(len(found) // 4)
                held += lengths[-1]
                if held >= FILE_IDS:
                    yield close()
                    raw, ids, lengths, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.xxhash64(F.monotonically_increasing_id()).alias("_spread"))
    # The last key cuts runs of rows equal in id and text into several ranges; which of them comes first does not show.
    ordered = ordered.repartitionByRange("doc_id", "_h", "_spread").sortWithinPartitions("doc_id", "_h", "_spread").drop("_h", "_spread")
    return cut(arrow_pass(ordered, run, "part bigint, seq bigint, file string, n_ids bigint"))


_MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64())])


def with_bases(manifest: DataFrame) -> DataFrame:
    """``file, base``: ids of all files before. Sums run within each part; only one row a part meets in one place."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.expr("sum(n) OVER (ORDER BY part) - n").alias("before"))
    inner = manifest.withColumn("within", F.expr("sum(n_ids) OVER (PARTITION BY part ORDER BY seq) - n_ids"))
    return inner.join(before, "part").select("file", (F.col("before") + F.col("within")).alias("base"))


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files. Only names and bases are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(f"{path}/{name}") as file:
                    found = TokenFile(file.read())
                ids = found.ids().astype("<u4", copy=False)
                ends = np.cumsum(found.lengths)
                begins = ends - found.lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(found.doc_ids, pa.int64()), pa.array(begins + base), pa.array(found.lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # The names are few bytes, which adaptive execution would put into one task: the number of tasks follows the files instead.
    tasks = min(max(manifest.count(), 1), MOST_TASKS)
    return with_bases(manifest).repartition(tasks, "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents below the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    manifest = write(docs, folder, tokenizer, end_id)
    return read(folder, manifest)
