"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` bits share a variant within half the radius of both, so every distinct fingerprint emits all
its variants within half the radius, variants are shuffled, and whoever meets on one is linked. A bucket of a variant holds
only fingerprints within half the radius of it: its size is bounded by the ball's (65 for radius 2), whatever the data, and
each is linked with the bucket's smallest only. Copies were folded into one fingerprint before, and count as one.

Defined results: null and empty texts and texts without a word have fingerprint zero and are linked like others; texts under
the shingle length give one shingle; ``component_id`` is null only where every document of a component has a null id.
Repeated rows each get their row, texts of any length are taken whole, an empty table gives no rows. Extra columns may have any name; results named like a column asked for are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, schema_with, slices, utf8, whole_row
from .components import components

BITS, SEED = 64, 42
#: A fingerprint of more than one in this many rows is joined by broadcast.
HOT = 1000
#: Shingles whose bits are unpacked at a time, for texts of any length.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 of each ``words``-word shingle; repeats count."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    begins = [0, *accumulate(len(p) + 1 for p in parts)]
    hasher, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    total = len(parts) - words + 1
    for at in range(0, total, BLOCK):
        end = min(at + BLOCK, total)
        hashes = np.fromiter((hasher(joined[i : j - 1], SEED) for i, j in zip(begins[at:end], begins[at + words : end + words])), np.uint64, end - at)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, columns: list[str], words: int = 3) -> DataFrame:
    """``columns`` of the documents and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = pa.array([_signed(fingerprint(x, words)) for x in part.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*part.schema.names[:-1], "fp"])

    kept = docs.select(*columns, utf8().alias("_text"))
    return arrow_pass(kept, run, schema_with(kept, "fp bigint", "_text"))


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v``: links between distinct fingerprints that keep every component of those within ``radius`` (even) bits.

    Members of a bucket are within twice half the radius of each other, so linking each with the smallest loses nothing;
    the distance is verified all the same.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.lit(_signed(m)) for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.select(F.col("fp").alias("u"), F.expr("min(fp) OVER (PARTITION BY variant)").alias("v")).where("u <> v")
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``columns`` (``doc_id`` among them), ``fp``, ``root`` and ``component_id``.

    ``root`` is the component's smallest fingerprint, which tells components apart even where documents share an id.
    """
    marked = cut(with_fingerprints(docs, columns or ["doc_id"], words))
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    total = firsts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    roots = components(links(firsts.select("fp"), radius))
    labelled = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(labelled.join(labels, "root").select("fp", "root", "component_id", (F.col("rows") * HOT > total).alias("hot")))
    # One fingerprint may be that of a third of all rows (texts without a word share one): such are fewer than HOT, and broadcast.
    hot, cold = F.broadcast(named.where("hot").drop("hot")), named.where("not hot").drop("hot")
    return marked.join(hot, "fp").unionByName(marked.join(hot, "fp", "left_anti").join(cold, "fp"))


def one_row(docs: DataFrame, key: str = "_hash") -> tuple[DataFrame, list[str]]:
    """Documents as ``_row`` behind the keys they are chosen by, wholly equal ones once, and these keys.

    Equal rows are folded in each task before they are moved, so that repeated rows do not meet in number.
    """
    keys = ["_id", "_none", key]
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias(key), whole_row(docs).alias("_row"))
    return rows.dropDuplicates(keys), keys


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id's (null last), then the smallest text hash.

    Texts move once, to meet the list of winners; which of the rows of equal id and text stays does not matter.
    """
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    found = near_duplicates(slim, ["doc_id", "_hash"], words, radius)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("_hash").alias("_hash"))).alias("w"))
    winners = best.select(F.coalesce(F.col("w.doc_id"), F.lit(0)).alias("_id"), F.col("w.n").alias("_none"), F.col("w._hash").alias("_hash"))
    rows, keys = one_row(docs)
    return rows.join(winners, keys, "left_semi").select("_row.*")
