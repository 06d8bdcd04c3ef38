"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by ascending id; a keyed Feistel network over the smallest a x b grid that holds all numbers, walking
cycles until it lands inside, permutes them. Position p of n rows lies in shard ``p mod shards`` at slot ``p div shards``, so
counts differ by one at most, slots have no gaps, and both directions can be computed from the row number, the number of
rows and the seed alone. Texts are not moved: only id, size and checksum travel to be numbered.

Defined results: null ids come first; rows that share an id are ordered by checksum and size; a null text has size 16 and the
checksum of the empty text; texts of any length are taken whole; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8

SHARDS, SEED, ROUNDS = 40, 20240229, 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The splitmix64 finaliser: fixed constants."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed & (2**64 - 1)], np.uint64), 0x9E3779B97F4A7C15 * (r + 1) % 2**64)[0]) for r in range(ROUNDS)]


def _sides(n: int) -> tuple[int, int]:
    """Sides of the grid; it has fewer spare cells than its side is long, so walks are short."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _once(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    """A bijection of [0, a*b): halves of moduli a and b take turns to be shifted by a hash of the other."""
    left, right = x % np.uint64(a), x // np.uint64(a)
    for r, key in enumerate(keys):
        if r % 2:
            right = (right + _mix(left, key) % np.uint64(b)) % np.uint64(b)
        else:
            left = (left + _mix(right, key) % np.uint64(a)) % np.uint64(a)
    return right * np.uint64(a) + left


def _once_back(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    left, right = x % np.uint64(a), x // np.uint64(a)
    for r, key in reversed(list(enumerate(keys))):
        if r % 2:
            right = (right + np.uint64(b) - _mix(left, key) % np.uint64(b)) % np.uint64(b)
        else:
            left = (left + np.uint64(a) - _mix(right, key) % np.uint64(a)) % np.uint64(a)
    return right * np.uint64(a) + left


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    a, b = _sides(n)
    keys = _keys(seed)
    x = step(x, a, b, keys)
    while (out := x >= np.uint64(n)).any():
        x[out] = step(x[out], a, b, keys)
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Positions of row numbers in the shuffle of ``n`` rows."""
    return _walk(_once, rows, n, seed)


def unpermute(positions: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row numbers of positions: what a reader of one shard needs to find its rows."""
    return _walk(_once_back, positions, n, seed)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row``, their place in ``order`` from 0, and how many there are.

    Ranges of the order are sorted apart; a row's number is its place in its range behind the sizes of the ranges before.
    The ranges are computed once, so that both uses see the same. A last key, of where a row was read, cuts runs of equal
    rows into ranges too; which of equal rows comes first does not show.
    """
    rows = rows.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "_spread").drop("_spread")
    ranged = ranged.withColumn("_place", F.monotonically_increasing_id())
    ranged = cut(ranged)
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    bases = cut(sizes.select("_part", "_n", F.expr("sum(_n) OVER (ORDER BY _part) - _n").alias("_base")))  # a row a partition
    total = bases.agg(F.sum("_n")).first()[0] or 0
    joined = ranged.withColumn("_part", part).join(F.broadcast(bases.select("_part", "_base")), "_part")
    return joined.withColumn("row", F.col("_base") + place).drop("_part", "_place", "_base"), total


def position(n: int, seed: int = SEED) -> Column:
    """The shuffle as a column function of ``row``."""

    @F.pandas_udf("bigint")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return run("row")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    slim = docs.select("doc_id", (F.octet_length(utf8()).cast("bigint") + 16).alias("size"), F.crc32(utf8()).alias("text_crc32"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("_p", position(n, seed))
    return placed.select("doc_id", "size", "text_crc32", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))
