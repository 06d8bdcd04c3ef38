"""Whitening of embeddings from an exact covariance: digit-slice products.

Entries become integers ``x = floor(256 * c)``. The fit list is each distinct vector once, n vectors with sums S. Centred rows
``y = n * x - S`` are integers too; they are split into small signed limbs, so that every float64 product of two limbs over a
block of rows stays below 2 ** 53 and BLAS gives it exactly. Products of equal weight are added as integers, per task, then
matrix row by matrix row in a second step, and recombined as big integers: the covariance has no rounding at all before it is
turned into doubles for the eigendecomposition, which is the only thing the driver does (dimension squared, whatever the rows).

Defined results: a null vector, one with null or non-finite entries or none at all takes no part, nor does one whose length is
not the most frequent (of equally frequent ones the greatest); a zero vector does. Repeated rows and ids each get their rows; of
repeated vectors the fit list has one. An empty table gives no rows. A component without variance (up to rounding) is not
whitened: ``whitened`` is null, ``identity_error`` is over the others, null if there are none. ``deviation`` is null where it
exceeds a long. Entries beyond a long's range are taken at its end. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Bits of a limb and rows of a block: LIMB + LIMB + log2(BLOCK) is 52 at most, so float64 sums of products are exact.
LIMB, BLOCK = 20, 4096
SCALE = 256


def _valid(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    v = F.col(f"`{column}`")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    usable = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    usual = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    kept = usable.where(F.size(v) == (usual[0]["d"] if usual else 0))
    return kept.select(F.col("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + 0).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``: int64 where it surely fits, else Python integers."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums.tolist()), default=0)
    if most < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Limbs of ``LIMB`` bits as float64, lowest first: ``y == sum(limb[k] << (LIMB * k))``. The last one carries the sign."""
    found, half = [], 1 << (LIMB - 1)
    while not len(found) or (y != 0).any():
        low = ((y + half) & ((1 << LIMB) - 1)) - half  # from -half to half - 1
        found.append(low.astype(float))
        y = (y - low) >> LIMB
    return found


def sliced_products(y: np.ndarray) -> dict[int, np.ndarray]:
    """``y.T @ y`` by weight: the sum of ``found[k] << (LIMB * k)`` is exact. Only half of the mixed products is computed."""
    parts, found = limbs(y), {}
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            product = (a.T @ parts[j]).astype(np.int64)
            found[i + j] = found.get(i + j, 0) + (product if i == j else product + product.T)
    return found


def totals(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums of each dimension, added in halves that no long overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            k = pa.array(np.arange(x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([k, pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0)), pa.array(np.full(x.shape[1], len(x)))], names=["k", "high", "low", "n"])

    parts = distinct.mapInArrow(run, "k int, high bigint, low bigint, n bigint").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
    found = parts.orderBy("k").collect()  # one row a dimension
    return found[0]["n"] if found else 0, np.array([(r["high"] << 32) + r["low"] for r in found], object)


def gram(distinct: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """``sum of y.T @ y`` over the fit list as exact Python integers."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, (_, x) in enumerate(_blocks(batches)):
            for weight, product in sliced_products(centred(x, n, sums)).items():
                total[weight] = total.get(weight, 0) + product
            if k % 256 == 255:  # a sum of so many blocks is below 2 ** 63 still
                yield from pieces(total)
                total = {}
        yield from pieces(total)

    def pieces(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for weight, product in total.items():
            flat = pa.array(product.ravel(), pa.int64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, weight, np.int32)), pa.array(np.arange(d, dtype=np.int32)), rows], names=["weight", "line", "v"])

    def merge(pieces_: pa.Table) -> pa.Table:
        weight, line = pieces_.column("weight")[0], pieces_.column("line")[0]
        whole = _matrix(pieces_.column("v").combine_chunks()).astype(object).sum(0)
        return pa.table({"weight": [weight.as_py()], "line": [line.as_py()], "v": [[str(v) for v in whole]]}, schema=pa.schema([("weight", pa.int32()), ("line", pa.int32()), ("v", pa.list_(pa.string()))]))

    parts = distinct.mapInArrow(run, "weight int, line int, v array<bigint>").groupBy("weight", "line").applyInArrow(merge, "weight int, line int, v array<string>")
    whole = np.zeros((d, d), object)
    for r in parts.toLocalIterator():  # d lines for each weight
        whole[r["line"]] += np.array([int(v) << (LIMB * r["weight"]) for v in r["v"]], object)
    return whole


@dataclass
class Fit:
    """What whitening needs: size and sums of the fit list, components (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of the rows of ``x`` on the components; NaN where a component has no variance."""
        y = (centred(x, self.n, self.sums) / self.n).astype(float)
        ok = self.values > self.trace * 1e-14
        return np.where(ok, y @ self.vectors / np.sqrt(np.where(ok, self.values, 1)), np.nan)


def fit(distinct: DataFrame, components: int) -> Fit | None:
    """Eigenvectors of the exact covariance of ``distinct`` (column ``x``); null if there is no row."""
    n, sums = totals(distinct)
    if not n:
        return None
    whole = gram(distinct, n, sums)
    unit = int(max(1, max(abs(v) for v in whole.diagonal())))
    # scaled to 1 by an exact division of integers, so that nothing overflows a double
    values, vectors = np.linalg.eigh(np.array([[v / unit for v in line] for line in whole], float))
    order = np.argsort(-values, kind="stable")[:components]
    scale = unit / n**3
    return Fit(n, sums, np.maximum(values[order], 0) * scale, vectors[:, order], sum(whole.diagonal()) / n**3)


def identity_error(distinct: DataFrame, model: Fit) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the rows themselves."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches):
            w = shared.value.whiten(x)
            m, here = len(w), w.mean(0)
            gap = here - mean
            spread += (w - here).T @ (w - here) + np.outer(gap, gap) * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])

    n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
    for r in distinct.mapInArrow(run, "n bigint, mean array<double>, spread array<double>").toLocalIterator():  # a few numbers a task
        m, gap = r["n"], np.array(r["mean"]) - mean
        spread += np.array(r["spread"]).reshape(k, k) + np.outer(gap, gap) * (n * m / (n + m))
        mean, n = mean + gap * (m / (n + m)), n + m
    (ok,) = np.nonzero(np.isfinite(spread.diagonal()))
    return float(np.abs(spread[np.ix_(ok, ok)] / n - np.eye(len(ok))).max()) if len(ok) else None


def whiten(rows: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component, from 1."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = _valid(rows, column)
    distinct = keep(found.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for part, x in _blocks(batches):
            y = centred(x, m.n, m.sums)
            if y.dtype != object and np.abs(y).max(initial=0) < (1 << 31) / max(1, len(m.sums)) ** 0.5:
                far = (y * y).sum(1).tolist()
            else:
                far = [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(1)]
            w = m.whiten(x)
            many = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, m.n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(m.values / m.trace if m.trace else np.zeros(k), many)),
                    pa.array([error] * (many * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return found.mapInArrow(run, schema)
