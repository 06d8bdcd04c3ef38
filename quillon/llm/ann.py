"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and residual codebooks are trained on a bounded sample; every valid row is assigned to its nearest centroid's
list and coded: the length of its residual, and the residual's direction by products, so that rows of any scale are told apart.
A query probes the lists of its nearest centroids, ranks their rows by asymmetric distance tables and measures the best again on
the original vectors. How many lists and how many rows that takes is read off the true neighbours, among all rows, of some of
the queries themselves. Lists go in groups, which are cut into chunks and their queries into blocks, both of
bounded size, so a list that holds a third of all rows, or draws a third of all queries, is many small tasks.

Defined results: vectors that are null, of a length other than the most frequent one, all zero, or hold a null or non-finite
component take no part, nor do rows without a vec_id; rows that repeat a vec_id are each candidates, but not for a query of
that id; of a repeated query id the smallest vector asks. Only ``vec_id`` and ``embedding`` are read, besides what the query
condition reads, so other columns may have any name; the condition sees ``vec_id`` and ``v``. Ties go to the smaller vec_id. With fewer candidates than asked for, all are returned: probing goes on until enough rows are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep

#: Expected rows of the training sample, and the most that is ever taken to the driver.
SAMPLE, MOST_SAMPLE = 12_000, 24_000
#: Most lists; parts of a vector; least rows measured exactly per query.
LISTS, PARTS, RERANKED = 1024, 16, 256
#: Queries whose true neighbours among all rows are found by brute force, the share of those that the probed lists must hold,
#: and the share that must be among the rows measured exactly.
ASKED, IN_LISTS, TARGET = 256, 0.99, 0.98
#: Rows of a chunk of a group of lists, queries of a block, and least groups; a query gets its best rows of each group.
CHUNK, QUERY_BLOCK, GROUPS = 20_000, 10_000, 16
SEED = 7


def valid(rows: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, v`` (doubles) of the rows that take part, and their length."""
    v = F.col("embedding")
    fine = rows.where(v.isNotNull()).select("vec_id", v.cast("array<double>").alias("v"))
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    modal = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = modal["d"] if modal else 0
    return fine.where((F.size("v") == dim) & F.col("vec_id").isNotNull()), dim


def _near(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1)[None, :] - 2 * (x @ centers.T)).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's iterations from distinct random rows; empty centres move to random rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        of = _near(x, centers)
        sizes = np.bincount(of, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], distinct[rng.choice(len(distinct), k)])
    return centers


class Index:
    """Trained centroids and codebooks."""

    def __init__(self, x: np.ndarray, rows: int):
        self.centers = kmeans(x, min(LISTS, max(1, round(rows**0.5))))
        self.parts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        ways, _ = self._residuals(x, _near(x, self.centers))
        self.books = [kmeans(ways[:, p], 256, seed=SEED + i) for i, p in enumerate(self.parts)]

    def _residuals(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and lengths of residuals; a row on its centroid has no direction."""
        rest = x - self.centers[of]
        lengths = np.sqrt((rest * rest).sum(1))
        return rest / np.where(lengths > 0, lengths, 1)[:, None], lengths

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = _near(x, self.centers)
        ways, lengths = self._residuals(x, of)
        return of, lengths, np.stack([_near(ways[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)

    def decode(self, of: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centers[of] + lengths[:, None] * np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)[:, np.argsort(np.concatenate(self.parts))]

    def fixed(self, of: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a coded row (``codes`` by part) adds to its distance from any query."""
        away = self.centers - self.centers.mean(0)
        own = sum((b * b).sum(1)[code] * lengths + 2 * (away[:, p] @ b.T)[of, code] for p, b, code in zip(self.parts, self.books, codes))
        return lengths * own

    def gaps(self, q: np.ndarray, of: np.ndarray, lengths: np.ndarray, codes: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Squared distances from a query to coded rows, by tables of each part's products."""
        rest, along = q - self.centers.mean(0), np.zeros(len(of))
        for p, b, code in zip(self.parts, self.books, codes):
            along += (b @ rest[p])[code]
        return ((q - self.centers) ** 2).sum(1)[of] + fixed - 2 * lengths * along


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def train(rows: DataFrame, dim: int, total: int) -> Index:
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.where(share * total < SAMPLE).limit(MOST_SAMPLE).select("v").toPandas()["v"]
    x = np.array(taken.tolist(), float).reshape(-1, dim)
    if not len(x):
        x = np.array([r[0] for r in rows.select("v").limit(SAMPLE).collect()], float).reshape(-1, dim)
    return Index(x[np.lexsort(x.T[::-1])], total)


def _coded(rows: DataFrame, index: Index, dim: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, lengths, codes = shared.value.code(_matrix(batch.column("v"), dim))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(of.astype(np.int32)), pa.array(lengths), packed], names=["vec_id", "v", "list", "length", "code"])

    return rows.mapInArrow(run, "vec_id bigint, v array<double>, list int, length double, code binary").withColumn("row", F.monotonically_increasing_id())


def _nearest(rows: DataFrame, asked: list[tuple[int, list[float]]], dim: int, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score, v``: the true neighbours of queries at hand; each task hands on its own ``k`` best."""
    q_ids = np.array([a for a, _ in asked], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, np.array([v for _, v in asked], float).reshape(len(asked), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)))] * len(q_ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)
            for at, (query_id, v) in enumerate(zip(q_ids, q)):
                d = np.sqrt(((x - v) ** 2).sum(1))
                held = best[at][1]
                near = np.flatnonzero((ids != query_id) & ((d <= held[-1]) if len(held) == k else True))
                if len(near) > k:
                    near = near[d[near] <= np.partition(d[near], k - 1)[k - 1]]
                if len(near):
                    found = [np.concatenate(pair) for pair in zip(best[at], (ids[near], d[near], x[near]))]
                    order = np.lexsort((found[0], found[1]))[:k]
                    best[at] = tuple(f[order] for f in found)
        for query_id, (ids, d, x) in zip(q_ids, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query_id)), pa.array(ids), pa.array(d), pa.array(list(x), pa.list_(pa.float64()))], names=["query_id", "vec_id", "score", "v"])

    near = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double, v array<double>")
    ranked = near.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "v")


def _calibrated(coded: DataFrame, queries: DataFrame, index: Index, dim: int, k: int) -> tuple[int, int]:
    """Lists to probe and rows to measure, so that true neighbours of up to ``ASKED`` queries are among them.

    Two passes over all rows: one finds those neighbours by brute force, one counts the rows that codes put before each.
    """
    asked = sorted((r["vec_id"], r["v"]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).collect())
    if not asked:
        return 1, RERANKED
    true = _nearest(coded, asked, dim, k).collect()  # ASKED * k rows at most
    if not true:
        return 1, RERANKED
    at = {query_id: i for i, (query_id, _) in enumerate(asked)}
    q, of_query = np.array([v for _, v in asked], float), np.array([at[r["query_id"]] for r in true])
    ids, x = np.array([r["vec_id"] for r in true], np.int64), np.array([r["v"] for r in true], float)
    order = np.argsort(((q[:, None] - index.centers[None]) ** 2).sum(2) if len(index.centers) * q.size < 1 << 24 else (index.centers**2).sum(1)[None] - 2 * (q @ index.centers.T), axis=1, kind="stable")
    ranks = np.argsort(order, axis=1)
    of, lengths, codes = index.code(x)
    needed = ranks[of_query, of]
    probes = int(np.sort(needed)[int(np.ceil(IN_LISTS * len(true))) - 1]) + 1
    limits = ((index.decode(of, lengths, codes) - q[of_query]) ** 2).sum(1)
    shared = coded.sparkSession.sparkContext.broadcast((index, q, [a for a, _ in asked], ranks < probes, of_query, ids, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q, q_ids, probed, of_query, ids, limits = shared.value
        before = np.zeros(len(ids), np.int64)
        pairs = [np.flatnonzero(of_query == i) for i in range(len(q))]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, of = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
            x = index.decode(of, batch.column("length").to_numpy(), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(own), -1))
            for i, mine in enumerate(pairs):
                met = np.flatnonzero(probed[i][of] & (own != q_ids[i]))
                gaps = ((x[met] - q[i]) ** 2).sum(1)
                for t in mine:
                    before[t] += ((gaps < limits[t]) | (gaps == limits[t]) & (own[met] < ids[t])).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(before)], names=["pair", "before"])

    counted = coded.select("vec_id", "list", "length", "code").mapInArrow(run, "pair int, before bigint").groupBy("pair").agg(F.sum("before").alias("before")).collect()
    before = np.zeros(len(true), np.int64)
    for r in counted:
        before[r["pair"]] = r["before"]
    met = np.where(needed < probes, before, np.iinfo(np.int64).max)
    return probes, max(RERANKED, int(np.sort(met)[int(np.ceil(TARGET * len(true))) - 1]) + 1)


def _probes(queries: DataFrame, index: Index, sizes: np.ndarray, k: int, probes: int, groups: int, dim: int) -> DataFrame:
    """The lists that each query probes, a row for each group that holds some."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centers, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, sizes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column("v"), dim)
                order = np.argsort((centers * centers).sum(1)[None] - 2 * (q @ centers.T), axis=1, kind="stable")
                met = np.cumsum(sizes[order], 1)
                # lists until both the number of probes and enough rows are met
                need = np.maximum(probes, (met < 2 * k + 1).sum(1) + 1)
                of, group, lists = [], [], []
                for i, (o, n) in enumerate(zip(order, need)):
                    take = np.sort(o[:n][sizes[o[:n]] > 0])
                    for g in np.unique(take % groups):
                        of.append(i), group.append(g), lists.append(take[take % groups == g])
                i = pa.array(of, pa.int64())
                arrays = [part.column("vec_id").take(i), part.column("v").take(i), pa.array(group, pa.int32()), pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "q", "group", "lists"])

    return queries.mapInArrow(run, "query_id bigint, q array<double>, group int, lists array<int>")


def _search(index_shared, dim: int, reranked: int):
    """The rows of a chunk nearest to each query of a block by the distance tables; only codes and ids are at hand."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("rough", pa.float64())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        index = index_shared.value
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, rows, lengths, of = (left.column(c).to_numpy() for c in ("vec_id", "row", "length", "list"))
        order = np.lexsort((rows, ids))
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.copy()
        ids, rows, lengths, of = ids[order], rows[order], lengths[order], of[order]
        fixed = index.fixed(of, lengths, codes)
        found: list[pa.Table] = []
        for query_id, q, lists in zip(right.column("query_id").to_pylist(), _matrix(right.column("q"), dim), right.column("lists").to_pylist()):
            probed = np.zeros(len(index.centers), bool)
            probed[lists] = True
            met = np.flatnonzero(probed[of] & (ids != query_id))
            rough = index.gaps(q, of[met], lengths[met], codes[:, met], fixed[met])
            best = np.arange(len(met))
            if len(met) > reranked:
                edge = np.partition(rough, reranked - 1)[reranked - 1]
                best = np.flatnonzero(rough < edge)
                best = np.concatenate([best, np.flatnonzero(rough == edge)[: reranked - len(best)]])  # ties: smaller ids
            found.append(pa.table([pa.array(np.full(len(best), query_id)), pa.array(ids[met[best]]), pa.array(rows[met[best]]), pa.array(rough[best])], schema=schema))
        return pa.concat_tables(found)

    return run


def search(rows: DataFrame, is_query: Column, k: int = 10, probes: int | None = None, reranked: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each query row.

    ``probes`` and ``reranked`` are calibrated on queries unless given. Chunks and blocks meet with codes alone; vectors are fetched, once
    each, for the ``reranked`` rows that are nearest by codes over all probed lists of a query.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors, dim = valid(rows)
    total = vectors.count() if dim else 0
    if total == 0:
        return empty
    index = train(vectors, dim, total)
    coded = keep(_coded(vectors, index, dim), "ivfpq")
    found = coded.groupBy("list").count().collect()  # LISTS rows at most
    sizes = np.zeros(len(index.centers), np.int64)
    for r in found:
        sizes[r["list"]] = r["count"]
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    if probes is None or reranked is None:
        lists, measured = _calibrated(coded, queries, index, dim, k)
        probes, reranked = probes or lists, reranked or measured
    groups = min(len(sizes), max(GROUPS, -(-total // CHUNK)))
    asked = cut(_probes(queries, index, sizes, k, probes, groups, dim))
    drawn = {r["group"]: r["count"] for r in asked.groupBy("group").count().collect()}
    held = [int(sizes[g::groups].sum()) for g in range(groups)]
    chunks = F.array(*[F.lit(max(1, -(-n // CHUNK))) for n in held])
    blocks = F.array(*[F.lit(max(1, -(-drawn.get(g, 0) // QUERY_BLOCK))) for g in range(groups)])
    salt = lambda *c: F.xxhash64(*c)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = coded.select("row", "vec_id", "list", "length", "code", (F.col("list") % groups).alias("group"))
    left = left.where(F.col("group").isin(list(drawn)) if len(drawn) < groups else F.lit(True))
    left = left.withColumn("chunk", F.pmod(salt("row"), chunks[F.col("group")]).cast("int")).withColumn("block", each(blocks[F.col("group")]))
    right = asked.withColumn("block", F.pmod(salt("query_id"), blocks[F.col("group")]).cast("int")).withColumn("chunk", each(chunks[F.col("group")]))
    keys = ["group", "chunk", "block"]
    run = _search(spark.sparkContext.broadcast(index), dim, reranked)
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, row bigint, rough double")
    near = near.withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rough, vec_id, row)")).where(F.col("place") <= reranked)
    fetched = near.select("query_id", "row").join(coded.select("row", "vec_id", "v"), "row").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    gaps = F.zip_with("v", "q", lambda a, b: (a - b) * (a - b))
    scored = fetched.select("query_id", "vec_id", "row", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)).alias("score"))
    ranked = scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id, row)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """Brute force for measuring recall: the queries against all rows, which stay where they are."""
    vectors, dim = valid(rows)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    return _nearest(vectors, sorted((r["vec_id"], r["v"]) for r in queries.collect()), dim, k).drop("v")
