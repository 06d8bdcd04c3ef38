"""Keyed state kept in files: the newest row of each key, in hash buckets with deltas, versions and a feed of changes.

A version writes the batch's newest row of each key below the buckets that the batch touches, and one small list of these
buckets, which commits it. A bucket with many deltas is merged into a base, alone; other buckets' files stay as they are. A
reader takes of each bucket the last base and the deltas behind it. Rows marked as gone take their key out. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

LISTED = "bucket int, base boolean, version bigint"


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; one aggregation that combines map-side. Of equal ones the greatest in all columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*keys, "_r.*")


def upsert(store: DataFrame | None, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same on tables, without files."""
    return newest(rows if store is None else store.unionByName(rows), keys, order)


@dataclass(frozen=True)
class Store:
    """A store of rows of ``schema`` by ``keys``; the newest by ``order`` counts, and of these the one of the last version.

    Without an ``order`` the last writer wins. ``buckets`` and what is below ``path`` belong together.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = 64
    #: Deltas of a bucket that a reader merges at most; a write that finds more makes a base of them.
    most_deltas: int = 8

    @property
    def _held(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_gone", BooleanType()), StructField("_version", LongType())])

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest(rows, list(self.keys), [*self.order, "_version"]).select(*self._held.names)

    def log(self) -> list[tuple[int, bool, int]]:
        """``bucket, base, version`` of every part that was committed; its size is that of the log, not of the data."""
        try:
            return [tuple(r) for r in self.spark.read.schema(LISTED).parquet(f"{self.path}/log").select("bucket", "base", "version").collect()]
        except AnalysisException:  # nothing was written yet
            return []

    def version(self) -> int:
        """The last version, -1 before the first."""
        return max((v for _, _, v in self.log()), default=-1)

    def _files(self, version: int, buckets: set[int] | None = None) -> dict[int, list[str]]:
        """The parts that make up each bucket at a version."""
        own: dict[int, list[tuple[int, bool]]] = {}
        for bucket, base, v in self.log():
            if bucket >= 0 and v <= version and (buckets is None or bucket in buckets):
                own.setdefault(bucket, []).append((v, base))
        found = {}
        for bucket, parts in own.items():
            last = max((v for v, base in parts if base), default=-1)
            found[bucket] = [self._part(v, base, bucket) for v, base in sorted(parts) if (v == last if base else v > last)]
        return found

    def _part(self, version: int, base: bool, bucket: int) -> str:
        return f"{self.path}/{'bases' if base else 'deltas'}/version={version}/bucket={bucket}"

    def _rows(self, files: dict[int, list[str]]) -> DataFrame:
        paths = [p for parts in files.values() for p in parts]
        rows = self.spark.read.schema(self._held).parquet(*paths) if paths else self.spark.createDataFrame([], self._held)
        return self._newest(rows)

    def read(self, version: int | None = None) -> DataFrame:
        """The store's rows at a version (the last one unless given)."""
        return self._rows(self._files(self.version() if version is None else version)).where("NOT _gone").select(*self.schema.names)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, version: int | None = None, gone: str | None = None) -> int:
        """Take in ``rows``; those for which the expression ``gone`` holds take their key out. Returns the version.

        A version that is in the log is not written again, so a repeated batch changes nothing; one that was left half
        written is overwritten.
        """
        log = self.log()
        last = max((v for _, _, v in log), default=-1)
        number = last + 1 if version is None else version
        if number <= last:
            return number
        marked = rows.select(*self.schema.names, F.coalesce(F.expr(gone or "false"), F.lit(False)).alias("_gone"), F.lit(number).cast("bigint").alias("_version"))
        deltas = self._newest(marked).withColumn("bucket", self._bucket())
        # a bucket's rows are one task's: each touched bucket gets one file
        deltas.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/version={number}")
        touched = self._touched(number)
        deep = {b for b in touched if self._depth(log, b) + 1 > self.most_deltas}
        if deep:
            files = {b: [*self._parts(log, b), self._part(number, False, b)] for b in deep}
            merged = self._rows(files).withColumn("bucket", self._bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bases/version={number}")
        listed = [(b, False, number) for b in touched] + [(b, True, number) for b in deep] or [(-1, False, number)]
        self.spark.createDataFrame(listed, LISTED).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/at={number}")
        return number

    def _touched(self, number: int) -> list[int]:
        try:
            found = self.spark.read.parquet(f"{self.path}/deltas/version={number}")
        except AnalysisException:  # an empty batch wrote no file
            return []
        return sorted(r["bucket"] for r in found.select("bucket").distinct().collect())  # at most ``buckets``

    def _parts(self, log: list[tuple[int, bool, int]], bucket: int) -> list[str]:
        own = sorted((v, base) for b, base, v in log if b == bucket)
        last = max((v for v, base in own if base), default=-1)
        return [self._part(v, base, bucket) for v, base in own if (v == last if base else v > last)]

    def _depth(self, log: list[tuple[int, bool, int]], bucket: int) -> int:
        return len(self._parts(log, bucket))

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The feed of changed keys between two versions: ``keys``, ``change`` (insert, update, delete), ``before``, ``after``.

        Reads the deltas in between, and of the version before only the buckets that they touch; a key that ends as it began
        is no change.
        """
        until = self.version() if until is None else until
        between = {(b, v) for b, base, v in self.log() if b >= 0 and not base and since < v <= until}
        touched = {b for b, _ in between}
        paths = [self._part(v, False, b) for b, v in sorted(between)]
        keys = (self.spark.read.schema(self._held).parquet(*paths) if paths else self.spark.createDataFrame([], self._held)).select(*self.keys).distinct()

        def side(version: int, name: str) -> DataFrame:
            found = self._rows(self._files(version, touched)).where("NOT _gone")
            return found.select(*[F.col(k).alias(f"{name}_{k}") for k in self.keys], F.struct(*self.schema.names).alias(name))

        before, after = side(since, "before"), side(until, "after")
        for name, rows in (("before", before), ("after", after)):
            on = [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in self.keys]
            keys = keys.join(rows, on, "left").drop(*[f"{name}_{k}" for k in self.keys])
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return keys.where(~F.col("before").eqNullSafe(F.col("after"))).select(*self.keys, kind.alias("change"), "before", "after")

    def follow(self, rows: DataFrame, checkpoint: str, gone: str | None = None, mode: str = "append") -> StreamingQuery:
        """Take in a stream, a version for each batch; batches that come again after a failure are not taken in twice."""

        def take(batch: DataFrame, number: int) -> None:
            self.write(batch, number, gone)

        return rows.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
