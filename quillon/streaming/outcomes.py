"""What became of pastes, as state: the newest few of each user in a ring, and the newest keys of all."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillon.operators.relational import last_by_key

from .profiles import STATE_STORE, Expiry

class _Ring(StatefulProcessor):
    """The newest ``n`` outcomes of a key; a timer empties the ring after a long silence. State is one value."""

    def __init__(self, n: int, keep_ms: int) -> None:
        self.n, self.keep_ms = n, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = Expiry(handle, self.keep_ms)
        self.ring = handle.getValueState("ring", "ats array<bigint>, ids array<bigint>, whats array<string>, ends bigint")

    def _newest(self, rows: set) -> list[tuple]:
        return sorted(rows, key=lambda r: (*r[:2], r[2] or ""), reverse=True)[: self.n]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.ring.get()
        held = set() if old is None else set(zip(*old[:3]))
        for row in rows:
            held.add((row["at"], row["id"], row["what"]))
            if len(held) > 100 + 2 * self.n:  # no more than n can stay
                held = set(self._newest(held))
        ring = self._newest(held)
        ends = self.expiry.seen(ring[0][0], timerValues, old is not None)
        self.ring.update((*map(list, zip(*ring)), ends))
        yield self._row(key, ring)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.ring.get()
        if self.expiry.over(old[3], timerValues):
            self.ring.clear()
            yield self._row(key, list(zip(*old[:3])), gone=True)

    def _row(self, key, held, gone: bool = False) -> Row:
        ring = [] if gone else [{"at": a, "id": i, "what": w} for a, i, w in held]
        return Row(key=key[0], at=held[0][0], id=held[0][1], ring=ring, gone=gone)

    def close(self) -> None:
        pass


def ring_stream(outcomes: DataFrame, n: int = 5, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """``key, at, id, ring, gone``: the ``n`` newest outcomes of each key after every batch that has some, in update mode.

    ``outcomes`` have ``key`` (bigint), ``ts`` (timestamp), ``id`` (tells those of one time apart) and ``what``. A row that comes
    again stays one; the ring does not depend on how rows are dealt out to batches.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = outcomes.withWatermark("ts", late).select("key", F.col("ts").alias("_time"), F.unix_micros("ts").alias("at"), F.col("id").cast("bigint").alias("id"), "what")
    return rows.groupBy("key").transformWithState(_Ring(n, keep_days * 86_400_000), "key bigint, at bigint, id bigint, ring array<struct<at: bigint, id: bigint, what: string>>, gone boolean", "Update", "EventTime")


def newest_keys(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What ``follow_newest`` holds after its last batch, or before batch ``before``."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        return None
    last = (found if before is None else found.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]
    return None if last is None else found.where(F.col("batch") == last).drop("batch")


def follow_newest(outcomes: DataFrame, path: str, checkpoint: str, key: str, at: str, tie: str, n: int = 20) -> StreamingQuery:
    """The last outcome of each of the ``n`` newest keys, kept up batch by batch: only those held and the batch are looked at.

    That is enough: a key that is no more among the newest comes back with its next outcome alone. A batch that comes again
    starts from what was held before it, and writes the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        held = newest_keys(batch.sparkSession, path, number)
        rows = batch if held is None else held.select(*batch.columns).unionByName(batch)
        last_by_key(rows, key, at, tie, n).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")  # n rows

    return outcomes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
