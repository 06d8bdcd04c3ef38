"""Learned styles as state: a profile of roles for each document scope, from a stream of samples and of what users do to it.

State is the value of each role with the order of the sample that taught it, and the order of the last reset. What a scope holds
depends on the events alone, not on how they are dealt out to batches: of each role the newest value that is not older than
the last reset. An ``auto`` event adds what it knows, a ``replace`` event holds alone, a ``forget`` event leaves nothing. A scope
that hears nothing for ``keep_days`` of event time is forgotten. Memory is one row and one profile a scope.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import styles

#: Fixed value: what marks a copy out of a document editor, the only copies that teach a style.
SAMPLE_MARKER = "docs-internal-guid"
_DAY_MS = 86_400_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def style_samples(copies: DataFrame) -> DataFrame:
    """``scope, at, html`` of the copies that teach a style: from a known scope, with the editor's mark. Any stream or table."""
    return copies.where(F.col("scope").isNotNull() & F.contains("html", F.lit(SAMPLE_MARKER))).select("scope", "at", "html")


def taught(samples: DataFrame, action: str = "auto") -> DataFrame:
    """What a batch of samples teaches, as events for ``profile_stream``: roles as JSON. ``replace`` is for samples that users chose."""
    micros = samples.withColumn("at", F.unix_micros("at"))
    roles = [F.when(F.col(r).isNotNull(), F.to_json(r)).alias(r) for r in styles.ROLES]
    return styles.learn(micros).select("scope", F.timestamp_micros("at").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit(action).alias("action"), *roles)


class Expiry:
    """When a key's state ends. A key has one timer, which is moved only when it fires: not at every batch that it hears of."""

    def __init__(self, handle: StatefulProcessorHandle, keep_ms: int) -> None:
        self.handle, self.keep_ms = handle, keep_ms

    def seen(self, newest: int, timerValues, timed: bool) -> int:
        """The end after an event at ``newest`` (microseconds); a key without a timer gets one."""
        end = max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        if not timed:
            self.handle.registerTimer(end)
        return end

    def over(self, end: int, timerValues) -> bool:
        """Whether the end is reached where a timer fires; else the timer is set to it."""
        if end <= timerValues.getCurrentWatermarkInMs():
            return True
        self.handle.registerTimer(end)
        return False


_NEVER = -(1 << 62)


class _Profiles(StatefulProcessor):
    """State is one value, read once and written once a batch: each call to the state's store is a round trip."""

    def __init__(self, roles: tuple[str, ...], keep_ms: int) -> None:
        self.names, self.keep_ms = roles, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = Expiry(handle, self.keep_ms)
        taught = "".join(f", at{i} bigint, seq{i} bigint, value{i} string" for i in range(len(self.names)))
        self.held = handle.getValueState("held", f"at bigint, seq bigint, ends bigint, reset_at bigint, reset_seq bigint{taught}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.held.get()
        newest, reset = ((_NEVER, 0), (_NEVER, 0)) if old is None else (old[:2], old[3:5])
        held = [None] * len(self.names) if old is None else [None if old[k] is None else old[k : k + 3] for k in range(5, len(old), 3)]
        for row in rows:
            order = (row["at"], row["seq"])
            newest = max(newest, order)
            if row["action"] != "auto":
                reset = max(reset, order)
            for i, name in enumerate(self.names):
                if (value := row[name]) is not None and (held[i] is None or (*order, value) > held[i]):
                    held[i] = (*order, value)
        held = [None if x is None or x[:2] < reset else x for x in held]
        ends = self.expiry.seen(newest[0], timerValues, old is not None)
        self.held.update((*newest, ends, *reset, *[v for x in held for v in (x or (None, None, None))]))
        yield self._row(key, newest, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.held.get()
        if self.expiry.over(old[2], timerValues):
            self.held.clear()
            yield self._row(key, old[:2], [None] * len(self.names))

    def _row(self, key, newest, held) -> Row:
        return Row(**{"scope": key[0], "at": newest[0], "seq": newest[1], **{r: x and x[2] for r, x in zip(self.names, held)}, "gone": not any(held)})

    def close(self) -> None:
        pass


def profile_stream(events: DataFrame, roles: tuple[str, ...] = ("heading", "entry", "bullet", "body"), late: str = "1 hour", keep_days: int = 180) -> DataFrame:
    """``scope, at, seq``, the roles and ``gone`` after every batch that changes a scope, in update mode.

    ``events`` have ``scope, at`` (timestamp), ``seq`` (tells events of one time apart), ``action`` (auto, replace, forget) and a
    string for each role or null. ``at`` comes back in microseconds.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the only one with maps and timers
    rows = events.withWatermark("at", late).select("scope", F.unix_micros("at").alias("at"), F.col("at").alias("_time"), F.col("seq").cast("bigint").alias("seq"), "action", *roles)
    schema = ", ".join(["scope string, at bigint, seq bigint", *[f"`{r}` string" for r in roles], "gone boolean"])
    return rows.groupBy("scope").transformWithState(_Profiles(roles, keep_days * _DAY_MS), schema, "Update", "EventTime")


def profiles_of(events: DataFrame, roles: tuple[str, ...] = ("heading", "entry", "bullet", "body")) -> DataFrame:
    """The same over a table: ``scope, at, seq`` and the roles of the scopes that hold any. One grouping, then another for resets."""
    order = F.struct(F.unix_micros("at").alias("at"), F.col("seq").cast("bigint").alias("seq"))
    rows = events.select("scope", order.alias("o"), "action", *roles)
    resets = rows.where("action <> 'auto'").groupBy("scope").agg(F.max("o").alias("r"))
    live = rows.join(resets, "scope", "left").where(F.col("r").isNull() | (F.col("o") >= F.col("r")))
    found = live.groupBy("scope").agg(F.max("o").alias("o"), *[F.max_by(r, F.when(F.col(r).isNotNull(), F.col("o"))).alias(r) for r in roles])
    return found.where(F.coalesce(*roles).isNotNull()).select("scope", "o.at", "o.seq", *roles)


