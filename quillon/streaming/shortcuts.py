"""Pastes right behind the plain-paste shortcut are left alone: an interval join of two streams, or of two tables.

Both sides meet by user and second (a shortcut in its own second and in those it reaches into), so that a user with any number
of events is many keys. On streams, state is kept for the interval and the lateness only; late rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _second(at: str):
    return F.floor(F.unix_millis(at) / 1000)


def with_suppression(pastes: DataFrame, shortcuts: DataFrame, within_ms: int = 1000, late: str = "10 minutes") -> DataFrame:
    """``paste_id, user_id, ts, suppressed`` for each paste: whether the user's shortcut came less than ``within_ms`` before.

    ``pastes`` have ``paste_id, user_id, ts`` and ``shortcuts`` ``user_id, ts`` (timestamps). Streams give a paste once nothing
    can match it any more. A null user matches nobody. Pastes that come again (same id) count once.
    """
    stream = pastes.isStreaming
    if stream:
        pastes, shortcuts = pastes.withWatermark("ts", late), shortcuts.withWatermark("ts", late)
    reach = -(-within_ms // 1000)
    asked = pastes.select("paste_id", "user_id", "ts").withColumn("second", _second("ts"))
    pressed = shortcuts.select(F.col("user_id").alias("by"), F.col("ts").alias("at"), F.explode(F.array(*[_second("ts") + k for k in range(reach + 1)])).alias("in_second"))
    near = (F.col("user_id") == F.col("by")) & (F.col("second") == F.col("in_second")) & (F.col("at") <= F.col("ts")) & (F.col("at") > F.col("ts") - F.expr(f"INTERVAL {within_ms / 1000} SECONDS"))
    found = asked.join(pressed, near, "left_outer").select("paste_id", "user_id", "ts", F.col("at").isNotNull().alias("suppressed"))
    # several shortcuts give several equal rows
    return found.dropDuplicatesWithinWatermark(["paste_id"]) if stream else found.dropDuplicates(["paste_id"])
