"""Streams of copy and paste events: which copy a paste came from.

State is one latest copy a key, in the state store; rows are handled in order of time within a batch, so replays of a batch
give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id bigint, paste_id bigint, ts timestamp, origin string"
#: A copy is forgotten when it could explain no paste any more.
MOST_AGE = pd.Timedelta(minutes=30)


def _match(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One latest copy a user: ``ts`` in microseconds, fingerprint and site."""
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "is_paste", "event_id"])
    out = []
    for r in rows.itertuples(index=False):
        if not r.is_paste:
            held = (int(r.ts.value // 1000), r.fingerprint, r.site)
            continue
        fits = held is not None and r.fingerprint and held[1] == r.fingerprint and int(r.ts.value // 1000) - held[0] <= MOST_AGE.value // 1000
        out.append((key[0], r.event_id, r.ts, held[2] if fits else None))
    if held is not None:
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs()) + MOST_AGE.value // 10**6 + 1)
    if out:
        yield pd.DataFrame(out, columns=["user_id", "paste_id", "ts", "origin"])


def attribute_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pastes with their origin from a stream of ``event_id, ts, user_id, is_paste, fingerprint, site``."""
    keyed = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy("user_id")
    return keyed.applyInPandasWithState(_match, OUT, "ts bigint, fingerprint string, site string", "append", GroupStateTimeout.EventTimeTimeout)
