"""Keep-first by position on a stream, with state per key and a time-out.

``dedupe_stream`` keeps the row of a key that arrives first.  Here the row with the
smallest position stays, in whatever order the rows arrive: a key's best row is
held in the state until the watermark has passed the latest event time seen of the
key (so that no row of that time is still to come), then it is emitted once;
the key itself is remembered for ``hold`` longer, and rows that come meanwhile
are repeats.  Then the state of the key goes, so that state grows with the keys of
that span of time, not with the stream.

Rows are grouped by a digest of the keys; the state holds one row (as JSON) a key.
The rows of a key in a micro-batch are read one Arrow batch after another, never
as a whole.  Null keys group together, as in ``dedupe_first``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedupe import key_digest

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def keep_first_stream(stream: DataFrame, keys: Sequence[str], order_col: str, event_time: str,
                      *, delay: str = "1 hour", hold_ms: int = 3_600_000) -> DataFrame:
    """One row per distinct ``keys``: the one with the smallest ``order_col`` (an
    integer, unique per row).  ``delay``: how late rows may come (the watermark)."""
    rows = stream.withWatermark(event_time, delay).select(
        F.hex(key_digest(stream, keys)).alias("_g"), F.col(order_col).cast("long").alias("_o"),
        F.col(event_time).alias("_t"), F.to_json(F.struct(*stream.columns), _JSON).alias("_row"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        order, row, done, until = state.get if state.exists else (None, "", False, now + 1)
        if until <= now:            # the time of this key, or of its memory, is over
            if done:
                order, done = None, False
            else:
                yield pd.DataFrame({"row": [row]})
                row, done, until = "", True, now + hold_ms
        if state.hasTimedOut:
            if done:
                state.update((order, row, done, until))
                state.setTimeoutTimestamp(until)
            else:
                state.remove()
            return
        for batch in batches:
            if done:
                continue
            best = batch["_o"].idxmin()
            if order is None or batch["_o"][best] < order:
                order, row = int(batch["_o"][best]), batch["_row"][best]
            until = max(until, int(batch["_t"].max().timestamp() * 1000) + 1)
        state.update((order, row, done, until))
        state.setTimeoutTimestamp(until)

    out = rows.groupBy("_g").applyInPandasWithState(
        step, "row string", "o long, row string, done boolean, until long", "append",
        GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("row", stream.schema, _JSON).alias("r")).select("r.*")
