"""The alert log of a stream of fused rows: every suspicious or alerted row once, numbered within its station.

State by station keeps the last time that was numbered, how many there were, and
the rows that came since. A row waits until the watermark has passed it, so
late rows within the delay find their place and repeated ones are known; a timer
at the oldest waiting row wakes stations that get no rows of their own. With a
checkpoint the log goes on where it stopped: it is the table that
``explore.alert_log`` makes of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import STATION, TIME

LOG = f"{STATION} string, {TIME} timestamp, idx int, final_severity string, detector_votes int"
_STATE = "last long, counted int, times array<long>, severities array<string>, votes array<int>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, counted, times, severities, votes = state.get if state.exists else (None, 0, [], [], [])
    waiting = {t: (s, v) for t, s, v in zip(times, severities, votes, strict=True)}
    for rows in batches:
        for t, s, v in zip(rows["micros"].tolist(), rows["final_severity"].tolist(), rows["detector_votes"].tolist(), strict=True):
            if last is None or t > last:  # an earlier time is numbered already
                waiting[t] = min(waiting.get(t, (s, int(v))), (s, int(v)))
    mark = state.getCurrentWatermarkMs() * 1000
    out = []
    for t in sorted(t for t in waiting if t <= mark):
        severity, count = waiting.pop(t)
        if severity != "normal":
            out.append((key[0], pd.Timestamp(t, unit="us"), counted, severity, count))
        last, counted = t, counted + 1
    rest = sorted(waiting)
    state.update((last, counted, rest, [waiting[t][0] for t in rest], [waiting[t][1] for t in rest]))
    if rest:
        state.setTimeoutTimestamp(max(rest[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=[STATION, TIME, "idx", "final_severity", "detector_votes"])


def alert_log_stream(results: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The log of a stream with station_id, timestamp, final_severity and detector_votes. Rows later than ``delay`` and rows without a key are dropped.

    A station's state holds the rows of one delay. Rows of the last delay are logged when later ones, of any station, arrive.
    """
    rows = results.where(F.col(STATION).isNotNull() & F.col(TIME).isNotNull()).select(STATION, F.col(TIME).cast("timestamp").alias(TIME), "final_severity", "detector_votes").withWatermark(TIME, delay)
    rows = rows.withColumn("micros", F.unix_micros(TIME))
    return rows.groupBy(STATION).applyInPandasWithState(_advance, LOG, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now goes into Parquet files, each row once; a later call with the same checkpoint goes on behind it."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
