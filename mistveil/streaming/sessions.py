"""Streams: logs flushed in steps, and token maps that live as long as their session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import SPAN
from ..operators.detect import with_spans

NUMBERED = "session_id string, origin string, unit long, type string, token string, start int, end int"
STATE = "numbers map<string,int>, tokens map<string,string>, last long"


def flush_logs(logs: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """Write a stream of log rows as Parquet in steps of time."""
    return logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed_counts(logs: DataFrame, *, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Records and failures per op and time window; rows later than the watermark are dropped."""
    failed = F.count_if(F.col("outcome") != "ok")
    return logs.withWatermark(ts, late).groupBy(F.window(ts, size), "op").agg(F.count("*").alias("n"), failed.alias("failed"))


def _number(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    numbers, tokens, last = state.get if state.exists else ({}, {}, 0)
    numbers, tokens = dict(numbers), dict(tokens)
    rows, ended = [], False
    units = pd.concat(list(frames)).sort_values("unit", kind="stable")  # one session's units of one batch, in whatever chunks they come
    for r in units.itertuples():
        ended |= bool(r.ends)
        for s in r.spans:
            value = r.text[s["start"] : s["end"]].strip().lower()
            name = "\x1f".join((r.origin, s["type"], value))
            if name not in tokens:
                numbers[s["type"]] = numbers.get(s["type"], 0) + 1
                tokens[name] = f"[PII_{s['type']}_{numbers[s['type']]}]"
            rows.append((key[0], r.origin, r.unit, s["type"], tokens[name], s["start"], s["end"]))
    if ended:
        state.remove()
    else:
        last = max(last, int(units["ms"].max()), state.getCurrentWatermarkMs())
        state.update((numbers, tokens, last))
        state.setTimeoutTimestamp(last + TTL_MS)
    yield pd.DataFrame(rows, columns=["session_id", "origin", "unit", "type", "token", "start", "end"])


#: A session without units for so long ends; its numbers start anew.
TTL_MS = 30 * 60 * 1000


def session_tokens(units: DataFrame, *, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Tokens of a stream of units (session_id, origin, unit, ts, text, ends): numbers stay stable for the life of a session.

    State is one session's map; it goes when a unit with ends comes, or once
    the watermark (the latest ts less `late`) has passed the session's last
    unit by TTL_MS. Time is that of the events, so an idle stream runs no
    batches. Units whose ts is null or older than the watermark are dropped.
    """
    found = with_spans(units.where(F.col(ts).isNotNull()).withWatermark(ts, late))
    shown = found.select("session_id", "origin", "unit", ts, "text", "ends", F.unix_millis(ts).alias("ms"), F.col("spans").cast(f"array<{SPAN}>").alias("spans"))
    return shown.groupBy("session_id").applyInPandasWithState(_number, NUMBERED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
