"""Sessions of an agent as state of a stream: token map, memo, history and the step at hand.

Needs a state store with several columns:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.patterns import JS_SPACE, PLACEHOLDER
from ..functions.spans import SPAN
from ..operators.detect import with_spans
from ..operators.known import MIN_KNOWN_CHARS
from .sessions import TTL_MS

#: What comes in. kind: text (origin, unit, text), step (step, thought, actions, blocked_at), results (step, results) or stop.
EVENT = "session_id string, ts timestamp, seq long, kind string, origin string, unit long, text string, step int, thought string, actions array<string>, blocked_at int, results array<string>"
OUT = "session_id string, seq long, kind string, unit long, step int, text string, memo boolean, thought string, actions array<string>, results array<string>"


def trimmed(value: str) -> str:
    return re.sub(rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "", value)


def known_places(text: str, known: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Places of known values (type, value) in a text: whole words, any case, longest first, outside of placeholders."""
    taken, out = [m.span() for m in re.finditer(PLACEHOLDER, text)], []
    places = [(*m.span(), kind) for kind, value in known if len(value) >= MIN_KNOWN_CHARS for m in re.finditer(rf"(?<!\w){re.escape(value)}(?!\w)", text, re.IGNORECASE)]
    for start, end, kind in sorted(places, key=lambda p: (p[0] - p[1], p[0], p[2])):
        if not any(start < e and s < end for s, e in taken):
            taken.append((start, end))
            out.append((start, end, kind))
    return out


def merged_results(actions: list, blocked_at: int | None, done: list) -> list[str]:
    """Results of all actions of a step: what ran, then not_run; the blocked one and those after it never ran."""
    ran = len(actions) if blocked_at is None else blocked_at
    return [(done[i] if i < len(done) else "not_run") if i < ran else "blocked" if i == blocked_at else "not_run" for i in range(len(actions))]


class AgentSession(StatefulProcessor):
    """One session's rows in order of (ts, seq). Texts come out with tokens, a text seen before by the memo unless it holds a
    value known by now; results come out as a row of history; a stop clears all, as does a silence of TTL_MS."""

    def init(self, handle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "origin string, type string, norm string", "value string, token string")
        self.numbers = handle.getMapState("numbers", "type string", "n int")
        self.memo = handle.getMapState("memo", "origin string, text string", "shown string")
        self.history = handle.getListState("history", "step int, thought string, actions array<string>, results array<string>")
        self.pending = handle.getValueState("pending", "step int, thought string, actions array<string>, blocked_at int")
        self.expiry = handle.getValueState("expiry", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out, live = [], False
        for r in given.itertuples():
            live = r.kind != "stop"
            if r.kind == "text":
                text, memo = self._shown(r.origin, r.text, r.spans)
                out.append((key[0], r.seq, "text", int(r.unit), None, text, memo, None, None, None))
            elif r.kind == "step":
                self.pending.update((int(r.step), r.thought, list(r.actions), None if pd.isna(r.blocked_at) else int(r.blocked_at)))
            elif r.kind == "results" and self.pending.exists():
                step, thought, actions, blocked = self.pending.get()
                if step == r.step:
                    results = merged_results(list(actions), blocked, list(r.results))
                    self.history.appendValue((step, thought, list(actions), results))
                    self.pending.clear()
                    out.append((key[0], r.seq, "results", None, step, None, None, thought, list(actions), results))
            elif r.kind == "stop":
                out.append((key[0], r.seq, "stop", None, None, None, None, None, None, [str(h[0]) for h in self.history.get()] if self.history.exists() else []))
                self._forget()
        if live:
            last = int(given["ts"].max().timestamp() * 1000)
            self._wake_at(max(last, timerValues.getCurrentWatermarkInMs()) + TTL_MS)
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])
        yield frame.astype({"unit": "Int64", "step": "Int32", "memo": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter(())

    def _wake_at(self, at: int) -> None:
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.handle.registerTimer(at)
        self.expiry.update((at,))

    def _forget(self) -> None:
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        for state in (self.tokens, self.numbers, self.memo, self.history, self.pending, self.expiry):
            state.clear()

    def _shown(self, origin: str, text: str | None, spans) -> tuple[str | None, bool]:
        if text is None:
            return None, False
        held = {k: v for k, v in self.tokens.iterator() if k[0] == origin}
        known = known_places(text, [(k[1], trimmed(v[0])) for k, v in held.items()])
        if not known and self.memo.containsKey((origin, text)):
            return self.memo.getValue((origin, text))[0], True
        free = [(s["start"], s["end"], s["type"]) for s in spans if not any(s["start"] < e and a < s["end"] for a, e, _ in known)]
        at, parts = 0, []
        for start, end, kind in sorted(known + free):
            parts += [text[at:start], self._token(origin, kind, text[start:end])]
            at = end
        shown = "".join(parts) + text[at:]
        self.memo.updateValue((origin, text), (shown,))
        return shown, False

    def _token(self, origin: str, kind: str, value: str) -> str:
        name = (origin, kind, trimmed(value).lower())
        if self.tokens.containsKey(name):
            return self.tokens.getValue(name)[1]
        n = (self.numbers.getValue((kind,))[0] if self.numbers.containsKey((kind,)) else 0) + 1
        self.numbers.updateValue((kind,), (n,))
        token = f"[PII_{kind}_{n}]"
        self.tokens.updateValue(name, (value, token))
        return token


def agent_sessions(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """What sessions of agents give out (OUT), from a stream of EVENT rows; rows without ts or later than the watermark are dropped."""
    timely = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    found = with_spans(timely).withColumn("spans", F.col("spans").cast(f"array<{SPAN}>"))
    return found.groupBy("session_id").transformWithStateInPandas(statefulProcessor=AgentSession(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
