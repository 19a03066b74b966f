"""Streams of response events: assembly per stream, in batch and with state, and deduplication."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrystone.operators.folds import fold

_SCHEMA = "stream_id string, status string, text string, arguments string, error string"
_KNOWN = ("text.delta", "tool.arguments.delta", "response.completed", "response.error")


def begin() -> dict:
    return {"status": "open", "text": [], "calls": {}, "error": None}


def step(state: dict, kind: str, call_id: str | None, delta: str | None) -> None:
    """Take one event into the state: open until a terminal event, with the first violation kept as its error.

    Pieces of text are kept apart until the end, so an event costs its own length.
    """
    if state["error"]:
        return
    if state["status"] != "open":
        state["error"] = "after_terminal"
    elif kind == "text.delta" and isinstance(delta, str):
        state["text"].append(delta)
    elif kind == "tool.arguments.delta" and not call_id:
        state["error"] = "missing_call_id"
    elif kind == "tool.arguments.delta" and isinstance(delta, str):
        state["calls"].setdefault(call_id, []).append(delta)
    elif kind == "response.completed":
        state["status"] = "completed"
    elif kind == "response.error":
        state["error"] = "response_error"
    else:
        state["error"] = "bad_delta" if kind in _KNOWN else "unknown_type"
    if state["error"]:
        state["status"] = "error"


def finish(name: str, state: dict) -> tuple:
    """Arguments are parsed only now; a stream without a terminal event is an error."""
    status, error = state["status"], state["error"]
    calls = {call: "".join(parts) for call, parts in state["calls"].items()}
    if status == "open":
        status, error = "error", "no_completion"
    if status == "completed":
        try:
            for raw in calls.values():
                json.loads(raw)
        except ValueError:
            status, error = "error", "invalid_arguments"
    return name, status, "".join(state["text"]), json.dumps(calls, sort_keys=True), error


def assemble(events: DataFrame) -> DataFrame:
    """One row for each stream of events (stream_id, seq, kind, call_id, delta)."""

    def one(state: dict, r: dict) -> tuple[dict, list]:
        step(state, r["kind"], r["call_id"], r["delta"])
        return state, []

    return fold(events, "stream_id", ["seq"], begin, one, lambda name, state: [finish(name, state)], _SCHEMA)


class Assembled(StatefulProcessor):
    """A stream's events folded in order of ``seq``, whatever order and frames they come in.

    Events that follow the last one folded are folded at once; those ahead of
    a gap wait in a map.  At a terminal event the row leaves.  When a stream
    has been idle, what waits is folded over the gaps and state is dropped.
    """

    def __init__(self, idle_ms: int, first: int):
        self.idle_ms, self.first = idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string, next long, told string, timer_ms long, events long")
        self.ahead = handle.getMapState("ahead", "seq long, n long", "event string")

    def _told(self, name: str, state: dict, told: str | None, closing: bool) -> tuple[list[tuple], str | None]:
        mark = f"{state['status']}:{state['error']}"
        if mark == told or (state["status"] == "open" and not closing):
            return [], told
        return [finish(name, state)], mark

    def _fold(self, state: dict, events: list[str]) -> None:
        for event in events:
            step(state, *json.loads(event))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        body, following, told, timer, events = tuple(self.state.get()) if self.state.exists() else (None, self.first, None, None, 0)
        state = begin() if body is None else json.loads(body)
        for part in rows:
            for r in part.itertuples():
                events += 1
                self.ahead.updateValue((int(r.seq), events), (json.dumps([r.kind, r.call_id, r.delta]),))
        waiting = sorted(tuple(k) for k in self.ahead.keys())
        for at, k in enumerate(waiting):
            if k[0] > following:
                break
            self._fold(state, [self.ahead.getValue(k)[0]])
            self.ahead.removeKey(k)
            if at + 1 == len(waiting) or waiting[at + 1][0] != k[0]:
                following = max(following, k[0] + 1)
        out, told = self._told(key[0], state, told, False)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.state.update((json.dumps(state), following, told, timer, events))
        yield pd.DataFrame(out, columns=["stream_id", "status", "text", "arguments", "error"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        body, _, told, _, _ = tuple(self.state.get())
        state = json.loads(body)
        waiting = sorted(tuple(k) for k in self.ahead.keys())
        self._fold(state, [self.ahead.getValue(k)[0] for k in waiting])
        out, _ = self._told(key[0], state, told, True)
        self.ahead.clear()
        self.state.clear()
        yield pd.DataFrame(out, columns=["stream_id", "status", "text", "arguments", "error"])

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, idle: str = "60 seconds", first: int = 1) -> DataFrame:
    """The same over a streaming DataFrame: rows leave at the terminal event, or when a stream has been idle too long.

    Events are folded in order of ``seq`` from ``first``, over all frames and
    micro-batches; one that is ahead of a gap waits until the gap is filled or
    the stream is idle.  A stream that has ended is remembered until it has
    been idle; an event that comes after its end gives one more row,
    after_terminal, as in batch.  Needs ``stateful.use_state_store``.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return events.groupBy("stream_id").transformWithStateInPandas(Assembled(wait, first), _SCHEMA, "Append", "ProcessingTime")


_GATEWAY = "stream_id string, kind string, text string, tools string, stop_reason string, input_tokens long, error string"


def parse_gateway(events: DataFrame) -> DataFrame:
    """One row for each stream of events (stream_id, seq, type, id, name, body, tokens) of the start, delta and end kind.

    One tool is open at a time, and a new start drops what the last one had;
    its arguments are parsed at its end, where empty or broken ones are the
    stream's error.  Unknown types are passed over.
    """

    def begin() -> dict:
        return {"text": "", "tools": [], "open": ("", "", ""), "stop": "end_turn", "tokens": 0, "error": None}

    def one(state: dict, r: dict) -> tuple[dict, list]:
        body = r["body"] or ""
        if state["error"] is None:
            match r["type"]:
                case "text_delta":
                    state["text"] += body
                case "tool_use_start":
                    state["open"] = (r["id"], r["name"], "")
                case "tool_use_delta":
                    call, name, raw = state["open"]
                    state["open"] = (call, name, raw + body)
                case "tool_use_end":
                    call, name, raw = state["open"]
                    try:
                        state["tools"].append({"id": call, "name": name, "input": json.loads(raw)})
                    except ValueError:
                        state["error"] = "invalid_arguments"
                case "message_end":
                    state["stop"], state["tokens"] = r["body"], int(r["tokens"] or 0)
        return state, []

    def end(name: str, state: dict) -> list[tuple]:
        kind = "error" if state["error"] else "tool_use" if state["tools"] else "text"
        return [(name, kind, state["text"] or None, json.dumps(state["tools"]) if state["tools"] else None, state["stop"], state["tokens"], state["error"])]

    return fold(events, "stream_id", ["seq"], begin, one, end, _GATEWAY)


def dedup_events(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """At-least-once events, once each, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
