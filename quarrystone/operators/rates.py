"""Rate limiters: admission depends on what was admitted before, so each key's events are folded in order.

A rule is a pair (begin, step): ``begin()`` gives a key's first state, and
``step(state, seconds)`` the next state and the answer for an event.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from quarrystone.operators.folds import fold

Rule = tuple[Callable[[], Any], Callable[[Any, float], tuple[Any, Any]]]


def sliding(most: int, window: float) -> Rule:
    """Allowed if fewer than ``most`` allowed events lie in the trailing window; refused ones are not counted."""

    def step(held: deque[float], t: float) -> tuple[deque[float], bool]:
        while held and held[0] <= t - window:
            held.popleft()
        allowed = len(held) < most
        if allowed:
            held.append(t)
        return held, allowed

    return deque, step


def token_bucket(capacity: float, per_second: float) -> Rule:
    """Allowed if a token is there; refused events take none."""

    def step(state: tuple[float, float | None], t: float) -> tuple[tuple[float, float], bool]:
        level, last = state
        level = capacity if last is None else min(capacity, level + (t - last) * per_second)
        return (level - (level >= 1), t), level >= 1

    return lambda: (capacity, None), step


def leaky_bucket(capacity: float, per_second: float) -> Rule:
    """Allowed if the bucket, which drains at a fixed rate, has room."""

    def step(state: tuple[float, float | None], t: float) -> tuple[tuple[float, float], bool]:
        level, last = state
        level = 0.0 if last is None else max(0.0, level - (t - last) * per_second)
        room = level + 1 <= capacity
        return (level + room, t), room

    return lambda: (0.0, None), step


def bucket_waits(capacity: float, per_second: float) -> Rule:
    """Seconds that an event waits for its token, first come first served; nothing is refused."""

    def step(state: tuple[float, float | None], t: float) -> tuple[tuple[float, float], float]:
        level, last = state
        now = t if last is None else max(t, last)
        level = capacity if last is None else min(capacity, level + (now - last) * per_second)
        served = now if level >= 1 else now + (1 - level) / per_second
        return (max(0.0, level - 1), served), served - t

    return lambda: (capacity, None), step


def answers(rule: Rule, times: list[float]) -> list:
    """The rule over one key's event times."""
    begin, step = rule
    state, out = begin(), []
    for t in times:
        state, answer = step(state, t)
        out.append(answer)
    return out


def admit(events: DataFrame, rule: Rule, key: str, time_us: str, event: str, result: str = "allowed boolean") -> DataFrame:
    """(key, event, allowed): ``rule`` over each key's event times in seconds, ties by event. Only a key's state is held."""
    begin, step = rule
    kinds = dict(events.dtypes)

    def one(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        state, answer = step(state, row[time_us] / 1e6)
        return state, [(row[key], row[event], answer)]

    return fold(events.select(key, event, time_us), key, [time_us, event], begin, one, lambda name, state: [], f"{key} {kinds[key]}, {event} {kinds[event]}, {result}")
