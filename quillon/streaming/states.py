"""Keyed state over an ordered stream: confirmation, keep-alive, delayed output, hot start.

Each operator has the state of one key in a few numbers or in the objects that
its session holds now; a session's frames arrive in order, within a
micro-batch they are sorted.  Batch twins are in `operators.windows`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _apply(stream: DataFrame, key: str, run, output: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def confirm(stream: DataFrame, key: str, order: str, hit: str, least: int) -> DataFrame:
    """key, order, streak, confirmed: hits in a row up to each row, and whether `least` in a row have been seen so far."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, confirmed = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(order)
        streaks, flags = [], []
        for h in rows[hit]:
            streak = streak + 1 if h else 0
            confirmed = confirmed or streak >= least
            streaks.append(streak)
            flags.append(confirmed)
        state.update((streak, confirmed))
        yield pd.DataFrame({key: k[0], order: rows[order], "streak": streaks, "confirmed": flags})

    return _apply(stream.select(key, order, hit), key, run, f"{key} bigint, {order} bigint, streak bigint, confirmed boolean", "streak bigint, confirmed boolean")


def keep_alive(stream: DataFrame, key: str, order: str, hit: str, low: int, high: int, start: int) -> DataFrame:
    """key, order, keep_alive: a counter that a hit raises and a miss lowers, held within [low, high]."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values(order)
        values = []
        for h in rows[hit]:
            value = max(low, min(high, value + (1 if h else -1)))
            values.append(value)
        state.update((value,))
        yield pd.DataFrame({key: k[0], order: rows[order], "keep_alive": values})

    return _apply(stream.select(key, order, hit), key, run, f"{key} bigint, {order} bigint, keep_alive bigint", "value bigint")


def delayed(stream: DataFrame, key: str, frame: str, last: str, removed: str, delay: int) -> DataFrame:
    """key, frame, emitted_at: each session's frames `delay` - 1 frames late, all that wait at its last frame.

    `removed` is an array of objects that a frame takes out of the session; a
    frame comes with `hidden`, all that was removed up to its emission.  The
    state holds the waiting frames, at most `delay`, and the removed objects.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, hidden = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(frame)
        out = []
        for f, is_last, gone in zip(rows[frame], rows[last], rows[removed]):
            waiting.append(int(f))
            hidden += [int(x) for x in (gone if gone is not None else []) if int(x) not in hidden]
            ready = waiting if is_last else waiting[:1] if len(waiting) >= delay else []
            out += [(k[0], x, int(f), sorted(hidden)) for x in ready]
            waiting = [] if is_last else waiting[len(ready) :]
        state.update((waiting, hidden))
        yield pd.DataFrame(out, columns=[key, frame, "emitted_at", "hidden"])

    return _apply(stream.select(key, frame, last, removed), key, run, f"{key} bigint, {frame} bigint, emitted_at bigint, hidden array<bigint>", "waiting array<bigint>, hidden array<bigint>")


def hot_start_step(objects: dict, pairs: dict, frame: int, event: dict, delay: int, unmatched: int, repeats: int, low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """(removed, suppressed) at a frame; `objects` and `pairs` are brought up to date.

    `event`: `new` objects; `matched` and `missed` ones (those neither matched
    nor empty); `groups`, for each detection that several tracks match, these.
    An object is removed if it is missed `unmatched` times, or shares a
    detection with an earlier one in `repeats` frames, while it is younger than
    `delay`; it is suppressed where its counter is 0 or less.
    """
    young = frame - delay
    for o in event["new"]:
        objects[o] = {"first": frame, "alive": start, "missed": 0, "removed": False}
    for o in event["matched"]:
        if o in objects:
            objects[o]["alive"] = min(high, objects[o]["alive"] + 1)
    for o in event["missed"]:
        if o in objects:
            objects[o]["missed"] += 1
            objects[o]["alive"] = max(low, objects[o]["alive"] - 1)
    for group in event["groups"]:
        known = sorted((objects[o]["first"], o) for o in group if o in objects)
        for _, other in known[1:]:
            pair = f"{known[0][1]}-{other}"
            pairs[pair] = pairs.get(pair, 0) + 1
    gone = {o for o, s in objects.items() if not s["removed"] and s["first"] > young and s["missed"] >= unmatched}
    for pair, n in pairs.items():
        other = int(pair.split("-")[1])
        if n >= repeats and objects[other]["first"] > young and not objects[other]["removed"]:
            gone.add(other)
    for o in gone:
        objects[o]["removed"] = True
    return sorted(gone), sorted(o for o, s in objects.items() if not s["removed"] and s["alive"] <= 0)


def hot_start(stream: DataFrame, key: str, frame: str, delay: int = 15, unmatched: int = 8, repeats: int = 8, low: int = -4, high: int = 8, start: int = 0) -> DataFrame:
    """key, frame, removed, suppressed of each session's frames, by `hot_start_step`.

    `stream` has key, frame, and arrays new, matched, missed (bigint) and
    groups (array of arrays).  The state is what the session's objects are.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        objects, pairs = json.loads(state.get[0]) if state.exists else ({}, {})
        objects = {int(o): s for o, s in objects.items()}
        out = []
        for row in pd.concat(list(frames)).sort_values(frame).itertuples():
            event = {n: [int(x) for x in getattr(row, n)] for n in ("new", "matched", "missed")} | {"groups": [[int(x) for x in g] for g in row.groups]}
            out.append((k[0], int(getattr(row, frame)), *hot_start_step(objects, pairs, int(getattr(row, frame)), event, delay, unmatched, repeats, low, high, start)))
        state.update((json.dumps([objects, pairs]),))
        yield pd.DataFrame(out, columns=[key, frame, "removed", "suppressed"])

    return _apply(stream.select(key, frame, "new", "matched", "missed", "groups"), key, run, f"{key} bigint, {frame} bigint, removed array<bigint>, suppressed array<bigint>", "session string")
