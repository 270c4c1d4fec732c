"""Tracking sessions over a stream: typed keyed state, timers and expiry.

A session's frames are numbered from 0.  Frames that come early wait in the
state until those before them are there; when more than `patience` wait, the
missing ones are given up.  A frame behind what has been worked on is late: it
goes out marked so and changes nothing.  What a frame does depends on the frames
before it alone, so output doesn't depend on how a stream is cut into
micro-batches.  A session whose event time stands still for `idle` is closed by
a timer: its waiting frames go out in order and all of its state is gone.

State is what future frames can still ask for: objects that live, pairs that can
still remove one, frames that wait.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that typed state needs; the session's setting comes back after it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Ordered(StatefulProcessor):
    """Hands a session's frames on in order; subclasses say what a frame's columns are and what it does.

    `columns`: names of a frame's columns after key, frame and time; `kinds` their types.
    """

    columns: list[str]
    kinds: list[str]
    patience: int
    idle_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "next bigint, waiting bigint, due bigint")
        self.waiting = handle.getMapState("waiting", "frame bigint", ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.kinds)))
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        coming, held, due = self.clock.get() if self.clock.exists() else (0, 0, -1)
        frames = {k[0]: tuple(v) for k, v in self.waiting.iterator()} if held else {}
        stored, late, latest = set(frames), [], due - self.idle_ms
        for _, frame, ms, _, *values in rows:
            latest = max(latest, ms)
            if frame < coming or frame in frames:
                late.append(frame)
            else:
                frames[frame] = tuple(values)
        out, self.state = [], None
        while frames:
            first = min(frames)
            if first != coming and len(frames) <= self.patience:
                break
            out += self.step(first, dict(zip(self.columns, frames.pop(first))))
            coming = first + 1
        for f in stored - frames.keys():
            self.waiting.removeKey((f,))
        for f in frames.keys() - stored:
            self.waiting.updateValue((f,), frames[f])
        self.save()
        if latest + self.idle_ms != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = latest + self.idle_ms
            self.handle.registerTimer(due)
        self.clock.update((coming, len(frames), due))
        yield from self.rows(key, out, late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        frames = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        out, self.state = [], None
        for f in sorted(frames):
            out += self.step(f, dict(zip(self.columns, frames[f])))
        out += self.close_session()
        for s in (self.clock, self.waiting, *self.all_states()):
            s.clear()
        yield from self.rows(key, out, [])

    def close(self) -> None:
        pass


@dataclass
class Rules:
    """Of the hot start: how long objects are young, what removes a young one, and the bounds of its counter."""

    delay: int = 15
    unmatched: int = 8
    repeats: int = 8
    low: int = -4
    high: int = 8
    start: int = 0
    empty_lowers: bool = False


def hot_start_frame(objects: dict, pairs: dict, frame: int, event: dict, r: Rules) -> tuple[list[int], list[int]]:
    """(removed, suppressed) at a frame; brings `objects` (id: [first, alive, missed, occluded]) and `pairs` ((earlier, later): frames) up to date.

    An object is removed while it is younger than `delay` frames: when it was
    missed in `unmatched` frames, or shared detections with an earlier object in
    `repeats` frames.  One that has been missed and whose counter is 0 or less
    is suppressed.  Removed and gone objects leave with their pairs, and pairs
    leave when the later object is no longer young.
    """
    for o in event["new"]:
        objects.setdefault(o, [frame, r.start, 0, -1])
    for o in set(event["matched"]).union(*event["groups"]) & objects.keys():
        objects[o][1] = min(r.high, objects[o][1] + 1)
    for o in [o for o in event["missed"] if o in objects]:
        objects[o][2] += 1
        objects[o][1] = max(r.low, objects[o][1] - 1)
    for o in [o for o in event["empty"] if o in objects] if r.empty_lowers else []:
        objects[o][1] = max(r.low, objects[o][1] - 1)
    for o in event["occluded"]:
        if o in objects:
            objects[o][3] = frame
    young = {o for o, s in objects.items() if s[0] > frame - r.delay}
    gone = {o for o in young if objects[o][2] >= r.unmatched}
    suppressed = sorted(o for o, s in objects.items() if s[2] > 0 and s[1] <= 0 and o not in gone)
    for group in event["groups"]:
        known = sorted((objects[o][0], o) for o in set(group) if o in objects)
        for _, later in known[1:]:
            pairs[known[0][1], later] = pairs.get((known[0][1], later), 0) + 1
    gone |= {later for (_, later), n in pairs.items() if n >= r.repeats and later in young}
    for o in gone | set(event["gone"]):
        objects.pop(o, None)
    for p in [p for p in pairs if p[0] not in objects or p[1] not in objects or p[1] not in young]:
        del pairs[p]
    return sorted(gone), suppressed


class _HotStart(_Ordered):
    columns = ["new", "matched", "missed", "empty", "occluded", "gone", "groups"]
    kinds = ["array<bigint>"] * 6 + ["array<array<bigint>>"]

    def __init__(self, key: str, frame: str, rules: Rules, recent: int, patience: int, idle_ms: int):
        self.key, self.frame, self.rules, self.recent, self.patience, self.idle_ms = key, frame, rules, recent, patience, idle_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.objects = handle.getMapState("objects", "object bigint", "first bigint, alive bigint, missed bigint, occluded bigint")
        self.pairs = handle.getMapState("pairs", "earlier bigint, later bigint", "frames bigint")

    def all_states(self) -> list:
        return [self.objects, self.pairs]

    def load(self) -> None:
        objects = {k[0]: list(v) for k, v in self.objects.iterator()}
        pairs = {tuple(k): v[0] for k, v in self.pairs.iterator()}
        self.state = objects, pairs
        self.before = {o: tuple(s) for o, s in objects.items()}, dict(pairs)

    def step(self, frame: int, event: dict) -> list[tuple]:
        if self.state is None:
            self.load()
        event = {c: v if v is not None else [] for c, v in event.items()}
        objects, pairs = self.state
        removed, suppressed = hot_start_frame(objects, pairs, frame, event, self.rules)
        hidden = sorted(o for o, s in objects.items() if s[3] >= 0 and s[3] > frame - self.recent)
        return [(frame, False, removed, suppressed, hidden)]

    def save(self) -> None:
        """Writes what has changed since it was loaded."""
        if self.state is None:
            return
        for state, now, was, key, value in ((self.objects, self.state[0], self.before[0], lambda k: (k,), tuple), (self.pairs, self.state[1], self.before[1], tuple, lambda v: (v,))):
            for k in was.keys() - now.keys():
                state.removeKey(key(k))
            for k, v in now.items():
                if was.get(k) != (tuple(v) if isinstance(v, list) else v):
                    state.updateValue(key(k), value(v))

    def close_session(self) -> list[tuple]:
        return []

    def rows(self, key: tuple, out: list[tuple], late: list[int]) -> Iterator[Row]:
        made = Row(self.key, self.frame, "late", "removed", "suppressed", "occluded")
        yield from (made(key[0], *r) for r in out)
        yield from (made(key[0], f, True, [], [], []) for f in late)


def hot_start(stream: DataFrame, key: str, frame: str, at: str, rules: Rules = Rules(), recent: int = 10, patience: int = 16, late: str = "1 hour", idle: int = 3600) -> DataFrame:
    """key, frame, late, removed, suppressed, occluded of each session's frames, by `hot_start_frame`.

    `stream` has key, frame, an event time `at` and the arrays new, matched,
    missed, empty, occluded, gone (bigint; null is none) and groups (for each
    detection the objects that match it).  occluded lists the living objects
    that were in the last `recent` frames.  Rows later than the watermark
    (`late`) are out; a session without a row for `idle` seconds of event time is
    closed.  Start the stream inside `typed_state`.
    """
    p = _HotStart(key, frame, rules, recent, patience, idle * 1000)
    rows = stream.select(key, frame, F.unix_millis(at).alias("__q_ms"), at, *p.columns).withWatermark(at, late)
    kind = f"{key} bigint, {frame} bigint, late boolean, removed array<bigint>, suppressed array<bigint>, occluded array<bigint>"
    return rows.groupBy(key).transformWithState(p, kind, "append", "eventTime")


class _Delay(_Ordered):
    columns = ["objects", "removed", "last"]
    kinds = ["array<bigint>", "array<bigint>", "boolean"]

    def __init__(self, key: str, frame: str, delay: int, patience: int, idle_ms: int):
        self.key, self.frame, self.delay, self.patience, self.idle_ms = key, frame, delay, patience, idle_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getMapState("buffer", "frame bigint", "objects array<bigint>")
        self.removed = handle.getMapState("removed", "object bigint", "frame bigint")

    def all_states(self) -> list:
        return [self.buffer, self.removed]

    def load(self) -> None:
        self.state = {k[0]: list(v[0] or []) for k, v in self.buffer.iterator()}, {k[0]: v[0] for k, v in self.removed.iterator()}
        self.before = dict(self.state[0]), dict(self.state[1])

    def step(self, frame: int, event: dict) -> list[tuple]:
        if self.state is None:
            self.load()
        held, removed = self.state
        held[frame] = event["objects"] or []
        for o in event["removed"] or []:
            removed.setdefault(o, frame)
        ready = sorted(held) if event["last"] else sorted(held)[: max(0, len(held) - self.delay + 1)]
        out = [(f, frame, [o for o in held.pop(f) if o not in removed]) for f in ready]
        oldest = min(held, default=frame)
        for o in [o for o, f in removed.items() if f + self.delay < oldest]:
            del removed[o]
        return out

    def save(self) -> None:
        if self.state is None:
            return
        for state, now, was in zip((self.buffer, self.removed), self.state, self.before):
            for k in was.keys() - now.keys():
                state.removeKey((k,))
            for k in now.keys() - was.keys():
                state.updateValue((k,), (now[k],))

    def close_session(self) -> list[tuple]:
        """Frames that still wait when a session ends without a last one."""
        if self.state is None:
            self.load()
        held, removed = self.state
        end = max(held, default=0)
        return [(f, end, [o for o in held[f] if o not in removed]) for f in sorted(held)]

    def rows(self, key: tuple, out: list[tuple], late: list[int]) -> Iterator[Row]:
        made = Row(self.key, self.frame, "emitted_at", "late", "objects")
        yield from (made(key[0], f, e, False, shown) for f, e, shown in out)
        yield from (made(key[0], f, None, True, []) for f in late)


def delayed_output(stream: DataFrame, key: str, frame: str, at: str, delay: int = 15, patience: int = 16, late: str = "1 hour", idle: int = 3600) -> DataFrame:
    """key, frame, emitted_at, late, objects: each session's frames `delay` - 1 frames late, all that wait at its last one.

    `stream` has key, frame, an event time `at`, arrays objects and removed, and
    a flag last.  A frame goes out without the objects that were removed up to
    its emission.  Removed objects stay known for `delay` frames beyond the oldest
    that waits: sessions don't show an object that long after its removal.
    """
    p = _Delay(key, frame, delay, patience, idle * 1000)
    rows = stream.select(key, frame, F.unix_millis(at).alias("__q_ms"), at, *p.columns).withWatermark(at, late)
    kind = f"{key} bigint, {frame} bigint, emitted_at bigint, late boolean, objects array<bigint>"
    return rows.groupBy(key).transformWithState(p, kind, "append", "eventTime")
