"""Typed session state against machines that keep everything."""

from __future__ import annotations

import datetime
import random

import pytest

from quillon.streaming import runs, sessions

EVENTS = "k bigint, frame bigint, at timestamp, new array<bigint>, matched array<bigint>, missed array<bigint>, empty array<bigint>, occluded array<bigint>, gone array<bigint>, groups array<array<bigint>>"
T0 = datetime.datetime(2024, 1, 1)


def at(i: int) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=i)


def events(seed: int, n: int, k: int = 1) -> list[tuple]:
    """Objects come, are matched or missed, share detections and go."""
    r, alive, out, top = random.Random(seed), [], [], 0
    for f in range(n):
        new = []
        if r.random() < 0.3:
            top += 1
            new = [top]
        alive = [o for o in alive if r.random() > 0.02] + new
        matched = [o for o in alive if r.random() < 0.6]
        missed = [o for o in alive if o not in matched and r.random() < 0.8]
        groups = [r.sample(matched, 2)] if len(matched) > 1 and r.random() < 0.7 else []
        out.append((k, f, at(f), new, matched, missed, [], [o for o in alive if r.random() < 0.1], [o for o in range(1, top + 1) if o not in alive], groups))
    return out


def machine(rows: list[tuple], delay: int, unmatched: int, repeats: int, recent: int) -> dict:
    """Every frame's lists from whole histories."""
    first, alive, lost, shared, hidden, dead, out = {}, {}, {}, {}, {}, set(), {}
    for _, f, _, new, matched, missed, _, occluded, gone, groups in rows:
        for o in new:
            first[o], alive[o], lost[o] = f, 0, []
        here = lambda o: o in first and o not in dead
        for o in {*matched, *(x for g in groups for x in g)}:
            if here(o):
                alive[o] = min(8, alive[o] + 1)
        for o in missed:
            if here(o):
                lost[o].append(f)
                alive[o] = max(-4, alive[o] - 1)
        for o in occluded:
            if here(o):
                hidden[o] = f
        removed = {o for o in first if here(o) and first[o] > f - delay and len(lost[o]) >= unmatched}
        suppressed = sorted(o for o in first if here(o) and lost[o] and alive[o] <= 0 and o not in removed)
        for g in groups:
            g = sorted((o for o in g if here(o)), key=lambda o: (first[o], o))
            for o in g[1:]:
                shared.setdefault((g[0], o), []).append(f)
        removed |= {o for (e, o), fs in shared.items() if here(o) and here(e) and len(fs) >= repeats and first[o] > f - delay}
        dead |= removed | set(gone)
        out[f] = sorted(removed), suppressed, sorted(o for o, h in hidden.items() if here(o) and h > f - recent)
    return out


def grown(spark, folder, rows: list[tuple], cut: int, schema: str = EVENTS):
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i : i + cut], schema).coalesce(1).write.parquet(f"{folder}/{i:06d}")
    return runs.read_growing(spark, f"{folder}/*", schema, files_per_trigger=1)


@pytest.mark.parametrize("cut", [400, 37])
def test_hot_start_whatever_the_batches(spark, tmp_path, cut):
    rows = events(1, 120) + events(2, 120, k=2)
    for r in rows:
        assert r[1] < 120
    mixed = sorted(rows, key=lambda r: (r[1] ^ 3, r[0]))  # frames come up to three out of order
    rules = sessions.Rules(delay=9, unmatched=4, repeats=3)
    with sessions.typed_state(spark):
        got = runs.run_available(sessions.hot_start(grown(spark, tmp_path, mixed, cut), "k", "frame", "at", rules, recent=4), "hot").collect()
    assert len(got) == 240 and not any(r.late for r in got)
    for k, seed in ((1, 1), (2, 2)):
        assert {r.frame: (r.removed, r.suppressed, r.occluded) for r in got if r.k == k} == machine(events(seed, 120, k), 9, 4, 3, 4)
    assert any(r.removed for r in got) and any(r.suppressed for r in got)


def test_late_frames_and_gaps(spark, tmp_path):
    e = lambda f, **x: (1, f, at(f), *[x.get(c) for c in sessions._HotStart.columns])
    rows = [e(0, new=[1]), e(2), e(3), e(4), e(1, new=[9]), e(5, missed=[1, 9])]
    with sessions.typed_state(spark):
        got = runs.run_available(sessions.hot_start(grown(spark, tmp_path, rows, 1), "k", "frame", "at", sessions.Rules(), patience=2), "late").collect()
    by = {r.frame: r for r in got}
    assert [f for f, r in sorted(by.items()) if r.late] == [1]
    assert by[5].suppressed == [1]  # the object of the late frame never was


def test_state_stays_flat():
    """Ten thousand frames: what is kept follows the living objects, not the past."""
    objects, pairs, most = {}, {}, 0
    rules = sessions.Rules(delay=9, unmatched=4, repeats=3)
    for _, f, _, *event in events(5, 10_000):
        sessions.hot_start_frame(objects, pairs, f, dict(zip(sessions._HotStart.columns, event)), rules)
        if f > 500:
            most = max(most, len(objects) + len(pairs))
    assert len(objects) < 60 and most < 150


def test_idle_sessions_close(spark, tmp_path):
    """Frames that wait for a missing one go out when event time has moved on."""
    none = [None] * 7
    rows = [(1, 0, at(0), [4], *none[1:]), (1, 2, at(2), *none), (2, 0, at(0), *none), (2, 1, at(9000), *none), (2, 2, at(19000), *none), (2, 3, at(29000), *none)]
    with sessions.typed_state(spark):
        got = runs.run_available(sessions.hot_start(grown(spark, tmp_path, rows, 1), "k", "frame", "at", sessions.Rules(), late="1 second", idle=60), "idle").collect()
    assert {r.frame for r in got if r.k == 1} == {0, 2}
    # Session 2 was closed and began anew: its next frames are numbered on, so they wait or count as new.
    assert {r.frame for r in got if r.k == 2} >= {0}


OUTPUT = "k bigint, frame bigint, at timestamp, objects array<bigint>, removed array<bigint>, last boolean"


@pytest.mark.parametrize("cut", [100, 7])
def test_delayed_output(spark, tmp_path, cut):
    r = random.Random(4)
    rows = [(k, f, at(f), [f, f + 1, f + 2], [f + r.choice([0, 1])] if r.random() < 0.3 else None, f == 29) for k in (1, 2) for f in range(30)]
    with sessions.typed_state(spark):
        got = runs.run_available(sessions.delayed_output(grown(spark, tmp_path, sorted(rows, key=lambda x: (x[1], x[0])), cut, OUTPUT), "k", "frame", "at", delay=5), "delay").collect()
    want = {}
    for k, f, _, objects, _, _ in rows:
        end = min(f + 4, 29)
        gone = {o for kk, g, _, _, removed, _ in rows if kk == k and g <= end for o in removed or []}
        want[k, f] = end, [o for o in objects if o not in gone]
    assert {(x.k, x.frame): (x.emitted_at, x.objects) for x in got} == want and len(got) == 60
