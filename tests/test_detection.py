"""Suppression, assignment and metrics against straightforward versions."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import masks as M
from quillon.operators import filters, matching, metrics, suppression, tracks


def test_best_assignment_is_optimal():
    r = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 5), (5, 2), (4, 4), (3, 6), (6, 3)]:
        for _ in range(20):
            w = np.round(r.random((n, m)), 1)
            rows = matching.best_assignment(w)
            got = sum(w[i, c] for i, c in enumerate(rows) if c >= 0)
            small = w if n <= m else w.T
            best = max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
            assert np.isclose(got, best) and len({c for c in rows if c >= 0}) == min(n, m)


def _random_boxes(seed: int, n: int, groups: int = 3) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.random() * 60, r.random() * 60
        out.append((i, i % groups, round(r.random(), 1), (x, y, x + 5 + r.random() * 30, y + 5 + r.random() * 30)))
    return out


def _iou(a, b):
    i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0.0


@pytest.mark.parametrize("cell", [None, 7.0, 200.0])
def test_nms(spark, cell):
    rows = _random_boxes(5, 90)
    df = spark.createDataFrame([(i, g, s, *b) for i, g, s, b in rows], "id bigint, g int, score double, x1 double, y1 double, x2 double, y2 double")
    df = df.select("id", "g", "score", F.struct("x1", "y1", "x2", "y2").alias("b"))
    r = suppression.ranked(df, ["g"], "score", ["id"])
    found = suppression.conflicts(r, ["g"], "id", "rank", "b", B.iou, 0.3, cell=cell)
    order = sorted(rows, key=lambda x: (-x[2], x[0]))
    fast, greedy = set(), []
    for k, (i, g, _, b) in enumerate(order):
        better = [o for o in order[:k] if o[1] == g and _iou(o[3], b) > 0.3]
        if not better:
            fast.add(i)
        if not any(o[0] in greedy for o in better):
            greedy.append(i)
    assert {x.id for x in suppression.fast_nms(r, ["g"], "id", found).collect()} == fast
    assert {x.id for x in suppression.greedy_nms(r, ["g"], "id", "rank", found).collect()} == set(greedy) != fast


def test_track_nms_nulls_suppressed_tracks(spark):
    same = (0.0, 0.0, 10.0, 10.0)
    rows = [("v", 1, 0, same), ("v", 1, 1, same), ("v", 2, 0, same), ("v", 2, 1, None), ("v", 3, 0, (50.0, 50.0, 60.0, 60.0)), ("v", 4, 0, None)]
    df = spark.createDataFrame(rows, "v string, track int, t int, b struct<x1: double, y1: double, x2: double, y2: double>")
    scores = spark.createDataFrame([("v", 1, 0.9), ("v", 2, 0.8), ("v", 3, 0.1), ("v", 4, 1.0)], "v string, track int, score double")
    out = suppression.track_nms(df, scores, ["v"], "track", "t", "b", "score", B.intersection, B.area, 1.0)
    assert sorted((r.track, r.t, r.b is not None) for r in out.collect()) == [(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, False), (3, 0, True), (4, 0, False)]


def _sequence(seed: int, n_t: int = 8) -> tuple[list, list, list]:
    r = random.Random(seed)
    g, k, s = [], [], []
    for t in range(n_t):
        gs, ks = [x for x in range(4) if r.random() < 0.7], [x for x in range(5) if r.random() < 0.6]
        g += [(seed, t, x) for x in gs]
        k += [(seed, t, x) for x in ks]
        s += [(seed, t, a, b, r.random()) for a in gs for b in ks if r.random() < 0.5]
    return g, k, s


def _assigned(g, k, s, t, align):
    rows, cols = sorted({x[2] for x in g if x[1] == t}), sorted({x[2] for x in k if x[1] == t})
    sim = {(a, b): v for _, tt, a, b, v in s if tt == t}
    if not rows or not cols:
        return []
    w = np.array([[align.get((a, b), 0) * sim.get((a, b), 0) for b in cols] for a in rows])
    best = max(permutations(range(max(len(rows), len(cols))), len(rows)), key=lambda p: sum(w[i, c] for i, c in enumerate(p) if c < len(cols)))
    return [(rows[i], cols[c], sim[rows[i], cols[c]]) for i, c in enumerate(best) if c < len(cols) and w[i, c] > 0]


def _hota(g, k, s):
    times, pot, ng, nk = range(8), defaultdict(float), defaultdict(int), defaultdict(int)
    for _, _, a in g:
        ng[a] += 1
    for _, _, b in k:
        nk[b] += 1
    for t in times:
        here = [(a, b, v) for _, tt, a, b, v in s if tt == t]
        for a, b, v in here:
            below = sum(x[2] for x in here if x[0] == a) + sum(x[2] for x in here if x[1] == b) - v
            pot[a, b] += v / below
    align = {(a, b): p / (ng[a] + nk[b] - p) for (a, b), p in pot.items()}
    matched = [m for t in times for m in _assigned(g, k, s, t, align)]
    out = {}
    for alpha in metrics.HOTA_LEVELS:
        hit = [m for m in matched if m[2] >= alpha - metrics.EPS]
        count = defaultdict(int)
        for a, b, _ in hit:
            count[a, b] += 1
        tp = len(hit)
        ass = sum(c * c / max(1, ng[a] + nk[b] - c) for (a, b), c in count.items()) / max(1, tp)
        out[round(alpha, 2)] = (tp, len(g) - tp, len(k) - tp, max(1e-10, sum(m[2] for m in hit)) / max(1e-10, tp), ass)
    return out


def test_hota_against_direct_version(spark):
    seqs = [_sequence(i) for i in range(4)]
    only_truth = [(9, 0, 1), (9, 1, 1)]
    g = [x for q in seqs for x in q[0]] + only_truth
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((g, "seq int, t int, gt int"), ([x for q in seqs for x in q[1]] + [(10, 0, 3)], "seq int, t int, trk int"), ([x for q in seqs for x in q[2]], "seq int, t int, gt int, trk int, sim double"))]
    got = {(r.seq, round(r.alpha, 2)): (r.tp, r.fn, r.fp, r.loc_a, r.ass_a) for r in metrics.hota_sequences(*frames, ["seq"]).collect()}
    assert len(got) == 6 * 19
    for i, q in enumerate(seqs):
        for alpha, want in _hota(*q).items():
            assert got[i, alpha] == pytest.approx(want), (i, alpha)
    assert got[9, 0.5] == (0, 2, 0, 1.0, 0.0) and got[10, 0.5] == (0, 0, 1, 1.0, 0.0)


def test_phrase_metrics(spark):
    units = spark.createDataFrame([(1,), (2,), (3,), (4,)], "u int")
    g = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "u int, gt int")
    d = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "u int, dt int")
    o = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7)], "u int, gt int, dt int, iou double")
    rows = {(r.u, round(r.threshold, 2)): r for r in metrics.phrase_units(units, g, d, o, ["u"]).collect()}
    # 0.8 + 0.7 beats 0.9 alone.
    assert [rows[1, x].tp for x in (0.5, 0.75, 0.85)] == [2, 1, 0] and rows[2, 0.5].fn == 1 and rows[3, 0.5].fp == 1 and rows[4, 0.5].f1 is None
    s = {round(r.threshold, 2): r for r in metrics.phrase_summary(metrics.phrase_units(units, g, d, o, ["u"])).collect()}[0.5]
    assert (s.tp, s.fp, s.fn, s.positive_fp) == (2, 1, 1, 0) and s.macro_f1 == pytest.approx(rows[1, 0.5].f1 + rows[2, 0.5].f1) and s.il_mcc == pytest.approx(0, abs=1e-6)


def test_best_annotator_rules(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.7), (2, 0, 0.9), (2, 1, None), (2, 2, 0.95), (3, 0, None), (3, 1, None)]
    df = spark.createDataFrame(rows, "u int, a int, f1 double")
    assert {r.u: r.a for r in metrics.best_annotator(df, ["u"], "a").collect()} == {1: 1, 2: 1, 3: 1}


def test_greedy_match_protocol(spark):
    truth = spark.createDataFrame([(1, 10, False, False), (1, 11, True, True), (2, 12, False, False)], "i int, gt int, ignore boolean, crowd boolean")
    found = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.6), (2, 5, 0.5)], "i int, det int, score double")
    over = spark.createDataFrame([(1, 10, 1, 0.6), (1, 10, 2, 0.9), (1, 11, 2, 0.8), (1, 11, 3, 0.7)], "i int, gt int, det int, iou double")
    got = {(r.det): (r.hit, r.ignored) for r in matching.greedy_match(truth, found, over, ["i"], [0.5]).collect()}
    # The best detection takes ground truth 10; the next two fall to the crowd; the fourth and the other image's miss.
    assert got == {1: (True, False), 2: (True, True), 3: (True, True), 4: (False, False), 5: (False, False)}
    assert {r.det for r in matching.greedy_match(truth, found, over, ["i"], [0.5], 2).collect()} == {1, 2, 5}


def test_masks_round_trip(spark):
    r = random.Random(7)
    rows = [(i, [int(r.random() < 0.4) for _ in range(r.randint(1, 60))]) for i in range(30)] + [(99, [1, 1, 1]), (98, [0])]
    df = spark.createDataFrame(rows, "id int, bits array<int>").withColumn("runs", M.encode_bits(F.col("bits"))).withColumn("text", M.encode_text("runs")).withColumn("back", M.decode_text("text"))
    for x in df.withColumn("area", M.area(F.col("runs"))).collect():
        flat = [v for i, n in enumerate(x.runs) for v in [i % 2] * n]
        assert flat == x.bits and x.back == x.runs and x.area == sum(x.bits)
    big = spark.createDataFrame([([0, 5, 100_000, 3, 70_000, 1],)], "runs array<bigint>").withColumn("text", M.encode_text("runs"))
    assert big.select(M.decode_text("text").alias("x")).first().x == [0, 5, 100_000, 3, 70_000, 1]


def test_mask_bounds(spark):
    # 4 rows, 5 columns, column-major: rows 1-2 of columns 1-3.
    bits = [0] * 20
    for c in (1, 2, 3):
        for y in (1, 2):
            bits[c * 4 + y] = 1
    df = spark.createDataFrame([(bits,), ([0] * 20,)], "bits array<int>").withColumn("runs", M.encode_bits(F.col("bits")))
    assert [r.b for r in df.select(M.bounds(F.col("runs"), F.lit(4)).alias("b")).collect()] == [[1, 1, 3, 2], None]


def test_tracks_and_frames(spark):
    rows = [("v", 1, 0, [1.0, 1.0, 2.0, 2.0], "m", 0.5, "a"), ("v", 1, 2, [3.0, 1.0, 2.0, 2.0], "n", 0.7, "b"), ("v", 2, 1, [0.0, 0.0, 1.0, 1.0], "o", 0.9, "c")]
    f = spark.createDataFrame(rows, "v string, k int, t int, box array<double>, mask string, score double, label string")
    t = {r.k: r for r in tracks.tracks_of(f, spark.createDataFrame([("v", 3)], "v string, n_frames int"), "v", "k", "t", "box", "mask", "score", "label").collect()}
    assert t[1].boxes == [[1.0, 1.0, 2.0, 2.0], [0.0] * 4, [3.0, 1.0, 2.0, 2.0]] and t[1].masks == ["m", None, "n"] and t[1].label == "a" and t[1].score == pytest.approx(0.6) and t[2].frame_scores == [-1e8, 0.9, -1e8]
    back = tracks.found_frames(spark.createDataFrame([("v", 1, [[1.0, 1.0, 2.0, 2.0], [0.0] * 4, None], [None, 5.0, None])], "v string, k int, box array<array<double>>, area array<double>"), ["v"], "box", "area")
    assert [(r.t, r.area) for r in back.collect()] == [(0, 4.0)]


def test_cascade_filter(spark):
    q = spark.createDataFrame([("d", 1, 0, 0, [0, 1], True), ("d", 2, 2, 1, [0], True), ("d", 3, 1, 1, [1], False), ("e", 4, 0, 0, [0], False), ("e", 5, 1, 0, [0], True)], "dp string, query int, stage int, image int, objects array<int>, ok boolean")
    o = spark.createDataFrame([("d", 0, 0, "x"), ("d", 0, 1, "y"), ("d", 1, 0, "z"), ("d", 1, 1, "w"), ("e", 0, 0, "u")], "dp string, image int, object int, name string")
    i = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("e", 0)], "dp string, image int")
    a, b, c = filters.cascade_filter(q, o, i, F.col("ok"), F.col("name") == "x")
    assert sorted((r.query, r.stage, r.image, r.objects) for r in a.collect()) == [(1, 0, 0, [0]), (2, 1, 1, [0])]
    assert sorted((r.image, r.object, r.name) for r in b.collect()) == [(0, 0, "y"), (1, 0, "z")] and sorted(r.image for r in c.collect()) == [0, 1]


def test_zero_boxes_become_null(spark):
    df = spark.createDataFrame([([[0.0] * 4, [1.0, 1.0, 2.0, 2.0], None], ["a", "b", "c"], [3.0, 4.0, 5.0])], "b array<array<double>>, m array<string>, a array<double>")
    r = filters.null_empty_boxes(df, "b", "m", "a").first()
    assert (r.b, r.m, r.a) == ([None, [1.0, 1.0, 2.0, 2.0], None], [None, "b", None], [None, 4.0, None])


def test_best_annotator_of_equal_means_in_any_order(spark):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last bit.
    level = {0.5: 0.1, 0.6: 0.2, 0.7: 0.3}
    rows = [(1, 2, t, level[t]) for t in (0.5, 0.6, 0.7)] + [(1, 1, t, level[t]) for t in (0.7, 0.6, 0.5)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "u int, a int, threshold double, f1 double").coalesce(1)
        assert {r.a for r in metrics.best_annotator(df, ["u"], "a").collect()} == {1}
