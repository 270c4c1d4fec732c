"""Run relations against plain versions over arrays of pixels."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import runs as R

SIZES = [(7, 9), (1, 6), (6, 1), (70, 3)]
MASKS = "id bigint, x string, counts array<bigint>"


def encoded(mask: np.ndarray) -> list[int]:
    flat = mask.T.reshape(-1).astype(int)
    turns = np.flatnonzero(np.diff(flat)) + 1
    lengths = np.diff(np.concatenate([[0], turns, [len(flat)]])).tolist()
    return lengths if flat[0] == 0 else [0, *lengths]


def images(height: int, width: int, n: int = 12, seed: int = 0) -> dict[int, np.ndarray]:
    r = np.random.default_rng(seed + height * 31 + width)
    out = {i: r.random((height, width)) < p for i, p in enumerate(np.linspace(0.05, 0.95, n))}
    return {**out, n: np.zeros((height, width), bool), n + 1: np.ones((height, width), bool)}


def relation(spark, masks: dict[int, np.ndarray]):
    height, width = next(iter(masks.values())).shape
    table = spark.createDataFrame([(i, "x", encoded(m)) for i, m in masks.items()], MASKS).drop("x")
    return R.segments(table, ["id"], "counts", height, width), table.select("id")


def pixels(segs) -> dict[int, set]:
    out: dict = {}
    for r in segs.collect():
        for y in range(r.y0, r.y1):
            assert (y, r.x) not in out.setdefault(r.id, set())
            out[r.id].add((y, r.x))
    return out


def points(mask: np.ndarray) -> set:
    return set(zip(*(v.tolist() for v in np.nonzero(mask))))


def same(segs, masks: dict[int, np.ndarray]) -> None:
    assert pixels(segs) == {i: points(m) for i, m in masks.items() if m.any()}


def edges(m: np.ndarray) -> np.ndarray:
    right, below = np.concatenate([m[:, 1:], m[:, -1:]], 1), np.concatenate([m[1:], m[-1:]], 0)
    both = np.concatenate([below[:, 1:], below[:, -1:]], 1)
    return (m != right) | (m != below) | (m != both)


def grown(m: np.ndarray, r: int) -> np.ndarray:
    out = np.zeros_like(m)
    for y, x in points(m):
        out[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    return out


def parts(m: np.ndarray, corners: bool = True) -> list[set]:
    left, out = points(m), []
    while left:
        new, ahead = set(), [left.pop()]
        while ahead:
            y, x = ahead.pop()
            new.add((y, x))
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i * j]:
                if p in left:
                    left.remove(p)
                    ahead.append(p)
        out.append(new)
    return out


@pytest.mark.parametrize("size", SIZES)
def test_algebra_and_morphology(spark, size):
    a, b = images(*size), images(*size, seed=9)
    (sa, every), (sb, _) = relation(spark, a), relation(spark, b)
    same(sa, a)
    same(R.combined(sa, sb, ["id"], lambda p, q: p != q), {i: a[i] ^ b[i] for i in a})
    same(R.union(sa.unionByName(sb), ["id"]), {i: a[i] | b[i] for i in a})
    same(R.complement(sa, every, ["id"], *size), {i: ~a[i] for i in a})
    same(R.boundary(sa, ["id"], *size), {i: edges(a[i]) for i in a})
    same(R.dilated(sa, ["id"], 2, *size), {i: grown(a[i], 2) for i in a})
    assert {r.id: r.counts for r in R.to_counts(sa, every, ["id"], *size).collect()} == {i: [*encoded(m)] for i, m in a.items()}


def test_boundary_scores(spark):
    size = (9, 8)
    a, b = images(*size), images(*size, seed=4)
    (sa, every), (sb, _) = relation(spark, a), relation(spark, b)
    got = {r.id: (r.precision, r.recall, r.f) for r in R.boundary_scores(sa, sb, every, ["id"], *size, 1).collect()}
    for i in a:
        g, d = edges(a[i]), edges(b[i])
        if not g.any() or not d.any():
            p, r = (1.0, 1.0) if not g.any() and not d.any() else (1.0, 0.0) if not d.any() else (0.0, 1.0)
        else:
            p, r = (d & grown(g, 1)).sum() / d.sum(), (g & grown(d, 1)).sum() / g.sum()
        assert got[i] == pytest.approx((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    assert R.boundary_radius(1080, 1920) == 18


def test_jf_scores(spark):
    matched = spark.createDataFrame([(1, 10, 0.5), (1, 11, 1.0), (2, 12, 0.25)], "unit int, pair int, iou double")
    f = spark.createDataFrame([(10, 1.0), (11, 0.0), (12, 0.75), (13, 1.0)], "pair int, f double")
    got = {r.unit: (r.j, r.f, r.jf) for r in R.jf_scores(matched, f, ["pair"], ["unit"]).collect()}
    assert got[1] == pytest.approx((0.75, 0.5, 0.625)) and got[2] == pytest.approx((0.25, 0.75, 0.5))


@pytest.mark.parametrize("corners", [True, False])
@pytest.mark.parametrize("size", [(7, 9), (130, 4)])
def test_components(spark, size, corners):
    masks = images(*size, n=6)
    # A comb of long teeth joined at the far end: a chain through all columns.
    comb = np.zeros(size, bool)
    comb[:, ::2] = True
    comb[-1] = True
    masks[20] = comb
    segs, _ = relation(spark, masks)
    got: dict = {}
    for r in R.components(segs, ["id"], size[0], corners).collect():
        got.setdefault((r.id, r.label, r.size), set()).update((y, r.x) for y in range(r.y0, r.y1))
    want = {(i, min(x * size[0] + y for y, x in p), len(p)): p for i, m in masks.items() for p in parts(m, corners)}
    assert got == want


def test_components_of_split_runs(spark):
    """Runs without a gap between them are one component."""
    df = spark.createDataFrame([(1, "x", [1, 2, 0, 2, 1, 1])], MASKS)
    got = R.components(R.segments(df, ["id"], "counts", 7, 1), ["id"], 7).collect()
    assert {(r.y0, r.label, r.size) for r in got} == {(1, 1, 4), (3, 1, 4), (6, 6, 1)}


def test_components_over_batches(spark):
    """Masks that end anywhere in a batch, with a null among their keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(k, j, x, 0, 2) for k in (None, 1, 2) for j in (None, 3) for x in range(4)]
        df = spark.createDataFrame(rows, "k int, j int, x long, y0 long, y1 long")
        assert sorted(((r.k, r.j, r.label, r.size) for r in R.components(df, ["k", "j"], 9).select("k", "j", "label", "size").distinct().collect()), key=str) == sorted(((k, j, 0, 8) for k in (None, 1, 2) for j in (None, 3)), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_nothing(spark):
    segs, _ = relation(spark, {1: np.zeros((3, 3), bool)})
    assert R.components(segs, ["id"], 3).count() == 0


def test_specks(spark):
    size = (12, 11)
    masks = images(*size)
    segs, every = relation(spark, masks)
    want = {}
    for i, m in masks.items():
        m = m.copy()
        for p in parts(~m):
            if len(p) <= 3:
                m[tuple(zip(*p))] = True
        limit = min(m.sum() // 2, 3)
        for p in parts(m):
            if len(p) <= limit:
                m[tuple(zip(*p))] = False
        want[i] = m
    same(R.without_specks(segs, every, ["id"], *size, 3), want)
    assert R.without_specks(segs, every, ["id"], *size, 0) is segs


def distances(m: np.ndarray) -> dict:
    wide = np.pad(m, 1)
    zeros = np.argwhere(~wide)
    return {(y, x): int(((zeros - (y + 1, x + 1)) ** 2).sum(1).min()) for y, x in points(m)}


@pytest.mark.parametrize("size", SIZES)
def test_distances_and_error_points(spark, size):
    a, b = images(*size), images(*size, seed=7)
    (sa, every), (sb, _) = relation(spark, a), relation(spark, b)
    got: dict = {}
    for r in R.squared_distances(sa, ["id"]).collect():
        got.setdefault(r.id, {})[r.y, r.x] = r.d2
    assert got == {i: distances(m) for i, m in a.items() if m.any()}
    clicks = {r.id: (r.y, r.x, r.positive) for r in R.error_points(sa, sb, every, ["id"]).collect()}
    for i in a:
        deep = [max(((d, (-y, -x)) for (y, x), d in distances(m).items()), default=(0, (0, 0))) for m in (a[i] & ~b[i], b[i] & ~a[i])]
        d, (y, x) = deep[0] if deep[0][0] > deep[1][0] else deep[1]
        assert clicks[i] == (-y, -x, deep[0][0] > deep[1][0])


def filled(polygon: list[float], height: int, width: int) -> np.ndarray:
    p = [(int(x), int(y)) for x, y in zip(polygon[::2], polygon[1::2])]
    out = np.zeros((height, width), bool)
    for x in range(width):
        for side in (0, 1):
            ys = []
            for (xa, ya), (xb, yb) in zip(p, [*p[1:], p[0]]):
                low, high = min(xa, xb), max(xa, xb)
                if (low <= x < high) if side == 0 else (low < x <= high):
                    ys.append(ya + (x - xa) * (yb - ya) / (xb - xa))
                if xa == xb == x:
                    out[max(0, min(ya, yb)) : max(0, max(ya, yb) + 1), x] = True
            ys.sort()
            for lo, hi in zip(ys[::2], ys[1::2]):
                out[max(0, math.floor(lo + 0.5)) : max(0, math.ceil(hi - 0.5) + 1), x] = True
    return out


POLYGONS = [
    (1, [1.0, 1.0, 6.9, 1.2, 6.0, 5.0, 1.0, 5.0]),  # a rectangle, cut to whole pixels
    (2, [0.0, 0.0, 8.0, 3.0, 0.0, 7.0]),
    (3, [-4.0, 2.0, 20.0, -3.0, 5.0, 30.0]),  # beyond every edge of the image
    (4, [2.0, 1.0, 7.0, 6.0, 7.0, 1.0, 2.0, 6.0]),  # crosses itself
    (5, [3.0, 1.0, 3.0, 6.0, 3.0, 2.0]),  # a line along a column
    (6, [4.0, 4.0, 4.0, 4.0, 4.0, 4.0]),  # a point
    (7, [1.0, 2.0, 3.0, 4.0]),
    (8, None),
    (9, [1.0, None, 3.0, 4.0, 5.0, 6.0]),
    (10, [30.0, 30.0, 40.0, 30.0, 35.0, 40.0]),
]


def test_polygons(spark):
    df = spark.createDataFrame([(i, "x", p) for i, p in POLYGONS] * 2 + [(1, "x", [7.0, 6.0, 8.0, 6.0, 8.0, 7.0])], "id int, x string, points array<double>").withColumnRenamed("x", "label")
    want = {i: filled(p, 8, 9) for i, p in POLYGONS if p and len(p) >= 6 and None not in p}
    want[1] |= filled([7.0, 6.0, 8.0, 6.0, 8.0, 7.0], 8, 9)
    assert want[1][1:6, 1:7].all() and want[1].sum() == 30 + 3
    same(R.polygon_segments(df, ["id"], "points", 8, 9), want)


def test_items_fall_back(spark):
    rows = [(1, [4, 3, 100], POLYGONS[0][1], [0.0, 0.0, 9.0, 9.0]), (2, [], POLYGONS[1][1], [0.0, 0.0, 9.0, 9.0]), (3, None, [9.0, 9.0], [1.4, 2.5, 3.0, 2.0]), (4, None, None, [5.0, 5.0, -1.0, 2.0]), (5, None, None, None), (1, None, None, [8.0, 7.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "id int, counts array<int>, polygon array<double>, box array<double>")
    got = pixels(R.item_segments(df, ["id"], "counts", "polygon", "box", 8, 9))
    assert got[1] == {(4, 0), (5, 0), (6, 0), (7, 8)} and got[2] == points(filled(POLYGONS[1][1], 8, 9))
    assert got[3] == {(y, x) for y in (2, 3) for x in (1, 2, 3)} and set(got) == {1, 2, 3}


@pytest.mark.parametrize("new", [(3, 4), (20, 31), (7, 9)])
def test_resized(spark, new):
    masks = images(7, 9)
    segs, _ = relation(spark, masks)
    ys, xs = np.arange(new[0]) * 7 // new[0], np.arange(new[1]) * 9 // new[1]
    same(R.resized(segs, ["id"], 7, 9, *new), {i: m[np.ix_(ys, xs)] for i, m in masks.items()})


def test_overlaps(spark):
    a, b = images(70, 5, n=5), images(70, 5, n=5, seed=3)
    tag = lambda s, n: s.withColumnRenamed("id", n).withColumn("image", F.col(n) % 2)
    got = {(r.a, r.b): (r.shared, r.iou, r.iom) for r in R.overlaps(tag(relation(spark, a)[0], "a"), tag(relation(spark, b)[0], "b"), ["image"], "a", "b").collect()}
    want = {}
    for i in a:
        for j in b:
            n = int((a[i] & b[j]).sum())
            if n and i % 2 == j % 2:
                want[i, j] = n, n / (a[i] | b[j]).sum(), n / (min(a[i].sum(), b[j].sum()) + 1e-8)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_null_and_long_runs(spark):
    """Twice the runs cost no more than about twice the time: no prefix is summed anew, no array grows by copies."""
    df = spark.createDataFrame([(1, "x", None), (2, "x", []), (3, "x", [0, 0, 5])], MASKS)
    assert R.segments(df, ["id"], "counts", 5, 5).count() == 0
    took = []
    for n in (10_000, 40_000):
        row = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.expr(f"transform(sequence(1, {n}), i -> 1L + i % 3)").alias("counts"))
        total = sum(1 + i % 3 for i in range(1, n + 1))
        height, width = 100, -(-total // 100)
        segs = R.segments(row, ["id"], "counts", height, width)
        began = time.time()
        (back,) = R.to_counts(R.union(segs.unionByName(segs), ["id"]), row, ["id"], height, width).collect()
        took.append(time.time() - began)
        rest = height * width - total
        assert back.counts[:n] == [1 + i % 3 for i in range(1, n + 1)] and sum(back.counts) == height * width and rest < 100
    assert took[1] < 8 * took[0] + 2
