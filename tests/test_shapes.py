"""Rotated boxes and transform chains against hand-worked and step-by-step versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import rotated as Q
from quillon.operators import transforms as T


def test_rotated_overlap(spark):
    """An upright square, one turned by 45 degrees around the same centre, a long bar across, strangers and nothing."""
    rows = [
        (0, (0.0, 0.0, 2.0, 2.0, 0.0), (0.0, 0.0, 2.0, 2.0, 45.0), 8 * (math.sqrt(2) - 1)),  # an octagon
        (1, (0.0, 0.0, 10.0, 2.0, 30.0), (0.0, 0.0, 10.0, 2.0, 120.0), 4.0),  # a cross
        (2, (1.0, 1.0, 2.0, 2.0, 0.0), (2.0, 2.0, 2.0, 2.0, 90.0), 1.0),
        (3, (0.0, 0.0, 2.0, 2.0, 10.0), (9.0, 0.0, 2.0, 2.0, 70.0), 0.0),
        (4, (0.0, 0.0, 4.0, 4.0, 0.0), (0.5, 0.5, 1.0, 1.0, 33.0), 1.0),  # inside
        (5, (0.0, 0.0, -1.0, 2.0, 0.0), (0.0, 0.0, 1.0, 2.0, 0.0), 0.0),
        (6, (3.0, 2.0, 5.0, 1.0, 17.0), (3.0, 2.0, 5.0, 1.0, 17.0 + 360), 5.0),
        (7, (2.0, 0.0, 2.0, 2.0, 0.0), (0.0, 0.0, 2.0, 2.0, 0.0), 0.0),  # touch
        (8, None, (0.0, 0.0, 1.0, 1.0, 0.0), None),
    ]
    kind = "struct<cx: double, cy: double, w: double, h: double, angle: double>"
    df = spark.createDataFrame([r[:3] for r in rows], f"i int, a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    got = {r.i: r for r in df.select("i", Q.intersection(a, b).alias("n"), Q.intersection(b, a).alias("back"), Q.iou(a, b).alias("iou"), Q.upright(b).alias("up")).collect()}
    for i, _, _, n in rows:
        assert got[i].n == (None if n is None else pytest.approx(n, abs=1e-9)) and got[i].back == (None if n is None else pytest.approx(n, abs=1e-9))
    assert got[2].iou == pytest.approx(1 / 7) and got[6].iou == pytest.approx(1.0) and got[5].iou == 0 and got[8].iou is None
    assert got[7].up and not got[0].up


def test_rotated_like_upright_and_scaled(spark):
    r = random.Random(2)
    rows = [tuple(r.uniform(0, 20) for _ in range(8)) for _ in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double, u double, v double, p double, q double")
    one, two = B.from_cxcywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")), B.from_cxcywh(F.col("u"), F.col("v"), F.col("p"), F.col("q"))
    ra, rb = (Q.rotated(*[F.col(c) for c in cs], F.lit(0.0)) for cs in ("xywh", "uvpq"))
    for row in df.select(B.iou(one, two).alias("want"), Q.iou(ra, rb).alias("got"), Q.bounds(ra).alias("bounds"), one.alias("box")).collect():
        assert row.got == pytest.approx(row.want, abs=1e-9) and tuple(row.bounds) == pytest.approx(tuple(row.box))
    turned = Q.rotated(F.lit(4.0), F.lit(2.0), F.lit(6.0), F.lit(2.0), F.lit(90.0))
    (row,) = spark.range(1).select(Q.scaled(turned, F.lit(2.0), F.lit(3.0)).alias("s"), Q.wrapped(F.lit(270.0)).alias("w")).collect()
    assert (row.s.cx, row.s.cy, row.s.w, row.s.h, row.s.angle) == pytest.approx((8, 6, 18, 4, 90)) and row.w == -90


def stepped(ops: list[tuple], w: float, h: float, b: tuple) -> tuple:
    """A box taken through the operations one by one."""
    x1, y1, x2, y2 = b
    x1, x2, y1, y2 = max(0, min(w, x1)), max(0, min(w, x2)), max(0, min(h, y1)), max(0, min(h, y2))
    for kind, *v in [("none",), *ops]:
        if kind == "crop":
            t, l, nh, nw = v
            x1, x2, y1, y2 = (max(0, min(nw, x1 - l)), max(0, min(nw, x2 - l)), max(0, min(nh, y1 - t)), max(0, min(nh, y2 - t)))
            w, h = nw, nh
        elif kind == "flip":
            x1, x2 = w - x2, w - x1
        elif kind == "resize":
            nh, nw = v
            x1, x2, y1, y2, w, h = x1 * nw / w, x2 * nw / w, y1 * nh / h, y2 * nh / h, nw, nh
        elif kind == "pad":
            l, t, r, d = v
            x1, x2, y1, y2, w, h = x1 + l, x2 + l, y1 + t, y2 + t, w + l + r, h + t + d
        if x2 <= x1 or y2 <= y1:
            return None, None
    return (x1, y1, x2, y2), (w, h)


def test_chains_in_any_order(spark):
    r = random.Random(7)
    make = {"crop": T.crop, "flip": lambda: T.flip(), "resize": T.resize, "pad": T.pad}
    draw = {"crop": lambda: [r.randint(0, 20), r.randint(0, 20), r.randint(20, 60), r.randint(20, 60)], "flip": list, "resize": lambda: [r.randint(10, 90), r.randint(10, 90)], "pad": lambda: [r.randint(0, 9) for _ in range(4)]}
    for _ in range(12):
        ops = [(k, *draw[k]()) for k in r.choices(list(make), k=r.randint(0, 6))]
        rows = [tuple(sorted(r.uniform(-20, 120) for _ in range(2)) + sorted(r.uniform(-20, 120) for _ in range(2))) for _ in range(8)]
        df = spark.createDataFrame([(x1, y1, x2, y2) for x1, x2, y1, y2 in rows], "x1 double, y1 double, x2 double, y2 double")
        m = T.composed(T.chain(*[make[k](*v) for k, *v in ops]) if ops else F.array().cast("array<struct<kind: string, a: double, b: double, c: double, d: double>>"), 100, 80)
        b = F.struct("x1", "y1", "x2", "y2")
        df = df.withColumn("m", m)
        p = T.map_point(F.col("m"), F.col("x1"), F.col("y1"))
        for row in df.select("x1", "y1", "x2", "y2", "m", T.map_box(F.col("m"), b).alias("o"), T.inverse_point(F.col("m"), p["x"], p["y"]).alias("back")).collect():
            want, size = stepped(ops, 100, 80, (row.x1, row.y1, row.x2, row.y2))
            assert (row.o is None) == (want is None) and (want is None or tuple(row.o) == pytest.approx(want))
            assert size is None or (row.m.w, row.m.h) == pytest.approx(size)
            assert (row.back.x, row.back.y) == pytest.approx((row.x1, row.y1))


def test_shorter_side(spark):
    sizes = [(100, 80, 40, None), (80, 100, 40, None), (100, 80, 80, None), (100, 20, 40, 90), (50, 50, 25, 10), (33, 100, 20, 50)]

    def wanted(w, h, size, most):
        low, high = min(w, h), max(w, h)
        if most is not None and high / low * size > most:
            size = most * low / high
        return (w, h) if low == size else (round(size * w / low), round(size * h / low))

    for w, h, size, most in sizes:
        (row,) = spark.range(1).select(T.composed(T.chain(T.resize_shorter(size, most)), w, h).alias("m")).collect()
        assert (row.m.w, row.m.h) == wanted(w, h, size, most)


def test_draws(spark):
    df = spark.range(4000).withColumns({"point": F.floor(F.col("id") / 4), "u": T.drawn(1, "flip", F.floor(F.col("id") / 4)), "v": T.drawn(1, "flip", F.col("id")), "n": T.drawn_between(T.drawn(2, "size", F.col("id")), 3, 6)})
    rows = df.collect()
    assert len({r.u for r in rows}) == 1000 and len({r.v for r in rows}) == 4000
    assert {r.n for r in rows} == {3, 4, 5, 6} and abs(sum(r.v for r in rows) / 4000 - 0.5) < 0.03
    assert [r.u for r in rows] == [r.u for r in df.repartition(3).orderBy("id").collect()]


def test_points_leave_with_the_crop(spark):
    df = spark.createDataFrame([(5.0, 5.0), (30.0, 5.0)], "x double, y double").withColumn("m", T.composed(T.chain(T.crop(0, 0, 20, 20), T.flip(), T.pad(10, 0, 0, 0)), 100, 80))
    got = [(r.p.x, r.p.y, r.p.visible) for r in df.select(T.map_point(F.col("m"), F.col("x"), F.col("y")).alias("p")).collect()]
    assert got == [(25.0, 5.0, True), (0.0, 5.0, False)]


def test_structure(spark, monkeypatch):
    from quillon.operators import structure as G

    monkeypatch.setattr(G, "HELD", 2)
    docs = ['{"a": [1, 2.5, null, {"b": "xyz"}], "c": {}}', '{"a": [], "d": true}', "[]", "{broken", None, '"text"', '{"a": null}', "[" * 3000 + "]" * 3000, "[" * 200_000 + "]" * 200_000]
    df = spark.createDataFrame([(d, 1) for d in docs], "j string, path int")
    got = {(r.path, r.kind): (r.n, r.least, r.most, r.total) for r in G.sketch(df, "j").collect() if "[][]" not in r.path}
    assert got == {
        ("$", "object"): (3, 1, 2, 5), ("$", "array"): (2, 0, 1, 1), ("$", "text"): (1, 4, 4, 4), ("$", "invalid"): (2, None, None, None), ("$", "missing"): (1, None, None, None), ("$[]", "array"): (1, 1, 1, 1),
        ("$.a", "array"): (2, 0, 4, 4), ("$.a", "null"): (1, None, None, None), ("$.a[]", "integer"): (1, None, None, None), ("$.a[]", "number"): (1, None, None, None), ("$.a[]", "null"): (1, None, None, None), ("$.a[]", "object"): (1, 1, 1, 1),
        ("$.a[].b", "text"): (1, 3, 3, 3), ("$.c", "object"): (1, 0, 0, 0), ("$.d", "boolean"): (1, None, None, None),
    }
    half = G.merged(G.sketch(df.where("j LIKE '{%'"), "j").unionByName(G.sketch(df.where("j NOT LIKE '{%' OR j IS NULL"), "j")))
    assert sorted(map(tuple, half.collect()), key=str) == sorted(map(tuple, G.sketch(df, "j").collect()), key=str)
    out = {r.path: r for r in G.summary(G.sketch(df, "j")).collect()}
    assert out["$.a"].kinds == ["array", "null"] and out["$.a"].null_share == pytest.approx(1 / 3) and out["$.a"].present_share == 1.0 and out["$.d"].present_share == pytest.approx(1 / 3)
    assert G.sketch(df.limit(0), "j").count() == 0
