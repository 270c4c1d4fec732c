"""Sampled points, combined association, and readers' small joins against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_runs import distances, images, points, relation

from quillon.functions import boxes as B
from quillon.operators import matching as H
from quillon.operators import mask_evaluation as M
from quillon.operators import points as P
from quillon.sources import annotations as A

SIZE = (9, 11)


def drawn(df) -> dict:
    out: dict = {}
    for r in df.collect():
        assert r.i not in out.setdefault(r.id, {})
        out[r.id][r.i] = r.x, r.y, r.positive
    return out


def test_points_from_masks(spark):
    masks = images(*SIZE)
    segs, every = relation(spark, masks)
    got = drawn(P.sampled(segs, ["id"], 20, "random_mask", 3))
    assert got.keys() == {i for i, m in masks.items() if m.any()}
    assert all(len(p) == 20 and {(y, x) for x, y, _ in p.values()} <= points(masks[i]) for i, p in got.items())
    full = len(masks) - 1  # sets every pixel: all are equally likely
    many = drawn(P.sampled(segs.where(f"id = {full}"), ["id"], 4000, "random_mask", 3))[full]
    counts = np.bincount([x * SIZE[0] + y for x, y, _ in many.values()], minlength=SIZE[0] * SIZE[1])
    assert counts.min() > 15 and counts.max() < 75
    assert drawn(P.sampled(segs.repartition(5), ["id"], 20, "random_mask", 3)) == got != drawn(P.sampled(segs, ["id"], 20, "random_mask", 4))


def test_points_from_boxes(spark):
    masks = images(*SIZE)
    segs, every = relation(spark, masks)
    boxes = every.withColumn("box", B.box(F.lit(1.2), F.lit(0.0), F.lit(5.0), F.lit(3.1))).unionByName(spark.createDataFrame([(99,)], "id long").withColumn("box", B.box(F.lit(2.2), F.lit(0.0), F.lit(2.9), F.lit(3.0))))
    got = drawn(P.sampled(segs, ["id"], 9, "random_box", 1, boxes))
    assert got.keys() == masks.keys()  # the last box spans no whole pixel
    for i, p in got.items():
        assert len(p) == 9 and all(2 <= x < 5 and 0 <= y < 4 and hit == bool(masks[i][y, x]) for x, y, hit in p.values())
    for mode in ("random_box", "other"):
        with pytest.raises(ValueError, match=mode):
            P.sampled(segs, ["id"], 1, mode)


def test_centered_points(spark):
    masks = {i: m for i, m in images(*SIZE, n=5).items()}
    segs, _ = relation(spark, masks)
    got = drawn(P.sampled(segs, ["id"], 3, "centered"))
    for i, m in masks.items():
        m = m.copy()
        for k in range(3):
            if not m.any():
                assert k not in got.get(i, {})
                break
            _, (y, x) = max((d, (-y, -x)) for (y, x), d in distances(m).items())
            assert got[i][k] == (-x, -y, True)
            m[-y, -x] = False


def test_points_from_errors(spark):
    a, b = images(*SIZE), images(*SIZE, seed=5)
    b[2], b[13] = a[2], a[13]  # nothing wrong; nothing wrong, and nothing outside
    (sa, every), (sb, _) = relation(spark, a), relation(spark, b)
    got = drawn(P.from_errors(sa, sb, every, ["id"], 12, 1, *SIZE))
    assert got.keys() == a.keys() - {13}
    for i, p in got.items():
        wrong = points(a[i] ^ b[i])
        for x, y, positive in p.values():
            assert ((y, x) in wrong and positive == bool(a[i][y, x])) if wrong else (not a[i][y, x] and not positive)


def test_mask_boxes(spark):
    masks = images(*SIZE)
    segs, every = relation(spark, masks)
    near, far = ({r.id: r.box for r in P.mask_boxes(segs, every, ["id"], e).collect()} for e in (False, True))
    for i, m in masks.items():
        ys, xs = np.nonzero(m)
        assert near[i] == ([xs.min(), ys.min(), xs.max(), ys.max()] if m.any() else None)
        assert far[i] == ([xs.min(), ys.min(), xs.max() + 1, ys.max() + 1] if m.any() else None)


def test_box_functions(spark):
    b = B.box(F.lit(2.0), F.lit(4.0), F.lit(6.0), F.lit(10.0))
    (r,) = spark.range(1).select(B.edge_distances(b, F.lit(3.0), F.lit(11.0)).alias("d"), B.rescaled(b, 2.0).alias("free"), B.rescaled(b, 2.0, F.lit(7), F.lit(9)).alias("cut")).collect()
    assert r.d == [1.0, 7.0, 3.0, -1.0] and tuple(r.free) == (0.0, 1.0, 8.0, 13.0) and tuple(r.cut) == (0.0, 1.0, 7.0, 9.0)


def test_associate_both(spark):
    dets = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.8), (2, 1, 0.1), (3, 1, 0.1)], "f int, det int, score double")
    tracks = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (4, 7)], "f int, trk int")
    pairs = spark.createDataFrame([(1, 1, 7, 0.8), (1, 1, 8, 0.75), (1, 2, 7, 0.7), (1, 3, 8, 0.1), (2, 1, 7, 0.4)], "f int, det int, trk int, iou double")
    fresh, lost, many, one = (sorted(map(tuple, x.collect())) for x in H.associate_both(dets, tracks, pairs, ["f"], 0.5, 0.72, 0.5))
    assert fresh == [(1, 3), (3, 1)]  # of frame 2 the score is too low; frame 3 has no tracks
    assert many == [(1, 1, 7, 0.8), (1, 1, 8, 0.75), (1, 2, 7, 0.7)]
    assert [(f, t, d) for f, t, d, *_ in one] == [(1, 7, 2), (1, 8, 1), (2, 7, 1)]  # 0.7 + 0.75 beats 0.8 + 0.1
    assert one[1][3:] == (0.75, 0.9, 0.9 * 0.75)
    assert lost == [(1, 7), (2, 7)]  # below 0.72; frame 4 has no detections


def test_failures_images_and_side_cars(spark):
    images_ = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_name string, n int")
    fine, bad = spark.createDataFrame([("a",), ("b",)], "file_name string"), spark.createDataFrame([("a",), (None,), ("a",)], "file_name string")
    assert sorted(r.file_name for r in A.without_failures(images_, fine, "file_name").collect()) == ["a", "b", "c"]
    assert sorted(r.file_name for r in A.without_failures(images_, bad, "file_name").collect()) == ["a"]
    chat = spark.createDataFrame([(1, [("image", "x"), ("text", "y")]), (1, None), (1, [("image", "z")]), (2, [])], "conv int, content array<struct<type: string, body: string>>")
    assert {r.conv: r.images for r in A.image_count(chat, ["conv"]).collect()} == {1: 2, 2: 0}
    points_ = spark.createDataFrame([(1, "v.mp4@3"), (2, "v.mp4@4"), (3, "i.jpg"), (4, "gone.jpg")], "id int, path string")
    files = spark.createDataFrame([("v.mp4", 10), ("i.jpg", 20)], "path string, length int")
    side = spark.createDataFrame([("v.mp4", 3, "m3"), ("i.jpg", None, "mi")], "path string, frame int, mask string")
    got = {r.id: (r.frame, r.length, r.mask, r.found) for r in A.with_side_car(points_, files, side, "path").collect()}
    assert got == {1: (3, 10, "m3", True), 2: (4, 10, None, True), 3: (None, 20, "mi", True), 4: (None, None, None, False)}


def test_tracks_of_masks(spark):
    """One object followed perfectly, one whose track changes, one missed: scores by hand."""
    m = {1: np.zeros((6, 6), bool), 2: np.zeros((6, 6), bool)}
    m[1][:2], m[2][3:5, :3] = True, True
    segs, _ = relation(spark, m)
    frames = spark.range(2).select(F.col("id").alias("t"))
    g = segs.crossJoin(frames).select(F.lit("v").alias("video"), "t", F.col("id").alias("gt"), "x", "y0", "y1", F.lit("c").alias("cls"))
    d = g.select("video", "t", F.when((F.col("gt") == 2) & (F.col("t") == 1), 9).otherwise(F.col("gt")).alias("trk"), "x", "y0", "y1", "cls")
    (h,) = M.hota(g, d, ["video"]).collect()
    assert h.det_a == pytest.approx(1.0) and h.ass_a == pytest.approx((1 + 1 + 0.5 + 0.5) / 4) and h.loc_a == pytest.approx(1.0)
    (t,) = M.teta(g, d, ["video"]).collect()
    assert t.loc_a == pytest.approx(1.0) and t.cls_a == pytest.approx(1.0) and t.assoc_a == pytest.approx(0.75)
    v = {(r.gt, r.trk): r.iou for r in M.volumes(g, d, ["video"]).collect()}
    assert v == {(1, 1): 1.0, (2, 2): 0.5, (2, 9): 0.5}
    scores = spark.createDataFrame([("v", "c", 1, 0.9), ("v", "c", 2, 0.8), ("v", "c", 9, 0.7)], "video string, cls string, trk long, score double")
    ap = {round(r.threshold, 2): r.ap for r in M.precision(g, d, scores, "video", "cls", {"all": (0, 1e10)}).collect()}
    assert ap[0.5] == pytest.approx(1.0) and ap[0.55] == pytest.approx(51 / 101)
    report = M.joined_report(spark, {"a": spark.createDataFrame([("x", 1.0)], "metric string, value double"), "b": spark.createDataFrame([("x", 2)], "metric string, value int")})
    assert sorted(map(tuple, report.collect())) == [("a", "x", 1.0), ("b", "x", 2.0)]
