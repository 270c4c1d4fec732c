"""Selections and evaluation reports on small rows, with results worked out by hand or by a plain second version."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.operators import evaluation as V
from quillon.operators import metrics as E
from quillon.operators import selection as S
from quillon.sources import text_tables


def test_predicates_know_missing_values(spark):
    null = F.lit(None)
    got = spark.range(1).select(
        F.array(*[S.without_texts(t, ["x"]) for t in (F.lit("x"), F.lit("y"), null.cast("string"))]).alias("text"), F.array(S.without_geometry(null, null), S.without_geometry(null, F.lit(1))).alias("geometry"),
        F.array(*[S.few_targets(t, 1) for t in (F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)), null.cast("array<int>"))]).alias("targets"), F.array(*[S.strictly_true(t) for t in (F.lit(True), F.lit(False), null.cast("boolean"))]).alias("true"),
        F.array(*[S.recondition(*c) for c in ((F.lit(4), null.cast("double"), 4, 0.5), (F.lit(3), null.cast("double"), 4, 0.5), (F.lit(3), F.lit(0.4), 4, 0.5), (F.lit(3), F.lit(0.5), 0, 0.5))]).alias("anew"),
        S.scores_for(F.array(*map(F.lit, "abc")), F.array(F.lit(0.5))).alias("short"), S.scores_for(F.array(*map(F.lit, "ab")), null.cast("array<double>")).alias("none"), S.above(null.cast("array<double>"), 0.5).alias("above"),
    ).first().asDict()
    assert got == {"text": [False, True, True], "geometry": [True, False], "targets": [True, False, True], "true": [True, False, False], "anew": [True, False, True, False], "short": [0.5, 0, 0], "none": [1, 1], "above": 0}


@pytest.mark.parametrize("size", [3, 10_000])
def test_next_valid(spark, size):
    rows = [(i, True if i in (4, 5, 11) else None if i % 3 else False) for i in range(14)]
    df = spark.createDataFrame(rows, "i int, ok boolean")
    wanted = df.select("i", F.lit("x").alias("next_to")).union(spark.createDataFrame([(4, "y")], "i int, s string"))
    got = sorted((r.i, r.next) for r in S.next_valid(wanted, df, "i", "ok", size).collect())
    assert got == sorted([(i, next((v for v in (4, 5, 11) if v >= i), 4)) for i in range(14)] + [(4, 4)])
    assert {r.next for r in S.next_valid(wanted, df.where("NOT ok"), "i", "ok", size).collect()} == {None}
    assert S.next_valid(wanted.where("false"), df, "i", "ok", size).count() == 0


def test_strided_stages(spark):
    df = spark.createDataFrame([(g, s) for g, n in (("a", 9), ("b", 4), ("c", 2)) for s in range(n) for _ in range(2)], "g string, s int")
    got = {}
    for r in S.strided_stages(df.withColumn("was", F.col("s")), ["g"], "s", 3, 3).collect():
        got.setdefault(r.g, set()).add((r.s, r.was))
    for g, n in (("a", 9), ("b", 4)):
        step = min(3, (n - 1) // 2)
        u = int(hashlib.md5(f"0|{g}".encode()).hexdigest()[:8], 16) / 2**32
        start = int(u * (n - 1 - step * 2 + 1))
        assert got[g] == {(k, start + k * step) for k in range(3)}
    assert "c" not in got
    assert {r.was for r in S.strided_stages(df.where("g = 'c'").withColumn("was", F.col("s")), ["g"], "s", 1, 3).collect()} <= {0, 1}


def test_arrays_and_containers(spark):
    df = spark.createDataFrame([(1, [0.1, None, 0.9, 0.9], ["a", "b", "c", "d"]), (2, [], []), (3, None, ["z"])], "id int, s array<double>, n array<string>")
    got = {r.id: (r.s, r.n) for r in S.by_score(df, "s", ["n"]).collect()}
    assert got == {1: ([0.9, 0.9, 0.1, None], ["c", "d", "a", "b"]), 2: ([], []), 3: (None, ["z"])}
    d = spark.createDataFrame([(1, {"k": "a", "l": None}, ["x", "y"]), (2, None, None)], "id int, m map<string,string>, l array<string>")
    assert sorted(tuple(r) for r in S.items_of(d, ["id"], [("m", "p.m"), ("l", "o")]).collect()) == [(1, "o[0]", "x"), (1, "o[1]", "y"), (1, "p.m.k", "a")]


def test_fallback_only_without_any_region(spark):
    cells = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("b", 1, 8), ("c", 1, None)], "seg string, t int, stable int")
    regions = spark.createDataFrame([("a", 1, 5), ("b", 1, None)], "seg string, t int, region int")
    got = S.conditional_fallback(cells, regions, ["seg"], "t", "region", "stable").collect()
    assert sorted((r.seg, r.t, r.region, r.is_fallback) for r in got) == [("a", 1, 5, False), ("b", 1, 8, True)]


def test_boxes_stay_in_bounds_and_unknown_modes_fail(spark):
    df = spark.range(200).select("id", B.from_xywh(F.col("id") * 1.0, F.lit(0.0), F.lit(50.0), F.lit(10.0)).alias("b"))
    n = df.select("id", S.noised(F.col("b"), F.lit(220), F.lit(20), 0.1, 3.0, 5, F.col("id")).alias("n")).select("id", "n.*").collect()
    assert all(abs(r.x1 - r.id) <= 3 and abs(r.y2 - 10) <= 1 and 0 <= r.y1 <= 1 and r.x2 <= 220 for r in n) and len({r.x1 - r.id for r in n}) > 150
    with pytest.raises(Exception, match="unknown mode edge"):
        df.select(S.point_in(F.col("b"), F.lit("edge"), 1, F.col("id"))).collect()


@pytest.mark.parametrize("blocks", [2, 64])
def test_average_precision_in_ranges_of_scores(spark, blocks):
    """Against the plain running counts, with many equal scores, ignored rows and a category without detections."""
    r = np.random.default_rng(blocks)
    rows = [(c, float(np.round(r.random(), 2)), i, bool(r.random() < 0.5), bool(r.random() < 0.1)) for c in range(2) for i in range(400)]
    m = spark.createDataFrame(rows, "c int, score double, ord int, hit boolean, ignored boolean").withColumn("threshold", F.lit(0.5))
    n = spark.createDataFrame([(0, 300), (1, 230), (2, 5), (3, 0)], "c int, n int")
    got = {x.c: (x.ap, x.recall) for x in E.average_precision(m, n, ["c"], [0.5], blocks=blocks).collect()}
    assert set(got) == {0, 1, 2} and got[2] == (0, 0)
    for c, total in ((0, 300), (1, 230)):
        hits = np.array([h for _, _, _, h, _ in sorted((x for x in rows if x[0] == c and not x[4]), key=lambda x: (-x[1], x[2]))])
        tp, k = np.cumsum(hits), np.arange(1, len(hits) + 1)
        recall, precision = tp / total, np.maximum.accumulate((tp / k)[::-1])[::-1]
        at = np.searchsorted(recall, np.linspace(0, 1, 101) - 1e-11)
        assert got[c] == (pytest.approx(np.mean([precision[i] if i < len(hits) else 0 for i in at])), pytest.approx(recall[-1]))


def test_areas(spark):
    truth = spark.createDataFrame([(1, 0, False, False, 100.0), (1, 1, False, False, 16384.0), (1, 2, None, True, 100.0)], "i int, gt int, ignore boolean, crowd boolean, area double")
    found = spark.createDataFrame([(1, 0, 0.9, 100.0), (1, 1, 0.8, 20000.0), (1, 2, 0.7, 90000.0)], "i int, det int, score double, area double")
    over = spark.createDataFrame([(1, 0, 0, 0.8), (1, 1, 1, 0.6)], "i int, gt int, det int, iou double")
    got = {(r.area_range, r.det): (r.hit, r.ignored) for r in V.area_matches(truth, found, over, ["i"], thresholds=[0.5]).collect()}
    assert [got[a, 0] for a in ("all", "small", "medium")] == [(True, False), (True, False), (True, True)]
    # 16384 belongs to two ranges; what meets nothing counts in its own range only.
    assert [got[a, 1] for a in ("all", "small", "medium", "large")] == [(True, False), (True, False), (True, False), (True, True)]
    assert [got[a, 2] for a in ("all", "small", "medium", "large")] == [(False, False), (False, True), (False, True), (False, False)]
    assert {r.area_range: r.n for r in V.area_truths(truth, ["i"]).collect()} == {"all": 2, "small": 2, "medium": 1}


def test_csv_files(spark, tmp_path):
    (tmp_path / "index.csv").write_text('id,name,other\n1,"a ""b"", c",x\n2,"line\nend",\n3,,y\n')
    rows = text_tables.index_rows(spark, str(tmp_path / "index.csv"), ["id", "name", "lacking"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "b", c', None), ("2", "line\nend", None), ("3", None, None)]
    (tmp_path / "detailed.csv").write_text("seq,HOTA,IDF1\na,0.5,\nCOMBINED,0.75,0.25\n")
    each, whole = text_tables.detailed_rows(spark, str(tmp_path / "detailed.csv"), "seq")
    assert [tuple(r) for r in each.collect()] == [("a", 0.5, None)] and [tuple(r) for r in whole.collect()] == [(0.75, 0.25)]


def tracks(spark, rows, name):
    """Rows (video, cls, t, id, score, x): boxes ten wide and high."""
    df = spark.createDataFrame(rows, f"video int, cls int, t int, {name} int, score double, x double")
    return df.withColumn("box", F.when(F.col("x").isNotNull(), B.from_xywh(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(10.0)))).drop("x")


def test_suppression_strategies(spark):
    # Track 2 lies on 1 in all frames, 3 in one of two; 4 scores too low; 5 has no box in frame 1.
    at = {1: (0.0, 0.0), 2: (1.0, 1.0), 3: (2.0, 50.0), 4: (90.0, 90.0), 5: (70.0, None)}
    score = {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.2, 5: 0.6}
    found = tracks(spark, [(1, 0, t, k, score[k], x[t]) for k, x in at.items() for t in (0, 1)], "trk")
    got = lambda s: sorted((r.trk, r.t) for r in V.suppressed(found, ["video"], s, 0.5, 0.5).collect())
    assert got("none") == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (5, 0)]
    assert got("track") == [(1, 0), (1, 1), (3, 0), (3, 1), (5, 0)]
    assert got("frame") == [(1, 0), (1, 1), (3, 1), (5, 0)]
    with pytest.raises(ValueError, match="best"):
        V.suppressed(found, ["video"], "best", 0.5, 0.5)


def test_video_scores(spark):
    gt = [(v, v % 2, t, 1, 1.0, 20.0 * v) for v in range(3) for t in range(4)]
    truth = tracks(spark, gt, "gt").drop("score")
    same = tracks(spark, [(v, c, t, 7, 0.9, x) for v, c, t, _, _, x in gt], "trk")
    # A copy that is a little off makes each class imprecise until suppression takes it out.
    doubled = same.union(tracks(spark, [(v, c, t, 8, 0.6, x + 1) for v, c, t, _, _, x in gt], "trk"))
    scores = {s: V.video_teta(truth, doubled, ["video"], s).first() for s in ("none", "track")}
    assert scores["track"].teta == pytest.approx(1)
    assert scores["none"].loc_a == pytest.approx(0.5) and scores["none"].assoc_a == pytest.approx(1)

    found = doubled.withColumnRenamed("trk", "det")
    over = {(r.video, r.det): r.iou for r in V.volume_overlaps(truth, found, ["video", "cls"]).collect()}
    assert over == {(v, d): pytest.approx(1 if d == 7 else 90 / 110) for v in range(3) for d in (7, 8)}
    got = {(r.cls, r.area_range, r.threshold): (r.ap, r.recall_1) for r in V.video_precision(truth, found, "video", "cls", thresholds=[0.5, 0.95]).collect()}
    assert got == {(c, a, x): (pytest.approx(1), 1) for c in (0, 1) for a in ("all", "small") for x in (0.5, 0.95)}
    late = V.video_precision(truth, found.where("det = 8"), "video", "cls", thresholds=[0.5, 0.95]).collect()
    assert {(r.threshold, round(r.ap, 9)) for r in late} == {(0.5, 1.0), (0.95, 0.0)}


def test_flags_carry_all_ranges_in_one_row(spark):
    truth = spark.createDataFrame([(1, 0, False, False, 100.0), (2, 0, False, False, 20000.0)], "i int, gt int, ignore boolean, crowd boolean, area double")
    found = spark.createDataFrame([(1, 0, 0.9, 100.0), (1, 1, 0.8, 90000.0), (2, 0, 0.7, 20000.0)], "i int, det int, score double, area double")
    over = spark.createDataFrame([(1, 0, 0, 0.6), (2, 0, 0, 0.9)], "i int, gt int, det int, iou double")
    flags = V.area_flags(truth, found, over, ["i"], thresholds=[0.5, 0.75])
    # all, small, medium, large; two thresholds each.
    assert {(r.i, r.det): r.flags for r in flags.collect()} == {(1, 0): "21213030", (1, 1): "11000011", (2, 0): "22332233"}
    rows = flags.withColumn("cls", F.lit(0)).withColumn("ord", F.col("det"))
    got = {(r.area_range, r.threshold): (r.ap, r.recall_1) for r in V.precision_recall(rows, V.area_truths(truth.withColumn("cls", F.lit(0)), ["cls"]), ["cls"], thresholds=[0.5, 0.75]).collect()}
    assert got["medium", 0.5] == got["medium", 0.75] == got["small", 0.5] == (pytest.approx(1.0), 1.0)
    assert got["small", 0.75] == (0.0, 0.0) and ("large", 0.5) not in got
    assert got["all", 0.5] == (pytest.approx((51 + 50 * 2 / 3) / 101), 1.0) and got["all", 0.75] == (pytest.approx(51 / 3 / 101), 0.5)
