"""Functions, filters and conversions on small rows, with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import masks as M
from quillon.functions import text as X
from quillon.operators import filters, matching, metrics
from quillon.sources import frames


def values(spark, **columns):
    """The columns' values over one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


def box(*v):
    return B.box(*map(F.lit, v))


def test_boxes(spark):
    a, b, none = box(0, 0, 10, 10), box(5, 5, 15, 15), box(3, 3, 3, 3)
    xyxy = lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"])
    got = values(
        spark, centred=xyxy(B.from_cxcywh(F.lit(5), F.lit(5), F.lit(10), F.lit(4))), guarded=B.iou_guarded(a, b), guarded_empty=B.iou_guarded(a, none), plain_empty=B.iou(none, none), ioa=B.ioa(a, b), ioa_empty=B.ioa(none, a),
        giou=B.giou(a, box(20, 0, 30, 10)), clip=xyxy(B.clip(box(-5, 2, 50, 8), F.lit(20), F.lit(6))), crop=xyxy(B.crop(box(4, 6, 30, 40), F.lit(5), F.lit(2), F.lit(20), F.lit(10))), nonempty=B.nonempty(a), empty=B.nonempty(none), thin=B.nonempty(box(0, 0, 1, 9), 1.0),
        center=B.center(b), inside=B.inside(a, F.lit(11), F.lit(11)), touching=B.inside(a, F.lit(10), F.lit(11)), margin=B.inside(box(-2, 0, 10, 10), F.lit(10), F.lit(10), 3.0),
        clamp=F.array(B.clamp01(F.lit(-0.5)), B.clamp01(F.lit(0.5)), B.clamp01(F.lit(2.0))), valid=B.valid_normalized(F.array(*map(F.lit, (-0.1, 0.2, 1.4, 0.6)))), flat=B.valid_normalized(F.array(*map(F.lit, (0.5, 0.2, 0.5, 0.6)))), short=B.valid_normalized(F.array(F.lit(0.1), F.lit(0.2))),
        triangle=B.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0)))),
    )
    assert got == {
        "centred": [0, 3, 10, 7], "guarded": pytest.approx(25 / 175), "guarded_empty": 0, "plain_empty": None, "ioa": 0.25, "ioa_empty": 0, "giou": pytest.approx(-1 / 3), "clip": [0, 2, 20, 6], "crop": [2, 1, 10, 20],
        "nonempty": True, "empty": False, "thin": False, "center": [10, 10], "inside": True, "touching": False, "margin": True, "clamp": [0, 0.5, 1], "valid": [0, 0.2, 1, 0.6], "flat": None, "short": None, "triangle": 6,
    }


def test_masks(spark):
    words = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    runs = words(4, 8, 4)
    got = values(
        spark, ratio=M.area_ratio(runs, F.lit(4), F.lit(4)), none=M.area_ratio(runs, F.lit(0), F.lit(4)), shared=M.bit_intersection(words(0b1100, -1), words(0b0110, 1)), either=M.bit_union(words(0b1100, 0), words(0b0110, 1)),
        probabilities=M.binarize(F.array(*map(F.lit, (0.2, 0.5, 0.6)))), logits=M.binarize(F.array(*map(F.lit, (-3.0, 0.2, 4.0)))), inclusive=M.bounds(runs, F.lit(4)), exclusive=M.bounds(runs, F.lit(4), True),
    )
    assert got == {"ratio": 0.5, "none": 0, "shared": 2, "either": 4, "probabilities": [0, 0, 1], "logits": [0, 1, 1], "inclusive": [1, 0, 2, 3], "exclusive": [1, 0, 3, 4]}


def test_text(spark):
    more = {"bottle": ["oil bottle", "bottle", "green bottle"]}
    got = values(
        spark, variants=X.variants(F.lit("  Basil Oil Bottle "), more), known=X.variants(F.lit("bottle"), more), plain=X.variants(F.lit("cup_a"), more), blank=X.variants(F.lit("  "), more),
        wrap=X.wrap(F.lit("aa bb cccccc d e f g"), 5, 3), folded=X.fold_path(F.lit("a_b_c_d"), 2), short=X.fold_path(F.lit("a"), 2),
    )
    assert got == {
        "variants": ["Basil Oil Bottle", "basil oil bottle", "oil bottle", "bottle", "green bottle"], "known": ["bottle", "oil bottle", "green bottle"], "plain": ["cup_a"], "blank": [],
        "wrap": ["aa bb", "cccccc", "d e f"], "folded": "a/b/c_d", "short": "a/",
    }


def test_predicates(spark):
    null, one = F.lit(None), F.array(F.lit(1))
    q = filters.exhaustive_query
    got = values(
        spark, crowd=F.array(*[filters.not_crowd(F.lit(x)) for x in (1, 0, None)]), exhaustive=F.array(q(F.lit(True), null.cast("boolean")), q(F.lit(True), F.lit(False)), q(null.cast("boolean"), F.lit(True))),
        geometric=F.array(*[filters.valid_geometric(*c) for c in ((F.lit("geometric"), one, F.array()), (F.lit("geometric"), one, one), (F.lit("cup"), one, F.array()), (F.lit("geometric"), null.cast("array<int>"), F.array()))]), area=F.array(filters.nonempty_area(F.lit(0.0)), filters.nonempty_area(F.lit(2e-6))),
        f1=F.array(metrics.video_summary_f1(F.lit(2), F.lit(1), F.lit(1)), metrics.video_summary_f1(F.lit(0), F.lit(0), F.lit(0))), boundary=F.array(metrics.boundary_f(F.lit(0.5), F.lit(1.0)), metrics.boundary_f(F.lit(0.0), F.lit(0.0))),
        cost=matching.matched_cost(F.lit(0.5), F.lit(0.1), F.lit(0.8)),
    )
    assert got == {"crowd": [False, True, True], "exhaustive": [True, False, False], "geometric": [False, True, True, True], "area": [False, True], "f1": [pytest.approx(2 / 3), 1], "boundary": [pytest.approx(2 / 3), 0], "cost": pytest.approx(0.6)}


def test_exhaustive_images(spark):
    a = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "image int, flag int")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "image int, flag int")
    assert [r.image for r in filters.exhaustive([a, b], "image", "flag").collect()] == [1]


def test_row_filters(spark):
    rows = spark.createDataFrame([(1, ["aaaaa", "bb", "cccccc"], [1, 2, 3])], "id int, masks array<string>, n array<int>")
    assert filters.long_masks(rows, "masks", ["n"]).first().asDict() == {"id": 1, "masks": ["aaaaa", "cccccc"], "n": [1, 3]}
    q = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 0.0, 1.0), (2, 1, 3.0, 1.0)], "query int, object int, w double, h double")
    assert [r["query"] for r in filters.without_degenerate_targets(q.select("query").distinct(), q, "query", "w", "h").collect()] == [2]
    notes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("a", ["x"])], "seq string, tags array<string>")
    seqs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "seq string, n int")
    assert [r.n for r in filters.with_tag(seqs, notes, "seq", "tags", "x").collect()] == [1]
    known, other = filters.split_known(seqs, "seq", spark.createDataFrame([("a",), ("a",), ("z",)], "seq string"))
    assert ([r.seq for r in known.collect()], sorted(r.seq for r in other.collect())) == (["a"], ["b", "c"])
    assert sorted(r.seq for r in filters.hidden_removed(seqs, ["seq"], seqs.where("n = 1"), seqs.where("n = 2")).collect()) == ["c"]
    many = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 2).alias("stage"))
    chosen = filters.at_most(many, ["g"], "k", 5, F.col("k") == 297)
    assert sorted(r.n for r in chosen.groupBy("g").agg(F.count("*").alias("n")).collect()) == [5, 5, 5] and chosen.where("k = 297").count() == 1
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, filters.at_most(many.repartition(7), ["g"], "k", 5, F.col("k") == 297).collect()))
    staged = spark.createDataFrame([(1, p, s) for p in range(10) for s in range(3)], "g int, p int, stage int")
    kept = filters.same_in_all_stages(staged, ["g"], "p", "stage", 4).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert [r.n for r in kept] == [3] * 4
    changed = filters.rewrite_some(many, "k", "stage", F.lit(9).cast("long"), 0.25)
    assert 40 < changed.where("stage = 9").count() < 110 and changed.count() == 300


def test_one_to_many_takes_scores_above_the_quantile(spark):
    rows = [("a", i, s) for i, s in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])] + [("b", 10, 0.9), ("b", 11, 0.8)] + [("c", 20 + i, 0.5) for i in range(4)] + [("d", 30 + i, s) for i, s in enumerate([0.1, 0.1, 0.9, 0.9])]
    df = spark.createDataFrame(rows, "t string, det int, score double")
    # Quantiles: a 0.6 * 4 = place 2.4, 0.34; b its least; c 0.5, which nothing exceeds; d place 1.5, 0.5.
    assert sorted(r.det for r in matching.one_to_many(df, [], "t", "score", 2, 0.0).collect()) == [3, 4, 10, 32, 33]
    assert sorted(r.det for r in matching.one_to_many(df, [], "t", "score", 2, 0.45).collect()) == [4, 10, 32, 33]


@pytest.mark.parametrize("records", [3, 10_000])
def test_assign_over_many_groups_and_batches(spark, records):
    """Groups with and without conflicts, of several parts, with null keys: each has the optimum of its own matrix."""
    from itertools import permutations

    import numpy as np

    r = np.random.default_rng(records)
    rows = [(g if g else None, int(a), int(b), round(float(r.random()), 2)) for g in range(40) for a in range(4) for b in range(4) if r.random() < 0.4]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = matching.assign(spark.createDataFrame(rows, "g int, a int, b int, w double"), ["g"], "a", "b", "w").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({(x.g, x.a) for x in got}) == len({(x.g, x.b) for x in got}) == len(got)
    for g in {x[0] for x in rows}:
        w = np.zeros((4, 4))
        for k, a, b, v in rows:
            if k == g:
                w[a, b] = v
        assert sum(x.w for x in got if x.g == g) == pytest.approx(max(sum(w[i, p[i]] for i in range(4)) for p in permutations(range(4))))


def test_find_item_prefers_exact_ids(spark):
    docs = spark.createDataFrame([(1, "take1 and x"), (2, "see take1_v2, take9"), (3, "(take1_v2_7)"), (4, "take10")], "doc int, text string")
    wanted = spark.createDataFrame([("take1_v2_7", "take1_v2", "take1"), ("take1_v2_8", "take1_v2", "take1"), ("q", "q", "take10"), ("none", "none", None)], "exact string, view string, take string")
    got = {r.exact: (r.doc, r.tier) for r in frames.find_item(docs, "text", wanted, ["doc"]).collect()}
    assert got == {"take1_v2_7": (3, 0), "take1_v2_8": (2, 1), "q": (4, 2)}


def test_aggregated_conventions(spark):
    df = spark.createDataFrame([(0.5, 4.0), (0.0, 2.0), (None, 0.0)], "iou double, area double")
    assert df.agg(metrics.segment_mean_iou(F.col("iou"), F.col("area")).alias("x")).first().x == 0.25
    assert df.where("area < 0").agg(metrics.segment_mean_iou(F.col("iou"), F.col("area")).alias("x")).first().x == 1
    m = spark.createDataFrame([(-1.0,), (0.5,), (0.7,)], "v double")
    assert m.agg(metrics.mean_or_missing(F.col("v")).alias("x")).first().x == pytest.approx(0.6)
    assert m.where("v < 0").agg(metrics.mean_or_missing(F.col("v")).alias("x")).first().x == -1
    classes = spark.createDataFrame([(0.5, 0.2, 1), (0.5, 0.4, 0), (0.7, 0.6, 1)], "alpha double, hota double, n int")
    assert {r.alpha: r.hota for r in metrics.class_averaged(classes, "alpha", ["hota"]).collect()} == {0.5: pytest.approx(0.3), 0.7: 0.6}
    assert {r.alpha: r.hota for r in metrics.class_averaged(classes, "alpha", ["hota"], F.col("n") > 0).collect()} == {0.5: 0.2, 0.7: 0.6}


def test_greedy_match_against_plain_version(spark):
    """Crowds, ignored ground truths, contested and plain images, equal scores: the protocol step by step."""
    import numpy as np

    r = np.random.default_rng(11)
    truth, found, over = [], [], []
    for image in range(60):
        kinds = [(k, bool(r.random() < 0.3), bool(r.random() < 0.3)) for k in range(int(r.integers(0, 4)))]
        truth += [(image, k, ignore or crowd, crowd) for k, ignore, crowd in kinds]
        dets = [(d, float(np.round(r.random(), 1))) for d in range(int(r.integers(0, 5)))]
        found += [(image, d, s) for d, s in dets]
        over += [(image, k, d, float(np.round(r.random(), 1))) for k, _, _ in kinds for d, _ in dets if r.random() < (0.2 if image % 2 else 0.7)]
    want = set()
    for image in range(60):
        gts = sorted((g for g in truth if g[0] == image), key=lambda g: (g[2], g[1]))
        iou = {(d, g): v for i, g, d, v in over if i == image}
        for tau in (0.3, 0.6):
            taken = set()
            for _, d, s in sorted((x for x in found if x[0] == image), key=lambda x: (-x[2], x[1]))[:3]:
                best, pick = tau, None
                for _, g, ignore, crowd in gts:
                    if g in taken and not crowd:
                        continue
                    if pick is not None and not pick[1] and ignore:
                        break
                    if iou.get((d, g), 0) >= best:
                        best, pick = iou[d, g], (g, ignore)
                if pick:
                    taken.add(pick[0])
                want.add((image, d, tau, pick is not None, bool(pick and pick[1])))
    frames_ = [spark.createDataFrame(x, s) for x, s in ((truth, "i int, gt int, ignore boolean, crowd boolean"), (found, "i int, det int, score double"), (over, "i int, gt int, det int, iou double"))]
    got = matching.greedy_match(*frames_, ["i"], [0.3, 0.6], 3).collect()
    assert {(x.i, x.det, x.threshold, x.hit, x.ignored) for x in got} == want and len(got) == len(want)


def test_runs_of_long_masks_take_one_fold(spark):
    # The plan names the array once for its runs: a look-up of ends for each element would make the time cubic.
    df = spark.createDataFrame([([0, 2] * 1500,), ([3, 1, 2],), ([5],)], "c array<int>")
    got = [list(map(tuple, r[0])) for r in df.select(M.run_intervals(F.col("c"))).collect()]
    assert got == [[(2 * i, 2 * i + 2) for i in range(1500)], [(3, 4)], []]
    assert [r[0] for r in df.select(M.bounds(F.col("c"), F.lit(4))).collect()] == [[0, 0, 749, 3], [0, 3, 0, 3], None]
    a, b = M.run_intervals(F.col("c")), M.run_intervals(F.lit([0, 4]))
    assert [r[0] for r in df.select(M.shared_pixels(a, b)).collect()] == [4, 1, 0]
