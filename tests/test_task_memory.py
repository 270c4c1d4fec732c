"""What a task holds: sweeps that share a sort, rows dealt over a fixed number of tasks, joins without a broadcast of boxes."""

from __future__ import annotations

import re

from test_runs import images, relation

from quillon.operators import runs as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_stay_dealt(spark):
    segs, _ = relation(spark, images(7, 9))
    assert segs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_boundary_scores_sort_few_times(spark):
    (a, every), (b, _) = relation(spark, images(9, 8)), relation(spark, images(9, 8, seed=4))
    # Runs of either side, boundaries and hits; the rest is the join with all pairs.
    assert plan(R.boundary_scores(a, b, every, ["id"], 9, 8, 1)).count("Sort [") <= 6


def test_jf_report_shares_the_boundary_sweep(spark):
    from quillon.plans import QUERIES

    assert plan(QUERIES["jf_report"](spark, "/root/testdata/sf0.001")).count("Sort [") <= 20


def test_compared_counts_all_rules_in_one_sweep(spark):
    a, b = images(7, 9), images(7, 9, seed=9)
    (sa, _), (sb, _) = relation(spark, a), relation(spark, b)
    got = R.compared(sa, sb, ["id"], {"both": lambda p, q: p & q, "differ": lambda p, q: p != q})
    assert plan(got).count("Sort [") <= 3
    assert {r.id: (r.both, r.differ) for r in got.collect()} == {i: ((a[i] & b[i]).sum(), (a[i] ^ b[i]).sum()) for i in a if (a[i] | b[i]).any()}


def test_boxes_per_cell_are_not_broadcast(spark):
    from quillon.functions import boxes as B
    from quillon.operators import suppression as S
    from quillon.plans import QUERIES
    from quillon.plans.detection import _ranked_boxes

    at = "/root/testdata/sf0.001"
    found = S.conflicts(_ranked_boxes(spark, at), ["grp"], "id", "rank", "b", B.iou, 0.4, cell=24.0)
    for df in (QUERIES["box_overlap_pairs"](spark, at), QUERIES["assignment_total"](spark, at), found):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_boxes_per_cell_stay_dealt(spark):
    from quillon.operators import suppression as S
    from quillon.plans.tables import part_boxes

    pairs = S.group_pairs(part_boxes(spark, "/root/testdata/sf0.001"), ["grp"], "id", ["b"], 24.0, "b")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_segments_are_not_broadcast(spark, tmp_path):
    (a, _), (b, _) = relation(spark, images(7, 9)), relation(spark, images(7, 9, seed=9))
    for n, segs in (("a", a), ("b", b)):
        segs.withColumn(n, segs["id"]).write.parquet(f"{tmp_path}/{n}")
    met = R.overlaps(*(spark.read.parquet(f"{tmp_path}/{n}") for n in "ab"), ["id"], "a", "b")
    lines = plan(met).splitlines()
    sides = [i for i, x in enumerate(lines) if "Join" in x and "__q_t" in x]
    assert sides and all("SortMergeJoin" in lines[i] for i in sides)
    assert sum("REPARTITION_BY_NUM" in x for x in lines) == 2


def test_units_are_shuffled_once_for_all_thresholds(spark):
    from quillon.plans import QUERIES

    made = plan(QUERIES["phrase_units"](spark, "/root/testdata/sf0.001")).splitlines()
    assert not [x for x in made if "Exchange" in x and "threshold" in x]


def test_assigned_groups_stay_dealt(spark):
    from quillon.operators.matching import assign

    pairs = spark.createDataFrame([(i, a, b, 0.5) for i in range(8) for a in range(2) for b in range(2)], "grp long, a long, b long, w double")
    got = assign(pairs, ["grp"], "a", "b", "w")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.groupBy("grp").count().where("count = 2").count() == 8


def numbers_dealt(df) -> set[int]:
    return {int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan(df))}


def test_tasks_of_masks_follow_the_vectors(spark, monkeypatch):
    from quillon.plans import QUERIES, masks

    at = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{at}/embeddings.parquet").count()
    monkeypatch.setattr(masks, "_EACH", 2)
    for name in ("jf_report", "boundary_scores", "mask_algebra", "mask_ious"):
        assert numbers_dealt(QUERIES[name](spark, at)) == {-(-n // 2)}


def test_tasks_of_boxes_follow_the_boxes(spark, monkeypatch):
    from quillon.plans import QUERIES, detection

    at = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{at}/part.parquet").count()
    monkeypatch.setattr(detection, "EACH", 10)
    for name in ("nms_greedy", "frame_nms", "overlap_removal", "nms_fast", "box_overlap_pairs"):
        assert -(-n // 10) in numbers_dealt(QUERIES[name](spark, at))


def test_greedy_suppression_joins_pairs_once(spark):
    from quillon.plans import QUERIES

    for name in ("nms_greedy", "frame_nms", "overlap_removal"):
        made = plan(QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines()
        assert len([x for x in made if "SortMergeJoin" in x and "__q_x" in x]) == 1
