"""State machines step by step, replayed sinks, readers of hand-written files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.sources import annotations, frames, sinks, text_tables
from quillon.streaming import runs, states


def _grow(spark, tmp_path, rows, schema, parts=3):
    """Rows in files that a stream takes up one by one, in order."""
    at = str(tmp_path / "in")
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(at)
    return runs.read_growing(spark, at, schema, 1)


def test_confirmation_over_micro_batches(spark, tmp_path):
    hits = [1, 1, 0, 1, 1, 1, 0, 1]
    rows = [(7, i, bool(h)) for i, h in enumerate(hits)]
    s = _grow(spark, tmp_path, rows, "k bigint, at bigint, hit boolean")
    got = sorted((r["at"], r.streak, r.confirmed) for r in runs.run_available(states.confirm(s, "k", "at", "hit", 3), "t").collect())
    assert [x[1] for x in got] == [1, 2, 0, 1, 2, 3, 0, 1] and [x[2] for x in got] == [False] * 5 + [True] * 3


def test_delay_buffer_hides_what_is_removed_later(spark, tmp_path):
    rows = [(1, f, f == 5, [f] if f in (1, 3) else []) for f in range(6)]
    s = _grow(spark, tmp_path, rows, "k bigint, frame bigint, last boolean, removed array<bigint>", 2)
    got = {r.frame: (r.emitted_at, r.hidden) for r in runs.run_available(states.delayed(s, "k", "frame", "last", "removed", 3), "t").collect()}
    assert got == {0: (2, [1]), 1: (3, [1, 3]), 2: (4, [1, 3]), 3: (5, [1, 3]), 4: (5, [1, 3]), 5: (5, [1, 3])}


def test_hot_start_rules(spark, tmp_path):
    event = lambda new=(), matched=(), missed=(), groups=(): (list(new), list(matched), list(missed), [list(g) for g in groups])
    steps = [event(new=[1, 2]), event(matched=[1], missed=[2]), event(matched=[1], missed=[2]), event(new=[3], matched=[1], missed=[2]), event(matched=[1, 3], groups=[[1, 3]]), event(matched=[1, 3], groups=[[1, 3]])]
    rows = [(1, i, *s) for i, s in enumerate(steps)]
    s = _grow(spark, tmp_path, rows, "k bigint, frame bigint, new array<bigint>, matched array<bigint>, missed array<bigint>, groups array<array<bigint>>")
    got = {r.frame: (r.removed, r.suppressed) for r in runs.run_available(states.hot_start(s, "k", "frame", delay=15, unmatched=3, repeats=2, low=-1, high=4, start=0), "t").collect()}
    assert got[0] == ([], [1, 2]) and got[2] == ([], [2]) and got[3] == ([2], [3]) and got[5] == ([3], [])


def test_hot_start_counts_only_young_objects():
    objects, pairs = {}, {}
    states.hot_start_step(objects, pairs, 0, {"new": [1], "matched": [], "missed": [], "groups": []}, 2, 2, 2, -4, 8, 1)
    states.hot_start_step(objects, pairs, 1, {"new": [], "matched": [], "missed": [1], "groups": []}, 2, 2, 2, -4, 8, 1)
    gone, _ = states.hot_start_step(objects, pairs, 9, {"new": [], "matched": [], "missed": [1], "groups": []}, 2, 2, 2, -4, 8, 1)
    assert gone == []


def test_upsert_replays_safely(spark, tmp_path):
    at = str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"{at}/version=0")
    for _ in range(2):  # a batch that ran twice counts once
        spark.createDataFrame([(2, "c")], "k int, v string").write.mode("overwrite").parquet(f"{at}/version=1")
    assert sorted((r.k, r.v) for r in runs.current(spark, at, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_image_truth(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 20}], "annotations": [{"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4], "area": 12, "category_id": 3, "iscrowd": 0}], "categories": [{"id": 3, "name": "cat"}, {"id": 4, "name": "dog"}]}
    (tmp_path / "gt.json").write_text(json.dumps(doc, indent=1))
    t = annotations.image_truth(spark, str(tmp_path / "gt.json"))
    grouped = {r.id: [a.id for a in r.annotations] for r in annotations.grouped_by_image(t["images"], t["annotations"]).collect()}
    assert grouped == {1: [5], 2: []}
    q = {(r.image_id, r.name): r for r in annotations.category_queries(t["images"], t["annotations"], t["categories"], 1).collect()}
    assert len(q) == 4 and q[1, "cat"].ids == [5] and q[1, "cat"].boxes[0] == [0.1, 0.1, 0.3, 0.2] and q[2, "dog"].ids == [] and q[2, "dog"].chunk == 1
    assert annotations.category_queries(t["images"], t["annotations"], t["categories"], negatives=False).count() == 1


def test_results_get_areas_and_ids(spark):
    rows = [(1, 1, [0.0, 0.0, 4.0, 5.0], None, 0.5), (2, 1, [0.0, 0.0, 4.0, 5.0], ("52", [2, 4]), 0.5)]
    df = spark.createDataFrame(rows, annotations.IMAGE_RESULTS)
    got = {r.image_id: r for r in annotations.with_derived(df, ["image_id"]).collect()}
    assert got[1].area == 20.0 and got[2].area == 2.0 and [got[1].id, got[2].id] == [1, 2]
    images = spark.createDataFrame([(1,)], "id bigint")
    assert [r.image_id for r in annotations.unknown_images(df, images).collect()] == [2]


def test_video_truth(spark, tmp_path):
    doc = {"videos": [{"id": 1, "video_name": "v", "file_names": ["0.jpg", "1.jpg"], "height": 4, "width": 4, "length": 2}], "annotations": [{"id": 1, "video_id": 1, "category_id": 2, "bboxes": [[1, 1, 2, 2], None], "areas": [4, None]}], "categories": [{"id": 2, "name": "cat"}], "video_np_pairs": [{"id": 1, "video_id": 1, "category_id": 2, "noun_phrase": "cat", "num_masklets": 1}]}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    t = annotations.video_truth(spark, str(tmp_path / "v.json"))
    a = t["annotations"].first()
    assert a.bboxes[1] == [0.0] * 4 and a.area == 2.0
    assert annotations.mean_area(t["annotations"], True).first().area == 4.0
    q = annotations.video_queries(t["videos"], t["video_np_pairs"], t["categories"]).collect()
    assert [(r.frame, r.agrees) for r in sorted(q, key=lambda r: r.frame)] == [(0, True), (1, True)]


def test_mask_cases_and_ranking(spark, tmp_path):
    for take, views in (("t1", {"cam": {"3": {"size": [2, 4], "counts": "52"}, "5": {"size": [2, 4], "counts": "44"}, "9": {"size": [2, 4], "counts": ""}}}), ("t2", {"cam": {"1": {"size": [2, 4], "counts": "52"}}})):
        (tmp_path / take).mkdir()
        (tmp_path / take / "annotation.json").write_text(json.dumps({"masks": {"cup": views, "pan": {}}}))
    m = annotations.mask_cases(spark, str(tmp_path), objects=["cup"])
    assert sorted((r["take"], r.frame) for r in m.collect()) == [("t1", 3), ("t1", 5), ("t1", 9), ("t2", 1)]
    images = spark.createDataFrame([("cam", 3, "p"), ("cam", 5, "p")], "view string, frame int, path string")
    ranked = {(r["take"], r.frame): (r.rank_global, r.pixels, r.image_exists) for r in annotations.ranked_masks(m, images).collect()}
    assert ranked["t1", 5] == (1, 4, True) and ranked["t1", 3] == (2, 2, True) and ranked["t1", 9] == (3, 0, False) and ranked["t2", 1][2] is False


def test_nested_json_strings(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"b": ["x", {"c": "y"}]}, "d": 5}))], "id int, j string")
    got = {r.value for r in annotations.json_strings(df, "id", "j").collect()}
    assert got == {"x", "y", "5"}


def test_frame_files(spark, tmp_path):
    for name in ("img_001.jpg", "img_1.PNG", "x7_0002.jpeg", "none.jpg", "note.txt", "12.jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = frames.file_listing(spark, str(tmp_path))
    kept, rejects = frames.frame_map(files)
    assert sorted((r.frame, r.name) for r in kept.collect()) == [(1, "img_001.jpg"), (2, "x7_0002.jpeg"), (12, "12.jpg")]
    assert sorted((r.name, r.reason) for r in rejects.collect()) == [("img_1.PNG", "repeated frame id"), ("none.jpg", "no frame id")]
    assert [r.name for r in frames.numeric_stems(files).collect()] == ["12.jpg"]


def test_routes(spark):
    rows = [("/a/v.mp4", False), ("/a/v.MOV", False), ("store://x/abc", False), ("/a/dir", True), ("<load-dummy-video-5>", False), ("<load-zero-video>", False), ("/a/v.xyz", False)]
    df = spark.createDataFrame(rows, "p string, d boolean").select("p", frames.route(F.col("p"), F.col("d")).alias("r"), frames.synthetic_length(F.col("p")).alias("n"))
    got = {r.p: (r.r, r.n) for r in df.collect()}
    assert [got[p][0] for p, _ in rows] == ["video", "video", "video", "folder", "synthetic", "synthetic", "video"] and got["<load-dummy-video-5>"][1] == 5 and got["<load-zero-video>"][1] == 60
    assert frames.synthetic_frames(spark, 5).count() == 5
    at = spark.createDataFrame([("v.mp4@17",), ("v.mp4",)], "p string").select(*[c.alias(n) for c, n in zip(frames.addressed(F.col("p")), "fn")]).collect()
    assert [tuple(r) for r in at] == [("v.mp4", 17), ("v.mp4", None)]


def test_batches_are_seeded_and_whole(spark):
    df = spark.range(25)
    a = {r.id: (r.shard, r.batch) for r in frames.shuffled_batches(df, "id", 4, 1, 2).collect()}
    b = {r.id: (r.shard, r.batch) for r in frames.shuffled_batches(df.repartition(7), "id", 4, 1, 2).collect()}
    assert a == b and len(a) == 25 and frames.shuffled_batches(df, "id", 4, 1, 2, True).count() == 24


def test_track_text_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1, 3, 0.5, Car\n2,-1,0.4,car\n2,5,0.4,dog,\n3,6,1,ped\n\n")
    (tmp_path / "b.txt").write_text("1 3 0.5 car \n4 4 0.5 CROWD\n")
    rows, skipped = text_tables.track_rows(spark, str(tmp_path), 0, 1, {3: ["car", "ped"]}, {3: ["crowd"]}, {3: {"car": "1", "ped": "2", "crowd": "9"}}, True)
    assert sorted((r.file, r.t, r.fields) for r in rows.collect()) == [("a.txt", 1, ["1", "3", "0.5", "1"]), ("a.txt", 3, ["3", "6", "1", "2"]), ("b.txt", 1, ["1", "3", "0.5", "1"])]
    assert [(r.t, r.fields[3]) for r in skipped.collect()] == [(4, "9")]


def test_logs_configurations_and_scans(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert tuple(text_tables.last_log_row(spark, str(tmp_path / "log.json"), ["a", "b"]).first()) == ("log.json", "2", None)
    for d in ("run", "code"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "config.yaml").write_text("scratch:\n  lr: 0.1  # rate\n  name: 'x'\nlauncher:\n  lr: 5\n")
    got = text_tables.configurations(spark, str(tmp_path), "config.yaml", "scratch", ["lr", "name", "none"]).collect()
    assert [(r.lr, r.name, r.none) for r in got] == [("0.1", "x", None)]
    (tmp_path / "scan" / "s1").mkdir(parents=True)
    (tmp_path / "scan" / "s1" / "r.json").write_text('{"x_AP": 0.5, "y": 1}')
    scan = text_tables.result_scan(spark, str(tmp_path / "scan"), "_AP")
    assert [tuple(r) for r in scan.collect()] == [("s1", "x_AP", 0.5)]
    assert text_tables.with_average(scan, "subset", "value").count() == 2


def test_sinks(spark, tmp_path):
    todo = spark.createDataFrame([(i, i % 2) for i in range(6)], "k int, g int")
    at = str(tmp_path / "done")
    assert sinks.write_remaining(todo.where("k < 4"), at, ["k"], "g") == 4 and sinks.write_remaining(todo, at, ["k"], "g") == 6
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "s string, metric string, value double")
    sinks.write_summary(long, str(tmp_path / "csv"), ["s"], ["y", "x"])
    lines = [line for f in (tmp_path / "csv").glob("part*") for line in f.read_text().split()]
    assert lines[0] == "s,y,x" and sorted(lines[1:]) == ["a,2.0,1.0", "b,,3.0"]
    v = spark.createDataFrame([(0.123456789,), (0.0,)], "v double").select(sinks.percent(F.col("v")).alias("p")).collect()
    assert [r.p for r in v] == [12.346, 0.0]
    assert {r.status: r.n for r in sinks.status_counts(spark.createDataFrame([("ok",), ("ok",), ("bad",)], "status string")).collect()} == {"ok": 2, "bad": 1, "all": 3}


def test_json_strings_of_more_rows_than_a_recursion_may_have(spark):
    df = spark.range(40).selectExpr("id", """'{"a": {"b": [1, "x"]}, "c": null}' AS j""")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 10)
    try:
        got = annotations.json_strings(df, "id", "j").collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == 120 and {(r.path, r.value) for r in got} == {("$.a.b[0]", "1"), ("$.a.b[1]", "x"), ("$.c", None)}
