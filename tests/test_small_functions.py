"""Functions of a few lines, on hand-made rows: choices, conversions, writers, compacted versions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import cases, dedup, filters, tracks, windows
from quillon.sources import annotations, sinks, text_tables
from quillon.streaming import runs


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def test_choices_and_orders(spark):
    chosen, files = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "f1")], "k int, file string")
    there, missing = cases.copied(chosen, files, ["k"])
    assert rows(there) == [(1, "x", "f1")] and rows(missing) == [(2, "y")]
    names = spark.createDataFrame([("a", "10"), ("a", "9"), ("b", "10"), ("b", "9"), ("b", "cover")], "folder string, stem string")
    assert rows(cases.name_order(names, ["folder"], "stem")) == [("a", "10", 1), ("a", "9", 0), ("b", "10", 0), ("b", "9", 1), ("b", "cover", 2)]
    assert cases.id_column(spark.createDataFrame([(1, 2)], "scalabel_id int, instance_id int")) == "instance_id"
    with pytest.raises(ValueError, match="track_id"):
        cases.id_column(names)
    sizes = spark.createDataFrame([(5, None), (5, 5), (6, 5)], "size int, most int")
    assert rows(sizes.select("size", cases.within_size(F.col("size"), F.col("most")).alias("ok"))) == [(5, True), (5, True), (6, False)]
    dealt = cases.round_robin(spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7)], "g string, i int"), ["g"], ["i"], 2)
    assert rows(dealt) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 4, 0), ("b", 7, 0)]


def test_region_boxes(spark):
    df = spark.createDataFrame([(1, ([0.1, 0.1, 0.5, 0.5], [0.2, 0.2, 0.4, 1.7])), (2, ([0.1, 0.1, 0.5, 0.5], [0.9, 0.2, 0.4, 0.5])), (3, (None, [0.1]))], "i int, region struct<box: array<double>, bbox: array<double>>")
    assert rows(df.select("i", cases.region_box("region", ("box", "bbox")).alias("b"))) == [(1, [0.2, 0.2, 0.4, 1.0]), (2, [0.1, 0.1, 0.5, 0.5]), (3, None)]


def test_first_success(spark):
    df = spark.createDataFrame([("a", 1, False, None, "e1"), ("a", 2, False, None, "e2"), ("a", 3, True, "v3", None), ("a", 4, False, None, "e4"), ("b", 1, False, None, "x"), ("c", 1, True, "w", None), (None, 1, None, None, "n")], "k string, n int, ok boolean, v string, e string")
    assert rows(cases.first_success(df, ["k"], "n", F.col("ok"), F.col("v"), F.col("e"))) == rows(spark.createDataFrame([("a", "v3", "e2"), ("b", None, "x"), ("c", "w", None), (None, None, "n")], "k string, value string, error string"))


def test_firsts_samples_and_violations(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert rows(dedup.first_occurrence(df, "k", ["n"])) == [("a", 1), ("b", 3)] == rows(windows.first_per_group(df, ["k"], ["n"]))
    ids = spark.range(100)
    one, again = (rows(dedup.seeded_sample(d, "id", 7, 3)) for d in (ids, ids.repartition(5)))
    assert one == again and len(one) == 7 and one != rows(dedup.seeded_sample(ids, "id", 7, 4))
    assert rows(filters.violations({"low": df.where("n < 2"), "none": df.where("n > 9")})) == [("low", 1), ("none", 0)]


def test_track_rows(spark):
    t = spark.createDataFrame([("v", 1, [[1.0, 1.0, 2.0, 2.0], None, [0.0, 0.0, 1.0, 1.0]]), ("v", 2, [None, [5.0, 5.0, 1.0, 1.0]])], "video string, track int, boxes array<array<double>>")
    got = {(r.track, r.t): r.id for r in tracks.truth_frames(t, ["video", "track"], "boxes").collect()}
    assert got == {(1, 0): 1, (1, 2): 2, (2, 1): 3}
    p = spark.createDataFrame([(7, [0.5, 0.25], [1, 2]), (8, [], [])], "image int, scores array<double>, labels array<int>")
    assert rows(tracks.result_rows(p, ["image"], ["scores", "labels"])) == [(7, 0.25, 2), (7, 0.5, 1)]
    assert rows(tracks.tiled(spark.createDataFrame([(1,)], "i int"), 3)) == [(1, 0), (1, 1), (1, 2)]
    assert rows(spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],)], "a array<int>").select(tracks.padded(F.col("a"), 3, 0).alias("a"))) == [([1, 2, 0],), ([1, 2, 3, 4],)]
    images = spark.createDataFrame([(1, 10), (2, 20)], "image int, video int")
    found = spark.createDataFrame([(1, None), (2, 99), (3, None)], "image int, video int")
    assert rows(tracks.missing_video(found.withColumnRenamed("video", "video"), images.withColumnRenamed("video", "video"), "image", "video")) == [(1, 10), (2, 99), (3, None)]
    assert rows(tracks.every_frame_known(found, images, ["image"])) == [(3, None)]
    at = spark.createDataFrame([("v", [1, 2], [0.5])], "video string, a array<int>, b array<double>")
    assert rows(text_tables.rows_at(at, "video", 1, ["a", "b"])) == [("v", 2, None)]
    assert rows(text_tables.rows_at(at, "video", 1, ["b"], -1.0)) == [("v", [1, 2], -1.0)]


def test_phrase_queries(spark):
    images = spark.createDataFrame([(1, "a.jpg", "a red car", 10, 20, 1), (2, "b.jpg", "dog", 5, 5, None)], "id int, file_name string, text_input string, width int, height int, is_instance_exhaustive int")
    assert [(r.image_id, r.phrase, r.exhaustive) for r in annotations.phrase_queries(images).orderBy("image_id").collect()] == [(1, "a red car", True), (2, "dog", False)]


def test_json_leaves_keep_the_session_clean(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "x"}}')], "k int, j string")
    one, two = annotations.json_strings(df, "k", "j"), annotations.json_strings(df.withColumn("k", F.lit(5)), "k", "j")
    assert rows(one) == [(1, "$.a.b", "x")] and rows(two) == [(5, "$.a.b", "x")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__q_json")]


def lines(folder: str) -> list[dict]:
    return [json.loads(x) for n in sorted(os.listdir(folder)) if n.endswith(".json") for x in open(f"{folder}/{n}")]


def test_writers(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(1, [0.1234567, 2.0, 3.0, 4.0], 0.987654321), (2, [1.0, 1.0, 1.0, 1.0], 0.5)], "image int, bbox array<double>, score double").repartition(2)
    sinks.write_json(df, f"{at}/one", one_file=True)
    assert len([n for n in os.listdir(f"{at}/one") if n.endswith(".json")]) == 1 and len(lines(f"{at}/one")) == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_json(df, f"{at}/one")
    sinks.write_results(df, f"{at}/results")
    assert {(x["image"], x["bbox"][0], x["score"]) for x in lines(f"{at}/results")} == {(1, 0.12346, 0.98765), (2, 1.0, 0.5)}
    sinks.write_ranking(df.withColumn("rank", F.col("image")), f"{at}/ranking", ["rank", "score"], ["rank"])
    assert sorted(x["rank"] for x in lines(f"{at}/ranking/json")) == [1, 2] and spark.read.option("header", True).csv(f"{at}/ranking/csv").columns == ["rank", "score"]
    for _ in range(2):
        sinks.write_filtered({"a": df.where("image = 1"), "b": df.limit(0)}, f"{at}/kept")
    assert spark.read.parquet(f"{at}/kept/a").count() == 1 and spark.read.parquet(f"{at}/kept/b").count() == 0
    merged = sinks.merge_reports([spark.createDataFrame([("v1", 1.0), ("v2", 2.0)], "video string, hota double"), spark.createDataFrame([("v2", 3.0), ("v3", 4.0)], "video string, map double")], ["video"])
    assert rows(merged) == [("v1", 1.0, None), ("v2", 2.0, 3.0), ("v3", None, 4.0)]


def test_versions_are_compacted(spark, tmp_path):
    at = str(tmp_path / "table")
    write = lambda n, *r: spark.createDataFrame(list(r), "k int, v string").write.mode("overwrite").parquet(f"{at}/version={n}")
    now = lambda: dict(rows(runs.current(spark, at, ["k"])))
    with pytest.raises(ValueError, match="no version"):
        runs.current(spark, at, ["k"])
    write(0, (1, "a"), (2, "b"))
    write(1, (2, "c"), (3, "d"))
    assert now() == {1: "a", 2: "c", 3: "d"}
    runs.compact(spark, at, ["k"])
    assert now() == {1: "a", 2: "c", 3: "d"} and os.listdir(at) == [n for n in os.listdir(at) if not n.startswith("version=")]
    write(2, (1, "e"))
    # A run that broke off before its commit: its generation isn't read.
    spark.createDataFrame([(9, "broken")], "k int, v string").write.parquet(f"{at}.generations/generation=2")
    assert now() == {1: "e", 2: "c", 3: "d"}
    runs.compact(spark, at, ["k"])
    # One that broke off after it: the version is there still, and counts no more.
    write(2, (1, "stale"))
    assert now() == {1: "e", 2: "c", 3: "d"}
    runs.compact(spark, at, ["k"])
    assert now() == {1: "e", 2: "c", 3: "d"} and sorted(n for n in os.listdir(f"{at}.generations")) == ["generation=2"]


def test_upserted_stream_stays_small(spark, tmp_path):
    at = str(tmp_path)
    for i in range(7):
        spark.createDataFrame([(j, i * 10 + j) for j in range(i % 3 + 1)], "k int, v int").coalesce(1).write.parquet(f"{at}/in/{i}")
    stream = runs.read_growing(spark, f"{at}/in/*", "k int, v int", files_per_trigger=1)
    for _ in range(2):  # the second start finds nothing new
        runs.upsert_into(stream, f"{at}/out", f"{at}/state", ["k"], every=3).awaitTermination()
    assert sum(n.startswith("version=") for n in os.listdir(f"{at}/out")) < 3
    want = {}
    for i in range(7):
        want |= {j: i * 10 + j for j in range(i % 3 + 1)}
    assert {k: v for k, v in rows(runs.current(spark, f"{at}/out", ["k"]))}.keys() == want.keys()


def test_stages_and_tags(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z"), ("b", 5, "u"), ("c", 7, "v")], "g string, stage int, v string")
    kept, missing = filters.renumbered_stages(df, ["g"], "stage", [5, 2])
    assert rows(kept) == [("a", 0, "x"), ("a", 1, "y"), ("b", 1, "u")] and rows(missing) == [("b", 2), ("c", 2), ("c", 5)]
    assert rows(filters.renumbered_stages(df, ["g"], "stage", [5, 2], reverse=True)[0]) == [("a", 0, "y"), ("a", 1, "x"), ("b", 0, "u")]
    seqs = spark.createDataFrame([("s", ["hard"]), ("s", ["hard", "far"]), ("t", ["hard"]), ("t", None), ("u", [])], "seq string, tags array<string>")
    kept, odd = filters.tagged_sequences(seqs, "seq", "tags", "hard")
    assert sorted(r.seq for r in kept.collect()) == ["s", "s", "t", "t"] and rows(odd) == [("t",)]


def test_cases_and_files(spark):
    from quillon.sources import frames

    files = spark.createDataFrame([("/d/c2/annotation.json",), ("/d/c1/annotation.json",), ("/d/c1/other.json",), ("/d/c3/image.png",), ("/e/c1/annotation.json",)], "path string")
    assert rows(frames.cases(files, "annotation.json")) == [("c1", "/d/c1/annotation.json"), ("c1", "/e/c1/annotation.json"), ("c2", "/d/c2/annotation.json")]
    assert rows(frames.cases(files, "annotation.json", ids=["c2", "c9"])) == [("c2", "/d/c2/annotation.json")] and frames.cases(files, "annotation.json", most=2).count() == 2
    lone, many = frames.lone_files(files, "JSON")
    assert rows(lone) == [("/d/c2", "/d/c2/annotation.json"), ("/e/c1", "/e/c1/annotation.json")] and rows(many) == [("/d/c1", 2)]
    assert rows(frames.unknown_classes(spark.createDataFrame([("cat",), ("dog",), ("cow",), (None,)], "cls string"), "cls", ["cat", "dog"])) == [("cow",), (None,)]
