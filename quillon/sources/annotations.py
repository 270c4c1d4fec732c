"""Annotation and prediction documents as relations.

A document with several sections is read once per section, each read pruned to
that section's columns; nothing is built that a join doesn't already do.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.boxes import clamp01
from quillon.streaming.runs import shared_path

_RLE = "struct<counts: string, size: array<int>>"
IMAGE_TRUTH = f"""
    images array<struct<id: bigint, file_name: string, text_input: string, width: int, height: int, queried_category: string, is_instance_exhaustive: int, is_pixel_exhaustive: int>>,
    annotations array<struct<id: bigint, image_id: bigint, source: string, area: double, bbox: array<double>, segmentation: {_RLE}, category_id: int, iscrowd: int>>,
    categories array<struct<id: int, name: string>>"""
VIDEO_TRUTH = f"""
    videos array<struct<id: bigint, video_name: string, file_names: array<string>, height: int, width: int, length: int>>,
    annotations array<struct<id: bigint, video_id: bigint, category_id: int, noun_phrase: string, height: int, width: int, iscrowd: int, tags: array<string>, segmentations: array<{_RLE}>, bboxes: array<array<double>>, areas: array<double>>>,
    categories array<struct<id: int, name: string>>,
    video_np_pairs array<struct<id: bigint, video_id: bigint, category_id: int, noun_phrase: string, num_masklets: int>>"""
IMAGE_RESULTS = f"image_id bigint, category_id int, bbox array<double>, segmentation {_RLE}, score double"
VIDEO_RESULTS = f"video_id bigint, category_id int, score double, bboxes array<array<double>>, segmentations array<{_RLE}>, areas array<double>, per_frame_scores array<double>"
MASK_MAP = "masks map<string, map<string, map<string, struct<size: array<int>, counts: string>>>>"


def documents(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """One row per JSON document, in its own folder or below; a missing section is null."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def section(documents: DataFrame, name: str) -> DataFrame:
    """The rows of one section of all documents."""
    return documents.select(F.inline(name))


def image_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    d = documents(spark, path, IMAGE_TRUTH)
    return {n: section(d, n) for n in ("images", "annotations", "categories")}


def video_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sections of a video set; a null box of a track is four zeros, `area` the mean with nulls as 0."""
    d = documents(spark, path, VIDEO_TRUTH)
    out = {n: section(d, n) for n in ("videos", "annotations", "categories", "video_np_pairs")}
    out["annotations"] = mean_area(zero_boxes(out["annotations"]))
    return out


def zero_boxes(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("bboxes", F.transform("bboxes", lambda b: F.coalesce(b, F.array_repeat(F.lit(0.0), 4))))


def mean_area(tracks: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Mean of a track's areas over its frames: nulls as 0, or, with `skip_empty`, over those above 0 only."""
    areas = F.filter("areas", lambda a: F.coalesce(a, F.lit(0.0)) > 0) if skip_empty else F.col("areas")
    total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + F.coalesce(a, F.lit(0.0)))
    return tracks.withColumn("area", F.when(F.size(areas) > 0, total / F.size(areas)).otherwise(0.0))


def results(spark: SparkSession, path: str, schema: str = IMAGE_RESULTS) -> DataFrame:
    """Rows of a results file: an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_derived(results: DataFrame, order: list[str]) -> DataFrame:
    """Result rows with id, area, box and iscrowd as an evaluator expects them.

    A row with a box gets its area from it; one with a mask from its runs.
    Ids count from 1 in `order`.
    """
    from quillon.functions.masks import area, decode_text
    from quillon.operators.windows import rank_globally

    box_area = F.get("bbox", 2) * F.get("bbox", 3)
    rows = results.withColumn("__q_counts", F.col("segmentation.counts"))
    mask_area = F.when(F.col("__q_counts").isNotNull() & (F.length("__q_counts") > 0), area(decode_text("__q_counts"))).cast("double")
    rows = rows.withColumns({"area": F.coalesce(mask_area, box_area), "iscrowd": F.lit(0)}).drop("__q_counts")
    return rank_globally(rows, order, "id")


def unknown_images(results: DataFrame, images: DataFrame) -> DataFrame:
    """Results of images that the ground truth doesn't have; an empty result is the assertion."""
    return results.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def grouped_by_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each image with its size and its annotations, an empty list where it has none."""
    listed = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "bbox", "area", "iscrowd"))).alias("annotations"))
    joined = images.join(listed, F.col("id") == F.col("image_id"), "left").drop("image_id")
    return joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(listed.schema["annotations"].dataType)))


def normalized_xywh(box: str, width: str, height: str) -> Column:
    """Columns 0 and 2 by the width, 1 and 3 by the height, clamped to [0, 1]."""
    return F.transform(box, lambda v, i: clamp01(v / F.when(i % 2 == 0, F.col(width)).otherwise(F.col(height))))


def category_queries(images: DataFrame, annotations: DataFrame, categories: DataFrame, chunk: int | None = None, negatives: bool = True) -> DataFrame:
    """image_id, chunk, category_id, name, boxes (normalised) and ids: a query per image and category.

    Categories are a label set of bounded size, so they are repeated per image
    inside the row.  Without `negatives` only categories with annotations make
    queries; `chunk` numbers groups of that many categories of an image.
    """
    a = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    a = a.groupBy("image_id", "category_id").agg(F.array_sort(F.collect_list(F.struct("id", normalized_xywh("bbox", "width", "height").alias("box")))).alias("objects"))
    labels = categories.select(F.col("id").alias("category_id"), "name")
    if negatives:
        q = images.select(F.col("id").alias("image_id")).crossJoin(labels).join(a, ["image_id", "category_id"], "left")
    else:
        q = a.join(labels, "category_id")
    empty = F.array().cast(a.schema["objects"].dataType)
    q = q.withColumn("objects", F.coalesce("objects", empty))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("category_id")) - 1
    number = F.floor(n / chunk).cast("int") if chunk else F.lit(0)
    return q.withColumn("chunk", number).select("image_id", "chunk", "category_id", "name", F.transform("objects", lambda o: o["id"]).alias("ids"), F.transform("objects", lambda o: o["box"]).alias("boxes"))


def phrase_queries(images: DataFrame) -> DataFrame:
    """A query per image and phrase."""
    return images.select(F.col("id").alias("image_id"), "file_name", F.col("text_input").alias("phrase"), "width", "height", F.coalesce("is_instance_exhaustive", F.lit(0)).cast("boolean").alias("exhaustive"))


def video_queries(videos: DataFrame, pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """A row per video, phrase and frame; the pair's phrase must be its category's name, else `agrees` is false."""
    p = pairs.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    v = videos.select(F.col("id").alias("video_id"), "height", "width", F.posexplode("file_names").alias("frame", "file_name"))
    return v.join(p.select("video_id", "category_id", "noun_phrase", F.col("category").eqNullSafe(F.col("noun_phrase")).alias("agrees")), "video_id")


def mask_cases(spark: SparkSession, path: str, glob: str = "annotation.json", objects: list[str] | None = None) -> DataFrame:
    """take (the document's folder), object, view, frame, size, counts of every mask below `path`."""
    d = documents(spark, path, MASK_MAP, glob).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("take"), F.explode("masks").alias("object", "views"))
    if objects is not None:
        d = d.where(F.col("object").isin(objects))
    d = d.select("take", "object", F.explode("views").alias("view", "frames"))
    d = d.select("take", "object", "view", F.explode("frames").alias("frame", "m"))
    return d.select("take", "object", "view", F.expr("try_cast(frame as int)").alias("frame"), "m.size", "m.counts")


def ranked_masks(masks: DataFrame, images: DataFrame) -> DataFrame:
    """`masks` (take, object, view, frame, size, counts) with area, ratio, whether an image of that frame exists
    (`images`: view, frame, path), and ranks over the object and within the view: usable first, then by ratio, area and frame."""
    from quillon.functions.masks import area, decode_text

    ok = F.col("counts").isNotNull() & (F.length("counts") > 0) & (F.size("size") == 2)
    m = masks.join(images, ["view", "frame"], "left").withColumns({"image_exists": F.col("path").isNotNull(), "decode_ok": ok})
    m = m.withColumn("pixels", F.when(ok, area(decode_text("counts"))).otherwise(0))
    extent = F.get("size", 0).cast("long") * F.get("size", 1)
    m = m.withColumn("ratio", F.when(ok & (extent > 0), F.col("pixels") / extent).otherwise(0.0))
    order = [F.desc(F.col("decode_ok") & F.col("image_exists")), F.desc("ratio"), F.desc("pixels"), "frame", "view"]
    over = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(*order))
    return m.withColumns({"rank_global": over("take", "object"), "rank_within_view": over("take", "object", "view")})


def json_strings(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of every leaf of a JSON document, however deep it is nested.

    One level after the other, each written once, until nothing is nested: a
    recursive query ends in an error at a fixed number of rows.
    """
    spark, at = df.sparkSession, shared_path(df.sparkSession, "leaves")
    kind = F.schema_of_variant("v")
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    level = df.select(F.col(key).alias("k"), F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL").withColumn("nested", nested)
    leaves = None
    for depth in itertools.count():
        found = level.where("NOT nested").select(F.col("k").alias(key), "path", F.expr("try_cast(v AS string)").alias("value"))
        leaves = found if leaves is None else leaves.unionByName(found)
        inner = level.where("nested")
        if depth and inner.isEmpty():
            return leaves
        inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("k", F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), "pos", F.lit("]")))).alias("path"), F.col("value").alias("v")).withColumn("nested", nested)
        inner.write.parquet(f"{at}/{depth}")
        level = spark.read.schema(inner.schema).parquet(f"{at}/{depth}")


def without_failures(images: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """`images` without those that no output of any run names, once an output has failed (its key is null); all of them while none has.

    All outputs decide, not those of the last file alone.
    """
    failed = outputs.agg(F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("__q_failed"))
    made = outputs.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__q_made", F.lit(True))
    # One row: the broadcast's size is fixed.
    return images.join(made, key, "left").crossJoin(F.broadcast(failed)).where("NOT __q_failed OR __q_made").drop("__q_made", "__q_failed").select(*images.columns)


def image_count(messages: DataFrame, keys: list[str], parts: str = "content") -> DataFrame:
    """keys and how many parts of type image the messages (an array of parts with a type, or null) hold."""
    n = F.coalesce(F.size(F.filter(parts, lambda p: p["type"] == "image")), F.lit(0))
    return messages.groupBy(*keys).agg(F.sum(F.when(F.col(parts).isNull(), 0).otherwise(n)).alias("images"))


def with_side_car(datapoints: DataFrame, files: DataFrame, side: DataFrame, path: str, frame: str = "frame") -> DataFrame:
    """Datapoints (with an address `file@frame`, or a file) with their file's columns and, where there is one, the row of the side-car for that file and frame.

    `files` has path; `side` path, frame (null for an image's own) and what it adds.
    """
    from quillon.sources.frames import addressed

    file, number = addressed(F.col(path))
    rows = datapoints.withColumns({"__q_file": file, frame: number})
    f = files.withColumnRenamed("path", "__q_path")
    s = side.withColumnsRenamed({"path": "__q_side", frame: "__q_frame"})
    met = rows.join(f, F.col("__q_file") == F.col("__q_path"), "left").join(s, (F.col("__q_file") == F.col("__q_side")) & F.col(frame).eqNullSafe(F.col("__q_frame")), "left")
    return met.withColumn("found", F.col("__q_path").isNotNull()).drop("__q_file", "__q_path", "__q_side", "__q_frame")
