"""Frames and files: what there is, in which order, and by which route it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import last_digits

#: Fixed values.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png"]
VIDEO_SUFFIXES = ["mp4", "mov", "avi", "mkv", "webm"]


def file_listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, stem, suffix and length of each file below `path`; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    return rows.select("path", name.alias("name"), stem.alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).alias("suffix"), "length")


def frame_map(files: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(frames with their id, rejects with a reason).

    An image's frame is the last run of digits of its stem; of several files of
    one frame the first by name counts.
    """
    images = files.where(F.col("suffix").isin(IMAGE_SUFFIXES)).withColumn("frame", last_digits(F.col("stem")))
    n = F.row_number().over(Window.partitionBy(*by, "frame").orderBy("name", "path"))
    numbered = images.withColumn("__q_n", F.when(F.col("frame").isNotNull(), n))
    frames = numbered.where("__q_n = 1").drop("__q_n")
    rejects = numbered.where("frame IS NULL OR __q_n > 1").withColumn("reason", F.when(F.col("frame").isNull(), "no frame id").otherwise("repeated frame id"))
    return frames, rejects.drop("__q_n")


def numeric_stems(files: DataFrame) -> DataFrame:
    """Files whose stem is a number, with it."""
    return files.withColumn("frame", F.expr("try_cast(stem as bigint)")).where(F.col("frame").isNotNull())


def route(path: Column, is_directory: Column) -> Column:
    """By which reader a path goes: synthetic, folder or video; what has no known suffix is tried as a video."""
    synthetic = F.startswith(path, F.lit("<load-dummy-video")) | F.startswith(path, F.lit("<load-zero-video"))
    return F.when(synthetic, "synthetic").when(is_directory, "folder").otherwise("video")


def synthetic_length(path: Column, default: int = 60) -> Column:
    """Frames that a synthetic path asks for."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^<load-(?:dummy|zero)-video-(\d+)>", 1), F.lit("")).cast("int"), F.lit(default))


def synthetic_frames(spark: SparkSession, n: int, height: int = 480, width: int = 640, rate: bool = False) -> DataFrame:
    """n numbered frames; as a stream with `rate`, one each second."""
    if rate:
        rows = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("value").alias("frame"))
    else:
        rows = spark.range(n).select(F.col("id").alias("frame"))
    return rows.withColumns({"height": F.lit(height), "width": F.lit(width)})


def addressed(path: Column) -> tuple[Column, Column]:
    """File and frame of `video.mp4@17`; without `@` the path and null."""
    return F.substring_index(path, "@", 1), F.when(F.instr(path, "@") > 0, F.substring_index(path, "@", -1).cast("int"))


def shuffled_batches(df: DataFrame, key: str, size: int, seed: int = 0, shards: int = 1, drop_last: bool = False) -> DataFrame:
    """Rows in a seeded order, dealt round to `shards` and cut into numbered batches of `size`."""
    from quillon.operators.windows import rank_globally

    order = df.withColumn("__q_h", F.xxhash64(F.lit(seed), key))
    ranked = rank_globally(order, ["__q_h", key], "__q_place").withColumn("__q_i", F.col("__q_place") - 1)
    placed = ranked.withColumn("shard", F.col("__q_i") % shards).withColumn("__q_k", F.floor(F.col("__q_i") / shards))
    placed = placed.withColumn("batch", F.floor(F.col("__q_k") / size))
    if drop_last:
        placed = placed.withColumn("__q_size", F.count("*").over(Window.partitionBy("shard", "batch"))).where(F.col("__q_size") == size).drop("__q_size")
    return placed.drop("__q_h", "__q_place", "__q_i", "__q_k")


def find_item(documents: DataFrame, text: str, wanted: DataFrame, order: list[str]) -> DataFrame:
    """For each wanted (exact, view, take) the first document that holds the exact id, else the view, else the take.

    An id stands in a document where characters outside `[A-Za-z0-9_.-]`, or its
    ends, bound it, so documents and look-ups meet by their words.
    """
    names = wanted.select("exact", "view", "take", F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.col(c).alias("name")) for i, c in enumerate(("exact", "view", "take"))])).alias("w")).select("exact", "view", "take", "w.*").where("name IS NOT NULL")
    words = documents.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.-]+"), F.lit(0)))))
    hits = words.join(names, "name").drop("name")
    n = F.row_number().over(Window.partitionBy("exact").orderBy("tier", *order))
    return hits.withColumn("__q_n", n).where("__q_n = 1").drop("__q_n")


def cases(files: DataFrame, name: str, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """case, path: the folders that hold a file of that name, those listed in `ids` if given, the first `most` by their names if given; of a folder name that occurs twice every one."""
    parts = F.split("path", "/")
    found = files.where(F.element_at(parts, -1) == name).select(F.element_at(parts, -2).alias("case"), "path")
    if ids is not None:
        found = found.where(F.col("case").isin(ids))
    return found if most is None else found.orderBy("case", "path").limit(most)


def lone_files(files: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(folder, path of folders with exactly one file of the suffix; folder, n of those with more)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)
    counts = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)) == suffix.lower()).groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return counts.where("n = 1").select("folder", "path"), counts.where("n > 1").select("folder", "n")


def unknown_classes(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """The distinct classes of the rows that the list doesn't hold: an empty result is the assertion."""
    return rows.select(column).distinct().where(F.col(column).isNull() | ~F.col(column).isin(known))
