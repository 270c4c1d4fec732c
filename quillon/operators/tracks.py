"""Conversions between tracks with arrays per frame, rows per frame and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.windows import rank_globally


def frames_of(tracks: DataFrame, keys: list[str], arrays: list[str], t: str = "t") -> DataFrame:
    """A row per track and frame from parallel arrays, frames from 0; shorter arrays give nulls."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rest = [c for c in tracks.columns if c not in arrays]
    rows = tracks.select(*rest, F.posexplode(zipped).alias(t, "__q_v"))
    return rows.select(*rest, t, *[F.col(f"__q_v.{a}").alias(a) for a in arrays])


def truth_frames(tracks: DataFrame, keys: list[str], box: str, t: str = "t", frame_id: str = "id") -> DataFrame:
    """Rows of the frames in which a track has a box, numbered from 1 in the order of keys and frame."""
    rows = frames_of(tracks, keys, [box], t).where(F.col(box).isNotNull())
    return rank_globally(rows, [*keys, t], frame_id)


def found_frames(tracks: DataFrame, keys: list[str], box: str, area: str, t: str = "t") -> DataFrame:
    """Rows of the frames with a box that isn't all zero; a missing area is width times height (boxes are x, y, w, h)."""
    from quillon.functions.boxes import is_zero

    rows = frames_of(tracks, keys, [box, area], t).where(~is_zero(F.col(box)))
    return rows.withColumn(area, F.coalesce(F.col(area), F.get(F.col(box), 2) * F.get(F.col(box), 3)))


def tracks_of(frames: DataFrame, lengths: DataFrame, video: str, track: str, t: str, box: str, mask: str, score: str, label: str, missing_score: float = -1e8) -> DataFrame:
    """video, track, score (mean), label (most frequent, smallest of equals), and arrays over all frames of the video.

    `lengths` has video and n_frames.  In frames without a row the box is four
    zeros, the mask null and the frame's score `missing_score`.  A track's rows
    meet in one group: as many as its video has frames.
    """
    seen = frames.groupBy(video, track).agg(F.avg(score).alias(score), F.mode(label, True).alias(label), F.map_from_entries(F.collect_list(F.struct(F.col(t).cast("int"), F.struct(F.col(box).alias("b"), F.col(mask).alias("m"), F.col(score).alias("s"))))).alias("__q_at"))
    joined = seen.join(lengths.select(video, "n_frames"), video)
    every = F.when(F.col("n_frames") > 0, F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.try_element_at("__q_at", i)
    zero = F.array_repeat(F.lit(0.0), 4)
    return joined.select(
        video, track, score, label,
        F.transform(every, lambda i: F.coalesce(at(i)["b"], zero)).alias("boxes"), F.transform(every, lambda i: at(i)["m"]).alias("masks"),
        F.transform(every, lambda i: F.coalesce(at(i)["s"], F.lit(missing_score))).alias("frame_scores"),
    )


def result_rows(predictions: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """A row per detection from an image's parallel arrays."""
    return predictions.select(*keys, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def rounded(df: DataFrame, box: str, score: str, places: int = 5) -> DataFrame:
    """Coordinates and score as a results file holds them."""
    return df.withColumns({box: F.transform(box, lambda v: F.bround(v, places)), score: F.bround(score, places)})


def scored(predictions: DataFrame, logit: str, presence: str | None = None, score: str = "score") -> DataFrame:
    """Sigmoid of the logit, times that of the presence logit if there is one."""
    p = F.lit(1.0) / (1 + F.exp(-F.col(logit)))
    return predictions.withColumn(score, p if presence is None else p / (1 + F.exp(-F.col(presence))))


def best_detections(df: DataFrame, image: str, score: str, ties: list[str], threshold: float, most: int, inclusive: bool = False) -> DataFrame:
    """Rows above (or, `inclusive`, at) the threshold, of each image at most `most`."""
    kept = df.where(F.col(score) >= threshold if inclusive else F.col(score) > threshold)
    n = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score), *ties))
    return kept.withColumn("__q_n", n).where(F.col("__q_n") <= most).drop("__q_n")


def by_video(videos: DataFrame, rows: DataFrame, video: str, order: list[str], name: str = "rows") -> DataFrame:
    """Each video with the ordered list of its rows, empty where it has none."""
    rest = [c for c in rows.columns if c != video and c not in order]
    listed = rows.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    joined = videos.join(listed, video, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(listed.schema[name].dataType)))


def positions(frames: DataFrame, video: str, order: str, name: str = "t") -> DataFrame:
    """Each frame's position in its video, from 0."""
    return frames.withColumn(name, F.row_number().over(Window.partitionBy(video).orderBy(order)) - 1)


def tiled(df: DataFrame, stages: int, name: str = "stage") -> DataFrame:
    """Each row once per stage."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(stages - 1))))


def padded(values: Column, size: int, fill) -> Column:
    """An array filled up to `size`."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def missing_video(rows: DataFrame, images: DataFrame, image: str, video: str) -> DataFrame:
    """`rows` whose missing video id comes from their image."""
    side = images.select(F.col(image).alias("__q_i"), F.col(video).alias("__q_v"))
    return rows.join(side, F.col(image) == F.col("__q_i"), "left").withColumn(video, F.coalesce(video, "__q_v")).drop("__q_i", "__q_v")


def every_frame_known(rows: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of frames that no image stands for: an empty result is the assertion."""
    return rows.join(images.select(*keys), keys, "left_anti")
