"""Tracks of masks through the tracking and video metrics: run relations in, scores out.

Truth and found masks are rows of `operators.runs` with the columns that say
whose they are: keys (the video, or video and phrase), a frame, and gt or trk.
An object without pixels in a frame isn't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import metrics as E
from quillon.operators import runs as R
from quillon.operators.evaluation import PIXEL_AREAS, area_flags, area_truths, precision_recall
from quillon.streaming.runs import shared_path


def similarity(truth: DataFrame, found: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """keys, t, gt, trk, sim of the masks that share pixels in a frame."""
    pairs = R.overlaps(truth, found, [*keys, t], "gt", "trk")
    return pairs.select(*keys, t, "gt", "trk", F.col("iou").alias("sim"))


def _there(segs: DataFrame, columns: list[str]) -> DataFrame:
    return segs.select(*columns).distinct()


def hota(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str] = (), t: str = "t") -> DataFrame:
    """`by` (of the keys) and the scores of higher order tracking accuracy, combined over the videos and averaged over the levels."""
    g, k = _there(truth, [*keys, t, "gt"]), _there(found, [*keys, t, "trk"])
    sequences = E.hota_sequences(g, k, similarity(truth, found, keys, t), keys, t)
    return E.over_levels(E.hota_combined(sequences, list(by)), list(by))


def teta(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str] = (), t: str = "t") -> DataFrame:
    """`metrics.teta_scores` of masks with a class: `truth` has cls beside gt, `found` beside trk; `by` of cls and the keys."""
    g, k = _there(truth, [*keys, t, "gt", "cls"]), _there(found, [*keys, t, "trk", "cls"])
    return E.teta_scores(E.teta_sequences(g, k, similarity(truth, found, keys, t), keys, t), list(by))


def volumes(truth: DataFrame, found: DataFrame, keys: list[str], t: str = "t", trk: str = "trk") -> DataFrame:
    """keys, gt, trk, iou of tracks that meet: shared pixels over all frames by the pixels of either."""
    met = R.overlaps(truth, found, [*keys, t], "gt", trk).groupBy(*keys, "gt", trk).agg(F.sum("shared").alias("__q_s"))
    whole = met.join(R.areas(truth, [*keys, "gt"], "__q_g"), [*keys, "gt"]).join(R.areas(found, [*keys, trk], "__q_k"), [*keys, trk])
    return whole.select(*keys, "gt", trk, (F.col("__q_s") / (F.col("__q_g") + F.col("__q_k") - F.col("__q_s"))).alias("iou"))


def phrase_rows(units: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """`metrics.phrase_units` of whole tracks: a row per video, phrase and threshold, of all `units`; `metrics.phrase_summary` sums them up."""
    pairs = volumes(truth, found, keys, t).withColumnRenamed("trk", "dt")
    return E.phrase_units(units, _there(truth, [*keys, "gt"]), _there(found, [*keys, "trk"]).withColumnRenamed("trk", "dt"), pairs, keys)


def precision(truth: DataFrame, found: DataFrame, scores: DataFrame, video: str, category: str, areas: dict[str, tuple[float, float]] = PIXEL_AREAS, thresholds: list[float] = E.BOX_LEVELS, t: str = "t") -> DataFrame:
    """`evaluation.precision_recall` of tracks of masks by category and area range (of the mean area over a track's frames); `scores` has video, category, trk, score."""
    keys = [video, category]

    def tracks(segs: DataFrame, name: str) -> DataFrame:
        frames = R.areas(segs, [*keys, t, name], "__q_a")
        return frames.groupBy(*keys, name).agg(F.avg("__q_a").alias("area"))

    g = tracks(truth, "gt").withColumns({"ignore": F.lit(False), "crowd": F.lit(False)})
    d = tracks(found, "trk").join(scores.select(*keys, "trk", "score"), [*keys, "trk"]).withColumnRenamed("trk", "det")
    m = area_flags(g, d, volumes(truth, found, keys, t).withColumnRenamed("trk", "det"), keys, areas, thresholds)
    m = m.withColumn("ord", F.struct(video, "det"))
    return precision_recall(m, area_truths(g.drop(video), [category], areas), [category], areas, thresholds)


def joined_report(spark: SparkSession, parts: dict[str, DataFrame]) -> DataFrame:
    """evaluator, metric, value: the (metric, value) rows of several evaluators, each under its name.

    Every part is written before the next one is planned, so that a report of
    many doesn't become one plan of all of them.
    """
    at, named = shared_path(spark, "report"), []
    for n, df in parts.items():
        df.select(F.lit(n).alias("evaluator"), "metric", F.col("value").cast("double").alias("value")).write.parquet(f"{at}/{n}")
        named.append(spark.read.schema("evaluator string, metric string, value double").parquet(f"{at}/{n}"))
    return reduce(DataFrame.unionByName, named)
