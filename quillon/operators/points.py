"""Points sampled from run-length masks, boxes and errors; draws depend on a seed and the keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import runs as R
from quillon.operators.transforms import drawn, drawn_between
from quillon.streaming.runs import shared_path

MODES = ("centered", "random_mask", "random_box")


def _draws(masks: DataFrame, n: int) -> DataFrame:
    return masks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _at_place(segs: DataFrame, asked: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """The pixel of number `__q_place` (column by column) of each row of `asked`, with columns `carry` of its segment."""
    n = F.col("y1") - F.col("y0")
    before = F.sum(n).over(Window.partitionBy(*keys).orderBy("x", "y0").rowsBetween(Window.unboundedPreceding, 0)) - n
    met = asked.join(segs.withColumn("__q_before", before), keys).where("__q_place >= __q_before AND __q_place < __q_before + y1 - y0")
    return met.select(*keys, "i", "x", (F.col("y0") + F.col("__q_place") - F.col("__q_before")).alias("y"), *carry)


def from_masks(segs: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """keys, i, x, y, positive: `n` pixels of each mask, each equally likely; masks without pixels have none."""
    asked = _draws(R.areas(segs, keys, "__q_n"), n)
    asked = asked.withColumn("__q_place", drawn_between(drawn(seed, "mask", *[F.col(k) for k in keys], F.col("i")), 0, F.col("__q_n") - 1).cast("long"))
    return _at_place(segs, asked, keys).withColumn("positive", F.lit(True))


def from_boxes(boxes: DataFrame, segs: DataFrame, keys: list[str], box: str, n: int, seed: int) -> DataFrame:
    """keys, i, x, y, positive: `n` whole pixels of each box {x1, y1, x2, y2}, edges rounded up and the far ones excluded; positive where the mask is."""
    b, ids = F.col(box), [*[F.col(k) for k in keys], F.col("i")]
    place = lambda name, low, high: drawn_between(drawn(seed, name, *ids), F.ceil(low), F.ceil(high) - 1).cast("long")
    there = boxes.where((F.ceil(b["x2"]) > F.ceil(b["x1"])) & (F.ceil(b["y2"]) > F.ceil(b["y1"])))
    asked = _draws(there.select(*keys, box), n).withColumns({"x": place("x", b["x1"], b["x2"]), "y": place("y", b["y1"], b["y2"])}).drop(box)
    hit = asked.join(segs.select(*keys, "x", "y0", "y1"), [*keys, "x"]).where("y >= y0 AND y < y1").select(*keys, "i", F.lit(True).alias("positive"))
    return asked.join(hit, [*keys, "i"], "left").select(*keys, "i", "x", "y", F.coalesce("positive", F.lit(False)).alias("positive"))


def centered(segs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, i, x, y, positive: the pixel deepest in the mask, then the deepest when that is taken out, and so on; ties go to the first in reading order.

    Each step is written, so a later one doesn't repeat those before.
    """
    spark, at, out = segs.sparkSession, shared_path(segs.sparkSession, "centered"), None
    left = segs.select(*keys, "x", "y0", "y1")
    for i in range(n):
        deepest = R.squared_distances(left, keys).groupBy(*keys).agg(F.min(F.struct((-F.col("d2")).alias("d"), "y", "x")).alias("p"))
        deepest.select(*keys, F.lit(i).alias("i"), "p.x", "p.y", F.lit(True).alias("positive")).write.parquet(f"{at}/{i}")
        step = spark.read.parquet(f"{at}/{i}")
        out = step if out is None else out.unionByName(step)
        left = R.combined(left, step.select(*keys, "x", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1")), keys, lambda a, b: a & ~b)
    return out


def sampled(segs: DataFrame, keys: list[str], n: int, mode: str, seed: int = 0, boxes: DataFrame | None = None, box: str = "box") -> DataFrame:
    """Points of each mask by one of MODES; another mode, or random_box without boxes, is an error."""
    if mode == "centered":
        return centered(segs, keys, n)
    if mode == "random_mask":
        return from_masks(segs, keys, n, seed)
    if mode == "random_box" and boxes is not None:
        return from_boxes(boxes, segs, keys, box, n, seed)
    raise ValueError(f"mode {mode} is none of {', '.join(MODES)}, or it lacks boxes")


def from_errors(truth: DataFrame, found: DataFrame, pairs: DataFrame, keys: list[str], n: int, seed: int, height: int, width: int) -> DataFrame:
    """keys, i, x, y, positive: `n` pixels each where truth and found differ, positive where something was missed.

    Where nothing differs they come from outside of the truth, negative; there
    are none if that is nowhere.
    """
    missed, wrong = R.combined(truth, found, keys, lambda a, b: a & ~b), R.combined(truth, found, keys, lambda a, b: ~a & b)
    errors = missed.withColumn("positive", F.lit(True)).unionByName(wrong.withColumn("positive", F.lit(False)))
    right = pairs.select(*keys).join(errors.select(*keys).distinct(), keys, "left_anti")
    outside = R.complement(truth.join(right, keys, "left_semi"), right, keys, height, width).withColumn("positive", F.lit(False))
    every = errors.unionByName(outside)
    asked = _draws(R.areas(every, keys, "__q_n"), n)
    asked = asked.withColumn("__q_place", drawn_between(drawn(seed, "error", *[F.col(k) for k in keys], F.col("i")), 0, F.col("__q_n") - 1).cast("long"))
    return _at_place(every, asked, keys, ["positive"])


def mask_boxes(segs: DataFrame, masks: DataFrame, keys: list[str], exclusive: bool = False, empty: Column | None = None) -> DataFrame:
    """keys and box [x1, y1, x2, y2] of the pixels of each of `masks`: far edges included or one beyond; `empty` (null unless given, such as four zeros) where there are none."""
    more = 1 if exclusive else 0
    found = segs.groupBy(*keys).agg(F.array(F.min("x"), F.min("y0"), F.max("x") + more, F.max("y1") - 1 + more).alias("box"))
    out = masks.select(*keys).join(found, keys, "left")
    return out if empty is None else out.withColumn("box", F.coalesce("box", empty))
