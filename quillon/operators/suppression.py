"""Suppression of overlapping detections and tracks, as pairs and one ordered fold per group.

Pairs come first, as a relation: a join inside a group, or, where boxes of a
group are many, a join on the grid cells that both boxes touch.  Fast
suppression is then an anti-join; greedy suppression folds each group's items
in rank order, with nothing but ids in the fold.  A group is an image, a frame
or a video: what it holds is bounded by the detector's cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.partitions import dealt

Overlap = Callable[[Column, Column], Column]


def group_pairs(df: DataFrame, keys: list[str], item: str, columns: list[str], cell: float | None = None, box: str | None = None, tasks: int = 0) -> DataFrame:
    """Pairs of different items of one group: keys, a, b (structs of `item` and `columns`), each once with a.item < b.item.

    With `cell`, only pairs whose boxes (column `box`) share a grid cell of that
    size; a pair meets in the cell where the boxes' common part begins, and
    nowhere else, so no pair is repeated.  Cells are dealt over `tasks` tasks at
    least.
    """
    side = df.select(*keys, F.struct(F.col(item).alias("item"), *columns).alias("s"))
    if cell is None:
        a, b = side.withColumnRenamed("s", "a"), side.withColumnRenamed("s", "b")
        return a.join(b, keys).where("a.item < b.item")

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    # The boxes of a side are some columns of files, small on disk; as rows per cell they are too many to broadcast, or for a task per core.
    placed = df.select(*keys, F.struct(F.col(item).alias("item"), *columns).alias("s"), *([] if box in columns else [F.col(box).alias("__q_b")]))
    at = F.col("s")[box] if box in columns else F.col("__q_b")
    placed = placed.withColumn("__q_x", F.explode(span(at["x1"], at["x2"]))).withColumn("__q_y", F.explode(span(at["y1"], at["y2"])))
    placed = dealt(placed, *keys, "__q_x", "__q_y", tasks=tasks)
    a = placed.withColumnsRenamed({"s": "a", "__q_b": "__q_ba"})
    b = placed.withColumnsRenamed({"s": "b", "__q_b": "__q_bb"})
    met = a.join(b.hint("merge"), [*keys, "__q_x", "__q_y"]).where("a.item < b.item")
    box_a, box_b = (F.col(n)[box] if box in columns else F.col(f"__q_b{n}") for n in "ab")
    first = (F.col("__q_x") == F.floor(F.greatest(box_a["x1"], box_b["x1"]) / cell)) & (F.col("__q_y") == F.floor(F.greatest(box_a["y1"], box_b["y1"]) / cell))
    return met.where(first).select(*keys, "a", "b")


def conflicts(df: DataFrame, keys: list[str], item: str, rank: str, box: str, overlap: Overlap, threshold: float, inclusive: bool = False, cell: float | None = None, tasks: int = 0) -> DataFrame:
    """keys, winner, loser: items whose overlap exceeds (or, `inclusive`, reaches) the threshold, the one of smaller rank first."""
    pairs = group_pairs(df, keys, item, [rank, box], cell, box, tasks)
    value = overlap(F.col("a")[box], F.col("b")[box])
    pairs = pairs.where(value >= threshold if inclusive else value > threshold)
    ahead = F.col("a")[rank] < F.col("b")[rank]
    return pairs.select(*keys, F.when(ahead, F.col("a.item")).otherwise(F.col("b.item")).alias("winner"), F.when(ahead, F.col("b.item")).otherwise(F.col("a.item")).alias("loser"))


def ranked(df: DataFrame, keys: list[str], score: str, ties: list[str], name: str = "rank") -> DataFrame:
    """1, 2, ... by score, best first; equal scores by `ties`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties)))


def fast_nms(df: DataFrame, keys: list[str], item: str, found: DataFrame) -> DataFrame:
    """Rows that no better item conflicts with, be that one suppressed itself or not. `found`: of `conflicts`."""
    return df.join(found.select(*keys, F.col("loser").alias(item)).distinct(), [*keys, item], "left_anti")


def greedy_nms(df: DataFrame, keys: list[str], item: str, rank: str, found: DataFrame) -> DataFrame:
    """Rows that no kept item conflicts with, in rank order: only kept items suppress. `found`: of `conflicts`."""
    against = found.groupBy(*keys, F.col("loser").alias(item)).agg(F.collect_list("winner").alias("__q_against"))
    listed = df.join(against, [*keys, item])
    # Only items that some better one conflicts with are folded; all others are kept. Winners that nothing is better than begin, so the pairs are needed once.
    folded = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col("__q_against").alias("c")))).alias("__q_items"))
    items = F.transform("__q_items", lambda x: x["i"])
    free = F.array_except(F.flatten(F.transform("__q_items", lambda x: x["c"])), items)
    kept = F.aggregate("__q_items", free, lambda s, x: F.when(F.arrays_overlap(s, x["c"]), s).otherwise(F.concat(s, F.array(x["i"]))))
    gone = folded.select(*keys, F.explode(F.array_except(items, kept)).alias(item))
    return df.join(gone, [*keys, item], "left_anti")


def track_overlap(boxes: DataFrame, keys: list[str], track: str, t: str, box: str, intersection: Overlap, area: Callable[[Column], Column], both_only: bool) -> DataFrame:
    """keys, a, b, iou of pairs of tracks: the sum over frames of what they share by the sum of their unions.

    With `both_only`, frames where one of the two is absent don't count; else
    the present one's area goes to the union.  `boxes` has a row per track and
    frame, absent ones missing or null.  Pairs that meet in no frame are left
    out: their overlap is 0.
    """
    present = boxes.where(F.col(box).isNotNull())
    met = group_pairs(present, [*keys, t], track, [box]).select(*keys, F.col("a.item").alias("a"), F.col("b.item").alias("b"), intersection(F.col("a")[box], F.col("b")[box]).alias("i"), area(F.col("a")[box]).alias("aa"), area(F.col("b")[box]).alias("ab"))
    sums = met.groupBy(*keys, "a", "b").agg(F.sum("i").alias("i"), F.sum("aa").alias("aa"), F.sum("ab").alias("ab"))
    if not both_only:
        whole = present.groupBy(*keys, track).agg(F.sum(area(F.col(box))).alias("__q_area"))
        side = {s: whole.select(*keys, F.col(track).alias(s), F.col("__q_area").alias(f"w{s}")) for s in "ab"}
        sums = sums.join(side["a"], [*keys, "a"]).join(side["b"], [*keys, "b"]).withColumns({"aa": F.col("wa"), "ab": F.col("wb")})
    union = F.col("aa") + F.col("ab") - F.col("i")
    return sums.select(*keys, "a", "b", F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("iou"))


def track_nms(boxes: DataFrame, scores: DataFrame, keys: list[str], track: str, t: str, box: str, score: str, intersection: Overlap, area: Callable[[Column], Column], threshold: float) -> DataFrame:
    """`boxes` with null boxes in all frames of the tracks that a kept, better track reaches `threshold` with.

    Tracks without a box in any frame neither suppress nor are suppressed.
    `scores`: one row per track; equal scores by track.
    """
    order = ranked(scores.select(*keys, track, score), keys, score, [track], "__q_rank")
    pairs = track_overlap(boxes, keys, track, t, box, intersection, area, True).where(F.col("iou") >= threshold)
    side = {s: order.select(*keys, F.col(track).alias(s), F.col("__q_rank").alias(f"r{s}")) for s in "ab"}
    pairs = pairs.join(side["a"], [*keys, "a"]).join(side["b"], [*keys, "b"])
    ahead = F.col("ra") < F.col("rb")
    found = pairs.select(*keys, F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("loser"))
    kept = greedy_nms(order, keys, track, "__q_rank", found).select(*keys, track, F.lit(True).alias("__q_kept"))
    out = boxes.join(kept, [*keys, track], "left").withColumn(box, F.when(F.col("__q_kept"), F.col(box))).drop("__q_kept")
    return out.select(*boxes.columns)


def arbitrate(df: DataFrame, keys: list[str], owner: str, score: str) -> DataFrame:
    """Each contested place (`keys`) goes to the owner of the highest score, the smallest owner of equals."""
    return df.groupBy(*keys).agg(F.min_by(owner, F.struct((-F.col(score)).alias("s"), owner)).alias(owner))


def most_recently_hidden(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item: of overlapping pairs (a, last_a, b, last_b) the one hidden later, if the other ever was (last > -1)."""
    a = pairs.where("last_a > last_b AND last_b > -1").select(*keys, F.col("a").alias("item"))
    b = pairs.where("last_b > last_a AND last_a > -1").select(*keys, F.col("b").alias("item"))
    return a.union(b).distinct()
