"""One-to-one assignment per group, greedy threshold matching and associations.

The relation of pairs is made, filtered and grouped by Spark; what no
expression can say, the optimum of a matrix with conflicts, is solved in NumPy.
A group is one frame or one image and phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.operators.partitions import dealt


def best_assignment(weight: np.ndarray) -> np.ndarray:
    """For each row its column, or -1, such that the sum of the chosen weights is largest; by shortest augmenting paths."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight).astype(float)
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    column_of, row_of = np.full(n, -1), np.full(m, -1)
    for start in range(n):
        distance, came = np.full(m, np.inf), np.full(m, -1)
        reached, here, low, visited = np.zeros(m, bool), start, 0.0, []
        while True:
            through = low + cost[here] - row_price[here] - column_price
            shorter = ~reached & (through < distance)
            distance[shorter], came[shorter] = through[shorter], here
            column = int(np.argmin(np.where(reached, np.inf, distance)))
            low, reached[column] = distance[column], True
            if row_of[column] < 0:
                break
            here = int(row_of[column])
            visited.append(here)
        row_price[start] += low
        if visited:
            row_price[visited] += low - distance[column_of[visited]]
        column_price[reached] -= low - distance[reached]
        while True:
            here = int(came[column])
            row_of[column], column, column_of[here] = here, int(column_of[here]), column
            if here == start:
                break
    return row_of if flip else column_of


def _parts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the connected part of each edge (i, j) of a bipartite graph: the smallest edge in it."""
    part = np.arange(len(i))
    while True:
        low = part
        for ends in (i, j):
            least = np.full(ends.max() + 1, len(i))
            np.minimum.at(least, ends, low)
            low = least[ends]
        if (low == part).all():
            return part
        part = low


def assign(pairs: DataFrame, keys: list[str], a: str, b: str, weight: str, carry: list[str] = ()) -> DataFrame:
    """The rows of `pairs` (one per group and pair, positive weights) of each group's best one-to-one assignment.

    Pairs that are missing weigh 0; chosen ones of weight 0 make no row.  Of
    several optima one is taken, the same for the same rows.  A pair whose sides
    have no other is chosen as it is, without a matrix; those of
    all others, one per connected part of a group, are solved many groups a batch.
    """
    source = pairs.select(*keys, a, b, weight, *carry).where(F.col(weight) > 0)
    n_a, n_b = (F.count("*").over(Window.partitionBy(*keys, x)) for x in (a, b))
    # Dealt by group once: both counts find their rows there.
    counted = (dealt(source, *keys) if keys else source.repartition(1)).withColumn("__q_a", n_a).withColumn("__q_alone", (n_b == 1) & (F.col("__q_a") == 1)).drop("__q_a")
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    grouped = counted.withColumn("__q_group", F.when(F.col("__q_alone"), "").otherwise(group)).sortWithinPartitions("__q_alone", "__q_group", a, b)

    def solved(t: pa.Table) -> pa.RecordBatch:
        group = t.column("__q_group").combine_chunks().dictionary_encode()
        g = group.indices.to_numpy()
        _, i = np.unique(t.column(a).to_numpy(), return_inverse=True)
        _, j = np.unique(t.column(b).to_numpy(), return_inverse=True)
        w, keep = t.column(weight).to_numpy(), np.array(t.column("__q_alone").to_numpy(zero_copy_only=False), bool)
        some = np.flatnonzero(~keep)
        if len(some):
            # Sides of different groups are different nodes.
            _, x = np.unique(np.stack([g[some], i[some]]), axis=1, return_inverse=True)
            _, y = np.unique(np.stack([g[some], j[some]]), axis=1, return_inverse=True)
            part = _parts(x, y)
            order = np.argsort(part, kind="stable")
            for edges in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                rows, p = np.unique(x[edges], return_inverse=True)
                cols, q = np.unique(y[edges], return_inverse=True)
                matrix = np.zeros((len(rows), len(cols)))
                matrix[p, q] = w[some[edges]]
                keep[some[edges]] = best_assignment(matrix)[p] == q
        kept = t.filter(pa.array(keep)).drop_columns(["__q_alone", "__q_group"]).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # The last group may go on in the next batch; rows without conflicts go as they come.
            names = batch.column("__q_group")
            open_ = names.index(names[-1]).as_py() if batch.num_rows and names[-1].as_py() else batch.num_rows
            if held and batch.num_rows and (open_ or names[0] != held[-1].column("__q_group")[-1]):
                yield solved(pa.Table.from_batches([*held, batch.slice(0, open_)]))
                held = []
            elif open_:
                yield solved(pa.Table.from_batches([batch.slice(0, open_)]))
            if open_ < batch.num_rows:
                held.append(batch.slice(open_))
        if held:
            yield solved(pa.Table.from_batches(held))

    return grouped.mapInArrow(run, source.schema)


def greedy_match(truth: DataFrame, found: DataFrame, overlaps: DataFrame, keys: list[str], thresholds: list[float], most: int = 100) -> DataFrame:
    """keys, det, score, threshold, hit, ignored for each detection and threshold, by the public COCO protocol.

    `truth`: keys, gt, ignore, crowd.  `found`: keys, det, score.  `overlaps`:
    keys, gt, det, iou (a crowd's divides by the detection's area).  Per group
    the `most` best detections, best first, each take the free ground truth of
    the highest overlap of at least min(threshold, 1 - 1e-10); one that isn't
    ignored comes first, a crowd stays free.  A detection on an ignored ground
    truth is ignored itself.
    """
    m = match_flags(truth, found, overlaps, keys, thresholds, most)
    levels = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.substring("flags", i + 1, 1).alias("f")) for i, t in enumerate(thresholds)])
    m = m.select(*keys, "det", "score", F.explode(levels).alias("__q_t")).select(*keys, "det", "score", "__q_t.*")
    return m.select(*keys, "det", "score", "threshold", F.col("f").isin("2", "3").alias("hit"), F.col("f").isin("0", "3").alias("ignored"))


def match_flags(truth: DataFrame, found: DataFrame, overlaps: DataFrame, keys: list[str], thresholds: list[float], most: int = 100, areas: list[tuple[float, float]] = ()) -> DataFrame:
    """keys, det, score, place, flags: the outcome of `greedy_match` as one row per detection, a character of flags a threshold: 1 a miss, 2 a hit, 0 and 3 the same ignored.

    With `areas`, truth and found have an area, and flags hold all thresholds of
    each range in turn.  Ranges overlap, so each is matched by itself: ground
    truths outside it are ignored there, and so are detections outside it that
    meet nothing.  A group (an image and a category) is one row of either side,
    so each side is shuffled once.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "det"))
    area = F.col("area").cast("double") if areas else F.lit(None).cast("double")
    dets = found.withColumn("place", place).where(F.col("place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "det", F.col("score").cast("double").alias("score"), area.alias("area")))).alias("dets"))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    truths = truth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gt", flag("ignore"), flag("crowd"), area.alias("area")))).alias("__q_g"))
    near = overlaps.where(F.col("iou") >= min(*thresholds, 1 - 1e-10)).groupBy(*keys).agg(F.collect_list(F.struct("gt", "det", F.col("iou").cast("double").alias("iou"))).alias("__q_p"))
    met = near.join(truths, keys)
    # Places of either side in its list; pairs of what isn't there fall out.
    both = dets.join(met, keys, "left")
    g = F.col("__q_g")
    at = F.transform("__q_p", lambda p: F.struct(F.array_position(F.col("dets.det"), p["det"]).cast("int").alias("place"), F.array_position(g["gt"], p["gt"]).cast("int").alias("gt"), p["iou"].alias("iou")))
    at = F.filter(at, lambda p: (p["place"] > 0) & (p["gt"] > 0))
    pairs = F.transform(at, lambda p: F.struct(p["place"].alias("place"), p["gt"].alias("gt"), p["iou"].alias("iou"), F.get(g, p["gt"] - 1)["ignore"].alias("ignore"), F.get(g, p["gt"] - 1)["crowd"].alias("crowd"), F.get(g, p["gt"] - 1)["area"].alias("area")))
    kind = "array<struct<place: int, gt: int, iou: double, ignore: boolean, crowd: boolean, area: double>>"
    grouped = both.select(*keys, "dets", F.coalesce(pairs, F.array()).cast(kind).alias("pairs"))
    schema = T.StructType([*[grouped.schema[k] for k in keys], grouped.schema["dets"], T.StructField("flags", T.ArrayType(T.StringType()))])
    done = grouped.mapInArrow(_greedy(keys, np.minimum(thresholds, 1 - 1e-10), list(areas)), schema)
    rows = done.select(*keys, F.explode(F.arrays_zip("dets", "flags")).alias("__q_z"))
    return rows.select(*keys, "__q_z.dets.det", "__q_z.dets.score", "__q_z.dets.place", "__q_z.flags")


def _greedy(keys: list[str], levels: np.ndarray, areas: list[tuple[float, float]]) -> Callable:
    """The flags of each group's detections, all groups of a batch and all levels at once: first every group's best detection takes its ground truth, then every second one, and so on."""

    def solve(first: np.ndarray, group: np.ndarray, place: np.ndarray, gt: np.ndarray, iou: np.ndarray, ignore: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # By detection, then by what it would rather take: not ignored, the higher overlap, the later ground truth.
        order = np.lexsort((gt, iou, ~ignore, group, place))
        group, place, gt, iou, ignore, crowd = (v[order] for v in (group, place, gt, iou, ignore, crowd))
        gt = gt + group * (int(gt.max(initial=0)) + 1)
        taken = np.zeros((int(gt.max(initial=0)) + 1, len(levels)), bool)
        hit, ignored = (np.zeros((int(first[-1]), len(levels)), bool) for _ in range(2))
        ends = np.flatnonzero(np.diff(place)) + 1
        for start, end in zip([0, *ends], [*ends, len(place)]) if len(place) else ():
            at = slice(start, end)
            free = (iou[at, None] >= levels) & (~taken[gt[at]] | crowd[at, None])
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(group[at]) != 0]))
            best = np.maximum.reduceat(np.where(free, np.arange(start + 1, end + 1)[:, None], 0), firsts, axis=0) - 1
            some = best >= 0
            row = first[group[at][firsts]] + place[start] - 1
            hit[row], ignored[row] = some, some & ignore[best]
            _, level = np.nonzero(some)
            taken[gt[best[some]], level] = True
        return hit, ignored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dets, pairs = batch.column("dets"), batch.column("pairs")
            first = dets.offsets.to_numpy() - dets.offsets[0].as_py()
            sizes = np.diff(pairs.offsets.to_numpy())
            values = pairs.flatten()
            group = np.repeat(np.arange(len(sizes)), sizes)
            place, gt, iou, area = (values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "gt", "iou", "area"))
            gt = gt.astype(np.int64)
            ignore, crowd = (values.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("ignore", "crowd"))
            own = dets.flatten().field("area").to_numpy(zero_copy_only=False)
            parts = []
            for low, high in areas or [(None, None)]:
                # A missing area (NaN) is in no range.
                outside = np.zeros(len(area), bool) if low is None else ~((area >= low) & (area <= high))
                hit, ignored = solve(first, group, place, gt, iou, ignore | outside | (crowd if low is not None else False), crowd)
                if low is not None:
                    ignored = ignored | ~(hit | ((own >= low) & (own <= high))[:, None])
                parts.append(np.where(ignored, np.where(hit, ord("3"), ord("0")), np.where(hit, ord("2"), ord("1"))).astype(np.uint8))
            marks = np.concatenate(parts, axis=1)
            offsets = pa.array(np.arange(len(marks) + 1, dtype=np.int32) * marks.shape[1], pa.int32())
            text = pa.StringArray.from_buffers(len(marks), offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(marks)))
            flags = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), text)
            yield pa.record_batch([*[batch.column(k) for k in keys], dets, flags], [*keys, "dets", "flags"])

    return run


def associate(dets: DataFrame, tracks: DataFrame, overlaps: DataFrame, keys: list[str], new_score: float, new_overlap: float, track_overlap: float, recondition: float = 0.8, sure: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new detections, unmatched tracks, best track of each sure detection) of each frame.

    `dets`: keys, det, score, kept.  `tracks`: keys, trk, nonempty.  `overlaps`:
    keys, det, trk, iou (missing pairs are 0).  A detection is new at a score of
    `new_score` and no overlap of `new_overlap`; a track that isn't empty is
    unmatched without an overlap of `track_overlap`.  For the third table
    overlaps of detections or tracks with more than one of `recondition` are
    void.
    """
    taken = overlaps.where(F.col("iou") >= new_overlap).select(*keys, "det").distinct()
    fresh = dets.where((F.col("score") >= new_score) & F.col("kept")).join(taken, [*keys, "det"], "left_anti").select(*keys, "det")
    matched = overlaps.where(F.col("iou") >= track_overlap).select(*keys, "trk").distinct()
    lost = tracks.where("nonempty").join(matched, [*keys, "trk"], "left_anti").select(*keys, "trk")
    strong = overlaps.where(F.col("iou") >= recondition)
    clear_det = strong.groupBy(*keys, "det").agg(F.count("*").alias("n")).where("n = 1").select(*keys, "det")
    clear_trk = strong.groupBy(*keys, "trk").agg(F.count("*").alias("n")).where("n = 1").select(*keys, "trk")
    best = strong.join(clear_det, [*keys, "det"]).join(clear_trk, [*keys, "trk"])
    eligible = dets.where(F.col("score") >= sure).join(fresh, [*keys, "det"], "left_anti").select(*keys, "det")
    return fresh, lost, best.join(eligible, [*keys, "det"], "left_semi").select(*keys, "det", "trk", "iou")


def associate_both(dets: DataFrame, tracks: DataFrame, overlaps: DataFrame, keys: list[str], overlap: float = 0.5, track_overlap: float = 0.5, new_score: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(new detections, unmatched tracks, all tracks of each detection, the one-to-one match of each track).

    `dets`: keys, det, score; `tracks`: keys, trk; `overlaps`: keys, det, trk, iou
    of the pairs that overlap.  A detection without a track of `overlap` is new
    at a score of `new_score`; where there are no tracks every one is.  A track is
    unmatched unless the best one-to-one assignment gives it a detection of
    `track_overlap`; where there are no detections none is.  The last table has
    keys, trk, det, iou, det_score and det_score times iou for all assigned pairs
    that overlap at all.
    """
    many = overlaps.where(F.col("iou") >= overlap).select(*keys, "det", "trk", "iou")
    some_tracks = tracks.select(*keys).distinct().withColumn("__q_tracks", F.lit(True))
    free = dets.join(many.select(*keys, "det").distinct(), [*keys, "det"], "left_anti").join(some_tracks, keys, "left")
    fresh = free.where(F.col("__q_tracks").isNull() | (F.col("score") >= new_score)).select(*keys, "det")
    best = assign(overlaps, keys, "det", "trk", "iou").join(dets.select(*keys, "det", "score"), [*keys, "det"])
    best = best.select(*keys, "trk", "det", "iou", F.col("score").alias("det_score"), (F.col("score") * F.col("iou")).alias("weighted"))
    held = best.where(F.col("iou") >= track_overlap).select(*keys, "trk")
    lost = tracks.join(dets.select(*keys).distinct(), keys, "left_semi").join(held, [*keys, "trk"], "left_anti").select(*keys, "trk")
    return fresh, lost, many, best


def one_to_many(pairs: DataFrame, keys: list[str], truth: str, score: str, k: int, threshold: float) -> DataFrame:
    """Per ground truth of n rows those whose score exceeds `threshold` and the quantile 1 - k / n of its scores.

    The quantile lies between two scores where it falls between them; with no
    more than k rows it is the least score, which itself isn't exceeded.
    """
    of = Window.partitionBy(*keys, truth)
    n, at = F.count("*").over(of), F.row_number().over(of.orderBy(score)) - 1
    place = F.greatest(F.lit(0.0), 1 - k / F.col("__q_n")) * (F.col("__q_n") - 1)
    ranked = pairs.withColumns({"__q_n": n, "__q_at": at}).withColumn("__q_place", place)
    low, high = (F.max(F.when(F.col("__q_at") == f("__q_place"), F.col(score))).over(of) for f in (F.floor, F.ceil))
    ranked = ranked.withColumn("__q_cut", low + (F.col("__q_place") - F.floor("__q_place")) * (high - low))
    return ranked.where((F.col(score) > F.col("__q_cut")) & (F.col(score) > threshold)).drop("__q_n", "__q_at", "__q_place", "__q_cut")


def within_cap(new: DataFrame, current: DataFrame, keys: list[str], score: str, ties: list[str], cap: int) -> DataFrame:
    """New detections that still fit under `cap` objects, best first; `current`: keys, n."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    room = F.lit(cap) - F.coalesce(F.col("n"), F.lit(0))
    return new.withColumn("__q_n", n).join(current, keys, "left").where(F.col("__q_n") <= room).drop("__q_n", "n")


def matched_cost(class_cost: Column, box_cost: Column, giou: Column, weights: tuple[float, float, float] = (1.0, 5.0, 2.0)) -> Column:
    """Weight (to be maximised) of a pair from class and box costs and generalised overlap."""
    return -(weights[0] * class_cost + weights[1] * box_cost - weights[2] * giou)
