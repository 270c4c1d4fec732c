"""Run-length masks as relations: algebra, morphology, components and distances.

A mask is a set of rows (keys, x, y0, y1): in column x the pixels from y0 to
y1, the end excluded.  `segments` makes them of run lengths and `to_counts`
goes back.  What combines masks is one sweep down each column: every segment
opens and closes a depth, and what is kept is where the depths satisfy a rule.
Columns are dealt over tasks, so a mask of any number of runs costs their sort,
and no array of pixels is ever built.  Only `squared_distances` has a row a
pixel, as its result does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.operators.partitions import dealt

#: Rows of a tile: segments of neighbouring columns meet by tile, so that a column of many runs isn't joined all against all.
TILE = 64


def segments(masks: DataFrame, keys: list[str], counts: str, height: Column | int, width: Column | int, tasks: int = 0) -> DataFrame:
    """Rows of masks given as run lengths in column-major order, the first run of zeros.

    Null and empty arrays are empty masks and have no rows, nor have runs of no
    length; what lies beyond the last column is dropped.  Masks are dealt before
    their runs become rows, over `tasks` tasks at least; what combines masks of
    equal keys finds them dealt.
    """
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    masks = dealt(masks.select(*keys, F.col(counts).alias("__q_counts"), h.cast("long").alias("__q_h"), w.cast("long").alias("__q_w")), *keys, tasks=tasks)
    runs = masks.select(*keys, "__q_h", "__q_w", F.posexplode("__q_counts").alias("__q_i", "__q_n"))
    end = F.sum(F.col("__q_n").cast("long")).over(Window.partitionBy(*keys).orderBy("__q_i").rowsBetween(Window.unboundedPreceding, 0))
    ends = runs.withColumn("__q_end", end).where("__q_i % 2 = 1 AND __q_n > 0").withColumn("__q_first", F.col("__q_end") - F.col("__q_n"))
    x = F.expr("sequence(__q_first div __q_h, least((__q_end - 1) div __q_h, __q_w - 1))")
    columns = ends.where("__q_first div __q_h < __q_w").withColumn("x", F.explode(x))
    return columns.select(*keys, "x", F.greatest(F.expr("__q_first - x * __q_h"), F.lit(0).cast("long")).alias("y0"), F.least(F.expr("__q_end - x * __q_h"), F.col("__q_h")).alias("y1"))


def to_counts(segs: DataFrame, masks: DataFrame, keys: list[str], height: int, width: int, name: str = "counts") -> DataFrame:
    """keys and run lengths of every mask of `masks` (keys), those without rows too; segments must not overlap."""
    order = Window.partitionBy(*keys).orderBy("__q_first")
    pixel = segs.select(*keys, (F.col("x") * height + F.col("y0")).alias("__q_first"), (F.col("x") * height + F.col("y1")).alias("__q_end"))
    # Segments that meet over the edge of a column are one run: its first row tells where it begins, the next run's where it ends.
    before = F.lag("__q_end").over(order)
    marked = pixel.withColumn("__q_before", F.coalesce(before, F.lit(0).cast("long"))).withColumn("__q_last", F.max("__q_end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = marked.where("__q_before <> __q_first OR __q_first = 0")
    closed = starts.withColumn("__q_end", F.coalesce(F.lead("__q_before").over(order), F.col("__q_last")))
    runs = closed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__q_first", "__q_before", "__q_end"))).alias("__q_r"))
    lengths = F.flatten(F.transform("__q_r", lambda r: F.array(r["__q_first"] - r["__q_before"], r["__q_end"] - r["__q_first"])))
    rest = F.lit(height * width).cast("long") - F.element_at("__q_r", -1)["__q_end"]
    runs = runs.select(*keys, F.when(rest > 0, F.concat(lengths, F.array(rest))).otherwise(lengths).alias(name))
    return masks.select(*keys).join(runs, keys, "left").withColumn(name, F.coalesce(name, F.array(F.lit(height * width).cast("long"))))


def swept(segs: DataFrame, keys: list[str], depths: dict[str, Column], keep: Callable[..., Column]) -> DataFrame:
    """Where `keep` holds for the depths: each of `depths` says what a row adds to it, `keep` gets the sums by name and must not hold for zeros."""
    down = Window.partitionBy(*keys, "x").orderBy("y")
    state = keep(*[F.col(f"__q_{n}") for n in depths])
    turned = _summed(segs, keys, depths).withColumn("__q_in", state).withColumn("__q_was", F.coalesce(F.lag("__q_in").over(down), F.lit(False))).where("__q_in <> __q_was")
    return turned.withColumn("y1", F.lead("y").over(down)).where("__q_in").select(*keys, "x", F.col("y").alias("y0"), "y1")


def _summed(segs: DataFrame, keys: list[str], depths: dict[str, Column]) -> DataFrame:
    """keys, x, y, __q_next and the depths from y up to there (null in the last row of a column)."""
    sides = list(depths)
    events = segs.select(*keys, "x", F.explode(F.array(F.struct(F.col("y0").alias("y"), F.lit(1).alias("s")), F.struct(F.col("y1").alias("y"), F.lit(-1).alias("s")))).alias("__q_e"), *[v.cast("int").alias(f"__q_d_{n}") for n, v in depths.items()])
    down = Window.partitionBy(*keys, "x").orderBy("y")
    summed = events.select(*keys, "x", F.col("__q_e.y").alias("y"), *[(F.col("__q_e.s") * F.col(f"__q_d_{n}")).alias(n) for n in sides])
    # With rows of equal y summed up by the last of them, one order serves every step.
    rows = down.rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumns({**{f"__q_{n}": F.sum(n).over(rows) for n in sides}, "__q_next": F.lead("y").over(down)}).where("__q_next IS NULL OR __q_next <> y")


def measured(segs: DataFrame, keys: list[str], depths: dict[str, Column], rules: dict[str, Callable[..., Column]]) -> DataFrame:
    """keys and per rule the pixels whose depths satisfy it, all of one sweep; rules are as `keep` of `swept`. Masks without rows have none."""
    pixels = F.col("__q_next") - F.col("y")
    sums = {n: F.coalesce(F.sum(F.when(rule(*[F.col(f"__q_{d}") for d in depths]), pixels)), F.lit(0).cast("long")) for n, rule in rules.items()}
    return _summed(segs, keys, depths).groupBy(*keys).agg(*[v.alias(n) for n, v in sums.items()])


def union(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The union of all masks whose rows share the keys; segments that touch become one."""
    return swept(segs, keys, {"n": F.lit(1)}, lambda n: n > 0)


def combined(a: DataFrame, b: DataFrame, keys: list[str], rule: Callable[[Column, Column], Column]) -> DataFrame:
    """Of two masks a key the pixels where `rule` holds for (in a, in b), such as `lambda a, b: a & ~b`."""
    both = a.select(*keys, "x", "y0", "y1", F.lit(1).alias("__q_a")).unionByName(b.select(*keys, "x", "y0", "y1", F.lit(0).alias("__q_a")))
    return swept(both, keys, {"a": F.col("__q_a"), "b": 1 - F.col("__q_a")}, lambda a, b: rule(a > 0, b > 0))


def compared(a: DataFrame, b: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """keys and per rule the pixels of `combined`, all of one sweep; masks that set none on either side have no row."""
    both = a.select(*keys, "x", "y0", "y1", F.lit(1).alias("__q_a")).unionByName(b.select(*keys, "x", "y0", "y1", F.lit(0).alias("__q_a")))
    of = {n: (lambda a, b, rule=rule: rule(a > 0, b > 0)) for n, rule in rules.items()}
    return measured(both, keys, {"a": F.col("__q_a"), "b": 1 - F.col("__q_a")}, of)


def frame(masks: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Masks that set every pixel."""
    return masks.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"), F.lit(0).cast("long").alias("y0"), F.lit(height).cast("long").alias("y1"))


def complement(segs: DataFrame, masks: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return combined(frame(masks, keys, height, width), segs, keys, lambda a, b: a & ~b)


def areas(segs: DataFrame, keys: list[str], name: str = "area") -> DataFrame:
    """keys and pixels of the masks that set any; segments must not overlap."""
    return segs.groupBy(*keys).agg(F.sum(F.col("y1") - F.col("y0")).alias(name))


def dilated(segs: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Dilation by a square of 2 radius + 1 pixels: runs grow in their column, then over the neighbouring ones."""
    r = F.lit(radius).cast("long")
    tall = union(segs.withColumns({"y0": F.greatest(F.col("y0") - r, F.lit(0).cast("long")), "y1": F.least(F.col("y1") + r, F.lit(height).cast("long"))}), keys)
    wide = tall.withColumn("x", F.explode(F.sequence(F.greatest(F.col("x") - r, F.lit(0).cast("long")), F.least(F.col("x") + r, F.lit(width - 1).cast("long")))))
    return union(wide, keys)


def boundary(segs: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Pixels that differ from the right, the lower or the lower right one; the last row and column stand for what is beyond them.

    Four copies, one for each corner of that square, lie over each other: a
    boundary is where some but not all of them are.
    """
    zero, last = F.lit(0).cast("long"), F.lit(width - 1).cast("long")
    left = F.when(F.col("x") == last, F.array(F.greatest(last - 1, zero), last)).otherwise(F.array(F.col("x") - 1))
    xs = F.concat(F.array(F.col("x")), F.filter(left, lambda x: x >= 0) if width > 1 else F.array(F.col("x")))
    ys = F.expr(f"array(named_struct('y0', y0, 'y1', y1), named_struct('y0', greatest(y0 - 1, 0L), 'y1', if(y1 = {height}, y1, y1 - 1)))")
    copies = segs.select(*keys, F.explode(xs).alias("x"), ys.alias("__q_y")).select(*keys, "x", F.explode("__q_y").alias("__q_y")).select(*keys, "x", "__q_y.y0", "__q_y.y1").where("y0 < y1")
    return swept(copies, keys, {"n": F.lit(1)}, lambda n: (n > 0) & (n < 4))


def boundary_radius(height: int, width: int, share: float = 0.008) -> int:
    """Pixels by which boundaries may miss each other: a share of the diagonal, rounded up."""
    return -int(-(share * (height * height + width * width) ** 0.5) // 1)


def boundary_scores(truth: DataFrame, found: DataFrame, pairs: DataFrame, keys: list[str], height: int, width: int, radius: int) -> DataFrame:
    """keys, precision, recall, f of every pair of masks in `pairs` (keys): shares of either boundary within `radius` of the other.

    Where only one side has a boundary its share is 0 and the other 1; where none has, both are 1.
    """
    side = lambda s, of: s.select(*keys, F.lit(of).alias("__q_side"), "x", "y0", "y1")
    own = boundary(side(truth, 0).unionByName(side(found, 1)), [*keys, "__q_side"], height, width)
    # Each boundary is itself and, of 2 radius + 1 columns, what the other may hit: one sweep of four depths counts all.
    r, zero, last = (F.lit(v).cast("long") for v in (radius, 0, width - 1))
    reach = lambda x: F.struct(x.alias("x"), F.greatest(F.col("y0") - r, zero).alias("y0"), F.least(F.col("y1") + r, F.lit(height).cast("long")).alias("y1"), F.lit(True).alias("__q_near"))
    places = F.concat(F.array(F.struct("x", "y0", "y1", F.lit(False).alias("__q_near"))), F.transform(F.sequence(F.greatest(F.col("x") - r, zero), F.least(F.col("x") + r, last)), reach))
    rows = own.select(*keys, "__q_side", F.explode(places).alias("__q_p")).select(*keys, "__q_side", "__q_p.*")
    depth = lambda of, near: (F.col("__q_side") == of) & (F.col("__q_near") == near)
    depths = {"g": depth(0, False), "d": depth(1, False), "ng": depth(0, True), "nd": depth(1, True)}
    rules = {"__q_g": lambda g, d, ng, nd: g > 0, "__q_d": lambda g, d, ng, nd: d > 0, "__q_hg": lambda g, d, ng, nd: (g > 0) & (nd > 0), "__q_hd": lambda g, d, ng, nd: (d > 0) & (ng > 0)}
    out = pairs.select(*keys).join(measured(rows, keys, depths, rules), keys, "left")
    out = out.na.fill(0, ["__q_g", "__q_d", "__q_hg", "__q_hd"])
    share = lambda hit, own, other: F.when(F.col(own) > 0, F.when(F.col(other) > 0, F.col(hit) / F.col(own)).otherwise(0.0)).otherwise(1.0)
    out = out.select(*keys, share("__q_hd", "__q_d", "__q_g").alias("precision"), share("__q_hg", "__q_g", "__q_d").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f", F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r)))


def jf_scores(matched: DataFrame, scores: DataFrame, pair: list[str], unit: list[str], iou: str = "iou") -> DataFrame:
    """unit, j, f, jf: means over the matched pairs of an image and phrase; units without a match have no row."""
    rows = matched.join(scores.select(*pair, "f"), pair)
    n = F.count("*")
    means = rows.groupBy(*unit).agg(F.avg(iou).alias("j"), (F.sum("f") / (n + 1e-9)).alias("f"))
    return means.withColumn("jf", (F.col("j") + F.col("f")) * 0.5)


def _tiles(y0: Column, y1: Column) -> Column:
    return F.explode(F.sequence(F.floor(y0 / TILE), F.floor((y1 - 1) / TILE)))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, tasks: int = 0) -> DataFrame:
    """keys, a_id, b_id, shared, iou, iom of the masks of `a` and `b` with equal keys that share pixels.

    Segments meet by column and tile, over `tasks` tasks at least, so pairs without a shared column cost nothing.
    """
    left = a.select(*keys, F.col(a_id).alias("__q_a"), "x", F.col("y0").alias("__q_a0"), F.col("y1").alias("__q_a1"), _tiles(F.col("y0"), F.col("y1")).alias("__q_t"))
    right = b.select(*keys, F.col(b_id).alias("__q_b"), "x", F.col("y0").alias("__q_b0"), F.col("y1").alias("__q_b1"), _tiles(F.col("y0"), F.col("y1")).alias("__q_t"))
    # Segments are small in files, and as rows too many to broadcast or for a task per core.
    by = [*keys, "x", "__q_t"]
    t = F.col("__q_t") * TILE
    length = F.least("__q_a1", "__q_b1", t + TILE) - F.greatest("__q_a0", "__q_b0", t)
    shared = dealt(left, *by, tasks=tasks).join(dealt(right, *by, tasks=tasks).hint("merge"), by).withColumn("__q_n", length).where("__q_n > 0").groupBy(*keys, "__q_a", "__q_b").agg(F.sum("__q_n").alias("shared"))
    whole = shared.join(areas(a.withColumnRenamed(a_id, "__q_a"), [*keys, "__q_a"], "__q_s"), [*keys, "__q_a"]).join(areas(b.withColumnRenamed(b_id, "__q_b"), [*keys, "__q_b"], "__q_r"), [*keys, "__q_b"])
    s, one, two = F.col("shared"), F.col("__q_s"), F.col("__q_r")
    return whole.select(*keys, F.col("__q_a").alias(a_id), F.col("__q_b").alias(b_id), "shared", (s / F.greatest(one + two - s, F.lit(1))).alias("iou"), (s / (F.least(one, two) + 1e-8)).alias("iom"))


def _labels(mask: np.ndarray, x: np.ndarray, y0: np.ndarray, y1: np.ndarray, corners: bool) -> np.ndarray:
    """Of runs in the order of (mask, x, y0) the first one that each is connected with.

    Runs of a column are disjoint and in order, so what touches a run in the next
    column is a stretch that two look-ups find; one that touches it from below is
    the next.  Labels fall to the least of both
    ends of every edge, and to their label's label, until none falls.
    """
    span = int(y1.max()) + 2
    column = (mask * (int(x.max()) + 2) + x) * span
    more = 0 if corners else 1
    low = np.searchsorted(column + y1, column + span + y0 + more)
    high = np.searchsorted(column + y0, column + span + y1 - more, "right")
    n = np.maximum(high - low, 0)
    left = np.repeat(np.arange(len(x)), n)
    right = low[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
    below = np.flatnonzero((column[1:] == column[:-1]) & (y0[1:] == y1[:-1]))
    left, right = np.concatenate([left, below]), np.concatenate([right, below + 1])
    labels = np.arange(len(x))
    while True:
        least = np.minimum(labels[left], labels[right])
        new = labels.copy()
        for end in (left, right):
            np.minimum.at(new, end, least)
            np.minimum.at(new, labels[end], least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _labelled(keys: list[str], height: int, corners: bool) -> Callable:
    """Masks, whole and in order, with the label and size of each run's component."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        x, y0, y1 = (table.column(c).to_numpy() for c in ("x", "y0", "y1"))
        labels = _labels(np.cumsum(new), x, y0, y1, corners)
        size = np.bincount(labels, weights=y1 - y0, minlength=len(x)).astype(np.int64)
        out = table.append_column("label", pa.array((x * height + y0)[labels])).append_column("size", pa.array(size[labels]))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # The last mask may go on in the next batch.
            last = pa.array(np.ones(held.num_rows, bool))
            for k in keys:
                value, column = held.column(k)[-1], held.column(k)
                last = pc.and_(last, column.is_null() if not value.is_valid else pc.fill_null(pc.equal(column, value), False))
            first = int(pc.index(last.combine_chunks() if isinstance(last, pa.ChunkedArray) else last, True).as_py())
            if first:
                yield solve(held.slice(0, first))
                held = held.slice(first)
        if held is not None:
            yield solve(held)

    return run


def components(segs: DataFrame, keys: list[str], height: int, corners: bool = True) -> DataFrame:
    """The segments with `label`, the first pixel (column-major) of their connected component, and `size`, its pixels.

    Masks are dealt by key and come sorted, a mask's runs being a graph whose
    edges are touching runs of neighbouring columns; many masks contract their
    labels at once.  A task holds one batch and one mask's runs, which the image
    bounds.
    """
    rows = segs.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("x", "y0", "y1")])
    kind = T.StructType([*rows.schema.fields, T.StructField("label", T.LongType()), T.StructField("size", T.LongType())])
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "x", "y0").mapInArrow(_labelled(keys, height, corners), kind)


def without_specks(segs: DataFrame, masks: DataFrame, keys: list[str], height: int, width: int, most: int) -> DataFrame:
    """The masks with holes of at most `most` pixels filled, then without components of at most `most` pixels that are no more than half of the mask."""
    if most <= 0:
        return segs
    holes = components(complement(segs, masks, keys, height, width), keys, height).where(F.col("size") <= most)
    filled = union(segs.select(*keys, "x", "y0", "y1").unionByName(holes.select(*keys, "x", "y0", "y1")), keys)
    parts = components(filled, keys, height)
    limit = F.least(F.floor(F.col("__q_whole") / 2), F.lit(most).cast("long"))
    return parts.join(areas(filled, keys, "__q_whole"), keys).where(F.col("size") > limit).select(*keys, "x", "y0", "y1")


def squared_distances(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, d2: each set pixel with the square of its distance to the nearest pixel that isn't set; what is beyond the image is none.

    In its column a pixel's distance follows from the ends of its run.  Along a
    row the pixels of an unbroken stretch then look at parabolas around each
    other, no farther than their own column's distance, which nothing can beat.
    A stretch is one array, as long as the image is wide.
    """
    pixels = segs.select(*keys, "x", "y0", "y1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    pixels = pixels.select(*keys, "y", "x", F.least(F.col("y") - F.col("y0") + 1, F.col("y1") - F.col("y")).alias("g"))
    along = Window.partitionBy(*keys, "y").orderBy("x")
    stretch = F.col("x") - F.row_number().over(along)
    rows = pixels.withColumn("__q_s", stretch).groupBy(*keys, "y", "__q_s").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("__q_r"))
    # Pixels beside the stretch are not set: a zero at either end.
    rows = rows.select(*keys, "y", F.get("__q_r", 0)["x"].alias("__q_x"), F.concat(F.array(F.lit(0).cast("long")), F.transform("__q_r", lambda r: r["g"]), F.array(F.lit(0).cast("long"))).alias("__q_g"))
    near = F.expr("""transform(sequence(1, size(__q_g) - 2), i -> array_min(transform(
        sequence(greatest(0, i - cast(__q_g[i] as int)), least(size(__q_g) - 1, i + cast(__q_g[i] as int))), j -> cast(i - j as bigint) * (i - j) + __q_g[j] * __q_g[j])))""")
    return rows.select(*keys, "y", "__q_x", F.posexplode(near).alias("__q_i", "d2")).select(*keys, (F.col("__q_x") + F.col("__q_i")).alias("x"), "y", "d2")


def error_points(truth: DataFrame, found: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, positive: where a correcting click goes: the deepest pixel of what was missed (positive) or, unless
    that is deeper, of what was found wrongly.  Ties go to the first in reading order; without errors it is pixel 0, negative."""
    def deepest(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        wrong = combined(a, b, keys, lambda x, y: x & ~y)
        return squared_distances(wrong, keys).groupBy(*keys).agg(F.min(F.struct((-F.col("d2")).alias("d"), "y", "x")).alias(name))

    both = pairs.select(*keys).join(deepest(truth, found, "__q_fn"), keys, "left").join(deepest(found, truth, "__q_fp"), keys, "left")
    depth = lambda c: F.coalesce(-F.col(f"{c}.d"), F.lit(0).cast("long"))
    positive = depth("__q_fn") > depth("__q_fp")
    place = lambda p: F.coalesce(F.when(positive, F.col(f"__q_fn.{p}")).otherwise(F.col(f"__q_fp.{p}")), F.lit(0).cast("long"))
    return both.select(*keys, place("x").alias("x"), place("y").alias("y"), positive.alias("positive"))


def polygon_segments(polygons: DataFrame, keys: list[str], points: str, height: int, width: int) -> DataFrame:
    """Rows of filled polygons, each a flat array x, y, x, y...; rows that share the keys unite.

    Vertices are cut to whole pixels.  A pixel is set where its column's line is
    inside or on the outline, to the nearest whole row.  Edges become rows of the
    columns they cross; of each column the crossings in order pair up, once
    for edges without their right and once without their left end, and edges
    along a column count whole.  Polygons of fewer than three points or with a null have no rows.
    """
    whole = (F.size(points) >= 6) & ~F.exists(points, lambda v: v.isNull())
    numbered = polygons.where(whole).select(*keys, points).distinct().withColumn("__q_poly", F.xxhash64(points))
    n = F.expr(f"size({points}) div 2")
    at = lambda i, k: F.get(F.col(points), 2 * (i % n) + k).cast("long")
    edge = numbered.withColumn("__q_n", n).select(*keys, "__q_poly", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).alias("xa"), at(i, 1).alias("ya"), at(i + 1, 0).alias("xb"), at(i + 1, 1).alias("yb")))).alias("e"))
    e = edge.select(*keys, "__q_poly", F.least("e.xa", "e.xb").alias("l"), F.greatest("e.xa", "e.xb").alias("r"), "e.*")
    flat = e.where("l = r").select(*keys, F.col("l").alias("x"), F.least("ya", "yb").alias("a"), F.greatest("ya", "yb").alias("b"))
    slanted = e.where("l < r")
    crossing = F.expr("ya + (x - xa) * (yb - ya) / cast(xb - xa as double)")
    columns = slanted.where(f"r >= 0 AND l < {width}").withColumn("x", F.explode(F.sequence(F.greatest(F.col("l"), F.lit(0).cast("long")), F.least(F.col("r"), F.lit(width - 1).cast("long")))))
    sides = columns.withColumn("y", crossing).withColumn("side", F.explode(F.expr("filter(array(0, 1), s -> if(s = 0, x < r, x > l))")))
    order = Window.partitionBy(*keys, "__q_poly", "side", "x").orderBy("y")
    paired = sides.withColumn("i", F.row_number().over(order)).withColumn("b", F.lead("y").over(order)).where("i % 2 = 1")
    spans = paired.select(*keys, "x", F.col("y").alias("a"), "b").unionByName(flat.select(*keys, "x", F.col("a").cast("double"), F.col("b").cast("double")))
    ends = spans.select(*keys, "x", F.greatest(F.floor(F.col("a") + 0.5), F.lit(0)).cast("long").alias("y0"), F.least(F.ceil(F.col("b") - 0.5) + 1, F.lit(height)).cast("long").alias("y1"))
    return union(ends.where(f"y0 < y1 AND x BETWEEN 0 AND {width - 1}"), keys)


def resized(segs: DataFrame, keys: list[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Masks in another size by the nearest pixel: pixel i of the new one shows pixel floor(i old / new) of the old."""
    first = lambda v, old, new: F.ceil(v * F.lit(new) / F.lit(old)).cast("long")
    tall = segs.select(*keys, "x", first(F.col("y0"), height, new_height).alias("y0"), first(F.col("y1"), height, new_height).alias("y1")).where("y0 < y1")
    xs = tall.withColumns({"__q_a": first(F.col("x"), width, new_width), "__q_b": first(F.col("x") + 1, width, new_width)}).where("__q_a < __q_b")
    return xs.select(*keys, F.explode(F.sequence(F.col("__q_a"), F.col("__q_b") - 1)).alias("x"), "y0", "y1")


def box_segments(boxes: DataFrame, keys: list[str], box: str, height: int, width: int) -> DataFrame:
    """Rows of boxes x, y, w, h, corners rounded (halves to even) and cut to the image; boxes of nothing have none."""
    v = lambda i: F.get(F.col(box), i)
    whole = lambda c: F.bround(c.cast("double")).cast("long")
    cut = lambda c, low, high: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), whole(c)))
    corners = boxes.where(F.size(box) >= 4).select(*keys, cut(v(0), 0, width - 1).alias("__q_x"), cut(v(1), 0, height - 1).alias("y0"), cut(v(0) + v(2), 0, width).alias("__q_r"), cut(v(1) + v(3), 0, height).alias("y1"))
    return corners.where("__q_x < __q_r AND y0 < y1").select(*keys, F.explode(F.sequence(F.col("__q_x"), F.col("__q_r") - 1)).alias("x"), "y0", "y1")


def item_segments(items: DataFrame, keys: list[str], counts: str, polygon: str, box: str, height: int, width: int) -> DataFrame:
    """The masks that items offer: of each its run lengths where it has any, else its polygon if that sets a pixel, else its box; items of equal keys unite."""
    has_runs = F.coalesce(F.size(counts), F.lit(0)) > 0
    numbered = items.withColumn("__q_item", F.xxhash64(*keys, F.to_json(F.struct(counts, polygon, box))))
    own = [*keys, "__q_item"]
    first = segments(numbered.where(has_runs), own, counts, height, width)
    rest = numbered.where(~has_runs)
    second = polygon_segments(rest.where(F.col(polygon).isNotNull()), own, polygon, height, width)
    boxed = rest.join(second.select(*own).distinct(), own, "left_anti")
    third = box_segments(boxed.where(F.col(box).isNotNull()), own, box, height, width)
    return union(first.unionByName(second).unionByName(third), keys)
