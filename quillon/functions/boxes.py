"""Box geometry over structs {x1, y1, x2, y2} of doubles, as expressions.

The denominators of overlaps differ on purpose; each function states its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_xywh(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def to_cxcywh(b: Column) -> Column:
    return F.array((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, b["x2"] - b["x1"], b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return w * h


def union(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null where the union is 0."""
    return F.try_divide(intersection(a, b), union(a, b))


def iou_guarded(a: Column, b: Column, eps: float = 2.220446049250313e-16) -> Column:
    """0 where either area or the union is at most eps."""
    return F.when((area(a) <= eps) | (area(b) <= eps) | (union(a, b) <= eps), 0.0).otherwise(iou(a, b))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of a; 0 for an empty a."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def iom(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Intersection over the smaller area + eps."""
    return intersection(a, b) / (F.least(area(a), area(b)) + eps)


def giou(a: Column, b: Column) -> Column:
    hull = (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])) * (F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]))
    return iou(a, b) - F.try_divide(hull - union(a, b), hull)


def clip(b: Column, width: Column, height: Column) -> Column:
    def within(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most.cast("double")))

    return box(within(b["x1"], width), within(b["y1"], height), within(b["x2"], width), within(b["y2"], height))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def normalize(b: Column, width: Column, height: Column) -> Column:
    """Divided by the image's size and clamped to [0, 1]."""
    return clip(box(b["x1"] / width, b["y1"] / height, b["x2"] / width, b["y2"] / height), F.lit(1), F.lit(1))


def hflip(b: Column, width: Column) -> Column:
    return box(width - b["x2"], b["y1"], width - b["x1"], b["y2"])


def crop(b: Column, top: Column, left: Column, height: Column, width: Column) -> Column:
    return clip(box(b["x1"] - left, b["y1"] - top, b["x2"] - left, b["y2"] - top), width, height)


def nonempty(b: Column, least: float = 0.0) -> Column:
    return (b["x2"] - b["x1"] > least) & (b["y2"] - b["y1"] > least)


def center(b: Column) -> Column:
    return F.array((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def inside(b: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    return (b["x1"] >= -margin) & (b["y1"] >= -margin) & (b["x2"] < width + margin) & (b["y2"] < height + margin)


def away_from_border(b: Column, margin: float = 0.025) -> Column:
    """The centre of a normalised box lies strictly inside the margin."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return (cx > margin) & (cx < 1 - margin) & (cy > margin) & (cy < 1 - margin)


def is_zero(values: Column) -> Column:
    """An array box that is null, short, or whose first four are all at most 0."""
    return values.isNull() | (F.size(values) < 4) | F.forall(F.slice(values, 1, 4), lambda v: v <= 0)


def euclidean_similarity(a: Column, b: Column, zero: float) -> Column:
    """max(0, 1 - distance / zero) of two points as arrays."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return F.greatest(F.lit(0.0), 1 - d / zero)


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def valid_normalized(values: Column) -> Column:
    """Four numbers clamped to [0, 1]; null unless they span something."""
    c = F.transform(values, clamp01)
    return F.when((F.size(values) == 4) & ~F.exists(values, lambda v: v.isNull()) & (F.get(c, 2) > F.get(c, 0)) & (F.get(c, 3) > F.get(c, 1)), c)


def map_to_cell(b: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A normalised array box in a cell's pixels, halves to even."""
    return F.array(F.bround(left + F.get(b, 0) * width), F.bround(top + F.get(b, 1) * height), F.bround(left + F.get(b, 2) * width), F.bround(top + F.get(b, 3) * height))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula over two arrays."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def edge_distances(b: Column, x: Column, y: Column) -> Column:
    """How far a point is inside of the left, upper, right and lower edge; negative beyond it."""
    return F.array(x - b["x1"], y - b["y1"], b["x2"] - x, b["y2"] - y)


def rescaled(b: Column, factor: Column | float, width: Column | None = None, height: Column | None = None) -> Column:
    """A box of `factor` times the sides around the same centre, cut to an image if there is one."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = (b["x2"] - b["x1"]) * factor / 2, (b["y2"] - b["y1"]) * factor / 2
    cut = lambda v, most: v if most is None else F.greatest(F.lit(0.0), F.least(most.cast("double"), v))
    return box(cut(cx - w, width), cut(cy - h, height), cut(cx + w, width), cut(cy + h, height))
