"""Rotated boxes over structs {cx, cy, w, h, angle} of doubles, as expressions.

The angle is in degrees, counter-clockwise as an image shows it (y goes down).
Two boxes overlap in a convex polygon: one box's corners, cut by the other's
four sides one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = "struct<x: double, y: double>"


def rotated(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(("cx", "cy", "w", "h", "angle"), (cx, cy, w, h, angle))])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def corners(b: Column) -> Column:
    """The four corners, from what was the upper left one on, as the box's outline goes."""
    c, s = F.cos(F.radians(b["angle"])), F.sin(F.radians(b["angle"]))

    def corner(i: int, j: int) -> Column:
        dx, dy = i * b["w"] / 2, j * b["h"] / 2
        return _point(b["cx"] + c * dx + s * dy, b["cy"] - s * dx + c * dy)

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def area(b: Column) -> Column:
    """Width times height; nothing where either isn't positive."""
    return F.when((b["w"] > 0) & (b["h"] > 0), b["w"] * b["h"]).otherwise(0.0)


def bounds(b: Column) -> Column:
    """The upright box {x1, y1, x2, y2} around it."""
    p = corners(b)
    x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def _cut(polygon: Column, a: Column, b: Column) -> Column:
    """What of a convex polygon lies to the inner side of the line from a to b."""
    side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    none = F.array().cast(f"array<{_POINT}>")

    def step(p: Column, i: Column) -> Column:
        q = F.get(polygon, (i + 1) % F.size(polygon))
        sp, sq = side(p), side(q)
        t = sp / (sp - sq)
        own = F.when(sp >= 0, F.array(p)).otherwise(none)
        return F.concat(own, F.when((sp >= 0) != (sq >= 0), F.array(_point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t))).otherwise(none))

    return F.flatten(F.transform(polygon, step))


def _shoelace(polygon: Column) -> Column:
    cross = F.transform(polygon, lambda p, i: p["x"] * F.get(polygon, (i + 1) % F.size(polygon))["y"] - F.get(polygon, (i + 1) % F.size(polygon))["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def intersection(a: Column, b: Column) -> Column:
    """Area of what both boxes cover; 0 with a box of no area, null with a null one."""
    outline = corners(b)
    sides = F.transform(outline, lambda p, i: F.struct(p.alias("a"), F.get(outline, (i + 1) % 4).alias("b")))
    common = F.aggregate(sides, corners(a).cast(f"array<{_POINT}>"), lambda poly, s: _cut(poly, s["a"], s["b"]), _shoelace)
    return F.when(a.isNull() | b.isNull(), None).when((area(a) > 0) & (area(b) > 0), common).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).when(union.isNotNull(), 0.0)


def wrapped(angle: Column) -> Column:
    """The same direction in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def upright(b: Column, within: float = 1.0) -> Column:
    """Whether a box's angle is at most `within` degrees, so that clipping to an image is that of a plain box."""
    return F.abs(wrapped(b["angle"])) <= within


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    """The box in an image scaled by sx and sy: sides stretch as the directions they lie in, the angle follows the width's."""
    c, s = F.cos(F.radians(b["angle"])), F.sin(F.radians(b["angle"]))
    w = b["w"] * F.sqrt((sx * c) * (sx * c) + (sy * s) * (sy * s))
    h = b["h"] * F.sqrt((sx * s) * (sx * s) + (sy * c) * (sy * c))
    return rotated(b["cx"] * sx, b["cy"] * sy, w, h, F.degrees(F.atan2(sy * s, sx * c)))
