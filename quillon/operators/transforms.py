"""Chains of image transforms on boxes and points: composed first, applied once.

Crops, flips, resizes and paddings map an axis to itself by a factor and a
shift, and cut to a window.  A chain is an array of operations; one fold makes it
a single map {ax, bx, ay, by}, the window {x1, y1, x2, y2} that is left, and the
size {w, h} of the image that comes out.  A box costs one multiplication an edge
however long the chain is, and the map has an inverse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.boxes import box


def _num(v: Column | float) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def _op(kind: Column | str, *values: Column | float) -> Column:
    four = [_num(v) for v in (*values, *[0.0] * (4 - len(values)))]
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), *[v.alias(n) for n, v in zip("abcd", four)])


def crop(top: Column | float, left: Column | float, height: Column | float, width: Column | float) -> Column:
    return _op("crop", top, left, height, width)


def flip(when: Column | bool = True) -> Column:
    """Left to right, for rows where `when` holds."""
    return _op(F.when(when if isinstance(when, Column) else F.lit(when), "flip").otherwise("none"))


def resize(height: Column | float, width: Column | float) -> Column:
    return _op("resize", height, width)


def resize_shorter(size: Column | float, longest: Column | float | None = None) -> Column:
    """The shorter side becomes `size`, less where the longer would exceed `longest`; both are rounded, halves to even, unless the shorter one has that size."""
    return _op("shorter", size, -1.0 if longest is None else longest)


def pad(left: Column | float, top: Column | float, right: Column | float, bottom: Column | float) -> Column:
    return _op("pad", left, top, right, bottom)


def chain(*operations: Column) -> Column:
    return F.array(*operations)


def composed(operations: Column, width: Column | float, height: Column | float) -> Column:
    """The map of a whole chain over images of `width` and `height`."""
    w, h = _num(width), _num(height)
    zero, one = F.lit(0.0), F.lit(1.0)
    names = ("ax", "bx", "ay", "by", "x1", "y1", "x2", "y2", "w", "h")
    start = F.struct(*[v.alias(n) for n, v in zip(names, (one, zero, one, zero, zero, zero, w, h, w, h))])

    def step(s: Column, o: Column) -> Column:
        kind, a, b, c, d = (o[n] for n in ("kind", "a", "b", "c", "d"))
        is_ = lambda k: kind == k
        low, high = F.least(s["w"], s["h"]), F.greatest(s["w"], s["h"])
        # The size that the shorter side gets, kept from carrying the longer one too far.
        short = F.when((b > 0) & (high / low * a > b), b * low / high).otherwise(a)
        new_w = F.when(is_("resize"), b).when(~is_("shorter") | (low == short), s["w"]).otherwise(F.bround(short * s["w"] / low))
        new_h = F.when(is_("resize"), a).when(~is_("shorter") | (low == short), s["h"]).otherwise(F.bround(short * s["h"] / low))
        kx, ky = F.when(is_("flip"), -1.0).otherwise(new_w / s["w"]), new_h / s["h"]
        sx = F.when(is_("crop"), -b).when(is_("pad"), a).when(is_("flip"), s["w"]).otherwise(0.0)
        sy = F.when(is_("crop"), -a).when(is_("pad"), b).otherwise(0.0)
        u, v = s["x1"] * kx + sx, s["x2"] * kx + sx
        x1, x2, y1, y2 = F.least(u, v), F.greatest(u, v), s["y1"] * ky + sy, s["y2"] * ky + sy
        inside = lambda value, top: F.when(is_("crop"), F.greatest(zero, F.least(top, value))).otherwise(value)
        out_w = F.when(is_("crop"), d).when(is_("pad"), s["w"] + a + c).otherwise(new_w)
        out_h = F.when(is_("crop"), c).when(is_("pad"), s["h"] + b + d).otherwise(new_h)
        values = (s["ax"] * kx, s["bx"] * kx + sx, s["ay"] * ky, s["by"] * ky + sy, inside(x1, d), inside(y1, c), inside(x2, d), inside(y2, c), out_w, out_h)
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    return F.aggregate(operations, start, step)


def map_box(m: Column, b: Column) -> Column:
    """A box {x1, y1, x2, y2} after the chain, cut to what its crops left; null where nothing is."""
    u, v = b["x1"] * m["ax"] + m["bx"], b["x2"] * m["ax"] + m["bx"]
    cut = lambda value, low, high: F.greatest(m[low], F.least(m[high], value))
    x1, x2 = cut(F.least(u, v), "x1", "x2"), cut(F.greatest(u, v), "x1", "x2")
    y1, y2 = cut(b["y1"] * m["ay"] + m["by"], "y1", "y2"), cut(b["y2"] * m["ay"] + m["by"], "y1", "y2")
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def map_point(m: Column, x: Column, y: Column) -> Column:
    """{x, y, visible} of a point after the chain."""
    u, v = x * m["ax"] + m["bx"], y * m["ay"] + m["by"]
    return F.struct(u.alias("x"), v.alias("y"), ((u >= m["x1"]) & (u < m["x2"]) & (v >= m["y1"]) & (v < m["y2"])).alias("visible"))


def inverse_point(m: Column, x: Column, y: Column) -> Column:
    """Where in the first image a point of the last one comes from."""
    return F.struct(((x - m["bx"]) / m["ax"]).alias("x"), ((y - m["by"]) / m["ay"]).alias("y"))


def drawn(seed: int, name: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed, name and keys alone: with a datapoint's key all its frames
    draw the same one, with a frame's key each its own."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def drawn_between(u: Column, low: Column | int, high: Column | int) -> Column:
    """A whole number from `low` to `high`, both included, for a draw `u`."""
    low, high = _num(low), _num(high)
    return F.floor(low + u * (high - low + 1)).cast("double")
