"""Run-length masks: arrays of run lengths in column-major order, the first run of zeros; and packed bit words.

Expressions over one array, for masks of some hundred runs; what sums prefixes
here takes time with the square of their number.  `operators.runs` has the same
algebra as relations, for any number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(counts: Column) -> Column:
    """Pixels set: every second run."""
    return F.aggregate(F.transform(counts, lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)


def area_ratio(counts: Column, height: Column, width: Column) -> Column:
    return F.when(height * width > 0, area(counts) / (height * width)).otherwise(0.0)


def run_intervals(counts: Column) -> Column:
    """Array of {first, end} of the runs of ones, end exclusive, over the column-major pixel numbers."""
    kind = "array<struct<first: bigint, end: bigint>>"
    # One fold: what a lambda takes from outside is computed anew for each element.
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(kind).alias("runs"))
    step = lambda s, x: F.struct((s["end"] + x.cast("long")).alias("end"), F.concat(s["runs"], F.array(F.struct(s["end"].alias("first"), (s["end"] + x.cast("long")).alias("end")))).alias("runs"))
    runs = F.aggregate(counts, start, step, lambda s: s["runs"])
    return F.filter(runs, lambda r, i: (i % 2 == 1) & (r["end"] > r["first"]))


def shared_pixels(a: Column, b: Column) -> Column:
    """Pixels in both of two arrays of `run_intervals`."""
    both = lambda s, r: F.aggregate(b, s, lambda t, q: t + F.greatest(F.least(r["end"], q["end"]) - F.greatest(r["first"], q["first"]), F.lit(0).cast("long")))
    return F.aggregate(a, F.lit(0).cast("long"), both)


def intersection(a: Column, b: Column) -> Column:
    """Pixels that both run-length masks set."""
    both = F.flatten(F.transform(run_intervals(a), lambda r: F.transform(run_intervals(b), lambda q: F.greatest(F.least(r["end"], q["end"]) - F.greatest(r["first"], q["first"]), F.lit(0).cast("long")))))
    return F.aggregate(both, F.lit(0).cast("long"), lambda s, v: s + v)


def iou(a: Column, b: Column) -> Column:
    """Over a union of at least 1."""
    i = intersection(a, b)
    return i / F.greatest(area(a) + area(b) - i, F.lit(1))


def iom(a: Column, b: Column) -> Column:
    return intersection(a, b) / (F.least(area(a), area(b)) + 1e-8)


def bounds(counts: Column, height: Column, exclusive: bool = False) -> Column:
    """[x1, y1, x2, y2] of the set pixels; the far edge inclusive, or one beyond it. Null for an empty mask.

    A run that goes on into another column spans all rows.
    """
    # The runs as an element, so that they are made once.
    return F.get(F.transform(F.array(run_intervals(counts)), lambda runs: _bounds(runs, height, exclusive)), 0)


def _bounds(runs: Column, height: Column, exclusive: bool) -> Column:
    x1 = F.array_min(F.transform(runs, lambda r: F.floor(r["first"] / height)))
    x2 = F.array_max(F.transform(runs, lambda r: F.floor((r["end"] - 1) / height)))
    spans = lambda r: F.floor(r["first"] / height) != F.floor((r["end"] - 1) / height)
    y1 = F.array_min(F.transform(runs, lambda r: F.when(spans(r), 0).otherwise(r["first"] % height)))
    y2 = F.array_max(F.transform(runs, lambda r: F.when(spans(r), height - 1).otherwise((r["end"] - 1) % height)))
    more = 1 if exclusive else 0
    return F.when(F.size(runs) > 0, F.array(x1, y1, x2 + more, y2 + more))


def encode_bits(bits: Column) -> Column:
    """Run lengths of an array of 0/1, the first run of zeros (0 where the array starts with a one or is empty).

    The bits as one string, cut where they change: linear in their number.
    """
    text = F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")
    runs = F.transform(F.regexp_extract_all(text, F.lit("0+|1+"), F.lit(0)), lambda r: F.length(r).cast("long"))
    zero = F.array(F.lit(0).cast("long"))
    return F.when((F.size(bits) == 0) | (F.get(bits, 0).cast("int") == 1), F.concat(zero, runs)).otherwise(runs)


def decode_text(counts: str) -> Column:
    """Run lengths from the compressed text of column `counts` (public COCO format): groups of five bits, low first,
    48 added, 32 for more; from the fourth run on the difference to the run two before."""
    return F.expr(f"""aggregate(transform(sequence(1, length({counts})), i -> ascii(substring({counts}, i, 1)) - 48),
        named_struct('done', cast(array() as array<bigint>), 'x', 0L, 'k', 0),
        (s, c) -> transform(array(s.x + shiftleft(cast(c & 31 as bigint), 5 * s.k)), x ->
          if(c & 32 != 0, named_struct('done', s.done, 'x', x, 'k', s.k + 1),
            named_struct('done', concat(s.done, array(x - if(c & 16 != 0, shiftleft(1L, 5 * (s.k + 1)), 0L) + if(size(s.done) > 2, s.done[size(s.done) - 2], 0L))), 'x', 0L, 'k', 0)))[0],
        s -> s.done)""")


def encode_text(counts: str) -> Column:
    """The compressed text of the run lengths in column `counts`; the inverse of `decode_text`."""
    return F.expr(f"""array_join(transform(transform({counts}, (x, i) -> cast(x as bigint) - if(i > 2, cast({counts}[i - 2] as bigint), 0L)), v ->
        transform(array(filter(sequence(1, 13), k -> v >= -shiftleft(1L, 5 * k - 1) AND v < shiftleft(1L, 5 * k - 1))[0]), n ->
          array_join(transform(sequence(0, n - 1), j -> char(cast(48 + (shiftright(v, 5 * j) & 31) + if(j < n - 1, 32, 0) as int))), ''))[0]), '')""")


def bit_intersection(a: Column, b: Column) -> Column:
    """Pixels that two masks of packed 64-bit words share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def bit_union(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def binarize(values: Column) -> Column:
    """0/1 values: above 0.5, or above 0 where the values leave [0, 1]."""
    return F.transform(values, lambda v: (v > F.when((F.array_min(values) < 0) | (F.array_max(values) > 1), 0.0).otherwise(0.5)).cast("int"))
