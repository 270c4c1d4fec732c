"""Which rows, stages, regions and points are taken: query filters, fallbacks, samples and perturbed boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Predicates of queries


def without_texts(text: Column, excluded: list[str]) -> Column:
    """Texts that aren't in the list; a missing text stays."""
    return ~F.coalesce(text.isin(excluded), F.lit(False))


def without_geometry(*inputs: Column) -> Column:
    """Queries asked by text alone: neither a box nor points."""
    out = F.lit(True)
    for c in inputs:
        out = out & c.isNull()
    return out


def few_targets(targets: Column, most: int) -> Column:
    """At most so many targets; missing ones are none."""
    return F.coalesce(F.size(targets), F.lit(0)) <= most


def strictly_true(flag: Column) -> Column:
    """True and nothing else: not missing."""
    return flag.eqNullSafe(F.lit(True))


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in reasons.items()])


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the seed and the keys alone, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


# Rows


def next_valid(wanted: DataFrame, rows: DataFrame, index: str, ok: str, size: int = 10_000) -> DataFrame:
    """`wanted` (with `index`) and `next`, the first valid index at or after it, else the first of all; null without any.

    Blocks of `size` indexes are searched by windows of their own; a block without a valid one further on takes the
    first of the next block that has one.  The blocks' firsts are a row per block.
    """
    block = lambda c: F.floor(F.col(c) / size)
    valid = rows.where(strictly_true(F.col(ok))).select(F.col(index).alias("__q_i")).distinct()
    both = wanted.select(F.col(index).alias("__q_i"), F.lit(None).cast("long").alias("__q_v"), F.struct(*wanted.columns).alias("__q_row")).unionByName(valid.select("__q_i", F.col("__q_i").cast("long").alias("__q_v")), allowMissingColumns=True)
    both = both.withColumn("__q_b", block("__q_i"))
    ahead = Window.partitionBy("__q_b").orderBy(F.desc("__q_i")).rangeBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__q_n", F.min("__q_v").over(ahead)).where("__q_row IS NOT NULL")
    blocks = both.groupBy("__q_b").agg(F.min("__q_v").alias("__q_first"))
    after = Window.orderBy(F.desc("__q_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__q_b", F.min("__q_first").over(after).alias("__q_after"), F.min("__q_first").over(Window.orderBy(F.desc("__q_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__q_all"))
    return inside.join(blocks, "__q_b").select("__q_row.*", F.coalesce("__q_n", "__q_after", "__q_all").alias("next"))


def valid_position(df: DataFrame, keys: list[str], order: list, valid: Column, name: str = "position") -> DataFrame:
    """Each row with the number, from 0, of the last valid row up to it; -1 before the first."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(valid, F.lit(False)).cast("long")).over(so_far) - 1)


def strided_stages(df: DataFrame, keys: list[str], stage: str, n: int, stride: int, seed: int = 0) -> DataFrame:
    """Of each group `n` of its distinct stages, `stride` apart, from a start that depends on seed and keys; the stride
    shrinks to the largest that fits.  Rows of those stages, stages numbered from 0; groups of fewer stages are out."""
    stages = df.select(*keys, stage).distinct()
    whole = Window.partitionBy(*keys)
    r = stages.withColumns({"__q_i": F.row_number().over(whole.orderBy(stage)) - 1, "__q_len": F.count("*").over(whole)}).where(F.col("__q_len") >= n)
    last = F.col("__q_len") - 1
    step = F.least(F.lit(stride), F.floor(last / max(n - 1, 1))) if n > 1 else F.lit(1)
    start = F.floor(uniform(seed, *[F.col(k) for k in keys]) * (last - step * (n - 1) + 1))
    off = F.col("__q_i") - start
    taken = r.where((off >= 0) & (off % step == 0) & (off / step < n)).select(*keys, stage, (off / step).cast("long").alias("__q_stage"))
    return df.join(taken, [*keys, stage]).withColumn(stage, F.col("__q_stage")).drop("__q_stage")


def conditional_fallback(cells: DataFrame, regions: DataFrame, keys: list[str], frame: str, region: str, fallback: str) -> DataFrame:
    """`cells` (keys, frame) with their region and whether it is the fallback.

    A cell of a segment that has any region shows its own or is out; only where
    the segment has none at all all its cells show its fallback, if it has one.
    `regions`: keys, frame, region; cells carry `fallback`.
    """
    own = regions.where(F.col(region).isNotNull())
    some = own.select(*keys).distinct().withColumn("__q_some", F.lit(True))
    joined = cells.join(own.select(*keys, frame, region), [*keys, frame], "left").join(some, keys, "left")
    stand_in = F.col(region).isNull() & F.col("__q_some").isNull() & F.col(fallback).isNotNull()
    out = joined.withColumn("is_fallback", stand_in).withColumn(region, F.when(stand_in, F.col(fallback)).otherwise(F.col(region)))
    return out.where(F.col(region).isNotNull()).drop("__q_some", fallback)


def recondition(frame: Column, overlap: Column, every: int, least: float) -> Column:
    """Whether a track is set anew: at every `every`-th frame, or where its overlap with its detection falls below `least`."""
    periodic = (frame % every == 0) if every > 0 else F.lit(False)
    return periodic | F.coalesce(overlap < least, F.lit(False))


def uniform_counts(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, usual (most frequent number of rows of an item, the smallest of equals), n_odd: items with another number; 0 everywhere is the assertion."""
    n = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.mode("n", True).alias("usual"), F.collect_list("n").alias("__q_all")).select(*keys, "usual", F.size(F.filter("__q_all", lambda v: v != F.col("usual"))).cast("long").alias("n_odd"))


def present_folders(expected: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Expected folders that hold a file, with their number of files."""
    n = files.groupBy(folder).agg(F.count("*").alias("n_files"))
    return expected.select(folder).distinct().join(n, folder)


# Arrays


def by_score(df: DataFrame, score: str, siblings: list[str]) -> DataFrame:
    """Parallel arrays in descending order of their scores, equal scores as they stood, missing ones last; without scores as they are."""
    names = [score, *siblings]
    zipped = F.arrays_zip(*names)
    keyed = F.array_sort(F.transform(zipped, lambda s, i: F.struct(F.coalesce(-s[score], F.lit(float("inf"))).alias("o"), i.alias("i"), s.alias("s"))))
    some = F.coalesce(F.size(score), F.lit(0)) > 0
    return df.withColumn("__q_z", F.transform(keyed, lambda s: s["s"])).withColumns({n: F.when(some, F.col("__q_z")[n]).otherwise(F.col(n)) for n in names}).drop("__q_z")


def scores_for(masks: Column, scores: Column) -> Column:
    """A score for each mask: without scores 1, beyond the end of a shorter list 0."""
    return F.transform(masks, lambda _, i: F.when(scores.isNull(), 1.0).otherwise(F.coalesce(F.get(scores, i), F.lit(0.0))))


def above(scores: Column, threshold: float) -> Column:
    """How many scores exceed the threshold; none of none."""
    return F.coalesce(F.size(F.filter(scores, lambda s: s > threshold)), F.lit(0))


def items_of(df: DataFrame, keys: list[str], containers: list[tuple[str, str]]) -> DataFrame:
    """keys, source, item of several containers of strings: columns (name, path) that are maps or lists; source tells
    the path and the key (`path.key`) or the place (`path[0]`)."""
    parts = []
    for name, path in containers:
        if df.schema[name].dataType.typeName() == "map":
            rows, source = df.select(*keys, F.explode(name).alias("__q_k", "item")), F.concat(F.lit(f"{path}."), F.col("__q_k").cast("string"))
        else:
            rows, source = df.select(*keys, F.posexplode(name).alias("__q_k", "item")), F.concat(F.lit(f"{path}["), F.col("__q_k").cast("string"), F.lit("]"))
        parts.append(rows.where(F.col("item").isNotNull()).select(*keys, source.alias("source"), "item"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Boxes and points


def noised(box: Column, width: Column, height: Column, share: float, most: float, seed: int, *keys: Column) -> Column:
    """Each corner moved by at most the smaller of `share` of the side and `most` pixels, inside the image; a box is given as x1, y1, x2, y2 fields."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    move = lambda side, k: (2 * uniform(seed + k, *keys) - 1) * F.least(share * side, F.lit(float(most)))
    into = lambda v, end: F.greatest(F.lit(0.0), F.least(v, end.cast("double")))
    return F.struct(into(box["x1"] + move(w, 0), width).alias("x1"), into(box["y1"] + move(h, 1), height).alias("y1"), into(box["x2"] + move(w, 2), width).alias("x2"), into(box["y2"] + move(h, 3), height).alias("y2"))


def point_in(box: Column, mode: Column, seed: int, *keys: Column) -> Column:
    """x, y of a point of the box: its `center`, or one drawn (`random`); another mode is an error."""
    at = lambda a, b, u: box[a] + (box[b] - box[a]) * u
    point = lambda u, v: F.struct(at("x1", "x2", u).alias("x"), at("y1", "y2", v).alias("y"))
    unknown = F.raise_error(F.concat(F.lit("unknown mode "), mode))
    return F.when(mode == "center", point(F.lit(0.5), F.lit(0.5))).when(mode == "random", point(uniform(seed, *keys), uniform(seed + 1, *keys))).otherwise(unknown.cast("struct<x:double,y:double>"))
