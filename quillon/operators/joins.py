"""Joins that the built-in ones don't name: nearest in time, priority look-ups, overlapping ranges, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import windows as W


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, direction: str = "backward", name: str | None = None) -> DataFrame:
    """`left` with the `value` of the last right row at or before `at` (backward) or the first at or after it (forward).

    Both sides meet in one union per key and a window carries the last value
    on: one shuffle, no range join.  Of right rows at one time the largest value counts.
    """
    out = name or f"{value}_{direction}"
    extra = [c for c in left.columns if c not in [*keys, at]]
    l = left.select(*keys, at, F.lit(1).alias("__q_side"), F.struct(*([F.col(c) for c in extra] or [F.lit(None).alias("none")])).alias("__q_row"), F.lit(None).cast(right.schema[value].dataType).alias("__q_value"))
    shape = l.schema["__q_row"].dataType
    r = right.select(*keys, at, F.lit(0).alias("__q_side"), F.lit(None).cast(shape).alias("__q_row"), F.col(value).alias("__q_value"))
    forward = direction == "forward"
    order = [F.desc(at) if forward else F.asc(at), F.asc("__q_side"), F.asc("__q_value")]
    carried = F.last("__q_value", True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = l.union(r).withColumn(out, carried).where("__q_side = 1")
    return both.select(*keys, at, *[F.col("__q_row")[c].alias(c) for c in extra], out)


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, right_id: str, k: int, most: float | None = None) -> DataFrame:
    """For each left row its k nearest right rows of the same key by |time difference|, the earlier first on ties, then the smaller id; none beyond `most`.

    One union per key tells each left row how many right rows are at or before
    it, so the k before and the k after are known by number and an equi-join on
    key and number fetches them: work and rows grow with the rows of both sides
    times k, and a hot key is dealt by number.  Rows without a key or a time find
    nothing.
    """
    kinds = {c: left.schema[c].dataType for c in left.columns}
    row = F.struct(*[F.col(c) for c in left.columns])
    l = left.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__q_at"), F.lit(1).alias("__q_side"), F.monotonically_increasing_id().alias("__q_id"), row.alias("__q_row"))
    shape = l.schema["__q_row"].dataType
    there = right.where(F.col(right_at).isNotNull())
    r = there.select(*keys, F.col(right_at).cast(kinds[at]).alias("__q_at"), F.lit(0).alias("__q_side"), F.lit(None).cast("long").alias("__q_id"), F.lit(None).cast(shape).alias("__q_row"))
    placed = W.running_within(l.union(r), keys, ["__q_at", "__q_side", "__q_id"], {"__q_before": (1 - F.col("__q_side")).cast("long")}).where("__q_side = 1")
    # Numbered so that the last before a time are those of the smallest ids, and so are the first after it.
    numbers = {"__q_down": [F.asc(right_at), F.desc(right_id)], "__q_up": [F.asc(right_at), F.asc(right_id)]}
    names = {c: f"__q_r_{c}" for c in right.columns}
    found = None
    for name, order in numbers.items():
        first = F.col("__q_before") - k + 1 if name == "__q_down" else F.col("__q_before") + 1
        asked = placed.withColumn(name, F.explode(F.sequence(first, first + k - 1)))
        there_n = W.rank_within_ranges(there, keys, order, name).withColumnsRenamed(names)
        met = asked.join(there_n, [*[F.col(c) == F.col(names[c]) for c in keys], asked[name] == there_n[name]]).select("__q_id", "__q_row", *names.values())
        found = met if found is None else found.unionByName(met)
    gap = F.abs(F.col(f"__q_row.{at}").cast("double") - F.col(names[right_at]).cast("double"))
    if most is not None:
        found = found.where(gap <= most)
    rank = F.row_number().over(Window.partitionBy("__q_id").orderBy(gap, names[right_at], names[right_id]))
    best = found.withColumn("nearest_rank", rank).where(F.col("nearest_rank") <= k)
    return best.select(*[F.col("__q_row")[c].alias(c) for c in left.columns], *[F.col(n).alias(c) for c, n in names.items() if c not in keys], "nearest_rank")


def fill_from(df: DataFrame, dim: DataFrame, key: str, columns: list[str], default: dict | None = None) -> DataFrame:
    """Missing values of `columns` from the row of `dim` with the same key, else `default`."""
    side = dim.select(F.col(key).alias("__q_key"), *[F.col(c).alias(f"__q_{c}") for c in columns])
    joined = df.join(side, F.col(key) == F.col("__q_key"), "left")
    filled = {c: F.coalesce(*([F.col(c)] if c in df.columns else []), F.col(f"__q_{c}"), F.lit((default or {}).get(c))) for c in columns}
    return joined.withColumns(filled).drop("__q_key", *[f"__q_{c}" for c in columns])


def cascade(parents: DataFrame, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """Children (table, foreign key, own key) left by filtered parents, level by level."""
    out, key = [parents], None
    for child, foreign, own in children:
        up = out[-1].select(F.col(key or foreign if key else parents.columns[0]).alias("__q_up"))
        out.append(child.join(up.distinct(), F.col(foreign) == F.col("__q_up"), "left_semi"))
        key = own
    return out


def missing_as_default(wanted: DataFrame, found: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """`found` and a row of `defaults` for each wanted key it lacks."""
    lacking = wanted.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")
    return found.unionByName(lacking.select(*keys, *[F.lit(v).alias(c) for c, v in defaults.items()]).select(*found.columns))


def overlapping_buckets(df: DataFrame, value: str, buckets: list[tuple[str, float, float]], name: str = "bucket") -> DataFrame:
    """Each row once per bucket (name, low, high), ends included, that holds its value; buckets may overlap."""
    hit = F.array_compact(F.array(*[F.when((F.col(value) >= lo) & (F.col(value) <= hi), F.lit(n)) for n, lo, hi in buckets]))
    return df.withColumn(name, F.explode(hit))


def by_priority(df: DataFrame, keys: list[str], conditions: list[Column], order: list) -> DataFrame:
    """Per key the first row of the best fulfilled condition (0 is best), then by `order`; rows that fulfil none are out."""
    level = F.coalesce(*[F.when(c, i) for i, c in enumerate(conditions)])
    ranked = df.withColumn("priority", level).where(F.col("priority").isNotNull())
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", *order))
    return ranked.withColumn("__q_n", n).where("__q_n = 1").drop("__q_n")


def referential_gaps(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is missing: an empty result is the assertion."""
    return child.join(parent.select(F.col(key).alias("__q_key")).distinct(), F.col(foreign) == F.col("__q_key"), "left_anti")


def common_groups(a: DataFrame, b: DataFrame, keys: list[str], item: str, least: int) -> DataFrame:
    """Groups with at least `least` items on both sides, with their number."""
    both = a.select(*keys, item).intersect(b.select(*keys, item))
    return both.groupBy(*keys).agg(F.count("*").alias("n_common")).where(F.col("n_common") >= least)


def resolve_windows(segments: DataFrame, windows: DataFrame, segment: str, cam: str, number: str, start: str, end: str) -> DataFrame:
    """Each segment with start and end of the window it names by camera and number, else of its camera's shortest window (the first of equals), else nulls."""
    named = segments.join(windows.select(cam, number, F.col(start).alias("__q_s"), F.col(end).alias("__q_e")), [cam, number], "left")
    shortest = windows.groupBy(cam).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(number).alias("n"), F.col(start).alias("s"), F.col(end).alias("e"))).alias("__q_w"))
    joined = named.join(shortest, cam, "left")
    return joined.withColumns({start: F.coalesce("__q_s", "__q_w.s"), end: F.coalesce("__q_e", "__q_w.e")}).drop("__q_s", "__q_e", "__q_w")
