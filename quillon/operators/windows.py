"""Ranking, sessions, fixed-count windows, even samples and re-labelling.

Spark sorts are not stable, so every order ends in a unique column that the
caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.streaming.runs import shared_path


def _ordered(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def rank_within(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """1, 2, ... in each group of `keys` by `order`."""
    return df.withColumn(name, F.row_number().over(_ordered(keys, order)))


def rank_globally(df: DataFrame, order: list, name: str, least: str = "__q_part") -> DataFrame:
    """1, 2, ... over the whole table without one task seeing all rows: range
    partitions are numbered inside and shifted by the sizes of those before.

    They are written once with their numbers: a plan that dealt the rows again
    for the sizes could cut the ranges elsewhere.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranks")
    dealt = df.repartitionByRange(*order).withColumn(least, F.spark_partition_id())
    dealt.write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    inside = dealt.withColumn("__q_n", F.row_number().over(_ordered([least], order)))
    # One row per partition.
    sizes = inside.groupBy(least).agg(F.count("*").alias("__q_size"))
    before = F.coalesce(F.sum("__q_size").over(Window.orderBy(least).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__q_before", before).select(least, "__q_before")
    return inside.join(F.broadcast(sizes), least).withColumn(name, F.col("__q_n") + F.col("__q_before")).drop(least, "__q_n", "__q_before")


def running_within(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Running sums of each group of `keys` by `order`, without one task seeing all rows of a group.

    Ranges of (keys, order) are written once, summed inside and shifted by what
    the group has in the ranges before: a row per group and range that it is in.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "running")
    dealt = df.withColumns({f"__q_v_{n}": v for n, v in sums.items()}).repartitionByRange(*keys, *order).withColumn("__q_part", F.spark_partition_id())
    dealt.write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    inside = _ordered(["__q_part", *keys], order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("__q_part", *keys).agg(*[F.sum(f"__q_v_{n}").alias(f"__q_t_{n}") for n in sums])
    before = _ordered(keys, ["__q_part"]).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__q_part").alias("__q_p"), *[F.col(k).alias(f"__q_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"__q_t_{n}").over(before), F.lit(0)).alias(f"__q_b_{n}") for n in sums])
    same = F.col("__q_part") == F.col("__q_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__q_k{i}"))
    summed = dealt.withColumns({n: F.sum(f"__q_v_{n}").over(inside) for n in sums}).join(shifts, same)
    return summed.select(*[c for c in df.columns if c not in sums], *[(F.col(n) + F.col(f"__q_b_{n}")).alias(n) for n in sums])


def rank_within_ranges(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """`rank_within` for few or large groups."""
    return running_within(df, keys, order, {name: F.lit(1).cast("long")})


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group; by names of columns it is a minimum, which sums up before anything moves, however large a group is."""
    if all(isinstance(o, str) for o in order):
        best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("__q_row"))
        return best.select("__q_row.*")
    return rank_within(df, keys, order, "__q_n").where("__q_n = 1").drop("__q_n")


def every_nth(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Positions 0, n, 2n, ... of each group."""
    return rank_within(df, keys, order, "__q_n").where((F.col("__q_n") - 1) % n == 0).drop("__q_n")


def gaps(df: DataFrame, keys: list[str], value: str, name: str = "gap", order: list | None = None) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_ordered(keys, order or [value])))


def sessions(df: DataFrame, keys: list[str], value: str, factor: float, run: str = "run_index", order: list | None = None) -> DataFrame:
    """Runs that end where the next gap exceeds `factor` times the group's exact median positive gap.

    A gap equal to the threshold doesn't part; a group without positive gaps is one run.
    Adds gap, median_gap, max_gap and the run's number from 0.
    """
    g = gaps(df, keys, value, "gap", order)
    every = Window.partitionBy(*keys)
    g = g.withColumn("median_gap", F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(every)).withColumn("max_gap", F.col("median_gap") * factor)
    cut = F.sum(F.coalesce((F.col("gap") > F.col("max_gap")).cast("int"), F.lit(0)))
    return g.withColumn(run, cut.over(_ordered(keys, order or [value])))


def fixed_windows(df: DataFrame, keys: list[str], order: list, size: int, stride: int) -> DataFrame:
    """Each row once per window of `size` consecutive rows that holds it, with
    window_start (a 0-based position) and pos (in the window).  Windows start at 0, stride, 2 stride, ...;
    the last `size` rows are a window too; groups of fewer rows have none.

    A row finds its windows by arithmetic, so nothing is joined.
    """
    r = rank_within(df, keys, order, "__q_n").withColumn("__q_i", F.col("__q_n") - 1).withColumn("__q_len", F.count("*").over(Window.partitionBy(*keys)))
    tail, i = F.col("__q_len") - size, F.col("__q_i")
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / F.lit(float(stride))) * stride)
    high = F.least(i, tail)
    regular = F.when(low <= high, F.filter(F.sequence(low.cast("long"), F.greatest(high, low).cast("long"), F.lit(stride).cast("long")), lambda s: (s <= high) & (s >= 0))).otherwise(F.array().cast("array<bigint>"))
    last = F.when((tail >= 0) & (i >= tail), F.array(tail.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    starts = F.when(tail >= 0, F.array_distinct(F.concat(regular, last))).otherwise(F.array().cast("array<bigint>"))
    return r.withColumn("window_start", F.explode(starts)).withColumn("pos", F.col("__q_i") - F.col("window_start")).drop("__q_n", "__q_i", "__q_len")


def _even_position(i: Column, n: Column, k: int) -> Column:
    return F.bround(i * (n - 1) / F.lit(float(k - 1))).cast("long")


def even_sample(df: DataFrame, keys: list[str], order: list, k: int, name: str | None = None) -> DataFrame:
    """At most k evenly spread rows of each group: positions i (n - 1) / (k - 1) rounded half to even; all where n <= k; the middle one where k is 1."""
    r = rank_within(df, keys, order, "__q_n").withColumn("__q_i", F.col("__q_n") - 1).withColumn("__q_len", F.count("*").over(Window.partitionBy(*keys)))
    n, i = F.col("__q_len"), F.col("__q_i")
    if k == 1:
        keep = i == F.floor(n / 2)
    else:
        # Position i is hit by some j in 0..k-1 near i (k - 1) / (n - 1).
        j = F.floor(i * (k - 1) / F.greatest(n - 1, F.lit(1)))
        hit = F.lit(False)
        for d in (-1, 0, 1, 2):
            at = j + d
            hit = hit | ((at >= 0) & (at <= k - 1) & (_even_position(at, n, k) == i))
        keep = (n <= k) | hit
    kept = r.where(keep)
    if name:
        kept = kept.withColumn(name, F.col("__q_i"))
    return kept.drop("__q_n", "__q_i", "__q_len")


def trim_ends(df: DataFrame, keys: list[str], order: list, share: float = 0.05, above: int = 40) -> DataFrame:
    """Floor(share * n) rows off both ends of groups of more than `above` rows."""
    r = rank_within(df, keys, order, "__q_n").withColumn("__q_len", F.count("*").over(Window.partitionBy(*keys)))
    cut = F.when(F.col("__q_len") > above, F.floor(F.col("__q_len") * share)).otherwise(0)
    return r.where((F.col("__q_n") > cut) & (F.col("__q_n") <= F.col("__q_len") - cut)).drop("__q_n", "__q_len")


def pages(df: DataFrame, keys: list[str], order: list, size: int, page: str = "page", slot: str = "slot") -> DataFrame:
    """Rows dealt to pages (or buckets) of `size`, both from 0."""
    n = F.row_number().over(_ordered(keys, order)) - 1
    return df.withColumn("__q_n", n).withColumn(page, F.floor(F.col("__q_n") / size)).withColumn(slot, F.col("__q_n") % size).drop("__q_n")


def dense_ids(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Values of each group to 0, 1, ... in their order."""
    return df.withColumn(name, F.dense_rank().over(_ordered(keys, [value])) - 1)


def pair_ids(present: DataFrame, all_pairs: DataFrame, keys: list[str], order: str, name: str = "pair_id") -> DataFrame:
    """Pairs of `present` get 1..n in sorted order, those of `all_pairs` only get n + 1, ... in `order`.

    Numbers run over distinct pairs, through range partitions.
    """
    first = rank_globally(present.select(*keys).distinct(), keys, name).withColumn("positive", F.lit(True))
    rest = all_pairs.join(first.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(order).alias("__q_o"))
    rest = rank_globally(rest, ["__q_o", *keys], "__q_k")
    n = first.agg(F.count("*").alias("__q_count"))
    rest = rest.crossJoin(F.broadcast(n)).select(*keys, (F.col("__q_k") + F.col("__q_count")).alias(name), F.lit(False).alias("positive"))
    return first.select(*keys, name, "positive").union(rest)


def unique_ids(df: DataFrame, scope: str, value: str, name: str) -> DataFrame:
    """`value` where only one `scope` uses it; else a new id above the largest, by (value, scope)."""
    pairs = df.select(scope, value).distinct()
    used = pairs.groupBy(value).agg(F.count("*").alias("__q_scopes"))
    clash = used.where("__q_scopes > 1").join(pairs, value).select(value, scope)
    fresh = rank_globally(clash, [value, scope], "__q_k")
    most = pairs.agg(F.max(value).alias("__q_most"))
    fresh = fresh.crossJoin(F.broadcast(most)).select(F.col(value).alias("__q_v"), F.col(scope).alias("__q_s"), (F.col("__q_most") + F.col("__q_k")).alias("__q_new"))
    joined = df.join(fresh, (F.col(value) == F.col("__q_v")) & (F.col(scope) == F.col("__q_s")), "left")
    return joined.withColumn(name, F.coalesce("__q_new", value)).drop("__q_v", "__q_s", "__q_new")


def look_ahead(df: DataFrame, keys: list[str], order: list, value: str, steps: int, name: str) -> DataFrame:
    """The value `steps` rows on, the group's last one near its end."""
    w = _ordered(keys, order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(F.row_number().over(w) + steps <= size, F.lead(value, steps).over(w)).otherwise(last))


def streak(df: DataFrame, keys: list[str], order: list, hit: str, least: int, run: str = "streak", status: str = "confirmed") -> DataFrame:
    """Consecutive hits up to each row (0 at a miss), and whether `least` of them in a row have been seen so far."""
    w = _ordered(keys, order)
    island = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w)
    s = df.withColumn("__q_island", island)
    s = s.withColumn(run, F.sum(F.when(F.col(hit), 1).otherwise(0)).over(_ordered([*keys, "__q_island"], order)).cast("long")).drop("__q_island")
    return s.withColumn(status, F.max(F.col(run) >= least).over(w))


def saturating_counter(df: DataFrame, keys: list[str], order: str, hit: str, low: int, high: int, start: int, name: str = "keep_alive", block: int = 1024) -> DataFrame:
    """keys, order and the counter after each row: +1 at a hit and -1 else, held within [low, high].

    A step is x -> max(low, min(high, x + d)), and any run of steps is again
    max(a, min(b, x + s)).  So a key's history is cut into blocks that fold
    independently, their few numbers give each block its first value, and the
    rows of a block follow from that: no array is longer than `block` rows or a
    key's number of blocks.
    """
    n = F.row_number().over(_ordered(keys, [order])) - 1
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.when(F.col(hit), 1).otherwise(-1).cast("bigint").alias("d"))))
    blocks = df.withColumn("__q_block", F.floor(n / block)).groupBy(*keys, "__q_block").agg(rows.alias("__q_rows"))

    def held(v: Column) -> Column:
        return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), v))

    far = 1 << 60
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(-far).cast("bigint").alias("a"), F.lit(far).cast("bigint").alias("b"))
    whole = F.aggregate("__q_rows", zero, lambda f, r: F.struct((f["s"] + r["d"]).alias("s"), held(f["a"] + r["d"]).alias("a"), held(f["b"] + r["d"]).alias("b")))
    steps = blocks.select(*keys, "__q_block", whole.alias("f")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__q_block", "f"))).alias("fs"))
    firsts = F.aggregate("fs", F.array(F.lit(start).cast("bigint")), lambda v, x: F.concat(v, F.array(F.greatest(x["f"]["a"], F.least(x["f"]["b"], F.element_at(v, -1) + x["f"]["s"])))))
    firsts = steps.select(*keys, F.posexplode(firsts).alias("__q_block", "__q_first")).withColumn("__q_block", F.col("__q_block").cast("bigint"))
    values = F.aggregate("__q_rows", F.array("__q_first"), lambda v, r: F.concat(v, F.array(held(F.element_at(v, -1) + r["d"]))))
    done = blocks.join(firsts, [*keys, "__q_block"]).withColumn("__q_values", values)
    zipped = F.zip_with("__q_rows", F.slice("__q_values", F.lit(2), F.size("__q_rows")), lambda r, v: F.struct(r["at"].alias("at"), v.alias("v")))
    return done.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.col("z.at").alias(order), F.col("z.v").alias(name))


def deal_least_loaded(df: DataFrame, keys: list[str], order: str, load: str, workers: int, name: str = "worker") -> DataFrame:
    """Rows of a group, one by one in `order`, to the worker with the smallest load so far (the first of equals).

    What is dealt at once is a frame's new objects, so a group is one fold.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(load).cast("bigint").alias("load"))))
    grouped = df.groupBy(*keys).agg(rows.alias("__q_rows"))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), workers).alias("loads"), F.array().cast("array<bigint>").alias("to"))

    def step(s: Column, r: Column) -> Column:
        least = F.array_position(s["loads"], F.array_min(s["loads"])) - 1
        return F.struct(F.transform(s["loads"], lambda x, i: F.when(i == least, x + r["load"]).otherwise(x)).alias("loads"), F.concat(s["to"], F.array(least)).alias("to"))

    dealt = grouped.withColumn("__q_to", F.aggregate("__q_rows", start, step)["to"])
    placed = dealt.select(*keys, F.explode(F.arrays_zip(F.transform("__q_rows", lambda r: r["at"]).alias("at"), F.col("__q_to").alias("to"))).alias("z"))
    return df.join(placed.select(*keys, F.col("z.at").alias(order), F.col("z.to").alias(name)), [*keys, order])
