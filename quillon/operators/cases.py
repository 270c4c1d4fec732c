"""Choices and fallbacks around annotation cases: which view, which mask, which variant, which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def choose_source(masks: DataFrame, keys: list[str], view: str, frame: str, preferred: str | None, prefix: str) -> DataFrame:
    """keys, view, frame: of each case the preferred view if it is there, else the first that starts with `prefix`, else the first; in it the earliest frame."""
    level = F.when(F.col(view).eqNullSafe(F.lit(preferred)) & F.lit(preferred is not None), 0).when(F.startswith(view, F.lit(prefix)), 1).otherwise(2)
    return masks.groupBy(*keys).agg(F.min(F.struct(level.alias("level"), F.col(view).alias("view"), F.col(frame).alias("frame"))).alias("__q_s")).select(*keys, F.col("__q_s.view").alias(view), F.col("__q_s.frame").alias(frame))


def split_views(views: DataFrame, keys: list[str], view: str, prefix: str) -> DataFrame:
    """keys, source (the first view that starts with `prefix`), targets (all others, in order), complete: whether both sides are there."""
    is_source = F.startswith(view, F.lit(prefix))
    g = views.groupBy(*keys).agg(F.min(F.when(is_source, F.col(view))).alias("source"), F.array_sort(F.collect_set(F.when(~is_source, F.col(view)))).alias("targets"))
    return g.withColumn("complete", F.col("source").isNotNull() & (F.size("targets") > 0))


def page_bounds(df: DataFrame, keys: list[str], order: list[str], frame: str, size: int) -> DataFrame:
    """keys, page, first, last, n of pages of `size` rows."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    paged = df.withColumn("__q_n", n).withColumn("page", F.floor(F.col("__q_n") / size))
    return paged.groupBy(*keys, "page").agg(F.min_by(frame, "__q_n").alias("first"), F.max_by(frame, "__q_n").alias("last"), F.count("*").alias("n"))


def first_success(df: DataFrame, keys: list[str], order: str, ok: Column, value: Column, error: Column) -> DataFrame:
    """keys, value of the first variant that went well (null if none did), error of the last one before it that didn't.

    Two sums of fixed size per key, however many variants failed; rows with a null key are one group.
    """
    rows = df.select(*keys, F.col(order).alias("__q_o"), F.coalesce(ok, F.lit(False)).alias("__q_ok"), value.alias("__q_v"), error.alias("__q_e"))
    won = rows.groupBy(*keys).agg(F.min(F.when(F.col("__q_ok"), F.struct("__q_o", "__q_v"))).alias("__q_w"))
    won = won.select(*[F.col(k).alias(f"__q_k_{k}") for k in keys], "__q_w")
    same = [F.col(k).eqNullSafe(F.col(f"__q_k_{k}")) for k in keys]
    met = rows.join(won, same)
    before = ~F.col("__q_ok") & (F.col("__q_w").isNull() | (F.col("__q_o") < F.col("__q_w.__q_o")))
    last = F.max(F.when(before, F.struct("__q_o", "__q_e")))
    return met.groupBy(*keys).agg(F.first("__q_w").alias("__q_w"), last.alias("__q_l")).select(*keys, F.col("__q_w.__q_v").alias("value"), F.col("__q_l.__q_e").alias("error"))


def box_runs(x: Column, y: Column, w: Column, h: Column, height: int, width: int) -> Column:
    """Run lengths, column-major, of a box of whole pixels inside its image: closed form, no raster."""
    lead = x * height + y
    columns = F.flatten(F.transform(F.sequence(F.lit(1), w), lambda k: F.when(k < w, F.array(h, F.lit(height) - h)).otherwise(F.array(h, F.lit(height * width) - lead - (w - 1) * height - h))))
    return F.concat(F.array(lead), columns)


def copied(chosen: DataFrame, files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chosen rows with their file, chosen rows without one)."""
    return chosen.join(files, keys), chosen.join(files.select(*keys), keys, "left_anti")


def name_order(files: DataFrame, folder: list[str], stem: str, name: str = "position") -> DataFrame:
    """Position of each file in its folder: by number where all stems of the folder are numbers, else by name."""
    number = F.expr(f"try_cast({stem} as bigint)")
    numeric = F.min(number.isNotNull().cast("int")).over(Window.partitionBy(*folder)) == 1
    keyed = files.withColumn("__q_k", F.when(numeric, number))
    return keyed.withColumn(name, F.row_number().over(Window.partitionBy(*folder).orderBy("__q_k", stem)) - 1).drop("__q_k")


def id_column(df: DataFrame, candidates: tuple[str, ...] = ("track_id", "instance_id", "scalabel_id")) -> str:
    """The first of the candidate columns that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)} is a column")


def within_size(size: Column, limit: Column) -> Column:
    """A size at most the limit; without a limit everything passes."""
    return limit.isNull() | (size <= limit)


def round_robin(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "part") -> DataFrame:
    """Row i of each group goes to part i mod n."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % n)


def first_seen_index(df: DataFrame, keys: list[str], order: str, text: str, name: str = "index") -> DataFrame:
    """Each row with the number of its text among the group's distinct texts, in the order they first appear."""
    first = df.groupBy(*keys, text).agg(F.min(order).alias("__q_first"))
    numbered = first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("__q_first")) - 1).drop("__q_first")
    return df.join(numbered, [*keys, text])


def region_box(region: str, keys: tuple[str, ...]) -> Column:
    """The box of a region struct from several keys, later ones win; null unless it is valid."""
    from quillon.functions.boxes import valid_normalized

    return F.coalesce(*[valid_normalized(F.col(f"{region}.{k}")) for k in reversed(keys)])


def mask_union(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """keys, pixels: how many pixels any of the group's run-length masks sets.

    Runs are rows; those that touch or overlap merge along the pixel numbers.
    A group is the objects of one image.
    """
    from quillon.functions.masks import run_intervals

    runs = df.select(*keys, F.inline(run_intervals(F.col(counts))))
    order = Window.partitionBy(*keys).orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("first"), F.coalesce(reach, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return runs.withColumn("__q_fresh", fresh).groupBy(*keys).agg(F.sum("__q_fresh").alias("pixels"))


def open_world(found: DataFrame, matched: DataFrame, negative: DataFrame, incomplete: DataFrame, keys: list[str], video: str, cls: str) -> DataFrame:
    """Detections without those that no ground truth matches and that can't be judged: of classes that are neither
    known to be absent in the video nor annotated exhaustively there."""
    lost = found.join(matched.select(*keys), keys, "left_anti")
    unjudged = lost.join(negative.select(video, cls), [video, cls], "left_anti")
    unjudged = unjudged.unionByName(lost.join(incomplete.select(video, cls), [video, cls], "left_semi")).select(*keys).distinct()
    return found.join(unjudged, keys, "left_anti")
