"""Filters of annotated data and the cascade that keeps ids dense behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_crowd(flag: Column) -> Column:
    return ~F.coalesce(flag.cast("boolean"), F.lit(False))


def exhaustive(truths: list[DataFrame], image: str, flag: str) -> DataFrame:
    """Images that the first annotation calls exhaustive and no other calls incomplete."""
    kept = truths[0].where(F.col(flag).cast("boolean")).select(image).distinct()
    for other in truths[1:]:
        kept = kept.join(other.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).select(image).distinct(), image, "left_anti")
    return kept


def exhaustive_query(instance: Column, pixel: Column) -> Column:
    """Incomplete instances are out; an unknown pixel flag passes."""
    return F.coalesce(instance, F.lit(False)) & F.coalesce(pixel, F.lit(True))


def valid_geometric(text: Column, box: Column, targets: Column) -> Column:
    """A geometric query (by its text) with a box must have targets."""
    return ~(box.isNotNull() & (F.coalesce(text, F.lit("")) == "geometric") & (F.coalesce(F.size(targets), F.lit(0)) <= 0))


def nonempty_area(area: Column, least: float = 1e-6) -> Column:
    return area >= least


def null_empty_boxes(df: DataFrame, boxes: str, masks: str, areas: str) -> DataFrame:
    """In three parallel arrays null where the area is 0 or null or the box is null or all zero."""
    from quillon.functions.boxes import is_zero

    void = F.zip_with(boxes, areas, lambda b, a: is_zero(b) | F.coalesce(a, F.lit(0)).eqNullSafe(F.lit(0)))
    hide = lambda c: F.zip_with(c, "__q_void", lambda x, v: F.when(~v, x))
    return df.withColumn("__q_void", void).withColumns({c: hide(F.col(c)) for c in (boxes, masks, areas)}).drop("__q_void")


def long_masks(df: DataFrame, masks: str, siblings: list[str], least: int = 5) -> DataFrame:
    """Masks of fewer than `least` characters leave, and so do their places in the parallel arrays."""
    names = [masks, *siblings]
    kept = F.filter(F.arrays_zip(*names), lambda s: F.length(s[masks]) >= least)
    return df.withColumn("__q_z", kept).withColumns({n: F.col("__q_z")[n] for n in names}).drop("__q_z")


def at_most(df: DataFrame, group: list[str], key: str, most: int, first: Column | None = None, seed: int = 0) -> DataFrame:
    """`most` rows of each group, chosen by a hash of key and seed; rows for which `first` holds come before all others."""
    order = [F.xxhash64(F.lit(seed), key), F.col(key)]
    if first is not None:
        order = [F.when(first, 0).otherwise(1), *order]
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__q_n", n).where(F.col("__q_n") <= most).drop("__q_n")


def same_in_all_stages(df: DataFrame, group: list[str], position: str, stage: str, most: int, seed: int = 0) -> DataFrame:
    """Positions chosen in the first stage, kept in all stages of the group."""
    chosen = at_most(df.where(F.col(stage) == 0), group, position, most, None, seed).select(*group, position)
    return df.join(chosen, [*group, position], "left_semi")


def without_degenerate_targets(queries: DataFrame, objects: DataFrame, query: str, width: str, height: str) -> DataFrame:
    """Queries none of whose objects lacks a width or a height."""
    bad = objects.where((F.col(width) <= 0) | (F.col(height) <= 0)).select(query).distinct()
    return queries.join(bad, query, "left_anti")


def with_tag(rows: DataFrame, annotations: DataFrame, sequence: str, tags: str, tag: str) -> DataFrame:
    """Rows of the sequences whose annotations carry the tag."""
    return rows.join(annotations.where(F.array_contains(tags, tag)).select(sequence).distinct(), sequence, "left_semi")


def split_known(rows: DataFrame, category: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known categories and all others."""
    ids = known.select(category).distinct()
    return rows.join(ids, category, "left_semi"), rows.join(ids, category, "left_anti")


def hidden_removed(rows: DataFrame, keys: list[str], *hidden: DataFrame) -> DataFrame:
    """Rows whose keys no table of hidden ones holds."""
    union = hidden[0].select(*keys)
    for h in hidden[1:]:
        union = union.union(h.select(*keys))
    return rows.join(union.distinct(), keys, "left_anti")


def cascade_filter(queries: DataFrame, objects: DataFrame, images: DataFrame, keep: Column, drop_objects: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a filter on queries leaves of a datapoint's three tables, with dense ids.

    `queries`: dp, query, stage, image, objects (array of positions).
    `objects`: dp, image, object.  `images`: dp, image.  Surviving queries get
    dense stages; objects that no surviving query refers to, or for which
    `drop_objects` holds, leave and the others' positions close up; images
    without queries leave.  References are rewritten, those to dropped objects
    taken out.  Datapoints without a query of stage 0 leave whole.
    """
    kept = queries.where(keep)
    started = kept.where("stage = 0").select("dp").distinct()
    kept = kept.join(started, "dp", "left_semi")
    stage = F.dense_rank().over(Window.partitionBy("dp").orderBy("stage")) - 1
    kept = kept.withColumn("stage", stage)
    used = kept.select("dp", "image", F.explode("objects").alias("object")).distinct()
    alive = objects if drop_objects is None else objects.where(~drop_objects)
    alive = alive.join(used, ["dp", "image", "object"], "left_semi")
    left = images.join(kept.select("dp", "image").distinct(), ["dp", "image"], "left_semi")
    left = left.withColumn("new_image", F.row_number().over(Window.partitionBy("dp").orderBy("image")) - 1)
    renumbered = alive.withColumn("new_object", F.row_number().over(Window.partitionBy("dp", "image").orderBy("object")) - 1)
    maps = renumbered.groupBy("dp", "image").agg(F.map_from_entries(F.collect_list(F.struct("object", "new_object"))).alias("__q_map"))
    q = kept.join(maps, ["dp", "image"], "left").join(left.select("dp", "image", "new_image"), ["dp", "image"])
    new = F.array_compact(F.transform("objects", lambda o: F.try_element_at("__q_map", o)))
    q = q.withColumn("objects", F.when(F.col("__q_map").isNull(), F.array().cast("array<int>")).otherwise(new))
    q = q.select("dp", "query", "stage", F.col("new_image").alias("image"), "objects")
    o = renumbered.join(left.select("dp", "image", "new_image"), ["dp", "image"]).select("dp", F.col("new_image").alias("image"), F.col("new_object").alias("object"), *[c for c in objects.columns if c not in ("dp", "image", "object")])
    i = left.select("dp", F.col("new_image").alias("image"), *[c for c in images.columns if c not in ("dp", "image")])
    return q, o, i


def rewrite_some(df: DataFrame, key: str, column: str, value: Column, share: float, seed: int = 0) -> DataFrame:
    """`column` replaced in about `share` of the rows, chosen by a hash of key and seed: reruns agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return df.withColumn(column, F.when(u < share, value).otherwise(F.col(column)))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """violation, n: how many rows break each named rule."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n") for name, t in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def renumbered_stages(df: DataFrame, keys: list[str], stage: str, wanted: list[int], reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted stages, numbered anew from 0 in their order or, `reverse`, from the last back; keys and stage of those that a group lacks)."""
    order = sorted(set(wanted), reverse=reverse)
    kept = df.where(F.col(stage).isin(order))
    place = (F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage)) - 1).cast(df.schema[stage].dataType)
    there = df.select(*keys).distinct().withColumn(stage, F.explode(F.array(*[F.lit(s).cast(df.schema[stage].dataType) for s in order])))
    return kept.withColumn(stage, place), there.join(kept.select(*keys, stage).distinct(), [*keys, stage], "left_anti")


def tagged_sequences(df: DataFrame, sequence: str, tags: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the sequences that carry the tag, sequences whose rows disagree about it: an empty result is the assertion)."""
    has = F.coalesce(F.array_contains(tags, tag), F.lit(False))
    seen = df.groupBy(sequence).agg(F.bool_or(has).alias("__q_some"), F.bool_and(has).alias("__q_all"))
    return df.join(seen.where("__q_some").select(sequence), sequence, "left_semi"), seen.where("__q_some AND NOT __q_all").select(sequence)
