"""Top-k with cross-worker dedup, group-level dedup, re-indexing, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_dumps(df: DataFrame, keys: list[str], image: str, worker: str, score: str, order: list, most: int) -> DataFrame:
    """Rows of a key count from the first worker that has it; then the `most` best scores of each image, earlier arrivals first on ties."""
    kept = earliest_worker(df, keys, worker)
    n = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score), worker, *order))
    return kept.withColumn("rank", n).where(F.col("rank") <= most)


def earliest_worker(df: DataFrame, keys: list[str], worker: str) -> DataFrame:
    """Of each key the whole list of its smallest worker."""
    return df.withColumn("__q_first", F.min(worker).over(Window.partitionBy(*keys))).where(F.col(worker) == F.col("__q_first")).drop("__q_first")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; k of 0 keeps all."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k) if k else ranked


def first_occurrence(df: DataFrame, key: str, order: list) -> DataFrame:
    return top_k(df, [key], order, 1, "__q_n").drop("__q_n")


def shift_if_zero(tables: dict[str, tuple[DataFrame, str]], references: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """Sections (table, id column) in which an id is 0 have all their ids raised by one, and so do the columns that
    refer to them: `references` maps a section to the (other section, its column)."""
    out = {n: t for n, (t, _) in tables.items()}
    for name, (table, key) in tables.items():
        shift = F.broadcast(table.agg(F.coalesce(F.bool_or(F.col(key) == 0), F.lit(False)).cast("int").alias("__q_shift")))
        out[name] = out[name].crossJoin(shift).withColumn(key, F.col(key) + F.col("__q_shift")).drop("__q_shift")
        for other, column in references.get(name, []):
            out[other] = out[other].crossJoin(shift).withColumn(column, F.col(column) + F.col("__q_shift")).drop("__q_shift")
    return out


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that depends on key and seed only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
