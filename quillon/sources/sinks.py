"""Writers: results, rankings, reports, cascaded copies, resumed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.tracks import rounded


def write_json(df: DataFrame, path: str, one_file: bool = False, mode: str = "error") -> None:
    """JSON lines; in one file only what is small by nature, such as a summary."""
    (df.coalesce(1) if one_file else df).write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, box: str = "bbox", score: str = "score") -> None:
    """Detections as a results file holds them: each task writes its own, coordinates and scores at five places."""
    rounded(df, box, score).write.json(path)


def write_ranking(ranked: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """The same ranking as JSON and as CSV of fixed columns, from one written copy."""
    ranked.select(*columns).orderBy(*order).write.parquet(f"{path}/table")
    table = ranked.sparkSession.read.parquet(f"{path}/table")
    table.write.json(f"{path}/json")
    table.write.option("header", True).csv(f"{path}/csv")


def write_summary(long: DataFrame, path: str, keys: list[str], metrics: list[str]) -> None:
    """A row per key and a column per metric, in the order given; `long` has keys, metric, value."""
    wide = long.groupBy(*keys).pivot("metric", metrics).agg(F.first("value")).select(*keys, *metrics)
    wide.coalesce(1).write.option("header", True).csv(path)


def detailed(sequences: DataFrame, combined: DataFrame, key: str, name: str = "COMBINED") -> DataFrame:
    """Rows per sequence and, named `name`, the combined one."""
    return sequences.unionByName(combined.withColumn(key, F.lit(name)).select(*sequences.columns))


def percent(value: Column, digits: int = 5) -> Column:
    """100 times the value, rounded to so many significant digits."""
    v = value * 100.0
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(v)))
    return F.when(v == 0, 0.0).otherwise(F.bround(v * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))


def write_filtered(tables: dict[str, DataFrame], path: str) -> None:
    """Filtered sections side by side; the originals stay where they are."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_remaining(todo: DataFrame, path: str, keys: list[str], group: str) -> int:
    """Appends the rows whose keys `path` doesn't have yet, a folder per `group`; the number of rows there now.

    A run that broke off goes on where it stopped: what is there is read first.
    """
    spark = todo.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        todo = todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    todo.write.mode("append").partitionBy(group).parquet(path)
    return spark.read.parquet(path).count()


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """How many cases ended how, and a total."""
    return df.rollup(status).agg(F.count("*").alias("n")).select(F.coalesce(status, F.lit("all")).alias(status), "n")


def merge_reports(reports: list[DataFrame], keys: list[str]) -> DataFrame:
    """Reports of several evaluators side by side: every key that any of them has."""
    out = reports[0]
    for r in reports[1:]:
        out = out.join(r, keys, "full")
    return out
