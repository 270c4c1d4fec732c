"""Reads of the test tables and the roles they play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import boxes


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames of cameras: camera user_id, frame the minute since 2024, unique per camera."""
    e = table(spark, sf_dir, "events", "user_id", "ts")
    return e.select(F.col("user_id").alias("cam"), F.floor(micros("ts") / 60_000_000).alias("frame")).distinct()


FRAMES_SQL = "frames AS (SELECT DISTINCT user_id AS cam, CAST(floor(epoch(ts) / 60) AS BIGINT) AS frame FROM events)"


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as scored boxes of frames: `grp` a block of fifty keys, `b` the box."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    x, y = F.col("p_partkey") % 97, (F.col("p_partkey") * 31) % 89
    w, h = 10 + F.col("p_size"), 12 + F.col("p_partkey") % 17
    return p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 50).alias("grp"), F.col("p_retailprice").alias("score"), boxes.from_xywh(x.cast("double"), y.cast("double"), w.cast("double"), h.cast("double")).alias("b"))


BOXES_SQL = """boxes AS (SELECT p_partkey AS id, p_partkey // 50 AS grp, p_retailprice AS score,
    CAST(p_partkey % 97 AS DOUBLE) AS x1, CAST((p_partkey * 31) % 89 AS DOUBLE) AS y1,
    CAST(p_partkey % 97 + 10 + p_size AS DOUBLE) AS x2, CAST((p_partkey * 31) % 89 + 12 + p_partkey % 17 AS DOUBLE) AS y2 FROM part),
  pairs AS (SELECT a.grp, a.id AS a, b.id AS b, a.score AS sa, b.score AS sb,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab,
    (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull
    FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id <> b.id)"""
