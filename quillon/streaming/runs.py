"""Streams in and out: reads as they grow, sinks that replay safely."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset in local mode, an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix="spark-quillon-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_growing(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs over all that is there now, into files, and reads them: what a batch twin would give."""
    spark = stream.sparkSession
    at = shared_path(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _children(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Number and path of the folders `prefix`N below `path`; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {int(n.removeprefix(prefix)): f"{path}/{n}" for n in names if n.startswith(prefix)}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, every: int = 0, mode: str = "append", priority: list | None = None):
    """Each micro-batch becomes one version folder; a replayed batch overwrites its own, so nothing counts twice. Read with `current`.

    With `every`, the versions are compacted by `keys` after so many of them.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= max(_children(spark, f"{path}.commits", "generation="), default=-1):
            return  # it is part of a generation already
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")
        if every and len(_children(spark, path, "version=")) >= every:
            compact(spark, path, keys, priority)

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], priority: list | None = None) -> DataFrame:
    """The row of the latest version of each key; rows of one version by `priority`.

    What is read is the last committed generation and the versions after it.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version"), *(priority or [])))
    return _kept(spark, path).withColumn("__q_n", n).where("__q_n = 1").drop("__q_n", "version")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    committed = max(_children(spark, f"{path}.commits", "generation="), default=-1)
    parts = [spark.read.parquet(p).withColumn("version", F.lit(n)) for n, p in sorted(_children(spark, path, "version=").items()) if n > committed]
    if committed >= 0:
        parts.insert(0, spark.read.parquet(f"{path}.generations/generation={committed}").withColumn("version", F.lit(committed)))
    if not parts:
        raise ValueError(f"{path} holds no version")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


def compact(spark: SparkSession, path: str, keys: list[str], priority: list | None = None, buckets: int = 16) -> None:
    """Merges the last generation and the versions after it, dealt by key, into a new generation, and drops what it replaces.

    The generation counts from when its commit is written: a run that breaks off
    before leaves everything as it was, one that breaks off after it leaves
    folders that nobody reads, which the next one removes.
    """
    versions, generations = _children(spark, path, "version="), _children(spark, f"{path}.generations", "generation=")
    committed = max(_children(spark, f"{path}.commits", "generation="), default=-1)
    newest = max(versions, default=-1)
    if newest > committed:
        current(spark, path, keys, priority).repartition(buckets, *keys).write.mode("overwrite").parquet(f"{path}.generations/generation={newest}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.commits/generation={newest}")
    last = max(newest, committed)
    _remove(spark, [p for n, p in versions.items() if n <= last] + [p for n, p in generations.items() if n != last] + [p for n, p in _children(spark, f"{path}.commits", "generation=").items() if n != last])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts per event-time window and key; rows later than the watermark are out."""
    span = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(span, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
