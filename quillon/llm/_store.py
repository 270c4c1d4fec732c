"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset in local mode an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("quillon.shared.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="spark-quillon-")
            spark.conf.set("quillon.shared.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch to `most`: batches that hold whole texts stay small on both sides."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20, scanned: int = 0) -> Iterator[None]:
    """While open, Arrow batches of what is run inside hold at most `rows` rows and about `size` bytes, and batches of
    the Parquet reader at most `scanned` rows (0: as the session has it); the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    if scanned:
        wanted["spark.sql.parquet.columnarReaderBatchSize"] = str(scanned)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """A folder of written tables that cut lineage. `drop` frees one that later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def write(self, df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
        df.write.option("compression", "zstd").options(**options or {}).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
