"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the records over buckets that a task's memory holds, by a
seeded hash of the whole record and, where records are repeated, of the copy's
number: no id, source or group of copies can crowd a bucket.  Pass two
shuffles each bucket by Fisher-Yates with a generator seeded by the bucket and
writes it.  The buckets in order are one random order of all records; the
shards are equal stretches of it, so their row counts differ by one at most
("rows").  A bucket's records go straight from its task into the files of the
one or two shards that it touches.

The result depends on the records, the seed and the number of buckets alone,
never on tasks, partitions or their order, so lost executors cost only time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._store import Workspace, bounded_batches

SEED = 20240611
#: Bytes of records that a bucket holds on average.
BUCKET = 16 << 20
#: Tasks of the second pass at most; beyond four times as many buckets each has more of them, one in memory at a time.
TASKS = 1 << 15
#: Copies of an equal record that one row of the scatter brings forth.
COPIES = 1000


def record_size(text: Column) -> Column:
    """Bytes of a record: those of its text in UTF-8 (none where null) and 16 for what is around it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of 0 to n - 1: each place from the last on swaps with one drawn from those up to it."""
    order = list(range(n))
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, 0, -1), drawn):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int) -> Callable:
    """A bucket's records in their new order, each with its place among all records."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("scatter")))
        order = fisher_yates(table.num_rows, [seed, table.column("bucket")[0].as_py()])
        place = table.column("before")[0].as_py() + np.arange(table.num_rows)
        return pa.table({"record": table.column("record").take(pa.array(order)), "place": pa.array(place)})

    return run


def _scattered(work: Workspace, docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Each record once, as (record, scatter, bucket)."""
    rows = docs.select(F.struct("*").alias("record")).withColumn("digest", F.xxhash64("record"))
    repeated = work.write(rows.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    copies = F.lit(0).cast("long")
    if repeated.isEmpty():
        every = rows.withColumn("copy", copies)
    else:
        # Equal records become one with a count, and copies of that again, a thousand a task's row.
        counted = rows.join(repeated, "digest", "left_semi").groupBy("record", "digest").count()
        parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count"), F.lit(COPIES).cast("long")))).where("part < count").repartition("digest", "part")
        again = parts.withColumn("copy", F.explode(F.sequence("part", F.least(F.col("part") + COPIES, F.col("count")) - 1)))
        every = rows.join(repeated, "digest", "left_anti").withColumn("copy", copies).unionByName(again.select("record", "digest", "copy"))
    hashed = every.select("record", F.xxhash64(F.lit(seed), "digest", "copy").alias("scatter"))
    return hashed.withColumn("bucket", F.pmod(F.xxhash64("scatter"), F.lit(buckets)))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 40, text: str = "text", seed: int = SEED, bucket: int = 0) -> DataFrame:
    """Writes all records of `docs` in random order into shards 0 to `shards` - 1
    under `path` and returns them as read back: record (a struct of all columns),
    shard, slot (from 0 without gaps).

    Row counts of shards differ by one at most; of fewer records than shards the
    last shards are empty.  Null and empty texts are records like others,
    repeated rows are shuffled one by one, and columns of any name stay inside
    `record`.  Columns of the types map and variant can't be hashed.
    """
    work = Workspace(spark, "scatter")
    total = docs.agg(F.sum(record_size(F.col(text))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, -(-(total.bytes or 0) // (bucket or BUCKET)))
    rows = _scattered(work, docs, buckets, seed)
    # One row a bucket: the window is over as many rows as there are buckets.
    counts = work.write(rows.groupBy("bucket").count(), "counts")
    before = counts.select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets // 4, TASKS))
    dealt = rows.repartition(tasks, "bucket").join(before, "bucket")
    kind = T.StructType([T.StructField("record", rows.schema["record"].dataType), T.StructField("place", T.LongType())])
    with bounded_batches(spark):
        mixed = dealt.groupBy("bucket").applyInArrow(_shuffled(seed), kind)
        least, more = divmod(total.rows, shards)
        wide, place = more * (least + 1), F.col("place")
        # The first `more` shards have one row more.
        shard = F.when(place < wide, F.floor(place / (least + 1))).otherwise(more + F.floor((place - wide) / max(least, 1)))
        mixed = mixed.withColumn("shard", shard.cast("int"))
        slot = place - F.col("shard") * least - F.least(F.col("shard"), F.lit(more))
        mixed.select("record", "shard", slot.alias("slot")).sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return read_shards(spark, path, docs)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """(record, shard, slot) of what write_shards has written of a table like `like`."""
    kind = like.select(F.struct("*").alias("record")).schema["record"].dataType.simpleString()
    return spark.read.schema(f"record {kind}, slot bigint, shard int").parquet(path).select("record", "shard", "slot")
