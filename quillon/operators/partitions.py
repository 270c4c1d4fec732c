"""How rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *by: str, tasks: int = 0) -> DataFrame:
    """Rows by the hash of `by` over as many tasks as the session has shuffle partitions, `tasks` at least.

    A shuffle without a number is coalesced by adaptive execution to little more
    than a task per core, as compressed sizes go, so that its sorts grow with the
    input; a number that is asked for stays.  Where `tasks` follows the rows, what
    a task holds doesn't grow at all.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), *by)


def tasks_for(table: DataFrame, each: int) -> int:
    """Tasks of `each` rows for a table; files of columns are counted by their footers."""
    return -(-table.count() // each)
