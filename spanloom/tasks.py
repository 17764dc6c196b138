"""Tasks whose memory doesn't follow the input.

Shuffle partitions are a fixed number, and small ones are joined up to a
compressed size; how many rows that is depends on the data.  A number of tasks
that follows the rows is kept as it is, and steps on the same keys need no other shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: rows that one task sorts or hashes
TASK_ROWS = 500_000


def tasks_for(spark, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for a number of rows; few for small tables."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 10_000), -(-rows // task_rows))


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as ``count`` rows need."""
    return rows.repartition(tasks_for(rows.sparkSession, count), *keys)


def join(left: DataFrame, right: DataFrame, keys: list[str], how: str, count: int) -> DataFrame:
    """Sort-merge join of two large tables over as many tasks as ``count`` rows need; nothing is sent to the driver."""
    return spread(left, count, *keys).hint("merge").join(spread(right, count, *keys), keys, how)
