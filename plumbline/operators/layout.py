"""How rows lie in partitions before expensive work within rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

# Rows of a task of expensive work, so that no task grows with the table.
TASK_ROWS = 50_000


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share, and no task much more than ``TASK_ROWS`` rows.

    Scoring works within rows, so a source of few splits would use few cores, and
    one of few bytes a row would have splits of very many rows. A source with
    enough splits for its rows is returned as it is: no shuffle is added.
    ``keys`` should be unique, so that shares are even. The rows are counted, which
    for a stored table reads no columns.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, ceil(table.count() / TASK_ROWS))
    if table.rdd.getNumPartitions() >= tasks:
        return table
    return table.repartition(tasks, *keys)
