"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(
    table: DataFrame, *kept: str | Column, array: str | Column, item: str = "item", pos: str = "pos"
) -> DataFrame:
    """One row per array element with its 0-based position; empty arrays vanish.

    For the plain form of explode the optimizer adds a filter on the size of
    the array and pushes it to the scan, where a computed array is then
    computed a second time. The outer form with a filter on the position
    behind it computes the array once.
    """
    rows = table.select(*kept, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
