"""Row numbers without a single-task sort and without a job of the driver.

``row_number() OVER (ORDER BY key)`` moves the whole table into one task.
Here borders cut the key range into buckets of similar size, rows are numbered
inside their bucket, and each bucket starts where the earlier ones end. Borders
and starts are subqueries of one lazy plan: building it runs nothing.

Which keys become borders is decided by their hash, so borders do not depend on
how often or in what order the plan is evaluated; a poor border costs time, never
a position.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys sampled for each border, and the range of hashes they are chosen by.
SAMPLED = 20
_HASHES = 1 << 30


def with_ordinal(table: DataFrame, key: str, name: str = "ordinal", rows_per_bucket: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of the unique ``key``.

    A NULL key comes first. See ``with_position`` for ``rows_per_bucket``.
    """
    return with_position(table, [], key, name, rows_per_bucket)


def with_position(
    table: DataFrame, by: list[str], key: str, name: str = "position", rows_per_bucket: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row of a group ``by`` in the order of ``key``.

    Keys are unique within a group. There are as many buckets as shuffle
    partitions, cut across groups, so a group with most rows is spread over
    most of them. With ``rows_per_bucket`` their number follows the rows
    instead; one in ``rows_per_bucket / SAMPLED`` keys must then fit one value.
    """
    spark = table.sparkSession
    place = F.struct(*by, key) if by else F.col(key)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows_per_bucket is None:
        total = table.agg(F.count("*").alias("n")).scalar()
        share = F.lit(float(SAMPLED * buckets)) / F.greatest(total, F.lit(1))
    else:
        share = F.lit(SAMPLED / rows_per_bucket)
    step = ceil(buckets**0.5)
    chosen = table.filter(place.isNotNull() & (F.pmod(F.xxhash64(place), F.lit(_HASHES)) < share * _HASHES))
    keys = chosen.agg(F.sort_array(F.collect_list(place)).alias("keys"))
    listed = keys.select(F.filter("keys", lambda k, i: i % SAMPLED == SAMPLED - 1).alias("borders"))
    both = listed.select(F.struct("borders", F.filter("borders", lambda k, i: i % step == step - 1).alias("firsts")).alias("b"))
    # A column of its own: lambdas may not hold a subquery.
    bordered = table.withColumn("_b", both.scalar())
    placed = bordered.withColumn("_bucket", _bucket_of(place, F.col("_b"), step)).drop("_b")

    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)],
        F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
    )
    same = F.col("_bucket") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    # One row a bucket: bounded by the number of buckets.
    joined = placed.join(starts if by else F.broadcast(starts), same)
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key)).cast("bigint") - 1
    return joined.select(*table.columns, (F.col("_start") + within).alias(name))


def _bucket_of(place: Column, borders: Column, step: int) -> Column:
    """Number of borders at or below ``place``; -1 for NULL. Searched in two steps."""
    coarse = F.size(F.filter(borders["firsts"], lambda b: b <= place)) * step
    part = F.slice(borders["borders"], coarse + 1, step)
    found = coarse + F.size(F.filter(part, lambda b: b <= place))
    return F.when(place.isNull(), -1).otherwise(found)


def numbered(table: DataFrame, key: str, n: int | None, name: str = "ordinal") -> DataFrame:
    """``table`` with positions by ``key``; its first ``n`` rows (None and 0: all)."""
    if not n:
        return with_ordinal(table, key, name)
    order = Window.partitionBy(F.lit(0)).orderBy(key)
    rows = first_rows(table, key, n)
    return rows.withColumn(name, F.row_number().over(order).cast("bigint") - 1)


def first_rows(table: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``key``; None and 0 both mean all rows.

    Every task keeps ``n`` rows at most; nothing is numbered or sorted whole.
    """
    return table.orderBy(key).limit(n) if n else table
