"""Exact percentiles of groups of any size.

The built-in ``percentile`` keeps a map of all distinct values of a group in
one task. Here a mergeable sketch gives a few borders near every wanted rank;
they cut a group into buckets. Buckets are counted exactly, so the bucket that
holds a rank is known for certain, and only the values of those buckets are
put in order. A border that is far off makes a bucket larger, never a result
wrong. The method is the same for every size and stores nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relative rank error of the sketch is 1 / ACCURACY.
ACCURACY = 50_000


def exact_percentiles(
    table: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[str, Sequence[int]]],
    *,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with columns ``{prefix}_p{share}``.

    ``wanted`` maps an output prefix to (input column, percent shares). NULL
    values are ignored; a measure without values gives NULL. NULL is a group.
    """
    by = list(by)
    pairs = [x for prefix, (column, _) in wanted.items() for x in (F.lit(prefix), F.col(column))]
    pairs = [p.cast("double") if i % 2 else p for i, p in enumerate(pairs)]
    long = table.select(
        *by, F.stack(F.lit(len(wanted)), *pairs).alias("_measure", "_value")
    )
    shares = sorted({s for _, marks in wanted.values() for s in marks})
    keys = [*by, "_measure"]

    # Group sizes, and a border on either side of every wanted rank.
    margin = 4 / accuracy
    marks = [b for s in shares for b in (max(s / 100 - margin, 0.0), min(s / 100 + margin, 1.0))]
    sketch = long.groupBy(*keys).agg(
        F.count("_value").alias("_n"),
        F.percentile_approx("_value", marks, accuracy).alias("_borders"),
    )

    # Exact counts per value, then per bucket. A value equal to a border lies
    # below it, so ties never straddle buckets.
    borders = [F.get("_borders", F.lit(i)) for i in range(len(marks))]
    bucket = reduce(lambda a, b: a + b, [(F.col("_value") > b).cast("int") for b in borders])
    values = null_safe_join(long.filter(F.col("_value").isNotNull()), sketch, keys)
    counts = (
        values.withColumn("_bucket", bucket)
        .groupBy(*keys, "_n", "_bucket", "_value")
        .agg(F.count("*").alias("_count"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        counts.groupBy(*keys, "_n", "_bucket")
        .agg(F.sum("_count").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    ranks = [r for s in shares for r in (F.floor(_position(s)), F.ceil(_position(s)))]
    holds = reduce(
        lambda a, b: a | b,
        [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")) for r in ranks],
    )
    needed = sizes.filter(holds).select(*keys, "_bucket", "_before")

    # Only the values of needed buckets are ordered, bucket by bucket.
    ordered = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    picked = null_safe_join(counts, needed, [*keys, "_bucket"]).withColumn(
        "_reached", F.col("_before") + F.sum("_count").over(ordered)
    )
    outputs = [
        _interpolated(prefix, share).alias(f"{prefix}_p{share}")
        for prefix, (_, own) in wanted.items()
        for share in own
    ]
    result = picked.groupBy(*by).agg(*outputs)
    if not by:
        return result
    # Groups without any value keep their row; the sketch knows all groups.
    groups = sketch.select(*by).distinct()
    return null_safe_join(groups, result, by, "left")


def _position(share: int) -> Column:
    return (F.col("_n") - 1) * F.lit(share / 100)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL group keys meet each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _interpolated(prefix: str, share: int) -> Column:
    mine = F.col("_measure") == prefix
    position = _position(share)
    low, high = (
        F.min(F.when(mine & (F.col("_reached") > rank), F.col("_value")))
        for rank in (F.floor(position), F.ceil(position))
    )
    weight = F.max(F.when(mine, position - F.floor(position)))
    # Measured from the nearer end, which keeps the last digit of the result.
    return F.when(weight < 0.5, low + (high - low) * weight).otherwise(
        high - (high - low) * (1 - weight)
    )


def approx_percentiles(
    table: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[str, Sequence[int]]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One-pass estimate with the same output columns, on request."""
    outputs = [
        F.percentile_approx(column, share / 100, accuracy).alias(f"{prefix}_p{share}")
        for prefix, (column, marks) in wanted.items()
        for share in marks
    ]
    return table.groupBy(*by).agg(*outputs)
