"""Sets and multisets in long form, of any size per sample.

Items are rows. What the two sides of a sample have is counted per item before
the shuffle and again behind it, so a sample that holds most of all items is
spread over its items, and one row per sample is what leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rows import exploded


def _sides(said: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Items of both sides with how often each side has them. NULL is an item like any other."""
    both = said.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_w")).unionByName(
        wanted.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_w"))
    )
    return both.groupBy(*columns).agg(F.sum("_s").alias("_said"), F.sum("_w").alias("_wanted"))


def _of_samples(found: DataFrame, samples: DataFrame | None, key: list[str], empty: dict) -> DataFrame:
    """``found`` for every sample; samples without items on either side have ``empty``."""
    if samples is None:
        return found
    return samples.select(*key).distinct().join(found, key, "left").fillna(empty)


def match_multisets(
    said: DataFrame,
    wanted: DataFrame,
    items: Sequence[str],
    key: Sequence[str] = ("sample_id",),
    samples: DataFrame | None = None,
) -> DataFrame:
    """Per sample: ``correct`` (equal as multisets), the sizes, and ``num_matched``.

    Without ``samples``, those with an item on some side.
    """
    key = list(key)
    counts = _sides(said, wanted, [*key, *items])
    found = counts.groupBy(*key).agg(
        F.bool_and(F.col("_said") == F.col("_wanted")).alias("correct"),
        F.sum("_said").alias("num_predicted"),
        F.sum("_wanted").alias("num_expected"),
        F.sum(F.least("_said", "_wanted")).alias("num_matched"),
    )
    empty = {"correct": True, "num_predicted": 0, "num_expected": 0, "num_matched": 0}
    return _of_samples(found, samples, key, empty)


def match_sets(
    said: DataFrame,
    wanted: DataFrame,
    items: Sequence[str],
    key: Sequence[str] = ("sample_id",),
    samples: DataFrame | None = None,
) -> DataFrame:
    """Per sample: ``correct`` (equal as sets), ``score`` (their Jaccard overlap) and the sizes.

    Two empty sets are equal and overlap fully. Repeated items count once.
    """
    key = list(key)
    flags = _sides(said, wanted, [*key, *items])
    has = {"num_predicted": F.col("_said") > 0, "num_expected": F.col("_wanted") > 0}
    found = flags.groupBy(*key).agg(
        *(F.count_if(flag).alias(name) for name, flag in has.items()),
        F.count_if((F.col("_said") > 0) & (F.col("_wanted") > 0)).alias("_shared"),
        F.count("*").alias("_union"),
    )
    found = found.select(
        *key,
        (F.col("_shared") == F.col("_union")).alias("correct"),
        (F.col("_shared") / F.col("_union")).alias("score"),
        *has,
    )
    return _of_samples(found, samples, key, {"correct": True, "score": 1.0, "num_predicted": 0, "num_expected": 0})


def items_long(table: DataFrame, key: Sequence[str], array: str, item: str = "item") -> DataFrame:
    """One row per item of an array column; empty arrays have none."""
    return exploded(table, *key, array=array, item=item).select(*key, item)
