"""Column expressions for run statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def pass_at_k(attempts: Column, passed: Column, k: int) -> Column:
    """Chance that one of ``k`` draws without return passes.

    The failure chance is written as k factors, (n-c-j)/(n-j) for j < k, so
    its cost depends on k only, never on the number of attempts of a task.
    """
    n, c = attempts.cast("double"), passed.cast("double")
    failures = reduce(
        lambda product, j: product * (n - c - j) / (n - j),
        range(k),
        F.lit(1.0),
    )
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - failures)


def ci_half_width(score: Column) -> Column:
    """Half of the 95 % interval of a mean; 0 for a single score."""
    spread = F.coalesce(F.stddev_samp(score), F.lit(0.0))
    return Z_95 * spread / F.sqrt(F.count(score))
