"""Run-level quality: accuracy, score, intervals, pass@k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats


def run_quality(
    results: DataFrame, by: Sequence[str] = (), runs: DataFrame | None = None
) -> DataFrame:
    """Samples, accuracy and mean score per run; 0 for a run without samples.

    ``runs`` names runs that must appear even when they have no sample.
    """
    totals = results.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        F.count_if("correct").alias("num_correct"),
        F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"),
    )
    if runs is None:
        return totals
    kept = runs.select(*by).distinct().join(totals, list(by), "left")
    return kept.fillna(0, ["num_samples", "num_correct"]).fillna(0.0, ["accuracy", "score"])


def with_interval(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, accuracy and the 95 % interval of the accuracy."""
    return results.groupBy(*by).agg(*interval_columns())


def interval_columns() -> list[Column]:
    """Aggregates of ``with_interval``, to be combined with others in one pass."""
    correct = F.col("correct").cast("double")
    half = stats.ci_half_width(correct)
    return [
        F.count("*").alias("num_samples"),
        F.avg(correct).alias("accuracy"),
        (F.avg(correct) - half).alias("ci_lo"),
        (F.avg(correct) + half).alias("ci_hi"),
    ]


def quality_rollup(results: DataFrame, subject: str) -> DataFrame:
    """Quality per value of ``subject`` and, with ``subject`` NULL, overall.

    Rows with a NULL subject are a group of their own; ``overall`` tells the
    two apart.
    """
    # One row per subject first: the roll-up doubles those rows, not the results.
    per_subject = results.groupBy(subject).agg(
        F.count("*").alias("_n"), F.count_if("correct").alias("_c"), F.sum("score").alias("_s")
    )
    return per_subject.rollup(subject).agg(
        F.sum("_n").alias("num_samples"),
        (F.sum("_c") / F.sum("_n")).alias("accuracy"),
        (F.sum("_s") / F.sum("_n")).alias("score"),
        F.grouping(subject).cast("boolean").alias("overall"),
    )


def pass_at_k(
    attempts: DataFrame,
    ks: Sequence[int],
    task: str = "task_id",
    by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """pass@k per task and its mean per run, from one row per attempt."""
    tasks = attempts.groupBy(*by, task).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("c")
    )
    per_task = tasks.withColumns(
        {f"pass_at_{k}": stats.pass_at_k(F.col("n"), F.col("c"), k) for k in ks}
    )
    per_run = per_task.groupBy(*by).agg(
        F.count("*").alias("num_tasks"),
        *[F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks],
    )
    return per_task, per_run


def results_by_tier(results: DataFrame, suites: DataFrame) -> DataFrame:
    """Quality per tier. Results shrink to one row per suite before they meet the catalog."""
    per_suite = results.groupBy("suite").agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("c"),
        F.sum("score").alias("s"),
    )
    tiers = per_suite.join(suites.select("suite", "tier"), "suite", "left")
    return tiers.groupBy("tier").agg(
        F.count("*").alias("num_suites"),
        F.sum("n").alias("num_samples"),
        (F.sum("c") / F.sum("n")).alias("accuracy"),
        (F.sum("s") / F.sum("n")).alias("score"),
    )
