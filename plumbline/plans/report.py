"""All statistics of runs in one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import percentiles, quality, requests
from plumbline.session import shared_path

MEASURES = (
    "correct",
    "score",
    "error",
    "start_ts",
    "ttft_seconds",
    "total_latency_seconds",
    "prompt_tokens",
    "completion_tokens",
    "tokens_per_second_generation",
    "tokens_per_second_prompt",
)


def run_report(results: DataFrame, by: Sequence[str] = ("suite", "model")) -> DataFrame:
    """Quality, interval, request totals, means, percentiles and throughput per run.

    ``results`` are scored samples joined with their request metrics. Their
    narrow columns are stored once, because percentiles take two more passes:
    these then read a few columns instead of scoring and joining again.
    Everything that is a plain aggregate is computed in a single pass.
    """
    by = list(by)
    spark = results.sparkSession
    narrow = results.select(*by, *MEASURES)
    path = shared_path(spark, "report")
    narrow.write.parquet(path)
    stored = spark.read.schema(narrow.schema).parquet(path)

    totals = stored.groupBy(*by).agg(
        *quality.interval_columns(),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"),
        *requests.summary_columns(),
        *requests.throughput_columns(),
    )
    succeeded = stored.filter(F.col("error").isNull())
    shares = percentiles.exact_percentiles(succeeded, by, requests.PERCENTILES)
    if not by:
        # Two tables of one row each; the percentiles have none without values.
        one = F.lit(1).alias("_one")
        return totals.select("*", one).join(shares.select("*", one), "_one", "left").drop("_one")
    return percentiles.null_safe_join(totals, shares, by, "left")
