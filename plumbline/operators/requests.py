"""Per-request rates and per-run request statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derived_rates(requests: DataFrame) -> DataFrame:
    """Add prefill and decode time and the two token rates.

    Only requests that were streamed and succeeded have them. A first-token
    time of 0 counts as absent.
    """
    if "streamed" not in requests.columns:
        requests = requests.withColumn("streamed", F.lit(True))
    usable = F.col("streamed") & F.col("error").isNull()
    ttft, total = F.col("ttft_seconds"), F.col("total_latency_seconds")
    seen = usable & (ttft > 0)
    return requests.withColumn("prefill_time_seconds", F.when(usable, ttft)).withColumn(
        "decode_time_seconds", F.when(seen & (total > ttft), total - ttft)
    ).withColumns(
        {
            "tokens_per_second_generation": F.when(
                F.col("completion_tokens") > 1,
                (F.col("completion_tokens") - 1) / F.col("decode_time_seconds"),
            ),
            "tokens_per_second_prompt": F.when(
                seen & (F.col("prompt_tokens") > 0),
                F.col("prompt_tokens") / F.nullif(ttft, F.lit(0.0)),
            ),
        }
    )


def _ok(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("error").isNull(), column)


def request_summary(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, token totals and means. Failed requests count, but only as failed."""
    return requests.groupBy(*by).agg(*summary_columns())


def summary_columns() -> list[Column]:
    """Aggregates of ``request_summary``, to be combined with others in one pass."""
    return [
        F.count("*").alias("total_requests"),
        F.count_if(F.col("error").isNotNull()).alias("failed_requests"),
        F.coalesce(F.sum(_ok("prompt_tokens")), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum(_ok("completion_tokens")), F.lit(0)).alias("total_completion_tokens"),
        F.avg(_ok("ttft_seconds")).alias("ttft_mean"),
        F.avg(_ok("tokens_per_second_generation")).alias("generation_tps_mean"),
        F.avg(_ok("tokens_per_second_prompt")).alias("prompt_tps_mean"),
        F.avg(_ok("total_latency_seconds")).alias("latency_mean"),
    ]


def throughput(requests: DataFrame, by: Sequence[str] = (), start: str = "start_ts") -> DataFrame:
    """Successful requests per second of wall time; NULL without wall time.

    Wall time runs from the first start to the last end in the log.
    """
    return requests.groupBy(*by).agg(*throughput_columns(start))


def throughput_columns(start: str = "start_ts") -> list[Column]:
    """Aggregates of ``throughput``, to be combined with others in one pass."""
    began = F.unix_micros(start) / 1e6
    successes = F.count_if(F.col("error").isNull())
    wall = F.max(began + F.col("total_latency_seconds")) - F.min(began)
    rate = F.when(wall > 0, successes / F.nullif(wall, F.lit(0.0)))
    return [
        successes.alias("successful_requests"),
        wall.alias("wall_time_seconds"),
        rate.alias("effective_throughput_rps"),
    ]


# Reported shares per measure (output prefix, input column).
PERCENTILES = {
    "ttft": ("ttft_seconds", (50, 95, 99)),
    "generation_tps": ("tokens_per_second_generation", (50,)),
    "latency": ("total_latency_seconds", (50, 95, 99)),
}


def last_turn_metrics(turns: DataFrame, metrics: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Metrics of the last turn that carries any, one row per conversation."""
    latest = F.max_by(F.struct(*metrics), F.col("turn"))
    return turns.groupBy(key).agg(F.max("turn").alias("last_turn"), latest.alias("m")).select(
        key, "last_turn", "m.*"
    )
