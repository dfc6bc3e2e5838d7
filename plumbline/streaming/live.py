"""Structured Streaming: token chunks, run progress, live scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.session import shared_path

DELAY = "10 minutes"
UNNAMED_ERROR = "error"

# Percentiles of a window, and how many ranks their sketch tells apart.
PROGRESS_SHARES = (("latency_p50", 0.5), ("latency_p95", 0.95), ("latency_p99", 0.99))
RANKS = 1_000

# State of streams with timers is kept by this store.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_metrics(
    chunks: DataFrame, *, delay: str = DELAY, gap: str | None = None, with_text: bool = True
) -> DataFrame:
    """Metrics of each request from its chunk log; works on batches and streams.

    ``chunks``: ``request_id, ts, seq, kind`` (dispatch, chunk, usage, error),
    ``content``, ``prompt_tokens``, ``completion_tokens``. A request is its
    chunks, however far apart: one row per ``request_id``. A stream without a
    ``gap`` is read in update mode (``drain_updates``): each row replaces the
    one before, and open requests are there with what is known of them.

    A stream that never ends may give a ``gap``: a request is then over, and
    its state dropped, when nothing arrives for so long; chunks later than
    ``delay`` are dropped, and a request that pauses for longer than the gap is
    split. Choose it above the longest wait for a first token.

    First-token time is that of the first chunk with content; the last usage
    counts; a failed request has no text. The text is the one thing gathered per
    request, because it is one value of the result; without it, the state of a
    request has a fixed size however many chunks arrive.
    """
    kind = F.col("kind")
    has_content = (kind == "chunk") & (F.length("content") > 0)
    pieces = F.array_sort(F.collect_list(F.when(has_content, F.struct("seq", "content"))))
    usage = F.max_by(
        F.struct("prompt_tokens", "completion_tokens"), F.when(kind == "usage", F.col("ts"))
    )
    if gap is None:
        requests = chunks.groupBy("request_id")
    else:
        requests = chunks.withWatermark("ts", delay).groupBy("request_id", F.session_window("ts", gap))
    grouped = (
        requests.agg(
            F.coalesce(F.min(F.when(kind == "dispatch", F.col("ts"))), F.min("ts")).alias("start_ts"),
            F.min(F.when(has_content, F.col("ts"))).alias("_first"),
            F.max("ts").alias("end_ts"),
            usage.alias("_usage"),
            F.max(F.when(kind == "error", F.coalesce("content", F.lit(UNNAMED_ERROR)))).alias("error"),
            *([pieces.alias("_pieces")] if with_text else []),
        )
    )
    start = F.unix_micros("start_ts")
    text = F.array_join(F.transform("_pieces", lambda p: p.content), "")
    told = F.when(F.col("error").isNull(), text).otherwise("").alias("text")
    return grouped.select(
        "request_id",
        "start_ts",
        ((F.unix_micros("_first") - start) / 1e6).alias("ttft_seconds"),
        ((F.unix_micros("end_ts") - start) / 1e6).alias("total_latency_seconds"),
        F.coalesce("_usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("_usage.completion_tokens", F.lit(0)).alias("completion_tokens"),
        *([told] if with_text else []),
        "error",
    )


def progress(
    requests: DataFrame, *by: str, width: str = "1 hour", delay: str = DELAY, accuracy: int = RANKS
) -> DataFrame:
    """Finished and failed requests, mean and percentiles of latency per time window.

    Percentiles come from a mergeable sketch, the state of a window: each is a
    latency of the window whose rank differs from the asked one by at most
    n / ``accuracy``, so it is exact in windows of up to ``accuracy`` requests.
    """
    shares = [share for _, share in PROGRESS_SHARES]
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *by)
        .agg(
            F.count("*").alias("num_finished"),
            F.count_if(F.col("error").isNotNull()).alias("num_failed"),
            F.avg("total_latency_seconds").alias("latency_mean"),
            F.percentile_approx("total_latency_seconds", shares, accuracy).alias("_shares"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            *by,
            "num_finished",
            "num_failed",
            "latency_mean",
            *[F.get("_shares", F.lit(i)).alias(name) for i, (name, _) in enumerate(PROGRESS_SHARES)],
        )
    )


def score_live(
    responses: DataFrame,
    samples: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("suite", "sample_id"),
) -> DataFrame:
    """Score responses as they arrive against the static sample table.

    The scorers are the batch ones: they work within a row and keep no state.
    """
    return score(responses.join(samples, list(keys), "left"))


def drain(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Process what is available, into a table of the shared folder; read it back."""
    path = shared_path(spark, label)
    store = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    # A running query keeps the settings it was started with.
    spark.conf.set(_STORE, store)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def drain_updates(stream: DataFrame, spark: SparkSession, label: str, keys: list[str]) -> DataFrame:
    """Process what is available of an aggregation in update mode; its last rows.

    Every batch appends the groups it changed, with its number; the newest row
    of a group counts. Nothing waits for a watermark, so groups that are still
    open are part of the result. A batch that is repeated after a failure
    writes the same rows again under the same number.
    """
    path = shared_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{path}/data")

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rest = [c for c in stream.columns if c not in keys]
    newest = spark.read.schema(schema).parquet(f"{path}/data").groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_batch").alias("_row")
    )
    return newest.select(*keys, "_row.*").select(*stream.columns)
