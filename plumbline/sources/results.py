"""Result files: export form, partitioned writer, reader of result documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.operators.quality import interval_columns
from plumbline.operators.rows import exploded
from plumbline.sources import documents

# Fields of an exported sample's metrics, layout of a document.
METRIC_FIELDS = (
    "ttft_seconds",
    "total_latency_seconds",
    "prompt_tokens",
    "completion_tokens",
    "tokens_per_second_generation",
)
STAMP = "yyyyMMdd'T'HHmmss'Z'"
_METRICS = (
    "struct<ttft_seconds:double,total_latency_seconds:double,prompt_tokens:bigint,"
    "completion_tokens:bigint,tokens_per_second_generation:double>"
)
SAMPLE = (
    "id:string,correct:boolean,score:double,predicted:string,expected:string,"
    f"details:string,metrics:{_METRICS}"
)
AGGREGATES = (
    "struct<ttft_p50:double,ttft_p95:double,ttft_p99:double,ttft_mean:double,"
    "generation_tps_mean:double,generation_tps_p50:double,prompt_tps_mean:double,"
    "latency_p50:double,latency_p95:double,latency_p99:double,latency_mean:double,"
    "total_prompt_tokens:bigint,total_completion_tokens:bigint,total_requests:bigint,"
    "failed_requests:bigint,wall_time_seconds:double,effective_throughput_rps:double>"
)
AGGREGATE_FIELDS = re.findall(r"(\w+):", AGGREGATES)
CONFIG = (
    "struct<base_url:string,concurrency:int,streaming:boolean,temperature:double,"
    "max_tokens:bigint,seed:bigint>"
)
DOCUMENT = (
    f"benchmark string, model string, timestamp string, config {CONFIG}, name string, "
    f"num_samples bigint, accuracy double, score double, aggregated_metrics {AGGREGATES}, "
    f"sample_results array<struct<{SAMPLE}>>"
)


def model_key(model: Column) -> Column:
    """Model name safe for a path."""
    return F.translate(model, "/\\", "__")


def run_stamp(moment: Column) -> Column:
    return F.date_format(moment, STAMP)


def result_name(suite: Column, model: Column, stamp: Column) -> Column:
    """``{suite}_{model}_{stamp}.json`` with slashes replaced."""
    return model_key(F.concat_ws("_", suite, model, F.concat(stamp, F.lit(".json"))))


def export_sample(results: DataFrame, details: Sequence[str] = ()) -> DataFrame:
    """Add ``exported``: the JSON object of a sample result.

    Empty details and missing metrics are left out; inside present metrics,
    NULL fields are kept.
    """
    metrics = F.to_json(F.struct(*METRIC_FIELDS), {"ignoreNullFields": "false"})
    present = F.coalesce(*[F.col(f).cast("string") for f in METRIC_FIELDS]).isNotNull()
    core = F.to_json(F.struct("id", "correct", "score", "predicted", "expected"))
    parts = [F.regexp_replace(core, r"\}\z", "")]
    if details:
        listed = F.to_json(F.struct(*details))
        parts.append(
            F.when(listed != "{}", F.concat(F.lit(',"details":'), listed)).otherwise("")
        )
    parts.append(F.when(present, F.concat(F.lit(',"metrics":'), metrics)).otherwise(""))
    return results.withColumn("exported", F.concat(*parts, F.lit("}")))


def sample_results(
    scored: DataFrame, *, model: str, run_id: str | None = None, details: Sequence[str] = ()
) -> DataFrame:
    """Scored rows in the common layout of all suites.

    Without ``run_id`` the rows' own one is kept.

    ``details`` names the suite's own columns; they become one JSON text.
    ``metrics`` is NULL for rows without any metric.
    """
    present = [f for f in METRIC_FIELDS if f in scored.columns]
    measured = F.coalesce(*[F.col(f).cast("string") for f in present], F.lit(None)).isNotNull()
    metrics = F.struct(*[F.col(f) if f in present else F.lit(None).alias(f) for f in METRIC_FIELDS])
    return scored.select(
        (F.col("run_id") if run_id is None else F.lit(run_id)).alias("run_id"),
        "suite",
        F.lit(model).alias("model"),
        "sample_id",
        "correct",
        "score",
        "predicted",
        "expected",
        (F.to_json(F.struct(*details)) if details else F.lit("{}")).alias("details"),
        F.when(measured, metrics.cast(_METRICS)).alias("metrics"),
    )


def write_results(results: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Write sample results, one folder per suite, model and run.

    Rows go to disk from the tasks that hold them; nothing is gathered into
    one document. A run that is written again replaces its folder, and no other.
    """
    keys = ["suite", "model_key", *(["run_id"] if "run_id" in results.columns else [])]
    keyed = results.withColumn("model_key", model_key(F.col("model")))
    writer = keyed.write.partitionBy(*keys).mode("overwrite").format(format)
    writer.option("partitionOverwriteMode", "dynamic").save(path)


def run_documents(
    summaries: DataFrame, *, stamp: Column, config: dict[str, Column] | None = None
) -> DataFrame:
    """Result documents without samples, one row per run.

    ``summaries`` has ``suite, model, num_samples, accuracy, score`` and any of
    the aggregate columns. Written as JSON, NULL fields vanish.
    """
    known = [f for f in summaries.columns if f in AGGREGATE_FIELDS]
    settings = [value.alias(name) for name, value in (config or {}).items()]
    return summaries.select(
        F.col("suite").alias("benchmark"),
        "model",
        stamp.alias("timestamp"),
        *([F.struct(*settings).alias("config")] if settings else []),
        F.col("suite").alias("name"),
        "num_samples",
        "accuracy",
        "score",
        F.struct(*known).alias("aggregated_metrics"),
    )


def write_run_documents(summaries: DataFrame, path: str) -> None:
    """Write run summaries, one JSON object per line, without their samples."""
    summaries.write.mode("append").json(path)


def read_results(
    spark: SparkSession, paths: str | Sequence[str], *, multi_line: bool = True, parts: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result documents as (runs, sample results, unreadable files).

    A file that cannot be read is reported in the third table and does not
    stop the others. ``multi_line`` reads one document per file, in byte ranges,
    however large; without it, one document per line. With ``parts`` a document
    is a folder of ``write_documents``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if multi_line or parts:
        return _read_split(spark, paths, parts)
    texts = spark.read.text(paths).withColumn("file", F.col("_metadata.file_path"))
    # Validity is judged on the whole text: a reader that is asked for some
    # columns only would not notice a fault elsewhere in the document.
    readable = jsontext.is_json(F.trim("value"))
    good = texts.filter(readable).select("file", F.from_json("value", DOCUMENT).alias("d"))
    good = good.select("file", "d.*")
    runs = good.drop("sample_results")
    samples = exploded(
        good,
        F.col("benchmark").alias("suite"),
        "model",
        "timestamp",
        "file",
        array="sample_results",
        item="s",
    ).select("suite", "model", "timestamp", "file", "s.*")
    bad = texts.filter(~readable).select("file", F.col("value").alias("content"))
    return runs, samples, bad


def _read_split(spark: SparkSession, paths: list[str], parts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``read_results`` of documents of any size; the content of a bad one is that without samples."""
    found, items = documents.read_split(spark, paths, parts=parts)
    found = found.withColumnRenamed("doc", "file")
    read = found.filter("valid").select("file", F.from_json("text", DOCUMENT).alias("d")).select("file", "d.*")
    runs = read.drop("sample_results")
    named = runs.select("file", F.col("benchmark").alias("suite"), "model", "timestamp")
    parsed = items.select(F.col("doc").alias("file"), F.from_json("text", f"struct<{SAMPLE}>").alias("s"))
    samples = parsed.join(named, "file").select("suite", "model", "timestamp", "file", "s.*")
    return runs, samples, found.filter(~F.col("valid")).select("file", F.col("text").alias("content"))


def runs_from_documents(runs: DataFrame, *more: str) -> DataFrame:
    """Flat run summaries (suite, model, quality, aggregates) for comparison."""
    return runs.select(
        *more,
        F.col("benchmark").alias("suite"),
        "model",
        "timestamp",
        "num_samples",
        "accuracy",
        "score",
        "aggregated_metrics.*",
    )


def summaries_from_documents(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Run summaries with the interval of the stored samples; NULL for a run without samples.

    One row per file, whatever files say of themselves.
    """
    judged = samples.select("file", F.coalesce("correct", F.lit(False)).alias("correct"))
    intervals = judged.groupBy("file").agg(*interval_columns()).select("file", "ci_lo", "ci_hi")
    flat = runs_from_documents(runs, "file")
    return flat.join(intervals, "file", "left")
