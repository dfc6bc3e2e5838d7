"""Input logs: what the model endpoint, the sandbox and the test runner left.

Schemas are explicit, so reading never scans data to guess types, and column
pruning and filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TOOL_CALLS = "array<struct<name:string,arguments:string>>"

# Columns of each log.
SCHEMAS = {
    "responses": (
        "run_id string, suite string, sample_id string, response string, "
        f"tool_calls {_TOOL_CALLS}, error string"
    ),
    "requests": (
        "run_id string, suite string, model string, sample_id string, request_id string, "
        "start_ts timestamp, ttft_seconds double, total_latency_seconds double, "
        "prompt_tokens bigint, completion_tokens bigint, error string, streamed boolean"
    ),
    "chunks": (
        "request_id string, ts timestamp, seq bigint, kind string, content string, "
        "prompt_tokens bigint, completion_tokens bigint"
    ),
    "turns": (
        "run_id string, suite string, sample_id string, turn int, role string, response string, "
        f"tool_calls {_TOOL_CALLS}, exit_code int, error string"
    ),
    "program_runs": "run_id string, sample_id string, exit_code int, output string",
    "test_verdicts": (
        "run_id string, suite string, sample_id string, kind string, pos int, test_id string, "
        "passed boolean"
    ),
}


def read_log(spark: SparkSession, log: str, path: str, format: str = "parquet") -> DataFrame:
    """A log as a DataFrame; columns the files lack are NULL."""
    return spark.read.schema(SCHEMAS[log]).format(format).load(path)


def stream_log(spark: SparkSession, log: str, path: str, format: str = "parquet") -> DataFrame:
    """A log as a stream of the files that arrive below ``path``."""
    return spark.readStream.schema(SCHEMAS[log]).format(format).load(path)
