"""Requests that end in a stream: over batches, with timeouts, late chunks and an empty state."""

import datetime as dt

from plumbline.session import shared_path
from plumbline.streaming import live, requests
from pyspark.sql import functions as F

CHUNKS = (
    "request_id string, ts timestamp, seq int, kind string, content string, prompt_tokens bigint, completion_tokens bigint"
)
START = dt.datetime(2024, 1, 1)


def row(name, second, seq, kind, content=None, prompt=None, completion=None):
    return name, START + dt.timedelta(seconds=second), seq, kind, content, prompt, completion


def run(spark, batches, **options):
    """Ended requests of one file a batch, and the state rows that are left."""
    path = shared_path(spark, "test-chunk-files")
    for rows in batches:
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(path)
    ended = requests.ended_requests(stream, **options)
    out = shared_path(spark, "test-ended")
    store = spark.conf.get(live._STORE)
    spark.conf.set(live._STORE, live._ROCKSDB)
    query = (
        ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.conf.set(live._STORE, store)
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return {r.request_id: r for r in spark.read.schema(ended.schema).parquet(out).collect()}, state


def test_requests_end_by_their_own_chunks(spark):
    whole = [row("a", 0, 0, "dispatch"), row("a", 1, 1, "chunk", ""), row("a", 3, 2, "chunk", "x"), row("a", 4, 3, "usage", None, 5, 6)]
    first = [
        *whole,
        row("b", 0, 0, "dispatch"), row("b", 2, 2, "chunk", "lo"), row("b", 1, 1, "chunk", "hel"),
        row("c", 0, 0, "dispatch"), row("c", 7, 1, "chunk", "part"),
        row("d", 0, 0, "dispatch"),
        row("e", 0, 0, "dispatch"), row("e", 1, 1, "chunk", "y"),
    ]
    second = [
        row("b", 9, 3, "chunk", "!"), row("b", 10, 4, "usage", None, 1, 2),
        row("e", 12, 2, "error"),
        row("a", 11, 4, "chunk", "late"), row("f", 5, 1, "chunk", "?"), row("f", 6, 2, "usage", None, 9, 9),
    ]
    clock = [row(None, 100_000, None, "clock")]
    got, state = run(spark, [first, second, clock], timeout="10 minutes")
    # Request a has ended, so its late chunk is a row of its own.
    batch = {r.request_id: r for r in live.request_metrics(spark.createDataFrame([*whole, *first[4:], *second[:3]], CHUNKS)).collect()}
    outcomes = {k: r.outcome for k, r in got.items() if k != "a"}
    assert outcomes == {"b": "done", "c": "timeout", "d": "timeout", "e": "error", "f": "late"}
    for name in ("b", "e"):
        assert {c: got[name][c] for c in batch[name].__fields__} == batch[name].asDict()
    assert (got["c"].error, got["c"].text, got["c"].ttft_seconds, got["c"].total_latency_seconds) == ("no response", "", 7.0, 7.0)
    assert (got["d"].error, got["d"].ttft_seconds, got["f"].num_chunks, got["f"].start_ts) == ("no response", None, 2, None)
    assert state == 0


def test_a_hot_request_and_one_that_never_ends(spark):
    """One request with most chunks; with text left out its state stays one row."""
    rows = [row("hot", 0, 0, "dispatch"), *(row("hot", i, i, "chunk", "x") for i in range(1, 2000)), row("open", 0, 0, "dispatch")]
    got, state = run(spark, [rows, [row("hot", 2000, 2000, "usage", None, 1, 2)]], with_text=False)
    assert {k: (r.outcome, r.ttft_seconds, r.total_latency_seconds) for k, r in got.items()} == {"hot": ("done", 1.0, 2000.0)}
    # What is left: the open request, the time its share wakes, and the timer.
    assert state == 3


def test_percentiles_of_windows_within_their_ranks(spark):
    rows = spark.range(20_000).select(
        (F.lit(START.isoformat()).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 3600)).alias("ts"),
        F.lit("x").alias("kind"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("total_latency_seconds"),
        F.lit(None).cast("string").alias("error"),
    )
    values = sorted(r[0] for r in rows.select("total_latency_seconds").collect())
    for accuracy in (50, 1000):
        got = live.progress(rows, "kind", accuracy=accuracy).collect()
        assert len(got) == 1 and got[0].num_finished == 20_000
        for name, share in live.PROGRESS_SHARES:
            value = got[0][name]
            low, high = values.index(value), 20_000 - 1 - values[::-1].index(value)
            off = max(low - share * 20_000, share * 20_000 - 1 - high, 0)
            assert off <= 20_000 / accuracy
