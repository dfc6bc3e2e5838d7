"""One key with a third of all rows: same results, and the work is split."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calls, pairing, percentiles, verdicts
from plumbline.operators.turns import visible_history

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def hot(n=30_000):
    """Key 'hot' for every third row, else one of many."""
    return F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))


def test_pairing_splits_a_hot_sample(skewed):
    rows = skewed.range(0, 30_000, 1, 8).select(
        F.lit("s").alias("suite"), hot().alias("sample_id"), F.sha2(F.col("id").cast("string"), 256).alias("response")
    )
    names = [("s", "hot"), ("s", "unanswered")] + [("s", f"k{i}") for i in range(500)]
    samples = skewed.createDataFrame(names, "suite string, sample_id string").repartition(4)
    paired = pairing.pair_responses(samples, rows)
    got = {r.sample_id: r.n for r in paired.groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    assert got["hot"] == 10_000 and got["unanswered"] == 1 and sum(got.values()) == 30_001
    matched = paired.filter("paired")
    matched.collect()
    assert "skew=true" in matched._jdf.queryExecution().executedPlan().toString()


def test_hot_conversation(skewed):
    turns = skewed.range(0, 30_000, 1, 8).select(
        hot().alias("sample_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("ab").alias("content")
    )
    got = visible_history(turns, block=64).filter("sample_id = 'hot'")
    wrong = got.filter((F.col("num_messages") != F.col("turn") / 3 + 1) | (F.col("num_chars") != 2 * F.col("num_messages")))
    assert got.count() == 10_000 and wrong.count() == 0


def test_hot_group_percentiles(skewed):
    values = skewed.range(0, 30_000, 1, 8).select(
        hot().alias("g"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v")
    )
    exact = percentiles.exact_percentiles(values, ["g"], {"v": ("v", (50, 95))}, accuracy=1_000)
    plain = values.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b"))
    both = exact.join(plain, "g")
    assert both.count() == 501
    assert both.filter((F.abs(F.col("v_p50") - F.col("a")) > 1e-9) | (F.abs(F.col("v_p95") - F.col("b")) > 1e-9)).count() == 0


def test_hot_sample_of_verdicts_and_actions(skewed):
    log = skewed.range(0, 30_000, 1, 8).select(
        hot().alias("sample_id"), F.lit("p2p").alias("kind"), F.col("id").alias("pos"), (F.col("id") < 15_000).alias("passed")
    )
    first = verdicts.first_tests(log, ["pos"])
    assert first.filter("sample_id = 'hot'").agg(F.max("pos")).first()[0] == 27
    assert first.groupBy("sample_id").count().filter("count > 10").count() == 0

    long = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(5_000)), lambda i: F.struct(F.concat(F.lit("a"), i).alias("name"))))
    samples = skewed.range(1).select(F.lit("hot").alias("sample_id"), long.alias("expected_actions"))
    made = F.transform(
        F.sequence(F.lit(1), F.lit(5_000)), lambda i: F.struct(F.concat(F.lit("a"), i).alias("name"), F.lit("{}").alias("arguments"))
    )
    turns = skewed.range(1).select(F.lit("hot").alias("sample_id"), F.lit(0).alias("turn"), made.alias("tool_calls"))
    row = calls.score_actions(samples, turns).first()
    assert (row.correct, row.num_actions) == (True, 5_000)
