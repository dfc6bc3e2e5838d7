"""Sets and multisets in long form, suites judged by logs of one's own."""

import random
from collections import Counter

import pytest
from plumbline.operators import multisets
from plumbline.plans import logged
from plumbline.plans.report import run_report
from pyspark.sql import functions as F


def sides(spark, seed):
    r = random.Random(seed)
    rows = lambda n: [(r.choice(["big"] * 8 + ["a", "b", None]), r.choice([None, 1, 2, 3, 4, 5]), [r.choice("xy")]) for _ in range(n)]
    said = rows(400)
    wanted = [x for x in said if x[0] != "big"] + rows(5)
    schema = "sample_id string, n int, args array<string>"
    r.shuffle(wanted)
    return said, wanted, spark.createDataFrame(said, schema), spark.createDataFrame(wanted, schema)


def test_multisets_and_sets_equal_counters(spark):
    said, wanted, left, right = sides(spark, 1)
    left = left.unionByName(spark.sql("select 'same' sample_id, 1 n, array('x') args union all select 'same', 1, array('x')"))
    right = right.unionByName(spark.sql("select 'same' sample_id, 1 n, array('x') args"))
    said, wanted = [*said, ("same", 1, ["x"]), ("same", 1, ["x"])], [*wanted, ("same", 1, ["x"])]
    count = lambda rows, key: Counter((n, tuple(a)) for k, n, a in rows if k == key)
    for r in multisets.match_multisets(left, right, ["n", "args"]).collect():
        s, w = count(said, r.sample_id), count(wanted, r.sample_id)
        assert (r.correct, r.num_predicted, r.num_expected, r.num_matched) == (s == w, s.total(), w.total(), (s & w).total())
    for r in multisets.match_sets(left, right, ["n", "args"]).collect():
        s, w = set(count(said, r.sample_id)), set(count(wanted, r.sample_id))
        assert (r.correct, r.num_predicted, r.num_expected) == (s == w, len(s), len(w))
        assert r.score == pytest.approx(len(s & w) / len(s | w))


def test_samples_without_items(spark):
    nothing = spark.createDataFrame([], "sample_id string, item string")
    samples = spark.createDataFrame([("a",), ("a",), ("b",)], "sample_id string")
    some = spark.createDataFrame([("b", "x")], "sample_id string, item string")
    sets = {r.sample_id: (r.correct, r.score) for r in multisets.match_sets(some, nothing, ["item"], samples=samples).collect()}
    assert sets == {"a": (True, 1.0), "b": (False, 0.0)}
    lists = {r.sample_id: (r.correct, r.num_matched) for r in multisets.match_multisets(nothing, nothing, ["item"], samples=samples).collect()}
    assert lists == {"a": (True, 0), "b": (True, 0)}
    assert multisets.match_sets(nothing, nothing, ["item"]).count() == 0


def test_no_sample_is_gathered(spark):
    """Items are counted before the shuffle; no list of a sample is made."""
    _, _, left, right = sides(spark, 2)
    plan = multisets.match_multisets(left, right, ["n", "args"])._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "partial_sum" in plan


def test_registered_suites_are_scored_by_their_logs(spark):
    suite = logged.get_logged_suite("tau_bench")
    samples = spark.createDataFrame([("s", "[]"), ("t", "[]"), ("u", "[]")], "sample_id string, expected_actions string")
    turns = spark.createDataFrame(
        [("s", 0, 0.25, 7), ("s", 1, 0.5, 9), ("s", 2, None, None), ("t", 0, None, None)],
        "sample_id string, turn int, ttft_seconds double, prompt_tokens bigint",
    ).withColumn("tool_calls", F.array().cast("array<struct<name:string,arguments:string>>"))
    rows = {r.sample_id: r for r in logged.score_logged(suite, samples, {"turns": turns}).collect()}
    assert {k: (r.correct, r.error, r.ttft_seconds, r.prompt_tokens) for k, r in rows.items()} == {
        "s": (True, None, 0.5, 9), "t": (True, None, None, None), "u": (False, "no response", None, None)}
    full = turns.withColumns({m: F.lit(None).cast("timestamp" if m == "start_ts" else "double") for m in logged.MEASURES if m not in turns.columns})
    scored = logged.score_logged(suite, samples, {"turns": full}).withColumn("suite", F.lit("tau_bench"))
    report = run_report(scored, ["suite"]).first()
    assert (report.num_samples, report.failed_requests, report.ttft_mean, report.total_prompt_tokens) == (3, 1, 0.5, 9)
    with pytest.raises(ValueError, match="judged by the logs turns"):
        logged.score_logged(suite, samples, {"checks": turns})
    with pytest.raises(KeyError, match="terminal_bench"):
        logged.get_logged_suite("nope")
