import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import percentiles, quality, requests
from plumbline.operators.ordinals import first_rows, numbered, with_ordinal, with_position


@pytest.mark.parametrize("rows_per_bucket", [10_000, 100, 7, 3])
def test_ordinals_in_buckets(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.permutation(10 ** 6)[:500]]
    # Most keys lie close together, as a skewed key range would.
    keys = [k if i % 5 else k * 10 ** 6 for i, k in enumerate(keys)]
    data = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.ordinal for r in with_ordinal(data, "k", rows_per_bucket=rows_per_bucket).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_ordinals_of_many_borders(spark):
    data = spark.range(2_000).select((F.col("id") * 3).alias("k"))
    rows = with_ordinal(data, "k", rows_per_bucket=10).filter(F.col("ordinal") != F.col("k") / 3)
    assert rows.count() == 0


def test_first_rows(spark):
    data = spark.range(10)
    assert [first_rows(data, "id", n).count() for n in (None, 0, 4)] == [10, 10, 4]


def _samples(spark):
    rng = np.random.default_rng(7)
    values = {
        "wide": rng.lognormal(size=4_000),
        "ties": np.repeat([0.2, 0.2, 0.2, 0.7], 500),
        "hot": np.concatenate([np.full(3_000, 1.5), rng.normal(size=500)]),
        "tiny": np.array([3.0]),
        "pair": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v), float(v) * 2 if g != "tiny" else None) for g, vs in values.items() for v in vs]
    rows += [(None, 5.0, 10.0), (None, 7.0, 14.0), ("nothing", None, None)]
    values[None] = np.array([5.0, 7.0])
    return spark.createDataFrame(rows, "g string, v double, w double"), values


@pytest.mark.parametrize("accuracy", [50_000, 500, 20])
def test_exact_percentiles_equal_numpy(spark, accuracy):
    data, values = _samples(spark)
    shares = (1, 50, 95, 99)
    wanted = {"v": ("v", shares), "w": ("w", (50,))}
    got = percentiles.exact_percentiles(data, ["g"], wanted, accuracy=accuracy)
    rows = {r.g: r for r in got.collect()}
    assert set(rows) == {*values, "nothing"}
    assert rows["nothing"].v_p50 is None and rows["tiny"].w_p50 is None
    for group, vs in values.items():
        for share in shares:
            assert math.isclose(rows[group][f"v_p{share}"], np.percentile(vs, share), abs_tol=1e-12)
        if group != "tiny":
            assert math.isclose(rows[group].w_p50, 2 * np.percentile(vs, 50), abs_tol=1e-12)


def test_percentiles_without_groups(spark):
    data = spark.range(1_001).select(F.col("id").cast("double").alias("v"))
    got = percentiles.exact_percentiles(data, [], {"v": ("v", (50, 99))}, accuracy=100)
    assert got.first().asDict() == {"v_p50": 500.0, "v_p99": 990.0}
    rough = percentiles.approx_percentiles(data, [], {"v": ("v", (50,))})
    assert abs(rough.first().v_p50 - 500) <= 1


def brute_pass_at_k(n, c, k):
    if n - c < k:
        return 1.0
    return 1.0 - float(np.prod([1.0 - k / i for i in range(n - c + 1, n + 1)]))


def test_pass_at_k(spark):
    cases = [(n, c) for n in range(1, 13) for c in range(n + 1)]
    data = spark.createDataFrame(cases, "n int, c int")
    for k in (1, 2, 5, 10):
        got = data.select("n", "c", stats.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect()
        assert all(math.isclose(r.p, brute_pass_at_k(r.n, r.c, k), abs_tol=1e-12) for r in got)
    known = spark.createDataFrame([(10, 10, 1.0), (10, 0, 0.0), (10, 5, 0.5)], "n int, c int, p double")
    rows = known.select("p", stats.pass_at_k(F.col("n"), F.col("c"), 1).alias("q")).collect()
    assert all(math.isclose(r.p, r.q) for r in rows)


def test_interval(spark):
    data = spark.createDataFrame(
        [("many", c) for c in (True, True, False, True, False)] + [("one", True)], "run string, correct boolean"
    )
    rows = {r.run: r for r in quality.with_interval(data, ["run"]).collect()}
    scores = np.array([1, 1, 0, 1, 0], dtype=float)
    half = 1.96 * scores.std(ddof=1) / math.sqrt(5)
    assert math.isclose(rows["many"].ci_lo, 0.6 - half) and math.isclose(rows["many"].ci_hi, 0.6 + half)
    assert (rows["one"].ci_lo, rows["one"].ci_hi) == (1.0, 1.0)


def test_empty_runs_count_as_zero(spark):
    results = spark.createDataFrame([("a", True, 1.0)], "run string, correct boolean, score double")
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    rows = {r.run: r.asDict() for r in quality.run_quality(results, ["run"], runs).collect()}
    assert rows["b"] == {"run": "b", "num_samples": 0, "num_correct": 0, "accuracy": 0.0, "score": 0.0}
    overall = quality.run_quality(results.filter("false")).first()
    assert (overall.num_samples, overall.accuracy, overall.score) == (0, 0.0, 0.0)


REQUEST = (
    "ttft_seconds double, total_latency_seconds double, prompt_tokens bigint, completion_tokens bigint, "
    "error string, streamed boolean"
)


def test_derived_rates(spark):
    data = spark.createDataFrame(
        [
            (0.1, 1.0, 100, 50, None, True),
            (0.0, 1.0, 100, 50, None, True),
            (0.1, 1.0, 0, 1, None, True),
            (0.1, 0.1, 5, 5, None, True),
            (0.1, 1.0, 100, 50, "timeout", True),
            (None, 1.0, 100, 50, None, False),
        ],
        REQUEST,
    )
    rows = requests.derived_rates(data).collect()
    first = rows[0]
    assert math.isclose(first.decode_time_seconds, 0.9)
    assert math.isclose(first.tokens_per_second_generation, 49 / 0.9)
    assert math.isclose(first.tokens_per_second_prompt, 100 / 0.1)
    assert rows[1].prefill_time_seconds == 0.0 and rows[1].decode_time_seconds is None
    assert rows[2].tokens_per_second_generation is None and rows[2].tokens_per_second_prompt is None
    assert rows[3].decode_time_seconds is None and rows[3].tokens_per_second_prompt == 50.0
    for row in rows[4:]:
        assert row.prefill_time_seconds is None and row.tokens_per_second_generation is None


def test_request_summary(spark):
    data = spark.createDataFrame(
        [
            (0.1, 0.5, 100, 50, None, True),
            (0.2, 1.0, 200, 100, None, True),
            (None, 9.0, 7, 7, "timeout", True),
        ],
        REQUEST,
    )
    row = requests.request_summary(requests.derived_rates(data)).first()
    assert (row.total_requests, row.failed_requests) == (3, 1)
    assert (row.total_prompt_tokens, row.total_completion_tokens) == (300, 150)
    assert math.isclose(row.ttft_mean, 0.15) and math.isclose(row.latency_mean, 0.75)
    failed = requests.request_summary(requests.derived_rates(data.filter("error is not null"))).first()
    assert failed.total_prompt_tokens == 0 and failed.latency_mean is None


def test_throughput(spark):
    data = spark.sql(
        "select timestamp'2024-01-01 00:00:00' start_ts, 0.5D total_latency_seconds, cast(null as string) error "
        "union all select timestamp'2024-01-01 00:00:01', 0.5D, null "
        "union all select timestamp'2024-01-01 00:00:00', 0.1D, 'x'"
    )
    row = requests.throughput(data).first()
    assert math.isclose(row.wall_time_seconds, 1.5) and math.isclose(row.effective_throughput_rps, 2 / 1.5)
    still = data.withColumn("total_latency_seconds", F.lit(0.0)).limit(1)
    assert requests.throughput(still).first().effective_throughput_rps is None


def test_tiers(spark):
    results = spark.createDataFrame(
        [("mmlu", True, 1.0), ("mmlu", False, 0.0), ("hle", True, 1.0), ("mrcr", False, 0.25)],
        "suite string, correct boolean, score double",
    )
    from plumbline.sources import catalog

    rows = {r.tier: r for r in quality.results_by_tier(results, catalog.suites(spark)).collect()}
    assert (rows[1].num_suites, rows[1].num_samples, round(rows[1].accuracy, 6)) == (2, 3, 0.666667)
    assert rows[2].score == 0.25
    assert len(catalog.suite_names()) == 14 and catalog.suites(spark).first().suite == "bfcl"
    assert catalog.require_suite("hle") == "hle"
    with pytest.raises(KeyError, match="mmlu_pro"):
        catalog.require_suite("nope")


@pytest.mark.parametrize("size", [3, 2_000, 2_001, 5_000])
def test_ordinals_of_strings_with_null(spark, size):
    keys = [None, *(f"é{i % 7}-{i}" for i in range(size - 1))]
    data = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.ordinal for r in with_ordinal(data, "k", rows_per_bucket=50).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda k: (k is not None, k or "")))}


def test_ordinals_are_one_lazy_plan(spark):
    """Nothing runs while the plan is built; first rows are taken, not numbered."""
    data = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    rows = with_ordinal(data, "k")
    some = numbered(data, "k", 5)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("running", "running")
    assert [(r.k, r.ordinal) for r in some.orderBy("ordinal").collect()] == [(k, k) for k in range(5)]
    assert rows.filter(F.col("k") < F.col("ordinal")).count() == 0 and rows.agg(F.max("ordinal")).first()[0] == 999
    assert "TakeOrderedAndProject" in some._jdf.queryExecution().executedPlan().toString()


def test_positions_within_groups(spark):
    """A group of most rows is spread over buckets; NULL is a group like any other."""
    groups = ["big"] * 900 + ["a", None, None, "z"]
    data = spark.createDataFrame([(g, i * 7919 % 1009, i) for i, g in enumerate(groups)], "g string, k bigint, kept int")
    for rows_per_bucket in (None, 40):
        got = with_position(data.repartition(5), ["g"], "k", rows_per_bucket=rows_per_bucket).collect()
        keys = {}
        for i, g in enumerate(groups):
            keys.setdefault(g, []).append(i * 7919 % 1009)
        want = {(g, k): n for g, ks in keys.items() for n, k in enumerate(sorted(ks))}
        assert len(got) == len(groups) and {(r.g, r.k): r.position for r in got} == want
        assert data.columns == got[0].__fields__[:3]
