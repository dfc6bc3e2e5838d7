import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import pairing, prompts, scoring
from plumbline.plans import compare
from plumbline.plans.suites import get_suite, run_summary, score_suite
from plumbline.sources import adapters, catalog, results


def prompt_of(row):
    return row.messages[0].content


def test_choice_prompt_cuts_extra_choices(spark):
    data = spark.sql("select 5 k, 'Q' question, array('a','b','c','d','e') choices, 2 answer")
    row = adapters.choice4_samples(data, "k").first()
    assert (row.sample_id, row.expected, row.subject) == ("mmlu_0", "C", "unknown")
    assert prompt_of(row) == "Q\n\nA. a\nB. b\nC. c\nD. d\n\nAnswer with the letter only."
    bare = data.withColumn("choices", F.array().cast("array<string>"))
    assert prompt_of(adapters.choice4_samples(bare, "k").first()) == "Q\n\n\nAnswer with the letter only."


def test_limit_comes_before_the_image_filter(spark):
    data = spark.sql(
        "select id k, concat('q', id) question, 'x' answer, 'exact' question_type, "
        "if(id % 2 = 0, 'img', null) image from range(10)"
    )
    rows = adapters.mixed_samples(data, "k", max_samples=4).orderBy("ordinal").collect()
    assert [r.sample_id for r in rows] == ["hle_1", "hle_3"]
    assert prompt_of(rows[0]) == "q1\n\nProvide a concise answer."
    assert adapters.mixed_samples(data.drop("image"), "k", max_samples=0).count() == 10


def test_long_context_choices(spark):
    data = spark.sql("select 1 k, 'C' context, 'Q' question, array('x','y') choices, 'A' answer")
    row = adapters.long_context_samples(data, "k").first()
    assert prompt_of(row) == "C\n\nQuestion: Q\n\nA. x\nB. y\n\nAnswer with the letter only."
    none = adapters.long_context_samples(data.drop("choices"), "k").first()
    assert prompt_of(none) == "C\n\nQuestion: Q\n\nAnswer with the letter only."
    five = data.withColumn("choices", F.array(*map(F.lit, "abcde")))
    with pytest.raises(PySparkException, match="at most 4 choices"):
        adapters.long_context_samples(five, "k").collect()


def test_present_but_null_columns_do_not_fall_through(spark):
    data = spark.sql("select 1 k, cast(null as string) prompt, 'Q' question, 7 answer, 'other' expected")
    row = adapters.set_samples(data, "k").first()
    assert prompt_of(row) is None and row.expected == "7"
    other = adapters.set_samples(data.drop("prompt", "answer"), "k").first()
    assert prompt_of(other) == "Q" and other.expected == "other"


def test_retrieval_messages(spark):
    data = spark.sql(
        "select 1 k, array(struct('user' role, 'hi' content)) messages, 'p' prompt, 'a' answer "
        "union all select 2, array(), 'p', 'a' union all select 3, array(), '', 'a'"
    )
    rows = adapters.retrieval_samples(data, "k").orderBy("ordinal").collect()
    assert [[m.content for m in r.messages] for r in rows] == [["hi"], ["p"], []]
    assert rows[0].context_length == 0


def test_test_lists(spark):
    data = spark.sql(
        """select 1 k, '["a","b"]' FAIL_TO_PASS, 'broken' PASS_TO_PASS, 'fix' problem_statement"""
    )
    rows = adapters.patch_samples(data, "k", suite="swe_bench_pro")
    assert rows.first().sample_id == "swe_pro_0"
    tests = [(t.kind, t.pos, t.test_id) for t in adapters.tests_long(rows).collect()]
    assert tests == [("f2p", 0, "a"), ("f2p", 1, "b")]


def test_tools(spark):
    data = spark.sql("""select '[{"name":"f"},{"type":"function","function":{}},3]' t union all select 'no'""")
    plain = data.select(prompts.tool_envelopes(F.col("t")).alias("t")).collect()
    typed = data.select(prompts.tool_envelopes(F.col("t"), keep_typed=True).alias("t")).collect()
    wrapped = '{"type":"function","function":{"name":"f"}}'
    assert plain[0].t[0] == wrapped and len(plain[0].t) == 2 and plain[1].t == []
    assert typed[0].t == [wrapped, '{"function":{},"type":"function"}']


def test_system_prompt_and_request(spark):
    data = spark.sql(
        "select 'mmlu' suite, array(struct('user' role, 'q' content)) messages "
        "union all select 'multi_if', array(struct('system' role, 's' content))"
    )
    joined = data.join(catalog.suites(spark), "suite", "left")
    rows = joined.select(
        "suite", prompts.with_system(F.col("messages"), F.col("system_prompt")).alias("m")
    ).orderBy("suite").collect()
    assert [m.role for m in rows[0].m] == ["system", "user"] and [m.content for m in rows[1].m] == ["s"]
    bodies = prompts.request_bodies(
        data, catalog.suites(spark), model="m", max_tokens=99, temperature=0.0
    ).orderBy("suite").collect()
    parsed = [json.loads(b.body) for b in bodies]
    assert [p["max_tokens"] for p in parsed] == [32, 99]
    assert parsed[0]["temperature"] == 0.0 and "seed" not in parsed[0]
    tools = data.withColumn("tools", F.array(F.lit('{"a":1}')))
    body = prompts.request_bodies(tools, catalog.suites(spark), model="m", max_tokens=9).first().body
    assert json.loads(body)["tools"] == [{"a": 1}]


def test_failure_paths(spark):
    samples = spark.sql(
        "select 'mmlu' suite, concat('mmlu_', id) sample_id, 'B' expected, 's' subject, array() messages from range(4)"
    )
    responses = spark.createDataFrame(
        [("mmlu", "mmlu_0", "The answer is B", None), ("mmlu", "mmlu_1", "", "timeout"), ("mmlu", "mmlu_2", "C", None),
         ("mmlu", "stray", "B", None)],
        "suite string, sample_id string, response string, error string",
    )
    scored = score_suite(get_suite("mmlu"), samples, responses)
    got = {r.sample_id: (r.correct, r.score, r.predicted, r.expected, r.error) for r in scored.collect()}
    assert got == {
        "mmlu_0": (True, 1.0, "B", "B", None),
        "mmlu_1": (False, 0.0, "", "B", "timeout"),
        "mmlu_2": (False, 0.0, "C", "B", None),
        "mmlu_3": (False, 0.0, "", "", pairing.NO_RESPONSE),
    }
    overall = run_summary(get_suite("mmlu"), scored).filter("overall").first()
    assert (overall.num_samples, overall.accuracy) == (4, 0.25)
    doubled = responses.unionByName(responses.limit(1))
    assert pairing.repeated_responses(doubled, ["suite", "sample_id"]).first().num_responses == 2
    with pytest.raises(KeyError, match="hle"):
        get_suite("nope")


@pytest.mark.parametrize("name", ["hle", "graphwalks", "mrcr", "ifeval", "bfcl", "mmlu_pro", "longbench_v2"])
def test_every_suite_scores_end_to_end(spark, name):
    rows = spark.sql(
        """select 1 k, 'Q' question, 'P' prompt, 'multiple_choice' question_type, array('a','b') choices,
        array('a','b') options, 'c' context, case when '%s' in ('bfcl') then '{"name":"f"}' else 'B' end answer,
        array('punctuation:no_comma') instruction_id_list, array('{}') kwargs""" % name
    )
    suite = get_suite(name)
    samples = suite.to_samples(rows, "k")
    said = "f()" if name == "bfcl" else "B"
    responses = samples.select("suite", "sample_id", F.lit(said).alias("response"))
    row = score_suite(suite, samples, responses).first()
    assert row.correct is True and row.score == 1.0 and row.error is None


def test_mixed_scores(spark):
    data = spark.createDataFrame(
        [
            ("exact", " Paris ", "paris"), ("exact", "It is Paris.", "PARIS"), ("exact", "Rome", "Paris"),
            ("multiple_choice", "(B)", "b"), (None, "x B", "B"),
        ],
        "question_type string, response string, expected string",
    )
    got = [(r.correct, r.predicted) for r in scoring.score_mixed(data).collect()]
    assert got == [(True, "Paris"), (True, "It is Paris."), (False, "Rome"), (True, "B"), (True, "x B")]


def test_result_files(spark, tmp_path):
    document = {
        "benchmark": "mmlu", "model": "org/m", "timestamp": "20260101T000000Z", "name": "mmlu",
        "config": {"base_url": "x", "concurrency": 8, "streaming": True, "temperature": 0.0, "max_tokens": 9, "seed": None},
        "num_samples": 2, "accuracy": 0.5, "score": 0.5,
        "aggregated_metrics": {"ttft_mean": 0.25, "total_requests": 2},
        "sample_results": [
            {"id": "mmlu_0", "correct": True, "score": 1.0, "predicted": "B", "expected": "B", "details": {"subject": "s"}},
            {"id": "mmlu_1", "correct": False, "score": 0.0, "predicted": "A", "expected": "B",
             "metrics": {"ttft_seconds": 0.1, "total_latency_seconds": 0.2, "prompt_tokens": 3, "completion_tokens": 4,
                         "tokens_per_second_generation": None}},
        ],
    }
    (tmp_path / "good.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "bad.json").write_text('{"benchmark": "mmlu", ')
    runs, samples, bad = results.read_results(spark, [str(tmp_path / "good.json"), str(tmp_path / "bad.json")])
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    flat = results.runs_from_documents(runs).first()
    assert (flat.suite, flat.model, flat.ttft_mean, flat.latency_p95) == ("mmlu", "org/m", 0.25, None)
    rows = {r.id: r for r in samples.collect()}
    assert rows["mmlu_0"].details == '{"subject":"s"}' and rows["mmlu_1"].metrics.completion_tokens == 4


def test_exported_samples(spark):
    data = spark.sql(
        "select 'x' id, true correct, 1.0D score, 'B' predicted, 'B' expected, 'algebra' subject, 0.1D ttft_seconds, "
        "cast(null as double) total_latency_seconds, 3 prompt_tokens, 4 completion_tokens, "
        "cast(null as double) tokens_per_second_generation "
        "union all select 'y', false, 0.0D, '', 'C', null, null, null, null, null, null"
    )
    rows = {r.id: json.loads(r.exported) for r in results.export_sample(data, ["subject"]).collect()}
    assert rows["x"]["metrics"] == {
        "ttft_seconds": 0.1, "total_latency_seconds": None, "prompt_tokens": 3, "completion_tokens": 4,
        "tokens_per_second_generation": None,
    }
    assert rows["x"]["details"] == {"subject": "algebra"}
    assert set(rows["y"]) == {"id", "correct", "score", "predicted", "expected"}


def test_names_and_partitions(spark, tmp_path):
    data = spark.sql("select 'mmlu' suite, 'org/m\\\\x' model, timestamp'2026-02-20 12:00:00' ts, 1 id")
    name = results.result_name(F.col("suite"), F.col("model"), results.run_stamp(F.col("ts")))
    assert data.select(name.alias("n")).first().n == "mmlu_org_m_x_20260220T120000Z.json"
    results.write_results(data, str(tmp_path / "out"))
    assert (tmp_path / "out" / "suite=mmlu" / "model_key=org_m_x").is_dir()


def test_comparison(spark):
    data = spark.createDataFrame(
        [("r1", 10, 0.12345, 0.5, 0.1, 0.2, 0.30005), ("r2", 4, 1.0, None, None, None, None), ("r3", 1, 1.0, None, None, None, None)],
        "label string, num_samples bigint, accuracy double, score double, ci_lo double, ci_hi double, ttft_mean double",
    )
    rows = {r.metric: (r.r1, r.r2) for r in compare.compare_runs(data, ["r1", "r2"]).collect()}
    assert rows["Accuracy"] == (f"{0.12345:.4f}", "1.0000") and rows["Samples"] == ("10", "4")
    assert rows["Score"] == ("0.5000", "0.0000") and rows["95% CI"] == ("[0.1000, 0.2000]", "N/A")
    assert rows["TTFT Mean (s)"] == (f"{0.30005:.4f}", "N/A") and rows["Latency P95 (s)"] == ("N/A", "N/A")
    unscored = compare.compare_runs(data, ["r2", "r3"])
    assert "Score" not in {r.metric for r in unscored.collect()}


def test_a_large_document_is_read_whole(spark, tmp_path):
    """Above the size limit of a VARIANT: neither unreadable nor without samples."""
    sample = '{"id":"%d","correct":true,"score":1.0,"predicted":"' + "x" * 1_000_000 + '","expected":"y"}'
    body = ",".join(sample % i for i in range(140))
    text = '{"benchmark":"mmlu","model":"m","num_samples":140,"sample_results":[' + body + "]}"
    (tmp_path / "large.json").write_text(text)
    (tmp_path / "bad.json").write_text(text[:-1])
    runs, samples, bad = results.read_results(spark, str(tmp_path))
    assert [r.num_samples for r in runs.select("num_samples").collect()] == [140]
    assert samples.select("suite").count() == 140
    assert [r.file.rsplit("/")[-1] for r in bad.select("file").collect()] == ["bad.json"]
