"""Plans that join samples with several logs."""

import json

from pyspark.sql import functions as F

from plumbline.operators import calls, instructions
from plumbline.plans import logged
from plumbline.plans.suites import get_suite, score_suite
from plumbline.sources import logs, results

F3 = "```"


def test_code(spark):
    samples = spark.sql("select 's' sample_id, 'def f():' prompt, 'T' test, 'f' entry_point")
    responses = spark.sql("select 's' sample_id, ' pass' response")
    runs = spark.sql("select 's' sample_id, 0 exit_code, 'ok' output")
    row = logged.score_code(samples, responses, runs).first()
    assert (row.correct, row.predicted, row.output) == (True, "pass", "ok")


def test_conversations(spark):
    samples = spark.sql(
        "select 's' sample_id, array('p','q') turns, array(array('punctuation:no_comma')) instruction_id_list, "
        "array(array('{}')) kwargs"
    )
    turns = spark.createDataFrame([("s", 0, "a, b"), ("s", 1, "last")], "sample_id string, turn int, response string")
    row = logged.score_conversations(samples, turns).first()
    assert (row.correct, row.num_turns, row.num_turns_passed, row.predicted) == (False, 2, 1, "last")


def test_agents(spark):
    samples = spark.sql("""select 's' sample_id, '[{"name":"a"}]' expected_actions""")
    turns = spark.createDataFrame([("s", 0, [("a", "{}")])], f"sample_id string, turn int, tool_calls {calls.TOOL_CALLS}")
    assert logged.score_agents(samples, turns).first().correct is True


def test_shell(spark):
    samples = spark.sql("select 's' sample_id, 'v' validation union all select 't', ''")
    turns = spark.createDataFrame(
        [("s", 0, "$ ls", 0), ("s", 1, "bye", 0)], "sample_id string, turn int, response string, exit_code int"
    )
    checks = spark.sql("select 's' sample_id, 0 exit_code")
    rows = {r.sample_id: r for r in logged.score_shell(samples, turns, checks).collect()}
    assert (rows["s"].correct, rows["s"].num_turns, rows["s"].predicted) == (True, 2, "bye")
    assert (rows["t"].correct, rows["t"].num_turns, rows["t"].error) == (False, 0, "no response")
    told = turns.withColumn("output", F.lit("file")).filter("turn = 0")
    row = logged.score_shell(samples, told, checks).filter("sample_id = 's'").first()
    assert row.predicted == "Exit code: 0\nOutput:\nfile"


def test_patches(spark):
    samples = spark.sql("select concat('s', id) sample_id from range(3)")
    responses = spark.createDataFrame(
        [("s0", f"{F3}diff\n+a\n{F3}"), ("s1", "no patch")], "sample_id string, response string"
    )
    tests = spark.createDataFrame(
        [(s, "f2p", 0, True) for s in ("s0", "s1", "s2")], "sample_id string, kind string, pos int, passed boolean"
    )
    rows = {r.sample_id: r for r in logged.score_patches(samples, responses, tests).collect()}
    assert [rows[f"s{i}"].correct for i in range(3)] == [True, False, False]
    assert rows["s0"].predicted == "+a" and rows["s1"].predicted == "no patch" and rows["s1"].error


def test_rule_items(spark):
    items = [
        ([{"instruction_id": "punctuation:no_comma"}], [True]),
        ([{"instruction_id_list": ["punctuation:no_comma", "detectable_format:title"], "kwargs": [{}, {}]}], [True, False]),
        ([{"instruction_id_list": ["punctuation:no_comma", "detectable_format:title"]}], [True]),
        ([{"instruction_id_list": ["keywords:existence"], "kwargs": ['{"keywords":["zz"]}']}], [False]),
        ([{"instruction_id_list": ["keywords:existence", "keywords:existence"], "kwargs": ["bad", None]}], [True, True]),
        ([{"instruction_id": "keywords:existence", "kwargs": None}], [False]),
        ([{}], [False]),
        ([], []),
    ]
    rows = [(i, "text", json.dumps(spec)) for i, (spec, _) in enumerate(items)]
    data = spark.createDataFrame(rows, "i int, response string, spec string")
    checked = instructions.check_listed(data, instructions.rule_items(F.col("spec"))).orderBy("i")
    got = [[p["pass"] for p in r.per_instruction] for r in checked.collect()]
    assert got == [outcome for _, outcome in items]


def test_common_layout(spark, tmp_path):
    scored = spark.sql(
        "select 'mmlu' suite, 'x' sample_id, true correct, 1.0D score, 'B' predicted, 'B' expected, 'law' subject, 0.1D ttft_seconds"
    )
    row = results.sample_results(scored, run_id="r", model="m", details=["subject"]).first()
    assert row.details == '{"subject":"law"}' and row.metrics.ttft_seconds == 0.1 and row.metrics.prompt_tokens is None
    bare = results.sample_results(scored.drop("ttft_seconds"), run_id="r", model="m").first()
    assert bare.metrics is None and bare.details == "{}"


def test_logs(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.sql("select 's' sample_id, 0 exit_code").write.parquet(path)
    log = logs.read_log(spark, "program_runs", path)
    assert log.first().asDict() == {"run_id": None, "sample_id": "s", "exit_code": 0, "output": None}
    assert logs.stream_log(spark, "program_runs", path).isStreaming


def test_report(spark):
    from plumbline.plans.report import run_report

    rows = spark.sql(
        "select 's' suite, 'm' model, id % 2 = 0 correct, 0.5D score, if(id = 3, 'x', null) error, "
        "timestamp'2024-01-01 00:00:00' start_ts, id / 10D ttft_seconds, id + 1D total_latency_seconds, "
        "10L prompt_tokens, 5L completion_tokens, 2D tokens_per_second_generation, 3D tokens_per_second_prompt from range(5)"
    )
    row = run_report(rows).first()
    assert (row.num_samples, row.accuracy, row.score, row.total_requests, row.failed_requests) == (5, 0.6, 0.5, 5, 1)
    assert (row.total_prompt_tokens, row.wall_time_seconds, row.effective_throughput_rps) == (40, 5.0, 0.8)
    assert round(row.ttft_p50, 9) == 0.15 and (row.latency_p50, row.generation_tps_p50) == (2.5, 2.0)


def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_every_run_answers_every_sample(spark):
    suite = get_suite("mmlu")
    samples = _table(spark, [("mmlu", f"mmlu_{i}", "A") for i in range(2)], "suite string, sample_id string, expected string")
    samples = samples.withColumns({"messages": F.lit(None).cast("string"), "subject": F.lit("s")})
    log = [("r1", "mmlu", "mmlu_0", "A", None), ("r1", "mmlu", "mmlu_1", "A", None), ("r2", "mmlu", "mmlu_0", "A", None)]
    responses = _table(spark, log, "run_id string, suite string, sample_id string, response string, error string")
    out = {(r.run_id, r.sample_id): (r.correct, r.error) for r in score_suite(suite, samples, responses).collect()}
    assert out == {
        ("r1", "mmlu_0"): (True, None),
        ("r1", "mmlu_1"): (True, None),
        ("r2", "mmlu_0"): (True, None),
        ("r2", "mmlu_1"): (False, "no response"),
    }


def test_failed_calls_are_wrong(spark):
    suite = get_suite("bfcl")
    rows = [("bfcl", "a", "[]", "timeout", ""), ("bfcl", "b", "[]", None, "[]"), ("bfcl", "c", "f(x=y)", None, "f(x=y)")]
    data = _table(spark, rows, "suite string, sample_id string, expected_raw string, error string, response string")
    samples = data.select("suite", "sample_id", "expected_raw").withColumns(
        {"messages": F.lit(None).cast("string"), "expected": F.col("expected_raw")}
    )
    out = {r.sample_id: r for r in score_suite(suite, samples, data.select("suite", "sample_id", "response", "error")).collect()}
    assert (out["a"].correct, out["a"].error, out["a"].expected) == (False, "timeout", "[]")
    assert (out["b"].correct, out["b"].error) == (True, None)
    assert (out["c"].correct, out["c"].expected, out["c"].predicted) == (False, "", "")


def test_conversations_need_all_their_turns(spark):
    samples = spark.createDataFrame(
        [(s, ["p", "q"], [[], []], [[], []]) for s in ("full", "short", "none")],
        "sample_id string, turns array<string>, instruction_id_list array<array<string>>, kwargs array<array<string>>",
    )
    turns = spark.createDataFrame([("full", 0, "a"), ("full", 1, "b"), ("short", 0, "a")], "sample_id string, turn int, response string")
    out = {r.sample_id: r for r in logged.score_conversations(samples, turns).collect()}
    assert {s: (r.correct, r.num_turns, r.error) for s, r in out.items()} == {
        "full": (True, 2, None),
        "short": (False, 2, None),
        "none": (False, 2, "no response"),
    }


def test_no_log_is_no_success(spark):
    tasks = spark.createDataFrame([("a", "[]"), ("b", "[]")], "sample_id string, expected_actions string")
    turns = spark.createDataFrame([("a", 0, [])], "sample_id string, turn int, tool_calls array<struct<name:string,arguments:string>>")
    out = {r.sample_id: (r.correct, r.error) for r in logged.score_agents(tasks, turns).collect()}
    assert out == {"a": (True, None), "b": (False, "no response")}


def test_turns_beyond_a_runners_limit_count(spark):
    call = [("f", "{}")]
    turns = spark.createDataFrame(
        [("a", t, call) for t in range(25)], "sample_id string, turn int, tool_calls array<struct<name:string,arguments:string>>"
    )
    tasks = spark.createDataFrame([("a", "[" + ",".join(['{"name":"f"}'] * 25) + "]")], "sample_id string, expected_actions string")
    assert calls.score_actions(tasks, turns).first().correct
    assert not calls.score_actions(tasks, turns, max_turns=calls.MAX_TURNS).first().correct
