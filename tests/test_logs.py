"""Verdict logs, conversations, streams and the driver's entry points."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as contract
from plumbline.functions import code_text
from plumbline.operators import turns, verdicts
from plumbline.operators.layout import spread
from plumbline.session import shared_path
from plumbline.streaming import live

F3 = "```"


def test_completions(evaluate):
    cases = {
        f" {F3}python\nx = 1\n {F3} ": "x = 1",
        f"{F3}\nx\n{F3}": "x",
        f"{F3}python": "",
        f"{F3}x\n{F3}": "",
        f"{F3}x\nno end": "no end",
        "plain ": "plain",
        f"a\n{F3}": f"a\n{F3}",
    }
    assert evaluate(code_text.clean_completion(F.col("a")), list(cases)) == list(cases.values())


def test_programs(evaluate):
    program = code_text.assemble_program(F.col("a"), F.col("b"), F.lit("T"), F.col("c"))
    rows = [("def f():\n", "  return 1", "f"), ("def f():\n", "def f(): pass", "f")]
    assert evaluate(program, rows) == [
        "def f():\n  return 1\nT\ncheck(f)\n", "def f(): pass\nT\ncheck(f)\n",
    ]


def test_commands(evaluate):
    cases = {
        f"Do {F3}bash\n ls -l \n{F3} now": "ls -l",
        f"{F3}\npwd\n{F3}": "pwd",
        f"{F3}python\nx\n{F3}\n  $ make all": "make all",
        "$ \n$ second": "second",
        "nothing": None,
        f"{F3}sh\n{F3}": "",
    }
    assert evaluate(code_text.extract_command(F.col("a")), list(cases)) == list(cases.values())


def test_patches(evaluate):
    cases = {
        f"{F3}diff\n+a\n{F3}": "+a",
        "diff --git a b\ntext\n@@ -1 @@\n-x": "diff --git a b\n@@ -1 @@\n-x",
        "+a\n-b": None,
        "different\n+a\n-b": None,
    }
    assert evaluate(code_text.extract_patch(F.col("a")), list(cases)) == list(cases.values())


def test_dialogue_stops(spark):
    cmd, done = f"{F3}bash\nls\n{F3}", f"{F3}bash\nls\n{F3} Done"
    log = [
        ("stop", 0, cmd, 0), ("stop", 1, done, 1), ("stop", 2, done, 0), ("stop", 3, cmd, 0),
        ("talk", 0, "no command, done", 0), ("talk", 1, cmd, 0),
        *[("long", t, cmd, 0) for t in range(18)],
    ]
    data = spark.createDataFrame(log, "sample_id string, turn int, response string, exit_code int")
    summary = verdicts.dialogue_summary(verdicts.dialogue_turns(data, max_turns=verdicts.TERMINAL_TURNS))
    got = {r.sample_id: (r.num_turns, r.num_commands, r.stopped) for r in summary.collect()}
    assert got == {"stop": (3, 3, True), "talk": (1, 0, True), "long": (15, 15, False)}


def test_terminal(spark):
    tasks = spark.createDataFrame([("a", ""), ("b", "v"), ("c", "v"), ("d", "v")], "sample_id string, validation string")
    checks = spark.createDataFrame([("b", 0), ("c", 1)], "sample_id string, exit_code int")
    got = {r.sample_id: r.correct for r in verdicts.score_terminal(tasks, checks).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_verdict_roll_up(spark):
    tasks = spark.createDataFrame(
        [("ok", True), ("nopatch", False), ("no_f2p", True), ("late", True), ("early", True), ("none", None)],
        "sample_id string, has_patch boolean",
    )
    log = [("ok", "f2p", 0, True), ("nopatch", "f2p", 0, True), ("no_f2p", "p2p", 0, True)]
    log += [(s, "f2p", 0, True) for s in ("late", "early", "none")]
    log += [("late", "p2p", i, i != 10) for i in range(12)] + [("early", "p2p", i, i != 9) for i in range(12)]
    data = spark.createDataFrame(log, "sample_id string, kind string, pos int, passed boolean")
    got = {r.sample_id: r.correct for r in verdicts.score_test_verdicts(tasks, data, regression_tests=10).collect()}
    assert got == {"ok": True, "nopatch": False, "no_f2p": False, "late": True, "early": False, "none": False}


def test_program_runs(spark):
    answers = spark.createDataFrame(
        [("a", "body", "f"), ("b", "body", "f"), ("c", "body", "f")], "sample_id string, completion string, entry_point string"
    )
    runs = spark.createDataFrame([("a", 0, "o" * 600), ("b", 1, "e")], "sample_id string, exit_code int, output string")
    rows = {r.sample_id: r for r in verdicts.score_programs(answers, runs).collect()}
    assert [rows[k].correct for k in "abc"] == [True, False, False]
    assert len(rows["a"].output) == 500 and rows["a"].expected == "passes f tests"


def test_history_in_blocks(spark):
    log = [("x", t, "user" if t % 2 == 0 else "assistant", "c" * (t % 7)) for t in range(100)]
    log += [("y", 5, "user", "abc"), ("y", 90, "user", "de")]
    data = spark.createDataFrame(log, "sample_id string, turn bigint, role string, content string")
    for block in (8, 4_096):
        got = {(r.sample_id, r.turn): (r.num_messages, r.num_chars) for r in turns.visible_history(data, block=block).collect()}
        assert all(got["x", t] == (t + 1, sum(i % 7 for i in range(t + 1))) for t in range(100))
        assert (got["y", 5], got["y", 90]) == ((1, 3), (2, 5))


def test_request_histories(spark):
    data = spark.createDataFrame(
        [("s", ["u0", "u1"], ["a0"]), ("e", [], [])], "sample_id string, turns array<string>, responses array<string>"
    )
    rows = {r.turn: [(m.role, m.content) for m in r.messages] for r in turns.request_histories(data).collect()}
    assert rows == {0: [("user", "u0")], 1: [("user", "u0"), ("assistant", "a0"), ("user", "u1")]}


def test_spread(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 16)
    assert spread(many, "id") is many


def _chunk_rows():
    start = dt.datetime(2024, 1, 1)
    rows = []
    for r in range(20):
        at = start + dt.timedelta(minutes=r)
        rows += [
            (f"r{r}", at, 0, "dispatch", None, None, None),
            (f"r{r}", at + dt.timedelta(seconds=1), 1, "chunk", "", None, None),
            (f"r{r}", at + dt.timedelta(seconds=3), 3, "chunk", "world", None, None),
            (f"r{r}", at + dt.timedelta(seconds=2), 2, "chunk", "hello ", None, None),
        ]
        if r % 3 == 0:
            rows.append((f"r{r}", at + dt.timedelta(seconds=4), 4, "error", "reset", None, None))
        else:
            rows += [
                (f"r{r}", at + dt.timedelta(seconds=4), 4, "usage", None, 9, 1),
                (f"r{r}", at + dt.timedelta(seconds=5), 5, "usage", None, 10, 2),
            ]
    return rows


CHUNKS = (
    "request_id string, ts timestamp, seq int, kind string, content string, prompt_tokens bigint, completion_tokens bigint"
)


def test_stream_equals_batch(spark):
    path = shared_path(spark, "test-chunks")
    spark.createDataFrame(_chunk_rows(), CHUNKS).write.parquet(path)
    batch = {r.request_id: r for r in live.request_metrics(spark.read.parquet(path)).collect()}
    assert len(batch) == 20
    good, bad = batch["r1"], batch["r0"]
    assert (good.ttft_seconds, good.total_latency_seconds, good.text) == (2.0, 5.0, "hello world")
    assert (good.prompt_tokens, good.completion_tokens, good.error) == (10, 2, None)
    assert (bad.ttft_seconds, bad.total_latency_seconds, bad.text, bad.error) == (2.0, 4.0, "", "reset")
    assert (bad.prompt_tokens, bad.completion_tokens) == (0, 0)
    stream = spark.readStream.schema(CHUNKS).parquet(path)
    done = live.drain_updates(live.request_metrics(stream), spark, "test-ttft", ["request_id"]).collect()
    assert {r.request_id: r for r in done} == batch
    closed = live.drain(live.request_metrics(stream, gap="5 minutes"), spark, "test-closed").collect()
    assert 0 < len(closed) < 20
    assert all(batch[r.request_id] == r for r in closed)


def test_slow_first_token_and_error_without_text(spark):
    start = dt.datetime(2024, 1, 1)
    later = start + dt.timedelta(minutes=6)
    rows = [
        ("slow", start, 0, "dispatch", None, None, None),
        ("slow", later, 1, "chunk", "hi", None, None),
        ("bad", start, 0, "dispatch", None, None, None),
        ("bad", later, 1, "error", None, None, None),
    ]
    got = {r.request_id: r for r in live.request_metrics(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert len(got) == 2
    assert (got["slow"].ttft_seconds, got["slow"].text, got["slow"].error) == (360.0, "hi", None)
    assert got["bad"].error == live.UNNAMED_ERROR


def test_queries_run_from_another_folder(tmp_path):
    """Python workers find the package, wherever the driver was started."""
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {top!r})\n"
        "from workload.session import local_session\n"
        "from plumbline.functions.text import normalize\n"
        "from pyspark.sql import functions as F\n"
        "s = local_session('1')\n"
        "print(s.createDataFrame([('\u00c9t\u00e9!',)], 't string').select(normalize(F.col('t'))).first()[0])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split("\n")[0] == "ete", done.stderr[-2000:]


def test_entry_points(spark):
    frame = contract.entry(spark)
    assert frame.count() == 5 and "ci_lo" in frame.columns
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names) and len(names) > 80


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_path(session, "x")
