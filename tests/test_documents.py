"""Result documents in parts: lines in order, byte ranges, faults."""

import json
import random

import pytest
from plumbline.sources import documents, results
from pyspark.sql import functions as F


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 700 bytes, so that small files are read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def document(seed, n, **more):
    r = random.Random(seed)
    odd = ['"', "\\", "}", "{", "]", "[", "\\\\", '\\"', '"sample_results":[', "é", "語", "\n", ",", "}},", " "]
    word = lambda: "".join(r.choice([*odd, "a", "b"]) for _ in range(r.randrange(12)))
    samples = []
    for i in range(n):
        s = {"id": f"s{i}", "correct": r.random() < 0.5, "score": 1.0, "predicted": word(), "expected": word()}
        if r.random() < 0.5:
            s["details"] = {"x": word(), "sample_results": [word(), {"y": [1, {}]}], word(): {}}
        if r.random() < 0.5:
            s["metrics"] = {"ttft_seconds": r.random(), "prompt_tokens": r.randrange(99)}
        samples.append(s)
    return {
        "benchmark": "mmlu", "model": word(), "config": {"base_url": word(), "deep": [{"a": [{}]}, [[]], {"sample_results": [1]}]},
        "num_samples": n, "accuracy": 0.5, "aggregated_metrics": {"ttft_mean": 0.25}, "sample_results": samples, **more,
    }


def check(spark, path, wanted, **options):
    runs, samples, bad = results.read_results(spark, path, **options)
    got = {}
    for r in samples.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    good = {k: d for k, d in wanted.items() if d is not None}
    assert {r.file.rsplit("/", 1)[1]: (r.model, r.num_samples) for r in runs.collect()} == {
        k: (d.get("model"), d.get("num_samples")) for k, d in good.items()
    }
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad.collect()) == sorted(k for k, d in wanted.items() if d is None)
    for name, d in good.items():
        rows = {r.id: r for r in got.get(name, [])}
        assert len(rows) == len(got.get(name, [])) == len(d.get("sample_results", []))
        for s in d.get("sample_results", []):
            row = rows[s["id"]]
            assert (row.correct, row.score, row.predicted, row.expected) == (s["correct"], s["score"], s["predicted"], s["expected"])
            assert (row.details is None) == ("details" not in s)
            assert "metrics" not in s or row.metrics.prompt_tokens == s["metrics"]["prompt_tokens"]


def test_files_in_byte_ranges(spark, tmp_path, small_ranges):
    wanted = {}
    for i, (n, indent) in enumerate([(40, None), (40, 2), (1, None), (0, 2), (0, None), (25, 1)]):
        d = document(i, n, **({"after": {"x": [{}, 1]}, "tail": []} if i % 2 else {}))
        wanted[f"f{i}.json"] = d
        (tmp_path / f"f{i}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 3))
    wanted["none.json"] = {"benchmark": "b", "model": "m", "num_samples": 0}
    (tmp_path / "none.json").write_text(' { "benchmark": "b", "model": "m", "num_samples": 0 } ')
    text = json.dumps(document(9, 30))
    faults = {
        "cut.json": text[:-1], "half.json": text[: len(text) // 2], "more.json": text + "}", "two.json": text + text, "comma.json": text[:-2] + ",]}",
        "nocomma.json": text.replace('}, {"id": "s7"', '} {"id": "s7"'), "bad.json": text.replace('"id": "s9"', '"id": s9'),
        "lead.json": text.replace('"sample_results": [{"id": "s0"', '"sample_results": [,{"id": "s0"'), "plain.json": "no json",
    }
    for name, fault in faults.items():
        assert fault != text
        wanted[name] = None
        (tmp_path / name).write_text(fault)
    check(spark, str(tmp_path), wanted)


def test_one_long_line_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    d = document(3, 200)
    (tmp_path / "one.json").write_text(json.dumps(d))
    pieces = documents._pieces(spark, [str(tmp_path)], False)
    assert pieces.select("range").distinct().count() > 20
    check(spark, str(tmp_path), {"one.json": d})


def exported(spark, sizes):
    rows = [(suite, "m", f"s{i:06}", i) for suite, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "suite string, model string, id string, i int")
    return table.withColumn("exported", F.to_json(F.struct("id", (F.col("i") % 2 == 0).alias("correct"), F.lit(1.0).alias("score"))))


def summaries(spark, sizes):
    rows = [(suite, suite, "m", n) for suite, n in sizes.items()]
    return spark.createDataFrame(rows, "suite string, benchmark string, model string, num_samples bigint")


def test_documents_in_lines(spark, tmp_path):
    """A run of most rows is spread over parts, which are the document in the order of their names."""
    sizes = {"big": 3000, "one": 1, "none": 0, "two": 2}
    lines = documents.document_lines(summaries(spark, sizes), exported(spark, {**sizes, "unknown": 3}).repartition(7, "i"), ["suite", "model"])
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    documents.write_documents(lines, path, ["suite", "model"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for suite, n in sizes.items():
        files = sorted((tmp_path / "out" / f"suite={suite}" / "model=m").glob("part-*"))
        assert len(files) > 1 or n < 3000
        d = json.loads("".join(f.read_text() for f in files))
        assert [s["id"] for s in d["sample_results"]] == [f"s{i:06}" for i in range(n)]
        assert (d["benchmark"], d["model"], d["num_samples"]) == (suite, "m", n)
    assert not (tmp_path / "out" / "suite=unknown").exists()
    runs, samples, bad = results.read_results(spark, path, parts=True)
    assert {r.benchmark: r.num_samples for r in runs.collect()} == sizes
    assert {r.suite: r["count"] for r in samples.groupBy("suite").count().collect()} == {k: n for k, n in sizes.items() if n}
    assert bad.count() == 0


def test_no_value_holds_a_run(spark):
    lines = documents.document_lines(summaries(spark, {"a": 5}), exported(spark, {"a": 5}), ["suite", "model"])
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(exported" not in plan and "collect_list(struct(suite" in plan  # sampled keys for borders alone
    assert max(len(r.line) for r in lines.collect()) < 120
