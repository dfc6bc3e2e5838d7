"""Tasks of bounded rows, and calls read alike in every wrapping."""

from plumbline.functions import call_text
from plumbline.operators import layout
from pyspark.sql import functions as F


def test_no_task_of_expensive_work_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 50, raising=False)
    table = spark.range(0, 1000, 1, 8)
    dealt = layout.spread(table, "id")
    rows = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert dealt.rdd.getNumPartitions() == 20 and max(r["count"] for r in rows) < 100
    assert dealt.count() == 1000


def test_calls_in_every_wrapping_are_read_alike(spark):
    call = '{"name":"f","arguments":{"k":"[1, 2]","n":1.0}}'
    texts = [call, f" [{call}] ", f"```json\n{call}\n```", call.replace('{"k', '"{\\"k').replace("1.0}", '1.0}"').replace('"[1, 2]"', '\\"[1, 2]\\"').replace('"n"', '\\"n\\"').replace('k":', 'k\\":')]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = call_text.with_calls(rows, "t", "c").orderBy("i").collect()
    assert all(not r.c.failed and r.c.calls == got[0].c.calls and r.c.calls[0].name == "f" for r in got)
    others = spark.createDataFrame([(0, "5"), (1, '"[]"'), (2, "null"), (3, "[5]"), (4, "{} []")], "i int, t string")
    sizes = [len(r.c.calls) for r in call_text.with_calls(others, "t", "c").orderBy("i").collect()]
    assert sizes == [0, 0, 0, 1, 0]
