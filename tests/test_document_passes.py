"""Samples of a document are scored once, however often they are passed over."""

from plumbline.session import shared_path
from plumbline.sources import documents
from pyspark.sql import functions as F


def test_written_samples_are_scored_once(spark):
    runs = shared_path(spark, "test-scored")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def scored(i):
        seen.add(1)
        return f'{{"id":{i},"predicted":"a ] \\" {{ [b"}}'

    rows = spark.range(0, 300, 1, 3).select(F.lit("s").alias("suite"), "id", scored("id").alias("exported"))
    heads = spark.createDataFrame([("s", "x")], "suite string, benchmark string")
    documents.write_documents(documents.document_lines(heads, rows, ["suite"]), runs, ["suite"])
    assert seen.value == 300
    found, samples = documents.read_split(spark, [runs], parts=True)
    assert [r.valid for r in found.collect()] == [True] and samples.count() == 300
