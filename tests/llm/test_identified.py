"""What the language stage finds is what later stages get."""

import corpus_pipeline
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def test_the_language_told_is_that_of_the_rows(spark, docs, tmp_path):
    rows = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if len(r["text"] or "") > 200]
    true = {r["doc_id"]: r["lang"] for r in rows}
    table = docs([(r["doc_id"], r["text"], None if r["doc_id"] % 3 == 0 else r["lang"]) for r in rows])
    got = corpus_pipeline.identify_language(spark, table, str(tmp_path)).collect()
    blank = [r for r in got if r.doc_id % 3 == 0]
    assert blank and all(r.lang is not None for r in got)
    assert sum(r.lang == true[r.doc_id] for r in blank) >= 0.9 * len(blank)
