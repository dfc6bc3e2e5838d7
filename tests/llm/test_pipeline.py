"""The pipeline against plain versions of its stages, and on odd tables."""

import os
import random

import corpus_pipeline
import pyarrow.parquet as pq
from plumbline.llm import language_id
from plumbline.llm.queries import ORACLES, QUERIES

from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    kept = {}
    for r in rows:
        if any(map(str.isalpha, r["text"] or "")):
            kept[r["text"]] = max(kept.get(r["text"], -1), r["doc_id"])
    left = [(d, t) for t, d in kept.items()]
    near = brute.similarity_classes(left, 5, 80)
    left = [(d, t) for d, t in left if near[d][1] == d]
    want = sorted(d for d, t in left if not brute.item_hits(t, items, 10)[1])
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == want
    assert all(r.round_trip and r.n_tokens for r in out)


def test_texts_of_no_learned_language_are_rejected(spark, docs, tmp_path):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    clean = [(r["doc_id"], r["text"], r["lang"] if r["doc_id"] % 5 else None) for r in rows]
    noise = random.Random(1)
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        *("".join(chr(noise.randrange(33, 127)) for _ in range(200)) + "a" for _ in range(3)),
    ]
    out = corpus_pipeline.identify_language(spark, docs(clean + [(10**6 + i, t, None) for i, t in enumerate(odd)]), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, t, _ in clean if any(map(str.isalpha, t or "")))


def test_a_language_of_one_text_and_no_language_at_all(spark, docs, tmp_path):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:60]
    alone = (10**6, "Все люди рождаются свободными и равными в своем достоинстве и правах.", "ru")
    some = [*((r["doc_id"], r["text"], r["lang"]) for r in rows), alone]
    out = corpus_pipeline.identify_language(spark, docs(some), str(tmp_path))
    assert 10**6 in {r.doc_id for r in out.collect()}
    none = docs([(d, t, None) for d, t, _ in some] + [(-1, "12 ?", None)])
    assert corpus_pipeline.identify_language(spark, none, str(tmp_path)).count() == len(some)
    empty = language_id.train(none)
    assert language_id.keep_identified(none, empty, min_score=0.5).count() == len(some)


def test_the_pipeline_drops_documents_with_short_items(spark, docs, tmp_path):
    items = [(1, "a passage of eight words is an item"), (2, "tiny item here")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    around = "these are the words that come before or after it in the text"
    rows = [(1, f"{around} {items[0][1]} {around}"), (2, f"{around} Tiny item, here {around}"), (3, f"{around} tiny item {around}")]
    out = corpus_pipeline.drop_contaminated(spark, docs(rows), str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [3]


def test_stages_keep_the_columns_and_take_odd_rows(spark, docs, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    table = docs([(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "other words"), (4, "!")])
    for frame in (table, table.filter("false")):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns
                now = out
        texts = sorted((r.doc_id or 0) for r in out.collect())
        assert texts == ([0, 3] if frame is table else [])


def test_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)
