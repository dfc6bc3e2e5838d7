"""Workers give freed memory back before the next task."""

import numpy as np
import psutil
import pyarrow as pa
from plumbline.llm import bpe, common
from plumbline.llm.queries import BYTE_BPE


def test_freed_memory_goes_back_to_the_system():
    own = psutil.Process()
    common.give_back()
    before = own.memory_info().rss
    kept = []
    for _ in range(3000):
        block = np.ones(10_000)
        kept.append(np.ones(10))
        kept.append(block)
    kept = kept[::2]
    del block
    common.give_back()
    assert own.memory_info().rss - before < 60 << 20


def test_a_task_gives_back_what_it_used():
    own = psutil.Process()
    common.give_back()
    before = own.memory_info().rss

    def start():
        some = [np.ones(10) if k % 2 else np.ones(10_000) for k in range(3000)]
        return lambda batch: [batch.slice(0, len(some[0]) // 10_000)]

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [b.num_rows for b in common.one_task(start, iter([batch, batch.slice(0, 0), batch]))] == [1, 1]
    assert own.memory_info().rss - before < 60 << 20


def test_encoder_remembers_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 16)
    ranks = bpe.read_ranks(BYTE_BPE)
    encoder = bpe.Encoder(ranks, bpe.class_table())
    words = [f" {k}" for k in range(20_000)] + [" " + "ab" * 300] * 2 + [f" {k}" for k in range(0, 20_000, 7)]
    packed = encoder.encode(["".join(words).encode()])
    assert packed == [b"".join(np.array(bpe.merge(w.encode(), ranks), "<u4").tobytes() for w in words)]
    held = [*encoder.merged.items(), *getattr(encoder.merged, "before", {}).items()]
    assert held and sum(len(a) + len(b) for a, b in held) <= 2 << 16


def test_no_merged_slice_outlives_a_task(docs):
    def held(batches):
        import gc

        for _ in batches:
            pass
        gc.collect()
        found = sum(len(o) for o in gc.get_objects() if type(o).__name__ == "_Merged")
        yield pa.RecordBatch.from_pydict({"n": pa.array([found], pa.int64())})

    bpe.encode(docs([(k, f"some words {k}") for k in range(8)]), BYTE_BPE).collect()
    some = docs([(k, "") for k in range(8)]).selectExpr("CAST(0 AS bigint) AS n")
    assert {r.n for r in some.mapInArrow(held, "n bigint").collect()} == {0}
