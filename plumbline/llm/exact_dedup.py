"""Exact duplicates by content-defined chunk recipes.

A rolling hash over the bytes of a text sets chunk borders by content. A text
becomes its recipe: the ordered list of its chunks' identifiers. Chunks are
deduplicated: each distinct content crosses the network about once per task
that has it, and there an identifier is verified to stand for one content
alone. Texts are then compared by their recipes; a long text is never moved to
be compared with another.

Defined results: NULL and empty text are the same text, the empty recipe. Of
equal texts the row with the largest id stays; a NULL id is smaller than any
other. Rows that repeat both id and text are all marked as kept by
``exact_groups``, as the id is what is kept; ``drop_duplicates`` returns one of
them. Only the named columns are read by ``exact_groups``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, bounded, map_texts, mix64, schema_of, stored, texts_of

# Bytes of a chunk: at least, about, at most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 1 << 10, 1 << 12, 1 << 15

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place.

    h[i] is the sum of gear[data[i - k]] << k over k < 32. Sums over 1, 2, 4,
    8, 16 and 32 bytes are each built from two of the half length.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        # The right side is computed in full before h changes.
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunk_ends(text: bytes, hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, by its rolling hash."""
    marks = np.flatnonzero((hashes & np.uint32(MEAN_CHUNK - 1)) == 0) + 1
    ends, start, size = [], 0, len(text)
    i = 0
    while size - start > MIN_CHUNK:
        i = i + int(np.searchsorted(marks[i:], start + MIN_CHUNK))
        end = int(marks[i]) if i < len(marks) else size
        end = min(end, start + MAX_CHUNK, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunks_of(text: bytes) -> list[bytes]:
    if len(text) <= MIN_CHUNK:
        return [text] if text else []
    ends = chunk_ends(text, rolling_hash(np.frombuffer(text, np.uint8)))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def identifier(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def recipes(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` with ``_recipe`` (identifiers end to end) and ``_sha256``."""
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            made, digests = [], []
            for text in texts_of(batch.column(n)):
                made.append(b"".join(map(identifier, chunks_of(text))))
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(made, pa.binary()), pa.array(digests)],
                names=[*keep, "_recipe", "_sha256"],
            )

        return work

    schema = schema_of(docs, keep, _recipe="binary", _sha256="string")
    source = docs.select(*keep, F.col(text_column).alias("_chunked"))
    return map_texts(source, source.columns, schema, start)


def chunk_store(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Each distinct chunk once: chunk_id, content, n_places.

    Grouping is by content as well as by identifier, so contents are compared
    byte by byte. Copies are merged in each task before the shuffle.
    """

    def start():
        def work(batch: pa.RecordBatch):
            texts = texts_of(batch.column(0))
            for a, b in blocks(texts):
                chunks = [c for text in texts[a:b] for c in chunks_of(text)]
                if chunks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([identifier(c) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())],
                        names=["chunk_id", "content"],
                    )

        return work

    found = map_texts(docs, [text_column], "chunk_id binary, content binary", start)
    return found.groupBy("chunk_id", "content").agg(F.count("*").alias("n_places"))


def ambiguous(store: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content: none, or the job must stop."""
    return store.groupBy("chunk_id").agg(F.count("*").alias("n_contents")).filter("n_contents > 1")


def _verified(value, docs: DataFrame, text_column: str):
    """``value``, or an error if an identifier is ambiguous. A scalar subquery."""
    wrong = ambiguous(chunk_store(docs, text_column)).agg(F.count("*")).scalar()
    return F.when(wrong > 0, F.raise_error(F.lit("two chunks share an identifier"))).otherwise(value)


def _repeated(made: DataFrame, id_column: str) -> DataFrame:
    """Recipes of more than one row: the id that stays, how many rows have it and all.

    Stored, so that the join that follows can split a recipe with very many
    rows; it holds duplicated texts alone.
    """
    each = made.groupBy("_recipe", id_column).agg(F.count("*").alias("_rows"))
    groups = each.groupBy("_recipe").agg(
        F.max(id_column).alias("_keep"),
        F.sum("_rows").alias("_size"),
        # No id is as good as any: max_by leaves NULL ids out.
        F.coalesce(F.max_by("_rows", id_column), F.max("_rows")).alias("_kept"),
    )
    return stored(groups.filter("_size > 1"), "recipes")


def exact_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id that stays for its text, group size, digest."""
    made = recipes(docs, [id_column], text_column)
    joined = made.join(bounded(_repeated(made, id_column)), "_recipe", "left")
    single = F.col("_size").isNull()
    keep = F.when(single, F.col(id_column)).otherwise(F.col("_keep"))
    return joined.select(
        id_column,
        _verified(keep, docs, text_column).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | F.col(id_column).eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that with the largest id."""
    made = recipes(docs, docs.columns, text_column)
    narrow = recipes(docs, [id_column], text_column)
    groups = _repeated(narrow, id_column)
    joined = made.join(bounded(groups), "_recipe", "left")
    stays = F.col("_size").isNull() | F.col(id_column).eqNullSafe(F.col("_keep"))
    kept = joined.filter(stays & (F.coalesce("_kept", F.lit(1)) == 1)).select(*docs.columns)
    again = groups.filter("_kept > 1")
    if not again.isEmpty():
        # Rows that repeat both id and text: one of them stays.
        some = made.join(bounded(again), "_recipe").filter(F.col(id_column).eqNullSafe(F.col("_keep")))
        kept = kept.unionByName(some.dropDuplicates(["_recipe"]).select(*docs.columns))
    return kept.filter(_verified(F.lit(True), docs, text_column))
