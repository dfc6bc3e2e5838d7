"""Helpers shared by the text operators: batches of bytes, stored tables, splits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from plumbline.session import shared_path

# Rows an Arrow batch may hold. Texts average a few kilobytes and may be long,
# so the default of 10,000 rows would make batches of unbounded memory.
BATCH_ROWS = 512

# Bytes of text worked on at once inside a batch; one longer text is a block.
BLOCK_BYTES = 4 << 20

# Lower-casing of A-Z alone, on bytes of UTF-8.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators of this package rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored(table: DataFrame, label: str) -> DataFrame:
    """``table`` written to the cluster's shared folder and read again.

    Cuts lineage, and lets a table that is used several times be computed once.
    The copy outlives lost executors.
    """
    spark = table.sparkSession
    path = shared_path(spark, f"llm-{label}")
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


# Bytes of rows that may be broadcast.
BROADCAST_BYTES = 16 << 20


def bounded(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if its rows are counted to fit the bound.

    Beyond ``BROADCAST_BYTES`` it stays as it is and its joins shuffle. For
    stored tables: the count reads them once.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind in ("binary", "string")]
    size = sum(wide, F.lit(16 * len(table.columns)))
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


# Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def few(table: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``table``, of about ``rows`` rows, in a task for every ``each`` of them, and one a core at least.

    Behind a shuffle a small table else has a task, and stored a file, for every
    shuffle partition, however few its rows. It is never dealt over more tasks.
    """
    return table.coalesce(max(table.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def split_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` bytes, or of one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed.

    Workers are used again by later stages; without this each keeps its largest heap.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_task(start: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task of ``map_texts`` does; a worker that waits for its next task holds nothing of it."""
    give_back()
    work = start()
    for batch in batches:
        if batch.num_rows:
            yield from work(batch)
    work = batch = None
    give_back()


def map_texts(
    table: DataFrame,
    columns: list[str],
    schema: str | StructType,
    start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list[pa.RecordBatch]]],
) -> DataFrame:
    """Run a function over Arrow batches of some columns of ``table``.

    ``start`` runs once per task and returns the function for its batches, so
    that tables a task needs are built once. Other columns of ``table`` are
    never read: names that clash with results do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return one_task(start, batches)

    return table.select(*columns).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def schema_of(table: DataFrame, keep: list[str] | tuple[str, ...], **more: str) -> StructType:
    """Schema of the columns ``keep`` of ``table`` and of ``more`` (name=type)."""
    fields = list(table.select(*keep).schema.fields)
    clash = {f.name for f in fields} & set(more)
    if clash:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    return StructType(fields + [StructField(name, DataType.fromDDL(kind)) for name, kind in more.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
