"""Vector codes: product quantisation in exact integers.

A vector becomes integers, floor(scale * x), cut into equal parts. Each part
position has a codebook that a fixed number of assignment rounds moves. All
nearest-entry searches are matrix products: integers are broken into limbs, so
narrow that every float64 product and partial sum of BLAS stays an integer of
at most 2^53, and the limb products are put together in int64. The nearest
entry is the first of the least distances. Sums of the parts of an entry are
such products as well, with the matrix of who belongs where.

The integers are written once, packed; every round reads them and shuffles one
partial sum per task and codebook number. What reaches the driver and the
tasks is the codebooks: parts x entries x width numbers, whatever the input.

Defined results: rows whose vector is NULL, or holds a NULL, NaN or infinite
component, are left out. A NULL id is larger than any other. Of rows of equal
id, that with the smaller integers comes first; repeated rows count as often as
they occur, in the codebook and in the result. A vector shorter than the
longest counts as filled up with zeros, as does one whose length is no multiple
of the parts. With fewer vectors than entries the codebook has as many entries
as there are vectors. An empty table gives an empty result. Components whose
squared distances could leave 63 bits (beyond about 2^26 after scaling for 64
components) stop the job with an error that says so: an ``error`` column of
type bigint could not hold them. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, map_texts, schema_of, stored

# Components after scaling are packed in 32 bits.
LARGEST = (1 << 31) - 1


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position within the part; int64."""

    entries: np.ndarray
    scale: int

    @property
    def digest(self) -> str:
        """SHA-256 of all integers in decimal, in order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# --- exact products -----------------------------------------------------------


def limbs(numbers: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 arrays whose sum, the i-th times 2^(i * width), is ``numbers``.

    All but the last hold ``width`` bits without sign; the last has the sign.
    """
    found = []
    while np.abs(numbers).max(initial=0) > 1 << width:
        found.append((numbers & ((1 << width) - 1)).astype(np.float64))
        numbers = numbers >> width
    return [*found, numbers.astype(np.float64)]


def limb_width(inner: int) -> int:
    """Bits of a limb, so that sums of ``inner`` products are exact in float64."""
    return (53 - max(inner - 1, 0).bit_length()) // 2


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact as long as the result fits int64."""
    width = limb_width(a.shape[-1])
    total = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + (a.shape[-2], b.shape[-1]), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            if width * (i + j) < 64:
                total += (x @ y).astype(np.int64) << (width * (i + j))
    return total


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry and its squared distance, each by part and vector.

    ``vectors`` is (parts, n, width), ``entries`` (parts, entries, width).
    """
    reach = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * reach * reach * vectors.shape[0] * vectors.shape[2] >= 1 << 63:
        raise OverflowError(f"squared distances of components up to {reach} do not fit 63 bits")
    own = np.einsum("pnw,pnw->pn", vectors, vectors)
    other = np.einsum("pew,pew->pe", entries, entries)
    apart = other[:, None, :] - 2 * exact_products(vectors, entries.transpose(0, 2, 1))
    index = apart.argmin(axis=2)
    return index, own + np.take_along_axis(apart, index[:, :, None], axis=2)[:, :, 0]


# --- packed integers ----------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Integers as bytes whose order is that of the integers."""
    return (numbers + (LARGEST + 1)).astype(">u4").tobytes()


def unpack(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors of a packed column as (parts, n, width), filled up with zeros."""
    size = parts * width
    out = np.zeros((len(column), size), np.int64)
    for row, packed in zip(out, column.to_pylist()):
        numbers = np.frombuffer(packed, ">u4")
        row[: len(numbers)] = numbers
        row[: len(numbers)] -= LARGEST + 1
    return out.reshape(len(column), parts, width).transpose(1, 0, 2)


def quantise(vectors: DataFrame, keep: list[str], vector_column: str, scale: int) -> DataFrame:
    """Columns ``keep`` and ``_packed`` of the rows whose components are all finite."""
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            column = batch.column(n)
            there = np.flatnonzero(np.asarray(column.is_valid()))
            kept = column.take(pa.array(there))
            values = kept.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(kept.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = np.flatnonzero(wrong[ends] == wrong[starts]) if len(there) else there
            numbers = np.floor(scale * np.where(np.isfinite(values), values, 0))
            packed = []
            for a, b in zip(starts[fine], ends[fine]):
                if np.abs(numbers[a:b]).max(initial=0) > LARGEST:
                    raise OverflowError(f"a component times {scale} does not fit 32 bits")
                packed.append(pack(numbers[a:b].astype(np.int64)))
            rows = pa.array(there[fine])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(n)), pa.array(packed, pa.binary())], names=[*keep, "_packed"]
            )

        return work

    source = vectors.select(*keep, F.col(vector_column).alias("_vector"))
    return map_texts(source, source.columns, schema_of(vectors, keep, _packed="binary"), start)


# --- codebooks ----------------------------------------------------------------


def _first(packed: DataFrame, id_column: str, parts: int, width: int, count: int) -> np.ndarray:
    """The entries to begin with: the parts of the rows of the least ids."""
    order = [F.col(id_column).asc_nulls_last(), F.col("_packed")]
    rows = packed.select(id_column, "_packed").orderBy(*order).limit(count).collect()
    return unpack(pa.array([bytes(r["_packed"]) for r in rows], pa.binary()), parts, width)


def _totals(packed: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Number and sum of the parts nearest to each entry: (parts, entries, 1 + width)."""
    parts, count, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, count, 1 + width), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = unpack(batch.column(0), parts, width)
                index, _ = nearest(vectors, entries)
                belongs = (index[:, None, :] == np.arange(count)[None, :, None]).astype(np.int64)
                total[:, :, 0] += belongs.sum(axis=2)
                total[:, :, 1:] += exact_products(belongs, vectors)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.ravel()[slots])], names=["slot", "amount"])

    found = packed.select("_packed").mapInArrow(run, "slot bigint, amount bigint")
    total = np.zeros(parts * count * (1 + width), np.int64)
    for row in found.groupBy("slot").agg(F.sum("amount").alias("amount")).collect():
        total[row["slot"]] = row["amount"]
    return total.reshape(parts, count, 1 + width)


def learn(packed: DataFrame, id_column: str, *, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks after ``rounds`` rounds over packed vectors (see ``quantise``)."""
    longest = packed.agg(F.max(F.octet_length("_packed"))).first()[0] or 0
    width = -(-longest // (4 * parts))
    books = _first(packed, id_column, parts, width, entries)
    for _ in range(rounds if books.size else 0):
        total = _totals(packed, books)
        used = total[:, :, :1] > 0
        books = np.where(used, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books)
    return Codebooks(books, scale)


# --- codes --------------------------------------------------------------------


def encode(packed: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``code`` (two hex digits a part) and ``error``."""
    parts, _, width = books.entries.shape
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            index, apart = nearest(unpack(batch.column(n), parts, width), books.entries)
            codes = [row.tobytes().hex() for row in np.ascontiguousarray(index.T.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(codes, pa.string()), pa.array(apart.sum(axis=0))],
                names=[*keep, "code", "error"],
            )

        return work

    return map_texts(packed, [*keep, "_packed"], schema_of(packed, keep, code="string", error="bigint"), start)


def reconstruct(code: Column, books: Codebooks) -> Column:
    """Approximate vector of a code: its entries end to end, divided by the scale."""
    scale = float(books.scale)
    table = F.array(*(F.array(*(F.array(*(F.lit(x / scale) for x in e)) for e in part)) for part in books.entries.tolist()))
    place = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.get(F.get(table, F.lit(p)), place(p)) for p in range(len(books.entries))))


def compress(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """id, label, code, error and label_error of every kept vector, and the codebooks.

    ``label_error`` sums ``error`` over the rows of equal label, NULLs
    together. Sums are made before the shuffle, so a label may hold any share.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be between 1 and 256")
    named = vectors.select(
        F.col(id_column).alias("_id"), F.col(label_column).alias("_label"), F.col(vector_column).alias("_vector")
    )
    packed = stored(quantise(named, ["_id", "_label"], "_vector", scale), "vectors")
    books = learn(packed, "_id", parts=parts, entries=entries, rounds=rounds, scale=scale)
    codes = stored(encode(packed, books, ["_id", "_label"]), "codes")
    totals = stored(codes.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = totals.withColumnRenamed("_label", "_same")
    joined = codes.join(bounded(totals), F.col("_label").eqNullSafe(F.col("_same")))
    return joined.select(
        F.col("_id").alias(id_column), F.col("_label").alias(label_column), "code", "error", "label_error"
    ), books
