"""Exact substring dedup on words by fixed-block anchors.

A word goes if it lies in a window of ``WINDOW`` words whose sequence also
starts earlier: in a smaller id, or in the same document before. The first
occurrence of every sequence stays whole.

1. Documents are put on shelves of some megabytes by hash.
2. Index and probes. Every document's non-overlapping blocks of half a window
   are indexed; every rolling window of that length is probed. Whatever window
   is repeated holds a whole indexed block of its other occurrence, so a hit
   lies in it. A shelf sends each distinct hash once to the hash's cell, with
   flags (indexed, repeated on this shelf); the cell answers which are anchored
   elsewhere. No pair of places is ever made, so a passage that a third of all
   documents hold costs one entry per shelf.
3. Extension. Around hits every window of full length is compared: one entry
   per shelf and sequence goes to the sequence's cell, which finds the earliest
   place and answers the others. Runs of such windows are the maximal repeats.
4. Each shelf marks the words that are covered and writes what is left.

Full windows are compared by 96 bits of hash. Shelves and cells have a size set
by the input's total bytes, which is counted first. Texts move once; all three
passes read the same exchange.

Defined results: a NULL or empty text has no words. A NULL id comes after all
others. Rows that repeat an id have the same places: neither is earlier than
the other. Windows are judged on the input. Only the named columns are read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mix64, schema_of, texts_of

WINDOW = 20
SHELF_BYTES = 8 << 20
LEAST_SHELVES = 64

_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class Shelf:
    """Words of a shelf's documents end to end, in the order of ids."""

    def __init__(self, table: pa.Table, id_column: str, text_column: str, hashed: bool = True):
        texts = texts_of(table.column(text_column).combine_chunks())
        ids = table.column(id_column).combine_chunks()
        rank = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense"))
        order = sorted(range(len(texts)), key=lambda i: (rank[i], texts[i]))
        self.order = pa.array(order, pa.int64())
        self.ids = ids.take(self.order)
        self.rank = rank[order].astype(np.int64)
        self.words = [texts[i].split() for i in order]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(order))
        self.first = np.cumsum(self.counts) - self.counts
        if hashed:
            flat = chain.from_iterable(map(xxhash.xxh3_64_intdigest, words) for words in self.words)
            self.hash = np.fromiter(flat, np.uint64, int(self.counts.sum()))
        self.doc = np.repeat(np.arange(len(order)), self.counts)
        self.start = np.arange(len(self.doc)) - self.first[self.doc]
        self.left = self.counts[self.doc] - self.start

    def rolling(self, size: int, factor: np.uint64 = _R) -> np.ndarray:
        """Hash of the ``size`` words from every place; places near a text's end are not valid."""
        n = len(self.hash)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h[: max(n - k, 0)] = h[: max(n - k, 0)] * factor + self.hash[k:]
        return mix64(h)


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)


# Bits of a hash that an entry holds besides its cell. Other hashes of a cell
# agree in them about once in a thousand: a hit too many, which step 3 drops.
_BITS = np.uint64(30)
_LOW = np.uint64((1 << 30) - 1)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.uint64)


def _cuts(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """(cell, start, end) of the runs of sorted cell numbers."""
    if not len(cells):
        return []
    edges = np.flatnonzero(np.diff(cells)) + 1
    starts = [0, *edges.tolist()]
    return [(int(cells[a]), a, b) for a, b in zip(starts, [*starts[1:], len(cells)])]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, and which occur more than once."""
    if not len(hashes):
        return hashes, np.zeros(0, bool)
    ordered = np.sort(hashes)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.diff(np.append(starts, len(ordered))) > 1


def _ask(shelf_id: int, shelf: Shelf, size: int, cells: int) -> pa.Table:
    """A shelf's distinct block hashes, by cell, with their flags."""
    hashes = shelf.rolling(size)
    valid = shelf.left >= size
    found, many = _distinct(hashes[valid])
    indexed = np.zeros(len(found), bool)
    indexed[np.searchsorted(found, hashes[valid & (shelf.start % size == 0)])] = True
    entry = ((found & _LOW) << np.uint64(2)) | (many.astype(np.uint64) << np.uint64(1)) | indexed.astype(np.uint64)
    runs = _cuts(_cell(found, cells))
    return pa.table(
        {
            "_cell": pa.array([c for c, _, _ in runs], pa.int64()),
            "_shelf": pa.array([shelf_id] * len(runs), pa.int64()),
            "_entries": pa.array([entry[a:b].astype("<u4").tobytes() for _, a, b in runs], pa.binary()),
        }
    )


def _answer(asked: pa.Table) -> pa.Table:
    """For one cell, which entries of each shelf are anchored elsewhere."""
    shelves = asked.column("_shelf").to_pylist()
    parts = [_numbers(p) for p in asked.column("_entries").to_pylist()]
    entry = np.concatenate(parts)
    value = entry >> np.uint64(2)
    found, many = _distinct(value)
    indexed = np.zeros(len(found), bool)
    indexed[np.searchsorted(found, value[(entry & np.uint64(1)) == 1])] = True
    anchored = found[many & indexed]
    rows = []
    for shelf, part in zip(shelves, parts):
        # What repeats on the shelf itself is known there.
        own = part[(part & np.uint64(2)) == 0] >> np.uint64(2)
        own = own[np.isin(own, anchored)]
        if len(own):
            rows.append((shelf, own.astype("<u4").tobytes()))
    return pa.table(
        {
            "_shelf": pa.array([s for s, _ in rows], pa.int64()),
            "_cell": pa.array([asked.column("_cell")[0].as_py()] * len(rows), pa.int64()),
            "_entries": pa.array([p for _, p in rows], pa.binary()),
        }
    )


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``; a bit table turns most of them away."""
    width = 1 << max(16, (8 * len(known)).bit_length())
    table = np.zeros(width, bool)
    mask = np.uint64(width - 1)
    table[(known & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values & mask).astype(np.int64)])
    out = np.zeros(len(values), bool)
    out[maybe] = np.isin(values[maybe], known)
    return out


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane; ascending numbers compress well so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _windows(shelf: Shelf, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the full windows that start at ``at``."""
    h1, h2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(window):
        word = shelf.hash[at + k]
        h1 = h1 * _R + word
        h2 = h2 * _Q + word
    return mix64(h1), (mix64(h2) >> np.uint64(32)).astype(np.uint32)


def _later(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which places have an earlier one with the same hashes."""
    order = np.lexsort((start, rank, h2, h1))
    later = np.zeros(len(order), bool)
    if not len(order):
        return later
    a, b, r, s = h1[order], h2[order], rank[order], start[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later[order] = (r != r[head]) | (s != s[head])
    return later


def _compare(shelf_id: int, shelf: Shelf, answers: pa.Table, window: int, cells: int) -> pa.Table:
    """Windows around hits, the earliest of each sequence on this shelf, by cell.

    Those that are later on the shelf itself are told without a comparison: in a
    row without hashes.
    """
    size = window // 2
    hashes = shelf.rolling(size)
    valid = shelf.left >= size
    found, many = _distinct(hashes[valid])
    key = lambda h: (h & _LOW) + (_cell(h, cells).astype(np.uint64) << _BITS)
    known = [key(found[many])]
    for cell, packed in zip(answers.column("_cell").to_pylist(), answers.column("_entries").to_pylist()):
        known.append(_numbers(packed) + (np.uint64(cell) << _BITS))
    hit = _member(key(hashes), np.concatenate(known)) & valid
    sums = np.concatenate(([0], np.cumsum(hit), np.full(window, hit.sum())))
    # A window has the blocks from its first word to half a window on.
    at = np.flatnonzero((shelf.left >= window) & (sums[window - size + 1 :][: len(hit)] > sums[: len(hit)]))
    h1, h2 = _windows(shelf, at, window)
    later = _later(h1, h2, shelf.rank[shelf.doc[at]], shelf.start[at])
    here = at[later]
    at, h1, h2 = at[~later], h1[~later], h2[~later]
    cell = _cell(h1, cells)
    order = np.argsort(cell, kind="stable")
    at, h1, h2 = at[order], h1[order], h2[order]
    rows = [(shelf_id % cells, None, None, _planes(here), shelf.ids.slice(0, 0), None)] if len(here) else []
    for c, a, b in _cuts(cell[order]):
        docs = np.unique(shelf.doc[at[a:b]])
        rows.append(
            (c, h1[a:b].tobytes(), h2[a:b].tobytes(), _planes(at[a:b]), shelf.ids.take(pa.array(docs)), _planes(shelf.first[docs]))
        )
    return pa.table(
        {
            "_cell": pa.array([r[0] for r in rows], pa.int64()),
            "_shelf": pa.array([shelf_id] * len(rows), pa.int64()),
            "_h1": pa.array([r[1] for r in rows], pa.binary()),
            "_h2": pa.array([r[2] for r in rows], pa.binary()),
            "_at": pa.array([r[3] for r in rows], pa.binary()),
            "_ids": pa.array([r[4].to_pylist() for r in rows], pa.list_(shelf.ids.type)),
            "_first": pa.array([r[5] for r in rows], pa.binary()),
        }
    )


def _judge(compared: pa.Table) -> pa.Table:
    """For one cell, the places of each shelf whose sequence starts earlier elsewhere."""
    told = compared.filter(pc.is_null(compared.column("_h1")))
    rows = list(zip(told.column("_shelf").to_pylist(), told.column("_at").to_pylist()))
    compared = compared.filter(pc.is_valid(compared.column("_h1")))
    if not compared.num_rows:
        return pa.table(
            {"_shelf": pa.array([s for s, _ in rows], pa.int64()), "_gone": pa.array([p for _, p in rows], pa.binary())}
        )
    shelves = compared.column("_shelf").to_pylist()
    at = [_from_planes(p) for p in compared.column("_at").to_pylist()]
    first = [_from_planes(p) for p in compared.column("_first").to_pylist()]
    h1 = np.frombuffer(b"".join(compared.column("_h1").to_pylist()), np.uint64)
    h2 = np.frombuffer(b"".join(compared.column("_h2").to_pylist()), np.uint32)
    ids = pa.concat_arrays([c.flatten() for c in compared.column("_ids").chunks])
    rank = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
    base = np.cumsum([0, *map(len, first)])
    doc = [np.searchsorted(f, a, side="right") - 1 for f, a in zip(first, at)]
    start = np.concatenate([a - f[d] for a, f, d in zip(at, first, doc)])
    order = np.concatenate([rank[b + d] for b, d in zip(base, doc)])
    later = _later(h1, h2, order, start)
    here = 0
    for shelf, places in zip(shelves, at):
        gone = places[later[here : here + len(places)]]
        here += len(places)
        if len(gone):
            rows.append((shelf, _planes(gone)))
    return pa.table(
        {"_shelf": pa.array([s for s, _ in rows], pa.int64()), "_gone": pa.array([p for _, p in rows], pa.binary())}
    )


def _finish(shelf: Shelf, judged: pa.Table, window: int, names: list[str]) -> pa.Table:
    places = [_from_planes(p) for p in judged.column("_gone").to_pylist()]
    gone = np.concatenate([np.zeros(0, np.int64), *places])
    edge = np.bincount(gone, minlength=len(shelf.doc) + window + 1) - np.bincount(
        gone + window, minlength=len(shelf.doc) + window + 1
    )
    covered = np.cumsum(edge)[: len(shelf.doc)] > 0
    removed, kept = [], []
    for words, a in zip(shelf.words, shelf.first):
        flags = covered[a : a + len(words)]
        removed.append(int(flags.sum()))
        if removed[-1]:
            words = [w for w, f in zip(words, flags) if not f]
        kept.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.table(
        [shelf.ids, pa.array(shelf.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
        names=names,
    )


def remove_repeats(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    shelf_bytes: int = SHELF_BYTES,
) -> DataFrame:
    """The id, n_words, n_removed and kept_text (words joined by one blank) of every row."""
    if window < 2 or window % 2:
        raise ValueError("a window has an even number of words")
    size = window // 2
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    shelves = max(LEAST_SHELVES, -(-total // shelf_bytes))
    kind = dict(docs.dtypes)[id_column]
    shelved = docs.select(
        F.pmod(F.xxhash64(id_column, text_column), F.lit(shelves)).alias("_shelf"),
        F.col(id_column).alias("_id"),
        F.col(text_column).alias("_text"),
    )
    own = shelved.groupBy("_shelf")
    number = lambda key: key[0].as_py()

    asked = own.applyInArrow(
        lambda key, rows: _ask(number(key), Shelf(rows, "_id", "_text"), size, shelves),
        "_cell bigint, _shelf bigint, _entries binary",
    )
    answers = asked.groupBy("_cell").applyInArrow(_answer, "_shelf bigint, _cell bigint, _entries binary")
    compared = own.cogroup(answers.groupBy("_shelf")).applyInArrow(
        lambda key, rows, told: _compare(number(key), Shelf(rows, "_id", "_text"), told, window, shelves),
        f"_cell bigint, _shelf bigint, _h1 binary, _h2 binary, _at binary, _ids array<{kind}>, _first binary",
    )
    judged = compared.groupBy("_cell").applyInArrow(_judge, "_shelf bigint, _gone binary")
    schema = schema_of(docs, [id_column], n_words="bigint", n_removed="bigint", kept_text="string")
    names = schema.names
    return own.cogroup(judged.groupBy("_shelf")).applyInArrow(
        lambda rows, told: _finish(Shelf(rows, "_id", "_text", hashed=False), told, window, names), schema
    )
