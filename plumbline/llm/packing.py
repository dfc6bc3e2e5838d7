"""Packing documents into sequences: patterns of few documents, fitted to the lengths.

Documents are encoded once; what follows works on lengths alone. The histogram
of piece lengths, at most as long as a sequence, is all the driver sees. There
patterns of one, two or three lengths that fill a sequence exactly are
enumerated, and their repeat counts are fitted to the histogram by non-negative
least squares, block by block: patterns that share their least length have a
closed solution, a threshold on what their other lengths still lack. Counts are
rounded to what the histogram holds, most frequent patterns first; the pieces
left over, as counts by length, go where they leave the least room (best fit,
longest first).

Pieces find their places without being sorted: each encoding task numbers its
pieces within their length, a join adds what earlier tasks had, and the number
of a piece among those of its length gives sequence and offset from the plan.
The plan has at most three rows for each of about capacity^2 / 12 patterns and
for each split of the best fit, which splits a way of filling twice a length at
most: some 40 MB at a capacity of 2,048, whatever the input. No group is ever
gathered, however many pieces have one length.

Defined results: NULL text is empty; a document is its ids and one ``end_id``,
so no document is without a piece. One of more than ``capacity`` ids is cut from
the end into pieces of ``capacity``, so only the first piece may be shorter; a
text of any length is encoded whole. Documents of equal length are exchangeable:
task and row order decide between them, and rows that repeat are documents of
their own. An empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, schema_of, stored

# Runs of a text remembered by a worker, and the longest one that is.
REMEMBERED, LONGEST = 1 << 19, 64

# No token reaches over a single blank between two visible characters, so words
# can be encoded one by one, each with the blank before it.
BETWEEN = re.compile(r"(?<=\S)(?= \S)")

# Texts of Latin letters, ASCII digits and signs (but no special token's bracket),
# with single blanks or line ends between them, are cut by the tokenizer's own
# rule for these characters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_VISIBLE = rf"[!-;=-~{_LETTERS}]+"
LATIN = re.compile(rf" ?{_VISIBLE}(?:[ \n]{_VISIBLE})*")
RUN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|\n")

# Byte-level vocabularies write a byte that is no visible Latin-1 character as one
# of the characters from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = {byte: 256 + i for i, byte in enumerate(sorted(set(range(256)) - _SHOWN))}


# --- encoding -------------------------------------------------------------------


def runs_of(text: str) -> list[str]:
    """What a text can be cut into: single runs where it is Latin, else words."""
    if LATIN.fullmatch(text):
        return RUN.findall(text)
    found = []
    for word in BETWEEN.split(text):
        if LATIN.fullmatch(word):
            found += RUN.findall(word)
        else:
            found.append(word)
    return found


class RunEncoder:
    """Ids of texts, little-endian unsigned 32-bit, by a byte-level tokenizer's JSON text."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _encode(self, run: str) -> bytes:
        """Ids of a run, by the model alone where nothing is left to be cut."""
        if RUN.fullmatch(run):
            shown = run.encode().decode("latin-1").translate(BYTE_LEVEL)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, long = self.known, {}
        runs = [runs_of(t) for t in texts]
        for run in set().union(*runs).difference(known):
            (known if len(run) <= LONGEST else long)[run] = self._encode(run)
        get = known.__getitem__ if not long else lambda r: long[r] if r in long else known[r]
        return [b"".join(map(get, found)) for found in runs]


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> RunEncoder:
    return RunEncoder(tokenizer)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    start, end = 0, n - (n - 1) // capacity * capacity
    while start < n:
        yield start, end - start
        start, end = end, end + capacity


def pieces(
    docs: DataFrame, tokenizer: str, keep: list[str], text_column: str, *, capacity: int, end_id: int, ids: bool
) -> DataFrame:
    """Columns ``keep``, piece, start, length and checksum of every piece, and its number.

    ``_rank`` counts the pieces of equal length of the task ``_task``.
    """
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    n, end = len(keep), np.array([end_id], "<u4").tobytes()

    def start():
        encode = encoder(text).encode
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def work(batch: pa.RecordBatch):
            rows, out = [], []
            for row, found in enumerate(encode([t or "" for t in batch.column(n).to_pylist()])):
                found += end
                for i, (a, length) in enumerate(cuts(len(found) // 4, capacity)):
                    piece = found[4 * a : 4 * (a + length)]
                    rows.append(row)
                    out.append((i, a, length, zlib.crc32(piece), task, int(seen[length]), piece if ids else None))
                    seen[length] += 1
            rows = pa.array(rows, pa.int64())
            numbers = [pa.array(c, kind) for c, kind in zip(zip(*out), [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(n)), *numbers],
                names=[*keep, "piece", "start", "length", "ids_crc32", "_task", "_rank", "ids"],
            )

        return work

    schema = schema_of(
        docs, keep, piece="int", start="bigint", length="bigint", ids_crc32="bigint", _task="int", _rank="bigint", ids="binary"
    )
    source = docs.select(*keep, F.col(text_column).alias("_packed_text"))
    return map_texts(source, source.columns, schema, start)


# --- plan -----------------------------------------------------------------------


def patterns(present: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Rows of three lengths that fill a sequence, one array for each least length.

    Lengths ascend; 0 stands for none. Patterns of one and two lengths begin with 0.
    """
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    found = []
    for a in [0, *present[present * 3 <= capacity].tolist()]:
        b = present[(present >= a) & (2 * present <= capacity - a)]
        if a == 0:
            b = np.concatenate([[0], b])
        c = capacity - a - b
        b, c = b[there[c]], c[there[c]]
        if len(b):
            found.append(np.stack([np.full(len(b), a), b, c], axis=1))
    return found


def fit(histogram: np.ndarray, blocks: list[np.ndarray], sweeps: int = 30) -> list[np.ndarray]:
    """Non-negative least squares: repeat counts by block, sum of patterns against histogram.

    One block at a time is solved exactly. Its patterns share the least length
    ``a``; their other lengths differ. With ``lack`` the share of ``a`` that is
    left over, a pattern's count is max(0, (gain + m * lack) / size), and
    ``lack`` solves one monotone equation in steps between sorted breakpoints.
    """
    left = histogram.astype(np.float64)
    left[0] = 0
    counts = [np.zeros(len(block)) for block in blocks]
    for _ in range(sweeps):
        for block, x in zip(blocks, counts):
            a, b, c = block[0, 0], block[:, 1], block[:, 2]
            m = 1.0 + (b == a) + (c == a)
            own, twice = (b != a) & (b > 0), b == c
            # Take this block out.
            left[a] += m @ x
            left[b[own]] += x[own]
            other = c != a
            left[c[other]] += x[other]
            left[0] = 0
            gain = np.where(own, left[b], 0) + np.where(other, left[c], 0)
            size = np.where(twice & own, 4.0, own.astype(float) + other)
            if a == 0:
                x[:] = np.maximum(gain / size, 0)
            else:
                alone = size == 0
                size = np.where(alone, 1e-9, size)
                order = np.argsort(-gain / m)
                best, weight, per = gain[order], m[order], size[order]
                lack = (left[a] - np.cumsum(weight * best / per)) / (1 + np.cumsum(weight**2 / per))
                # The breakpoints below ``lack`` are those of the patterns in use.
                used = np.flatnonzero(-best / weight < lack)
                x[:] = np.maximum((gain + m * lack[used[-1]]) / size, 0) if len(used) else 0
            left[a] -= m @ x
            left[b[own]] -= x[own]
            left[c[other]] -= x[other]
            left[0] = 0
    return counts


class Sequences:
    """Sequences by how they are filled: (count, lengths placed one after the other)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        # By room left: lists of (count, ((length, times), ...)).
        self.open: list[list] = [[] for _ in range(capacity + 1)]
        self.groups = np.zeros(capacity + 1, np.int64)

    def add(self, room: int, count: int, filled) -> None:
        if count:
            self.open[room].append((count, filled))
            self.groups[room] += 1

    def place(self, length: int, pieces: int) -> None:
        """Best fit: each piece where it leaves the least room, else in a new sequence."""
        while pieces:
            fitting = np.flatnonzero(self.groups[length:])
            if len(fitting):
                room = length + int(fitting[0])
                count, filled = self.open[room].pop()
                self.groups[room] -= 1
            else:
                room, filled = self.capacity, None
                count = -(-pieces // (room // length))
            times = room // length
            whole = min(count, pieces // times)
            # One more sequence gets what does not fill one up.
            rest = pieces - whole * times if whole < count else 0
            self.add(room - times * length, whole, (filled, length, times))
            if rest:
                self.add(room - rest * length, 1, (filled, length, rest))
            if filled is not None:
                self.add(room, count - whole - (rest > 0), filled)
            pieces -= whole * times + rest

    def rows(self) -> list[tuple[int, list[tuple[int, int]]]]:
        found = []
        for group in self.open:
            for count, filled in group:
                parts = []
                while filled is not None:
                    filled, length, times = filled
                    parts.append((length, times))
                found.append((count, parts[::-1]))
        return found


def arrange(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for ``histogram[length]`` pieces: (count, [(length, times), ...])."""
    left = histogram.astype(np.int64).copy()
    found = Sequences(capacity)
    blocks = patterns(np.flatnonzero(left), capacity)
    if blocks:
        rows, wanted = np.concatenate(blocks), np.rint(np.concatenate(fit(left, blocks))).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable")[: np.count_nonzero(wanted > 0)]:
            lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
            count = int(min(wanted[i], (left[lengths] // times).min()))
            if count > 0:
                left[lengths] -= count * times
                filled = None
                for length, t in zip(lengths[::-1].tolist(), times[::-1].tolist()):
                    filled = (filled, length, t)
                found.add(0, count, filled)
    for length in range(capacity, 0, -1):
        found.place(length, int(left[length]))
    return found.rows()


def plan(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Places of the pieces, numbered by length and then within their length.

    Arrays by run of numbers: first number, first sequence, pieces of that
    length in a sequence, offset of the first of them, length.
    """
    runs, sequence = [], 0
    for count, parts in arrange(histogram, capacity):
        offset = 0
        for length, times in parts:
            runs.append((length, sequence, times, offset, count * times))
            offset += length * times
        sequence += count
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(table[:, 4])])[:-1]
    return first.astype(np.int64), table[:, 1], table[:, 2], table[:, 3], table[:, 0]


# --- packing --------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    made = pieces(named, tokenizer, ["_id"], "_text", capacity=capacity, end_id=end_id, ids=ids)
    made = stored(made if ids else made.drop("ids"), "pieces")
    by_task = made.groupBy("length", "_task").agg(F.count("*").alias("_pieces"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("_pieces").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    first, sequences, times, offsets, lengths = plan(histogram, capacity)
    before_length = np.concatenate([[0], np.cumsum(histogram)])

    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "_task", F.coalesce(F.sum("_pieces").over(earlier), F.lit(0)).alias("_before"))
    columns = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    numbered = made.join(before, ["length", "_task"]).select(*columns, (F.col("_before") + F.col("_rank")).alias("_number"))
    n = len(columns)

    def start():
        def work(batch: pa.RecordBatch):
            length = batch.column(columns.index("length")).to_numpy()
            number = batch.column(n).to_numpy() + before_length[length]
            run = np.searchsorted(first, number, "right") - 1
            within = number - first[run]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)),
                    pa.array(sequences[run] + within // times[run]),
                    pa.array(offsets[run] + within % times[run] * length),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

        return work

    schema = schema_of(numbered, columns, sequence_id="bigint", offset="bigint")
    return map_texts(numbered, numbered.columns, schema, start).withColumnRenamed("_id", id_column)


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of every sequence, from pieces packed with ``ids=True``.

    A sequence has at most ``capacity`` pieces, so its list is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
