"""Interactions of quality filters: what each removes, by every order of them.

Texts are measured by a finite-state transducer over their UTF-8 bytes, driven
by two tables: the class of a byte gives the next state, state and class give
what is put out (a word begins, a word ends, a capital, a code point, a
symbol). As a byte's class alone decides the state behind it, the states of a
whole block are one table look-up. The spans of the words go into a hash table,
all at once; a span counts as known only if its bytes equal those of the span
that holds the slot, otherwise it goes on to the next slot.

Each document then has one bit per filter that it fails. Documents are counted
by part and bits before anything is expanded, so the orders are applied to at
most 2^filters rows a part.

Copies are found by (digest, smallest id): texts meet by their SHA-256 in a
partial aggregate, and a row looks itself up by digest and its own id, so a
text with very many copies is never one task's work.

Defined results: NULL text is empty; it has no words, fails the word minimum
and no share. A NULL part is the empty string, and one with it. A row with a
NULL id has no smaller one and is no copy; rows that repeat the smallest id are
no copies of each other. A document counts as good (toxic) if any of its labels
says so, once for each of its rows. Every part has a row for each order and
step; an empty table has no part. Texts of any length are measured whole, in
stretches that end between words. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BLOCK_BYTES, blocks, map_texts, mix64, schema_of, stored, texts_of

# Byte classes and what the transducer puts out.
SPACE, CAPITAL, SYMBOL, INSIDE, OTHER = range(5)
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8, 16

WHITE = re.compile(rb"[\x20\x09-\x0D]")

# Spans longer than this are hashed and compared one by one.
WIDE = 64


def _tables(symbols: bytes = b"#$%&*|") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(256, OTHER, np.uint8)
    kind[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = SPACE
    kind[0x41:0x5B] = CAPITAL
    kind[list(symbols)] = SYMBOL
    kind[0x80:0xC0] = INSIDE
    # State 1 is inside a word; the class of the last byte decides.
    after = (np.arange(5) != SPACE).astype(np.uint8)
    out = np.zeros((2, 5), np.uint8)
    out[0, after == 1] |= BEGINS
    out[1, SPACE] |= ENDS
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    out[:, [c for c in range(5) if c != INSIDE]] |= IS_POINT
    return kind, after, out


KIND, AFTER, OUT = _tables()


def transduce(data: np.ndarray) -> np.ndarray:
    """What the transducer puts out at each byte, started between words."""
    kind = KIND[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = AFTER[kind[:-1]]
    return OUT[state, kind]


# --- verified hash table --------------------------------------------------------


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends in eight spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _masked(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from ``at``, those beyond ``left`` set to zero."""
    spare = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
    return eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> spare)


def span_hashes(data: bytes, eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    found = sizes.astype(np.uint64)
    rows = np.flatnonzero(sizes <= WIDE)
    for k in range(0, WIDE, 8):
        rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        found[rows] = mix64(found[rows] ^ _masked(eights, starts[rows] + k, sizes[rows] - k)) + np.uint64(k)
    for i in np.flatnonzero(sizes > WIDE):
        span = memoryview(data)[starts[i] : starts[i] + sizes[i]]
        found[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return found


def same_spans(data: bytes, eights: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans that begin at ``a`` and ``b`` have the same bytes."""
    same = np.ones(len(a), bool)
    rows = np.flatnonzero(sizes <= WIDE)
    for k in range(0, WIDE, 8):
        rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        left = sizes[rows] - k
        same[rows] &= _masked(eights, a[rows] + k, left) == _masked(eights, b[rows] + k, left)
    view = memoryview(data)
    for i in np.flatnonzero(sizes > WIDE):
        same[i] = view[a[i] : a[i] + sizes[i]] == view[b[i] : b[i] + sizes[i]]
    return same


def first_spans(data: bytes, owners: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashed=span_hashes) -> np.ndarray:
    """Marks one span of each distinct word of an owner.

    Open addressing: every span asks for its slot; of those that ask for a free
    slot one gets it. Equal spans ask in step, so a span meets its equal
    where that has been put.
    """
    eights = _eights(data)
    keys = mix64(hashed(data, eights, starts, sizes) + mix64(owners.astype(np.uint64) + np.uint64(1)))
    size = 1 << max(2 * len(starts), 1).bit_length()
    table = np.full(size, -1, np.int64)
    slots = (keys & np.uint64(size - 1)).astype(np.int64)
    first = np.zeros(len(starts), bool)
    asking = np.arange(len(starts))
    while len(asking):
        slot = slots[asking]
        free = table[slot] < 0
        table[slot[free]] = asking[free]
        holder = table[slot]
        got = holder == asking
        first[asking[got]] = True
        like = ~got & (keys[holder] == keys[asking]) & (owners[holder] == owners[asking]) & (sizes[holder] == sizes[asking])
        rows = np.flatnonzero(like)
        like[rows] = same_spans(data, eights, starts[holder[rows]], starts[asking[rows]], sizes[asking[rows]])
        asking = asking[~(got | like)]
        slots[asking] = (slots[asking] + 1) & (size - 1)
    return first


# --- measures -------------------------------------------------------------------


def stretches(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A long text in stretches that end behind white space, of about ``limit`` bytes."""
    start = 0
    while start < len(text):
        found = WHITE.search(text, min(start + limit, len(text)))
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


def measure_block(texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Rows of (words, distinct words, capitals, symbols, code points), and the
    bytes, starts and sizes of one span of each distinct word."""
    data = b" ".join(texts) + b" " * 9
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    put = transduce(np.frombuffer(data, np.uint8, bounds[-1]))
    starts = np.flatnonzero(put & BEGINS)
    sizes = np.flatnonzero(put & ENDS) - starts
    owners = np.searchsorted(bounds, starts, "right") - 1
    first = first_spans(data, owners, starts, sizes)
    per_text = lambda places: np.diff(np.searchsorted(places, bounds))
    measures = np.stack(
        [
            per_text(starts),
            per_text(starts[first]),
            per_text(np.flatnonzero(put & IS_CAPITAL)),
            per_text(np.flatnonzero(put & IS_SYMBOL)),
            # One blank follows each text.
            per_text(np.flatnonzero(put & IS_POINT)) - 1,
        ],
        axis=1,
    )
    return measures, data, starts[first], sizes[first]


def measure_long(text: bytes, limit: int = BLOCK_BYTES) -> np.ndarray:
    total, known = np.zeros(5, np.int64), set()
    for stretch in stretches(text, limit):
        measures, data, starts, sizes = measure_block([stretch])
        total += measures[0]
        known.update(data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist()))
    total[1] = len(known)
    return total


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def measure(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep``, the counts named in ``MEASURES``, and ``digest`` of the text."""
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            texts = texts_of(batch.column(n))
            rows = []
            for a, b in blocks(texts):
                long = b == a + 1 and len(texts[a]) > BLOCK_BYTES
                rows.append(measure_long(texts[a])[None] if long else measure_block(texts[a:b])[0])
            counts = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)),
                    *(pa.array(np.ascontiguousarray(c)) for c in counts.T),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                names=[*keep, *MEASURES, "digest"],
            )

        return work

    schema = schema_of(docs, keep, **{name: "bigint" for name in MEASURES}, digest="binary")
    source = docs.select(*keep, F.col(text_column).alias("_measured"))
    return map_texts(source, source.columns, schema, start)


# --- filters --------------------------------------------------------------------


def conditions(*, least_words: int = 100, least_distinct: int = 80, most_capitals: int = 10) -> dict[str, Column]:
    """Failure conditions over measured columns, by letter; shares in percent."""
    return {
        "A": F.col("n_words") < least_words,
        "B": 100 * F.col("n_distinct") < least_distinct * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > most_capitals * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def _copies(measured: DataFrame, id_column: str) -> DataFrame:
    """``measured`` with ``_copy``: whether a smaller id has the same text."""
    firsts = measured.groupBy("digest").agg(F.min(id_column).alias("_first")).withColumn("_leads", F.lit(True))
    firsts = firsts.withColumnRenamed("digest", "_digest")
    same = (F.col("digest") == F.col("_digest")) & (F.col(id_column) == F.col("_first"))
    joined = measured.join(firsts, same, "left")
    return joined.withColumn("_copy", F.col(id_column).isNotNull() & F.col("_leads").isNull()).drop("_digest", "_first", "_leads")


def failures(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    part_column: str = "lang",
    text_column: str = "text",
    copies: str = "E",
    **limits: int,
) -> DataFrame:
    """id, part and one boolean per filter: those of ``conditions``, and that for copies."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(part_column).alias("_part"), F.col(text_column).alias("_text"))
    fails = conditions(**limits)
    measured = measure(named, ["_id", "_part"], "_text").select("_id", "_part", "digest", *(c.alias(k) for k, c in fails.items()))
    found = _copies(stored(measured, "measured"), "_id")
    part = F.coalesce(F.col("_part").cast("string"), F.lit(""))
    return found.select(F.col("_id").alias(id_column), part.alias("part"), *fails, F.col("_copy").alias(copies))


def with_labels(flagged: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``flagged`` with booleans ``good`` and ``toxic``; no label is neither."""
    judged = labels.groupBy(F.col(id_column).alias("_labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    joined = flagged.join(judged, F.col(id_column) == F.col("_labelled"), "left").drop("_labelled")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def _orders(letters: str) -> Column:
    """Every order and step: its letter's bit and the bits of the letters before."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    rows = [
        {"filter_order": "".join(order), "step": i + 1, "bit": bit[letter], "before": sum(bit[x] for x in order[:i])}
        for order in permutations(letters)
        for i, letter in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, bit int, before int>>")


def interactions(flagged: DataFrame, letters: str) -> DataFrame:
    """Counts by part, order of the filters and step.

    ``flagged`` has ``part``, a boolean per letter, ``good`` and ``toxic``.
    """
    bits = sum((F.when(F.col(x), F.lit(1 << i)).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    counted = flagged.groupBy("part", bits.alias("bits")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    rows = counted.select("*", F.inline(_orders(letters)))
    bits, bit, before = F.col("bits"), F.col("bit"), F.col("before")
    fails, earlier = bits.bitwiseAND(bit) != 0, bits.bitwiseAND(before) != 0
    total = lambda condition, amount="n": F.sum(F.when(condition, F.col(amount)).otherwise(0))
    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(bits == bit).alias("unique_fails"),
        total(fails & ~earlier, "n_good").alias("good_lost"),
        total(fails & ~earlier, "n_toxic").alias("toxic_lost"),
    )
    # A filter has one step in each order.
    everywhere = Window.partitionBy("part", "bit")
    return steps.withColumn("shapley", F.sum("removed").over(everywhere)).drop("bit")
