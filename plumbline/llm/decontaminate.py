"""Benchmark decontamination with a generalised suffix automaton.

All test items, normalised to words, go into one automaton of all their
substrings. A document's words stream through it; at every word the automaton
gives the longest suffix that occurs in some item, so every shared span of at
least the window length is found, however long.

Normal form: A-Z in lower case, words are runs of digits, a-z and any
non-ASCII character. All else separates words.

Defined results: a NULL or empty text has no words and is never hit. A NULL or
empty item, or one without words, has no window. An item shorter than the
window is one window of its own length. Items with the same words all count.
Items without an id are hit like others; they count as one item without a name.
Rows repeated in the input are repeated in the output. An empty table of items
leaves every document clean. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, texts_of

WINDOW = 10

# Words of items one automaton may hold (about 400 bytes each). More items
# are matched block by block.
BLOCK_WORDS = 200_000

# Byte-wise form of the word rule: separators become blanks, A-Z lower case.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class ItemAutomaton:
    """Suffix automaton over the word sequences of several items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW, whole_below: int = 0):
        self.window = window
        self.whole_below = max(window, whole_below)
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((name, ids))
                self._add(ids)
        self.shortest = min((len(ids) for _, ids in coded), default=window)
        self._mark(coded)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """Clone ``target`` for the strings that reach it from ``state``."""
        clone = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def _add(self, ids: list[int]) -> None:
        last = 0
        for word in ids:
            known = self.step[last].get(word)
            if known is not None:
                exact = self.length[known] == self.length[last] + 1
                last = known if exact else self._split(last, word, known)
                continue
            fresh = self._new(self.length[last] + 1, {}, 0)
            state = last
            while state >= 0 and word not in self.step[state]:
                self.step[state][word] = fresh
                state = self.link[state]
            if state >= 0:
                target = self.step[state][word]
                exact = self.length[target] == self.length[state] + 1
                self.link[fresh] = target if exact else self._split(state, word, target)
            last = fresh

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which state stands for a window, and whose."""
        size = self.window
        self.owners: dict[int, list[str]] = {}
        self.whole: dict[int, tuple[int, list[str]]] = {}
        for name, ids in coded:
            state = 0
            for i, word in enumerate(ids):
                state = self.step[state][word]
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    names = self.owners.setdefault(at, [])
                    if not names or names[-1] != name:
                        names.append(name)
            if len(ids) < self.whole_below:
                self.whole.setdefault(state, (len(ids), []))[1].append(name)
        # The nearest state up the suffix links that is a whole short item.
        self.above = [-1] * len(self.step)
        if self.whole:
            for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
                up = self.link[state]
                self.above[state] = up if up in self.whole else self.above[up]

    def match(
        self, words: list[bytes], wholes: list[tuple[int, int]] | None = None
    ) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (start, end) of word positions, items found, longest match.

        The longest match is that of words in runs long enough to hold a
        window; shorter runs cannot be hit. ``wholes`` receives the spans of
        items found whole, of those shorter than ``whole_below``.
        """
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        need = min(self.shortest, self.window)
        known = np.fromiter(ids, np.int64, len(ids)) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        for start, end in edges.reshape(-1, 2):
            if end - start >= need:
                longest = max(longest, self._run(ids, int(start), int(end), spans, names, wholes))
        return spans, names, longest

    def _run(self, ids, start: int, end: int, spans: list, names: set, wholes: list | None) -> int:
        step, link, length, size = self.step, self.link, self.length, self.window
        state = matched = longest = 0
        for i in range(start, end):
            word = ids[i]
            while word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state][word]
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= size:
                at = state
                while length[link[at]] >= size:
                    at = link[at]
                names.update(self.owners[at])
                _cover(spans, i + 1 - matched, i + 1)
            if self.whole:
                at = state if state in self.whole else self.above[state]
                while at >= 0:
                    count, owners = self.whole[at]
                    if count <= matched:
                        names.update(owners)
                        _cover(spans, i + 1 - count, i + 1)
                        if wholes is not None:
                            _cover(wholes, i + 1 - count, i + 1)
                    at = self.above[at]
        return longest


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span that ends no earlier than those before, joining overlaps."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def long_spans(spans: list[tuple[int, int]], wholes: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans of ``least`` words or more, and those around one of ``wholes``; both lists ascend."""
    out, k = [], 0
    for start, end in spans:
        while k < len(wholes) and wholes[k][0] < start:
            k += 1
        if end - start >= least or (k < len(wholes) and wholes[k][1] <= end):
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int, whole_below: int = 0):
    """Automata over all items, each of about ``block_words`` words.

    The items are the query set; their words are counted first, so that what
    is broadcast has a known size.
    """
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text"))
    # A word and its separator take two bytes at least.
    bound = rows.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(-(-bound // block_words)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    for k in range(count):
        block = rows.filter(F.col("block") == k).select("name", "text").collect()
        found = ((r.name, words_of((r.text or "").encode())) for r in block)
        yield ItemAutomaton(found, window, whole_below)


FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, longest bigint"


def find_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: its word count, hit spans in words, items found, longest match.

    One block of items, the usual case, takes one pass without a shuffle. More
    blocks are matched one after the other and their spans are joined by
    document.
    """
    spark = docs.sparkSession
    key = "" if id_column in ("n_words", "spans", "items", "longest") else id_column
    if not key:
        raise ValueError(f"the id column may not be named {id_column!r}")
    kind = dict(docs.dtypes)[id_column]
    keyed = docs.select(
        id_column, F.col(text_column).alias("_text"), F.xxhash64(text_column).alias("_version")
    )

    def one(automaton: ItemAutomaton) -> DataFrame:
        shared = spark.sparkContext.broadcast(automaton)

        def start():
            found = shared.value

            def work(batch: pa.RecordBatch):
                counts, spans, names, longest = [], [], [], []
                for text in texts_of(batch.column(2)):
                    words = words_of(text)
                    hit, who, most = found.match(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    names.append(sorted(who, key=lambda x: (x is None, x)))
                    longest.append(most)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(longest, pa.int64()),
                    ],
                    names=[id_column, "_version", "n_words", "spans", "items", "longest"],
                )

            return work

        return map_texts(
            keyed, [id_column, "_version", "_text"], f"`{id_column}` {kind}, _version bigint, {FOUND}", start
        )

    parts = [one(a) for a in item_blocks(items, item_id, item_text, window, block_words)]
    if len(parts) == 1:
        return parts[0].drop("_version")
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    grouped = together.groupBy(id_column, "_version").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
        (F.count("*") / len(parts)).cast("int").alias("_copies"),
    )
    # Spans of blocks may overlap; repeated rows were grouped and come back.
    joined = F.aggregate(
        F.array_sort("spans"),
        F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return (
        grouped.withColumn("spans", joined)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(id_column, "n_words", "spans", "items", "longest")
    )


def hit_words(spans: str = "spans"):
    """Number of words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Counts per document, and whether it holds any window of any item."""
    key = options.get("id_column", "doc_id")
    return find_items(docs, items, **options).select(
        key,
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in merge_spans(spans):
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(text[at:])
    return "".join(kept)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_span: int = WINDOW,
    max_coverage: float = 0.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without spans of ``min_span`` words or more that items hold.

    An item shorter than ``min_span`` counts where it is found whole, and so
    does the span it lies in. A document of which more than ``max_coverage`` of the words lies in such
    spans is dropped whole; with 0 every contaminated document goes, with 1
    documents stay and lose the spans. Clean rows pass unchanged. Columns are
    those of ``docs``. Nothing is shuffled: all blocks of items are matched in one
    pass over the rows, and coverage is that by all of them.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_column)
    schema, names = docs.schema, docs.columns
    blocks = item_blocks(items, item_id, item_text, window, block_words, min_span)
    shared = [spark.sparkContext.broadcast(automaton) for automaton in blocks]

    def start():
        automata = [s.value for s in shared]

        def work(batch: pa.RecordBatch):
            keep, changed = [], False
            column = batch.column(at)
            texts = column.to_pylist()
            for i, text in enumerate(texts_of(column)):
                words = words_of(text)
                wholes: list[tuple[int, int]] = []
                spans = []
                for found in automata:
                    some: list[tuple[int, int]] = []
                    spans += found.match(words, some)[0]
                    wholes += some
                spans = long_spans(merge_spans(spans), merge_spans(wholes), min(min_span, len(words)))
                covered = sum(b - a for a, b in spans)
                keep.append(covered <= max_coverage * len(words))
                if spans and keep[-1]:
                    texts[i], changed = remove_spans(texts[i], spans), True
            if changed:
                batch = batch.set_column(at, names[at], pa.array(texts, column.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

        return work

    return map_texts(docs, names, schema, start)
