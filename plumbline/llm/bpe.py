"""Byte-level BPE: encoding without regular expressions, and exact decoding.

Code points of a block of texts become classes (letter, number, white space,
other). Token borders follow from a finite automaton whose step for one
character is a function from states to states. Composing such functions is
associative, so the states before all characters come from a scan: blocks of
characters are composed side by side, block results are scanned by doubling,
and one more pass fills in the states. Slices between borders are merged by
rank; merged slices are remembered per task, those seen last, by their bytes.

The split is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined results: NULL and empty text have no tokens and decode to no bytes.
There are no special tokens; their names are ordinary text. Repeated rows are
encoded alike. Only the named columns are read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, map_texts, schema_of, texts_of

# Code points worked on at once; bytes of slices a task remembers, twice, and what
# one takes beside its own bytes and ids.
CODE_POINTS = 1 << 18
REMEMBERED = 24 << 20
ENTRY = 150

# Longest slice merged by rescanning a short list; longer ones use a heap.
SHORT = 48

LETTER, NUMBER, OTHER, SPACE = range(4)

# The Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    classes = np.fromiter((kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    classes[WHITE_SPACE] = SPACE
    return classes


# --- the automaton ------------------------------------------------------------

# Symbols: a class, refined by what follows it.
_QUOTE1, _QUOTE2 = 3, 4  # ' before one of s t m d; ' before re, ve or ll
_BLANK, _LONE, _RUN = 5, 6, 7  # last white space before a word: ' ' or other; the rest
_FIRST = 8  # added to the symbol of a text's first character
_NOTHING = 16  # padding: leaves the state as it is

# States: the run being read; a blank that waits for its word; n characters of
# a contraction to come; a closed token.
_IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _WAITING, _IN_SPACE, _ONE_MORE, _TWO_MORE, _CLOSED = range(8)


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if state == _TWO_MORE:
        return _ONE_MORE, False
    if state == _ONE_MORE:
        return _CLOSED, False
    run = {LETTER: _IN_LETTERS, NUMBER: _IN_NUMBERS, OTHER: _IN_OTHERS, _QUOTE1: _IN_OTHERS, _QUOTE2: _IN_OTHERS}
    if symbol in run and (state == _WAITING or state == run[symbol]):
        return run[symbol], False
    if symbol == _RUN:
        return _IN_SPACE, state != _IN_SPACE
    opened = {_QUOTE1: _ONE_MORE, _QUOTE2: _TWO_MORE, _BLANK: _WAITING, _LONE: _CLOSED}
    return opened.get(symbol, run.get(symbol)), True


_NEXT = np.empty((17, 8), np.uint8)
_STARTS = np.zeros((17, 8), bool)
for _symbol in range(8):
    for _state in range(8):
        _NEXT[_symbol, _state], _STARTS[_symbol, _state] = _step(_symbol, _state)
        _NEXT[_symbol + _FIRST, _state], _STARTS[_symbol + _FIRST, _state] = _step(_symbol, _CLOSED)
_NEXT[_NOTHING] = np.arange(8)

_LANE = 128


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before every character, by a scan over transition functions."""
    n = len(symbols)
    lanes = -(-n // _LANE)
    grid = np.full(lanes * _LANE, _NOTHING, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, _LANE).T).astype(np.intp) * 8
    step = _NEXT.ravel()
    # Function of every lane: where each of the 8 states ends up.
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in grid:
        whole = step[row + whole]
    # Inclusive scan over lanes: compose with the result 1, 2, 4, … lanes back.
    d = 1
    while d < lanes:
        whole[:, d:] = np.take_along_axis(whole[:, d:], whole[:, :-d].astype(np.intp), axis=0)
        d *= 2
    state = np.concatenate(([_CLOSED], whole[_CLOSED, :-1])).astype(np.uint8)
    out = np.empty((_LANE, lanes), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = step[row + state]
    return out.T.ravel()[:n]


def _symbols(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` marks the first of each text."""
    kind = classes[codes]
    # Following characters within the text; 0 where the text ends.
    after = np.append(codes[1:], 0)
    ends = np.append(first[1:], True)
    after[ends] = 0
    symbols = kind.copy()
    space = kind == SPACE
    before_word = space & ~ends & ~np.append(space[1:], True)
    symbols[space] = _RUN
    symbols[before_word] = np.where(codes[before_word] == 32, _BLANK, _LONE)
    at = np.flatnonzero((codes == 39) & (after > 0))
    if len(at):
        one = after[at]
        two = after[np.minimum(at + 1, len(codes) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[at[single]] = _QUOTE1
        symbols[at[double]] = _QUOTE2
    symbols[first] += _FIRST
    return symbols


def token_slices(text: str, classes: np.ndarray) -> list[str]:
    """Slices of one text, for tests and single use."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes), bool)
    first[0] = True
    symbols = _symbols(codes, first, classes)
    starts = np.flatnonzero(_STARTS[symbols, states_before(symbols)])
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(codes)])]


# --- merging ------------------------------------------------------------------


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: adjacent parts are merged by lowest rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return _merge_short(piece, ranks) if len(piece) <= SHORT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, never = ranks.get, 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == never:
            break
        i = pairs.index(lowest)
        joined = parts[i] + parts.pop(i + 1)
        parts[i] = joined
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, never)
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], never)
    return [ranks[part] for part in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of candidate pairs: n log n for a slice of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 if merged away
    prior = list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        middle = end[i]
        # Stale unless both parts still are as they were.
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            prior[stop] = i
            rank = get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        left = prior[i]
        if left >= 0:
            rank = get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Merged(dict):
    """Slices to packed ids; misses are merged.

    Slices fill one generation and then another; those that nothing asked for
    meanwhile go with the older one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            packed = np.array(merge(piece, self.ranks), "<u4").tobytes()
        size = ENTRY + len(piece) + len(packed)
        if self and self.size + size > REMEMBERED:
            self.before = dict(self)
            self.clear()
            self.size = 0
        self[piece] = packed
        self.size += size
        return packed


class Encoder:
    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.classes = classes
        self.merged = _Merged(ranks)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        out: list[bytes] = []
        for a, b in blocks(texts, CODE_POINTS):
            out += self._block(texts[a:b])
        return out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        byte_starts = np.cumsum(lengths) - lengths
        # Byte offset of every code point.
        if len(codes) == len(data):
            offsets = np.arange(len(codes))
        else:
            width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            offsets = np.cumsum(width) - width
        first = np.zeros(len(codes), bool)
        first[np.searchsorted(offsets, byte_starts[lengths > 0])] = True
        symbols = _symbols(codes, first, self.classes)
        starts = offsets[_STARTS[symbols, states_before(symbols)]]
        cuts = np.searchsorted(starts, np.append(byte_starts, len(data))).tolist()
        ends = [*starts[1:].tolist(), len(data)]
        starts = starts.tolist()
        look = self.merged.__getitem__
        return [
            b"".join([look(data[i:j]) for i, j in zip(starts[a:b], ends[a:b])]) for a, b in zip(cuts, cuts[1:])
        ]


# --- operators ----------------------------------------------------------------


def encode(
    docs: DataFrame,
    ranks_path: str,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    offsets: bool = True,
) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids and, if wanted, byte offsets.

    ``ids`` is packed: little-endian unsigned 32-bit integers. ``offsets``
    holds the place in the text's UTF-8 form at which each token starts.
    The vocabulary is a fixed file and is broadcast.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, class_table()))
    more = {"offsets": "array<bigint>"} if offsets else {}
    schema = schema_of(docs, keep, n_tokens="bigint", ids="binary", **more)
    n = len(keep)

    def start():
        ranks, classes = shared.value
        encoder = Encoder(ranks, classes)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)

        def places(packed: bytes) -> np.ndarray:
            width = sizes[np.frombuffer(packed, "<u4")]
            return np.cumsum(width) - width

        def work(batch: pa.RecordBatch):
            packed = encoder.encode(texts_of(batch.column(n)))
            columns = [
                *(batch.column(i) for i in range(n)),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
            ]
            if offsets:
                columns.append(pa.array(list(map(places, packed)), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return work

    source = docs.select(*keep, F.col(text_column).alias("_encoded"))
    return map_texts(source, source.columns, schema, start)


def decode(encoded: DataFrame, ranks_path: str, *, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes its packed ids stand for; NULL for NULL ids."""
    if "decoded" in encoded.columns:
        encoded = encoded.drop("decoded")
    tokens = {rank: token for token, rank in read_ranks(ranks_path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    at = encoded.columns.index(ids_column)
    names = [*encoded.columns, "decoded"]

    def start():
        token = shared.value.__getitem__

        def work(batch: pa.RecordBatch):
            plain = [
                None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                for ids in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.binary())], names=names)

        return work

    return map_texts(encoded, encoded.columns, schema_of(encoded, encoded.columns, decoded="binary"), start)
