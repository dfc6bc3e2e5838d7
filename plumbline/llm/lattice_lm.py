"""Language-model score of a text: all its segmentations into subwords.

The pieces are those of an existing vocabulary. A word's probability is the
sum over all ways to cut it into pieces, by a forward recursion in log space;
pieces do not cross words, so a text's probability is the product over its
words and its end. Piece probabilities start from the vocabulary's own scores
and are re-estimated once from expected counts over all training words (one
step of expectation maximisation over every segmentation).

Beside it the base score: words under additive smoothing.

Each distinct word is scored once. The most frequent words reach the tasks by
broadcast, at most ``FREQUENT`` of them; a text's other words meet their counts
in a join. No hot word is left to that join.

Defined results: NULL text is empty: it has its end alone. Only A-Z is
lower-cased; words are separated by blanks and the control characters 9 to 13.
Bytes outside all pieces are single-byte pieces, so every word has a
probability. Without training rows counts are 0 and V is 0. Repeated rows are
scored alike. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ASCII_LOWER, map_texts, mix64, schema_of, stored, texts_of

# Words that may be broadcast (about 150 bytes each), and their longest.
FREQUENT = 1 << 17
FREQUENT_BYTES = 64

# Distinct words a task gathers before it passes their counts on.
GATHERED = 200_000

LONGEST_PIECE = 16
# Words of one length scored side by side; longer words go one by one.
SIDE_BY_SIDE = 192
CELLS = 1 << 18
# Words of a table taken together; batches of a few hundred waste vector work.
TOGETHER = 1 << 16

START = 0xFF  # marks the start of a word; no byte of UTF-8
END = b""  # the end of a text, counted as a word
SMOOTHING = 0.1
LN10 = math.log(10)


def lower_words(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


# --- pieces -------------------------------------------------------------------


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a vocabulary file as bytes, with first probabilities from their scores.

    Scores there fall by one from piece to piece; the probabilities fall as one
    over that rank. Every single byte is a piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]): 1e-7 for b in range(256)}
    mark = bytes([START])
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "\0").encode().replace(b"\0", mark)
        rank = -model.get_score(i)
        if 0 < len(piece) <= LONGEST_PIECE and piece.translate(ASCII_LOWER) == piece and mark not in piece[1:]:
            if rank < 1e8:
                out[piece] = out.get(piece, 0) + 1 / (rank + 10)
    total = sum(out.values())
    return {piece: p / total for piece, p in out.items()}


class Pieces:
    """Log probabilities of pieces, by a hash of their bytes."""

    def __init__(self, probabilities: dict[bytes, float], end: float):
        self.end = math.log(end)
        self.known = {piece: math.log(p) for piece, p in probabilities.items()}
        self.names = sorted(self.known)
        self.logs = np.array([self.known[n] for n in self.names])
        # By length: sorted hashes and which piece each stands for.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.fromiter(map(len, self.names), np.int64, len(self.names))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            flat = np.frombuffer(b"".join(self.names[i] for i in own), np.uint8)
            codes = _code(flat.reshape(len(own), size))
            if len(np.unique(codes)) < len(codes):
                raise ValueError("two pieces share a hash")
            order = np.argsort(codes)
            self.tables[size] = codes[order], own[order]

    def find(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which piece of ``size`` bytes has each hash, and whether one has."""
        if size not in self.tables:
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        known, which = self.tables[size]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return which[at], known[at] == codes


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _code(grid: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes."""
    h = np.zeros(len(grid), np.uint64)
    for column in grid.T:
        h = h * _FACTOR + _BYTE[column]
    return h


def _links(grid: np.ndarray, pieces: Pieces):
    """For every stretch [i, j): which rows have a piece there, and which one."""
    rows, n = grid.shape
    for i in range(n):
        h = np.zeros(rows, np.uint64)
        for j in range(i + 1, min(i + LONGEST_PIECE, n) + 1):
            h = h * _FACTOR + _BYTE[grid[:, j - 1]]
            at, there = pieces.find(h, j - i)
            if there.any():
                yield i, j, at, there


def forward(grid: np.ndarray, pieces: Pieces, links=None) -> np.ndarray:
    """Log of the summed probability of the first j bytes, for every row and j."""
    rows, n = grid.shape
    alpha = np.full((n + 1, rows), -np.inf)
    alpha[0] = 0
    for i, j, at, there in links if links is not None else _links(grid, pieces):
        step = np.where(there, alpha[i] + pieces.logs[at], -np.inf)
        alpha[j] = np.logaddexp(alpha[j], step)
    return alpha


def _forward_one(word: bytes, pieces: Pieces) -> float:
    """The same for one long word."""
    known = pieces.known
    alpha = [0.0]
    for j in range(1, len(word) + 1):
        steps = []
        for i in range(max(0, j - LONGEST_PIECE), j):
            log = known.get(word[i:j])
            if log is not None:
                steps.append(alpha[i] + log)
        top = max(steps)
        alpha.append(top + math.log(sum(math.exp(s - top) for s in steps)))
    return alpha[-1]


def _groups(words: list[bytes]):
    """(places, grid of bytes) of words of one length, with the mark of a start in front."""
    by: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by.setdefault(len(word), []).append(k)
    for size, places in by.items():
        if size <= SIDE_BY_SIDE:
            most = max(CELLS // (size + 1), 1)
            for a in range(0, len(places), most):
                part = places[a : a + most]
                flat = np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), size)
                yield part, np.concatenate((np.full((len(part), 1), START, np.uint8), flat), axis=1)


def word_logs(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations."""
    out = np.zeros(len(words))
    for part, grid in _groups(words):
        out[part] = forward(grid, pieces)[-1]
    for k, word in enumerate(words):
        if len(word) > SIDE_BY_SIDE:
            out[k] = _forward_one(bytes([START]) + word, pieces)
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected use of every piece over all segmentations of weighted words."""
    total = np.zeros(len(pieces.logs))
    for part, grid in _groups(words):
        _expect(grid, weights[part], pieces, total)
    for k, word in enumerate(words):
        if len(word) > SIDE_BY_SIDE:
            # In stretches: where a long run is cut matters little to counts.
            marked = bytes([START]) + word
            for a in range(0, len(marked), SIDE_BY_SIDE):
                stretch = np.frombuffer(marked[a : a + SIDE_BY_SIDE], np.uint8)[None, :]
                _expect(stretch, weights[k : k + 1], pieces, total)
    return total


def _expect(grid: np.ndarray, weights: np.ndarray, pieces: Pieces, total: np.ndarray) -> None:
    links = list(_links(grid, pieces))
    alpha = forward(grid, pieces, links)
    beta = np.full(alpha.shape, -np.inf)
    beta[-1] = 0
    for i, j, at, there in reversed(links):
        beta[i] = np.logaddexp(beta[i], np.where(there, beta[j] + pieces.logs[at], -np.inf))
    for i, j, at, there in links:
        use = weights * np.exp(np.where(there, alpha[i] + pieces.logs[at] + beta[j] - alpha[-1], -np.inf))
        total += np.bincount(at, use, len(total))


# --- counts -------------------------------------------------------------------


def _together(batches):
    """Arrow batches joined to batches of ``TOGETHER`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_counts(docs: DataFrame, train_column: str, text_column: str) -> DataFrame:
    """word, n (in training rows) and uses (in all rows), ends of texts included."""

    def start():
        def work(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())

            def flush():
                words = list(seen[0].keys() | seen[1].keys())
                rows = pa.RecordBatch.from_arrays(
                    [
                        pa.array(words, pa.binary()),
                        pa.array([seen[1][w] for w in words], pa.int64()),
                        pa.array([seen[0][w] + seen[1][w] for w in words], pa.int64()),
                    ],
                    names=["word", "n", "uses"],
                )
                seen[0].clear()
                seen[1].clear()
                return rows

            for batch in batches:
                flags = batch.column(0).to_pylist()
                for flag, text in zip(flags, texts_of(batch.column(1))):
                    count = seen[bool(flag)]
                    count.update(lower_words(text))
                    count[END] += 1
                    if len(count) > GATHERED:
                        yield flush()
            if seen[0] or seen[1]:
                yield flush()

        return work

    work = start()
    found = docs.select(train_column, text_column).mapInArrow(work, "word binary, n bigint, uses bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def estimate(words: DataFrame, path: str) -> Pieces:
    """Piece probabilities from expected counts over all training words."""
    spark = words.sparkSession
    first = vocabulary(path)
    shared = spark.sparkContext.broadcast(Pieces(first, 0.5))

    def start():
        pieces = shared.value

        def work(batches):
            total = np.zeros(len(pieces.logs))
            for batch in _together(batches):
                rows = batch.column(0).to_pylist()
                total += expected_counts(rows, batch.column(1).to_numpy().astype(float), pieces)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], names=["piece", "uses"]
            )

        return work

    trained = words.filter((F.col("n") > 0) & (F.octet_length("word") > 0)).select("word", "n")
    sums = (
        trained.mapInArrow(start(), "piece bigint, uses double")
        .groupBy("piece")
        .agg(F.sum("uses").alias("uses"))
        .collect()
    )
    names = shared.value.names
    uses = {name: 0.0 for name in names} | {names[r.piece]: r.uses for r in sums}
    ends = words.filter(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    # Each piece keeps a share of its first probability, so that none is 0.
    total = sum(uses.values()) + 1 + ends + 1
    return Pieces({n: (uses[n] + first[n]) / total for n in names}, (ends + 1) / total)


def scored_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, uses and the natural log of the word's probability."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        own = shared.value
        for batch in _together(batches):
            rows = batch.column(0).to_pylist()
            logs = word_logs(rows, own)
            logs[[k for k, w in enumerate(rows) if w == END]] = own.end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logs, pa.float64())], names=["word", "n", "uses", "log"]
            )

    return words.select("word", "n", "uses").mapInArrow(run, "word binary, n bigint, uses bigint, log double")


# --- scores -------------------------------------------------------------------

_SUMS = {"n_tokens": "bigint", "n_known": "bigint", "base": "double", "model": "double"}


def score(
    docs: DataFrame,
    train_column: str,
    vocabulary_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """The id, the training flag and both scores of every row of ``docs``.

    ``train_column`` flags the rows to learn from.
    """
    spark = docs.sparkSession
    counted = stored(word_counts(docs, train_column, text_column), "words")
    pieces = estimate(counted, vocabulary_path)
    words = stored(scored_words(counted, pieces), "scored-words")
    sums = words.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    tokens, distinct = sums.tokens or 0, sums.distinct or 0
    # With no training rows at all every word is equally unknown.
    room = math.log10(tokens + SMOOTHING * (distinct + 1))
    base = F.log10(F.col("n") + SMOOTHING) - room
    common = (
        words.filter(F.octet_length("word") <= FREQUENT_BYTES)
        .orderBy(F.desc("uses"), "word")
        .limit(frequent)
        .select("word", (F.col("n") > 0).alias("known"), base.alias("base"), "log")
    )
    table = {bytes(r.word): (1, int(r.known), r.base, r.log) for r in common.toLocalIterator()}
    shared = spark.sparkContext.broadcast(table)

    keyed = docs.select(
        id_column,
        train_column,
        F.xxhash64(text_column).alias("_version"),
        F.col(text_column).alias("_scored"),
    )
    keys = [id_column, train_column, "_version"]
    rest_schema = schema_of(keyed, keys, copies="bigint", word="binary", uses="bigint", **_SUMS)

    def start():
        get = shared.value.get

        def work(batch: pa.RecordBatch):
            row, copies, word, uses = [], [], [], []
            parts: list[tuple] = []
            for i, text in enumerate(texts_of(batch.column(3))):
                tokens = lower_words(text)
                tokens.append(END)
                found = list(map(get, tokens))
                if None in found:
                    rare = Counter(w for w, f in zip(tokens, found) if f is None)
                    found = [f for f in found if f is not None]
                    for w, n in rare.items():
                        row.append(i)
                        copies.append(0)
                        word.append(w)
                        uses.append(n)
                        parts.append((0, 0, 0.0, 0.0))
                row.append(i)
                copies.append(1)
                word.append(None)
                uses.append(0)
                known = [f[1] for f in found]
                parts.append(
                    (len(found), sum(known), math.fsum(f[2] for f in found), math.fsum(f[3] for f in found))
                )
            at = pa.array(row, pa.int64())
            columns = [batch.column(k).take(at) for k in range(3)]
            columns += [pa.array(copies, pa.int64()), pa.array(word, pa.binary()), pa.array(uses, pa.int64())]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns += [pa.array(values, kind) for values, kind in zip(zip(*parts), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=rest_schema.names)

        return work

    # One pass gives each row's sum over common words and, apart, its rare words.
    every = map_texts(keyed, keyed.columns, rest_schema, start)
    own = every.filter(F.col("word").isNull()).select(*keys, "copies", *_SUMS)
    known = words.select("word", "n", "log")
    rare = (
        every.filter(F.col("word").isNotNull())
        .select(*keys, "word", "uses")
        .join(known, "word")
        .select(
            *keys,
            F.lit(0).cast("bigint").alias("copies"),
            F.col("uses").alias("n_tokens"),
            F.when(F.col("n") > 0, F.col("uses")).otherwise(0).alias("n_known"),
            (F.col("uses") * base).alias("base"),
            (F.col("uses") * F.col("log")).alias("model"),
        )
    )
    total = own.unionByName(rare).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("copies", *_SUMS)))
    # Rows that repeat id and text were summed together and come back as such.
    each = total.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda c: F.col(c) / F.col("copies")
    return each.select(
        id_column,
        train_column,
        share("n_tokens").cast("bigint").alias("n_tokens"),
        share("n_known").cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        share("base").alias("base_score"),
        (share("model") / LN10).alias("score"),
    )
