"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Cyclic boosting goes round the features;
each round fits a shallow tree to one feature's residuals and adds it to that
feature's lookup table. Pairs of features whose residuals gain most from a
common table are then boosted the same way. A text's score is a sum of looked-up
values, one per table.

Features are computed by Spark over all texts. The tables are fitted on the
driver on at most ``MAX_ROWS`` labelled rows, chosen by a hash of the id; that
bound is a parameter.

Defined results: NULL text is the empty text, which has a score as well. Rows
without a label or an id teach nothing; several labels of a document count as
several rows. Without labels every score is 0.5; with one class alone scores
follow its smoothed share. Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, schema_of, stored, texts_of

MAX_ROWS = 50_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.15
LEAF_WEIGHT, PENALTY = 5.0, 1.0

FEATURES = (
    "log_bytes",
    "log_words",
    "word_length",
    "longest_word",
    "letters",
    "capitals",
    "digits",
    "non_ascii",
    "stops",
    "symbols",
    "bars",
    "distinct_words",
    "distinct_lines",
    "words_per_line",
    "short_words",
    "capital_words",
    "common_symbol",
)


def _members(characters: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in characters]] = 1
    return out


_LOWER = _members("abcdefghijklmnopqrstuvwxyz")
_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _members("0123456789")
_HIGH = (np.arange(256) >= 128).astype(float)
_STOPS = _members(".,;:!?")
_SYMBOLS = _members("#$%&*+<=>@[\\]^_`{|}~/")
_BARS = _members("|")
_CLASSES = np.stack([_LOWER + _UPPER + _HIGH, _UPPER, _DIGITS, _HIGH, _STOPS, _SYMBOLS, _BARS], axis=1)


def features(text: bytes) -> list[float]:
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _CLASSES) / max(size, 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = list(map(len, words)) or [0]
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = counts * _SYMBOLS
    return [
        float(np.log1p(size)),
        float(np.log1p(len(words))),
        sum(lengths) / n,
        float(max(lengths)),
        *map(float, shares),
        len(set(words)) / n,
        len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1),
        sum(x <= 2 for x in lengths) / n,
        sum(map(bytes.istitle, words)) / n,
        float(symbols.max()) / n,
    ]


def text_features(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Columns ``keep`` with ``features``, an array in the order of ``FEATURES``."""
    schema = schema_of(docs, keep, features="array<double>")
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            rows = list(map(features, texts_of(batch.column(n))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(rows, pa.list_(pa.float64()))], names=schema.names
            )

        return work

    source = docs.select(*keep, F.col(text_column).alias("_measured"))
    return map_texts(source, source.columns, schema, start)


# --- the model ----------------------------------------------------------------


@dataclass
class Additive:
    """Bin borders and lookup tables; ``scores`` is nothing but additions."""

    start: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.borders[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[
                np.searchsorted(self.coarse[a], x[:, a], side="right"),
                np.searchsorted(self.coarse[b], x[:, b], side="right"),
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(grad: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins; place 0 if there is none."""
    g, w = np.cumsum(grad), np.cumsum(weight)
    rest_g, rest_w = g[-1] - g, w[-1] - w
    gain = g**2 / (w + PENALTY) + rest_g**2 / (rest_w + PENALTY) - g[-1] ** 2 / (w[-1] + PENALTY)
    gain[(w < LEAF_WEIGHT * 0.25) | (rest_w < LEAF_WEIGHT * 0.25)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _tree(grad: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over one feature's bins."""
    if depth and len(grad) > 1:
        _, at = _best_cut(grad, weight)
        if at:
            return np.concatenate((_tree(grad[:at], weight[:at], depth - 1), _tree(grad[at:], weight[at:], depth - 1)))
    return np.full(len(grad), grad.sum() / (weight.sum() + PENALTY))


def _pair_tree(grad: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts one axis and then the other in each half; its gain."""
    best, values = 0.0, np.full(grad.shape, grad.sum() / (weight.sum() + PENALTY))
    for turned in (False, True):
        g, w = (grad.T, weight.T) if turned else (grad, weight)
        gain, at = _best_cut(g.sum(axis=1), w.sum(axis=1))
        if not at:
            # A cut of one axis may pay only after a cut of the other.
            at = g.shape[0] // 2
        if not 0 < at < g.shape[0]:
            continue
        halves, total = [], gain
        for part_g, part_w in ((g[:at], w[:at]), (g[at:], w[at:])):
            more, _ = _best_cut(part_g.sum(axis=0), part_w.sum(axis=0))
            row = _tree(part_g.sum(axis=0), part_w.sum(axis=0), 1)
            halves.append(np.broadcast_to(row, part_g.shape))
            total += more
        if total > best:
            best = total
            table = np.concatenate(halves)
            values = table.T if turned else table
    return values, best


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting of logistic loss: first single features, then pairs."""
    if not len(y):
        return Additive()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(start=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    columns = range(x.shape[1])
    model.borders = [_borders(x[:, j], BINS) for j in columns]
    model.coarse = [_borders(x[:, j], PAIR_BINS) for j in columns]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    bins = [np.searchsorted(model.borders[j], x[:, j], side="right") for j in columns]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in columns]
    total = np.full(len(y), model.start)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in columns:
            size = len(model.tables[j])
            if size < 2:
                continue
            r, w = residual()
            step = RATE * _tree(np.bincount(bins[j], r, size), np.bincount(bins[j], w, size))
            model.tables[j] += step
            total += step[bins[j]]

    def histograms(a: int, b: int):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        r, w = residual()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, r, size).reshape(shape), np.bincount(cell, w, size).reshape(shape)

    gains = []
    for a in columns:
        for b in range(a + 1, x.shape[1]):
            if len(model.coarse[a]) and len(model.coarse[b]):
                _, g, w = histograms(a, b)
                gains.append((_pair_tree(g, w)[1], a, b))
    for _, a, b in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            cell, g, w = histograms(a, b)
            step = RATE * _pair_tree(g, w)[0]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


# --- operators ----------------------------------------------------------------


def train(measured: DataFrame, labels: DataFrame, *, id_column="doc_id", label_column="quality", max_rows=MAX_ROWS) -> Additive:
    """Fit on at most ``max_rows`` labelled rows of ``measured`` (id and features)."""
    labelled = labels.select(F.col(id_column), F.col(label_column).cast("int").alias("_label")).filter(
        F.col("_label").isin(0, 1)
    )
    rows = (
        measured.select(id_column, "features")
        .join(labelled, id_column)
        .select("features", "_label", F.xxhash64(id_column).alias("_order"))
        .orderBy("_order", "_label")
        .limit(max_rows)
        .collect()
    )
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["_label"] for r in rows], float))


def score(measured: DataFrame, model: Additive, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the score and the predicted class."""
    schema = schema_of(measured, keep, score="double", predicted="int")
    shared = measured.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def start():
        tables = shared.value

        def work(batch: pa.RecordBatch):
            column = batch.column(n)
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))
            p = tables.scores(values)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                ],
                names=schema.names,
            )

        return work

    return map_texts(measured, [*keep, "features"], schema, start)


def measure(docs: DataFrame, **options) -> DataFrame:
    """Features of all texts, stored once for training and scoring."""
    return stored(text_features(docs, **options), "features")
