"""Language identification by prediction by partial matching (PPM).

Per language, counts of every byte after each context of up to ``ORDER`` bytes
form a variable-order tree. A byte unseen in a context is coded as an escape
followed by the next shorter context, without the bytes already ruled out
(escape method C with full exclusion), down to a uniform choice among bytes
never seen. The statistics are frozen after training, so code lengths are
exact and do not depend on what is scored. The language with the shortest code
wins; the score is its posterior under equal priors.

Texts of no learned language are told by code length alone (``keep_claimed``):
a language claims what its tree codes in ``LIMIT`` times the bits per byte of
the worst of its training texts. Those are part of the tree, so a labelled text
is claimed by its label; other texts have to be like the labelled ones.

Counts cover all training texts. What is broadcast is bounded: of each language
and order at most ``MAX_GRAMS`` grams are kept, the most frequent ones. A count
threshold does that, so every kept gram's shorter forms are kept as well.

Defined results: NULL text and text without a letter get ``und`` and score 0.
Rows without a language or text teach nothing. Equal code lengths go to the
language that sorts first. Without any training row every text is ``und``.
Where no language was learned, any text with a
letter is kept. Repeated rows are predicted alike. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, schema_of, stored, texts_of

ORDER = 4
MAX_GRAMS = 200_000
UNDETERMINED = "und"

# A text that was not learned takes more bits than one that was, but a language
# claims no code of a byte's own 8 bits. The slack lets a short text hold a few
# bytes never seen; the least limit is for training texts that are copies.
LIMIT = 2.5
LEAST_LIMIT, MOST_LIMIT = 4.0, 8.0
SLACK_BITS = 64.0

# Bytes of text coded at once, and grams whose costs a task remembers.
PIECE = 1 << 19
REMEMBERED = 1 << 18

# Shares in which a language's grams of one order reach the driver.
SHARES = 16

_PAD = b"\0" * ORDER


def _mask(order: int) -> np.int64:
    return np.int64((1 << (8 * (order + 1))) - 1)


def pieces(texts: list[bytes]):
    """(index of text, piece with its context in front), of bounded size."""
    for i, text in enumerate(texts):
        for s in range(0, len(text), PIECE):
            yield i, (_PAD + text[max(0, s - ORDER) : s])[-ORDER:] + text[s : s + PIECE]


def piece_blocks(texts: list[bytes]):
    group, size = [], 0
    for piece in pieces(texts):
        group.append(piece)
        size += len(piece[1])
        if size >= PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def grams(group) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its context as one number, and the text it belongs to."""
    data = np.frombuffer(b"".join(p for _, p in group), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(p) for _, p in group), np.int64, len(group))
    key = data.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= data[:-k] << np.int64(8 * k)
    starts = np.cumsum(lengths) - lengths
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[starts + k] = False
    owner = np.repeat(np.fromiter((i for i, _ in group), np.int64, len(group)), lengths - ORDER)
    return key[real], owner


def count_grams(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """lang, gram, n over all rows that have both a text and a language."""

    def start():
        def work(batch: pa.RecordBatch):
            langs = batch.column(0).to_pylist()
            texts = texts_of(batch.column(1))
            for lang in sorted(set(langs)):
                for group in piece_blocks([t for t, x in zip(texts, langs) if x == lang]):
                    keys, _ = grams(group)
                    codes, found = pd.factorize(keys)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(found), pa.string()),
                            pa.array(found, pa.int64()),
                            pa.array(np.bincount(codes, minlength=len(found)), pa.int64()),
                        ],
                        names=["lang", "gram", "n"],
                    )

        return work

    rows = docs.filter(F.col(lang_column).isNotNull() & (F.length(text_column) > 0))
    counted = map_texts(rows, [lang_column, text_column], "lang string, gram bigint, n bigint", start)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def tree_counts(counted: DataFrame) -> DataFrame:
    """Counts of the grams of every order with their level.

    A level is a sixteenth of an octave of counts: few levels, whatever the counts.
    """
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("ord")
    spread = counted.select("lang", "gram", "n", orders)
    shorter = F.col("gram").bitwiseAND(F.element_at(F.array(*(F.lit(int(_mask(k))) for k in range(ORDER + 1))), F.col("ord") + 1))
    every = spread.groupBy("lang", "ord", shorter.alias("gram")).agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 16)
    return every.withColumn("level", level)


def _pack(group: pa.Table) -> pa.Table:
    """One row of a share of a language's grams of one order, and their counts."""
    return pa.table(
        {
            "lang": group.column("lang").slice(0, 1),
            "ord": group.column("ord").slice(0, 1),
            "grams": pa.array([group.column("gram").to_numpy().tobytes()], pa.binary()),
            "counts": pa.array([group.column("n").to_numpy().tobytes()], pa.binary()),
        }
    )


Counts = dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]


def _collect(counted: DataFrame, max_grams: int) -> Counts:
    """Grams and counts by language and order; at most ``max_grams`` of each."""
    every = stored(tree_counts(counted), "grams")
    sizes = every.groupBy("lang", "ord", "level").agg(F.count("*").alias("grams"))
    spark = counted.sparkSession
    by: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in sizes.collect():
        by.setdefault((r.lang, r.ord), []).append((r.level, r.grams))
    floors = []
    for (lang, order), levels in by.items():
        room, lowest = max_grams, max(levels)[0] + 1
        for level, size in sorted(levels, reverse=True):
            room -= size
            if room < 0:
                break
            lowest = level
        floors.append((lang, order, lowest))
    limits = spark.createDataFrame(floors, "lang string, ord int, floor bigint")
    # Above the floor a group is small by choice of the floor; shares of it are packed.
    packed = (
        every.join(F.broadcast(limits), ["lang", "ord"])
        .filter("level >= floor")
        .select("lang", "ord", "gram", "n")
        .groupBy("lang", "ord", F.pmod(F.xxhash64("gram"), F.lit(SHARES)))
        .applyInArrow(_pack, "lang string, ord int, grams binary, counts binary")
    )
    shares: dict[tuple[str, int], list] = {}
    for r in packed.collect():
        shares.setdefault((r.lang, r.ord), []).append((r.grams, r.counts))
    out: Counts = {}
    for (lang, order), parts in shares.items():
        gram = np.frombuffer(b"".join(g for g, _ in parts), np.int64)
        n = np.frombuffer(b"".join(c for _, c in parts), np.int64)
        at = np.argsort(gram)
        out.setdefault(lang, {})[order] = (gram[at], n[at])
    return out


class Tree:
    """Code lengths of one language, in bits."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``counts``: by order, grams in ascending order and their counts."""
        self.grams, self.costs = [], []
        self.contexts, self.escape, self.total, self.distinct = [], [], [], []
        self.excluded: list[np.ndarray] = []
        self.count = []
        below = None
        for order in range(ORDER + 1):
            gram, n = counts.get(order, (np.empty(0, np.int64), np.empty(0, np.int64)))
            if order:
                # A gram without its shorter form has no place in the tree.
                at, known = _find(below, gram & _mask(order - 1))
                gram, n, at = gram[known], n[known], at[known]
            context, where, distinct = np.unique(gram >> np.int64(8), return_inverse=True, return_counts=True)
            self.grams.append(gram)
            self.count.append(n)
            self.contexts.append(context)
            self.total.append(np.bincount(where, n, len(context)))
            self.distinct.append(distinct.astype(np.float64))
            # What the bytes seen here weigh in the next shorter context.
            self.excluded.append(
                np.bincount(where, self.count[order - 1][at], len(context)) if order else np.zeros(len(context))
            )
            below = gram

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its context."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        gone_total = np.zeros(len(keys))
        gone_distinct = np.zeros(len(keys))
        for order in range(ORDER, -1, -1):
            key = keys[todo] & _mask(order)
            c, known = _find(self.contexts[order], key >> np.int64(8))
            g, seen = _find(self.grams[order], key)
            c = np.where(known, c, 0)
            if not len(self.contexts[order]):
                continue
            total = np.where(known, self.total[order][c] - gone_total[todo], 0)
            new = np.where(known, self.distinct[order][c] - gone_distinct[todo], 0)
            weight = np.where(seen, self.count[order][np.where(seen, g, 0)], new)
            room = total + new
            # A context all of whose bytes are ruled out adds no bits.
            open_ = known & (room > 0) & (weight > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[todo] += np.where(open_, np.log2(room) - np.log2(weight), 0)
            gone_total[todo] = np.where(known, self.excluded[order][c], gone_total[todo])
            gone_distinct[todo] = np.where(known, self.distinct[order][c], gone_distinct[todo])
            todo = todo[~seen]
        out[todo] += np.log2(np.maximum(256 - gone_distinct[todo], 1))
        return out


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, keys)
    at[at == len(sorted_)] = 0
    return at, (sorted_[at] == keys) if len(sorted_) else np.zeros(len(keys), bool)


class LanguageModel:
    """Trees of all languages, and what a task remembers of their costs."""

    def __init__(self, counts: Counts):
        self.langs = sorted(counts)
        self.trees = [Tree(counts[lang]) for lang in self.langs]
        self._shared = None

    def shared(self, docs: DataFrame):
        """The model as a broadcast, one for all its uses."""
        if self._shared is None:
            self._shared = docs.sparkSession.sparkContext.broadcast(self)
        return self._shared

    def scorer(self):
        known, costs = np.empty(0, np.int64), np.empty((len(self.langs), 0))

        def score(texts: list[bytes]) -> np.ndarray:
            """Bits of each text (columns) in each language (rows)."""
            nonlocal known, costs
            out = np.zeros((len(self.langs), len(texts)))
            for group in piece_blocks(texts):
                keys, owner = grams(group)
                codes, found = pd.factorize(keys)
                at, there = _find(known, found)
                fresh = np.sort(found[~there])
                if len(fresh):
                    if len(known) > REMEMBERED:
                        known, costs = known[:0], costs[:, :0]
                        fresh = np.sort(found)
                    order = np.argsort(np.concatenate((known, fresh)), kind="stable")
                    known = np.concatenate((known, fresh))[order]
                    costs = np.concatenate((costs, [t.bits(fresh) for t in self.trees]), axis=1)[:, order]
                    at, _ = _find(known, found)
                first, last = owner[0], owner[-1] + 1
                for row, cost in zip(out, costs):
                    row[first:last] += np.bincount(owner - first, cost[at][codes], last - first)
            return out

        return score


def train(docs: DataFrame, *, text_column="text", lang_column="lang", max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Count all rows of ``docs`` that have a language, and freeze the trees."""
    return LanguageModel(_collect(count_grams(docs, text_column, lang_column), max_grams))


def has_letter(text: bytes) -> bool:
    return next(filter(str.isalpha, text.decode("utf-8", "replace")), None) is not None


def predict(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ("doc_id",), text_column="text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score and bits_per_byte of each text."""
    shared = model.shared(docs)
    schema = schema_of(docs, keep, lang_pred="string", score="double", bits_per_byte="double")
    n = len(keep)
    langs = [*model.langs, UNDETERMINED]

    def start():
        score = shared.value.scorer() if len(langs) > 1 else None

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch.column(n))
            usable = np.fromiter(map(has_letter, texts), bool, len(texts)) & (len(langs) > 1)
            best = np.full(len(texts), len(langs) - 1)
            share, rate = np.zeros(len(texts)), np.zeros(len(texts))
            if usable.any():
                bits = score(texts)
                least = bits.min(axis=0)
                best = np.where(usable, bits.argmin(axis=0), best)
                share = np.where(usable, 1 / np.exp2(least - bits).sum(axis=0), 0.0)
                size = np.maximum([len(t) for t in texts], 1)
                rate = np.where(usable, least / size, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)),
                    pa.array([langs[b] for b in best], pa.string()),
                    pa.array(share, pa.float64()),
                    pa.array(rate, pa.float64()),
                ],
                names=schema.names,
            )

        return work

    source = docs.select(*keep, F.col(text_column).alias("_coded"))
    return map_texts(source, source.columns, schema, start)


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_column="text", min_score: float = 0.0) -> DataFrame:
    """``docs`` without texts that are ``und`` or whose posterior is below ``min_score``.

    Without a learned language there is nothing to reject by but the letter.
    """
    shared = model.shared(docs)
    at, some = docs.columns.index(text_column), bool(model.langs)

    def start():
        score = shared.value.scorer() if some else None

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            keep = np.fromiter(map(has_letter, texts), bool, len(texts))
            if some and min_score > 0 and keep.any():
                bits = score(texts)
                keep &= 1 / np.exp2(bits.min(axis=0) - bits).sum(axis=0) >= min_score
            yield batch.filter(pa.array(keep, pa.bool_()))

        return work

    return map_texts(docs, docs.columns, docs.schema, start)


def claim_limits(docs: DataFrame, model: LanguageModel, *, text_column="text", lang_column="lang") -> dict[str, float]:
    """By language, the most bits per byte of a text it claims; from its training texts ``docs``."""
    shared = model.shared(docs)
    row = {lang: k for k, lang in enumerate(model.langs)}

    def start():
        score = shared.value.scorer()

        def work(batch: pa.RecordBatch):
            own = np.array([row[x] for x in batch.column(0).to_pylist()])
            texts = texts_of(batch.column(1))
            rate = (score(texts)[own, np.arange(len(texts))] - SLACK_BITS) / [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate, pa.float64())], names=["lang", "rate"])

        return work

    rows = docs.filter(F.col(lang_column).isNotNull() & (F.length(text_column) > 0))
    rates = map_texts(rows, [lang_column, text_column], "lang string, rate double", start)
    worst = rates.groupBy("lang").agg(F.max("rate").alias("rate")).collect()
    return {r.lang: min(max(LIMIT * r.rate, LEAST_LIMIT), MOST_LIMIT) for r in worst}


def keep_claimed(
    docs: DataFrame, model: LanguageModel, limits: dict[str, float], *, text_column="text", lang_column="lang"
) -> DataFrame:
    """``docs`` without texts that have no letter or that no language claims.

    The language of what stays is that of the shortest code among those that claim the
    text, whatever the label said; without a learned language labels stay.
    """
    shared = model.shared(docs)
    at = docs.columns.index(text_column)
    place = docs.columns.index(lang_column)
    langs = np.array(model.langs, object)
    most = np.array([[limits[lang]] for lang in model.langs])

    def start():
        score = shared.value.scorer() if len(most) else None

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            keep = np.fromiter(map(has_letter, texts), bool, len(texts))
            if len(most) and keep.any():
                size = np.array([len(t) for t in texts])
                bits = score(texts)
                claims = bits <= most * size + SLACK_BITS
                keep &= claims.any(axis=0)
                told = langs[np.where(claims, bits, np.inf).argmin(axis=0)]
                columns = [*batch.columns]
                columns[place] = pa.array(told, columns[place].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch.filter(pa.array(keep, pa.bool_()))

        return work

    return map_texts(docs, docs.columns, docs.schema, start)
