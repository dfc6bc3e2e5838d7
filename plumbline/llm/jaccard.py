"""Similarity join on sets of word n-grams, with signature trees.

Two texts link when the Jaccard similarity of their sets reaches a threshold.
The join is exact over 64-bit hashes of the n-grams:

1. Texts with the same set form a class; one member stands for it.
2. Prefix filter. Under one order of all n-grams, two sets that are similar
   enough share one of their first n-grams. The order puts n-grams last that a
   sample finds frequent: the order steers cost and cannot change the result.
   N-grams whose blocks have the same members are one block.
3. Each block is joined by a signature tree over small bitmaps of the sets:
   members sorted by size, nodes with the OR of their members' bitmaps, the
   range of sizes and the least number of bits. Two nodes are traversed together
   and left as soon as the largest possible overlap is below what the smallest
   sizes would need. Members without a surviving partner go; that is nearly all.
4. What survives is compared exactly, on whole sets: first in two blocks of each
   text, which connects groups of copies. Of the other blocks, those members
   follow that the trees leave with a partner of another component, in the one
   block that counts for the pair: members, never pairs, are written.
5. A block above ``BLOCK`` members is cut at random, differently for every
   n-gram. Members of different cuts that other blocks have not connected by
   then are joined in a last round: the largest component of a block stays in
   its cuts, the others visit them.
6. Components of the links; every member of a class gets its component.

Links are found between different sets; inside a class no pairs are made. Pairs
whose ends are connected by other links need not be compared, so the links
given are enough for the components but are not all links.

Defined results: a NULL or empty text has no n-grams and links with nothing.
Fewer words than n are one n-gram; texts of any length have whole sets. A row
with a NULL id links with nothing and has a NULL component. Rows that repeat an
id are rows of their own, each with the component of its own text. Of a
component ``keep_one`` keeps one row of the smallest id, any of them where
several have it. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ASCII_LOWER, bounded, few, map_texts, mix64, schema_of, stored, texts_of
from plumbline.llm.components import components

SIZE, MIN_PERCENT = 4, 85

# Members of a block, of a leaf, and children of a node.
BLOCK, LEAF, FAN = 128, 8, 4

# Rows of cells that are worth a task.
CELL_ROWS = 1_000

# Bytes of bitmaps compared at once.
COMPARED_BYTES = 4 << 20

# Blocks of a text that are compared before the others. Two let groups that are cut
# at random grow together.
FIRST_BLOCKS = 2

# One text in so many is counted to find frequent n-grams; those seen at least
# so often, and at most so many of them (16 bytes each), are put last.
SAMPLE, SEEN, LISTED = 16, 3, 1 << 17

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def ngram_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(len(w) - size + 1, 1)
    h = np.zeros(count, np.uint64)
    for k in range(min(size, len(w))):
        h = h * _FACTOR + w[k : k + count]
    return np.unique(mix64(h + np.uint64(min(size, len(w)))))


def prefix_length(n: int, percent: int) -> int:
    """How many first n-grams of a set hold one of any similar set's."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _prefix(grams: np.ndarray, percent: int, listed: np.ndarray, seen: np.ndarray) -> np.ndarray:
    n = len(grams)
    weight = np.zeros(n, np.int64)
    if len(listed) and n:
        at = np.minimum(np.searchsorted(listed, grams), len(listed) - 1)
        weight = np.where(listed[at] == grams, seen[at], 0)
    # By frequency, then by a hash of the hash, for an order without pattern.
    order = np.lexsort((mix64(grams), weight))
    return grams[order[: prefix_length(n, percent)]]


def frequent_ngrams(docs: DataFrame, id_column: str, text_column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that a sample of texts finds frequent, and how often, sorted by hash."""

    def start():
        def work(batch: pa.RecordBatch):
            sets = [ngram_set(t, size) for t in texts_of(batch.column(0))]
            grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64), pa.int64())], names=["gram"])

        return work

    some = docs.filter(F.pmod(F.xxhash64(id_column), F.lit(SAMPLE)) == 0)
    counts = (
        map_texts(some, [text_column], "gram bigint", start)
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= SEEN)
        .orderBy(F.desc("n"), "gram")
        .limit(LISTED)
        .select(F.col("gram"), F.col("n"))
    )
    rows = counts.collect()
    grams = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    seen = np.array([r.n for r in rows], np.int64)
    order = np.argsort(grams)
    return grams[order], seen[order]


def _width(n: int) -> int:
    """Bits of a set's bitmap: two to four for every n-gram."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def bitmap(grams: np.ndarray, width: int) -> np.ndarray:
    """Bits of the n-grams, as bytes; ``width`` is a power of two, 64 or more."""
    flags = np.zeros(width, np.uint8)
    flags[(grams >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(flags)


def signatures(docs: DataFrame, id_column: str, text_column: str, size: int, percent: int) -> DataFrame:
    """What is known of every text's set: n, digest, prefix and bitmap, and a number for the row.

    ``_text`` is a digest of the text itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(docs, id_column, text_column, size))
    schema = schema_of(
        docs, [id_column], _row="bigint", _text="binary", _n="bigint", _digest="binary", _prefix="array<bigint>", _bits="binary"
    )

    def start():
        listed, seen = shared.value
        row = TaskContext.get().partitionId() << 36

        def work(batch: pa.RecordBatch):
            nonlocal row
            texts = texts_of(batch.column(1))
            n, digests, prefixes, bits = [], [], [], []
            for text in texts:
                grams = ngram_set(text, size)
                n.append(len(grams))
                digests.append(hashlib.sha256(grams.tobytes()).digest()[:16] if len(grams) else None)
                prefixes.append(_prefix(grams, percent, listed, seen).view(np.int64))
                bits.append(bitmap(grams, _width(len(grams))).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.arange(row, row + len(texts))),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                ],
                names=schema.names,
            )
            row += len(texts)

        return work

    return map_texts(docs, [id_column, text_column], schema, start)


# --- the tree -----------------------------------------------------------------


class SignatureTree:
    """Nodes over the members of a block; level 0 are the members themselves.

    A node has the OR of the bitmaps below it, the least number of bits of a
    member, and the least and largest set size.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        """``bitmaps``: a row of bytes for each member, all of one width."""
        words = np.ascontiguousarray(bitmaps).view(np.uint64)
        # Similar members next to each other: by size, then by first bits.
        self.order = np.lexsort((words[:, 0], sizes))
        bits = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        o = self.order
        self.levels = [(words[o], bits[o], sizes[o], sizes[o])]
        fan = LEAF
        while len(self.levels[-1][1]) > 1:
            ors, least, low, high = self.levels[-1]
            cuts = np.arange(0, len(least), fan)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(ors, cuts, axis=0),
                    np.minimum.reduceat(least, cuts),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                )
            )
            fan = FAN

    def _may_reach(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs below which two members may be similar enough."""
        ors, least, low, high = self.levels[level]
        out = np.empty(len(a), bool)
        step = max(COMPARED_BYTES // ors.itemsize // ors.shape[1], 1)
        for s in range(0, len(a), step):
            x, y = a[s : s + step], b[s : s + step]
            shared = np.bitwise_count(ors[x] & ors[y]).sum(axis=1, dtype=np.int64)
            # A bit that the other side lacks is an n-gram it lacks.
            most = np.minimum(
                high[x] - np.maximum(least[x] - shared, 0), high[y] - np.maximum(least[y] - shared, 0)
            )
            # overlap / (sizes - overlap) >= percent / 100, for the smallest sizes.
            out[s : s + step] = (100 + percent) * most >= percent * (low[x] + low[y])
        return out

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members that the bounds leave, as places in the block."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            count = len(self.levels[level - 1][1])
            fan = LEAF if level == 1 else FAN
            keep = self._may_reach(level, a, b, percent)
            a, b = a[keep], b[keep]
            # Children of a pair of nodes: each with each, once.
            step = np.arange(fan)
            a, b = np.broadcast_arrays(
                (a[:, None] * fan + step)[:, :, None], (b[:, None] * fan + step)[:, None, :]
            )
            a, b = a.ravel(), b.ravel()
            inside = (a < count) & (b < count) & (a <= b)
            a, b = a[inside], b[inside]
        apart = a < b
        a, b = a[apart], b[apart]
        keep = self._may_reach(0, a, b, percent) if len(a) else np.zeros(0, bool)
        return self.order[a[keep]], self.order[b[keep]]


def candidates(bits: list[np.ndarray], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members the trees leave, for bitmaps of different widths.

    Members of one width share a tree. Sizes of similar sets are close, so their
    widths are the same or neighbours; a wider bitmap folds to the narrower by
    OR of its halves.
    """
    widths = np.fromiter(map(len, bits), np.int64, len(bits))
    left, right = [], []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        rows = np.stack([bits[i] for i in own])
        if len(own) > 1:
            a, b = SignatureTree(rows, sizes[own]).pairs(percent)
            left.append(own[a])
            right.append(own[b])
        largest = sizes[own].max() * 100 // percent
        next_ = np.flatnonzero((widths == 2 * width) & (sizes <= largest))
        if len(next_):
            wide = np.stack([bits[i] for i in next_])
            both = np.concatenate((own, next_))
            folded = np.concatenate((rows, _fold(wide)))
            a, b = SignatureTree(folded, sizes[both]).pairs(percent)
            cross = (a < len(own)) != (b < len(own))
            left.append(both[a[cross]])
            right.append(both[b[cross]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _fold(rows: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: a bit's place loses its highest binary digit."""
    half = rows.shape[1] // 2
    return rows[:, :half] | rows[:, half:]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def join_block(sets: list[np.ndarray], groups: list, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar in a block.

    ``groups`` names what is connected already. ``sides`` restricts to pairs
    of different sides.
    """
    if len(sets) < 2:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    # Wider than what was sent around: whole sets are here.
    bits = [bitmap(g, 4 * _width(len(g))) for g in sets]
    a, b = candidates(bits, sizes, percent)
    if sides is not None:
        cross = sides[a] != sides[b]
        a, b = a[cross], b[cross]
    names: dict = {}
    root = np.array([names.setdefault(g, len(names)) for g in groups])
    links = []
    # Members in turn; what has been connected meanwhile is not compared.
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    while len(a):
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        if not len(a):
            break
        some, more = slice(0, 64), slice(64, None)
        for x, y in zip(a[some].tolist(), b[some].tolist()):
            if root[x] != root[y] and similar(sets[x], sets[y], percent):
                links.append((x, y))
                root[root == root[y]] = root[x]
        a, b = a[more], b[more]
    return links


# --- the distributed join -------------------------------------------------------


def _blocks(prefixes: DataFrame, most: int) -> DataFrame:
    """(_rep, _gram, _size): n-grams in the prefixes of two members at least.

    Of n-grams with the same members one is kept. ``most`` bounds the rows of ``prefixes``.
    """
    counts = few(prefixes.groupBy("_gram").agg(F.count("*").alias("_size")), most)
    shared = stored(counts.filter("_size > 1"), "shared-grams")
    rows = stored(few(prefixes.join(shared, "_gram"), most), "shared-rows")
    most = rows.count()
    of = F.col("_rep")
    members = rows.groupBy("_gram", "_size").agg(
        F.min(of).alias("_low"),
        F.max(of).alias("_high"),
        F.bit_xor(F.xxhash64(of)).alias("_x"),
        F.sum(F.xxhash64(of, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))).alias("_y"),
    )
    same = few(members, most).filter("_low <> _high").groupBy("_size", "_low", "_high", "_x", "_y")
    least = few(same.agg(F.min("_gram").alias("_gram")).select("_gram"), most)
    return rows.join(stored(least, "blocks"), "_gram")


def _by_cell(rows: DataFrame, most: int, work, schema: str) -> DataFrame:
    """Run ``work`` over the rows of each ``_cell``, a list of tuples at a time.

    Rows are dealt by cell and sorted, and cells are read one after the other:
    most have a handful of members, too few for a call of their own. ``most``
    tells about how many rows there are.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, kinds = None, [], None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != cell:
                    if len(members) > 1:
                        yield from work(members, kinds)
                    cell, members = row[0], []
                members.append(row)
        if len(members) > 1:
            yield from work(members, kinds)

    dealt = few(rows, most, CELL_ROWS).select("_cell", *[n for n in names if n != "_cell"]).repartition("_cell")
    return few(dealt, most, CELL_ROWS).sortWithinPartitions("_cell").mapInArrow(run, schema)


def _active(cells: DataFrame, most: int, bits: DataFrame, percent: int) -> DataFrame:
    """Rows of ``cells`` (_rep, _cell, _side, _group) that have a surviving partner."""
    kind = dict(cells.dtypes)["_rep"]

    def work(members: list[tuple], kinds: list[pa.DataType]):
        sizes = np.array([m[4] for m in members], np.int64)
        a, b = candidates([np.frombuffer(m[5], np.uint8) for m in members], sizes, percent)
        side = np.array([m[2] for m in members])
        names: dict = {}
        group = np.array([names.setdefault(m[3], len(names)) for m in members])
        open_ = ((side[a] == 0) | (side[a] != side[b])) & (group[a] != group[b])
        kept = [members[k] for k in np.union1d(a[open_], b[open_]).tolist()]
        if kept:
            columns = list(zip(*kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[1], kinds[1]), pa.array(columns[0], kinds[0]), pa.array(columns[2], kinds[2])],
                names=["_rep", "_cell", "_side"],
            )

    rows = cells.join(bits, "_rep").select("_cell", "_rep", "_side", "_group", "_n", "_bits")
    return _by_cell(rows, most, work, f"_rep {kind}, _cell bigint, _side int")


def _met(lists: list[np.ndarray]) -> np.ndarray:
    """Which two of the members have a number in common."""
    out = np.zeros((len(lists), len(lists)), bool)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    numbers, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    common = count[code] > 1
    owner, at = owner[common], place[code[common]]
    for first in range(0, int(at.max(initial=-1)) + 1, 2048):
        has = np.zeros((len(lists), 2048), np.float32)
        some = (at >= first) & (at < first + 2048)
        has[owner[some], at[some] - first] = 1
        out |= has @ has.T > 0
    return out


def _open_members(cells: DataFrame, bits: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Rows of ``cells`` that have a surviving partner of another group which they meet here first.

    ``_before`` lists what two members would share if they met elsewhere, too,
    so a pair counts in one cell only. A member is one row, however many
    partners it has.
    """
    kind = dict(cells.dtypes)["_rep"]

    def work(members: list[tuple], kinds: list[pa.DataType]):
        sizes = np.array([m[4] for m in members], np.int64)
        a, b = candidates([np.frombuffer(m[5], np.uint8) for m in members], sizes, percent)
        side = np.array([m[2] for m in members])
        names: dict = {}
        group = np.array([names.setdefault(m[3], len(names)) for m in members])
        open_ = ((side[a] == 0) | (side[a] != side[b])) & (group[a] != group[b])
        a, b = a[open_], b[open_]
        if len(a):
            # Only members of a pair are looked up.
            some = np.union1d(a, b)
            met = _met([np.asarray(members[k][6], np.int64) for k in some.tolist()])
            new = ~met[np.searchsorted(some, a), np.searchsorted(some, b)]
            kept = [members[k] for k in np.union1d(a[new], b[new]).tolist()]
            if kept:
                columns = list(zip(*kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[k], kinds[k]) for k in (1, 0, 2, 3)], names=["_rep", "_cell", "_side", "_group"]
                )

    rows = cells.join(bits, "_rep").select("_cell", "_rep", "_side", "_group", "_n", "_bits", "_before")
    most = cells.count() if most is None else most
    return _by_cell(rows, most, work, f"_rep {kind}, _cell bigint, _side int, _group {kind}")


def _crossing(cut: DataFrame, placed: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Cells in which members of different cuts of a block meet, and how many rows they have.

    Members of the block's largest group stay in their cut; only the others
    visit the other cuts, in shares of ``block``.
    """
    most = cut.count()
    groups = cut.groupBy("_gram", "_group").agg(F.count("*").alias("_many"), F.first("_cuts").alias("_cuts"))
    others = F.sum("_many") - F.max("_many")
    shares = F.ceil(others / block).cast("int")
    largest = few(groups, most).groupBy("_gram").agg(
        F.max_by("_group", F.struct("_many", "_group")).alias("_largest"),
        shares.alias("_shares"),
        (F.sum("_many") * shares + others * (F.first("_cuts") - 1)).alias("_visits"),
    )
    largest = stored(few(largest, most), "largest")
    visits = largest.agg(F.sum("_visits")).first()[0] or 0
    rows = cut.join(bounded(largest.drop("_visits")), "_gram")
    shares = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    home = rows.select("_rep", "_gram", "_group", F.col("_cut").alias("_at"), F.lit(1).alias("_side"), shares)
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("_cuts") - 1), lambda k: k != F.col("_cut"))).alias("_at")
    own = F.pmod(F.xxhash64("_gram", "_rep", F.lit(1)), F.col("_shares")).cast("int").alias("_share")
    guests = rows.filter("_group <> _largest").select("_rep", "_gram", "_group", others, F.lit(2).alias("_side"), own)
    # Who shares a cut has met; else the least common n-gram counts.
    here = F.collect_list(F.xxhash64("_gram", "_cut")).alias("_cells")
    met = placed.join(stored(few(cut.select("_rep").distinct(), most), "crossing"), "_rep", "left_semi").groupBy("_rep")
    met = few(met.agg(here, F.collect_list(F.when(F.col("_cuts") > 1, F.col("_gram"))).alias("_grams")), most)
    before = F.concat("_cells", F.filter("_grams", lambda g: g < F.col("_gram")))
    cells = (
        home.unionByName(guests)
        .join(stored(met, "met"), "_rep")
        .select("_rep", F.xxhash64("_gram", "_at", "_share").alias("_cell"), "_side", "_group", before.alias("_before"))
    )
    return cells, visits


def _stars(links: list[tuple[int, int]], reps: list[int]) -> list[tuple[int, int]]:
    """Links that connect the same members, each to the smallest it is connected with."""
    parent = {x: x for pair in links for x in pair}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in links:
        x, y = top(x), top(y)
        if reps[y] < reps[x]:
            x, y = y, x
        parent[y] = x
    return [(reps[x], reps[top(x)]) for x in parent if top(x) != x]


def _links(cells: DataFrame, most: int, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): who is connected inside each cell, on whole sets; short paths need few rounds later."""
    kind = dict(cells.dtypes)["_rep"]

    def work(members: list[tuple], kinds: list[pa.DataType]):
        # Rows that repeat a text may have brought its set twice.
        members = list({m[1:3]: m for m in members}.values())
        grams = [np.frombuffer(m[4], np.uint64) for m in members]
        sides = np.array([m[2] for m in members])
        found = join_block(grams, [m[3] for m in members], percent, sides if sides.any() else None)
        if found:
            a, b = zip(*_stars(found, [m[1] for m in members]))
            yield pa.RecordBatch.from_arrays([pa.array(a, kinds[1]), pa.array(b, kinds[1])], names=["a", "b"])

    rows = cells.join(sets, "_rep").select("_cell", "_rep", "_side", "_group", "_set")
    return few(_by_cell(rows, most, work, f"a {kind}, b {kind}").distinct(), most)


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """_rep and the whole set of every wanted text (_rep, _id, _text) of ``texts`` (_id, _body).

    A row that repeats id and text gives its set once a task.
    """
    joined = texts.join(bounded(stored(wanted, "wanted")), "_id").select("_rep", "_text", "_body")

    def start():
        given: set[int] = set()

        def work(batch: pa.RecordBatch):
            reps, sets = [], []
            for rep, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                if rep not in given and hashlib.sha256(text).digest() == digest:
                    given.add(rep)
                    reps.append(rep)
                    sets.append(ngram_set(text, size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], names=["_rep", "_set"])

        return work

    return map_texts(joined, joined.columns, "_rep bigint, _set binary", start)


def _grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``_group``: the component of ``_rep`` so far."""
    known = found.select(F.col("id").alias("_rep"), "component")
    return rows.drop("_group").join(bounded(known), "_rep", "left").withColumn("_group", F.coalesce("component", "_rep")).drop("component")


def _apart(rows: DataFrame, most: int, key: str) -> DataFrame:
    """Rows, ``most`` at most, whose ``key`` still has members of different groups."""
    keys = (
        rows.groupBy(key)
        .agg(F.min("_group").alias("_low"), F.max("_group").alias("_high"))
        .filter("_low <> _high")
        .select(key)
    )
    return rows.join(bounded(stored(few(keys, most), "apart")), key)


def _rows(docs: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """For every row of ``docs`` (_id, _body): _id, _text, _row, _n, _class and component_id.

    ``_class`` is the number of the row that stands for the component; NULL where
    a row links with nothing by definition.
    """
    known = stored(signatures(docs, "_id", "_body", size, percent), "signatures")
    # Rows, and n-grams in their prefixes at most.
    many, grams = known.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("_n") * (100 - percent) / 100) + 1), F.lit(0))).first()
    linked = F.col("_id").isNotNull() & (F.col("_n") > 0)
    classes = known.filter(linked).groupBy("_digest")
    classes = classes.agg(F.min("_row").alias("_of"), F.min("_id").alias("_least"), F.count("*").alias("_many"))
    classes = bounded(stored(few(classes, many).filter("_many > 1").drop("_many"), "classes"))
    member = known.join(classes, "_digest", "left").withColumns(
        {"_rep": F.when(linked, F.coalesce("_of", "_row")), "_low": F.when(F.col("_id").isNotNull(), F.coalesce("_least", "_id"))}
    )

    # One row stands for a class.
    reps = member.filter("_row = _rep")
    prefixes = reps.select("_rep", F.explode("_prefix").alias("_gram"))
    placed = stored(
        _blocks(prefixes, grams)
        .withColumn("_cuts", F.ceil(F.col("_size") / block).cast("int"))
        .withColumn("_cut", F.pmod(F.xxhash64("_rep", "_gram"), F.col("_cuts")).cast("int"))
        .drop("_size"),
        "placed",
    )
    bits = reps.select("_rep", "_n", "_bits")
    texts = docs.filter(F.col("_id").isNotNull())

    def sets_of(rows: DataFrame, most: int) -> DataFrame:
        wanted = stored(few(rows.select("_rep").distinct(), most), "with-sets")
        return _sets(texts, reps.select("_rep", "_id", "_text").join(wanted, "_rep"), size)

    # Inside cuts: who has a possible partner, and what these hold.
    inside = placed.select(
        "_rep", F.xxhash64("_gram", "_cut").alias("_cell"), F.lit(0).alias("_side"), F.col("_rep").alias("_group")
    ).distinct()
    active = stored(_active(inside, placed.count(), bits, percent), "active")
    most = active.count()
    sets = stored(sets_of(active, most), "sets")
    turn = Window.partitionBy("_rep").orderBy(F.xxhash64("_cell"), "_cell")
    some = active.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= FIRST_BLOCKS)
    links = stored(_links(some.drop("_turn").withColumn("_group", F.col("_rep")), most, sets, percent), "links")
    found = stored(components(links, "a", "b"), "components")
    rest = stored(_apart(_grouped(active, found), most, "_cell"), "rest")
    most = rest.count()
    met = stored(few(rest.groupBy("_rep").agg(F.collect_list("_cell").alias("_cells")), most), "met")
    before = F.filter("_cells", lambda c: c < F.col("_cell")).alias("_before")
    open_ = rest.join(met, "_rep").select("_rep", "_cell", "_side", "_group", before)
    open_ = stored(_open_members(open_, bits, percent, most), "open")
    more = stored(_links(open_, open_.count(), sets, percent), "links")
    # What is connected so far is stars already, which takes fewer rounds than its links.
    with_ = lambda links: found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)
    if not more.isEmpty():
        found = stored(components(with_(more), "a", "b"), "components")

    # Across cuts of a block whose members are not all connected by now.
    parts = placed.filter("_cuts > 1")
    cut = stored(_apart(_grouped(parts, found), parts.count(), "_gram"), "cut")
    crossing, visits = _crossing(cut, placed, block)
    late = stored(_open_members(crossing, bits, percent, visits), "open")
    most = late.count()
    if most:
        across = stored(_links(late, most, stored(sets_of(late, most), "sets"), percent), "links")
        found = stored(components(with_(across), "a", "b"), "components")

    least = found.join(reps.select(F.col("_rep").alias("id"), "_low"), "id").groupBy("component")
    least = stored(few(least.agg(F.min("_low").alias("_smallest")), found.count()), "least-ids")
    found = stored(found.join(bounded(least), "component"), "classes")
    named = member.join(found, F.col("_rep") == F.col("id"), "left")
    return named.select(
        "_id",
        "_text",
        "_row",
        "_n",
        F.coalesce("component", "_rep").alias("_class"),
        F.coalesce("_smallest", "_low").alias("component_id"),
    )


def similarity_classes(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SIZE,
    percent: int = MIN_PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: the id, n_shingles and component_id."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_body"))
    rows = _rows(named, size, percent, block)
    return rows.select(F.col("_id").alias(id_column), F.col("_n").alias("n_shingles"), "component_id")


def keep_one(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SIZE,
    percent: int = MIN_PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with one row of each component, of the smallest id; texts without n-grams all stay."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_body"))
    rows = stored(_rows(named, size, percent, block).filter("_class IS NOT NULL"), "near-copies")
    groups = rows.groupBy("_class").agg(F.min(F.struct("_id", "_row", "_text")).alias("_stays"), F.count("*").alias("_many"))
    stays = stored(groups.filter("_many > 1").select("_class", "_stays.*"), "stays")
    among = rows.join(stays.select("_class"), "_class", "left_semi")
    gone = stored(among.join(stays.select("_row"), "_row", "left_anti").select("_id", "_text").distinct(), "gone")
    # Rows are told apart by id and text.
    text = F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    same = lambda keys: (F.col(id_column) == keys["_id"]) & (text == keys["_text"])
    left = bounded(gone)
    kept = docs.join(left, same(left), "left_anti")
    again = stored(stays.select("_id", "_text").join(gone, ["_id", "_text"], "left_semi"), "again")
    if not again.isEmpty():
        # Rows that repeat both id and text: one of them stays.
        some = docs.join(bounded(again), same(again)).dropDuplicates(["_id", "_text"])
        kept = kept.unionByName(some.select(*docs.columns))
    return kept
