"""Operators that compare documents: exact, near and partial copies, benchmark items."""

import random

import numpy as np
import pytest
from plumbline.llm import common, decontaminate, exact_dedup, jaccard, substring
from plumbline.llm.components import components
from pyspark.sql import functions as F

from tests.llm import brute


def prose(seed, n, words=400):
    r = random.Random(seed)
    return [f"w{r.randrange(words)}" for _ in range(n)]


def mutated(words, seed, share):
    r = random.Random(seed)
    return [f"x{r.randrange(10**6)}" if r.random() < share else w for w in words]


@pytest.fixture
def corpus():
    base = prose(1, 120)
    rows = [(i, " ".join(mutated(base, i, 0.02))) for i in range(40)]
    rows += [(100 + i, " ".join(prose(100 + i, 60))) for i in range(20)]
    passage = prose(7, 45)
    rows += [(200 + i, " ".join([*prose(300 + i, 30), *passage, *prose(400 + i, 30)])) for i in range(20)]
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, "A b"), (303, "a  B"), (304, None), (305, ""), (306, " \n ")]
    rows += [(307, " ".join(["loop"] * 300)), (308, " ".join(prose(9, 30_000, 50)))]
    return rows


# --- exact --------------------------------------------------------------------


def test_chunks_rebuild_the_text_and_shift_with_it():
    text = random.Random(1).randbytes(200_000)
    chunks = exact_dedup.chunks_of(text)
    assert b"".join(chunks) == text
    assert all(len(c) <= exact_dedup.MAX_CHUNK for c in chunks)
    assert all(len(c) >= exact_dedup.MIN_CHUNK for c in chunks[:-1])
    moved = exact_dedup.chunks_of(b"new start " + text)
    assert len(set(moved) & set(chunks)) > 0.8 * len(chunks)


def test_rolling_hash_is_the_sum_over_32_bytes():
    import numpy as np

    data = np.frombuffer(random.Random(2).randbytes(100), np.uint8)
    gear = exact_dedup._GEAR
    for i in (0, 5, 31, 32, 99):
        want = sum(int(gear[data[i - k]]) << k for k in range(min(i + 1, 32))) % 2**32
        assert int(exact_dedup.rolling_hash(data)[i]) == want


def test_exact_groups(docs, corpus):
    rows = [*corpus, (None, "alone"), (None, "A b"), (5, corpus[5][1])]
    out = exact_dedup.exact_groups(docs(rows)).collect()
    assert len(out) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    by_text = {brute.sha(t): ids for t, ids in groups.items()}
    for r in out:
        ids = by_text[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None)
        assert r.group_size == len(ids)
        assert r.kept == (r.doc_id == r.keep_id)


def test_drop_duplicates_keeps_one_of_each(docs, corpus):
    rows = [*corpus, (5, corpus[5][1]), (5, corpus[5][1])]
    table = docs(rows)
    out = exact_dedup.drop_duplicates(table)
    assert out.columns == table.columns
    got = sorted((r.text or "", r.doc_id) for r in out.collect())
    want = {}
    for d, t in rows:
        want[t or ""] = max(want.get(t or "", d), d)
    assert got == sorted(want.items())


def test_an_ambiguous_identifier_stops_the_job(docs, monkeypatch):
    store = docs([(1, "a"), (2, "b")]).select(F.lit(b"x").alias("chunk_id"), F.col("text").cast("binary").alias("content"))
    assert exact_dedup.ambiguous(store).count() == 1
    monkeypatch.setattr(exact_dedup, "chunk_store", lambda *a: store)
    with pytest.raises(Exception, match="two chunks share an identifier"):
        exact_dedup.exact_groups(docs([(1, "a")])).collect()


# --- near ---------------------------------------------------------------------


@pytest.mark.parametrize("block", [8, 128])
def test_similarity_classes(docs, corpus, block):
    want = brute.similarity_classes(corpus, 4, 85)
    out = jaccard.similarity_classes(docs(corpus), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_similarity_at_the_threshold(docs):
    # 17 common of 20: 85 percent exactly; one less does not link.
    words = [f"a{i}" for i in range(20)]
    a, b = words[:20], words[:17]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(f"b{i}" for i in range(20))), (4, " ".join(f"b{i}" for i in range(16)))]
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(docs(rows), size=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_similarity_with_null_and_repeated_ids(docs, corpus):
    rows = [*corpus[:10], (3, corpus[3][1]), (None, corpus[3][1]), (None, None)]
    out = jaccard.similarity_classes(docs(rows)).collect()
    want = brute.similarity_classes(corpus[:10], 4, 85)
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == {d: c for d, (_, c) in want.items()}
    assert all(r.component_id is None for r in out if r.doc_id is None)


def test_tree_loses_no_pair():
    import numpy as np

    sets = [np.array(sorted({hash((w, 1)) % 2**63 for w in mutated(prose(k % 5, 80), k, 0.05)}), np.uint64) for k in range(90)]
    sets += [g[: len(g) // 2] for g in sets[:10]] + [np.arange(64, dtype=np.uint64) << np.uint64(20), np.arange(66, dtype=np.uint64) << np.uint64(20)]
    sizes = np.array(list(map(len, sets)))
    a, b = jaccard.candidates([jaccard.bitmap(g, jaccard._width(len(g))) for g in sets], sizes, 70)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.similar(sets[i], sets[j], 70):
                assert frozenset((i, j)) in found
    assert len(found) < 90 * 89 / 2
    assert frozenset((100, 101)) in found and jaccard._width(64) < jaccard._width(66)


def test_keep_one(docs, corpus):
    table = docs(corpus)
    out = jaccard.keep_one(table, size=5, percent=80)
    want = brute.similarity_classes(corpus, 5, 80)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_rows_that_repeat_an_id_are_rows_of_their_own(docs):
    first, other = prose(1, 60), prose(2, 60)
    near = [*first[:-1], "end"]
    rows = [(1, " ".join(first)), (5, " ".join(near)), (5, " ".join(other)), (4, " ".join([*other[:-1], "x"])), (9, "a b"), (9, "c d")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(docs(rows)).collect())
    assert got == [(1, 1), (4, 4), (5, 1), (5, 4), (9, 9), (9, 9)]
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs(rows)).collect())
    assert kept == sorted([rows[0], rows[3], rows[4], rows[5]])


def test_keep_one_of_rows_that_repeat_id_and_text(docs, corpus):
    rows = [*corpus[:6], corpus[0], corpus[0], corpus[45], corpus[45], (None, corpus[0][1]), (None, None), (304, None), (304, None)]
    kept = jaccard.keep_one(docs(rows), percent=30).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [
        (False, 0), (False, corpus[45][0]), (False, 304), (False, 304), (True, 0), (True, 0)]


def test_a_group_that_fills_many_cuts(docs):
    """One large group and some texts that share its n-grams without being similar."""
    base = prose(11, 40, 10**6)
    rows = [(i, " ".join([*base[:-1], f"v{i}"])) for i in range(120)]
    rows += [(500 + i, " ".join([*base[:30], *prose(600 + i // 2, 30, 10**6)])) for i in range(24)]
    rows += [(700 + i, " ".join([*base[10:], *prose(800 + i, 4, 10**6)])) for i in range(10)]
    want = brute.similarity_classes(rows, 2, 85)
    for block in (4, 16):
        got = jaccard.similarity_classes(docs(rows), size=2, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_open_members_are_no_more_than_the_members(spark):
    """A cell of alike members of different groups gives a row a member, not a pair."""
    sets = [np.unique(np.concatenate([np.arange(100, dtype=np.uint64) * 77777, np.array([i + 10**6], np.uint64)])) for i in range(60)]
    bits = spark.createDataFrame(
        [(i, len(s), bytearray(jaccard.bitmap(s, 512).tobytes())) for i, s in enumerate(sets)], "_rep bigint, _n bigint, _bits binary"
    )
    cells = [(i, c, 0, i, [k for k in (1, 2) if k < c]) for i in range(60) for c in (1, 2)]
    schema = "_rep bigint, _cell bigint, _side int, _group bigint, _before array<bigint>"
    out = jaccard._open_members(spark.createDataFrame(cells, schema), bits, 85).collect()
    assert sorted((r._rep, r._cell) for r in out) == [(i, 1) for i in range(60)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    got = {r.id: r.component for r in out}
    assert len(out) == len(got)
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 64 partitions that Spark itself does not merge."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_take_few_tasks(docs, spark, corpus, many_partitions, monkeypatch):
    files = {}

    def counted(table, label, stored=common.stored):
        out = stored(table, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    # Its module has the name of the function.
    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setitem(components.__globals__, "stored", counted)
    out = jaccard.similarity_classes(docs(corpus), block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.similarity_classes(corpus, 4, 85)
    assert {"classes", "shared-grams", "blocks", "active", "links", "edges", "components", "met", "open", "least-ids"} <= set(files)
    assert max(files.values()) <= max(2 * spark.sparkContext.defaultParallelism, 32), files


def test_tasks_follow_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(0, 1000, 1, 64)
    tasks = lambda *a: common.few(table, *a).rdd.getNumPartitions()
    assert tasks(0) == tasks(1000) == min(cores, 64)
    assert tasks(1000, 25) == max(40, min(cores, 64))
    assert tasks(10**9) == 64


# --- passages ---------------------------------------------------------------


@pytest.mark.parametrize("window", [4, 20])
def test_remove_repeats(docs, corpus, window):
    out = substring.remove_repeats(docs(corpus), window=window).collect()
    assert sorted(map(tuple, out)) == brute.remove_repeats(corpus, window)


def test_remove_repeats_with_null_and_repeated_ids(docs, corpus):
    words = " ".join(prose(1, 40))
    rows = [(5, words), (5, words), (None, words), (9, "tail " + words)]
    out = sorted(((r.doc_id, r.n_removed) for r in substring.remove_repeats(docs(rows)).collect()), key=str)
    # Equal places: neither is earlier; a NULL id comes last.
    assert out == sorted([(5, 0), (5, 0), (9, 40), (None, 40)], key=str)


# --- benchmark ----------------------------------------------------------------


@pytest.fixture
def items(spark):
    a = prose(50, 40)
    rows = [(1, " ".join(a)), (2, "one two three"), (3, "Two, THREE four"), (4, None), (5, "?!"), (6, " ".join(a[5:30])), (7, "one two three")]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_contamination(docs, items, block_words):
    rows_of_items, table = items
    a = prose(50, 40)
    rows = [
        (1, " ".join([*prose(60, 30), *a[3:25], *prose(61, 20), *a[30:40]])),
        (2, "zero ONE... two\nthree four"),
        (3, " ".join(a[:9])),
        (4, None),
        (5, ""),
        (6, " ".join(["one"] * 500)),
        (2, "zero ONE... two\nthree four"),
        (None, " ".join(a)),
        (8, " ".join([*prose(70, 60_000, 300), *a])),
    ]
    out = decontaminate.contamination(docs(rows), table, block_words=block_words).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    want = []
    for d, t in rows:
        n, hit, names = brute.item_hits(t, rows_of_items, 10)
        want.append((str(d), n, len(hit), len(names), brute.sha(",".join(sorted(names))), bool(hit)))
    assert got == sorted(want)


def test_decontaminate_drops_or_cuts(docs, items):
    _, table = items
    a = " ".join(prose(50, 40))
    rows = [(1, "clean text"), (2, f"before, {a}! after it all"), (3, None)]
    dropped = decontaminate.decontaminate(docs(rows), table)
    assert dropped.columns == docs(rows).columns
    assert sorted(r.doc_id for r in dropped.collect()) == [1, 3]
    cut = decontaminate.decontaminate(docs(rows), table, max_coverage=1.0).collect()
    assert {r.doc_id: r.text for r in cut} == {1: "clean text", 2: "before, ! after it all", 3: None}


@pytest.mark.parametrize("min_span", [10, 20])
def test_decontaminate_finds_short_items(docs, spark, min_span):
    short = [(size, " ".join(f"i{size}k{j}" for j in range(size))) for size in range(3, 13)]
    table = spark.createDataFrame(short, "item_id bigint, text string")
    rows = [(i, " ".join([*prose(i, 15), item, *prose(i + 50, 15)])) for i, item in short]
    rows += [(100 + i, " ".join([*prose(i, 15), *item.split()[:-1], *prose(i + 50, 15)])) for i, item in short if i < 10]
    out = decontaminate.decontaminate(docs(rows), table, min_span=min_span)
    assert sorted(r.doc_id for r in out.collect()) == [100 + i for i in range(3, 10)]
    cut = decontaminate.decontaminate(docs(rows[:1]), table, min_span=min_span, max_coverage=1.0).collect()
    assert [r.text.split() for r in cut] == [[*prose(3, 15), *prose(53, 15)]]


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_items_without_an_id_and_coverage_by_all_blocks(docs, spark, block_words):
    a, b = prose(80, 12), [w.replace("w", "v") for w in prose(81, 12)]
    table = spark.createDataFrame([(None, " ".join(a)), (None, "one two"), (2, " ".join(b))], "item_id bigint, text string")
    rows = [(1, " ".join(a)), (2, "say one two"), (3, " ".join([*b, "x", "one", "two"])), (4, " ".join([*a, *prose(82, 12, 9), *b]))]
    out = decontaminate.contamination(docs(rows), table, block_words=block_words).collect()
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in out}
    none, two = brute.sha(""), brute.sha("2")
    assert got == {1: (12, 1, none), 2: (2, 1, none), 3: (14, 2, two), 4: (24, 2, two)}
    assert decontaminate.decontaminate(docs(rows), table, block_words=block_words).count() == 0
    # Either item alone covers a third of the last document, both two thirds.
    half = decontaminate.decontaminate(docs(rows[3:]), table, block_words=block_words, max_coverage=0.5)
    assert half.count() == 0


# --- empty tables -------------------------------------------------------------


def test_empty_tables(docs, items):
    empty = docs([])
    _, table = items
    for out in (
        exact_dedup.exact_groups(empty),
        exact_dedup.drop_duplicates(empty),
        jaccard.similarity_classes(empty),
        jaccard.keep_one(empty),
        substring.remove_repeats(empty),
        decontaminate.contamination(empty, table),
        decontaminate.decontaminate(empty, table),
    ):
        assert out.count() == 0
    clean = decontaminate.contamination(docs([(1, "a b c")]), table.filter("false")).collect()
    assert [(r.n_words, r.contaminated) for r in clean] == [(3, False)]


def test_stars_connect_what_links_connect():
    r = random.Random(3)
    for _ in range(50):
        n = r.randrange(2, 30)
        links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 40))]
        links = [(x, y) for x, y in links if x != y] or [(0, 1)]
        reps = r.sample(range(1000), n)
        near = {x: {x} for x in range(n)}
        for x, y in links:
            both = near[x] | near[y]
            for z in both:
                near[z] = both
        stars = jaccard._stars(links, reps)
        named = {x for pair in links for x in pair}
        want = {(reps[x], min(reps[y] for y in near[x])) for x in named}
        assert sorted(stars) == sorted(p for p in want if p[0] != p[1])
