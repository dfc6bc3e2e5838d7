"""Packing: ids, pieces, the fit and the places, against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import packing
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(n))


ODD = [None, "", " ", "  a  b ", "x\n\ny z", "tab\tand blank  wide", "it's we'll 'tis", "<|endoftext|> a<|endoftext|>", "語学 学ぶ 😀 é", " lead", "1 2 34 ...", "a\x1cb \x1c c", "İ K"]


def check(rows, out, capacity):
    """Every piece once, as cut from its document; sequences without gaps and overlaps."""
    docs = defaultdict(list)
    for d, t in rows:
        found = ids_of(t)
        first = len(found) - (len(found) - 1) // capacity * capacity
        borders = [0, *range(first, len(found) + 1, capacity)]
        for i, (a, b) in enumerate(zip(borders, borders[1:])):
            docs[d].append((i, a, b - a, zlib.crc32(np.array(found[a:b], "<u4").tobytes())))
    got, places = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(p) for d, p in docs.items()}
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return places


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_ids_are_those_of_the_tokenizer():
    encoder = packing.encoder(open(TOKENIZER, encoding="utf-8").read())
    r = random.Random(1)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", " ", "7", "...", "é", "語", " ", "<|endoftext|>", "\x1c", "'", "ll", "'T", ".", "ß", "Œ", "×", "<", "_", "²", "½", "ǅ", "\x85", "word", "w" * 70]
    texts = [t or "" for t in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(4000)]
    for found, text in zip(encoder.encode(texts), texts):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(text)[:-1], text


def test_cuts():
    assert [list(packing.cuts(n, 4)) for n in (1, 4, 5, 8, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 4), (4, 4)], [(0, 1), (1, 4), (5, 4)]]


def test_the_fit_is_the_least_squares_solution():
    """No pattern's count can change in the direction that would lower the error."""
    r = np.random.default_rng(2)
    capacity = 30
    histogram = r.integers(0, 50, capacity + 1)
    histogram[0] = 0
    blocks = packing.patterns(np.flatnonzero(histogram), capacity)
    rows = np.concatenate(blocks)
    assert (rows.sum(axis=1) == capacity).all() and (np.diff(rows, axis=1) >= 0).all()
    want = sum(1 for a in range(capacity + 1) for b in range(a, capacity + 1) for c in range(b, capacity + 1) if a + b + c == capacity and all(n == 0 or histogram[n] for n in (a, b, c)))
    assert len({tuple(x) for x in rows.tolist()}) == len(rows) == want
    counts = np.concatenate(packing.fit(histogram, blocks, sweeps=3000))
    sums = np.zeros((capacity + 1, len(rows)))
    for column in rows.T:
        sums[column, np.arange(len(rows))] += 1
    sums[0] = 0
    slope = sums.T @ (sums @ counts - histogram)
    assert (counts >= 0).all()
    assert slope.min() > -0.05 and np.abs(slope[counts > 1e-6]).max() < 0.05


@pytest.mark.parametrize("kind", ["uniform", "short", "long", "same", "few", "ones", "hot"])
def test_plans_use_every_piece_and_few_sequences(kind):
    r = np.random.default_rng(3)
    capacity = 128
    lengths = {
        "uniform": r.integers(1, 129, 3000),
        "short": r.integers(1, 30, 3000),
        "long": r.integers(70, 129, 500),
        "same": np.full(999, 43),
        "few": r.integers(1, 129, 7),
        "ones": np.ones(500, int),
        "hot": np.concatenate([np.full(2000, 128), np.full(2000, 50), r.integers(1, 129, 500)]),
    }[kind]
    histogram = np.bincount(lengths, minlength=capacity + 1)
    used = np.zeros_like(histogram)
    sequences = 0
    for count, parts in packing.arrange(histogram, capacity):
        assert sum(n * t for n, t in parts) <= capacity
        sequences += count
        for n, t in parts:
            used[n] += count * t
    assert (used == histogram).all()
    assert sequences <= 1.01 * best_fit(lengths.tolist(), capacity) + 1
    if kind in ("uniform", "short"):
        assert sequences <= 1.01 * lengths.sum() / capacity + 1
    assert len(packing.plan(histogram, capacity)[0]) < 10 * capacity**2


def test_packed_documents(docs):
    r = random.Random(4)
    rows = [(i, words(i, r.choice([0, 1, 5, 30, 80, 200, 400]))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, rows[5][1]), (5, "other"), (None, "no id"), (None, None)]
    rows += [(2000 + i, rows[7][1]) for i in range(100)] + [(3000, words(9, 40_000)), (3001, "w" * 5000)]
    out = packing.pack(docs(rows).repartition(5), TOKENIZER, capacity=512, ids=True)
    found = out.collect()
    places = check(rows, found, 512)
    lengths = [r.length for r in found]
    assert len(places) <= 1.02 * best_fit(lengths, 512)
    joined = {r.sequence_id: (np.frombuffer(r.ids, "<u4").tolist(), r.length) for r in packing.sequences(out).collect()}
    assert joined.keys() == places.keys()
    assert all(len(ids) == n <= 512 for ids, n in joined.values())
    for r in found:
        at = joined[r.sequence_id][0][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(at, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_few_rows(docs, rows):
    check(rows, packing.pack(docs(rows), TOKENIZER).collect(), 2048)


def test_the_query_packs_all_documents(spark):
    from plumbline.llm.queries import QUERIES

    out = QUERIES["op12_pattern_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    places = check([(r.doc_id, r.text) for r in docs], out, 2048)
    assert len(places) <= 1.02 * sum(r.length for r in out) / 2048 + 1
