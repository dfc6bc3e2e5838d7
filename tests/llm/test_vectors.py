"""Vector codes: exact products, codebooks and codes against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from plumbline.llm import vector_codes
from plumbline.llm.common import prepare

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, _packed string, _id int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, label, code, error) of kept rows and the digest of the codebooks, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(v, p):
        apart = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c)) for c in books[p]]
        return min(range(len(apart)), key=lambda e: (apart[e], e)), min(apart)

    for _ in range(rounds):
        members = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for p in range(parts):
                members[p][near(v, p)[0]].append(cut(v, p))
        books = [
            [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(ms, book)] for ms, book in zip(members, books)
        ]
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    text = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **options):
    prepare(spark)
    table = spark.createDataFrame([(i, v, label, "?", "?", "?", 0) for i, v, label in rows], SCHEMA)
    codes, books = vector_codes.compress(table, **options)
    return codes.collect(), books


def check(spark, rows, **options):
    want, digest = plain(rows, **options)
    got, books = run(spark, rows, **options)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert books.digest == digest
    for r in got:
        assert r.label_error == sum(e for _, label, _, e in want if label == r.label)
    return got


def vectors(seed, n, size=16):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.gauss(0, 0.3)))
    return [(i, [f() for _ in range(size)], i % 3) for i in range(n)]


def test_products_of_any_width_are_exact():
    rng = np.random.default_rng(1)
    for bits, inner in ((10, 8), (29, 8), (28, 33), (27, 1), (24, 4096)):
        a = rng.integers(-(1 << bits), 1 << bits, (3, 5, inner))
        b = rng.integers(-(1 << bits), 1 << bits, (3, inner, 4))
        want = np.array([[[sum(int(x) * int(y) for x, y in zip(r, c)) for c in m.T] for r in n] for n, m in zip(a, b)])
        assert (vector_codes.exact_products(a, b) == want).all()
        width = vector_codes.limb_width(inner)
        assert inner << (2 * width) <= 1 << 53
        found = vector_codes.limbs(a, width)
        assert len(found) > 1 or bits <= width
        assert (sum(x.astype(np.int64) << (i * width) for i, x in enumerate(found)) == a).all()


def test_codes_equal_plain_integers(spark):
    check(spark, vectors(1, 150))


def test_wide_components_take_several_limbs(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.uniform(-30000, 30000))) for _ in range(8)], None) for i in range(60)]
    check(spark, rows, entries=4)


def test_odd_rows(spark):
    rows = vectors(3, 40, 8)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (101, [1.0, None] * 4, 1), (102, [nan] * 8, 1), (103, [0.0] * 7 + [inf], 1), (104, [-inf] * 8, 1)]
    rows += [(None, [0.5] * 8, None), (None, [0.25] * 8, None), rows[4], rows[4], (4, [0.125] * 8, 2)]
    rows += [(-5, [], 1), (-4, [0.5], 1), (-3, [-0.1] * 5, 1)]
    got = check(spark, rows)
    assert len(got) == 40 + 5 + 3


def test_ties_go_to_the_lower_entry(spark):
    rows = [(0, [0.0] * 8, 0), (1, [0.0] * 8, 0), (2, [2 / 4096] * 8, 0), (3, [1 / 4096] * 8, 0)]
    got = check(spark, rows, entries=3, rounds=0)
    assert {r.vec_id: r.code for r in got} == {0: "00" * 8, 1: "00" * 8, 2: "02" * 8, 3: "00" * 8}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 8, 1)], [(1, [], None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_components_out_of_range_are_named(spark):
    with pytest.raises(Exception, match="does not fit 32 bits"):
        run(spark, [(1, [1e30] * 8, 1)])
    with pytest.raises(Exception, match="do not fit 63 bits"):
        run(spark, [(1, [500_000.0] * 64, 1), (2, [-500_000.0] * 64, 1)])


def test_a_hot_label_and_reconstruction(spark):
    rows = [(i, v, 7 if i % 3 else i) for i, v, _ in vectors(5, 90, 8)]
    got, books = run(spark, rows)
    from pyspark.sql import functions as F

    by_id = {i: v for i, v, _ in rows}
    table = spark.createDataFrame([(r.vec_id, r.code, r.error) for r in got], "vec_id bigint, code string, error bigint")
    for r in table.withColumn("near", vector_codes.reconstruct(F.col("code"), books)).collect():
        exact = sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(by_id[r.vec_id], r.near))
        assert exact == r.error
