"""Filter audit: measures, table of spans and counts against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from plumbline.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text)
    return (
        len(words),
        len(set(words)),
        sum("A" <= c <= "Z" for c in text),
        sum(c in "#$%&*|" for c in text),
        len(text),
    )


def texts(seed, n):
    r = random.Random(seed)
    alphabet = ["a", "B", "é", "語", "😀", "#", "|", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "word", "Word"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]
    return [*out, "", " ", "x", "x" * 64, "x" * 65 + " " + "x" * 65 + " " + "x" * 64 + "y", "ab ab abc ab\0 ab\0\0 \0", "\0 \0\0"]


def test_measures_of_a_block():
    rows = texts(1, 400)
    measures, *_ = audit.measure_block([t.encode() for t in rows])
    assert [tuple(m) for m in measures.tolist()] == [plain_measures(t) for t in rows]


def test_long_texts_in_stretches():
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(300)}" * r.randrange(1, 4) for _ in range(5000)) + " " + "long" * 1000 + "\nend  "
    data = text.encode()
    for limit in (1, 7, 100, 3000, 10**6):
        assert b"".join(audit.stretches(data, limit)) == data
        assert tuple(audit.measure_long(data, limit).tolist()) == plain_measures(text)
    many = ("wörd " * 2_000_000).encode()
    assert audit.measure_long(many).tolist() == [2_000_000, 1, 0, 0, 10_000_000]


def test_colliding_spans_are_told_apart():
    data = b" ".join(f"w{i % 700}".encode() for i in range(2000)) + b" " * 9
    put = audit.transduce(np.frombuffer(data, np.uint8)[:-8])
    starts = np.flatnonzero(put & audit.BEGINS)
    sizes = np.flatnonzero(put & audit.ENDS) - starts
    owners = np.arange(2000) // 1000
    one_slot = lambda data, eights, starts, sizes: np.zeros(len(starts), np.uint64)
    first = audit.first_spans(data, owners, starts, sizes, hashed=one_slot)
    assert np.bincount(owners[first]).tolist() == [700, 700]


def plain_audit(rows, labels):
    """(part, order, step) -> counts, by applying each order to each document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = judged.get(i, (False, False))
            judged[i] = (good or quality == 1, bad or toxic == 1)
    tally = Counter()
    for i, t, part in rows:
        w, distinct, capitals, symbols, points = plain_measures(t or "")
        fails = {
            "A": w < 100,
            "B": 100 * distinct < 80 * w,
            "C": 100 * capitals > 10 * points,
            "D": symbols > 0,
            "E": i is not None and i > least[t or ""],
        }
        tally[part or "", frozenset(x for x in fails if fails[x]), judged.get(i, (False, False))] += 1
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in tally}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                counts = Counter()
                for (p, fails, (good, toxic)), n in tally.items():
                    if p != part:
                        continue
                    hit, gone = letter in fails, bool(fails & set(order[:step]))
                    counts["kept"] += n * (not hit and not gone)
                    counts["removed"] += n * (hit and not gone)
                    counts["redundant"] += n * (hit and gone)
                    counts["unique_fails"] += n * (fails == {letter})
                    counts["good_lost"] += n * (hit and not gone and good)
                    counts["toxic_lost"] += n * (hit and not gone and toxic)
                out[part, "".join(order), step + 1] = counts
                shapley[part, letter] += counts["removed"]
    return {k: (*(c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def run(docs, spark, rows, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, part string, good string")
    flagged = audit.failures(docs([(i, t, part) for i, t, part in rows]))
    out = audit.interactions(audit.with_labels(flagged, table), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}


def test_every_order_against_brute_force(docs, spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["BIG", "#1", "A&B"]
    rows = []
    for i in range(120):
        words = [r.choice(vocabulary[: r.choice([30, 403])]) for _ in range(r.choice([0, 5, 99, 100, 150]))]
        rows.append((i, " ".join(words), r.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[5][1], "en") for i in range(60)]
    rows += [(None, rows[5][1], "en"), (None, None, None), (300, None, "xx"), (301, "", "xx"), (300, None, "xx"), (302, " ", "xx")]
    labels = [(i, i % 2, i % 3 % 2, "?", "?") for i in range(0, 250, 3)] + [(3, 0, 1, "?", "?"), (6, None, None, "?", "?"), (None, 1, 1, "?", "?")]
    assert run(docs, spark, rows, labels) == plain_audit(rows, [x[:3] for x in labels])


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_few_rows(docs, spark, rows):
    assert run(docs, spark, rows, []) == plain_audit(rows, [])


def test_the_limits_are_met_exactly(docs):
    hundred = " ".join(f"w{i}" for i in range(100))
    eighty = " ".join(f"w{i % 80}" for i in range(100))
    fewer = " ".join(f"w{i % 79}" for i in range(100))
    tenth, more = "A" + "b" * 9, "A" + "b" * 8
    flags = {r.doc_id: r for r in audit.failures(docs([(1, hundred), (2, eighty), (3, fewer), (4, tenth), (5, more)])).collect()}
    assert not any(flags[1][x] for x in "ABCDE") and not any(flags[2][x] for x in "ABCDE")
    assert flags[3].B and not flags[4].C and flags[5].C and flags[5].A
