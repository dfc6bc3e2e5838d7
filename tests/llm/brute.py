"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text):
    return (text or "").encode().translate(LOWER).split()


def remove_repeats(rows, window):
    first = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone.update(range(s, s + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def ngrams(text, size):
    w = lower_words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def similarity_classes(rows, size, percent):
    sets = {d: ngrams(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def item_hits(text, items, window):
    """n_words, hit places and items of one text."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: pattern.findall((t or "").encode().translate(LOWER).decode())
    words, hit, names = norm(text), set(), set()
    for name, item in items:
        own = norm(item)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if grams else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                names.add(str(name))
    return len(words), hit, names


KINDS = ("assign", "access", "hex")
PATTERNS = (
    (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 1),
    (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    (re.compile(r"[0-9a-f]+"), 24, 0),
)


def base_spans(text):
    found = [
        (m.start(), k, m.end())
        for k, (pattern, least, group) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    return sorted(found)


def joined(spans):
    return ",".join(f"{(*KINDS, 'entropy')[k]}:{a}:{b}" for a, k, b in spans)


def entropy(text):
    counts = collections.Counter(text)
    return -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())


def base_scores(rows, folds=10):
    counts = collections.Counter()
    tokens = [(d, [*lower_words(t), b""]) for d, t in rows]
    for d, words in tokens:
        if zlib.crc32(str("" if d is None else d).encode()) % folds:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    return [(d, len(w), sum(counts[x] > 0 for x in w), total, sum(map(log, w))) for d, w in tokens]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
