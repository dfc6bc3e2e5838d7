"""Secret scan with column expressions only.

Three fixed patterns give the base spans. The method adds what they miss: over
candidate strings a window slides; counts per character and the sum of
c log2 c change by the character that enters and the one that leaves, which
gives the Shannon entropy of every window. Windows above the threshold of
the candidate's character class are reported, unless the candidate is on the
allow list or overlaps a base span.

Places come from the parts between matches and the matches themselves: their
lengths in code points add up to offsets. Sums over arrays, and windows over long
candidates, go in blocks, so that time grows with the length of a text and the
number of its matches, however long and however many.

Defined results: NULL and empty text have no spans. A candidate of any length is
one candidate. Spans of equal start are ordered by kind, then end. Repeated rows
are scanned alike; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and how long a match must be.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20

# Items of an array that are summed up, or windows that are slid over, at once.
BLOCK = 256

# Character classes, first match counts, and the bits per character above
# which a window of 20 looks random. A random window has about 3.4 bits over
# hex digits, 3.9 over letters of one case with digits, 4.1 over all.
CLASSES = (
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5),
    (r"", 3.7),
)

# Candidates that are no secrets: without a digit (words, paths, separators),
# without a letter, UUIDs, alphabets, placeholders.
ALLOW = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefghijklm|nopqrstuvwxyz|0123456789",
    r"(?i)example|placeholder|xxxxxxxx",
)

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _none() -> Column:
    return F.expr(f"CAST(array() AS {_SPAN})")


def _scan(items: Column, start: Column, merge) -> Column:
    """For each item ``merge`` over all items before it, beginning with ``start``."""

    def plain(values: Column, first: Column) -> Column:
        empty = F.slice(values, 1, 0)
        step = lambda acc, x: F.struct(
            merge(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
        )
        return F.aggregate(values, F.struct(first.alias("now"), empty.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK))
        return _bound(
            F.transform(cuts, lambda cut: F.slice(values, cut + 1, BLOCK)),
            lambda blocks: F.flatten(
                F.zip_with(
                    blocks, plain(F.transform(blocks, lambda b: F.aggregate(b, start, merge)), start), plain
                )
            ),
        )

    return _bound(items, lambda values: F.when(F.size(values) > 0, in_blocks(values)).otherwise(values))


def _matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``: (start, end, value), ends exclusive, in code points."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )

    def places(x: Column) -> Column:
        steps = F.transform(x["match"], lambda m, i: F.get(x["between"], i) + F.char_length(m))
        return _bound(
            _scan(steps, F.lit(0), lambda a, b: a + b),
            lambda at: F.transform(
                x["match"],
                lambda m, i: F.struct(
                    (F.get(at, i) + F.get(x["between"], i)).alias("start"),
                    (F.get(at, i) + F.get(x["between"], i) + F.char_length(m)).alias("end"),
                    m.alias("value"),
                ),
            ),
        )

    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), _bound(found, places)).otherwise(none)


def _spans(text: Column, pattern: str, rank: int, valid: Column | None = None) -> Column:
    """Places of all matches of ``pattern``; ``valid`` flags them one by one."""
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))
    matches = _matches(text, pattern)
    if valid is None:
        return F.transform(matches, span)
    both = F.struct(matches.alias("m"), valid.alias("valid"))
    return _bound(both, lambda x: F.transform(F.filter(x["m"], lambda m, i: F.get(x["valid"], i)), span))


def base_spans(text: Column) -> Column:
    """Base matches, by start and then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.char_length(v) >= ASSIGN_LENGTH)
    return F.array_sort(
        F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    )


def _weight(count: Column) -> Column:
    """c log2 c, 0 for no or one character."""
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def windows(codes: Column, size: int = WINDOW) -> Column:
    """Entropy in bits of every window over an array of character codes below 128.

    One step per character: what enters and what leaves changes two counts and
    two terms of the sum. Counts are packed, several to a number.
    """
    width = size.bit_length()
    packed = 63 // width
    word = lambda code: F.floor(code / packed)
    shift = lambda code: (code % packed * width).cast("int")

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(code).cast("int")), shift(code)).bitwiseAND(
            F.lit((1 << width) - 1)
        )

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(code))

    def slide(values: Column):
        def step(acc: Column, i: Column) -> Column:
            enters = F.get(values, i)
            leaves = F.when(i >= size, F.get(values, F.greatest(i - size, F.lit(0))))
            many, fewer = count(acc["counts"], enters), count(acc["counts"], leaves)
            gone = F.when(leaves.isNotNull(), _weight(fewer - 1) - _weight(fewer)).otherwise(0.0)
            same = F.coalesce(enters == leaves, F.lit(False))
            total = acc["sum"] + F.when(same, 0.0).otherwise(_weight(many + 1) - _weight(many) + gone)
            counts = F.when(same, acc["counts"]).otherwise(
                F.transform(
                    acc["counts"],
                    lambda c, j: c
                    + F.when(j == word(enters), one(enters)).otherwise(0)
                    - F.when(j == word(leaves), one(leaves)).otherwise(0),
                )
            )
            bits = F.lit(math.log2(size)) - total / size
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(i >= size - 1, F.concat(acc["bits"], F.array(bits))).otherwise(acc["bits"]).alias("bits"),
            )

        return step

    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), -(-128 // packed)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.expr("CAST(array() AS array<double>)").alias("bits"),
    )

    def block(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(values) - 1)
        return F.aggregate(places, start, slide(values), lambda acc: acc["bits"])

    def whole(values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.size(values) - size, F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(cuts, lambda cut: _bound(F.slice(values, cut + 1, BLOCK + size - 1), block)))

    return _bound(codes, whole)


def entropy_spans(
    text: Column,
    *,
    window: int = WINDOW,
    classes: tuple[tuple[str, float], ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> Column:
    """Per candidate, from the first to the last window above its class's threshold.

    A candidate is a whole run of its characters, as long as a window at least.
    """
    candidates = _matches(text, rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{window},}}")

    def judge(span: Column) -> Column:
        v = span["value"]
        limit = None
        for rule, bits in classes:
            test = F.rlike(v, F.lit(rule))
            limit = F.when(test, bits) if limit is None else limit.when(test, bits)
        allowed = F.lit(False)
        for rule in allow:
            allowed = allowed | F.rlike(v, F.lit(rule))
        codes = F.transform(F.split(v, ""), F.ascii)
        high = _bound(limit, lambda least: F.transform(windows(codes, window), lambda b: b >= least))
        found = _bound(
            high,
            lambda h: F.struct(
                F.array_position(h, True).cast("int").alias("first"),
                (F.size(h) - F.array_position(F.reverse(h), True) + 1).cast("int").alias("last"),
            ),
        )
        return _bound(
            F.when(~allowed, found),
            lambda w: F.when(
                w["first"] > 0,
                F.struct(
                    (span["start"] + w["first"] - 1).alias("start"),
                    F.lit(3).alias("rank"),
                    (span["start"] + w["last"] + window - 1).alias("end"),
                ),
            ),
        )

    return F.filter(F.transform(candidates, judge), lambda s: s.isNotNull())


def _without_overlaps(base: Column, extra: Column) -> Column:
    """Base spans and those of ``extra`` that touch none, in order.

    In the order of starts, a span touches a base span before it if one of
    those ends later than it starts, and one after it if the next begins before it ends.
    """
    far = F.lit((1 << 31) - 1)

    def kept(x: Column) -> Column:
        is_base = lambda s: s["rank"] < 3
        ends = F.transform(x, lambda s: F.when(is_base(s), s["end"]).otherwise(-1))
        starts = F.transform(F.reverse(x), lambda s: F.when(is_base(s), s["start"]).otherwise(far))
        around = F.struct(
            _scan(ends, F.lit(-1), lambda a, b: F.greatest(a, b)).alias("before"), F.reverse(_scan(starts, far, lambda a, b: F.least(a, b))).alias("after")
        )
        free = lambda a, s, i: (F.get(a["before"], i) <= s["start"]) & (F.get(a["after"], i) >= s["end"])
        return _bound(around, lambda a: F.filter(x, lambda s, i: is_base(s) | free(a, s, i)))

    return _bound(F.array_sort(F.concat(base, extra)), lambda x: F.when(F.size(extra) > 0, kept(x)).otherwise(x))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id with ``base`` and ``spans``: arrays of (start, rank, end).

    ``rank`` is the place in ``KINDS``. The arrays are exploded nowhere; every
    row is worked on alone. Each array is held in an array of one, which keeps
    the optimizer from computing it anew at every use.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))

    def both(x: Column) -> Column:
        return F.struct(x["base"].alias("base"), _without_overlaps(x["base"], x["extra"]).alias("spans"))

    found = F.struct(base_spans(text).alias("base"), entropy_spans(text).alias("extra"))
    return docs.select(F.col(id_column), F.transform(F.array(found), both).alias("_found")).select(
        id_column, F.explode("_found").alias("_one")
    ).select(id_column, "_one.base", "_one.spans")


def secret_report(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    found = find_secrets(docs, id_column=id_column, text_column=text_column)
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        id_column,
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
