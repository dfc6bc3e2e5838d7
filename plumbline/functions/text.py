"""Text expressions with the white-space and word classes of Unicode.

Java's ``\\s``, ``\\w``, ``$`` and ``.`` are not the Unicode ones, so every
pattern in the package is built from the classes below.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Members of a character class: white space, word characters.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
WS = f"[{SPACE}]"
NOT_WS = f"[^{SPACE}]"

# Every white-space code point, for trimming without a pattern.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = "```"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL where there is no match.

    ``regexp_extract`` gives '' both for no match and for an empty group.
    """
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def nonblank_parts(text: Column, pattern: str) -> Column:
    """Pieces between matches of ``pattern`` that are not blank, stripped."""
    pieces = F.transform(F.split(text, pattern), strip)
    return F.filter(pieces, lambda piece: piece != "")


@F.arrow_udf(T.StringType())
def _decompose(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKD")


def decompose(text: Column) -> Column:
    """NFKD form. Only texts with a non-ASCII character visit Python."""
    exotic = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)
    return F.coalesce(_decompose(exotic), text)


def normalize(text: Column) -> Column:
    """Comparison form: NFKD, lower case, no punctuation, single spaces.

    The ends are stripped before punctuation goes, so ``"! a"`` keeps the
    blank that followed its punctuation.
    """
    folded = strip(F.lower(decompose(text)))
    letters = F.regexp_replace(folded, f"[^{WORD}{SPACE}]", "")
    return F.regexp_replace(letters, f"{WS}+", " ")


def exact_match(predicted: Column, expected: Column) -> Column:
    """Equality of comparison forms."""
    return normalize(predicted) == normalize(expected)


def contains_match(predicted: Column, expected: Column) -> Column:
    """The expected comparison form occurs in the predicted one."""
    return F.contains(normalize(predicted), normalize(expected))
