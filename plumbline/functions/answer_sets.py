"""Set-valued answers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import first_group, strip

# The first bracketed region, the separators, the quotes.
_REGION = r"(?s)[\[{](.*?)[\]}]"
_SEPARATORS = "[,\n]"
_QUOTES = "'\""


def extract_set(text: Column) -> Column:
    """Distinct items of the first bracketed region, else of the whole text.

    Blank items vanish; an item made of quotes only stays as ''.
    """
    body = strip(text)
    inner = F.coalesce(first_group(body, _REGION), body)
    items = F.filter(F.transform(F.split(inner, _SEPARATORS), strip), lambda i: i != "")
    bare = F.transform(items, lambda i: strip(F.btrim(i, F.lit(_QUOTES))))
    return F.array_distinct(bare)


def same_set(left: Column, right: Column) -> Column:
    """Equality of two distinct arrays as sets."""
    return (F.size(left) == F.size(right)) & (F.size(F.array_except(left, right)) == 0)


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two distinct arrays: 1 for two empty sets, 0 for one empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.nullif(union, F.lit(0)))
