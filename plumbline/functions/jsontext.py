"""Strict JSON parsing on top of the lenient VARIANT parser.

``try_parse_json`` ignores whatever follows the first value. Wrapping the
text once as an array element and once as an object member makes both wraps
fail, or gain elements, unless the text is exactly one JSON value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A bare NaN / Infinity token: allowed by the reading side, not by the parser.
# Inside a string the replacement changes content but never validity.
_BARE_NUMBER = r"(?<=^|[\[,:\s])-?(?:NaN|Infinity)(?=\s*(?:[,\]}]|\z))"


# How a JSON value may begin. Most texts fail here, which is far cheaper than
# the parser's exception; the two bare numbers count for validity only.
_OPENING = r"^[ \t\n\r]*(?:[\[{\"0-9\-]|true|false|null)"
_OPENING_OR_BARE = r"^[ \t\n\r]*(?:[\[{\"0-9\-]|true|false|null|NaN|Infinity)"


# The VARIANT parser gives NULL above its size limit (128 MB); a text has to be this
# long before that can be the reason.
LARGE = 64 << 20


def _counted(text: Column) -> Column:
    """True where the streaming parser, which has no limit, reads exactly one value.

    It also takes single quotes and control characters in strings: what is left
    without the strings that JSON allows must have no quote of either kind.
    """
    items = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    members = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", "__"), r'"[^"\x00-\x1f]*"', "")
    one = (items == 1) & members.isNotNull() & ~F.rlike(bare, F.lit("[\"']"))
    return F.coalesce(one, F.lit(False))


def _wrapped(text: Column) -> tuple[Column, Column]:
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return as_item, as_member


def is_json(text: Column) -> Column:
    """True where ``text`` is exactly one JSON value; one parser for texts of every size."""
    has_bare = F.rlike(text, F.lit("NaN|Infinity"))
    plain = F.when(has_bare, F.regexp_replace(text, _BARE_NUMBER, "0")).otherwise(text)
    return F.coalesce(F.when(F.rlike(text, F.lit(_OPENING_OR_BARE)), _counted(plain)), F.lit(False))


def parse(text: Column) -> Column:
    """VARIANT value of a JSON text; NULL where it is not exactly one value.

    A valid text above the size limit of a VARIANT is an error, not a NULL.
    """
    as_item, as_member = _wrapped(text)
    one = F.size(F.try_variant_get(as_item, "$", "array<variant>")) == 1
    opens = F.rlike(text, F.lit(_OPENING))
    too_large = (F.octet_length(text) > LARGE) & as_item.isNull() & _counted(text)
    return F.when(
        too_large, F.raise_error(F.lit("a JSON text above the size limit of a VARIANT")).cast("variant")
    ).when(opens & one, F.try_variant_get(as_member, "$.v", "variant"))


def parse_or_empty_object(text: Column) -> Column:
    """VARIANT value, an empty object where the text is NULL or not JSON."""
    return F.coalesce(parse(text), F.parse_json(F.lit("{}")))


def kind(value: Column) -> Column:
    """Type name of a VARIANT: BIGINT, STRING, VOID, OBJECT<…>, ARRAY<…>, …"""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.startswith(kind(value), F.lit("OBJECT"))


def is_array(value: Column) -> Column:
    return F.startswith(kind(value), F.lit("ARRAY"))


def as_members(value: Column) -> Column:
    """MAP of an object's members; NULL for anything that is not an object.

    A missing key gives NULL, a JSON null gives a VARIANT of kind VOID.
    """
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_items(value: Column) -> Column:
    """ARRAY of an array's items; NULL for anything that is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")
