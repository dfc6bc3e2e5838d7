"""Function calls written as text, in a form that compares by equality.

A call becomes ``(name, args)`` where args is a sorted list of
``(key, kind, value)``. Kinds: ``n`` whole number or boolean (1, 1.0 and true
are equal), ``f`` other number, ``s`` text, ``z`` null, ``l`` list,
``d`` object, ``o`` anything else. String values that hold JSON count as the value
they hold.

Both notations are read by built-in functions. Python call syntax is cut into
tokens; each token becomes its JSON form by what stands next to it, and the JSON
reader judges how they nest. Names of calls and of keywords carry a mark, so that
counting them tells whether every call is an item and every argument a keyword.
What is left to one Arrow function are nested arguments and what the tokens
cannot say (escapes, tuples, positional arguments, operators, prefixes); it sees
NULL for every other row.
"""

from __future__ import annotations

import ast
import json
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import jsontext
from plumbline.functions.text import FENCE, WS, bound_to, first_group, strip

_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("k", "t", "v")])
_CALL = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(_ENTRY))]
)
CALLS = T.StructType(
    [T.StructField("failed", T.BooleanType()), T.StructField("calls", T.ArrayType(_CALL))]
)
_NO_ARGS = "array<struct<k:string,t:string,v:string>>"
_NO_CALLS = f"array<struct<name:string,args:{_NO_ARGS}>>"
_ARROW_ENTRY = pa.struct([(n, pa.string()) for n in ("k", "t", "v")])
_ARROW_CALL = pa.struct([("name", pa.string()), ("args", pa.list_(_ARROW_ENTRY))])
_ARROW_CALLS = pa.struct([("failed", pa.bool_()), ("calls", pa.list_(_ARROW_CALL))])

# Marks arguments that are no object: the key of their single entry.
WHOLE = "\x00"

# Tokens of calls with literal arguments. Strings without escapes, numbers as JSON
# writes them, dotted names, single signs.
_BLANK = r" \t\f\n\r"
_NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"
_TOKEN = "|".join(
    (
        r"'[^'\\\x00-\x1f]*'|\"[^\"\\\x00-\x1f]*\"",
        r"(?<![\w.)\]}'\"])-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])",
        _NAME,
        r"[()\[\]{},:]|(?<!=)=(?!=)",
    )
)
# The literals of Python by their JSON form, and its keywords.
_LITERALS = {"True": "true", "False": "false", "None": "null"}
_KEYWORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield True False None"
).split()
_WORD = rf"(?!(?:{'|'.join(_KEYWORDS)})\b)[A-Za-z_]\w*"
# A line end outside of brackets, where a bracket closes only a call.
_TOP_LINE_END = r"\A[^(]*[\n\r]|\)[^('\"]*[\n\r]"
# Marks of a call and of a keyword; no text of theirs can hold them.
_MARK = "\x01"
_MARKED = "\\u0001"


def _canonical(value: Any) -> list:
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return ["s", value.strip()]
        return _canonical(inner)
    if value is None:
        return ["z", ""]
    if isinstance(value, int) or (isinstance(value, float) and value.is_integer()):
        return ["n", str(int(value))]
    if isinstance(value, float):
        # A NaN equals nothing, not even itself.
        return ["f", repr(value) if value == value else f"nan-{uuid.uuid4().hex}"]
    if isinstance(value, list):
        return ["l", [_canonical(v) for v in value]]
    if isinstance(value, dict):
        return ["d", [[str(k), _canonical(v)] for k, v in sorted(value.items(), key=lambda m: str(m[0]))]]
    return ["o", f"{type(value).__name__}:{value!r}"]


def _entry(key: str, value: Any) -> dict[str, str]:
    tag, content = _canonical(value)
    text = content if isinstance(content, str) else json.dumps(content)
    return {"k": key, "t": tag, "v": text}


def _call(item: Any) -> dict[str, Any]:
    if not isinstance(item, dict):
        return {"name": None, "args": []}
    name = item.get("name", "")
    tag, content = _canonical(item.get("arguments", {}))
    if tag == "d":
        entries = [
            {"k": k, "t": t, "v": v if isinstance(v, str) else json.dumps(v)}
            for k, (t, v) in content
        ]
    else:
        entries = [_entry(WHOLE, item["arguments"])]
    entries.sort(key=lambda e: (e["k"], e["t"], e["v"]))
    shown = name if isinstance(name, str) else WHOLE + json.dumps(name)
    return {"name": shown, "args": entries}


def _json_items(text: str) -> list | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


def _syntax_items(text: str) -> list[dict[str, Any]]:
    """Calls in Python syntax: keyword arguments with literal values."""
    for source, listed in ((text, False), (f"[{text}]", True)):
        try:
            body = ast.parse(source, mode="eval").body
        except SyntaxError:
            continue
        nodes = body.elts if listed and isinstance(body, ast.List) else [body]
        return [
            {
                "name": getattr(node.func, "attr", getattr(node.func, "id", "")),
                "arguments": {
                    k.arg: ast.literal_eval(k.value) for k in node.keywords if k.arg is not None
                },
            }
            for node in nodes
            if isinstance(node, ast.Call)
        ]
    return []


def _read(text: str, block: str | None) -> dict[str, Any]:
    try:
        items = _json_items(text)
        if items is None and block is not None:
            items = _json_items(block)
        if items is None:
            items = _syntax_items(text)
        return {"failed": False, "calls": [_call(i) for i in items]}
    except (ValueError, TypeError, RecursionError, MemoryError):
        # A value that is no literal: the sample cannot be scored.
        return {"failed": True, "calls": []}


@F.arrow_udf(CALLS)
def _read_calls(texts: pa.Array, blocks: pa.Array) -> pa.Array:
    rows = [
        None if text is None else _read(text, block)
        for text, block in zip(texts.to_pylist(), blocks.to_pylist(), strict=True)
    ]
    return pa.array(rows, type=_ARROW_CALLS)


def _text_of(value: Column) -> Column:
    """Content of a VARIANT string, NULL for every other kind."""
    return F.when(jsontext.kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _fraction(number: Column) -> Column:
    """One form of a fraction, whoever read it."""
    return number.cast("string")


def _same_fractions(calls: Column) -> Column:
    """Calls that Python read, with fractions in the form of the others."""
    entry = lambda e: F.struct(
        e["k"].alias("k"),
        e["t"].alias("t"),
        F.when((e["t"] == "f") & ~F.startswith(e["v"], F.lit("nan")), _fraction(e["v"].cast("double"))).otherwise(e["v"]).alias("v"),
    )
    one = lambda c: F.struct(c["name"].alias("name"), F.array_sort(F.transform(c["args"], entry)).alias("args"))
    return F.transform(calls, one)


def _native_entries(entries: Column) -> Column:
    """Entries of scalar members; the kind is NULL where Python has to look.

    Written as a chain of transforms, so that each step is computed once.
    """
    told = F.transform(
        entries,
        lambda e: F.struct(e.key.alias("k"), e.value.alias("value"), jsontext.kind(e.value).alias("kind")),
    )
    read = F.transform(
        told,
        lambda e: F.struct(
            e.k.alias("k"),
            e.value.alias("value"),
            e.kind.alias("kind"),
            F.when(e.kind == "STRING", F.try_variant_get(e.value, "$", "string")).alias("text"),
        ),
    )
    resolved = F.transform(
        read,
        lambda e: F.struct(
            e.k.alias("k"),
            e.text.alias("text"),
            e.kind.alias("kind"),
            F.when(e.text.isNull(), e.value).otherwise(jsontext.parse(e.text)).alias("value"),
        ),
    )
    typed = F.transform(
        resolved,
        lambda e: F.struct(
            e.k.alias("k"),
            e.text.alias("text"),
            e.value.alias("value"),
            F.when(e.text.isNull(), e.kind).otherwise(jsontext.kind(e.value)).alias("kind"),
        ),
    )

    def finish(e: Column) -> Column:
        number = F.try_variant_get(e.value, "$", "double")
        # Larger ones are whole numbers of many digits, or no longer exact.
        fraction = F.rlike(e.kind, F.lit("^(DECIMAL|DOUBLE|FLOAT)")) & (F.abs(number) < 1e15)
        whole = e.kind.isin("BIGINT", "BOOLEAN") | (fraction & (number == F.floor(number)))
        plain_text = e.kind.isNull() & ~F.rlike(e.text, F.lit("NaN|Infinity"))
        tag = F.when(whole, "n").when(fraction, "f").when(e.kind == "VOID", "z").when(plain_text, "s")
        shown = (
            F.when(e.kind.isin("BIGINT", "BOOLEAN"), F.try_variant_get(e.value, "$", "bigint").cast("string"))
            .when(whole, number.cast("bigint").cast("string"))
            .when(fraction, _fraction(number))
            .when(e.kind == "VOID", "")
        )
        return F.struct(
            e.k.alias("k"), tag.alias("t"), shown.otherwise(strip(e.text)).alias("v")
        )

    return F.array_sort(F.transform(typed, finish))


def _native_calls(items: Column) -> Column:
    """(name, args, done) per item; ``done`` is false where Python has to look."""
    members = F.transform(items, jsontext.as_members)
    fields = F.transform(
        members,
        lambda m: F.struct(
            m.isNull().alias("bad"),
            F.try_element_at(m, F.lit("name")).alias("called"),
            F.try_element_at(m, F.lit("arguments")).alias("given"),
        ),
    )
    named = F.transform(
        fields,
        lambda f: F.struct(
            f.bad.alias("bad"),
            f.called.isNull().alias("unnamed"),
            _text_of(f.called).alias("name"),
            f.given.alias("given"),
            jsontext.as_members(f.given).alias("object"),
        ),
    )
    # Arguments that are no object may be a text that holds one.
    quoted = F.transform(
        named,
        lambda f: F.struct(
            f.bad.alias("bad"),
            f.unnamed.alias("unnamed"),
            f["name"].alias("name"),
            f.given.isNull().alias("bare"),
            f.object.alias("object"),
            F.when(f.object.isNull(), _text_of(f.given)).alias("text"),
        ),
    )
    opened = F.transform(
        quoted,
        lambda f: F.struct(
            f.bad.alias("bad"),
            f.unnamed.alias("unnamed"),
            f["name"].alias("name"),
            f.bare.alias("bare"),
            F.coalesce(f.object, jsontext.as_members(jsontext.parse(f.text))).alias("held"),
        ),
    )
    none = F.array().cast(_NO_ARGS)
    listed = F.transform(
        opened,
        lambda o: F.struct(
            o.bad.alias("bad"),
            o.unnamed.alias("unnamed"),
            o["name"].alias("name"),
            F.when(o.bad | o.bare, none)
            .otherwise(_native_entries(F.map_entries(o.held)))
            .alias("args"),
        ),
    )
    return F.transform(
        listed,
        lambda c: F.struct(
            F.when(~c.bad, F.coalesce(c["name"], F.lit(""))).alias("name"),
            c.args.alias("args"),
            (
                c.bad
                | (
                    (c.unnamed | c["name"].isNotNull())
                    & F.coalesce(F.forall(c.args, lambda e: e.t.isNotNull()), F.lit(False))
                )
            ).alias("done"),
        ),
    )


def _json_of_syntax(text: Column) -> Column:
    """(json, calls, keywords): call syntax as a JSON list; NULL where a token has no JSON form."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    begins = F.rlike(text, F.lit(rf"\A{_NAME}[{_BLANK}]*\("))
    # Nothing but blanks stands between the tokens.
    covered = ~F.rlike(F.regexp_replace(text, _TOKEN, ""), F.lit(f"[^{_BLANK}]"))

    def forms(all_: Column) -> Column:
        def form(token: Column, i: Column) -> Column:
            first, after = F.substring(token, 1, 1), F.get(all_, i + 1)
            named_before = F.rlike(F.when(i > 0, F.get(all_, i - 1)), F.lit("^[A-Za-z_]"))
            name = F.rlike(token, F.lit("^[A-Za-z_]"))
            plain = F.rlike(token, F.lit(rf"^{_WORD}(?:\.{_WORD})*$"))
            inner = F.replace(F.substring(token, F.lit(2), F.char_length(token) - 2), F.lit('"'), F.lit('\\"'))
            literal = F.element_at(F.create_map(*(F.lit(x) for pair in _LITERALS.items() for x in pair)), token)
            last = F.element_at(F.split(token, r"\."), -1)
            return (
                F.when(first == "'", F.concat(F.lit('"'), inner, F.lit('"')))
                .when(first == '"', token)
                .when(plain & (after == "("), F.concat(F.lit(f'{{"{_MARKED}name":"'), last, F.lit('","arguments":')))
                .when(plain & (after == "=") & ~F.contains(token, F.lit(".")), F.concat(F.lit(f'"{_MARKED}'), token, F.lit('"')))
                .when(name, F.when(token.isin(*_LITERALS), literal))
                .when(first == "=", F.when(named_before, ":"))
                .when(first == "(", F.when(named_before, "{"))
                .when(first == ")", "}}")
                .otherwise(token)
            )

        many = lambda sign: F.size(F.filter(all_, lambda t: t == sign))
        return bound_to(
            F.transform(all_, form),
            lambda made: F.struct(
                F.when(
                    F.forall(made, lambda m: m.isNotNull()), F.concat(F.lit("["), F.array_join(made, " "), F.lit("]"))
                ).alias("json"),
                many("(").alias("calls"),
                many("=").alias("keywords"),
            ),
        )

    return F.when(begins & covered, bound_to(tokens, forms))


def _syntax_calls(text: Column) -> Column:
    """Calls of a text in call syntax; NULL where Python has to say what it means.

    Every call has to be an item (one within an argument is not) and every
    argument a keyword, none of them twice. Several calls are a tuple, which
    is no call, unless a line ends between them.
    """
    name = lambda m: F.try_element_at(m, F.lit(f"{_MARK}name"))
    given = lambda m: jsontext.as_members(F.try_element_at(m, F.lit("arguments")))
    unmarked = lambda held: F.transform(
        held, lambda e: F.struct(F.substring(e["key"], F.lit(2), F.char_length(e["key"])).alias("key"), e["value"].alias("value"))
    )

    def sound(calls: Column, read: Column) -> Column:
        marked = lambda c: F.forall(c["held"], lambda e: F.startswith(e["key"], F.lit(_MARK)))
        return (
            (F.size(calls) == read["calls"])
            & F.forall(calls, lambda c: c["called"].isNotNull() & c["held"].isNotNull() & marked(c))
            & (F.aggregate(calls, F.lit(0), lambda n, c: n + F.size(c["held"])) == read["keywords"])
        )

    def judged(read: Column) -> Column:
        members = F.transform(jsontext.as_items(jsontext.parse(read["json"])), jsontext.as_members)
        opened = F.transform(
            members, lambda m: F.struct(_text_of(name(m)).alias("called"), F.map_entries(given(m)).alias("held"))
        )
        entries = lambda calls: F.transform(
            calls, lambda c: F.struct(c["called"].alias("name"), _native_entries(unmarked(c["held"])).alias("args"))
        )
        several = (read["calls"] > 1) & ~F.rlike(text, F.lit(_TOP_LINE_END))
        return bound_to(
            opened,
            lambda calls: F.when(
                sound(calls, read), F.when(several, F.array().cast(_NO_CALLS)).otherwise(entries(calls))
            ),
        )

    return bound_to(_json_of_syntax(text), judged)


def _maybe_calls(text: Column) -> Column:
    """Whether Python could read a call: there is a call form, and no two words stand side by side.

    The second is never so in an expression, outside of strings and comments.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", "__"), r"\"[^\"\n]*\"|'[^'\n]*'", "")
    prose = ~F.rlike(text, F.lit("#|\"\"\"|'''")) & F.rlike(bare, F.lit(rf"\b{_WORD}[ \t]+{_WORD}"))
    return F.rlike(text, F.lit(r"(?:[\w)\]}'\"]|[^\x00-\x7f])\s*\(")) & ~prose


def with_calls(table: DataFrame, text: str, name: str, *, quoted: bool = False) -> DataFrame:
    """Add ``name``: a struct (failed, calls) read from the column ``text``.

    Tried in order: the whole text as JSON, the first fenced block as JSON,
    Python call syntax; otherwise no calls. ``quoted`` accepts a JSON string
    and reads its content instead (answers of question sets).
    A call whose name is NULL was no object.
    """
    body = strip(F.col(text))
    if quoted:
        value = jsontext.parse(F.when(F.startswith(body, F.lit('"')), body))
        body = F.coalesce(strip(F.try_variant_get(value, "$", "string")), body)
    staged = table.withColumn("_text", body)
    block = first_group(F.col("_text"), rf"(?s){FENCE}(?:json)?{WS}*\n?(.*?){FENCE}")
    staged = staged.withColumn("_block", strip(block))
    staged = staged.withColumn("_value", jsontext.parse(_container(F.col("_text"))))
    staged = staged.withColumn("_value", F.coalesce("_value", jsontext.parse(_container(F.col("_block")))))
    # A value that is no array is an object: others were not parsed.
    items = F.coalesce(jsontext.as_items(F.col("_value")), F.when(F.col("_value").isNotNull(), F.array("_value")))
    staged = staged.withColumn("_native", _native_calls(items))
    readable = F.col("_native").isNotNull()
    done = F.forall("_native", lambda c: c.done)
    # Call syntax, where the text is no JSON.
    staged = staged.withColumn("_syntax", F.when(~readable, _syntax_calls(F.col("_text"))))
    told_all = F.coalesce(F.forall("_syntax", lambda c: F.forall(c.args, lambda e: e.t.isNotNull())), F.lit(False))
    possible = F.rlike("_text", F.lit("NaN|Infinity")) | _maybe_calls(F.col("_text"))
    needs_python = (readable & ~done) | (~readable & possible & ~told_all)
    staged = staged.withColumn("_ask", F.when(needs_python, F.col("_text")))
    told = _read_calls(F.col("_ask"), F.when(F.col("_ask").isNotNull(), F.col("_block")))
    listed = F.transform("_native", lambda c: F.struct(c.getField("name").alias("name"), c.args.alias("args")))
    native = F.coalesce(listed, "_syntax")
    plain = F.struct(
        F.lit(False).alias("failed"),
        F.coalesce(native, F.array().cast(_NO_CALLS)).alias("calls"),
    )
    staged = staged.withColumn("_told", told)
    again = F.struct(F.col("_told.failed").alias("failed"), _same_fractions(F.col("_told.calls")).alias("calls"))
    return staged.withColumn(name, F.when(F.col("_told").isNotNull(), again).otherwise(plain)).drop(
        "_text", "_block", "_value", "_native", "_syntax", "_ask", "_told"
    )


def _container(text: Column) -> Column:
    """Stripped text of a list or an object, told by its first sign; NULL for any other."""
    return F.when(F.substring(text, 1, 1).isin("[", "{"), text)


def same_calls(predicted: Column, expected: Column) -> Column:
    """Equal as multisets of calls; two empty lists are equal.

    Matching one by one in any order finds a full match exactly when the
    sorted lists are equal, because equality of calls is transitive.
    """
    said, wanted = predicted.getField("calls"), expected.getField("calls")
    readable = ~predicted.getField("failed") & ~expected.getField("failed")
    objects = ~F.exists(F.concat(said, wanted), lambda c: c.getField("name").isNull())
    return readable & objects & (F.array_sort(said) == F.array_sort(wanted))
