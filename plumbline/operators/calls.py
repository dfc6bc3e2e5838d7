"""Function-call suites: parsing, comparison, and action sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.functions.call_text import same_calls, with_calls
from plumbline.operators import multisets
from plumbline.operators.rows import exploded

# Echo length, most turns of an agent run.
ECHO = 300
MAX_TURNS = 20
NOT_COMPARABLE = "calls cannot be compared"


def predicted_text(content: Column, tool_calls: Column) -> Column:
    """Structured tool calls, as JSON, win over the text of a message.

    The arguments stay text here; reading the calls resolves text that holds
    JSON and keeps the rest as text.
    """
    structured = F.to_json(
        F.transform(
            tool_calls,
            lambda c: F.struct(c.getField("name").alias("name"), c.arguments.alias("arguments")),
        )
    )
    return F.when(F.size(tool_calls) > 0, structured).otherwise(F.coalesce(content, F.lit("")))


def score_calls(
    answers: DataFrame, predicted: str = "response", expected: str = "expected"
) -> DataFrame:
    """Order-free comparison of the calls of a response with the expected ones.

    Each row carries its own calls, so no join or grouping is needed. A call
    list with a non-literal argument, or with an item that is no object, is
    wrong and marked in ``error`` and ``raised``. An error the row brings
    along stays.
    """
    known = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    rows = with_calls(answers, predicted, "_said")
    rows = with_calls(rows, expected, "_wanted", quoted=True)
    said, wanted = F.col("_said"), F.col("_wanted")
    num_said, num_wanted = F.size(said.calls), F.size(wanted.calls)
    malformed = (num_said == num_wanted) & F.exists(
        F.concat(said.calls, wanted.calls), lambda c: c.getField("name").isNull()
    )
    return (
        rows.withColumns(
            {
                "correct": same_calls(said, wanted),
                "num_predicted": num_said.cast("bigint"),
                "num_expected": num_wanted.cast("bigint"),
                "predicted": F.substring(F.to_json(said.calls), 1, ECHO),
                "raised": known.isNull() & F.coalesce(said.failed | wanted.failed | malformed, F.lit(False)),
            }
        )
        .withColumn("error", F.coalesce(known, F.when(F.col("raised"), NOT_COMPARABLE)))
        .withColumn("score", F.col("correct").cast("double"))
        .drop("_said", "_wanted")
    )


def calls_long(table: DataFrame, key: str, text: str = "response", *, quoted: bool = False) -> DataFrame:
    """One row per call read from ``text``: ``pos, name`` and its arguments."""
    rows = with_calls(table.select(key, text), text, "_calls", quoted=quoted)
    rows = exploded(rows, key, array="_calls.calls", item="c")
    return rows.select(key, "pos", F.col("c.name").alias("name"), F.col("c.args").alias("args"))


def score_call_lists(
    said: DataFrame, wanted: DataFrame, key: str = "sample_id", samples: DataFrame | None = None
) -> DataFrame:
    """``score_calls`` for lists in long form (``key, name, args``), of any length.

    Calls are counted per name and arguments on both sides; equal counts of all
    are equal multisets, whatever the order. Two empty lists are equal.
    """
    found = multisets.match_multisets(said, wanted, ("name", "args"), (key,), samples)
    return found.withColumn("score", F.col("correct").cast("double"))


# --- action sequences -------------------------------------------------------

TOOL_CALLS = "array<struct<name:string,arguments:string>>"


def _turns_of(turns: DataFrame, max_turns: int | None) -> DataFrame:
    return turns if max_turns is None else turns.filter(F.col("turn") < max_turns)


def actions_long(
    turns: DataFrame, key: str = "sample_id", max_turns: int | None = None
) -> DataFrame:
    """Executed actions in order: ``idx`` counts through all turns of a sample.

    ``turns`` has ``turn`` (0-based, unique per sample) and ``tool_calls``.
    Whatever was logged counts; ``max_turns`` leaves later turns out. Arguments
    that are not JSON become ``{}``.
    """
    window = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    made = F.greatest(F.size("tool_calls"), F.lit(0)).cast("bigint")
    counted = (
        _turns_of(turns, max_turns)
        .select(key, "turn", "tool_calls", made.alias("_made"))
        .withColumn("_before", F.coalesce(F.sum("_made").over(window), F.lit(0)))
    )
    rows = exploded(counted, key, "turn", "_before", array="tool_calls", item="call")
    arguments = F.to_json(jsontext.parse_or_empty_object(F.col("call.arguments")))
    return rows.select(
        key,
        "turn",
        (F.col("_before") + F.col("pos")).alias("idx"),
        F.col("call.name").alias("name"),
        arguments.alias("arguments"),
    )


def expected_actions_long(
    samples: DataFrame, key: str = "sample_id", text: str = "expected_actions"
) -> DataFrame:
    """Expected actions: ``idx, name, arguments``; text that is no list has none."""
    rows = exploded(
        samples, key, array=jsontext.as_items(jsontext.parse(F.col(text))), pos="idx"
    )
    return rows.select(
        key,
        F.col("idx").cast("bigint").alias("idx"),
        F.try_variant_get("item", "$.name", "string").alias("name"),
        F.coalesce(F.to_json(F.try_variant_get("item", "$.arguments", "variant")), F.lit("{}")).alias(
            "arguments"
        ),
    )


def expects_nothing(text: Column) -> Column:
    """Expected actions that are invalid JSON or an empty value.

    A value that is neither empty nor a list can never be met.
    """
    value = jsontext.parse(text)
    zero = ~F.startswith(jsontext.kind(value), F.lit("STRING")) & F.coalesce(
        F.try_variant_get(value, "$", "double") == 0, F.lit(False)
    )
    empty = F.to_json(value).isin("[]", "{}", "null", '""', "false")
    return value.isNull() | empty | zero


def score_actions(
    samples: DataFrame, turns: DataFrame, key: str = "sample_id", max_turns: int | None = None
) -> DataFrame:
    """Names must agree pairwise, in order and in number; none expected passes.

    The sequences are equal when every (position, name) occurs equally often
    on both sides. Grouping by sample, position and name spreads even one very
    long sequence over the cluster; then it shrinks to counts per sample.
    """
    executed = actions_long(turns, key, max_turns).select(
        key, "idx", "name", F.lit(1).alias("e"), F.lit(0).alias("w")
    )
    wanted = expected_actions_long(samples, key).select(
        key, "idx", "name", F.lit(0).alias("e"), F.lit(1).alias("w")
    )
    positions = (
        executed.unionByName(wanted)
        .groupBy(key, "idx", "name")
        .agg(F.sum("e").alias("e"), F.sum("w").alias("w"))
    )
    totals = positions.groupBy(key).agg(
        F.bool_and(F.col("e") == F.col("w")).alias("_agrees"),
        F.sum("e").alias("_e"),
        F.sum("w").alias("_w"),
    )
    num_turns = (
        _turns_of(turns, max_turns)
        .groupBy(key)
        .agg(F.count("*").alias("num_turns"))
    )
    nothing_expected = expects_nothing(F.col("expected_actions")).alias("_free")
    joined = samples.select(key, nothing_expected)
    joined = joined.join(totals, key, "left").join(num_turns, key, "left")
    listed = F.coalesce("_w", F.lit(0)) > 0
    correct = F.col("_free") | (listed & F.coalesce("_agrees", F.lit(False)))
    return joined.select(
        key,
        correct.alias("correct"),
        correct.cast("double").alias("score"),
        F.coalesce("num_turns", F.lit(0)).alias("num_turns"),
        F.coalesce("_e", F.lit(0)).alias("num_actions"),
        F.coalesce("_w", F.lit(0)).alias("num_expected"),
    )
