"""Instruction checking: one response, a list of rules with JSON arguments.

The rules of a response are checked inside its own row. No text and no
per-rule row crosses a shuffle, and a response with very many rules stays
one row of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import jsontext, rules
from plumbline.functions.text import bound_to
from plumbline.operators.rows import exploded

NO_IDS = "array<string>"


def rule_list(
    ids: Column,
    arguments: Column,
    *,
    falsy_is_empty: bool = False,
) -> Column:
    """Pair rule ids with parsed arguments, up to the shorter of the two lists.

    ``arguments`` are JSON texts; NULL or invalid JSON counts as ``{}``. With
    ``falsy_is_empty``, so do null, false, 0, "" and the empty list.
    """
    ids = F.coalesce(ids, F.array().cast(NO_IDS))
    arguments = F.coalesce(arguments, F.array().cast(NO_IDS))
    shared = F.least(F.size(ids), F.size(arguments))
    values = F.transform(F.slice(arguments, 1, shared), jsontext.parse_or_empty_object)
    members = F.transform(values, _members(falsy_is_empty))
    return F.zip_with(
        F.slice(ids, 1, shared),
        members,
        _rule,
    )


def _members(falsy_is_empty: bool):
    def read(value: Column) -> Column:
        members = jsontext.as_members(value)
        if not falsy_is_empty:
            return members
        empty = F.to_json(value).isin("null", "false", '""', "[]") | (
            F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False))
            & ~F.startswith(jsontext.kind(value), F.lit("STRING"))
        )
        return F.when(empty, jsontext.as_members(F.parse_json(F.lit("{}")))).otherwise(members)

    return read


def rule_items(items: Column) -> Column:
    """Rules given as a JSON list of objects, in either of two shapes.

    ``{"instruction_id_list": […], "kwargs": […]}`` pairs the two lists (one
    empty object where kwargs are missing; falsy arguments are empty ones).
    ``{"instruction_id": …, "kwargs": {…}}`` is one rule, arguments as given.
    """
    empty = F.parse_json(F.lit("{}"))

    def texts(values: Column) -> Column:
        return F.transform(values, lambda v: F.try_variant_get(v, "$", "string"))

    def as_object(value: Column) -> Column:
        text = F.when(jsontext.kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.when(text.isNull(), value).otherwise(F.coalesce(jsontext.parse(text), empty))

    def read(item: Column) -> Column:
        ids = jsontext.as_items(F.try_element_at(item, F.lit("instruction_id_list")))
        given = F.try_element_at(item, F.lit("kwargs"))
        listed = F.when(given.isNull(), F.array(empty)).otherwise(jsontext.as_items(given))
        shared = F.least(F.size(ids), F.size(listed))
        pairs = F.zip_with(
            texts(F.slice(ids, 1, shared)),
            F.transform(F.transform(F.slice(listed, 1, shared), as_object), _members(True)),
            _rule,
        )
        name = F.try_variant_get(F.try_element_at(item, F.lit("instruction_id")), "$", "string")
        members = jsontext.as_members(F.coalesce(given, empty))
        single = F.array(_rule(F.coalesce(name, F.lit("")), members))
        return F.when(ids.isNotNull(), pairs).otherwise(single)

    objects = F.transform(jsontext.as_items(jsontext.parse(items)), jsontext.as_members)
    return F.flatten(F.transform(objects, read))


def _rule(rule_id: Column, args: Column) -> Column:
    return F.struct(rule_id.alias("rule_id"), args.alias("args"))


def check_rules(
    responses: DataFrame,
    *,
    text: str = "response",
    ids: str = "instruction_id_list",
    arguments: str = "kwargs",
    falsy_is_empty: bool = False,
    only: list[str] | None = None,
) -> DataFrame:
    """Add ``per_instruction``: an array of (instruction_id, pass) in list order."""
    listed = rule_list(F.col(ids), F.col(arguments), falsy_is_empty=falsy_is_empty)
    return check_listed(responses, listed, text=text, only=only)


def check_listed(
    responses: DataFrame, listed: Column, *, text: str = "response", only: list[str] | None = None
) -> DataFrame:
    """``check_rules`` for a ready list of (rule_id, args)."""
    def outcomes(shared: Column) -> Column:
        return F.transform(
            "_rules",
            lambda r: F.struct(
                r.rule_id.alias("instruction_id"),
                rules.check(F.col(text), r.rule_id, r.args, only, shared).alias("pass"),
            ),
        )

    # Bound outside the lambda over the rules: once a response, not once a rule.
    outcome = bound_to(rules.features(F.col(text), F.transform("_rules", lambda r: r.rule_id)), outcomes)
    prepared = responses.withColumn("_rules", listed)
    return prepared.withColumn("per_instruction", outcome).drop("_rules")


def score_rules(responses: DataFrame, **options) -> DataFrame:
    """One row per response: correct iff every paired rule passes.

    ``num_instructions`` counts the whole id list, ``num_passed`` only the
    pairs; a response without rules is correct.
    """
    ids = options.get("ids", "instruction_id_list")
    checked = check_rules(responses, **options)
    correct = F.forall("per_instruction", lambda r: r["pass"])
    return (
        checked.withColumn("correct", correct)
        .withColumn("score", F.col("correct").cast("double"))
        .withColumn("num_instructions", F.greatest(F.size(F.col(ids)), F.lit(0)).cast("bigint"))
        .withColumn(
            "num_passed", F.size(F.filter("per_instruction", lambda r: r["pass"])).cast("bigint")
        )
    )


def outcomes_long(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per (response, rule): ``pos, instruction_id, pass``."""
    rows = exploded(checked, *keys, array="per_instruction", item="r")
    return rows.select(*keys, "pos", F.col("r.instruction_id"), F.col("r.pass"))


def rule_pass_rates(checked: DataFrame, *by: str) -> DataFrame:
    """Checks, passes and pass rate per rule (and per ``by`` columns)."""
    return (
        outcomes_long(checked, *by)
        .groupBy(*by, "instruction_id")
        .agg(
            F.count("*").alias("num_checked"),
            F.count_if("pass").alias("num_passed"),
            F.avg(F.col("pass").cast("double")).alias("pass_rate"),
        )
    )


def turns_long(
    samples: DataFrame,
    *keys: str,
    turns: str = "turns",
    ids: str = "instruction_id_list",
    arguments: str = "kwargs",
) -> DataFrame:
    """Per-turn rule lists from nested lists: one row per turn, 0-based.

    A turn without an id list has none. A turn past the end of the argument
    lists gets one empty object per rule, a NULL argument list one in all.
    """
    rows = exploded(
        samples,
        *keys,
        F.col(ids).alias("_ids"),
        F.col(arguments).alias("_args"),
        array=turns,
        item="prompt",
        pos="turn",
    )
    turn_ids = F.coalesce(F.get("_ids", F.col("turn")), F.array().cast(NO_IDS))
    blanks = F.array_repeat(F.lit("{}"), F.size(turn_ids))
    one_blank = F.array(F.lit("{}"))
    turn_args = F.when(
        F.col("turn") < F.size("_args"), F.coalesce(F.get("_args", F.col("turn")), one_blank)
    ).otherwise(blanks)
    return rows.select(
        *keys,
        "turn",
        "prompt",
        turn_ids.alias("instruction_id_list"),
        turn_args.alias("kwargs"),
    )


def argument_list(text: Column) -> Column:
    """Arguments of one turn given as JSON text: a list of JSON texts.

    Text that is not JSON stands for one empty object, an object for a list
    of one.
    """
    value = jsontext.parse(text)
    items = F.when(jsontext.is_array(value), jsontext.as_items(value)).otherwise(F.array(value))
    return F.when(value.isNull(), F.array(F.lit("{}"))).otherwise(
        F.transform(items, lambda v: F.to_json(v))
    )


def score_turns(
    turns: DataFrame,
    rule_turns: DataFrame,
    *,
    key: str = "sample_id",
    turn: str = "turn",
    text: str = "response",
    only: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Multi-turn scoring: outcomes per turn and per conversation.

    Turns are matched to rule lists on (conversation, turn); a turn without
    rules passes, and an errored turn is scored as empty text. Both tables
    are spread by conversation *and* turn, so one huge conversation does not
    land in one task.
    """
    joined = turns.join(rule_turns.select(key, turn, "instruction_id_list", "kwargs"), [key, turn], "left")
    filled = joined.withColumn(text, F.coalesce(text, F.lit("")))
    scored = score_rules(filled, text=text, falsy_is_empty=True, only=only)
    per_turn = scored.select(key, turn, F.col("correct").alias("pass"), "num_instructions")
    per_sample = per_turn.groupBy(key).agg(
        F.bool_and("pass").alias("correct"),
        F.count("*").alias("num_turns"),
        F.count_if("pass").alias("num_turns_passed"),
    )
    return per_turn, per_sample
