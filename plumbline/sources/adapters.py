"""Question-set adapters: raw tables of each suite to ``samples`` tables.

Every adapter takes a table and the unique column that orders it. The result
has ``suite, sample_id, ordinal, messages`` and the typed columns of the
suite. ``max_samples`` keeps the first rows (None and 0: all rows).

A column that a source may lack is chosen by its presence; a NULL in a
present column is kept, it does not fall through to the other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.functions.choice import LETTERS
from plumbline.operators import prompts
from plumbline.operators.rows import exploded
from plumbline.operators.ordinals import numbered

TEXTS = "array<string>"


def pick(table: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first of ``names`` the table has, else ``default``."""
    for name in names:
        if name in table.columns:
            return F.col(name)
    return F.lit("") if default is None else default


def json_text(table: DataFrame, *names: str, default: str) -> Column:
    """A column as JSON text: texts stay, typed values (arrays, structs, maps, variants) are written out.

    Fields of a struct that are NULL are absent, as a struct cannot tell the two apart.
    """
    for name in names:
        if name in table.columns:
            kind = dict(table.dtypes)[name]
            return F.col(name) if kind == "string" else F.to_json(F.col(name))
    return F.lit(default)


def json_texts(table: DataFrame, name: str, depth: int = 1) -> Column:
    """A list (of lists, with ``depth`` 2) of JSON texts from a list of typed values or texts.

    One JSON text for the whole list is taken apart.
    """
    shape = "array<" * depth + "string" + ">" * depth
    if name not in table.columns:
        return F.array().cast(shape)

    def unfold(value: Column, level: int) -> Column:
        items = F.coalesce(jsontext.as_items(value), F.array().cast("array<variant>"))
        return F.transform(items, lambda v: F.to_json(v) if level == 1 else unfold(v, level - 1))

    def written(value: Column, level: int) -> Column:
        return F.transform(value, lambda v: F.to_json(v) if level == 1 else written(v, level - 1))

    kind = dict(table.dtypes)[name]
    if kind == shape:
        return F.col(name)
    if kind in ("string", "variant"):
        return unfold(jsontext.parse(F.col(name)) if kind == "string" else F.col(name), depth)
    return written(F.col(name), depth)


def _numbered(table: DataFrame, suite: str, key: str, max_samples: int | None) -> DataFrame:
    rows = numbered(table, key, max_samples)
    return rows.select(
        "*",
        F.lit(suite).alias("suite"),
        F.concat(F.lit(f"{suite}_"), F.col("ordinal")).alias("sample_id"),
    )


HEAD = ("suite", "sample_id", "ordinal")


def choice4_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``question, choices, answer`` (index) and an optional ``subject``."""
    rows = _numbered(table, "mmlu", key, max_samples)
    prompt = prompts.choice_prompt(F.col("question"), F.col("choices"), 4)
    return rows.select(
        *HEAD,
        prompts.user_message(prompt).alias("messages"),
        F.element_at(F.lit(list(LETTERS[:4])), (F.col("answer") + 1).cast("int")).alias("expected"),
        pick(table, "subject", default=F.lit("unknown")).alias("subject"),
    )


def choice10_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``question, options, answer`` (letter) and an optional ``category``."""
    rows = _numbered(table, "mmlu_pro", key, max_samples)
    prompt = prompts.choice_prompt(F.col("question"), F.col("options"), 10)
    return rows.select(
        *HEAD,
        prompts.user_message(prompt).alias("messages"),
        F.col("answer").alias("expected"),
        pick(table, "category", default=F.lit("unknown")).alias("category"),
    )


def mixed_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """Multiple choice and short answers; image questions are left out.

    They are left out after numbering and after the limit, so fewer than
    ``max_samples`` rows may remain and ids have gaps.
    """
    rows = _numbered(table, "hle", key, max_samples)
    question_type = pick(table, "question_type")
    return rows.filter(pick(table, "image", default=F.lit(None)).isNull()).select(
        *HEAD,
        prompts.user_message(prompts.mixed_prompt(F.col("question"), question_type)).alias("messages"),
        pick(table, "answer").alias("expected"),
        question_type.alias("question_type"),
    )


def long_context_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``context, question, choices, answer``; no choices is allowed."""
    rows = _numbered(table, "longbench_v2", key, max_samples)
    prompt = prompts.long_context_prompt(
        pick(table, "context"),
        pick(table, "question"),
        pick(table, "choices", default=F.array().cast(TEXTS)),
    )
    return rows.select(
        *HEAD,
        prompts.user_message(prompt).alias("messages"),
        pick(table, "answer").alias("expected"),
    )


def set_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``prompt``/``question`` and ``answer``/``expected``, the latter as text."""
    rows = _numbered(table, "graphwalks", key, max_samples)
    return rows.select(
        *HEAD,
        prompts.user_message(pick(table, "prompt", "question")).alias("messages"),
        pick(table, "answer", "expected").cast("string").alias("expected"),
    )


def retrieval_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """Ready-made ``messages``, else one message from ``prompt``/``question``."""
    rows = _numbered(table, "mrcr", key, max_samples)
    empty = F.array().cast(prompts.MESSAGES)
    prompt = pick(table, "prompt", "question")
    fallback = F.when(prompt != "", prompts.user_message(prompt)).otherwise(empty)
    given = pick(table, "messages", default=empty).cast(prompts.MESSAGES)
    return rows.select(
        *HEAD,
        F.when(F.size(given) > 0, given).otherwise(fallback).alias("messages"),
        pick(table, "answer", "expected").cast("string").alias("expected"),
        pick(table, "context_length", default=F.lit(0)).cast("bigint").alias("context_length"),
    )


def code_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``prompt, test, entry_point, task_id``; the id is the task id."""
    rows = _numbered(table, "humaneval", key, max_samples)
    return rows.select(
        "suite",
        F.col("task_id").alias("sample_id"),
        "ordinal",
        prompts.user_message(prompts.code_prompt(F.col("prompt"))).alias("messages"),
        "prompt",
        "test",
        "entry_point",
    )


def instruction_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``prompt`` with ``instruction_id_list`` and ``kwargs`` (texts or typed values)."""
    rows = _numbered(table, "ifeval", key, max_samples)
    none = F.array().cast(TEXTS)
    return rows.select(
        *HEAD,
        prompts.user_message(F.col("prompt")).alias("messages"),
        pick(table, "instruction_id_list", default=none).alias("instruction_id_list"),
        json_texts(table, "kwargs").alias("kwargs"),
    )


def turn_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``turns`` with nested rule lists; messages arise turn by turn."""
    rows = _numbered(table, "multi_if", key, max_samples)
    return rows.select(
        *HEAD,
        F.array().cast(prompts.MESSAGES).alias("messages"),
        pick(table, "turns", default=F.array().cast(TEXTS)).alias("turns"),
        pick(
            table, "instruction_id_list", default=F.array().cast("array<array<string>>")
        ).alias("instruction_id_list"),
        json_texts(table, "kwargs", depth=2).alias("kwargs"),
    )


def call_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``question`` (text or messages), ``function`` and the answer (JSON or typed)."""
    rows = _numbered(table, "bfcl", key, max_samples)
    question = pick(table, "question")
    is_text = not dict(table.dtypes).get("question", "string").startswith("array")
    return rows.select(
        *HEAD,
        (prompts.user_message(question.cast("string")) if is_text else question.cast(prompts.MESSAGES)).alias(
            "messages"
        ),
        prompts.tool_envelopes(json_text(table, "function", default="[]")).alias("tools"),
        json_text(table, "answer", "ground_truth", default="").alias("expected_raw"),
    )


def action_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """Agent tasks: instruction, tools and expected actions (JSON or typed)."""
    rows = _numbered(table, "tau_bench", key, max_samples)
    instruction = pick(table, "user_instruction", "instruction")
    return rows.select(
        *HEAD,
        prompts.user_message(instruction).alias("messages"),
        prompts.tool_envelopes(json_text(table, "tools", default="[]"), keep_typed=True).alias(
            "tools"
        ),
        json_text(table, "expected_actions", default="[]").alias("expected_actions"),
        json_text(table, "initial_state", default="{}").alias("initial_state"),
    )


def terminal_samples(table: DataFrame, key: str, max_samples: int | None = None) -> DataFrame:
    """``task``/``instruction``, ``setup`` and ``validation``/``check``."""
    rows = _numbered(table, "terminal_bench", key, max_samples)
    return rows.select(
        *HEAD,
        prompts.user_message(pick(table, "task", "instruction")).alias("messages"),
        pick(table, "setup").alias("setup"),
        pick(table, "validation", "check").alias("validation"),
    )


def patch_samples(
    table: DataFrame, key: str, max_samples: int | None = None, *, suite: str = "swe_bench"
) -> DataFrame:
    """Repository issues; the test lists are JSON or typed, invalid ones are empty."""
    prefix = {"swe_bench": "swe_", "swe_bench_pro": "swe_pro_"}[suite]
    rows = _numbered(table, suite, key, max_samples)
    default_id = F.concat(F.lit(prefix), F.col("ordinal"))
    return rows.select(
        "suite",
        pick(table, "instance_id", default=default_id).alias("sample_id"),
        "ordinal",
        prompts.user_message(pick(table, "problem_statement")).alias("messages"),
        pick(table, "repo").alias("repo"),
        pick(table, "base_commit").alias("base_commit"),
        pick(table, "patch").alias("gold_patch"),
        pick(table, "test_patch").alias("test_patch"),
        test_list(json_text(table, "FAIL_TO_PASS", default="")).alias("fail_to_pass"),
        test_list(json_text(table, "PASS_TO_PASS", default="")).alias("pass_to_pass"),
    )


def test_list(names: Column) -> Column:
    """Test names out of a JSON list; anything else is an empty list."""
    items = jsontext.as_items(jsontext.parse(names))
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast(TEXTS))


def tests_long(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per listed test: ``kind`` (f2p, p2p), 0-based ``pos``, ``test_id``."""
    entries = F.concat(
        F.transform("fail_to_pass", lambda t, i: _test("f2p", i, t)),
        F.transform("pass_to_pass", lambda t, i: _test("p2p", i, t)),
    )
    return exploded(samples, key, array=entries, item="t", pos="_pos").select(key, "t.*")


def _test(kind: str, pos: Column, test_id: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), test_id.alias("test_id"))
