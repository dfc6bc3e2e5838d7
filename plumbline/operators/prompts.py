"""Prompt and request building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.functions.choice import LETTERS

MESSAGES = "array<struct<role:string,content:string>>"

# Texts the prompts are made of.
LETTER_ONLY = "Answer with the letter only."
CONCISE = "Provide a concise answer."
CODE_INTRO = (
    "Complete the following Python function. "
    "Return only the function body (no explanation, no markdown).\n\n"
)
TERMINAL_SYSTEM = (
    "You are a Linux CLI expert. Execute commands to complete the task. "
    "Respond with a bash command to execute. Wrap commands in ```bash\\n...\\n```."
)
TERMINAL_QUESTION = "\n\nYou have access to a bash shell. What command should I run?"
PATCH_SYSTEM = (
    "You are an expert software engineer fixing a bug in a repository at /workspace/repo. "
    "Generate a unified diff patch that fixes the issue. "
    "Wrap the patch in ```diff\\n...\\n```."
)
PATCH_INTRO = "Fix this issue:\n\n"


def option_lines(choices: Column, num_options: int) -> Column:
    """``A. first`` lines; choices beyond ``num_options`` are left out."""
    letters = F.lit(list(LETTERS[:num_options]))
    lines = F.transform(
        F.slice(choices, 1, num_options),
        lambda choice, i: F.concat(F.get(letters, i), F.lit(". "), choice),
    )
    return F.array_join(lines, "\n")


def choice_prompt(question: Column, choices: Column, num_options: int) -> Column:
    """Question, blank line, lettered options, blank line, closing sentence."""
    listed = F.when(
        F.size(choices) > 0, F.concat(option_lines(choices, num_options), F.lit("\n"))
    ).otherwise("")
    return F.concat(question, F.lit("\n\n"), listed, F.lit("\n" + LETTER_ONLY))


def mixed_prompt(question: Column, question_type: Column) -> Column:
    closing = F.when(question_type == "multiple_choice", LETTER_ONLY).otherwise(CONCISE)
    return F.concat(question, F.lit("\n\n"), closing)


def long_context_prompt(context: Column, question: Column, choices: Column) -> Column:
    """Context, question and up to four options; more than four is an error."""
    block = F.when(
        F.size(choices) > len(LETTERS[:4]),
        F.raise_error(F.lit("a long-context question has at most 4 choices")),
    ).when(F.size(choices) > 0, F.concat(option_lines(choices, 4), F.lit("\n\n")))
    return F.concat(
        context,
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\n"),
        F.coalesce(block, F.lit("")),
        F.lit(LETTER_ONLY),
    )


def code_prompt(stub: Column) -> Column:
    return F.concat(F.lit(CODE_INTRO), stub)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_message(content: Column) -> Column:
    return F.array(message("user", content))


def terminal_messages(task: Column) -> Column:
    question = F.concat(F.lit("Task: "), task, F.lit(TERMINAL_QUESTION))
    return F.array(message("system", F.lit(TERMINAL_SYSTEM)), message("user", question))


def patch_messages(problem: Column) -> Column:
    return F.array(
        message("system", F.lit(PATCH_SYSTEM)),
        message("user", F.concat(F.lit(PATCH_INTRO), problem)),
    )


def with_system(messages: Column, system_prompt: Column) -> Column:
    """Prepend the system prompt unless one is there or none is given."""
    present = F.get(messages, F.lit(0)).getField("role").eqNullSafe("system")
    has_prompt = F.coalesce(system_prompt != "", F.lit(False))
    prompt = F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))
    return F.when(has_prompt & ~present, F.concat(F.array(prompt), messages)).otherwise(messages)


def tool_envelopes(functions: Column, *, keep_typed: bool = False) -> Column:
    """Function definitions (JSON text) as an array of tool JSON texts.

    Items that are no objects are dropped. With ``keep_typed``, a definition
    that already carries ``type`` stays as it is.
    """
    items = F.coalesce(
        jsontext.as_items(jsontext.parse(functions)), F.array().cast("array<variant>")
    )
    objects = F.filter(items, jsontext.is_object)

    def wrap(item: Column) -> Column:
        plain = F.to_json(item)
        wrapped = F.concat(F.lit('{"type":"function","function":'), plain, F.lit("}"))
        if not keep_typed:
            return wrapped
        has_type = F.try_variant_get(item, "$.type", "variant").isNotNull()
        return F.when(has_type, plain).otherwise(wrapped)

    return F.transform(objects, wrap)


def request_bodies(
    samples: DataFrame,
    suites: DataFrame,
    *,
    model: str,
    max_tokens: int,
    temperature: float | None = None,
    seed: int | None = None,
    stream: bool = True,
) -> DataFrame:
    """Add ``request_max_tokens`` and the JSON ``body`` of each request.

    The suite's token limit always wins over the run's, and its system prompt,
    if it has one, goes first. A NULL temperature or seed does not appear in
    the body. ``suites`` has one row per suite; Spark broadcasts it by its size.
    """
    prompt = "system_prompt" if "system_prompt" in suites.columns else None
    limits = suites.select(
        "suite",
        F.col("max_tokens").alias("_suite_limit"),
        (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("_system"),
    )
    joined = samples.join(limits, "suite", "left").withColumn(
        "request_max_tokens", F.coalesce("_suite_limit", F.lit(max_tokens)).cast("bigint")
    )
    fields = [
        F.lit(model).alias("model"),
        with_system(F.col("messages"), F.col("_system")).alias("messages"),
        F.lit(stream).alias("stream"),
        F.col("request_max_tokens").alias("max_tokens"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(seed).cast("bigint").alias("seed"),
    ]
    body = F.to_json(F.struct(*fields))
    if "tools" in samples.columns:
        # Tools are JSON texts already: spliced in, so they are not quoted again.
        tools = F.concat(F.lit(',"tools":['), F.array_join("tools", ","), F.lit("]}"))
        body = F.when(
            F.size("tools") > 0, F.concat(F.regexp_replace(body, r"\}\z", ""), tools)
        ).otherwise(body)
    return joined.withColumn("body", body).drop("_suite_limit", "_system")
