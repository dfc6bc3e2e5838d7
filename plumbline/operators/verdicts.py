"""Code, terminal and patch suites: text in, verdict logs in, outcomes out.

Programs, commands and tests are run elsewhere; their exit codes and verdicts
arrive as tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import code_text

# Echo lengths, most dialogue turns, regression tests that count.
OUTPUT_ECHO = 500
TERMINAL_TURNS = 15
REGRESSION_TESTS = 10


def programs(answers: DataFrame) -> DataFrame:
    """Add ``completion`` and the runnable ``program`` to code answers."""
    cleaned = answers.withColumn("completion", code_text.clean_completion(F.col("response")))
    return cleaned.withColumn(
        "program",
        code_text.assemble_program(
            F.col("prompt"), F.col("completion"), F.col("test"), F.col("entry_point")
        ),
    )


def score_programs(answers: DataFrame, runs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Join programs with the log of their runs (``exit_code, output``).

    A program passes with exit code 0; one that never ran fails.
    """
    logged = runs.select(key, "exit_code", F.substring("output", 1, OUTPUT_ECHO).alias("output"))
    correct = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    programs_only = answers.select(key, "completion", "entry_point")
    return programs_only.join(logged, key, "left").select(
        key,
        correct.alias("correct"),
        correct.cast("double").alias("score"),
        F.substring("completion", 1, OUTPUT_ECHO).alias("predicted"),
        F.concat(F.lit("passes "), F.col("entry_point"), F.lit(" tests")).alias("expected"),
        F.coalesce("output", F.lit("")).alias("output"),
    )


def dialogue_turns(
    turns: DataFrame, key: str = "sample_id", max_turns: int | None = None
) -> DataFrame:
    """Turns of a shell dialogue up to its stop, with ``command`` and ``stops``.

    A dialogue stops at the first turn without a command, or with exit code 0
    and "done" in the response; ``max_turns`` leaves later turns out. The stop is
    found by a grouped minimum and joined back: a window would gather a whole
    dialogue in one task.
    """
    command = code_text.extract_command(F.col("response"))
    finished = (F.col("exit_code") == 0) & F.contains(F.lower("response"), F.lit("done"))
    no_command = F.coalesce(F.col("command") == "", F.lit(True))
    marked = (
        (turns if max_turns is None else turns.filter(F.col("turn") < max_turns))
        .withColumn("command", command)
        .withColumn("stops", no_command | F.coalesce(finished, F.lit(False)))
    )
    stop = marked.filter("stops").groupBy(key).agg(F.min("turn").alias("_stop"))
    kept = marked.join(stop, key, "left").filter(
        F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop"))
    )
    return kept.drop("_stop")


def dialogue_summary(kept: DataFrame, key: str = "sample_id") -> DataFrame:
    """Turns used, commands run and whether the dialogue stopped by itself."""
    return kept.groupBy(key).agg(
        F.count("*").alias("num_turns"),
        F.count_if(F.coalesce(F.col("command") != "", F.lit(False))).alias("num_commands"),
        F.bool_or("stops").alias("stopped"),
    )


def terminal_correct(validation: Column, exit_code: Column) -> Column:
    """A task without a validation passes; else the validation must exit 0."""
    none = F.coalesce(validation == "", F.lit(True))
    return F.when(none, True).otherwise(F.coalesce(exit_code == 0, F.lit(False)))


def score_terminal(samples: DataFrame, checks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Join tasks (``validation``) with the log of validation exit codes."""
    correct = terminal_correct(F.col("validation"), F.col("exit_code"))
    return samples.join(checks.select(key, "exit_code"), key, "left").select(
        key,
        correct.alias("correct"),
        correct.cast("double").alias("score"),
        F.lit("task completed").alias("expected"),
    )


def extracted_patches(answers: DataFrame) -> DataFrame:
    return answers.withColumn("patch", code_text.extract_patch(F.col("response")))


def first_tests(
    verdicts: DataFrame, order: Sequence[str], key: str = "sample_id", n: int = REGRESSION_TESTS
) -> DataFrame:
    """The first ``n`` verdicts per sample, in ``order``.

    Spark limits each group before the shuffle, so a sample with very many
    verdicts sends ``n`` rows per task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    ranked = verdicts.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def score_test_verdicts(
    samples: DataFrame,
    verdicts: DataFrame,
    order: Sequence[str] = ("pos",),
    key: str = "sample_id",
    regression_tests: int | None = None,
) -> DataFrame:
    """Patch outcome from test verdicts (``kind, passed`` and the order columns).

    All ``f2p`` tests must pass, and there must be one; all ``p2p`` tests, or
    the first ``regression_tests`` of them, must pass, none is fine. ``has_patch`` of the sample false
    or missing: wrong.
    """
    target = (
        verdicts.filter(F.col("kind") == "f2p")
        .groupBy(key)
        .agg(F.bool_and("passed").alias("f2p"), F.count("*").alias("num_f2p"))
    )
    kept = verdicts.filter(F.col("kind") == "p2p")
    if regression_tests is not None:
        kept = first_tests(kept, order, key, regression_tests)
    regression = (
        kept.groupBy(key)
        .agg(F.bool_and("passed").alias("p2p"), F.count("*").alias("num_p2p"))
    )
    joined = samples.select(key, "has_patch").join(target, key, "left").join(regression, key, "left")
    has_patch = F.coalesce("has_patch", F.lit(False))
    f2p, p2p = F.coalesce("f2p", F.lit(False)), F.coalesce("p2p", F.lit(True))
    correct = has_patch & f2p & p2p
    return joined.select(
        key,
        correct.alias("correct"),
        correct.cast("double").alias("score"),
        f2p.alias("f2p_pass"),
        p2p.alias("p2p_pass"),
        F.coalesce("num_f2p", F.lit(0)).alias("num_f2p"),
        F.coalesce("num_p2p", F.lit(0)).alias("num_p2p"),
    )
