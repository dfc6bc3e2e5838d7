"""Answer scoring. Each job adds ``correct, score, predicted`` to its input.

The input holds ``response`` and ``expected``; every other column is kept.
Everything is computed within the row, so a job adds no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import answer_sets, choice
from plumbline.functions.text import normalize, strip

# Fixed value: length of the echoed answer text.
ECHO = 200


def read_choices(
    responses: DataFrame, num_options: int = 4, response: str = "response"
) -> DataFrame:
    """Replace the response text by its ``letter``.

    Run this before a join, so that a letter crosses the shuffle, not a text.
    """
    return responses.withColumn(
        "letter", choice.extract_letter(F.col(response), num_options)
    ).drop(response)


def judge_choices(answers: DataFrame) -> DataFrame:
    """Score rows that have ``letter`` and ``expected``."""
    return _outcome(
        answers,
        choice.choice_matches(F.col("letter"), F.col("expected")),
        F.coalesce("letter", F.lit("")),
    )


def score_choices(answers: DataFrame, num_options: int = 4) -> DataFrame:
    """Multiple choice, from response text to outcome."""
    letter = choice.extract_letter(F.col("response"), num_options)
    return judge_choices(answers.withColumn("letter", letter)).drop("letter")


def score_mixed(answers: DataFrame) -> DataFrame:
    """Multiple choice or short answer by ``question_type``.

    A short answer is right when it equals or contains the expected one in
    comparison form; equality is a case of containment.
    """
    is_choice = F.col("question_type").eqNullSafe("multiple_choice")
    prepared = answers.withColumn(
        "_letter", F.when(is_choice, choice.extract_letter(F.col("response"), 4))
    ).withColumns(
        {
            # NULL for multiple choice, so that those texts never visit Python.
            "_said": normalize(F.when(~is_choice, strip(F.col("response")))),
            "_wanted": normalize(F.when(~is_choice, F.col("expected"))),
        }
    )
    correct = F.when(
        is_choice, choice.choice_matches(F.col("_letter"), F.col("expected"))
    ).otherwise(F.contains("_said", "_wanted"))
    predicted = F.when(is_choice, F.coalesce("_letter", F.lit(""))).otherwise(
        strip(F.col("response"))
    )
    scored = _outcome(prepared, correct, F.substring(predicted, 1, ECHO))
    return scored.drop("_letter", "_said", "_wanted")


def score_retrieval(answers: DataFrame) -> DataFrame:
    """Exact and containment match, both flags kept; the response is cut for echo."""
    prepared = answers.withColumns(
        {"_said": normalize(F.col("response")), "_wanted": normalize(F.col("expected"))}
    ).withColumns(
        {
            "exact_match": F.col("_said") == F.col("_wanted"),
            "contains_match": F.contains("_said", "_wanted"),
        }
    )
    correct = F.col("exact_match") | F.col("contains_match")
    return _echoed(_outcome(prepared, correct, F.col("response"))).drop("_said", "_wanted")


def score_exact(answers: DataFrame) -> DataFrame:
    """Equality in comparison form."""
    return _outcome(
        answers, normalize(F.col("response")) == normalize(F.col("expected")), F.col("response")
    )


def score_contains(answers: DataFrame) -> DataFrame:
    """Containment in comparison form; an empty expected answer is contained."""
    said, wanted = normalize(F.col("response")), normalize(F.col("expected"))
    return _outcome(answers, F.contains(said, wanted), F.col("response"))


def score_sets(answers: DataFrame) -> DataFrame:
    """Set answers: correct iff equal, the score is their overlap."""
    prepared = answers.withColumns(
        {
            "_said": answer_sets.extract_set(F.col("response")),
            "_wanted": answer_sets.extract_set(F.col("expected")),
        }
    )
    scored = prepared.withColumns(
        {
            "correct": answer_sets.same_set(F.col("_said"), F.col("_wanted")),
            "score": answer_sets.jaccard(F.col("_said"), F.col("_wanted")),
            "predicted": F.col("response"),
        }
    )
    return _echoed(scored).drop("_said", "_wanted")


def _outcome(rows: DataFrame, correct: Column, predicted: Column) -> DataFrame:
    return rows.withColumns({"correct": correct, "predicted": predicted}).withColumn(
        "score", F.col("correct").cast("double")
    )


def _echoed(rows: DataFrame) -> DataFrame:
    """Cut the echo of the response; the stored expected answer stays whole."""
    return rows.withColumn("predicted", F.substring("predicted", 1, ECHO))
