"""Suites as plans: how each one builds samples and scores responses.

A suite is a pair of DataFrame functions. New ones are added with
``register_suite``; running one is ``DataFrame.transform`` all the way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import calls, instructions, pairing, quality, scoring
from plumbline.sources import adapters


@dataclass(frozen=True)
class Suite:
    """``to_samples(table, key, max_samples)`` and ``score(answers)``.

    ``score`` gets samples joined with their responses and adds ``correct,
    score, predicted``. ``shrink`` may reduce responses before that join, so
    that less crosses the shuffle. ``subject`` names the column quality is
    split by.
    """

    name: str
    tier: int
    to_samples: Callable[..., DataFrame]
    score: Callable[[DataFrame], DataFrame]
    shrink: Callable[[DataFrame], DataFrame] | None = None
    subject: str | None = None


SUITES: dict[str, Suite] = {}


def register_suite(suite: Suite) -> Suite:
    SUITES[suite.name] = suite
    return suite


def get_suite(name: str) -> Suite:
    if name not in SUITES:
        raise KeyError(
            f"no single-response suite {name!r}; known: {', '.join(sorted(SUITES))}. "
            "Suites judged by several logs are in plumbline.plans.logged."
        )
    return SUITES[name]


def score_suite(
    suite: Suite, samples: DataFrame, responses: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Pair, score and apply the failure rules: one row per run and sample.

    ``responses`` has ``suite, sample_id, response`` and optionally ``run_id``,
    ``error`` and metric columns, which are kept. ``runs`` names runs that may
    have answered nothing.
    """
    # A message without content is an empty answer, not an unknown one.
    answered = responses.withColumn("response", F.coalesce("response", F.lit("")))
    shrunk = suite.shrink(answered) if suite.shrink else answered
    paired = pairing.pair_responses(samples.drop("messages"), shrunk, runs=runs)
    return pairing.apply_failures(suite.score(paired))


def run_summary(suite: Suite, results: DataFrame) -> DataFrame:
    """Quality per subject and overall, or overall only."""
    if suite.subject:
        return quality.quality_rollup(results, suite.subject)
    return quality.run_quality(results)


def _rules(answers: DataFrame) -> DataFrame:
    return (
        instructions.score_rules(answers)
        .withColumn("predicted", F.substring("response", 1, scoring.ECHO))
        .withColumn("expected", F.lit("all instructions followed"))
    )


def _calls(answers: DataFrame) -> DataFrame:
    return calls.score_calls(answers.withColumn("expected", F.col("expected_raw")))


register_suite(
    Suite(
        "mmlu", 1, adapters.choice4_samples, scoring.judge_choices,
        shrink=lambda r: scoring.read_choices(r, 4), subject="subject",
    )
)
register_suite(
    Suite(
        "mmlu_pro", 1, adapters.choice10_samples, scoring.judge_choices,
        shrink=lambda r: scoring.read_choices(r, 10), subject="category",
    )
)
register_suite(
    Suite(
        "longbench_v2", 1, adapters.long_context_samples, scoring.judge_choices,
        shrink=lambda r: scoring.read_choices(r, 4),
    )
)
register_suite(
    Suite("hle", 1, adapters.mixed_samples, scoring.score_mixed, subject="question_type")
)
register_suite(Suite("graphwalks", 1, adapters.set_samples, scoring.score_sets))
register_suite(
    Suite("mrcr", 2, adapters.retrieval_samples, scoring.score_retrieval, subject="context_length")
)
register_suite(Suite("ifeval", 1, adapters.instruction_samples, _rules))
register_suite(Suite("bfcl", 3, adapters.call_samples, _calls))
