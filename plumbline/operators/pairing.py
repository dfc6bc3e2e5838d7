"""Pairing samples with responses, and what a failed request scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("suite", "sample_id")
NO_RESPONSE = "no response"


RUN = "run_id"


def pair_responses(
    samples: DataFrame,
    responses: DataFrame,
    keys: Sequence[str] = KEYS,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Every sample with its response; ``paired`` is false where none arrived.

    Samples are unique per key, responses need not be (repeated attempts). An
    inner join from the response side lets adaptive execution split a key that
    owns a large share of the responses, which it could not do on the optional
    side of an outer join. Samples without a response are added by an anti join
    against the distinct keys.

    With a ``run_id`` in ``responses`` every run must answer every sample of
    its suites. ``runs`` (``run_id, suite``) names runs that must appear even
    when they answered nothing.

    Responses to no sample are left out. Columns of ``responses`` are NULL
    for samples without one.
    """
    keys = list(keys)
    matched = responses.join(samples, keys).withColumn("paired", F.lit(True))
    wanted, full = samples, keys
    if RUN in responses.columns:
        known = responses.select(RUN, "suite")
        known = (known if runs is None else known.unionByName(runs.select(RUN, "suite"))).distinct()
        wanted, full = samples.join(known, "suite"), [RUN, *keys]
    answered = responses.select(*full).distinct()
    missing = wanted.join(answered, full, "left_anti").withColumn("paired", F.lit(False))
    return matched.unionByName(missing, allowMissingColumns=True)


def per_run(samples: DataFrame, suite: str, *logs: DataFrame | None, runs: DataFrame | None = None) -> DataFrame:
    """``samples`` once for every run that any log or ``runs`` names.

    Without a ``run_id`` anywhere the samples stay as they are. The runs are
    joined by suite, so a run meets the samples of its own suite alone.
    """
    named = [t.select(RUN) for t in (*logs, runs) if t is not None and RUN in t.columns]
    if not named:
        return samples
    known = named[0]
    for table in named[1:]:
        known = known.unionByName(table)
    known = known.distinct().withColumn("suite", F.lit(suite))
    kept = samples if "suite" in samples.columns else samples.withColumn("suite", F.lit(suite))
    return kept.join(known, "suite")


def repeated_responses(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one response, for callers that expect just one."""
    counts = responses.groupBy(*keys).agg(F.count("*").alias("num_responses"))
    return counts.filter("num_responses > 1")


def apply_failures(scored: DataFrame) -> DataFrame:
    """Replace the outcome of samples that could not be scored.

    No response, or an answer whose scoring ``raised``: wrong, score 0, empty
    texts. A request error: wrong, score 0, empty prediction, the expected
    answer stays.
    """
    if "raised" not in scored.columns:
        scored = scored.withColumn("raised", F.lit(False))
    told = F.col("paired") & ~F.coalesce("raised", F.lit(False))
    if "error" not in scored.columns:
        scored = scored.withColumn("error", F.lit(None).cast("string"))
    error = F.when(F.col("paired"), F.col("error")).otherwise(
        F.coalesce("error", F.lit(NO_RESPONSE))
    )
    ok = error.isNull()
    return scored.withColumns(
        {
            "correct": F.coalesce(F.when(ok, F.col("correct")), F.lit(False)),
            "score": F.coalesce(F.when(ok, F.col("score")), F.lit(0.0)),
            "predicted": F.when(ok, F.col("predicted")).otherwise(""),
            "expected": F.when(told, F.coalesce("expected", F.lit(""))).otherwise(""),
            "error": error,
        }
    ).drop("raised")
