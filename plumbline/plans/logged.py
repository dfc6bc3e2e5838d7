"""Plans of the suites whose outcome comes from more than one response.

Each takes samples and the logs of runs and gives exactly one row per run and
sample: ``sample_id, correct, score, predicted, expected, error`` and the
details kept, with ``run_id`` when a log has one. A sample that a run left no
trace of is wrong, with empty texts and the error "no response"; a request
error in a log makes its sample wrong and leaves the prediction empty.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import calls, instructions, verdicts
from plumbline.operators.pairing import RUN, apply_failures, per_run
from plumbline.operators.scoring import ECHO
from plumbline.sources import adapters

KEY = "sample_id"
# Run and sample together, while a plan works on its logs.
CASE = "_case"

# Message that returns a command's result, output it shows.
SHELL_RESULT = "Exit code: %d\nOutput:\n%s"
SHELL_OUTPUT = 2_000
NO_PATCH = "No patch extracted from response"

# Request metrics a log may carry.
MEASURES = (
    "start_ts",
    "ttft_seconds",
    "total_latency_seconds",
    "prompt_tokens",
    "completion_tokens",
    "tokens_per_second_generation",
    "tokens_per_second_prompt",
)


def judged(
    suite: str,
    samples: DataFrame,
    logs: Sequence[DataFrame],
    judge: Callable[..., DataFrame],
    seen: DataFrame,
    runs: DataFrame | None,
) -> DataFrame:
    """One row per run and sample, with the failure rules applied.

    ``judge`` gets samples and logs keyed by ``CASE`` and returns ``CASE``,
    ``correct, score, predicted, expected`` and details. ``seen`` is the log by
    which a sample counts as answered; its ``error`` is a request's error, and
    request metrics in it become the sample's: those of its last turn that
    carries any.
    """
    keys = [RUN, KEY] if any(RUN in log.columns for log in logs) or runs is not None else [KEY]

    def keyed(log: DataFrame) -> DataFrame:
        own = [F.col(k) if k in log.columns else F.lit(None).cast("string").alias(k) for k in keys]
        return log.withColumn(CASE, F.struct(*own))

    cases = keyed(per_run(samples, suite, *logs, runs=runs))
    answered = keyed(seen)
    failed = F.col("error") if "error" in seen.columns else F.lit(None).cast("string")
    measures = [m for m in MEASURES if m in seen.columns]
    turn = F.col("turn") if "turn" in seen.columns else F.lit(0)
    carries = F.coalesce(*(F.col(m).cast("string") for m in measures)).isNotNull() if measures else None
    last = [F.max_by(F.struct(*measures), F.when(carries, turn)).alias("_metrics")] if measures else []
    answered = answered.groupBy(CASE).agg(F.max(failed).alias("_failed"), F.lit(True).alias("paired"), *last)
    outcome = judge(cases, *map(keyed, logs))
    if "error" not in outcome.columns:
        outcome = outcome.withColumn("error", F.lit(None).cast("string"))
    joined = outcome.join(answered, CASE, "left").withColumns(
        {"paired": F.coalesce("paired", F.lit(False)), "error": F.coalesce("_failed", "error")}
    )
    done = apply_failures(joined)
    rest = [c for c in done.columns if c not in (CASE, "_failed", "_metrics", "paired", *keys, *measures)]
    metrics = [F.col("_metrics").getField(m).alias(m) for m in measures]
    return done.select(*(F.col(CASE).getField(k).alias(k) for k in keys), *rest, *metrics)


def score_code(
    samples: DataFrame, responses: DataFrame, program_runs: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Code completion: programs are assembled, then judged by their run log.

    The outcome needs the exit code alone, so the answer meets its run with no
    more than its cleaned and cut text.
    """

    def judge(cases: DataFrame, answers: DataFrame, log: DataFrame) -> DataFrame:
        completion = verdicts.code_text.clean_completion(F.coalesce("response", F.lit("")))
        said = answers.select(CASE, F.substring(completion, 1, verdicts.OUTPUT_ECHO).alias("completion"))
        programs = cases.select(CASE, "entry_point").join(said, CASE, "left")
        return verdicts.score_programs(programs, log, CASE)

    return judged("humaneval", samples, [responses, program_runs], judge, responses, runs)


def score_conversations(samples: DataFrame, turns: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Multi-turn instructions: every turn of the sample must follow its own rules.

    A turn of the sample that the log lacks is an empty answer.
    """

    def judge(cases: DataFrame, log: DataFrame) -> DataFrame:
        rules = instructions.turns_long(cases, CASE)
        logged = log.select(CASE, "turn", "response")
        # A turn that is not in the log counts as failed, not as absent.
        asked = rules.select(CASE, "turn").join(logged, [CASE, "turn"], "left")
        whole = asked.withColumn("response", F.coalesce("response", F.lit("")))
        _, per_sample = instructions.score_turns(whole, rules, key=CASE)
        last = logged.groupBy(CASE).agg(
            F.max_by(F.substring("response", 1, ECHO), "turn").alias("_last"), F.count("*").alias("_logged")
        )
        joined = cases.select(CASE).join(per_sample, CASE, "left").join(last, CASE, "left")
        complete = F.coalesce("_logged", F.lit(0)) >= F.coalesce("num_turns", F.lit(0))
        correct = complete & F.coalesce("correct", F.lit(True))
        return joined.select(
            CASE,
            correct.alias("correct"),
            correct.cast("double").alias("score"),
            F.coalesce("_last", F.lit("")).alias("predicted"),
            F.lit("all turns pass").alias("expected"),
            F.coalesce("num_turns", F.lit(0)).alias("num_turns"),
            F.coalesce("num_turns_passed", F.lit(0)).alias("num_turns_passed"),
        )

    return judged("multi_if", samples, [turns], judge, turns, runs)


def score_agents(
    samples: DataFrame, turns: DataFrame, runs: DataFrame | None = None, max_turns: int | None = None
) -> DataFrame:
    """Agent runs: executed actions against expected ones."""

    def judge(cases: DataFrame, log: DataFrame) -> DataFrame:
        outcome = calls.score_actions(cases, log, CASE, max_turns)
        texts = cases.select(CASE, F.substring("expected_actions", 1, calls.ECHO).alias("expected"))
        return outcome.join(texts, CASE).withColumn("predicted", F.lit(""))

    return judged("tau_bench", samples, [turns], judge, turns, runs)


def score_shell(
    samples: DataFrame,
    turns: DataFrame,
    checks: DataFrame,
    runs: DataFrame | None = None,
    max_turns: int | None = None,
) -> DataFrame:
    """Shell tasks: the validation decides, the dialogue gives the turn count.

    The echo is the last message: the result of the last command, when the log
    has its ``output``, else the last response.
    """

    def judge(cases: DataFrame, log: DataFrame, validations: DataFrame) -> DataFrame:
        kept = verdicts.dialogue_turns(log, CASE, max_turns)
        last = F.col("response")
        if "output" in log.columns:
            result = F.format_string(SHELL_RESULT, "exit_code", F.substring("output", 1, SHELL_OUTPUT))
            last = F.when(F.coalesce(F.col("command") != "", F.lit(False)), result).otherwise(last)
        used = kept.groupBy(CASE).agg(
            F.count("*").alias("num_turns"), F.max_by(F.substring(last, 1, ECHO), "turn").alias("_last")
        )
        outcome = verdicts.score_terminal(cases, validations, CASE)
        return outcome.join(used, CASE, "left").select(
            *outcome.columns,
            F.coalesce("_last", F.lit("")).alias("predicted"),
            F.coalesce("num_turns", F.lit(0)).alias("num_turns"),
        )

    return judged("terminal_bench", samples, [turns, checks], judge, turns, runs)


def score_patches(
    samples: DataFrame,
    responses: DataFrame,
    tests: DataFrame,
    order: Sequence[str] = ("pos",),
    runs: DataFrame | None = None,
    regression_tests: int | None = None,
    suite: str = "swe_bench",
) -> DataFrame:
    """Patches: a patch must be found in the response and its tests must pass.

    ``order`` names the columns that order the regression tests of a sample.
    """

    def judge(cases: DataFrame, answers: DataFrame, log: DataFrame) -> DataFrame:
        found = verdicts.extracted_patches(answers.select(CASE, "response")).select(
            CASE,
            (F.coalesce(F.col("patch"), F.lit("")) != "").alias("has_patch"),
            F.when(F.col("patch") != "", F.substring("patch", 1, verdicts.OUTPUT_ECHO))
            .otherwise(F.substring("response", 1, calls.ECHO))
            .alias("predicted"),
        )
        tasks = cases.select(CASE).join(found, CASE, "left")
        outcome = verdicts.score_test_verdicts(tasks, log, order, CASE, regression_tests)
        return outcome.join(tasks.select(CASE, "has_patch", "predicted"), CASE).select(
            *outcome.columns,
            F.coalesce("predicted", F.lit("")).alias("predicted"),
            F.when(F.col("has_patch"), F.lit("passing tests")).otherwise("").alias("expected"),
            F.when(~F.coalesce("has_patch", F.lit(False)), NO_PATCH).alias("_note"),
        )

    done = judged(suite, samples, [responses, tests], judge, responses, runs)
    # No patch is an outcome, not a failed request: texts stay.
    return done.withColumn("error", F.coalesce("error", "_note")).drop("_note")


@dataclass(frozen=True)
class LoggedSuite:
    """A suite judged by several logs.

    ``score(samples, *logs, runs=…, **options)`` takes the logs named in
    ``logs``, in that order; ``judged`` makes one of a judge.
    """

    name: str
    tier: int
    to_samples: Callable[..., DataFrame]
    score: Callable[..., DataFrame]
    logs: tuple[str, ...]


LOGGED: dict[str, LoggedSuite] = {}


def register_logged_suite(suite: LoggedSuite) -> LoggedSuite:
    """Add a suite; later registrations replace earlier ones."""
    LOGGED[suite.name] = suite
    return suite


def get_logged_suite(name: str) -> LoggedSuite:
    if name not in LOGGED:
        raise KeyError(f"no suite judged by logs {name!r}; known: {', '.join(sorted(LOGGED))}")
    return LOGGED[name]


def score_logged(
    suite: LoggedSuite, samples: DataFrame, logs: Mapping[str, DataFrame], runs: DataFrame | None = None, **options
) -> DataFrame:
    """One row per run and sample, from the logs by their names."""
    wrong = set(suite.logs) ^ set(logs)
    if wrong:
        raise ValueError(f"{suite.name} is judged by the logs {', '.join(suite.logs)}; got {', '.join(sorted(logs))}")
    return suite.score(samples, *(logs[name] for name in suite.logs), runs=runs, **options)


register_logged_suite(LoggedSuite("humaneval", 1, adapters.code_samples, score_code, ("responses", "program_runs")))
register_logged_suite(LoggedSuite("multi_if", 2, adapters.turn_samples, score_conversations, ("turns",)))
register_logged_suite(LoggedSuite("tau_bench", 3, adapters.action_samples, score_agents, ("turns",)))
register_logged_suite(LoggedSuite("terminal_bench", 4, adapters.terminal_samples, score_shell, ("turns", "checks")))
register_logged_suite(LoggedSuite("swe_bench", 4, adapters.patch_samples, score_patches, ("responses", "tests")))
register_logged_suite(
    LoggedSuite(
        "swe_bench_pro", 4, partial(adapters.patch_samples, suite="swe_bench_pro"),
        partial(score_patches, suite="swe_bench_pro"), ("responses", "tests"),
    )
)

# Suite name to (adapter, scorer).
LOGGED_SUITES = {name: (suite.to_samples, suite.score) for name, suite in LOGGED.items()}
