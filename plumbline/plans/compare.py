"""Side-by-side comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rows import exploded

# Rows of the comparison and where they come from.
PERFORMANCE_ROWS = [
    ("TTFT Mean (s)", "ttft_mean"),
    ("TTFT P50 (s)", "ttft_p50"),
    ("TTFT P95 (s)", "ttft_p95"),
    ("Gen TPS Mean", "generation_tps_mean"),
    ("Latency Mean (s)", "latency_mean"),
    ("Latency P95 (s)", "latency_p95"),
    ("Throughput (req/s)", "effective_throughput_rps"),
]
NOT_AVAILABLE = "N/A"


def run_label(suite: Column, model: Column, run: Column | None = None) -> Column:
    """Name of a run in a comparison; ``run`` (id or stamp) tells repeated runs apart."""
    parts = [F.coalesce(suite, F.lit("?")), F.coalesce(model, F.lit("?"))]
    return F.concat_ws(" ", *parts, *([] if run is None else [F.coalesce(run, F.lit("?"))]))


def _four(value: Column) -> Column:
    # The pattern form rounds the exact binary value, half to even, like C does.
    return F.call_function("format_number", value, F.lit("0.0000"))


def comparison_rows(summaries: DataFrame) -> DataFrame:
    """Long form: ``label, pos, metric, value`` (text) per run and row.

    ``summaries`` has one row per run: ``label``, the quality columns, the
    performance columns it knows, and ``ci_lo, ci_hi`` (NULL without rows).
    """

    def column(name: str) -> Column:
        present = name in summaries.columns
        return (F.col(name) if present else F.lit(None)).cast("double")

    interval = F.concat(
        F.lit("["), _four(column("ci_lo")), F.lit(", "), _four(column("ci_hi")), F.lit("]")
    )
    lines = [
        ("Accuracy", _four(F.coalesce(column("accuracy"), F.lit(0.0)))),
        ("Samples", F.coalesce(F.col("num_samples"), F.lit(0)).cast("string")),
        ("Score", _four(column("score"))),
        ("95% CI", F.when(column("ci_lo").isNotNull(), interval)),
        *[
            (title, F.when(column(name).isNotNull(), _four(column(name))))
            for title, name in PERFORMANCE_ROWS
        ],
    ]
    stacked = F.array(
        *[
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(title).alias("metric"),
                F.coalesce(value, F.lit("0.0000" if title == "Score" else NOT_AVAILABLE)).alias(
                    "value"
                ),
                (value.isNotNull() if title == "Score" else F.lit(True)).alias("known"),
            )
            for pos, (title, value) in enumerate(lines, start=1)
        ]
    )
    return exploded(summaries, "label", array=stacked, item="r", pos="_pos").select("label", "r.*")


def _only(name: str) -> Column:
    """The value of a group of one row."""
    return F.when(F.count(name) > 1, F.raise_error(F.lit("two runs share a label"))).otherwise(F.min(name))


def compare_runs(summaries: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per metric, one column per run in ``labels``.

    The score row appears only when some run has a score. The runs to show
    are named by the caller, so the number of columns is fixed beforehand. A
    label must stand for one run; two runs of one label are an error.
    """
    rows = comparison_rows(summaries.filter(F.col("label").isin(*labels)))
    wide = (
        rows.groupBy("pos", "metric")
        .pivot("label", list(labels))
        .agg(_only("value").alias("value"), F.bool_or("known").alias("known"))
    )
    shown = F.coalesce(*[F.nullif(F.col(f"`{n}_known`"), F.lit(False)) for n in labels], F.lit(False))
    return wide.filter(shown).select(
        "pos",
        "metric",
        *[F.coalesce(F.col(f"`{n}_value`"), F.lit(NOT_AVAILABLE)).alias(n) for n in labels],
    )
