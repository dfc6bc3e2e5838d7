"""The suites: names, tiers, descriptions and request settings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = pa.schema(
    [
        ("suite", pa.string()),
        ("description", pa.string()),
        ("tier", pa.int32()),
        ("system_prompt", pa.string()),
        ("max_tokens", pa.int32()),
    ]
)

_LETTER_SYSTEM = (
    "You are a knowledgeable assistant. "
    "Answer multiple-choice questions with only the letter of the correct answer."
)
_CODE_SYSTEM = (
    "You are an expert Python programmer. "
    "Complete the function as requested. Return only code, no explanations."
)

# Fixed values: (suite, description, tier, system prompt, token limit).
_SUITES = [
    ("mmlu", "Massive Multitask Language Understanding — 15,908 MCQ, 57 subjects", 1, _LETTER_SYSTEM, 32),
    ("mmlu_pro", "MMLU-Pro — 12,000+ MCQ with 10 options per question", 1, _LETTER_SYSTEM, 64),
    ("humaneval", "HumanEval — 164 Python code generation tasks with execution-based evaluation", 1, _CODE_SYSTEM, 512),
    ("ifeval", "IFEval — ~500 instruction-following tasks with verifiable constraints", 1, None, 2048),
    ("hle", "Humanity's Last Exam — 2,500 expert-level MCQ and short-answer questions", 1, None, 256),
    ("longbench_v2", "LongBench v2 — 503 long-context MCQ spanning 8k to 2M words", 1, None, 32),
    ("graphwalks", "GraphWalks — 1,150 graph reasoning tasks with set comparison", 1, None, 512),
    ("multi_if", "Multi-IF — 4,501 multi-turn multilingual instruction following (3 turns)", 2, None, None),
    ("mrcr", "MRCR — 2,400 multi-round long-context needle retrieval (4k to 1M tokens)", 2, None, 256),
    ("bfcl", "BFCL — Berkeley Function Calling Leaderboard with AST-based evaluation", 3, None, 512),
    ("tau_bench", "TAU-Bench — Multi-turn agentic tasks with simulated tool execution", 3, None, 1024),
    ("terminal_bench", "Terminal-Bench — 89 CLI tasks executed in Docker containers", 4, None, 1024),
    ("swe_bench", "SWE-bench Verified — 500 real-world software engineering tasks in Docker", 4, None, 4096),
    ("swe_bench_pro", "SWE-bench Pro — 1,865 extended real-world software engineering tasks", 4, None, 4096),
]


def suites(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """One row per suite, sorted by name. ``extra`` adds user suites."""
    rows = sorted(_SUITES + list(extra or []), key=lambda row: row[0])
    # An Arrow table becomes a local relation: no Python worker, known size.
    table = pa.Table.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in rows], SCHEMA)
    return spark.createDataFrame(table)


def suite_names(extra: list[tuple] | None = None) -> list[str]:
    return sorted(row[0] for row in _SUITES + list(extra or []))


def require_suite(name: str, extra: list[tuple] | None = None) -> str:
    """``name`` itself, or a KeyError that lists the known suites."""
    known = suite_names(extra)
    if name not in known:
        raise KeyError(f"unknown suite {name!r}; known suites: {', '.join(known)}")
    return name
