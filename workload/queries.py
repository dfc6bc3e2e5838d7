"""The registered queries and their DuckDB counterparts.

Each query reads whole given tables through a fixture, runs library jobs and
returns columns of plain types, so that both engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import configure
from plumbline.functions import answer_sets, choice, code_text, rules
from plumbline.functions.text import normalize
from plumbline.operators import (
    calls,
    instructions,
    multisets,
    pairing,
    percentiles,
    prompts,
    quality,
    requests,
    scoring,
    turns,
    verdicts,
)
from plumbline.operators.layout import spread
from plumbline.operators.ordinals import numbered
from plumbline.operators.rows import exploded
from plumbline.plans import compare, logged
from plumbline.plans.report import run_report
from plumbline.plans.suites import Suite, get_suite, run_summary, score_suite
from plumbline.session import shared_path
from plumbline.sources import adapters, catalog, documents, logs, results
from plumbline.streaming import live
from plumbline.streaming import requests as live_requests
from workload import duck
from workload import fixtures as fx
from workload.fixtures import duck as table
from workload.fixtures import frame

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Rounding of doubles on both sides. The inputs have five decimals, so shares
# and means of a few values would be exact ties at six.
DIGITS = 9


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can say the same, its counterpart."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def ordinal(key: str) -> str:
    return f"(row_number() OVER (ORDER BY {key}) - 1)"


def first_content(messages: str = "messages"):
    return F.get(messages, F.lit(0)).getField("content")


# --- question sets: samples and prompts --------------------------------------

CHOICES = table(fx.choices)
CHOICES10 = table(fx.choices, 10)


def _lettered(n: int) -> str:
    lines = [f"'{c}. ' || choices[{i + 1}]" for i, c in enumerate("ABCDEFGHIJ"[:n])]
    return " || chr(10) || ".join(lines)


_PROMPT4 = f"question || chr(10) || chr(10) || {_lettered(4)} || chr(10) || chr(10) || 'Answer with the letter only.'"
_PROMPT10 = f"question || chr(10) || chr(10) || {_lettered(10)} || chr(10) || chr(10) || 'Answer with the letter only.'"


@query(
    "samples_mcq4",
    f"""SELECT 'mmlu' AS suite, 'mmlu_' || {ordinal('event_id')} AS sample_id,
    {ordinal('event_id')} AS ordinal, expected, subject FROM {CHOICES}""",
)
def samples_mcq4(spark, sf_dir):
    rows = adapters.choice4_samples(frame(spark, sf_dir, fx.choices), "event_id")
    return rows.drop("messages")


@query(
    "prompt_mcq4",
    f"SELECT 'mmlu_' || {ordinal('event_id')} AS sample_id, 'user' AS role, {_PROMPT4} AS prompt FROM {CHOICES}",
)
def prompt_mcq4(spark, sf_dir):
    rows = adapters.choice4_samples(frame(spark, sf_dir, fx.choices), "event_id")
    role = F.get("messages", F.lit(0)).getField("role")
    return rows.select("sample_id", role.alias("role"), first_content().alias("prompt"))


@query(
    "samples_mcq10",
    f"""SELECT 'mmlu_pro' AS suite, 'mmlu_pro_' || {ordinal('event_id')} AS sample_id,
    {ordinal('event_id')} AS ordinal, expected, subject AS category FROM {CHOICES10}""",
)
def samples_mcq10(spark, sf_dir):
    return _choices10(spark, sf_dir).drop("messages")


def _choices10(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.choices, 10).select(
        "event_id",
        "question",
        F.col("choices").alias("options"),
        F.col("expected").alias("answer"),
        F.col("subject").alias("category"),
    )
    return adapters.choice10_samples(raw, "event_id")


@query(
    "prompt_mcq10",
    f"SELECT 'mmlu_pro_' || {ordinal('event_id')} AS sample_id, {_PROMPT10} AS prompt FROM {CHOICES10}",
)
def prompt_mcq10(spark, sf_dir):
    return _choices10(spark, sf_dir).select("sample_id", first_content().alias("prompt"))


@query(
    "first_n_samples",
    f"""SELECT 'mmlu_' || {ordinal('event_id')} AS sample_id, subject, expected
    FROM (SELECT * FROM {CHOICES} ORDER BY event_id LIMIT 250)""",
)
def first_n_samples(spark, sf_dir):
    rows = adapters.choice4_samples(frame(spark, sf_dir, fx.choices), "event_id", max_samples=250)
    return rows.select("sample_id", "subject", "expected")


ANSWERS = table(fx.answers)
_CONTENT = "CASE WHEN question_type = 'multiple_choice' THEN 'Answer with the letter only.' ELSE 'Provide a concise answer.' END"


def _mixed(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.answers, spread_out=True).select(
        "doc_id", F.col("text").alias("question"), F.col("expected").alias("answer"), "question_type", "image"
    )
    return adapters.mixed_samples(raw, "doc_id")


@query(
    "samples_mixed",
    f"""SELECT sample_id, ordinal, expected, question_type FROM (
    SELECT 'hle_' || {ordinal('doc_id')} AS sample_id, {ordinal('doc_id')} AS ordinal, * FROM {ANSWERS})
    WHERE image IS NULL""",
)
def samples_mixed(spark, sf_dir):
    return _mixed(spark, sf_dir).drop("messages", "suite")


@query(
    "prompt_mixed",
    f"""SELECT sample_id, text || chr(10) || chr(10) || {_CONTENT} AS prompt FROM (
    SELECT 'hle_' || {ordinal('doc_id')} AS sample_id, * FROM {ANSWERS}) WHERE image IS NULL""",
)
def prompt_mixed(spark, sf_dir):
    return _mixed(spark, sf_dir).select("sample_id", first_content().alias("prompt"))


def _long_context(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.answers, spread_out=True).select(
        "doc_id",
        F.col("text").alias("context"),
        F.concat(F.lit("Which language is it? "), F.col("doc_id")).alias("question"),
        F.when(F.col("question_type") == "multiple_choice", F.array(*map(F.lit, ("en", "fr", "de", "es"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("choices"),
        F.col("lang").alias("answer"),
    )
    return adapters.long_context_samples(raw, "doc_id")


@query(
    "samples_longctx",
    f"""SELECT 'longbench_v2' AS suite, 'longbench_v2_' || {ordinal('doc_id')} AS sample_id,
    {ordinal('doc_id')} AS ordinal, lang AS expected FROM {ANSWERS}""",
)
def samples_longctx(spark, sf_dir):
    return _long_context(spark, sf_dir).drop("messages")


@query(
    "prompt_longctx",
    f"""SELECT 'longbench_v2_' || {ordinal('doc_id')} AS sample_id,
    text || chr(10) || chr(10) || 'Question: Which language is it? ' || doc_id || chr(10) || chr(10)
    || CASE WHEN question_type = 'multiple_choice' THEN
       array_to_string(['A. en', 'B. fr', 'C. de', 'D. es'], chr(10)) || chr(10) || chr(10) ELSE '' END
    || 'Answer with the letter only.' AS prompt FROM {ANSWERS}""",
)
def prompt_longctx(spark, sf_dir):
    return _long_context(spark, sf_dir).select("sample_id", first_content().alias("prompt"))


SETS = table(fx.set_answers)


@query(
    "samples_set",
    f"""SELECT 'graphwalks_' || {ordinal('doc_id')} AS sample_id, expected,
    'List the parts: ' || response AS prompt FROM {SETS}""",
)
def samples_set(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.set_answers, spread_out=True).select(
        "doc_id", F.concat(F.lit("List the parts: "), "response").alias("question"), "expected"
    )
    rows = adapters.set_samples(raw, "doc_id")
    return rows.select("sample_id", "expected", first_content().alias("prompt"))


@query(
    "samples_retrieval",
    f"""SELECT 'mrcr_' || {ordinal('doc_id')} AS sample_id, expected, context_length,
    (CASE WHEN image IS NULL THEN 2 WHEN text = '' THEN 0 ELSE 1 END)::BIGINT AS num_messages, text AS first_content
    FROM {ANSWERS}""",
)
def samples_retrieval(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.answers, spread_out=True).select(
        "doc_id",
        F.col("text").alias("prompt"),
        F.when(
            F.col("image").isNull(),
            F.array(prompts.message("user", F.col("text")), prompts.message("assistant", F.col("lang"))),
        )
        .otherwise(F.array().cast(prompts.MESSAGES))
        .alias("messages"),
        "expected",
        "context_length",
    )
    rows = adapters.retrieval_samples(raw, "doc_id")
    return rows.select(
        "sample_id",
        "expected",
        "context_length",
        F.size("messages").cast("bigint").alias("num_messages"),
        first_content().alias("first_content"),
    )


CODE = table(fx.code_answers)


def _code(spark, sf_dir):
    return adapters.code_samples(frame(spark, sf_dir, fx.code_answers, spread_out=True), "doc_id")


@query(
    "samples_code",
    f"SELECT task_id AS sample_id, {ordinal('doc_id')} AS ordinal, prompt, test, entry_point FROM {CODE}",
)
def samples_code(spark, sf_dir):
    return _code(spark, sf_dir).drop("messages", "suite")


@query(
    "prompt_code",
    f"SELECT task_id AS sample_id, {fx.literal(prompts.CODE_INTRO)} || prompt AS prompt FROM {CODE}",
)
def prompt_code(spark, sf_dir):
    return _code(spark, sf_dir).select("sample_id", first_content().alias("prompt"))


TASKS = table(fx.agent_tasks)


def _terminal(spark, sf_dir):
    return adapters.terminal_samples(
        frame(spark, sf_dir, fx.agent_tasks).drop("sample_id"), "conv_id"
    )


@query(
    "samples_terminal",
    f"""SELECT 'terminal_bench_' || {ordinal('conv_id')} AS sample_id, validation, '' AS setup,
    instruction AS task FROM {TASKS}""",
)
def samples_terminal(spark, sf_dir):
    rows = _terminal(spark, sf_dir)
    return rows.select("sample_id", "validation", "setup", first_content().alias("task"))


@query(
    "prompt_terminal",
    f"""SELECT 'terminal_bench_' || {ordinal('conv_id')} AS sample_id, 2::BIGINT AS num_messages,
    'Task: ' || instruction || chr(10) || chr(10)
    || 'You have access to a bash shell. What command should I run?' AS prompt FROM {TASKS}""",
)
def prompt_terminal(spark, sf_dir):
    messages = prompts.terminal_messages(first_content())
    rows = _terminal(spark, sf_dir).withColumn("messages", messages)
    return rows.select(
        "sample_id",
        F.size("messages").cast("bigint").alias("num_messages"),
        F.get("messages", F.lit(1)).getField("content").alias("prompt"),
    )


PATCH_TASKS = table(fx.patch_tasks)


def _patches(spark, sf_dir):
    return adapters.patch_samples(frame(spark, sf_dir, fx.patch_tasks), "o_orderkey")


@query(
    "prompt_patch",
    f"SELECT instance_id AS sample_id, {fx.literal(prompts.PATCH_INTRO)} || problem_statement AS prompt FROM {PATCH_TASKS}",
)
def prompt_patch(spark, sf_dir):
    rows = _patches(spark, sf_dir).withColumn("messages", prompts.patch_messages(first_content()))
    return rows.select("sample_id", F.get("messages", F.lit(1)).getField("content").alias("prompt"))


@query(
    "swe_tests_long",
    f"""WITH s AS (SELECT instance_id AS sample_id,
      CASE WHEN json_valid(FAIL_TO_PASS) THEN from_json(FAIL_TO_PASS, '["varchar"]') ELSE [] END AS f,
      CASE WHEN json_valid(PASS_TO_PASS) THEN from_json(PASS_TO_PASS, '["varchar"]') ELSE [] END AS p
      FROM {PATCH_TASKS})
    SELECT sample_id, 'f2p' AS kind, unnest(range(len(f))) AS pos, unnest(f) AS test_id FROM s
    UNION ALL SELECT sample_id, 'p2p', unnest(range(len(p))), unnest(p) FROM s""",
)
def swe_tests_long(spark, sf_dir):
    rows = adapters.tests_long(_patches(spark, sf_dir))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


CALLS = table(fx.call_log)


def _call_samples(spark, sf_dir):
    return adapters.call_samples(frame(spark, sf_dir, fx.call_log, spread_out=True), "event_id")


@query(
    "samples_calls",
    f"""SELECT 'bfcl_' || {ordinal('event_id')} AS sample_id, question, answer AS expected_raw,
    1::BIGINT AS num_tools FROM {CALLS}""",
)
def samples_calls(spark, sf_dir):
    return _call_samples(spark, sf_dir).select(
        "sample_id",
        first_content().alias("question"),
        "expected_raw",
        F.size("tools").cast("bigint").alias("num_tools"),
    )


@query(
    "tool_envelopes",
    f"""SELECT 'bfcl_' || {ordinal('event_id')} AS sample_id,
    '{{"type":"function","function":' || json_extract(function, '$[0]')::varchar || '}}' AS tool FROM {CALLS}""",
)
def tool_envelopes(spark, sf_dir):
    return exploded(_call_samples(spark, sf_dir), "sample_id", array="tools", item="tool").drop("pos")


@query(
    "tool_envelopes_typed",
    f"""SELECT 'tau_bench_' || {ordinal('conv_id')} AS sample_id, instruction, 2::BIGINT AS num_tools,
    '{{"type":"function","function":{{"name":"lookup"}}}}' AS first_tool,
    '{{"function":{{"name":"update"}},"type":"function"}}' AS second_tool FROM {TASKS}""",
)
def tool_envelopes_typed(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.agent_tasks).drop("sample_id")
    rows = adapters.action_samples(raw, "conv_id")
    return rows.select(
        "sample_id",
        first_content().alias("instruction"),
        F.size("tools").cast("bigint").alias("num_tools"),
        F.get("tools", F.lit(0)).alias("first_tool"),
        F.get("tools", F.lit(1)).alias("second_tool"),
    )


_SYSTEM = (
    "You are a knowledgeable assistant. Answer multiple-choice questions with only the letter of the correct answer."
)


@query(
    "messages_with_system",
    f"""SELECT 'mmlu_' || {ordinal('event_id')} AS sample_id, 2::BIGINT AS num_messages, 'system' AS role,
    '{_SYSTEM}' AS system_content, {_PROMPT4} AS user_content FROM {CHOICES}""",
)
def messages_with_system(spark, sf_dir):
    samples = adapters.choice4_samples(frame(spark, sf_dir, fx.choices), "event_id")
    settings = catalog.suites(spark).select("suite", "system_prompt")
    rows = samples.join(settings, "suite", "left")
    messages = prompts.with_system(F.col("messages"), F.col("system_prompt"))
    # A second pass changes nothing: the first message is a system one by then.
    rows = rows.withColumn("messages", messages).withColumn("messages", messages)
    return rows.select(
        "sample_id",
        F.size("messages").cast("bigint").alias("num_messages"),
        F.get("messages", F.lit(0)).getField("role").alias("role"),
        first_content().alias("system_content"),
        F.get("messages", F.lit(1)).getField("content").alias("user_content"),
    )


@query(
    "request_bodies",
    f"""SELECT 'mmlu_' || {ordinal('event_id')} AS sample_id, 32::BIGINT AS request_max_tokens, 32::BIGINT AS body_max_tokens,
    'org/m' AS model, 7::BIGINT AS seed, false AS has_temperature, '{_SYSTEM}' AS system, {_PROMPT4} AS content
    FROM {CHOICES}""",
)
def request_bodies(spark, sf_dir):
    samples = adapters.choice4_samples(frame(spark, sf_dir, fx.choices), "event_id")
    rows = prompts.request_bodies(
        samples, catalog.suites(spark), model="org/m", max_tokens=2048, seed=7
    )
    body = F.from_json(
        "body",
        "model string, messages array<struct<role:string,content:string>>, max_tokens bigint, "
        "temperature double, seed bigint",
    )
    rows = rows.withColumn("b", body)
    return rows.select(
        "sample_id",
        "request_max_tokens",
        F.col("b.max_tokens").alias("body_max_tokens"),
        F.col("b.model").alias("model"),
        F.col("b.seed").alias("seed"),
        F.contains("body", F.lit('"temperature"')).alias("has_temperature"),
        F.get("b.messages", F.lit(0)).getField("content").alias("system"),
        F.get("b.messages", F.lit(1)).getField("content").alias("content"),
    )


# --- multiple choice ---------------------------------------------------------


def _letter_query(n: int) -> str:
    return f"SELECT event_id, {duck.letter('response', n)} AS letter FROM {table(fx.choices, n)}"


@query("extract_mcq", _letter_query(4))
def extract_mcq(spark, sf_dir):
    letter = choice.extract_letter(F.col("response"), 4)
    return frame(spark, sf_dir, fx.choices).select("event_id", letter.alias("letter"))


def _score_choice_sql(n: int) -> str:
    return f"""SELECT event_id, coalesce(letter, '') AS predicted, expected,
    coalesce(letter = expected, false) AS correct,
    CASE WHEN letter = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM (SELECT *, {duck.letter('response', n)} AS letter FROM {table(fx.choices, n)})"""


def _scored_choices(spark, sf_dir, n):
    scored = scoring.score_choices(frame(spark, sf_dir, fx.choices, n, spread_out=True), n)
    return scored.select("event_id", "predicted", "expected", "correct", "score")


@query("score_mcq4", _score_choice_sql(4))
def score_mcq4(spark, sf_dir):
    return _scored_choices(spark, sf_dir, 4)


@query("score_mcq10", _score_choice_sql(10))
def score_mcq10(spark, sf_dir):
    return _scored_choices(spark, sf_dir, 10)


LOG = table(fx.choice_log)
_JOINED = f"""SELECT s.sample_id, s.subject, coalesce(r.letter, '') AS letter, s.expected, r.sample_id IS NOT NULL AS paired,
    r.error FROM (SELECT 'mmlu_' || {ordinal('event_id')} AS sample_id, subject, expected FROM {CHOICES}) s
    LEFT JOIN (SELECT sample_id, error, {duck.letter('response')} AS letter FROM {LOG}) r USING (sample_id)"""
_OUTCOMES = f"""SELECT sample_id, subject,
    paired AND error IS NULL AND letter = expected AS correct,
    CASE WHEN paired AND error IS NULL AND letter = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    CASE WHEN paired AND error IS NULL THEN letter ELSE '' END AS predicted,
    CASE WHEN paired THEN expected ELSE '' END AS expected,
    CASE WHEN paired THEN error ELSE 'no response' END AS error FROM ({_JOINED})"""


def _suite_results(spark, sf_dir):
    suite = get_suite("mmlu")
    samples = suite.to_samples(frame(spark, sf_dir, fx.choices), "event_id")
    return score_suite(suite, samples, frame(spark, sf_dir, fx.choice_log))


@query("score_join", _OUTCOMES)
def score_join(spark, sf_dir):
    return _suite_results(spark, sf_dir).select(
        "sample_id", "subject", "correct", "score", "predicted", "expected", "error"
    )


@query(
    "score_mixed",
    f"""SELECT doc_id, question_type, substr(predicted, 1, 200) AS predicted, correct,
    correct::int::double AS score FROM (SELECT doc_id, question_type,
      CASE WHEN question_type = 'multiple_choice' THEN coalesce({duck.letter('response')}, '')
           ELSE {duck.strip('response')} END AS predicted,
      CASE WHEN question_type = 'multiple_choice' THEN coalesce({duck.letter('response')} = upper(expected), false)
           ELSE contains({duck.norm('response')}, {duck.norm('expected')}) END AS correct FROM {ANSWERS})""",
)
def score_mixed(spark, sf_dir):
    scored = scoring.score_mixed(frame(spark, sf_dir, fx.answers, spread_out=True))
    return scored.select("doc_id", "question_type", "predicted", "correct", "score")


# --- text matching -----------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {duck.norm('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    texts = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return texts.select("doc_id", normalize(F.col("text")).alias("normalized"))


@query(
    "score_exact",
    f"""SELECT doc_id, {duck.norm('response')} = {duck.norm('expected')} AS correct FROM {ANSWERS}""",
)
def score_exact(spark, sf_dir):
    return scoring.score_exact(frame(spark, sf_dir, fx.answers, spread_out=True)).select("doc_id", "correct")


@query(
    "score_contains",
    f"""SELECT doc_id, contains({duck.norm('response')}, {duck.norm('expected')}) AS correct FROM {ANSWERS}""",
)
def score_contains(spark, sf_dir):
    return scoring.score_contains(frame(spark, sf_dir, fx.answers, spread_out=True)).select("doc_id", "correct")


@query(
    "score_retrieval",
    f"""SELECT doc_id, context_length, e AS exact_match, c AS contains_match, e OR c AS correct,
    (e OR c)::int::double AS score, predicted, expected FROM (SELECT doc_id, context_length,
      {duck.norm('response')} = {duck.norm('expected')} AS e,
      contains({duck.norm('response')}, {duck.norm('expected')}) AS c,
      substr(response, 1, 200) AS predicted, expected FROM {ANSWERS})""",
)
def score_retrieval(spark, sf_dir):
    scored = scoring.score_retrieval(frame(spark, sf_dir, fx.answers, spread_out=True))
    return scored.select(
        "doc_id", "context_length", "exact_match", "contains_match", "correct", "score", "predicted", "expected"
    )


# --- set answers -------------------------------------------------------------


@query(
    "extract_set",
    f"SELECT doc_id, unnest({duck.item_set('response')}) AS item FROM {SETS}",
)
def extract_set(spark, sf_dir):
    items = answer_sets.extract_set(F.col("response"))
    return exploded(frame(spark, sf_dir, fx.set_answers, spread_out=True), "doc_id", array=items).drop("pos")


@query(
    "score_set",
    f"""SELECT doc_id, list_sort(p) = list_sort(e) AS correct,
    round(CASE WHEN len(p) = 0 AND len(e) = 0 THEN 1.0 WHEN len(p) = 0 OR len(e) = 0 THEN 0.0
      ELSE len(list_intersect(p, e)) / len(list_distinct(list_concat(p, e))) END, {DIGITS})::DOUBLE AS score, predicted, expected
    FROM (SELECT doc_id, {duck.item_set('response')} AS p, {duck.item_set('expected')} AS e,
      substr(response, 1, 200) AS predicted, expected FROM {SETS})""",
)
def score_set(spark, sf_dir):
    scored = scoring.score_sets(frame(spark, sf_dir, fx.set_answers, spread_out=True))
    return scored.select(
        "doc_id", "correct", F.round("score", DIGITS).alias("score"), "predicted", "expected"
    )


# --- instruction rules -------------------------------------------------------


def _rules_sql(group: str) -> str:
    n = len(fx.RULE_CASES[group])
    return f"""WITH r AS (SELECT doc_id, unnest(range({n})) AS pos, unnest(instruction_id_list) AS rule_id,
      unnest(kwargs) AS a, response AS t FROM {table(fx.rule_cases, group)}),
    x AS (SELECT doc_id, pos, rule_id, t, {duck.valid_args('a')} AS k FROM r)
    SELECT doc_id, pos, rule_id AS instruction_id, {duck.rule_outcome()} AS pass FROM x"""


def _rules_query(group: str) -> None:
    @query(f"rules_{group}", _rules_sql(group))
    def run(spark, sf_dir):
        checked = instructions.check_rules(frame(spark, sf_dir, fx.rule_cases, group, spread_out=True))
        rows = instructions.outcomes_long(checked, "doc_id")
        return rows.withColumn("pos", F.col("pos").cast("bigint"))


for _group in fx.RULE_CASES:
    _rules_query(_group)

LISTS = table(fx.rule_lists)
_PAIRS = f"""SELECT doc_id, lang, unnest(range(least(len(instruction_id_list), len(kwargs)))) AS pos,
    unnest(instruction_id_list[:least(len(instruction_id_list), len(kwargs))]) AS rule_id,
    unnest(kwargs[:least(len(instruction_id_list), len(kwargs))]) AS a, response AS t FROM {LISTS}"""
_CHECKED = f"""SELECT doc_id, lang, pos, rule_id, {duck.rule_outcome()} AS pass
    FROM (SELECT doc_id, lang, pos, rule_id, t, {duck.valid_args('a')} AS k FROM ({_PAIRS}))"""


@query(
    "instructions_long",
    f"SELECT 'ifeval_' || doc_id AS sample_id, pos, rule_id AS instruction_id, {duck.valid_args('a')} AS kwargs FROM ({_PAIRS})",
)
def instructions_long(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.rule_lists, spread_out=True).withColumnRenamed("response", "prompt")
    samples = adapters.instruction_samples(raw, "doc_id")
    pairs = instructions.rule_list(F.col("instruction_id_list"), F.col("kwargs"))
    rows = exploded(samples, "sample_id", array=pairs, item="r")
    return rows.select(
        "sample_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("r.rule_id").alias("instruction_id"),
        F.to_json("r.args").alias("kwargs"),
    )


@query(
    "score_rules",
    f"""SELECT l.doc_id, coalesce(bool_and(c.pass), true) AS correct,
    coalesce(bool_and(c.pass), true)::int::double AS score, any_value(len(l.instruction_id_list)) AS num_instructions,
    count(*) FILTER (WHERE c.pass) AS num_passed
    FROM {LISTS} l LEFT JOIN ({_CHECKED}) c ON l.doc_id = c.doc_id GROUP BY l.doc_id""",
)
def score_rules(spark, sf_dir):
    scored = instructions.score_rules(frame(spark, sf_dir, fx.rule_lists, spread_out=True))
    return scored.select("doc_id", "correct", "score", "num_instructions", "num_passed")


@query(
    "rule_pass_rates",
    f"""SELECT lang, rule_id AS instruction_id, count(*) AS num_checked, count(*) FILTER (WHERE pass) AS num_passed,
    round(avg(pass::int), {DIGITS}) AS pass_rate FROM ({_CHECKED}) GROUP BY lang, rule_id""",
)
def rule_pass_rates(spark, sf_dir):
    checked = instructions.check_rules(frame(spark, sf_dir, fx.rule_lists, spread_out=True))
    rates = instructions.rule_pass_rates(checked, "lang")
    return rates.withColumn("pass_rate", F.round("pass_rate", DIGITS))


@query(
    "custom_rule",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(response) >= 500 ELSE length(response) >= 0 END AS pass
    FROM {LISTS}""",
)
def custom_rule(spark, sf_dir):
    @rules.register_rule("custom:min_chars")
    def min_chars(text, args):
        return F.length(text) >= args.number("num_chars", 0)

    rows = frame(spark, sf_dir, fx.rule_lists, spread_out=True).withColumns(
        {
            "instruction_id_list": F.array(F.lit("custom:min_chars")),
            "kwargs": F.array(
                F.when(F.col("doc_id") % 2 == 0, F.lit('{"num_chars":500}')).otherwise("{}")
            ),
        }
    )
    checked = instructions.check_rules(rows)
    return instructions.outcomes_long(checked, "doc_id").select("doc_id", "pass")


# --- conversations -----------------------------------------------------------

NESTED = table(fx.nested_turns)


@query(
    "turn_instructions_long",
    f"""WITH s AS (SELECT 'multi_if_' || {ordinal('event_id')} AS sample_id, * FROM {NESTED}),
    t AS (SELECT sample_id, unnest(range(3)) AS turn, turns, instruction_id_list AS ids, kwargs AS args FROM s)
    SELECT sample_id, turn, turns[turn + 1] AS prompt, coalesce(len(ids[turn + 1]), 0) AS num_rules,
    array_to_string(coalesce(ids[turn + 1], []), ' ') AS rules,
    array_to_string(CASE WHEN turn < len(args) THEN args[turn + 1]
      ELSE ['{{}}' for r in coalesce(ids[turn + 1], [])] END, ' ') AS arguments
    FROM t""",
)
def turn_instructions_long(spark, sf_dir):
    samples = adapters.turn_samples(frame(spark, sf_dir, fx.nested_turns), "event_id")
    rows = instructions.turns_long(samples, "sample_id")
    return rows.select(
        "sample_id",
        F.col("turn").cast("bigint").alias("turn"),
        "prompt",
        F.size("instruction_id_list").cast("bigint").alias("num_rules"),
        F.array_join("instruction_id_list", " ").alias("rules"),
        F.array_join("kwargs", " ").alias("arguments"),
    )


TURNS = table(fx.assistant_turns)
TURN_RULES = table(fx.turn_rules)
_TURN_CHECKS = f"""WITH j AS (SELECT a.sample_id, a.turn, a.response, r.instruction_id_list AS ids, r.kwargs AS args
      FROM {TURNS} a LEFT JOIN {TURN_RULES} r ON a.sample_id = r.sample_id AND a.turn = r.turn),
    p AS (SELECT sample_id, turn, response AS t, unnest(ids[:least(len(ids), len(args))]) AS rule_id,
      unnest(args[:least(len(ids), len(args))]) AS a FROM j WHERE ids IS NOT NULL),
    c AS (SELECT sample_id, turn, {duck.rule_outcome()} AS pass
      FROM (SELECT sample_id, turn, rule_id, t, {duck.valid_args('a')} AS k FROM p)),
    o AS (SELECT j.sample_id, j.turn, coalesce(bool_and(c.pass), true) AS pass
      FROM j LEFT JOIN c ON j.sample_id = c.sample_id AND j.turn = c.turn GROUP BY j.sample_id, j.turn)"""


def _scored_turns(spark, sf_dir):
    return instructions.score_turns(
        frame(spark, sf_dir, fx.assistant_turns),
        frame(spark, sf_dir, fx.turn_rules),
    )


@query(
    "score_multi_turn",
    f"""{_TURN_CHECKS} SELECT sample_id, bool_and(pass) AS correct, count(*) AS num_turns,
    count(*) FILTER (WHERE pass) AS num_turns_passed FROM o GROUP BY sample_id""",
)
def score_multi_turn(spark, sf_dir):
    return _scored_turns(spark, sf_dir)[1]


@query("score_turns", f"{_TURN_CHECKS} SELECT sample_id, turn, pass FROM o")
def score_turns(spark, sf_dir):
    return _scored_turns(spark, sf_dir)[0].select("sample_id", "turn", "pass")


@query(
    "turn_history",
    f"""SELECT sample_id, turn, role, count(*) OVER w AS num_messages,
    CAST(sum(length(content)) OVER w AS BIGINT) AS num_chars FROM {table(fx.dialogue)}
    WINDOW w AS (PARTITION BY sample_id ORDER BY turn)""",
)
def turn_history(spark, sf_dir):
    return turns.visible_history(frame(spark, sf_dir, fx.dialogue))


@query(
    "request_histories",
    f"""WITH s AS (SELECT event_id, unnest(range(3)) AS turn, turns, responses FROM {NESTED})
    SELECT event_id, turn, 2 * turn + 1 AS num_messages,
    turns[1] || CASE WHEN turn > 0 THEN '/' || coalesce(responses[1], '') || '/' || turns[2] ELSE '' END
    || CASE WHEN turn > 1 THEN '/' || coalesce(responses[2], '') || '/' || turns[3] ELSE '' END AS contents FROM s""",
)
def request_histories(spark, sf_dir):
    rows = turns.request_histories(frame(spark, sf_dir, fx.nested_turns), "event_id")
    contents = F.array_join(F.transform("messages", lambda m: m.content), "/")
    return rows.select(
        "event_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.size("messages").cast("bigint").alias("num_messages"),
        contents.alias("contents"),
    )


@query(
    "last_turn_metrics",
    f"""SELECT sample_id, max(turn) AS last_turn,
    round(arg_max(total_latency_seconds, turn), {DIGITS}) AS total_latency_seconds,
    arg_max(completion_tokens, turn) AS completion_tokens FROM {TURNS} GROUP BY sample_id""",
)
def last_turn_metrics(spark, sf_dir):
    rows = requests.last_turn_metrics(
        frame(spark, sf_dir, fx.assistant_turns), ["total_latency_seconds", "completion_tokens"]
    )
    return rows.withColumns(
        {
            "total_latency_seconds": F.round("total_latency_seconds", DIGITS),
            "completion_tokens": F.col("completion_tokens").cast("bigint"),
        }
    )


# --- function calls ----------------------------------------------------------

_FENCED = duck.strip(duck.group("response", rf"(?s){fx.FENCE}(?:json)?\s*\n?(.*?){fx.FENCE}"))
_SYNTAX = (
    r"""'{"name":"' || regexp_extract(response, '^(\w+)\(', 1) || '","arguments":{"k":' """
    r"""|| regexp_extract(response, '\(k=(\d+)\)$', 1) || '}}'"""
)


def _call_list(text: str, fallback: str = "NULL") -> str:
    json = f"CASE WHEN json_valid({text}) THEN {text} ELSE {fallback} END"
    return f"CASE WHEN json_type({json}) = 'ARRAY' THEN from_json({json}, '[\"json\"]') ELSE [({json})::json] END"


_PARSED = f"""SELECT event_id, {_call_list('response', f"coalesce({_FENCED}, {_SYNTAX})")} AS said,
    {_call_list('answer')} AS wanted FROM {CALLS}"""
_FORM = "[json_extract_string(c, '$.name') || '|' || json_extract_string(c, '$.arguments.k') for c in {}]"


@query(
    "parse_calls",
    f"""SELECT event_id, pos, json_extract_string(c, '$.name') AS name, 1::BIGINT AS num_args,
    'k' AS key, json_extract_string(c, '$.arguments.k') AS value
    FROM (SELECT event_id, unnest(range(len(said))) AS pos, unnest(said) AS c FROM ({_PARSED}))""",
)
def parse_calls(spark, sf_dir):
    rows = calls.calls_long(frame(spark, sf_dir, fx.call_log, spread_out=True), "event_id")
    entries = rows.select("event_id", "pos", "name", F.size("args").alias("num_args"), F.explode_outer("args").alias("e"))
    return entries.select(
        "event_id",
        F.col("pos").cast("bigint").alias("pos"),
        "name",
        F.col("num_args").cast("bigint").alias("num_args"),
        F.col("e.k").alias("key"),
        F.col("e.v").alias("value"),
    )


@query(
    "canonical_args",
    f"""SELECT event_id, 'k' AS key, CASE json_type(v) WHEN 'NULL' THEN 'z' WHEN 'BOOLEAN' THEN 'n'
      WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$')) THEN 'n' ELSE 's' END ELSE 'n' END AS kind,
    CASE json_type(v) WHEN 'NULL' THEN '' WHEN 'BOOLEAN' THEN '1' WHEN 'VARCHAR' THEN trim(json_extract_string(v, '$'))
      ELSE CAST(CAST(json_extract_string(v, '$') AS DOUBLE) AS BIGINT)::varchar END AS value
    FROM (SELECT event_id, json_extract(response, '$.arguments.k') AS v FROM {table(fx.flat_arguments)})""",
)
def canonical_args(spark, sf_dir):
    return _entries(spark, sf_dir, fx.flat_arguments)


def _entries(spark, sf_dir, fixture):
    rows = calls.calls_long(frame(spark, sf_dir, fixture, spread_out=True), "event_id")
    return exploded(rows, "event_id", array="args", item="e").select(
        "event_id", F.col("e.k").alias("key"), F.col("e.t").alias("kind"), F.col("e.v").alias("value")
    )


# A number with a fraction keeps it, one without is whole.
_NUMBER = """CASE WHEN value = floor(value) THEN 'n' ELSE 'f' END"""
_DIGITS = """CASE WHEN value = floor(value) THEN value::bigint::varchar ELSE value::varchar END"""


@query(
    "canonical_nested_args",
    f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'x' WHEN 2 THEN 'x' WHEN 5 THEN 'k' ELSE chr(0) END AS key,
    CASE event_id % 6 WHEN 0 THEN 'd' WHEN 1 THEN 'd' WHEN 2 THEN {_NUMBER} WHEN 3 THEN 's' ELSE 'l' END AS kind,
    CASE event_id % 6 WHEN 0 THEN '[["k", ["n", "' || (props->>'k') || '"]]]'
      WHEN 1 THEN '[["y", ["' || {_NUMBER} || '", "' || {_DIGITS} || '"]]]' WHEN 2 THEN {_DIGITS}
      WHEN 3 THEN 'plain text' WHEN 4 THEN '[["n", "1"], ["n", "2"]]' ELSE '[["n", "' || event_id || '"]]' END AS value
    FROM events UNION ALL
    SELECT event_id, 'a', 'l', '[["n", "1"], ["n", "2"], ["z", ""]]' FROM events WHERE event_id % 6 = 0""",
)
def canonical_nested_args(spark, sf_dir):
    return _entries(spark, sf_dir, fx.nested_arguments)


@query(
    "score_calls",
    f"""SELECT event_id, list_sort({_FORM.format('said')}) = list_sort({_FORM.format('wanted')}) AS correct,
    (list_sort({_FORM.format('said')}) = list_sort({_FORM.format('wanted')}))::int::double AS score,
    len(said) AS num_predicted, len(wanted) AS num_expected FROM ({_PARSED})""",
)
def score_calls(spark, sf_dir):
    rows = frame(spark, sf_dir, fx.call_log, spread_out=True).withColumn("expected", F.col("answer"))
    scored = calls.score_calls(rows)
    return scored.select("event_id", "correct", "score", "num_predicted", "num_expected")


_CALL_SIDES = f"""SELECT g, f, sum(s) AS s, sum(w) AS w FROM (
      SELECT g, f, s, w FROM (SELECT event_type, unnest({_FORM.format('said')}) AS f, 1 AS s, 0 AS w FROM ({_PARSED}) JOIN (SELECT event_id, event_type FROM events) USING (event_id)
        UNION ALL SELECT event_type, unnest({_FORM.format('wanted')}), 0, 1 FROM ({_PARSED}) JOIN (SELECT event_id, event_type FROM events) USING (event_id)) x,
      LATERAL (SELECT unnest([event_type, 'all']) AS g) y) GROUP BY g, f"""


@query(
    "score_call_lists",
    f"""SELECT g AS sample_id, bool_and(s = w) AS correct, sum(s)::BIGINT AS num_predicted, sum(w)::BIGINT AS num_expected,
    sum(least(s, w))::BIGINT AS num_matched FROM ({_CALL_SIDES}) GROUP BY g""",
)
def score_call_lists(spark, sf_dir):
    """All calls of an event type as one list, and those of all events."""
    raw = frame(spark, sf_dir, fx.call_log, spread_out=True)
    owners = F.explode(F.array("event_type", F.lit("all"))).alias("sample_id")
    of = raw.select("event_id", owners)
    said = calls.calls_long(raw, "event_id").join(of, "event_id")
    wanted = calls.calls_long(raw, "event_id", "answer", quoted=True).join(of, "event_id")
    return calls.score_call_lists(said, wanted).drop("score")


@query(
    "score_set_lists",
    f"""WITH i AS (SELECT DISTINCT l_returnflag AS sample_id, l_partkey || '-' || l_suppkey AS item,
      bool_or(l_linenumber <= 4) OVER k AS s, bool_or(l_linenumber >= 2) OVER k AS w FROM lineitem
      WINDOW k AS (PARTITION BY l_returnflag, l_partkey || '-' || l_suppkey))
    SELECT sample_id, bool_and(s = w) AS correct, round(count(*) FILTER (WHERE s AND w) / count(*), {DIGITS}) AS score,
    count(*) FILTER (WHERE s) AS num_predicted, count(*) FILTER (WHERE w) AS num_expected FROM i GROUP BY sample_id""",
)
def score_set_lists(spark, sf_dir):
    """Three samples whose sets hold a third of all rows each."""
    rows = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey").select(
        F.col("l_returnflag").alias("sample_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("item"), "l_linenumber"
    )
    found = multisets.match_sets(rows.filter("l_linenumber <= 4"), rows.filter("l_linenumber >= 2"), ["item"])
    return found.withColumn("score", F.round("score", DIGITS))


@query(
    "score_tool_calls",
    f"""SELECT event_id, event_type = 'click' OR {_FORM.format('said')} = {_FORM.format('wanted')} AS correct
    FROM ({_PARSED}) JOIN (SELECT event_id, event_type FROM events) USING (event_id)""",
)
def score_tool_calls(spark, sf_dir):
    """Structured tool calls where a message has them (clicks), text elsewhere."""
    rows = frame(spark, sf_dir, fx.call_log, spread_out=True)
    given = F.when(
        F.col("event_type") == "click",
        F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))),
    )
    rows = rows.withColumns(
        {"response": calls.predicted_text(F.col("response"), given), "expected": F.col("answer")}
    )
    return calls.score_calls(rows).select("event_id", "correct")


_EXPECTED_ACTIONS = f"""SELECT sample_id, pos AS idx, json_extract_string(a, '$.name') AS name,
    coalesce(json_extract(a, '$.arguments')::varchar, '{{}}') AS arguments
    FROM (SELECT sample_id, unnest(range(len(l))) AS pos, unnest(l) AS a FROM (SELECT sample_id,
      CASE WHEN json_valid(expected_actions) THEN from_json(expected_actions, '["json"]') ELSE [] END AS l FROM {TASKS}))"""
_ACTIONS = f"""SELECT sample_id, turn, row_number() OVER (PARTITION BY sample_id ORDER BY turn, pos) - 1 AS idx,
    json_extract_string(a, '$.name') AS name,
    CASE WHEN json_valid(json_extract_string(a, '$.arguments')) THEN json_extract_string(a, '$.arguments') ELSE '{{}}' END AS arguments
    FROM (SELECT sample_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS a FROM (SELECT sample_id, turn,
      from_json(tool_calls, '["json"]') AS l FROM {TURNS}))"""


@query("expected_actions_long", _EXPECTED_ACTIONS)
def expected_actions_long(spark, sf_dir):
    return calls.expected_actions_long(frame(spark, sf_dir, fx.agent_tasks))


def _action_turns(spark, sf_dir):
    rows = frame(spark, sf_dir, fx.assistant_turns)
    return rows.withColumn("tool_calls", F.from_json("tool_calls", calls.TOOL_CALLS))


@query("actions_long", _ACTIONS)
def actions_long(spark, sf_dir):
    return calls.actions_long(_action_turns(spark, sf_dir))


@query(
    "score_actions",
    f"""WITH e AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_ACTIONS}) GROUP BY sample_id),
    w AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_EXPECTED_ACTIONS}) GROUP BY sample_id),
    n AS (SELECT sample_id, count(*) AS num_turns FROM {TURNS} GROUP BY sample_id)
    SELECT t.sample_id, w.l IS NULL OR coalesce(e.l = w.l, false) AS correct,
    (w.l IS NULL OR coalesce(e.l = w.l, false))::int::double AS score, coalesce(n.num_turns, 0) AS num_turns,
    coalesce(len(e.l), 0) AS num_actions, coalesce(len(w.l), 0) AS num_expected
    FROM {TASKS} t LEFT JOIN e USING (sample_id) LEFT JOIN w USING (sample_id) LEFT JOIN n USING (sample_id)""",
)
def score_actions(spark, sf_dir):
    return calls.score_actions(
        frame(spark, sf_dir, fx.agent_tasks), _action_turns(spark, sf_dir)
    )


# --- code, commands, patches -------------------------------------------------


@query("clean_completion", f"SELECT doc_id, {duck.completion('response')} AS completion FROM {CODE}")
def clean_completion(spark, sf_dir):
    rows = frame(spark, sf_dir, fx.code_answers, spread_out=True)
    return rows.select("doc_id", code_text.clean_completion(F.col("response")).alias("completion"))


_PROGRAMS = f"SELECT *, {duck.completion('response')} AS completion FROM {CODE}"


@query(
    "assemble_programs",
    f"""SELECT doc_id, CASE WHEN starts_with(completion, 'def ') THEN '' ELSE prompt END || completion || chr(10)
    || test || chr(10) || 'check(' || entry_point || ')' || chr(10) AS program FROM ({_PROGRAMS})""",
)
def assemble_programs(spark, sf_dir):
    return verdicts.programs(frame(spark, sf_dir, fx.code_answers, spread_out=True)).select("doc_id", "program")


@query(
    "score_verdicts",
    f"""SELECT doc_id, coalesce(r.exit_code = 0, false) AS correct,
    coalesce(r.exit_code = 0, false)::int::double AS score, substr(completion, 1, 500) AS predicted,
    'passes ' || entry_point || ' tests' AS expected, coalesce(substr(r.output, 1, 500), '') AS output
    FROM ({_PROGRAMS}) p LEFT JOIN {table(fx.code_runs)} r USING (doc_id)""",
)
def score_verdicts(spark, sf_dir):
    rows = verdicts.programs(frame(spark, sf_dir, fx.code_answers, spread_out=True))
    return verdicts.score_programs(rows, frame(spark, sf_dir, fx.code_runs), "doc_id")


@query("extract_commands", f"SELECT doc_id, {duck.command('response')} AS command FROM {CODE}")
def extract_commands(spark, sf_dir):
    rows = frame(spark, sf_dir, fx.code_answers, spread_out=True)
    return rows.select("doc_id", code_text.extract_command(F.col("response")).alias("command"))


@query("extract_patches", f"SELECT doc_id, {duck.patch('response')} AS patch FROM {CODE}")
def extract_patches(spark, sf_dir):
    rows = verdicts.extracted_patches(frame(spark, sf_dir, fx.code_answers, spread_out=True))
    return rows.select("doc_id", "patch")


_DIALOGUE = f"""WITH m AS (SELECT sample_id, turn, {duck.command('response')} AS command,
      exit_code, response FROM {TURNS} WHERE turn < 15),
    s AS (SELECT *, coalesce(command = '', true) OR (exit_code = 0 AND contains(lower(response), 'done')) AS stops FROM m),
    k AS (SELECT * FROM (SELECT *, min(CASE WHEN stops THEN turn END) OVER (PARTITION BY sample_id) AS stop FROM s)
      WHERE stop IS NULL OR turn <= stop)"""


@query("dialogue_stop", f"{_DIALOGUE} SELECT sample_id, turn, command, stops FROM k")
def dialogue_stop(spark, sf_dir):
    kept = verdicts.dialogue_turns(frame(spark, sf_dir, fx.assistant_turns))
    return kept.select("sample_id", "turn", "command", "stops")


@query(
    "dialogue_summary",
    f"""{_DIALOGUE} SELECT sample_id, count(*) AS num_turns,
    count(*) FILTER (WHERE coalesce(command <> '', false)) AS num_commands, bool_or(stops) AS stopped
    FROM k GROUP BY sample_id""",
)
def dialogue_summary(spark, sf_dir):
    kept = verdicts.dialogue_turns(frame(spark, sf_dir, fx.assistant_turns))
    return verdicts.dialogue_summary(kept)


@query(
    "score_terminal",
    f"""SELECT sample_id, validation = '' OR exit_code = 0 AS correct,
    (validation = '' OR exit_code = 0)::int::double AS score, 'task completed' AS expected FROM {TASKS}""",
)
def score_terminal(spark, sf_dir):
    tasks = frame(spark, sf_dir, fx.agent_tasks)
    return verdicts.score_terminal(tasks.drop("exit_code"), tasks)


TESTS = table(fx.test_log)


@query(
    "score_test_verdicts",
    f"""WITH f AS (SELECT sample_id, bool_and(passed) AS f2p, count(*) AS n FROM {TESTS} WHERE kind = 'f2p' GROUP BY sample_id),
    p AS (SELECT sample_id, bool_and(passed) AS p2p, count(*) AS n FROM (SELECT *, row_number() OVER (
      PARTITION BY sample_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {TESTS} WHERE kind = 'p2p')
      WHERE rn <= 10 GROUP BY sample_id)
    SELECT o.o_orderkey AS sample_id, has_patch AND coalesce(f2p, false) AND coalesce(p2p, true) AS correct,
    (has_patch AND coalesce(f2p, false) AND coalesce(p2p, true))::int::double AS score,
    coalesce(f2p, false) AS f2p_pass, coalesce(p2p, true) AS p2p_pass,
    coalesce(f.n, 0) AS num_f2p, coalesce(p.n, 0) AS num_p2p
    FROM {PATCH_TASKS} o LEFT JOIN f ON o.o_orderkey = f.sample_id LEFT JOIN p ON o.o_orderkey = p.sample_id""",
)
def score_test_verdicts(spark, sf_dir):
    tasks = frame(spark, sf_dir, fx.patch_tasks).withColumnRenamed("o_orderkey", "sample_id")
    log = frame(spark, sf_dir, fx.test_log)
    order = ("l_linenumber", "l_partkey", "l_suppkey")
    return verdicts.score_test_verdicts(tasks, log, order, regression_tests=verdicts.REGRESSION_TESTS)


# --- run statistics ----------------------------------------------------------


@query(
    "run_quality",
    f"""SELECT count(*) AS num_samples, count(*) FILTER (WHERE correct) AS num_correct,
    round(avg(correct::int), {DIGITS}) AS accuracy, round(avg(score), {DIGITS}) AS score FROM ({_OUTCOMES})""",
)
def run_quality(spark, sf_dir):
    totals = quality.run_quality(_suite_results(spark, sf_dir))
    return totals.withColumns({c: F.round(c, DIGITS) for c in ("accuracy", "score")})


@query(
    "quality_by_subject",
    f"""SELECT subject, count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    round(avg(correct::int) - 1.96 * coalesce(stddev_samp(correct::int), 0) / sqrt(count(*)), {DIGITS}) AS ci_lo,
    round(avg(correct::int) + 1.96 * coalesce(stddev_samp(correct::int), 0) / sqrt(count(*)), {DIGITS}) AS ci_hi
    FROM ({_OUTCOMES}) GROUP BY subject""",
)
def quality_by_subject(spark, sf_dir):
    totals = quality.with_interval(_suite_results(spark, sf_dir), ["subject"])
    return totals.withColumns({c: F.round(c, DIGITS) for c in ("accuracy", "ci_lo", "ci_hi")})


@query(
    "quality_rollup",
    f"""SELECT subject, count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    round(avg(score), {DIGITS}) AS score, grouping(subject) = 1 AS overall FROM ({_OUTCOMES}) GROUP BY ROLLUP (subject)""",
)
def quality_rollup(spark, sf_dir):
    summary = run_summary(get_suite("mmlu"), _suite_results(spark, sf_dir))
    return summary.withColumns({c: F.round(c, DIGITS) for c in ("accuracy", "score")})


@query(
    "accuracy_ci",
    f"""SELECT count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    round(avg(correct::int) - 1.96 * stddev_samp(correct::int) / sqrt(count(*)), {DIGITS}) AS ci_lo,
    round(avg(correct::int) + 1.96 * stddev_samp(correct::int) / sqrt(count(*)), {DIGITS}) AS ci_hi FROM ({_OUTCOMES})""",
)
def accuracy_ci(spark, sf_dir):
    totals = quality.with_interval(_suite_results(spark, sf_dir))
    return totals.withColumns({c: F.round(c, DIGITS) for c in ("accuracy", "ci_lo", "ci_hi")})


_TIER_SUITES = """CASE subject WHEN 'click' THEN 'mmlu' WHEN 'view' THEN 'mrcr' WHEN 'purchase' THEN 'bfcl'
    WHEN 'signup' THEN 'hle' ELSE 'swe_bench' END"""


@query(
    "results_by_tier",
    f"""SELECT CASE suite WHEN 'mrcr' THEN 2 WHEN 'bfcl' THEN 3 WHEN 'swe_bench' THEN 4 ELSE 1 END AS tier,
    count(DISTINCT suite) AS num_suites, count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    round(avg(correct::int), {DIGITS}) AS score FROM (SELECT {_TIER_SUITES} AS suite,
      coalesce({duck.letter('response')} = expected, false) AS correct FROM {CHOICES}) GROUP BY 1""",
)
def results_by_tier(spark, sf_dir):
    scored = scoring.score_choices(frame(spark, sf_dir, fx.choices))
    scored = scored.withColumn("suite", F.expr(_TIER_SUITES))
    tiers = quality.results_by_tier(scored, catalog.suites(spark))
    return tiers.withColumns(
        {"num_samples": F.col("num_samples").cast("bigint"), "accuracy": F.round("accuracy", DIGITS), "score": F.round("score", DIGITS)}
    )


_PASS = """CASE WHEN n - c < {k} THEN 1.0 ELSE 1.0 - coalesce(list_product([1.0 - {k} / i for i in range(n - c + 1, n + 1)]), 1.0) END"""
_PASS_TASKS = """SELECT run, task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM {t} GROUP BY run, task_id"""


def _pass_columns(form: str) -> str:
    return ", ".join(form.format(expr=_PASS.format(k=k), k=k, DIGITS=DIGITS) for k in (1, 2, 5))


@query(
    "pass_at_k",
    f"""SELECT run, count(*) AS num_tasks, {_pass_columns('round(avg({expr}), {DIGITS}) AS pass_at_{k}')}
    FROM ({_PASS_TASKS.format(t=table(fx.attempts))}) GROUP BY run""",
)
def pass_at_k(spark, sf_dir):
    _, per_run = quality.pass_at_k(frame(spark, sf_dir, fx.attempts), (1, 2, 5), by=["run"])
    return per_run.withColumns({f"pass_at_{k}": F.round(f"pass_at_{k}", DIGITS) for k in (1, 2, 5)})


@query(
    "pass_at_k_tasks",
    f"""SELECT run, task_id, n, c, {_pass_columns('round({expr}, {DIGITS}) AS pass_at_{k}')}
    FROM ({_PASS_TASKS.format(t=table(fx.attempts))})""",
)
def pass_at_k_tasks(spark, sf_dir):
    per_task, _ = quality.pass_at_k(frame(spark, sf_dir, fx.attempts), (1, 2, 5), by=["run"])
    return per_task.withColumns({f"pass_at_{k}": F.round(f"pass_at_{k}", DIGITS) for k in (1, 2, 5)})


# --- request statistics ------------------------------------------------------

REQUESTS = table(fx.requests)
_RATES = f"""SELECT *, CASE WHEN ok THEN ttft_seconds END AS prefill_time_seconds,
    CASE WHEN ok AND completion_tokens > 1 THEN (completion_tokens - 1) / decode_time_seconds END AS tokens_per_second_generation,
    CASE WHEN ok AND ttft_seconds > 0 AND prompt_tokens > 0 THEN prompt_tokens / ttft_seconds END AS tokens_per_second_prompt
    FROM (SELECT *, CASE WHEN ok AND ttft_seconds > 0 AND total_latency_seconds > ttft_seconds
            THEN total_latency_seconds - ttft_seconds END AS decode_time_seconds
      FROM (SELECT *, streamed AND error IS NULL AS ok FROM {REQUESTS}))"""
_RATE_COLUMNS = (
    "prefill_time_seconds",
    "decode_time_seconds",
    "tokens_per_second_generation",
    "tokens_per_second_prompt",
)


def _rated(spark, sf_dir):
    return requests.derived_rates(frame(spark, sf_dir, fx.requests))


@query(
    "derived_rates",
    f"SELECT request_id, {', '.join(f'round({c}, 6) AS {c}' for c in _RATE_COLUMNS)} FROM ({_RATES})",
)
def derived_rates(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    return rows.select("request_id", *[F.round(c, 6).alias(c) for c in _RATE_COLUMNS])


_MEANS = {
    "ttft_mean": "ttft_seconds",
    "generation_tps_mean": "tokens_per_second_generation",
    "prompt_tps_mean": "tokens_per_second_prompt",
    "latency_mean": "total_latency_seconds",
}
_SUMMARY = f"""count(*) AS total_requests, count(*) FILTER (WHERE error IS NOT NULL) AS failed_requests,
    CAST(coalesce(sum(prompt_tokens) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_prompt_tokens,
    CAST(coalesce(sum(completion_tokens) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_completion_tokens,
    {', '.join(f'round(avg({c}) FILTER (WHERE error IS NULL), {DIGITS}) AS {m}' for m, c in _MEANS.items())}"""


@query("request_summary", f"SELECT suite, model, {_SUMMARY} FROM ({_RATES}) GROUP BY suite, model")
def request_summary(spark, sf_dir):
    rows = requests.request_summary(_rated(spark, sf_dir), ["suite", "model"])
    return rows.withColumns({m: F.round(m, DIGITS) for m in _MEANS})


def _percentile_sql() -> str:
    return ", ".join(
        f"round(quantile_cont({column}, {share / 100}) FILTER (WHERE error IS NULL), {DIGITS}) AS {prefix}_p{share}"
        for prefix, (column, shares) in requests.PERCENTILES.items()
        for share in shares
    )


_PERCENTILE_COLUMNS = [
    f"{prefix}_p{share}" for prefix, (_, shares) in requests.PERCENTILES.items() for share in shares
]


@query("latency_percentiles", f"SELECT suite, {_percentile_sql()} FROM ({_RATES}) GROUP BY suite")
def latency_percentiles(spark, sf_dir):
    rows = _rated(spark, sf_dir).filter(F.col("error").isNull())
    exact = percentiles.exact_percentiles(rows, ["suite"], requests.PERCENTILES)
    return exact.withColumns({c: F.round(c, DIGITS) for c in _PERCENTILE_COLUMNS})


@query("latency_percentiles_overall", f"SELECT {_percentile_sql()} FROM ({_RATES})")
def latency_percentiles_overall(spark, sf_dir):
    """The same over one single group, with a coarse sketch."""
    rows = _rated(spark, sf_dir).filter(F.col("error").isNull())
    exact = percentiles.exact_percentiles(
        rows, [], requests.PERCENTILES, accuracy=400
    )
    return exact.withColumns({c: F.round(c, DIGITS) for c in _PERCENTILE_COLUMNS})


@query(
    "throughput",
    f"""SELECT suite, successful_requests, round(wall, 6) AS wall_time_seconds,
    round(CASE WHEN wall > 0 THEN successful_requests / wall END, {DIGITS}) AS effective_throughput_rps FROM (
      SELECT suite, count(*) FILTER (WHERE error IS NULL) AS successful_requests,
      max(epoch_us(start_ts) / 1e6 + total_latency_seconds) - min(epoch_us(start_ts) / 1e6) AS wall
      FROM {REQUESTS} GROUP BY suite)""",
)
def throughput(spark, sf_dir):
    rows = requests.throughput(frame(spark, sf_dir, fx.requests), ["suite"])
    return rows.withColumns(
        {
            "wall_time_seconds": F.round("wall_time_seconds", 6),
            "effective_throughput_rps": F.round("effective_throughput_rps", DIGITS),
        }
    )


# --- result files and comparison ---------------------------------------------

_RUN = f"""SELECT c.event_id AS id, r.suite, r.model, {duck.letter('c.response')} IS NOT DISTINCT FROM c.expected AS correct,
    coalesce({duck.letter('c.response')}, '') AS predicted, c.expected, r.ttft_seconds, r.total_latency_seconds,
    r.prompt_tokens, r.completion_tokens, r.error
    FROM {CHOICES} c JOIN {REQUESTS} r ON c.event_id = r.request_id"""


def _run_results(spark, sf_dir):
    scored = scoring.score_choices(frame(spark, sf_dir, fx.choices)).select(
        F.col("event_id").alias("id"), "correct", "score", "predicted", "expected"
    )
    logged = _rated(spark, sf_dir).withColumnRenamed("request_id", "id")
    return scored.join(logged, "id")


@query(
    "result_rows",
    f"""SELECT suite, replace(model, '/', '_') AS model_key, id, correct, predicted, expected,
    CASE WHEN error IS NULL THEN prompt_tokens END AS prompt_tokens FROM ({_RUN})""",
)
def result_rows(spark, sf_dir):
    path = shared_path(spark, "results")
    rows = _run_results(spark, sf_dir).select(
        "suite",
        "model",
        "id",
        "correct",
        "score",
        "predicted",
        "expected",
        F.when(F.col("error").isNull(), F.col("prompt_tokens")).alias("prompt_tokens"),
    )
    results.write_results(rows, path)
    stored = spark.read.parquet(path)
    return stored.select(
        "suite", "model_key", "id", "correct", "predicted", "expected", "prompt_tokens"
    )


def _run_summaries(spark, sf_dir):
    return run_report(_run_results(spark, sf_dir))


_RUN_SUMMARIES = f"""SELECT suite, model, count(*) AS num_samples, avg(correct::int) AS accuracy,
    avg(correct::int) - 1.96 * coalesce(stddev_samp(correct::int), 0) / sqrt(count(*)) AS ci_lo,
    avg(correct::int) + 1.96 * coalesce(stddev_samp(correct::int), 0) / sqrt(count(*)) AS ci_hi,
    avg(ttft_seconds) FILTER (WHERE error IS NULL) AS ttft_mean,
    quantile_cont(ttft_seconds, 0.5) FILTER (WHERE error IS NULL) AS ttft_p50,
    quantile_cont(ttft_seconds, 0.95) FILTER (WHERE error IS NULL) AS ttft_p95,
    avg(tokens_per_second_generation) FILTER (WHERE error IS NULL) AS generation_tps_mean,
    avg(total_latency_seconds) FILTER (WHERE error IS NULL) AS latency_mean,
    quantile_cont(total_latency_seconds, 0.95) FILTER (WHERE error IS NULL) AS latency_p95,
    count(*) FILTER (WHERE error IS NULL) / (max(epoch_us(start_ts) / 1e6 + total_latency_seconds)
      - min(epoch_us(start_ts) / 1e6)) AS effective_throughput_rps,
    count(*) FILTER (WHERE error IS NOT NULL) AS failed_requests
    FROM (SELECT r.*, {duck.letter('c.response')} IS NOT DISTINCT FROM c.expected AS correct
      FROM ({_RATES}) r JOIN {CHOICES} c ON c.event_id = r.request_id) GROUP BY suite, model"""


@query(
    "read_results",
    f"""SELECT suite, model, num_samples, round(accuracy, {DIGITS}) AS accuracy, round(accuracy, {DIGITS}) AS score,
    round(ttft_p95, {DIGITS}) AS ttft_p95, round(latency_mean, {DIGITS}) AS latency_mean, failed_requests FROM ({_RUN_SUMMARIES})""",
)
def read_results(spark, sf_dir):
    path = shared_path(spark, "documents")
    summaries = _run_summaries(spark, sf_dir)
    stamp = results.run_stamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    documents = results.run_documents(summaries, stamp=stamp, config={"max_tokens": F.lit(32)})
    results.write_run_documents(documents, path)
    runs, _, _ = results.read_results(spark, path, multi_line=False)
    flat = results.runs_from_documents(runs)
    return flat.select(
        "suite",
        "model",
        "num_samples",
        *[F.round(c, DIGITS).alias(c) for c in ("accuracy", "score", "ttft_p95", "latency_mean")],
        "failed_requests",
    )


@query(
    "read_documents",
    f"""SELECT r.suite, count(*) AS num_samples, count(*) FILTER (WHERE correct) AS num_correct,
    sum(CASE WHEN error IS NULL THEN prompt_tokens END)::BIGINT AS prompt_tokens, 1::BIGINT AS num_bad FROM ({_RUN}) r GROUP BY r.suite""",
)
def read_documents(spark, sf_dir):
    """Complete documents of all runs, written in lines and read in byte ranges, a broken one among them."""
    path = shared_path(spark, "documents")
    _write_documents(spark, sf_dir, path)
    spark.createDataFrame([('{"benchmark": "cut",',)], "value string").write.text(f"{path}/broken")
    _, samples, bad = results.read_results(spark, path, parts=True)
    totals = samples.groupBy("suite").agg(
        F.count("*").alias("num_samples"),
        F.count_if("correct").alias("num_correct"),
        F.sum("metrics.prompt_tokens").alias("prompt_tokens"),
    )
    return totals.select("*", bad.agg(F.count("*")).scalar().alias("num_bad"))


def _write_documents(spark, sf_dir, path):
    rows = _run_results(spark, sf_dir)
    exported = results.export_sample(
        rows.withColumn("prompt_tokens", F.when(F.col("error").isNull(), F.col("prompt_tokens")))
    )
    stamp = results.run_stamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    summaries = results.run_documents(run_report(rows), stamp=stamp).withColumn("suite", F.col("benchmark"))
    lines = documents.document_lines(summaries, exported, ["suite", "model"])
    documents.write_documents(lines, path, ["suite", "model"])


@query(
    "read_logs",
    f"""SELECT 'mmlu' AS suite, count(*) AS num_rows, count(*) FILTER (WHERE value > 100) AS num_failed FROM {CHOICES}""",
)
def read_logs(spark, sf_dir):
    """A response log that is written and read by its schema; columns it lacks are NULL."""
    path = shared_path(spark, "log")
    frame(spark, sf_dir, fx.choices).select(
        F.lit("mmlu").alias("suite"),
        F.concat(F.lit("mmlu_"), "event_id").alias("sample_id"),
        "response",
        F.when(F.col("value") > 100, "timeout").alias("error"),
    ).write.parquet(path)
    log = logs.read_log(spark, "responses", path).filter(F.col("run_id").isNull() & F.col("tool_calls").isNull())
    return log.groupBy("suite").agg(
        F.count("*").alias("num_rows"), F.count_if(F.col("error") == "timeout").alias("num_failed")
    )


RUN_LABELS = [
    f"{suite} org/m{i}" for suite in ("click", "error", "purchase", "signup", "view") for i in range(3)
]
_COMPARE_LINES = [
    ("Accuracy", "printf('%.4f', accuracy)"),
    ("Samples", "num_samples::varchar"),
    ("Score", "printf('%.4f', accuracy)"),
    ("95% CI", "'[' || printf('%.4f', ci_lo) || ', ' || printf('%.4f', ci_hi) || ']'"),
    *[(title, f"coalesce(printf('%.4f', {column}), 'N/A')") for title, column in compare.PERFORMANCE_ROWS],
]


def _compare_sql() -> str:
    runs = f"(SELECT suite || ' ' || model AS label, * FROM ({_RUN_SUMMARIES}))"
    lines = " UNION ALL ".join(
        f"SELECT {pos} AS pos, '{title}' AS metric, label, {value} AS value FROM runs"
        for pos, (title, value) in enumerate(_COMPARE_LINES, start=1)
    )
    columns = ", ".join(
        f"""coalesce(max(value) FILTER (WHERE label = '{n}'), 'N/A') AS "{n}\"""" for n in RUN_LABELS
    )
    return f"WITH runs AS {runs} SELECT pos, metric, {columns} FROM ({lines}) GROUP BY pos, metric"


@query("compare_runs", _compare_sql())
def compare_runs(spark, sf_dir):
    label = compare.run_label(F.col("suite"), F.col("model"))
    summaries = _run_summaries(spark, sf_dir).withColumn("label", label)
    return compare.compare_runs(summaries, RUN_LABELS)


@query("compare_files", _compare_sql())
def compare_files(spark, sf_dir):
    """The comparison from result files; intervals come from the samples they hold."""
    path = shared_path(spark, "documents")
    _write_documents(spark, sf_dir, path)
    spark.createDataFrame([('{"benchmark": "cut",',)], "value string").write.text(f"{path}/broken")
    runs, samples, _ = results.read_results(spark, path, parts=True)
    summaries = results.summaries_from_documents(runs, samples)
    label = compare.run_label(F.col("suite"), F.col("model"))
    return compare.compare_runs(summaries.withColumn("label", label), RUN_LABELS)


@query(
    "custom_suite",
    f"""SELECT 'arith_' || event_id AS sample_id, response = expected AS correct,
    (response = expected)::int::double AS score FROM {CHOICES}""",
)
def custom_suite(spark, sf_dir):
    def to_samples(rows, key, max_samples=None):
        kept = numbered(rows, key, max_samples)
        return kept.select(
            F.lit("arith").alias("suite"),
            F.concat(F.lit("arith_"), "ordinal").alias("sample_id"),
            prompts.user_message(F.col("question")).alias("messages"),
            "expected",
        )

    def score(answers):
        return answers.withColumns(
            {
                "correct": F.col("response") == F.col("expected"),
                "score": (F.col("response") == F.col("expected")).cast("double"),
                "predicted": F.col("response"),
            }
        )

    suite = Suite("arith", 1, to_samples, score)
    rows = frame(spark, sf_dir, fx.choices)
    responses = rows.select(
        F.lit("arith").alias("suite"),
        F.concat(F.lit("arith_"), "event_id").alias("sample_id"),
        "response",
    )
    scored = score_suite(suite, suite.to_samples(rows, "event_id"), responses)
    return scored.select("sample_id", "correct", "score")


# --- suites end to end -------------------------------------------------------


def _suite(spark, sf_dir, name, raw, key):
    """Samples by the suite's adapter, responses by id from the same fixture."""
    suite = get_suite(name)
    samples = suite.to_samples(raw.drop("response"), key)
    responses = raw.select(
        F.lit(name).alias("suite"), F.concat(F.lit(f"{name}_"), key).alias("sample_id"), "response"
    )
    return score_suite(suite, samples, responses)


@query(
    "suite_graphwalks",
    f"""SELECT 'graphwalks_' || doc_id AS sample_id, list_sort(p) = list_sort(e) AS correct,
    round(CASE WHEN len(p) = 0 AND len(e) = 0 THEN 1.0 WHEN len(p) = 0 OR len(e) = 0 THEN 0.0
      ELSE len(list_intersect(p, e)) / len(list_distinct(list_concat(p, e))) END, {DIGITS})::DOUBLE AS score
    FROM (SELECT doc_id, {duck.item_set('response')} AS p, {duck.item_set('expected')} AS e FROM {SETS})""",
)
def suite_graphwalks(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.set_answers, spread_out=True).withColumn("prompt", F.lit("List."))
    scored = _suite(spark, sf_dir, "graphwalks", raw, "doc_id")
    return scored.select("sample_id", "correct", F.round("score", DIGITS).alias("score"))


@query(
    "suite_mrcr",
    f"""SELECT context_length >= 2000 AS long_context, count(*) AS num_samples,
    round(avg(contains({duck.norm('response')}, {duck.norm('expected')})::int), {DIGITS}) AS accuracy
    FROM {ANSWERS} GROUP BY 1""",
)
def suite_mrcr(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.answers, spread_out=True)
    raw = raw.withColumns({"prompt": F.lit("Find it."), "messages": F.array().cast(prompts.MESSAGES)})
    scored = _suite(spark, sf_dir, "mrcr", raw, "doc_id")
    bucket = scored.withColumn("long_context", F.col("context_length") >= 2000)
    totals = quality.run_quality(bucket, ["long_context"])
    return totals.select("long_context", "num_samples", F.round("accuracy", DIGITS).alias("accuracy"))


@query(
    "suite_ifeval",
    f"""SELECT 'ifeval_' || l.doc_id AS sample_id, coalesce(bool_and(c.pass), true) AS correct,
    any_value(substr(l.response, 1, 200)) AS predicted FROM {LISTS} l LEFT JOIN ({_CHECKED}) c ON l.doc_id = c.doc_id
    GROUP BY l.doc_id""",
)
def suite_ifeval(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.rule_lists, spread_out=True).withColumn("prompt", F.col("lang"))
    scored = _suite(spark, sf_dir, "ifeval", raw, "doc_id")
    return scored.select("sample_id", "correct", "predicted")


@query(
    "suite_bfcl",
    f"""SELECT 'bfcl_' || event_id AS sample_id,
    list_sort({_FORM.format('said')}) = list_sort({_FORM.format('wanted')}) AS correct FROM ({_PARSED})""",
)
def suite_bfcl(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.call_log, spread_out=True)
    return _suite(spark, sf_dir, "bfcl", raw, "event_id").select("sample_id", "correct")


@query(
    "suite_humaneval",
    f"""SELECT task_id AS sample_id, coalesce(r.exit_code = 0, false) AS correct,
    substr(completion, 1, 500) AS predicted, 'passes ' || entry_point || ' tests' AS expected
    FROM ({_PROGRAMS}) p LEFT JOIN {table(fx.code_runs)} r USING (doc_id)""",
)
def suite_humaneval(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.code_answers, spread_out=True)
    runs = frame(spark, sf_dir, fx.code_runs).withColumn(
        "sample_id", F.concat(F.lit("task/"), "doc_id")
    )
    responses = raw.select(F.col("task_id").alias("sample_id"), "response")
    scored = logged.score_code(adapters.code_samples(raw, "doc_id"), responses, runs)
    return scored.select("sample_id", "correct", "predicted", "expected")


def _prefixed(rows: DataFrame, suite: str) -> DataFrame:
    return rows.withColumn("sample_id", F.concat(F.lit(f"{suite}_"), F.col("sample_id")))


@query(
    "suite_tau_bench",
    f"""WITH e AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_ACTIONS}) GROUP BY sample_id),
    w AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_EXPECTED_ACTIONS}) GROUP BY sample_id)
    SELECT 'tau_bench_' || t.sample_id AS sample_id,
    t.sample_id IN (SELECT sample_id FROM {TURNS}) AND (w.l IS NULL OR coalesce(e.l = w.l, false)) AS correct,
    coalesce(len(e.l), 0) AS num_actions,
    CASE WHEN t.sample_id IN (SELECT sample_id FROM {TURNS}) THEN substr(expected_actions, 1, 300) ELSE '' END AS expected
    FROM {TASKS} t LEFT JOIN e USING (sample_id) LEFT JOIN w USING (sample_id)""",
)
def suite_tau_bench(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.agent_tasks).drop("sample_id")
    turns_log = _prefixed(_action_turns(spark, sf_dir), "tau_bench")
    scored = logged.score_agents(adapters.action_samples(raw, "conv_id"), turns_log)
    return scored.select("sample_id", "correct", "num_actions", "expected")


@query(
    "suite_terminal_bench",
    f"""{_DIALOGUE} SELECT 'terminal_bench_' || t.sample_id AS sample_id,
    n.num_turns IS NOT NULL AND (t.validation = '' OR t.exit_code = 0) AS correct, coalesce(n.num_turns, 0) AS num_turns
    FROM {TASKS} t LEFT JOIN (SELECT sample_id, count(*) AS num_turns FROM k GROUP BY sample_id) n USING (sample_id)""",
)
def suite_terminal_bench(spark, sf_dir):
    checks = _prefixed(frame(spark, sf_dir, fx.agent_tasks), "terminal_bench")
    turns_log = _prefixed(frame(spark, sf_dir, fx.assistant_turns), "terminal_bench")
    scored = logged.score_shell(_terminal(spark, sf_dir), turns_log, checks)
    return scored.select("sample_id", "correct", "num_turns")


@query(
    "suite_swe_bench",
    f"""WITH f AS (SELECT sample_id, bool_and(passed) AS f2p FROM {TESTS} WHERE kind = 'f2p' GROUP BY sample_id),
    p AS (SELECT sample_id, bool_and(passed) AS p2p FROM (SELECT *, row_number() OVER (
      PARTITION BY sample_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {TESTS} WHERE kind = 'p2p')
      WHERE rn <= 10 GROUP BY sample_id)
    SELECT instance_id AS sample_id, has_patch AND coalesce(f2p, false) AND coalesce(p2p, true) AS correct,
    CASE WHEN has_patch THEN substr('+' || problem_statement, 1, 500)
      ELSE substr('No patch for ' || problem_statement, 1, 300) END AS predicted,
    CASE WHEN has_patch THEN 'passing tests' ELSE '' END AS expected,
    CASE WHEN NOT has_patch THEN 'No patch extracted from response' END AS error
    FROM {PATCH_TASKS} o LEFT JOIN f ON o.o_orderkey = f.sample_id LEFT JOIN p ON o.o_orderkey = p.sample_id""",
)
def suite_swe_bench(spark, sf_dir):
    log = frame(spark, sf_dir, fx.test_log).withColumn(
        "sample_id", F.concat(F.lit("issue-"), "sample_id")
    )
    scored = logged.score_patches(
        _patches(spark, sf_dir),
        frame(spark, sf_dir, fx.patch_answers),
        log,
        order=("l_linenumber", "l_partkey", "l_suppkey"),
        regression_tests=verdicts.REGRESSION_TESTS,
    )
    return scored.select("sample_id", "correct", "predicted", "expected", "error")


# --- typed question sets: the same samples from arrays and structs -------------


def _typed_calls(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.call_log, spread_out=True)
    one = "struct<arguments:struct<k:bigint>,name:string>"
    return raw.withColumns(
        {
            "answer": F.array(F.from_json("answer", one)),
            "function": F.array(F.struct(F.col("event_type").alias("name"), F.lit("int").alias("kind"))),
        }
    )


@query(
    "typed_calls",
    f"""SELECT 'bfcl_' || event_id AS sample_id, '[{{"arguments":{{"k":' || k || '}},"name":"' || event_type || '"}}]' AS expected_raw,
    '{{"type":"function","function":{{"kind":"int","name":"' || event_type || '"}}}}' AS tool FROM {CALLS}""",
)
def typed_calls(spark, sf_dir):
    samples = adapters.call_samples(_typed_calls(spark, sf_dir), "event_id")
    return samples.select("sample_id", "expected_raw", F.get("tools", F.lit(0)).alias("tool"))


@query(
    "typed_rules",
    f"""SELECT 'ifeval_' || doc_id AS sample_id,
    NOT contains(response, ',') AND len(regexp_extract_all(response, '[^{duck.SPACE}]+')) >= doc_id % 300 AS correct FROM {LISTS}""",
)
def typed_rules(spark, sf_dir):
    """Rule arguments as structs; a field that is NULL is not given."""
    raw = frame(spark, sf_dir, fx.rule_lists, spread_out=True).withColumns(
        {
            "prompt": F.col("lang"),
            "instruction_id_list": F.array(F.lit("punctuation:no_comma"), F.lit("length_constraints:number_words")),
            "kwargs": F.array(
                F.struct(F.lit(None).cast("bigint").alias("num_words")), F.struct((F.col("doc_id") % 300).alias("num_words"))
            ),
        }
    )
    return _suite(spark, sf_dir, "ifeval", raw, "doc_id").select("sample_id", "correct")


@query(
    "typed_turn_rules",
    f"SELECT 'multi_if_' || event_id AS sample_id, '{{\"num_words\":' || event_id || '}}' AS first, '{{}}' AS second FROM events",
)
def typed_turn_rules(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.nested_turns)
    one = lambda n: F.array(F.struct(n.alias("num_words")))
    raw = raw.withColumn("kwargs", F.array(one(F.col("event_id")), one(F.lit(None).cast("bigint"))))
    samples = adapters.turn_samples(raw, "event_id")
    place = lambda i: F.get(F.get("kwargs", F.lit(i)), F.lit(0))
    return samples.select("sample_id", place(0).alias("first"), place(1).alias("second"))


@query(
    "typed_actions",
    f"""SELECT 'tau_bench_' || conv_id AS sample_id, '[{{"name":"lookup","arguments":{{"id":"' || conv_id || '"}}}}]' AS expected_actions,
    '{{"name":"t","type":"function"}}' AS tool FROM {TASKS}""",
)
def typed_actions(spark, sf_dir):
    """Actions as an array of structs with a map, tools as a VARIANT."""
    arguments = F.create_map(F.lit("id"), F.col("conv_id").cast("string"))
    raw = frame(spark, sf_dir, fx.agent_tasks).drop("sample_id").withColumns(
        {
            "expected_actions": F.array(F.struct(F.lit("lookup").alias("name"), arguments.alias("arguments"))),
            "tools": F.parse_json(F.lit('[{"name":"t","type":"function"}]')),
        }
    )
    samples = adapters.action_samples(raw, "conv_id")
    return samples.select("sample_id", "expected_actions", F.get("tools", F.lit(0)).alias("tool"))


@query(
    "typed_test_lists",
    f"""SELECT instance_id AS sample_id, 2::BIGINT AS num_f2p, 't' || o_orderkey AS first, 0::BIGINT AS num_p2p FROM {PATCH_TASKS}""",
)
def typed_test_lists(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.patch_tasks).withColumns(
        {
            "FAIL_TO_PASS": F.array(F.concat(F.lit("t"), "o_orderkey"), F.lit("u")),
            "PASS_TO_PASS": F.array().cast("array<string>"),
        }
    )
    samples = adapters.patch_samples(raw, "o_orderkey")
    return samples.select(
        "sample_id",
        F.size("fail_to_pass").cast("bigint").alias("num_f2p"),
        F.get("fail_to_pass", F.lit(0)).alias("first"),
        F.size("pass_to_pass").cast("bigint").alias("num_p2p"),
    )


@query(
    "suite_swe_bench_pro",
    f"""WITH f AS (SELECT sample_id, bool_and(passed) AS f2p FROM {TESTS} WHERE kind = 'f2p' GROUP BY sample_id),
    p AS (SELECT sample_id, bool_and(passed) AS p2p FROM {TESTS} WHERE kind = 'p2p' GROUP BY sample_id),
    t AS (SELECT *, {ordinal('o_orderkey')} AS n FROM {PATCH_TASKS})
    SELECT 'swe_pro_' || n AS sample_id, n % 10 <> 0 AND has_patch AND coalesce(f2p, false) AND coalesce(p2p, true) AS correct,
    CASE WHEN n % 10 = 0 THEN '' WHEN has_patch THEN substr('+' || problem_statement, 1, 500)
      ELSE substr('No patch for ' || problem_statement, 1, 300) END AS predicted,
    CASE WHEN n % 10 = 0 THEN 'no response' WHEN NOT has_patch THEN 'No patch extracted from response' END AS error
    FROM t LEFT JOIN f ON t.o_orderkey = f.sample_id LEFT JOIN p ON t.o_orderkey = p.sample_id""",
)
def suite_swe_bench_pro(spark, sf_dir):
    """Tasks without an id of their own get the default one; answers and tests come under it, a tenth not at all."""
    suite = logged.get_logged_suite("swe_bench_pro")
    raw = frame(spark, sf_dir, fx.patch_tasks)
    ids = numbered(raw.select("o_orderkey", "instance_id"), "o_orderkey", None, "n")
    ids = ids.withColumn("default_id", F.concat(F.lit("swe_pro_"), "n"))
    answers = frame(spark, sf_dir, fx.patch_answers).withColumnRenamed("sample_id", "instance_id").join(ids, "instance_id")
    answers = answers.filter(F.col("n") % 10 != 0).select(F.col("default_id").alias("sample_id"), "response")
    tests = frame(spark, sf_dir, fx.test_log).withColumnRenamed("sample_id", "o_orderkey").join(ids, "o_orderkey")
    tests = tests.withColumnRenamed("default_id", "sample_id").drop("instance_id", "n")
    samples = suite.to_samples(raw.drop("instance_id"), "o_orderkey")
    scored = logged.score_logged(
        suite, samples, {"responses": answers, "tests": tests}, order=("l_linenumber", "l_partkey", "l_suppkey")
    )
    return scored.select("sample_id", "correct", "predicted", "error")


@query(
    "custom_logged_suite",
    f"""SELECT run_id, 'mine_' || event_id AS sample_id, event_id % 4 <> 0 AND event_id % 3 = 0 AND response = expected AS correct,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE response END AS predicted,
    CASE WHEN event_id % 4 = 0 THEN 'no response' END AS error,
    CASE WHEN event_id % 4 <> 0 THEN value / 1000.0 END AS ttft_seconds
    FROM {CHOICES}, (SELECT unnest(['r1', 'r2']) AS run_id)""",
)
def custom_logged_suite(spark, sf_dir):
    """A suite of one's own, judged by two logs: the answer has to match and its check to pass."""

    def judge(cases, answers, checks):
        passed = checks.groupBy(logged.CASE).agg(F.bool_and("passed").alias("passed"))
        rows = cases.join(answers.select(logged.CASE, "response"), logged.CASE, "left").join(passed, logged.CASE, "left")
        good = F.coalesce(F.col("passed") & (F.col("response") == F.col("expected")), F.lit(False))
        return rows.select(
            logged.CASE, good.alias("correct"), good.cast("double").alias("score"), F.col("response").alias("predicted"), "expected"
        )

    def score(samples, answers, checks, runs=None):
        return logged.judged("mine", samples, [answers, checks], judge, answers, runs)

    suite = logged.register_logged_suite(
        logged.LoggedSuite("mine", 1, lambda rows: rows.select("sample_id", "expected"), score, ("answers", "checks"))
    )
    raw = frame(spark, sf_dir, fx.choices).withColumn("sample_id", F.concat(F.lit("mine_"), "event_id"))
    twice = raw.withColumn("run_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    answers = twice.filter("event_id % 4 <> 0").select(
        "run_id", "sample_id", "response", (F.col("value") / 1000.0).alias("ttft_seconds")
    )
    checks = twice.select("run_id", "sample_id", (F.col("event_id") % 3 == 0).alias("passed"))
    scored = logged.score_logged(logged.get_logged_suite("mine"), suite.to_samples(raw), {"answers": answers, "checks": checks})
    return scored.select("run_id", "sample_id", "correct", "predicted", "error", "ttft_seconds")


_LAST_TURNS = f"""(SELECT sample_id, max(turn) AS turn FROM {TURNS} WHERE turn % 5 <> 0 GROUP BY sample_id)"""


@query(
    "logged_report",
    f"""WITH s AS (SELECT sample_id FROM {table(fx.agent_tasks)}),
    r AS (SELECT s.sample_id, l.turn, s.sample_id IN (SELECT sample_id FROM {TURNS}) AS seen FROM s LEFT JOIN {_LAST_TURNS} l USING (sample_id)),
    c AS (SELECT replace(sample_id, 'tau_bench_', '')::BIGINT AS sample_id, correct FROM ({ORACLES["suite_tau_bench"]}))
    SELECT 'tau_bench' AS suite, count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    count(*) FILTER (WHERE NOT seen) AS failed_requests, round(avg(turn / 8.0) FILTER (WHERE seen), {DIGITS}) AS ttft_mean,
    round(quantile_cont(turn / 4.0, 0.95) FILTER (WHERE seen), {DIGITS}) AS latency_p95,
    coalesce(sum(50 + turn) FILTER (WHERE seen), 0)::BIGINT AS total_prompt_tokens
    FROM r JOIN c USING (sample_id)""",
)
def logged_report(spark, sf_dir):
    """The report of a suite of conversations: metrics are those of the last turn that has any."""
    has = F.col("turn") % 5 != 0
    turns_log = _prefixed(_action_turns(spark, sf_dir), "tau_bench").withColumns(
        {
            "start_ts": F.when(has, F.lit("2024-01-01").cast("timestamp")),
            "ttft_seconds": F.when(has, F.col("turn") / 8.0),
            "total_latency_seconds": F.when(has, F.col("turn") / 4.0),
            "prompt_tokens": F.when(has, 50 + F.col("turn")),
            "completion_tokens": F.when(has, F.col("turn")),
            "tokens_per_second_generation": F.lit(None).cast("double"),
            "tokens_per_second_prompt": F.lit(None).cast("double"),
        }
    )
    samples = adapters.action_samples(frame(spark, sf_dir, fx.agent_tasks).drop("sample_id"), "conv_id")
    scored = logged.score_logged(logged.get_logged_suite("tau_bench"), samples, {"turns": turns_log})
    report = run_report(scored.withColumn("suite", F.lit("tau_bench")), ["suite"])
    return report.select(
        "suite", "num_samples", *[F.round(c, DIGITS).alias(c) for c in ("accuracy",)], "failed_requests",
        *[F.round(c, DIGITS).alias(c) for c in ("ttft_mean", "latency_p95")], "total_prompt_tokens",
    )


# --- several runs, failures, missing logs --------------------------------------


@query(
    "score_runs",
    f"""SELECT run_id, count(*) AS num_samples, round(avg(correct::int), {DIGITS}) AS accuracy,
    count(*) FILTER (WHERE error = 'no response') AS num_missing, count(*) FILTER (WHERE error = 'timeout') AS num_failed FROM (
      SELECT 'r1' AS run_id, {duck.letter('response')} IS NOT DISTINCT FROM expected AS correct, NULL AS error FROM {CHOICES}
      UNION ALL SELECT 'r2', event_id % 3 <> 0 AND event_id % 5 <> 0 AND {duck.letter('response')} IS NOT DISTINCT FROM expected,
        CASE WHEN event_id % 3 = 0 THEN 'no response' WHEN event_id % 5 = 0 THEN 'timeout' END FROM {CHOICES}
      UNION ALL SELECT 'r3', false, 'no response' FROM {CHOICES}) GROUP BY run_id""",
)
def score_runs(spark, sf_dir):
    """A whole run, one with gaps and errors, one that answered nothing."""
    raw = frame(spark, sf_dir, fx.choices)
    suite = get_suite("mmlu")
    said = raw.select(
        F.lit("mmlu").alias("suite"), F.concat(F.lit("mmlu_"), "event_id").alias("sample_id"), "response", "event_id"
    )
    whole = said.withColumns({"run_id": F.lit("r1"), "error": F.lit(None).cast("string")})
    gaps = said.filter(F.col("event_id") % 3 != 0).withColumns(
        {"run_id": F.lit("r2"), "error": F.when(F.col("event_id") % 5 == 0, "timeout")}
    )
    runs = spark.createDataFrame([("r3", "mmlu")], "run_id string, suite string")
    responses = whole.unionByName(gaps).drop("event_id")
    scored = score_suite(suite, suite.to_samples(raw.drop("response"), "event_id"), responses, runs)
    totals = scored.groupBy("run_id").agg(
        F.count("*").alias("num_samples"),
        F.round(F.avg(F.col("correct").cast("int")), DIGITS).alias("accuracy"),
        F.count_if(F.col("error") == "no response").alias("num_missing"),
        F.count_if(F.col("error") == "timeout").alias("num_failed"),
    )
    return totals


@query(
    "bfcl_failures",
    f"""SELECT 'bfcl_' || event_id AS sample_id, event_id % 4 <> 0 AND event_id % 7 <> 0
      AND list_sort({_FORM.format('said')}) = list_sort({_FORM.format('wanted')}) AS correct,
    CASE WHEN event_id % 7 = 0 THEN 'no response' WHEN event_id % 4 = 0 THEN 'timeout' END AS error FROM ({_PARSED})""",
)
def bfcl_failures(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.call_log, spread_out=True)
    suite = get_suite("bfcl")
    failed = F.col("event_id") % 4 == 0
    responses = raw.filter(F.col("event_id") % 7 != 0).select(
        F.lit("bfcl").alias("suite"),
        F.concat(F.lit("bfcl_"), "event_id").alias("sample_id"),
        F.when(failed, "").otherwise(F.col("response")).alias("response"),
        F.when(failed, "timeout").alias("error"),
    )
    scored = score_suite(suite, suite.to_samples(raw.drop("response"), "event_id"), responses)
    return scored.select("sample_id", "correct", "error")


@query(
    "humaneval_missing",
    f"""SELECT task_id AS sample_id, doc_id % 3 <> 1 AND coalesce(r.exit_code = 0, false) AS correct,
    CASE WHEN doc_id % 3 <> 1 THEN substr(completion, 1, 500) ELSE '' END AS predicted,
    CASE WHEN doc_id % 3 <> 1 THEN 'passes ' || entry_point || ' tests' ELSE '' END AS expected,
    CASE WHEN doc_id % 3 = 1 THEN 'no response' END AS error
    FROM ({_PROGRAMS}) p LEFT JOIN {table(fx.code_runs)} r USING (doc_id)""",
)
def humaneval_missing(spark, sf_dir):
    raw = frame(spark, sf_dir, fx.code_answers, spread_out=True)
    program_runs = frame(spark, sf_dir, fx.code_runs).withColumn("sample_id", F.concat(F.lit("task/"), "doc_id"))
    responses = raw.filter(F.col("doc_id") % 3 != 1).select(F.col("task_id").alias("sample_id"), "response")
    scored = logged.score_code(adapters.code_samples(raw, "doc_id"), responses, program_runs)
    return scored.select("sample_id", "correct", "predicted", "expected", "error")


@query(
    "multi_if_missing",
    f"""SELECT 'multi_if_' || event_id AS sample_id, CASE WHEN event_id % 5 < 2 THEN false END AS incomplete_correct,
    CASE WHEN event_id % 5 = 0 THEN 'no response' END AS error, 3::BIGINT AS num_turns FROM events""",
)
def multi_if_missing(spark, sf_dir):
    """Samples of three turns: some without any log, some with only two turns of it."""
    raw = frame(spark, sf_dir, fx.nested_turns)
    samples = adapters.turn_samples(raw, "event_id")
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 5 == 1, 1).otherwise(2))).alias("turn")
    turns_log = raw.filter(F.col("event_id") % 5 != 0).select(
        F.concat(F.lit("multi_if_"), "event_id").alias("sample_id"), F.get("responses", F.lit(0)).alias("response"), turn
    )
    scored = logged.score_conversations(samples, turns_log)
    number = F.regexp_extract("sample_id", "([0-9]+)$", 1).cast("bigint")
    return scored.select(
        "sample_id", F.when(number % 5 < 2, F.col("correct")).alias("incomplete_correct"), "error", "num_turns"
    )


@query(
    "tau_missing",
    f"""WITH e AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_ACTIONS}) GROUP BY sample_id),
    w AS (SELECT sample_id, list(name ORDER BY idx) AS l FROM ({_EXPECTED_ACTIONS}) GROUP BY sample_id),
    r AS (SELECT DISTINCT sample_id, run_id FROM {TURNS}, (VALUES ('r1'), ('r2')) v(run_id)
      WHERE run_id = 'r1' OR sample_id % 2 = 0)
    SELECT v.run_id, 'tau_bench_' || t.sample_id AS sample_id,
    r.run_id IS NOT NULL AND (w.l IS NULL OR coalesce(e.l = w.l, false)) AS correct,
    CASE WHEN r.run_id IS NULL THEN 'no response' END AS error
    FROM {TASKS} t CROSS JOIN (VALUES ('r1'), ('r2')) v(run_id)
    LEFT JOIN r ON r.sample_id = t.sample_id AND r.run_id = v.run_id
    LEFT JOIN e ON e.sample_id = t.sample_id LEFT JOIN w ON w.sample_id = t.sample_id""",
)
def tau_missing(spark, sf_dir):
    """Two runs; the second has a log of every other conversation only."""
    raw = frame(spark, sf_dir, fx.agent_tasks).drop("sample_id")
    turns_log = _action_turns(spark, sf_dir)
    both = turns_log.withColumn("run_id", F.lit("r1")).unionByName(
        turns_log.filter(F.col("sample_id") % 2 == 0).withColumn("run_id", F.lit("r2"))
    )
    scored = logged.score_agents(adapters.action_samples(raw, "conv_id"), _prefixed(both, "tau_bench"))
    return scored.select("run_id", "sample_id", "correct", "error")


@query(
    "rule_items",
    f"""SELECT doc_id, unnest([0, 1, 2]::BIGINT[]) AS pos, unnest(['punctuation:no_comma', 'detectable_format:title',
      'keywords:existence']) AS instruction_id, unnest([NOT contains(response, ','),
      regexp_matches(response, '<<[^>]+>>'), contains(lower(response), lang)]) AS pass FROM {LISTS}""",
)
def rule_items(spark, sf_dir):
    """Rules as a JSON list of objects in both shapes, with arguments per row."""
    rows = frame(spark, sf_dir, fx.rule_lists, spread_out=True)
    spec = F.concat(
        F.lit(
            '[{"instruction_id":"punctuation:no_comma"},'
            '{"instruction_id_list":["detectable_format:title","keywords:existence"],'
            '"kwargs":[null,"{\\"keywords\\":[\\"'
        ),
        F.col("lang"),
        F.lit('\\"]}"]}]'),
    )
    listed = instructions.rule_items(spec)
    checked = instructions.check_listed(rows, listed)
    outcomes = instructions.outcomes_long(checked, "doc_id")
    return outcomes.withColumn("pos", F.col("pos").cast("bigint"))


# --- streams -----------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream of its file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _chunks(events: DataFrame) -> DataFrame:
    """Five chunk rows per event: dispatch, an empty, two filled, usage."""
    parts = [
        (0, "dispatch", F.lit(None)),
        (1, "chunk", F.lit("")),
        (2, "chunk", F.col("event_type")),
        (3, "chunk", F.col("props")),
        (4, "usage", F.lit(None)),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(seq).alias("seq"),
                F.lit(kind).alias("kind"),
                content.cast("string").alias("content"),
            )
            for seq, kind, content in parts
        ]
    )
    exploded = events.select(
        F.col("event_id").alias("request_id"), "ts", "event_id", F.explode(rows).alias("c")
    ).select("request_id", "ts", "event_id", "c.*")
    is_usage = F.col("kind") == "usage"
    return exploded.select(
        "request_id",
        (F.col("ts") + F.make_dt_interval(secs=F.col("seq"))).alias("ts"),
        "seq",
        "kind",
        "content",
        F.when(is_usage, 50 + F.col("event_id") % 100).alias("prompt_tokens"),
        F.when(is_usage, F.col("event_id") % 300).alias("completion_tokens"),
    )


@query(
    "stream_ttft",
    """SELECT event_id AS request_id, 2.0::DOUBLE AS ttft_seconds, 4.0::DOUBLE AS total_latency_seconds,
    50 + event_id % 100 AS prompt_tokens, event_id % 300 AS completion_tokens, event_type || props AS text
    FROM events""",
)
def stream_ttft(spark, sf_dir):
    ended = live_requests.ended_requests(_chunks(_event_stream(spark, sf_dir)))
    return live.drain(ended, spark, "ttft").select(
        "request_id", "ttft_seconds", "total_latency_seconds", "prompt_tokens", "completion_tokens", "text"
    )


@query(
    "stream_progress",
    f"""SELECT epoch_us(w)::BIGINT AS window_start_us, event_type, count(*) AS num_finished,
    count(*) FILTER (WHERE value > 100) AS num_failed, round(avg(value / 1000.0), 12) AS latency_mean,
    quantile_disc(value / 1000.0, 0.5) AS latency_p50, quantile_disc(value / 1000.0, 0.95) AS latency_p95,
    quantile_disc(value / 1000.0, 0.99) AS latency_p99
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) GROUP BY w, event_type""",
)
def stream_progress(spark, sf_dir):
    finished = _event_stream(spark, sf_dir).select(
        "ts",
        "event_type",
        (F.col("value") / 1000.0).alias("total_latency_seconds"),
        F.when(F.col("value") > 100, "timeout").alias("error"),
    )
    done = live.drain_updates(
        live.progress(finished, "event_type"), spark, "progress", ["window_start", "event_type"]
    )
    return done.select(
        F.unix_micros("window_start").alias("window_start_us"),
        "event_type",
        "num_finished",
        "num_failed",
        # Means of two to the n short decimals end exactly at up to eleven digits.
        F.round("latency_mean", 12).alias("latency_mean"),
        # No window has more requests than ranks: the sketch is exact.
        *[name for name, _ in live.PROGRESS_SHARES],
    )


@query(
    "stream_score",
    f"""SELECT event_id, subject, coalesce({duck.letter('response')}, '') AS predicted,
    coalesce({duck.letter('response')} = expected, false) AS correct FROM {CHOICES}""",
)
def stream_score(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    answer = F.substring(F.lit("ABCD"), ((F.col("event_id") * 7 + F.col("user_id")) % 4 + 1).cast("int"), F.lit(1))
    kind = F.col("event_id") % 9
    said = (
        F.when(kind == 0, F.concat(F.lit("The answer is "), answer))
        .when(kind == 1, F.concat(F.lit("Answer: ("), answer, F.lit(")")))
        .when(kind == 2, answer)
        .when(kind == 3, F.concat(F.lit("I think ("), answer, F.lit(") fits")))
        .when(kind == 4, F.concat(F.lit("So it must be "), answer, F.lit(".")))
        .when(kind == 5, F.concat(F.lit("Not B, more likely "), answer))
        .when(kind == 6, F.lit("no idea"))
        .when(kind == 7, F.lit("The answer is because of that"))
        .otherwise("")
    )
    responses = stream.select("event_id", said.alias("response"))
    samples = frame(spark, sf_dir, fx.choices).select("event_id", "subject", "expected")
    scored = live.score_live(responses, samples, scoring.score_choices, ("event_id",))
    done = live.drain(scored.select("event_id", "subject", "predicted", "correct"), spark, "scores")
    return done


@query(
    "stream_outcomes",
    f"""SELECT event_id, subject, coalesce(CASE WHEN fails IS NULL THEN said END, '') AS predicted,
    CASE WHEN fails = 'no response' THEN '' ELSE expected END AS expected,
    fails IS NULL AND said IS NOT DISTINCT FROM expected AS correct,
    (fails IS NULL AND said IS NOT DISTINCT FROM expected)::int::double AS score, fails AS error
    FROM (SELECT *, {duck.letter('response')} AS said,
      CASE WHEN event_id % 7 = 0 THEN 'no response' WHEN event_id % 11 = 0 THEN 'reset' END AS fails FROM {CHOICES})""",
)
def stream_outcomes(spark, sf_dir):
    """Chunks of answered, failed and unanswered requests, scored when each ends; a clock row closes the log."""
    raw, path = frame(spark, sf_dir, fx.choices), shared_path(spark, "chunk-log")
    number = F.col("event_id")
    silent, failed = number % 7 == 0, number % 11 == 0
    part = lambda seq, kind, content, there: F.when(
        there, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), content.cast("string").alias("content"))
    )
    parts = F.array(
        part(0, "dispatch", F.lit(None), F.lit(True)),
        part(1, "chunk", F.col("response"), ~silent | (number % 2 == 0)),
        part(2, "error", F.lit("reset"), ~silent & failed),
        part(3, "usage", F.lit(None), ~silent & ~failed),
    )
    chunks = raw.select(number.alias("request_id"), "ts", F.explode(parts).alias("c")).filter("c IS NOT NULL")
    chunks = chunks.select("request_id", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("c.seq"))).alias("ts"), "c.*")
    clock = chunks.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    log = chunks.unionByName(clock, allowMissingColumns=True)
    log = log.withColumns({c: F.when(F.col("kind") == "usage", F.lit(1)).cast("bigint") for c in ("prompt_tokens", "completion_tokens")})
    log.write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    ended = live_requests.ended_requests(stream).withColumnRenamed("request_id", "event_id")
    samples = raw.select("event_id", "subject", "expected")
    scored = live_requests.score_requests(ended, samples, scoring.score_choices, ("event_id",))
    done = live.drain(scored.select("event_id", "subject", "predicted", "expected", "correct", "score", "error"), spark, "outcomes")
    return done
