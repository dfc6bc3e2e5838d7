"""Inputs of the queries, derived from the whole given tables by SQL.

One text serves both engines: ``@table`` stands for a given table, and a
``Dialect`` writes the few things they spell differently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.layout import spread

FENCE = "```"


@dataclass(frozen=True)
class Dialect:
    spark: bool
    sf_dir: str = ""

    def array(self, items: list[str]) -> str:
        """Array of SQL expressions; an empty one holds strings."""
        body = ", ".join(items)
        if not items:
            return "CAST(array() AS array<string>)" if self.spark else "CAST([] AS varchar[])"
        return f"array({body})" if self.spark else f"[{body}]"

    def texts(self, items: list[str]) -> str:
        return self.array([literal(i) for i in items])

    def tables(self, sql: str) -> str:
        form = f"parquet.`{self.sf_dir}/%s.parquet`" if self.spark else "%s"
        return re.sub(r"@(\w+)", lambda m: form % m.group(1), sql)


DUCKDB = Dialect(spark=False)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Unique keys of the tables whose rows feed expensive work.
SPREAD_KEYS = {"events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def frame(spark: SparkSession, sf_dir: str, fixture, *args, spread_out: bool = False) -> DataFrame:
    """The fixture as a DataFrame.

    ``spread_out`` is for expensive work within rows: a given table of fewer
    splits than cores is spread first.
    """
    dialect = Dialect(spark=True, sf_dir=sf_dir)
    text = fixture(dialect, *args)
    if not spread_out:
        return spark.sql(dialect.tables(text))
    names = re.findall(r"@(\w+)", text)
    sources = {
        name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *SPREAD_KEYS[name])
        for name in set(names)
    }
    # Braces of JSON texts are not placeholders.
    escaped = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", escaped), **sources)


def duck(fixture, *args) -> str:
    """The fixture as a parenthesised DuckDB query."""
    return "(" + DUCKDB.tables(fixture(DUCKDB, *args)) + ")"


# --- multiple choice (events) ----------------------------------------------


def choices(d: Dialect, n: int = 4) -> str:
    letters = "ABCDEFGHIJ"[:n]
    options = d.array([f"concat(event_type, '-', event_id + {i})" for i in range(n)])
    return f"""
    SELECT event_id, user_id, ts, event_type AS subject,
           concat('Which label fits event ', event_id, ' of user ', user_id, '?') AS question,
           {options} AS choices,
           CAST(event_id % {n} AS INT) AS answer,
           substr('{letters}', CAST(event_id % {n} AS INT) + 1, 1) AS expected,
           CASE CAST(event_id % 9 AS INT)
             WHEN 0 THEN concat('The answer is ', L)
             WHEN 1 THEN concat('Answer: (', L, ')')
             WHEN 2 THEN L
             WHEN 3 THEN concat('I think (', L, ') fits')
             WHEN 4 THEN concat('So it must be ', L, '.')
             WHEN 5 THEN concat('Not B, more likely ', L)
             WHEN 6 THEN 'no idea'
             WHEN 7 THEN 'The answer is because of that'
             ELSE '' END AS response,
           value
    FROM (SELECT *, substr('{letters}', CAST((event_id * 7 + user_id) % {n} AS INT) + 1, 1) AS L
          FROM @events) e"""


def choice_log(d: Dialect) -> str:
    """Responses by sample id: fast events (value below 0.5) left no response."""
    return f"""
    SELECT 'mmlu' AS suite, concat('mmlu_', event_id) AS sample_id,
           CASE WHEN subject = 'error' THEN '' ELSE response END AS response,
           CASE WHEN subject = 'error' THEN 'timeout' END AS error
    FROM ({choices(d)}) c WHERE value >= 0.5"""


# --- short answers and long contexts (documents) ---------------------------


def answers(d: Dialect) -> str:
    return """
    SELECT doc_id, lang, n_chars AS context_length, text,
           CASE WHEN doc_id % 11 = 0 THEN 'img' END AS image,
           CASE WHEN doc_id % 2 = 0 THEN 'multiple_choice' ELSE 'exact' END AS question_type,
           CASE WHEN doc_id % 2 = 0 THEN L WHEN doc_id % 16 = 5 THEN concat(text, ' tail')
                ELSE text END AS expected,
           CASE CAST(doc_id % 8 AS INT)
             WHEN 0 THEN concat('The answer is ', L) WHEN 2 THEN concat('(', L, ') I guess')
             WHEN 4 THEN 'no idea' WHEN 6 THEN 'B'
             WHEN 1 THEN lower(text) WHEN 3 THEN concat('I found: ', text, '!!')
             WHEN 5 THEN replace(text, ' ', '  ') ELSE '' END AS response
    FROM (SELECT *, substr('ABCD', CAST((doc_id * 7 + 3) % 4 AS INT) + 1, 1) AS L
          FROM @documents) d"""


def set_answers(d: Dialect) -> str:
    """The commas and lines of whole documents make the items of sets."""
    return """
    SELECT doc_id, text AS expected,
           CASE CAST(doc_id % 6 AS INT)
             WHEN 0 THEN text
             WHEN 1 THEN concat('The nodes are {', text, '} as asked')
             WHEN 2 THEN concat('[', replace(text, ',', ' , '), ']')
             WHEN 3 THEN concat(text, ', one more, and another')
             WHEN 4 THEN replace(text, 'de', '"de"')
             ELSE '{}' END AS response
    FROM @documents"""


# --- instruction rules (documents) -----------------------------------------

# (rule, argument texts to rotate through). Compact JSON with sorted keys.
RULE_CASES: dict[str, list[tuple[str, list[str]]]] = {
    "keywords": [
        ("keywords:existence", ['{"keywords":["de","La"]}', '{"keywords":[]}', "{}", '{"keywords":null}', '{"keywords":["de",5]}']),
        ("keywords:frequency", [
            '{"frequency":2,"keyword":"der","relation":"at least"}', '{"frequency":3,"keyword":"La","relation":"at most"}',
            '{"frequency":1,"keyword":"que","relation":"exactly"}', '{"frequency":null,"keyword":"de"}',
            '{"frequency":"2","keyword":"de"}', '{"frequency":900,"keyword":""}', '{"frequency":1,"keyword":"e","relation":"below"}']),
        ("keywords:forbidden_words", ['{"forbidden_words":["und","the"]}', '{"forbidden_words":["zzz"]}', "{}", '{"forbidden_words":null}', '{"forbidden_words":["zzz",1]}']),
        ("keywords:letter_frequency", [
            '{"let_frequency":40,"let_relation":"at least","letter":"E"}', '{"let_frequency":30,"let_relation":"at most","letter":"n"}',
            '{"let_frequency":3,"let_relation":"exactly","letter":"x"}', "{}", '{"let_frequency":1,"letter":null}']),
    ],
    "language": [
        ("language:response_language", ['{"language":"en"}', '{"language":"English"}', '{"language":"fr"}', "{}", '{"language":null}', '{"language":7}']),
    ],
    "length": [
        ("length_constraints:number_words", ['{"num_words":100}', '{"num_words":80,"relation":"at most"}', '{"num_words":3,"relation":"exactly"}', "{}", '{"num_words":null}', '{"num_words":120.5}']),
        ("length_constraints:number_sentences", ['{"num_sentences":12}', '{"num_sentences":9,"relation":"at most"}', '{"num_sentences":9,"relation":"exactly"}', "{}", '{"num_sentences":"4"}']),
        ("length_constraints:number_paragraphs", ['{"num_paragraphs":2}', '{"num_paragraphs":1,"relation":"at most"}', "{}", '{"num_paragraphs":null}']),
        ("length_constraints:nth_paragraph_first_word", [
            '{"first_word":"Die","nth_paragraph":1,"num_paragraphs":1}', '{"first_word":"la","nth_paragraph":1}', '{"first_word":"le","nth_paragraph":2,"num_paragraphs":2}',
            "{}", '{"first_word":"x","nth_paragraph":0}', '{"first_word":null}', '{"first_word":"-","num_paragraphs":1}']),
        ("detectable_format:number_words_in_section", ['{"num_words":100}', '{"num_words":80,"relation":"at most"}', '{"num_words":3,"relation":"exactly"}', "{}"]),
    ],
    "content": [
        ("detectable_content:number_placeholders", ['{"num_placeholders":1}', '{"num_placeholders":0}', "{}", '{"num_placeholders":null}']),
        ("detectable_content:postscript", ['{"postscript_marker":"P.P.S"}', "{}", '{"postscript_marker":"de"}', '{"postscript_marker":null}']),
    ],
    "format": [
        ("detectable_format:number_bullet_lists", ['{"num_bullets":1}', '{"num_bullets":2}', "{}", '{"num_bullets":null}']),
        ("detectable_format:constrained_response", ["{}", "[]"]),
        ("detectable_format:number_highlighted_sections", ['{"num_highlights":1}', '{"num_highlights":0}', "{}", '{"num_highlights":"1"}']),
        ("detectable_format:multiple_sections", ['{"num_sections":1,"section_spliter":"De"}', '{"num_sections":30,"section_spliter":"la"}', '{"num_sections":1}', "{}", '{"num_sections":1,"section_spliter":null}', '{"section_spliter":"l.a"}']),
        ("detectable_format:json_format", ["{}", "null"]),
        ("detectable_format:title", ["{}", "not json"]),
    ],
    "combination": [
        ("combination:two_responses", ["{}"]),
        ("combination:repeat_prompt", ['{"prompt_to_repeat":"- "}', '{"prompt_to_repeat":" <<t>> "}', "{}", '{"prompt_to_repeat":null}', '{"prompt_to_repeat":5}']),
    ],
    "startend": [
        ("startend:end_checker", ['{"end_phrase":" t "}', '{"end_phrase":"."}', "{}", '{"end_phrase":null}']),
        ("startend:quotation", ["{}"]),
    ],
    "case": [
        ("change_case:english_capital", ["{}"]),
        ("change_case:english_lowercase", ["{}"]),
    ],
    "punctuation": [
        ("punctuation:no_comma", ["{}"]),
        ("no_such:rule", ["{}"]),
    ],
}


def formatted_text(column: str = "text", key: str = "doc_id") -> str:
    """Whole text in one of nine dressings, to exercise the format rules."""
    nl = "chr(10)"
    return f"""CASE CAST({key} % 9 AS INT)
        WHEN 0 THEN concat('- ', {column})
        WHEN 1 THEN concat('<<t>> ', {column}, {nl}, ' * *one* t')
        WHEN 2 THEN concat('{{"a": "', replace(replace({column}, {nl}, ' '), '"', ''), '"}}')
        WHEN 3 THEN concat({column}, ' ****** ', {column})
        WHEN 4 THEN concat('"', {column}, '"')
        WHEN 5 THEN concat('{FENCE}json', {nl}, '{{"a": [1, 2]}}', {nl}, '{FENCE}', {nl}, {column})
        WHEN 6 THEN concat('[x] P.S. ', upper(replace({column}, 'ß', 'ss')))
        WHEN 7 THEN concat('# ', lower({column}), {nl}, {nl}, '## la fin [y] [z]')
        ELSE {column} END"""


def rule_cases(d: Dialect, group: str) -> str:
    """Every document with every rule of a group, its arguments rotating."""
    cases = RULE_CASES[group]
    arguments = []
    for _, variants in cases:
        whens = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(variants))
        arguments.append(f"CASE CAST(doc_id % {len(variants)} AS INT) {whens} END")
    return f"""
    SELECT doc_id, {d.texts([r for r, _ in cases])} AS instruction_id_list,
           {d.array(arguments)} AS kwargs, {formatted_text()} AS response
    FROM @documents"""


# Rule lists of the roll-up queries: (rules, arguments); lengths may differ.
RULE_LISTS: list[tuple[list[str], list[str]]] = [
    (["punctuation:no_comma"], ["{}"]),
    (["length_constraints:number_words", "detectable_format:title"], ['{"num_words":20}', "{}"]),
    (["keywords:existence", "length_constraints:number_sentences", "startend:end_checker"],
     ['{"keywords":["de"]}', '{"num_sentences":2}', '{"end_phrase":"."}']),
    ([], []),
    (["detectable_format:constrained_response", "change_case:english_capital", "punctuation:no_comma"],
     ["{}", "bad json"]),
    (["keywords:forbidden_words", "language:response_language"],
     ['{"forbidden_words":["zzz"]}', '{"language":"en"}']),
]
RULE_LIST_IDS = sorted({r for ids, _ in RULE_LISTS for r in ids})


def _pick_list(d: Dialect, part: int, number: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {d.texts(lists[part])}" for i, lists in enumerate(RULE_LISTS))
    return f"CASE CAST({number} % {len(RULE_LISTS)} AS INT) {whens} END"


def rule_lists(d: Dialect) -> str:
    return f"""
    SELECT doc_id, lang, {_pick_list(d, 0, 'doc_id')} AS instruction_id_list,
           {_pick_list(d, 1, 'doc_id')} AS kwargs, {formatted_text()} AS response
    FROM @documents"""


# --- conversations ----------------------------------------------------------


def assistant_turns(d: Dialect) -> str:
    """Answers of a dialogue with exit codes, tool calls and timings."""
    call = "{{\"arguments\":\"{args}\",\"name\":\"{name}\"}}"
    one = "[" + call.format(args='{\\"id\\":1}', name="lookup") + "]"
    two = "[" + call.format(args='{\\"id\\":2}', name="lookup") + "," + call.format(args="oops", name="update") + "]"
    # A backslash is an escape in one of the two engines' literals.
    one, two = (f"replace({literal(t.replace(chr(92), '~'))}, '~', chr(92))" for t in (one, two))
    return f"""
    SELECT conv_id AS sample_id, turn, role, text AS content,
           CASE CAST((conv_id + turn) % 4 AS INT)
             WHEN 0 THEN concat('{FENCE}bash', chr(10), text, chr(10), '{FENCE}')
             WHEN 1 THEN concat('Run this:', chr(10), '  $ ls ', turn, chr(10), text, ' Done')
             WHEN 2 THEN concat('{FENCE}sh', chr(10), 'make all', chr(10), '{FENCE}', text)
             ELSE text END AS response,
           CAST(turn % 2 AS INT) AS exit_code,
           CASE CAST(turn % 3 AS INT) WHEN 0 THEN {one} WHEN 1 THEN {two} ELSE '[]' END AS tool_calls,
           CAST(length(text) AS DOUBLE) / 100.0 AS total_latency_seconds,
           length(text) AS completion_tokens
    FROM @conversations WHERE role = 'assistant'"""


def dialogue(d: Dialect) -> str:
    return "SELECT conv_id AS sample_id, turn, role, text AS content FROM @conversations"


def turn_rules(d: Dialect) -> str:
    """A user turn sets the rules of the answer that follows it."""
    number = "(conv_id + turn)"
    return f"""
    SELECT conv_id AS sample_id, turn + 1 AS turn, {_pick_list(d, 0, number)} AS instruction_id_list,
           {_pick_list(d, 1, number)} AS kwargs
    FROM @conversations WHERE role = 'user'"""


def agent_tasks(d: Dialect) -> str:
    return """
    SELECT conv_id AS sample_id, conv_id, text AS instruction,
           CASE CAST(conv_id % 4 AS INT)
             WHEN 0 THEN '[]' WHEN 1 THEN 'broken'
             WHEN 2 THEN '[{"arguments":{"id":1},"name":"lookup"},{"arguments":{},"name":"update"}]'
             ELSE '[{"name":"lookup"},{"name":"update"},{"arguments":{"id":9},"name":"lookup"}]'
             END AS expected_actions,
           '[{"name":"lookup"},{"function":{"name":"update"},"type":"function"},5]' AS tools,
           CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'test -f out' END AS validation,
           CAST(conv_id % 2 AS INT) AS exit_code
    FROM @conversations WHERE turn = 0"""


def nested_turns(d: Dialect) -> str:
    """Multi-turn samples that hold their turns, answers and nested rule lists."""
    q = [f"concat(question, ' {i}')" for i in (1, 2, 3)]
    ids = d.array([_pick_list(d, 0, "event_id"), _pick_list(d, 0, "(event_id + 1)")])
    args = d.array([_pick_list(d, 1, "event_id")])
    return f"""
    SELECT event_id, {d.array(q)} AS turns, {d.array(["response", "expected"])} AS responses,
           {ids} AS instruction_id_list, {args} AS kwargs
    FROM ({choices(d)}) c"""


# --- calls (events) ---------------------------------------------------------


def call_log(d: Dialect) -> str:
    same = """concat('{"arguments":', props, ',"name":"', event_type, '"}')"""
    k = "regexp_extract(props, '([0-9]+)', 1)"
    return f"""
    SELECT event_id, event_type, props, {k} AS k,
           concat('Call ', event_type, ' for user ', user_id) AS question,
           concat('[{{"name":"', event_type, '","parameters":{{"k":"int"}}}},7]') AS function,
           {same} AS answer,
           CASE CAST(event_id % 8 AS INT)
             WHEN 0 THEN concat('[', {same}, ']')
             WHEN 1 THEN concat('{{"arguments":', props, ',"name":"other"}}')
             WHEN 2 THEN concat('{{"arguments":{{"k":1', {k}, '}},"name":"', event_type, '"}}')
             WHEN 3 THEN concat('{{"arguments":{{"k":"', {k}, '"}},"name":"', event_type, '"}}')
             WHEN 4 THEN concat('[', {same}, ',', {same}, ']')
             WHEN 5 THEN '[]'
             WHEN 6 THEN concat('Here: {FENCE}json', chr(10), {same}, chr(10), '{FENCE}')
             ELSE concat(event_type, '(k=', {k}, ')') END AS response
    FROM @events"""


def nested_arguments(d: Dialect) -> str:
    return """
    SELECT event_id, event_type, concat('{"name":"f","arguments":', CASE CAST(event_id % 6 AS INT)
             WHEN 0 THEN concat('{"b":', props, ',"a":[1,"2",null]}')
             WHEN 1 THEN concat('{"x":{"y":', value, '}}')
             WHEN 2 THEN concat('{"x":', value, '}')
             WHEN 3 THEN '"plain text"' WHEN 4 THEN '[1,2]'
             ELSE concat('{"k":"[', event_id, ']"}') END, '}') AS response
    FROM @events"""


def flat_arguments(d: Dialect) -> str:
    k = "regexp_extract(props, '([0-9]+)', 1)"
    return f"""
    SELECT event_id, concat('{{"name":"f","arguments":', CASE CAST(event_id % 6 AS INT)
             WHEN 0 THEN props
             WHEN 1 THEN concat('{{"k":"', {k}, '"}}')
             WHEN 2 THEN concat('{{"k":" word ', event_type, ' "}}')
             WHEN 3 THEN '{{"k":true}}' WHEN 4 THEN '{{"k":null}}'
             ELSE concat('{{"k":', {k}, '.0}}') END, '}}') AS response
    FROM @events"""


# --- requests (events) ------------------------------------------------------


def requests(d: Dialect) -> str:
    return """
    SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS start_ts, event_type AS suite,
           concat('org/m', user_id % 3) AS model,
           CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 1000.0 END AS ttft_seconds,
           value / 1000.0 + CAST(event_id % 50 AS DOUBLE) / 10.0 AS total_latency_seconds,
           50 + event_id % 100 AS prompt_tokens, event_id % 300 AS completion_tokens,
           CASE WHEN value > 100 THEN 'timeout' END AS error,
           event_id % 7 <> 0 AS streamed
    FROM @events"""


# --- code and patches (documents) ------------------------------------------


def code_answers(d: Dialect) -> str:
    nl = "chr(10)"
    return f"""
    SELECT doc_id, concat('task/', doc_id) AS task_id, text,
           concat('def f', doc_id, '(x):', {nl}) AS prompt,
           concat('def check(f): assert f(', doc_id, ')') AS test,
           concat('f', doc_id) AS entry_point,
           CASE CAST(doc_id % 7 AS INT)
             WHEN 0 THEN concat(' {FENCE}python', {nl}, text, {nl}, ' {FENCE} ')
             WHEN 1 THEN concat('def f(x):', {nl}, text)
             WHEN 2 THEN concat('{FENCE}bash', {nl}, text, {nl}, '{FENCE}')
             WHEN 3 THEN concat('Run', {nl}, '  $ ls ', doc_id, {nl}, text)
             WHEN 4 THEN concat('diff --git a b', {nl}, '@@ -1 +1 @@', {nl}, '-', text, {nl}, '+new')
             WHEN 5 THEN concat('See {FENCE}diff', {nl}, '+', text, {nl}, '{FENCE}')
             ELSE concat('{FENCE}', text) END AS response,
           CAST(doc_id % 3 AS INT) AS exit_code
    FROM @documents"""


def code_runs(d: Dialect) -> str:
    """Programs of Spanish documents never ran."""
    return f"""
    SELECT doc_id, exit_code, text AS output FROM ({code_answers(d)}) c
    WHERE text NOT LIKE '% los %'"""


# --- tests, attempts (orders, lineitem) -------------------------------------


def patch_tasks(d: Dialect) -> str:
    return """
    SELECT o_orderkey, concat('issue-', o_orderkey) AS instance_id,
           concat('Order ', o_orderkey, ' of ', o_custkey, ' fails') AS problem_statement,
           'org/repo' AS repo, o_orderpriority <> '5-LOW' AS has_patch,
           CASE WHEN o_orderstatus = 'F' THEN 'not json'
                ELSE concat('["t', o_custkey, '","t', o_orderkey, '"]') END AS FAIL_TO_PASS,
           CASE WHEN o_orderstatus = 'O' THEN '[]'
                ELSE concat('["p', o_orderkey, '"]') END AS PASS_TO_PASS
    FROM @orders"""


def patch_answers(d: Dialect) -> str:
    return f"""
    SELECT instance_id AS sample_id, CASE WHEN has_patch
      THEN concat('Fix: {FENCE}diff', chr(10), '+', problem_statement, chr(10), '{FENCE}')
      ELSE concat('No patch for ', problem_statement) END AS response
    FROM ({patch_tasks(d)}) t"""


def test_log(d: Dialect) -> str:
    return """
    SELECT l_orderkey AS sample_id, CASE WHEN l_linenumber <= 2 THEN 'f2p' ELSE 'p2p' END AS kind,
           l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AS passed
    FROM @lineitem"""


def attempts(d: Dialect) -> str:
    return """
    SELECT o_custkey AS task_id, o_orderpriority AS run, o_orderstatus <> 'F' AS passed
    FROM @orders"""
