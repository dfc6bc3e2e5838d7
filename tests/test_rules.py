import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import instructions

CASES = [
    # rule, text, arguments, outcome
    ("keywords:existence", "Hello World", {"keywords": ["hello", "world"]}, True),
    ("keywords:existence", "Hello", {"keywords": ["hello", "world"]}, False),
    ("keywords:existence", "x", {}, True),
    ("keywords:existence", "x", {"keywords": None}, False),
    ("keywords:existence", "abc", {"keywords": "cab"}, True),
    ("keywords:existence", "x", {"keywords": ["x", 1]}, False),
    ("keywords:frequency", "aaaa", {"keyword": "AA", "frequency": 2, "relation": "exactly"}, True),
    ("keywords:frequency", "abc", {"keyword": "", "frequency": 4, "relation": "exactly"}, True),
    ("keywords:frequency", "a a", {"keyword": "a", "frequency": 1, "relation": "at most"}, False),
    ("keywords:frequency", "a", {"keyword": "a", "relation": "below"}, False),
    ("keywords:frequency", "a", {"keyword": "a", "frequency": True}, True),
    ("keywords:frequency", "a", {"keyword": "a", "frequency": "1"}, False),
    ("keywords:forbidden_words", "fine text", {"forbidden_words": ["bad"]}, True),
    ("keywords:forbidden_words", "a BAD text", {"forbidden_words": ["bad"]}, False),
    ("keywords:forbidden_words", "x", {"forbidden_words": None}, False),
    ("keywords:letter_frequency", "eEx", {"letter": "e", "let_frequency": 2}, True),
    ("keywords:letter_frequency", "e", {"letter": "e", "let_frequency": 1, "let_relation": "exactly"}, False),
    ("language:response_language", "plain text", {"language": "English"}, True),
    ("language:response_language", "ééééé", {"language": "en"}, False),
    ("language:response_language", "", {"language": "en"}, False),
    ("language:response_language", "ééé", {"language": "fr"}, True),
    ("language:response_language", "x", {"language": None}, False),
    ("length_constraints:number_words", "one two three four five", {"num_words": 5, "relation": "at least"}, True),
    ("length_constraints:number_words", "one", {"num_words": 5}, False),
    ("length_constraints:number_words", "a b", {"num_words": 2.0, "relation": "exactly"}, True),
    ("length_constraints:number_sentences", "One. Two! Three?", {"num_sentences": 3}, True),
    ("length_constraints:number_sentences", "One... ", {"num_sentences": 1, "relation": "at most"}, True),
    ("length_constraints:number_sentences", "One.", {"num_sentences": 1, "relation": "exactly"}, False),
    ("length_constraints:number_paragraphs", "a\n\nb\n\n\n\n", {"num_paragraphs": 2, "relation": "at most"}, True),
    ("length_constraints:number_paragraphs", "a\nb", {"num_paragraphs": 2}, False),
    ("length_constraints:nth_paragraph_first_word", "x\n\n**Title** rest", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "title"}, True),
    ("length_constraints:nth_paragraph_first_word", "Title, rest", {"first_word": "title"}, False),
    ("length_constraints:nth_paragraph_first_word", "a", {"nth_paragraph": 2, "first_word": "a"}, False),
    ("length_constraints:nth_paragraph_first_word", "a", {"nth_paragraph": 0, "first_word": "a"}, False),
    ("length_constraints:nth_paragraph_first_word", "a", {"nth_paragraph": 1.0, "first_word": "a"}, False),
    ("length_constraints:nth_paragraph_first_word", "", {"first_word": ""}, False),
    ("length_constraints:nth_paragraph_first_word", "", {"num_paragraphs": 0, "first_word": ""}, False),
    ("detectable_content:number_placeholders", "[a] and [b]", {"num_placeholders": 2}, True),
    ("detectable_content:number_placeholders", "[a\nb]", {"num_placeholders": 1}, False),
    ("detectable_content:postscript", "text P.S. more", {"postscript_marker": "P.P.S"}, True),
    ("detectable_content:postscript", "none", {}, False),
    ("detectable_content:postscript", "P.S.", {"postscript_marker": None}, False),
    ("detectable_format:number_bullet_lists", "- a\n  * b\n• c", {"num_bullets": 3}, True),
    ("detectable_format:number_bullet_lists", "-a\n*b", {"num_bullets": 1}, False),
    ("detectable_format:constrained_response", "  x ", {}, True),
    ("detectable_format:constrained_response", " \n ", {}, False),
    ("detectable_format:number_highlighted_sections", "*a* and *b*", {"num_highlights": 2}, True),
    ("detectable_format:number_highlighted_sections", "**", {"num_highlights": 1}, False),
    ("detectable_format:multiple_sections", "Section 1\nsection 2", {"num_sections": 2}, True),
    ("detectable_format:multiple_sections", "# a\n## b", {"num_sections": 2}, True),
    ("detectable_format:multiple_sections", "lXa", {"section_spliter": "l.a", "num_sections": 1}, False),
    ("detectable_format:multiple_sections", "a\\Eb a\\EB", {"section_spliter": "a\\Eb", "num_sections": 2}, True),
    ("detectable_format:multiple_sections", "x", {"section_spliter": 5}, False),
    ("detectable_format:json_format", '{"a": 1}', {}, True),
    ("detectable_format:json_format", "not json", {}, False),
    ("detectable_format:json_format", 'x\n```json\n[1, 2]\n```', {}, True),
    ("detectable_format:json_format", '```{"a":1}```', {}, False),
    ("detectable_format:json_format", '{"a": 1} tail', {}, False),
    ("detectable_format:title", "a <<title>> b", {}, True),
    ("detectable_format:title", "<<>>", {}, False),
    ("detectable_format:number_words_in_section", "a b c", {"num_words": 3}, True),
    ("detectable_format:number_words_in_section", "a b", {"num_words": 2, "relation": "exactly"}, False),
    ("combination:two_responses", "a ****** b", {}, True),
    ("combination:two_responses", "a ***** b", {}, False),
    ("combination:repeat_prompt", " ask me: yes", {"prompt_to_repeat": "ask me "}, True),
    ("combination:repeat_prompt", "yes", {"prompt_to_repeat": "ask"}, False),
    ("combination:repeat_prompt", "yes", {"prompt_to_repeat": None}, True),
    ("combination:repeat_prompt", "yes", {"prompt_to_repeat": 5}, False),
    ("combination:repeat_prompt", "yes", {"prompt_to_repeat": 0}, True),
    ("startend:end_checker", "this is THE END ", {"end_phrase": "THE END"}, True),
    ("startend:end_checker", "this is the end", {"end_phrase": "THE END"}, False),
    ("startend:end_checker", "x", {"end_phrase": None}, False),
    ("startend:quotation", ' "quoted" ', {}, True),
    ("startend:quotation", '"', {}, True),
    ("startend:quotation", '"a', {}, False),
    ("change_case:english_capital", "HELLO 12!", {}, True),
    ("change_case:english_capital", "Hello", {}, False),
    ("change_case:english_capital", "12", {}, True),
    ("change_case:english_capital", "漢", {}, False),
    ("change_case:english_lowercase", "hello ß", {}, True),
    ("change_case:english_lowercase", "Hello", {}, False),
    ("punctuation:no_comma", "no commas", {}, True),
    ("punctuation:no_comma", "a, b", {}, False),
    ("no:such_rule", "x", {}, False),
    # arguments that are no object fail only the rules that read them
    ("keywords:existence", "x", [], False),
    ("combination:repeat_prompt", "x", [], False),
    ("punctuation:no_comma", "x", [], True),
]


def test_every_rule(spark):
    rows = [(i, text, [rule], [json.dumps(args)]) for i, (rule, text, args, _) in enumerate(CASES)]
    data = spark.createDataFrame(
        rows, "i int, response string, instruction_id_list array<string>, kwargs array<string>"
    )
    checked = instructions.outcomes_long(instructions.check_rules(data), "i")
    got = {r.i: r["pass"] for r in checked.collect()}
    wrong = [(case, got[i]) for i, case in enumerate(CASES) if got[i] != case[3]]
    assert not wrong
    assert {c[0] for c in CASES} >= set(rules.RULES) - {r for r in rules.RULES if r.startswith("custom:")}


def test_roll_up_of_lists(spark):
    rows = [
        (1, "a, b", ["punctuation:no_comma", "detectable_format:title"], ["{}"]),
        (2, "x", [], []),
        (3, "x", None, None),
        (4, "x", ["keywords:existence"], ["broken"]),
        (5, "x", ["keywords:existence"], ["null"]),
        (6, "x", ["keywords:existence"], [None]),
    ]
    data = spark.createDataFrame(
        rows, "i int, response string, instruction_id_list array<string>, kwargs array<string>"
    )
    scored = instructions.score_rules(data).orderBy("i")
    got = [(r.correct, r.num_instructions, r.num_passed) for r in scored.collect()]
    assert got == [(False, 2, 0), (True, 0, 0), (True, 0, 0), (True, 1, 1), (False, 1, 0), (True, 1, 1)]
    lenient = instructions.score_rules(data, falsy_is_empty=True).orderBy("i")
    assert [r.correct for r in lenient.collect()] == [False, True, True, True, True, True]


def test_own_rule(spark):
    @rules.register_rule("custom:starts_with")
    def starts(text, args):
        return F.startswith(text, args.text("start", ""))

    try:
        data = spark.createDataFrame(
            [(1, "abc", ["custom:starts_with"], ['{"start":"ab"}'])],
            "i int, response string, instruction_id_list array<string>, kwargs array<string>",
        )
        assert instructions.score_rules(data).first().correct is True
    finally:
        del rules.RULES["custom:starts_with"]


def test_turns(spark):
    samples = spark.createDataFrame(
        [("s", ["p0", "p1", "p2"], [["punctuation:no_comma"], ["detectable_format:title"]], [["{}"]])],
        "sample_id string, turns array<string>, instruction_id_list array<array<string>>, kwargs array<array<string>>",
    )
    long = instructions.turns_long(samples, "sample_id")
    rows = {r.turn: (r.instruction_id_list, r.kwargs) for r in long.collect()}
    assert rows == {
        0: (["punctuation:no_comma"], ["{}"]),
        1: (["detectable_format:title"], ["{}"]),
        2: ([], []),
    }
    answers = spark.createDataFrame(
        [("s", 0, "fine"), ("s", 1, "<<t>>"), ("s", 2, None)], "sample_id string, turn int, response string"
    )
    per_turn, per_sample = instructions.score_turns(answers, long)
    assert {r.turn: r["pass"] for r in per_turn.collect()} == {0: True, 1: True, 2: True}
    assert per_sample.first().asDict() == {
        "sample_id": "s", "correct": True, "num_turns": 3, "num_turns_passed": 3,
    }


@pytest.mark.parametrize(
    ("text", "expected"),
    [('[{"a":1},null]', ['{"a":1}', "null"]), ("oops", ["{}"]), ('{"a":1}', ['{"a":1}'])],
)
def test_argument_list(evaluate, text, expected):
    assert evaluate(instructions.argument_list(F.col("a")), [text]) == [expected]


def test_features_of_a_response_are_computed_once(spark):
    """However many rules read them, and only where one does."""
    ids = [*rules.READERS["lower"], *rules.READERS["stripped"], *rules.READERS["num_words"], *rules.READERS["paragraphs"]]
    data = spark.createDataFrame([(" Some WORDS here. ", ids, ["{}"] * len(ids))], "response string, instruction_id_list array<string>, kwargs array<string>")
    checked = instructions.check_rules(data)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(response") == 1 and len(re.findall(r"split\(response#\d+, \n\n", plan)) == 1
    alone = [instructions.check_rules(data.withColumns({"instruction_id_list": F.array(F.lit(i)), "kwargs": F.array(F.lit("{}"))})).first().per_instruction[0][1] for i in ids[:3]]
    assert [o[1] for o in checked.first().per_instruction][:3] == alone
    nothing = data.select(rules.features(F.col("response"), F.array(F.lit("punctuation:no_comma"))).alias("f")).first().f
    assert all(v is None for v in nothing)


JSON_TEXTS = [
    "{}", "[]", "1", "-0", "1.5e3", '"a"', "null", "true", " {} ", '{"a": [1, {"b": null}]}', '"it\'s"', '"\\"\'"', '{"a": "\\\\"}', '"\\u00e9"', "[1, 2]",
    "", " ", "{", "[1,]", "{'a': 1}", "'a'", "01", "1.", ".5", "+1", "{} {}", "1 2", "[1] [2]", '{"a": 1}, {"b": 2}', "nul", "True", '"a', 'a"', '"\n"', '"a\tb"', '"\\x"', '"\\"',
    "{a: 1}", '{"a" 1}', "[1 2]", "// c\n1", '{"a": \'b\'}', '["a", \'b"c\']', '"a" \'', "]", "1]", "[1", '"a"]["b"', "NaN", "[NaN, -Infinity]", '{"a": Infinity}', "Infinit", "\u00a01", "\ufeff1",
]


def test_json_is_told_by_one_parser(spark):
    """What Python's reader takes, on short texts and on long ones."""
    from plumbline.functions import jsontext

    def valid(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    data = spark.createDataFrame(list(enumerate(JSON_TEXTS)), "i int, t string")
    got = {r.t: r.v for r in data.select("t", jsontext.is_json(F.col("t")).alias("v")).collect()}
    assert {t for t in JSON_TEXTS if got[t] != valid(t)} == set()
    # Repeated by a column, so that no plan holds the text.
    filler = F.repeat(F.lit('"xxxxxxxxxxxxxxxxxxxxxxxxx",'), (F.length("t") * 0 + 2_700_000).cast("int"))
    long = F.concat(F.lit("["), filler, F.col("t"), F.lit("]"))
    some = data.filter(F.col("t").isin("{'a': 1}", '{"a": 1}', '["a", \'b"c\']')).union(spark.createDataFrame([(99, '{"a": 1}')], "i int, t string")).coalesce(1)
    for r in some.select("t", F.octet_length(long).alias("n"), jsontext.is_json(long).alias("v")).collect():
        assert r.n > 70_000_000 and r.v == valid(r.t)
