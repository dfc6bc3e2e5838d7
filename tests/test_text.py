from pyspark.sql import functions as F

from plumbline.functions import answer_sets, choice, jsontext
from plumbline.functions.text import contains_match, exact_match, normalize, strip, word_count


def test_normalize(evaluate):
    cases = {
        "hello, world!": "hello world",
        "it's a test.": "its a test",
        "! a": " a",
        "  Hello   World ": "hello world",
        "Éclair ﬁne": "eclair fine",
        "a \tb": "a b",
        "snake_case-x": "snake_casex",
        "": "",
        "½ cup": "12 cup",
    }
    assert evaluate(normalize(F.col("a")), list(cases)) == list(cases.values())


def test_exact_and_contains(evaluate):
    pairs = [("hello world", "Hello World"), ("  hello  world  ", "hello world"), ("hello", "world")]
    assert evaluate(exact_match(F.col("a"), F.col("b")), pairs) == [True, True, False]
    pairs = [("The Answer Is 42!", "answer is 42"), ("hello", "world"), ("x", "")]
    assert evaluate(contains_match(F.col("a"), F.col("b")), pairs) == [True, False, True]


def test_strip_and_words_use_unicode_space(evaluate):
    texts = ["　 a b \x1f", " ", "", "a b\x85c"]
    assert evaluate(strip(F.col("a")), texts) == [t.strip() for t in texts]
    assert evaluate(word_count(F.col("a")), texts) == [len(t.split()) for t in texts]


def test_letters(evaluate):
    cases = {
        "The answer is B": "B",
        "A": "A",
        "(C)": "C",
        "Answer: D": "D",
        "answer:(b)": "B",
        "The answer is because": "B",
        "So it must be C.": "C",
        "I think (A) fits, or D": "A",
        "Not B, more likely D": "D",
        "": None,
        "no idea": None,
        "it is a trap": "A",
        "first line\n c \nlast": "C",
        "éA": None,
    }
    assert evaluate(choice.extract_letter(F.col("a"), 4), list(cases)) == list(cases.values())


def test_letters_of_ten(evaluate):
    cases = {"The answer is H": "H", "J": "J", "The answer is K": None, "H.": "H"}
    assert evaluate(choice.extract_letter(F.col("a"), 10), list(cases)) == list(cases.values())
    letters = choice.extract_letter(F.col("a"), 4)
    rows = [("B.", "B"), ("b", "b"), ("zzz", "A")]
    assert evaluate(choice.choice_matches(letters, F.col("b")), rows) == [True, True, False]


def test_sets(evaluate):
    cases = {
        "{a, b, c}": ["a", "b", "c"],
        "a\nb\nc": ["a", "b", "c"],
        "[x, 'y', \"z\"] and more": ["x", "y", "z"],
        "{}": [],
        "{'', a}": ["", "a"],
        "see {a,\nb] rest": ["a", "b"],
        " , ,": [],
        "a, a": ["a"],
    }
    assert evaluate(answer_sets.extract_set(F.col("a")), list(cases)) == list(cases.values())


def test_set_comparison(evaluate):
    left, right = answer_sets.extract_set(F.col("a")), answer_sets.extract_set(F.col("b"))
    pairs = [("{a, b, c}", "{c, b, a}"), ("{a, b}", "{a, b, c}"), ("{}", "{}"), ("{a}", "{}"), ("{a}", "{b}")]
    assert evaluate(answer_sets.same_set(left, right), pairs) == [True, False, True, False, False]
    scores = evaluate(answer_sets.jaccard(left, right), pairs)
    assert [round(s, 6) for s in scores] == [1.0, 0.666667, 1.0, 0.0, 0.0]
    flipped = evaluate(answer_sets.jaccard(right, left), pairs)
    assert scores == flipped


def test_strict_json(evaluate):
    good = ['{"a":1}', "[]", "null", ' "x" ', "NaN", "[-Infinity, NaN]", '{"a":1,"a":2}', "1e5"]
    bad = ['{"a":1} xyz', "1,2", "1],[2", '1}{"b":2', "", "{a:1}", "'x'", "NaNa", "[1,]", '{"k":1']
    assert evaluate(jsontext.is_json(F.col("a")), good) == [True] * len(good)
    assert evaluate(jsontext.is_json(F.col("a")), bad) == [False] * len(bad)
    parsed = F.to_json(jsontext.parse(F.col("a")))
    assert evaluate(parsed, ['{"b":1,"a":[1,"x"]}', "7 apples"]) == ['{"a":[1,"x"],"b":1}', None]
