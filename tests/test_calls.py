import json

from plumbline.functions.call_text import with_calls
from plumbline.operators import calls


def read(spark, texts, **options):
    data = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = with_calls(data, "t", "c", **options).orderBy("i").collect()
    return [
        None if r.c.failed else [(c.name, [(a.k, a.t, a.v) for a in c.args]) for c in r.c.calls]
        for r in rows
    ]


def test_reading(spark):
    f1 = ("f", [("x", "n", "1")])
    cases = {
        '[{"name": "f", "arguments": {"x": 1}}]': [f1],
        '{"name": "f", "arguments": {"x": 1.0}}': [f1],
        '{"name": "f", "arguments": {"x": true}}': [f1],
        '{"name": "f", "arguments": {"x": "1"}}': [f1],
        '{"name": "f", "arguments": "{\\"x\\": 1}"}': [f1],
        'text ```json\n{"name": "f", "arguments": {"x": 1}}\n``` more': [f1],
        "f(x=1)": [f1],
        "module.f(2, x=1)": [f1],
        "f(x=1),\ng()": [f1, ("g", [])],
        "f(x=1), g()": [],
        "f(x=y)": None,
        "f(x=": [],
        "5": [],
        "": [],
        "[]": [],
        '{"arguments": {}}': [("", [])],
        '{"name": "f"}': [("f", [])],
        '{"name": "f", "arguments": {"x": null, "a": " b "}}': [("f", [("a", "s", "b"), ("x", "z", "")])],
        '[5]': [(None, [])],
    }
    got = read(spark, list(cases))
    assert got == list(cases.values())


def test_native_and_python_forms_agree(spark):
    """The same arguments compare equal whichever way they were read."""
    nested = '{"name":"f","arguments":{"x":{"b":2,"a":"[1, 2.0]"},"y":0.5}}'
    same = "f(y=0.5, x={'a': [1, 2], 'b': '2'})"
    other = "f(y=0.5, x={'a': [1, 3], 'b': '2'})"
    first, second, third = read(spark, [nested, same, other])
    assert first == second != third


def score(spark, rows):
    data = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, response string, expected string")
    return [(r.correct, r.error) for r in calls.score_calls(data).orderBy("i").collect()]


def test_scoring(spark):
    f = '{"name":"f","arguments":{"x":%s}}'
    bad = "calls cannot be compared"
    rows = [
        (f"[{f % 1}]", f"[{f % 1}]", True, None),
        (f % 1, f % 2, False, None),
        (f"[{f % 1},{f % 2}]", f"[{f % 2},{f % 1}]", True, None),
        (f"[{f % 1},{f % 1}]", f"[{f % 1},{f % 2}]", False, None),
        ("[]", "[]", True, None),
        ("nothing", "", True, None),
        (f % 1, "[]", False, None),
        ("f(x=1)", json.dumps(f % 1), True, None),
        ("f(x=y)", f % 1, False, bad),
        ("[7]", f % 1, False, bad),
        ("[7]", "[]", False, None),
        (f % '"a b"', f % '" a b "', True, None),
        (f % "NaN", f % "NaN", False, None),
    ]
    assert score(spark, [r[:2] for r in rows]) == [r[2:] for r in rows]


def test_structured_calls_win(spark):
    from pyspark.sql import functions as F

    data = spark.createDataFrame(
        [("g()", [("f", "{}")]), ("g()", []), (None, None)],
        "content string, tool_calls array<struct<name:string,arguments:string>>",
    )
    text = calls.predicted_text(F.col("content"), F.col("tool_calls"))
    assert [r.t for r in data.select(text.alias("t")).collect()] == [
        '[{"name":"f","arguments":"{}"}]', "g()", "",
    ]


def test_actions(spark):
    samples = spark.createDataFrame(
        [
            ("both", '[{"name":"a"},{"name":"b"}]'),
            ("order", '[{"name":"b"},{"name":"a"}]'),
            ("short", '[{"name":"a"},{"name":"b"},{"name":"c"}]'),
            ("free", "[]"),
            ("broken", "?"),
            ("silent", '[{"name":"a"}]'),
            ("object", '{"name":"a"}'),
            ("null", "null"),
        ],
        "sample_id string, expected_actions string",
    )
    log = [(s, t, [(n, "{}")]) for s in ("both", "order", "short", "free", "broken") for t, n in ((0, "a"), (3, "b"))]
    log.append(("both", 20, [("late", "{}")]))
    turns = spark.createDataFrame(log, f"sample_id string, turn int, tool_calls {calls.TOOL_CALLS}")
    got = {r.sample_id: (r.correct, r.num_turns, r.num_actions) for r in calls.score_actions(samples, turns, max_turns=calls.MAX_TURNS).collect()}
    assert got == {
        "both": (True, 2, 2),
        "order": (False, 2, 2),
        "short": (False, 2, 2),
        "free": (True, 2, 2),
        "broken": (True, 2, 2),
        "silent": (False, 0, 0),
        "object": (False, 0, 0),
        "null": (True, 0, 0),
    }


SYNTAX = [
    "f()", "f(x=1)", "a.b.f(x=1)", "f (x = 1 , y = 'a' )", "f(x=1,)", "f(x=-1.5, y=1e3, z=2.0, w=0)", "f(x='it', y=\"a 'b' c\")", "f(x='say \"hi\"')",
    "f(x='', y=\"\")", "f(x=True, y=False, z=None)", "f(x='5', y=' b ', z='true', w='[1]')", "f(x=[1, 2], y={'k': None})", "f(x=[], y={})", "f(x=[{'a': [1.5]}])",
    "f(x=1),\ng(y='z')", "f(x=1), g()", "f(x=1)\n, g()", "f\n(x=1)", "f(x=1,\n y=2)", "f(x=')\\n', y=2)", "f(x=')',\n y=2), g()", "f(x=1),", "f(x=1),\n3", "3,\nf(x=1)",
    "f(1)", "f(1, x=2)", "f(*a, x=2)", "f(**k)", "f(x=1, x=2)", "f(x=1, **{'y': 2})", "f(x=g(y=1))", "f(x=[g(y=1)])", "f(x=y)", "f(x=(1, 2))", "f(x={1, 2})", "f(x={1: 2})",
    "f('x': 1)", "f('x'=1)", "f(x={y=1})", "f('a':1, x={b=2})", "f(x:1)", "f(x==1)", "f(x=1=2)", "f(None=1)", "None(x=1)", "a.if(x=1)", "lambda(x=1)", "f(if=1)", "f(x=1) # two words (y)",
    "f(x=007)", "f(x=0x1)", "f(x=1_000)", "f(x=1.)", "f(x=.5)", "f(x=+1)", "f(x=1-2)", "f(x=- 1)", "f(x=1j)", "f(x=12345678901234567890)", "f(x=0.1, y=1e300, z=1e-7, w=100000000000000000.5)",
    "f(x='a' 'b')", "f(x='a\\tb')", "f(x='a\tb')", "f(x=r'a')", "f(x=b'a')", "f(x='''a b''')", "f(x=\"\"\"two words\n(more words)\"\"\")", "f(x=f'{y}')", "f(x='é語')", "fé(x=1)", "f(x=1)(y=2)",
    "(f)(x=1)", "a[0](x=1)", "'s'.f(x=1)", "f(x=1) + 2", "[f(x=1)]", "not f(x=1)", "f(x=1) if a else b", "x if f(a=1) else y", "f(x=1) g(y=2)", "f(x=1", "f x=1)", "f(x=)", "f(=1)", "(", "f(", "f)",
    "The answer (see below) is f(x=1)", "call f(x=1)", "don't (really)", "f(x='two words (here)')", "await f(x=1)", "f(x=1);g()", "f(x=1)\ng(y=2)", "f(x='\x01')", "f(x=1, y='\\'')", "print(x=1, end='')",
    "f(x=-0, y=-0.0, z=1E5)", "f(x=[1 2])", "f(x=[1,,2])", "f(x={'a' 1})", "f(x=1 y=2)", "f(x={'a': 1, 'a': 2})", "f(x=[True, None, 'None'])",
]


def test_call_syntax_reads_as_python_reads_it(spark):
    from plumbline.functions import call_text

    want = []
    for text in SYNTAX:
        told = call_text._read(text.strip(), None)
        want.append(None if told["failed"] else [(c["name"], [(e["k"], e["t"], str(float(e["v"])) if e["t"] == "f" else e["v"]) for e in c["args"]]) for c in told["calls"]])
    got = [None if c is None else [(n, [(k, t, str(float(v)) if t == "f" else v) for k, t, v in a]) for n, a in c] for c in read(spark, SYNTAX)]
    assert {t: (g, w) for t, g, w in zip(SYNTAX, got, want) if g != w} == {}


def test_python_sees_only_what_the_tokens_cannot_say(spark, monkeypatch):
    """Flat calls, several calls and prose never get there."""
    from plumbline.functions import call_text
    from pyspark.sql import functions as F

    monkeypatch.setattr(call_text, "_read_calls", lambda texts, blocks: F.when(texts.isNotNull(), F.raise_error(F.lit("asked")).cast(call_text.CALLS)))
    texts = ["f(x=1, y='a', z=1.5, w=None)", "a.f(x=1),\ng()", "f(x=1), g()", "The answer (see below) is 5", "No (really), it's fine", '{"name":"f","arguments":{"x":0.5}}', "text", ""]
    assert [c is None for c in read(spark, texts)] == [False] * len(texts)
    long = "f(" + ", ".join(f"a{i}='{'x' * 50}'" for i in range(20_000)) + ")"
    assert len(read(spark, [long])[0][0][1]) == 20_000
