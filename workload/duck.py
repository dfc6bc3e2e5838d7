"""DuckDB spellings of the text rules, for the oracle queries."""

from __future__ import annotations

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
FENCE = "```"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def norm(x: str) -> str:
    bare = rf"regexp_replace({strip(f'strip_accents(lower({x}))')}, '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g')"
    return f"regexp_replace({bare}, '[{SPACE}]+', ' ', 'g')"


def letter(x: str, n: int = 4) -> str:
    set_ = "ABCDEFGHIJ"[:n]
    t = strip(x)
    patterns = [
        rf"(?im)(?:the\s+)?answer\s*(?:is|:)\s*\(?([{set_}])\)?",
        rf"(?im)\b([{set_}])\s*[.)]\s*$",
        rf"(?im)^\s*\(?([{set_}])\)?\s*$",
        rf"(?i)\(([{set_}])\)",
        rf"(?is)^.*\b([{set_}])\b",
    ]
    found = ", ".join(f"nullif(regexp_extract({t}, '{p}', 1), '')" for p in patterns)
    return f"upper(coalesce({found}))"


def item_set(x: str) -> str:
    t = strip(x)
    region = r"(?s)[\[{](.*?)[\]}]"
    inner = f"CASE WHEN regexp_matches({t}, '{region}') THEN regexp_extract({t}, '{region}', 1) ELSE {t} END"
    item = strip(f"trim({strip('i')}, '''\"')")
    return (
        rf"list_distinct([{item} for i in string_split_regex({inner}, '[,\n]') if {strip('i')} <> ''])"
    )


def group(x: str, pattern: str) -> str:
    """Group 1 of the first match or NULL."""
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', 1) END"


def completion(x: str) -> str:
    t = strip(x)
    blank = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}"
    opened = rf"regexp_replace({t}, '^[^\n]*(\n|$)', '')"
    closed = rf"regexp_replace({opened}, '(\n|^)[{blank}]*{FENCE}[{blank}]*$', '')"
    return f"CASE WHEN starts_with({t}, '{FENCE}') THEN {closed} ELSE {t} END"


def command(x: str) -> str:
    block = strip(group(x, rf"(?s){FENCE}(?:bash|sh)?[{SPACE}]*\n(.*?){FENCE}"))
    line = f"[{strip('l')} for l in string_split({x}, chr(10)) if starts_with({strip('l')}, '$ ')][1]"
    return f"coalesce({block}, substr({line}, 3))"


def patch(x: str) -> str:
    block = strip(group(x, rf"(?s){FENCE}(?:diff|patch)?[{SPACE}]*\n(.*?){FENCE}"))
    lines = rf"[l for l in string_split({x}, chr(10)) if regexp_matches(l, '^(\+|-|@@|diff )')]"
    return (
        f"coalesce({block}, CASE WHEN len({lines}) >= 3 "
        f"THEN array_to_string({lines}, chr(10)) END)"
    )


# --- instruction rules -------------------------------------------------------


def valid_args(k: str) -> str:
    return f"CASE WHEN {k} IS NOT NULL AND json_valid({k}) THEN {k} ELSE '{{}}' END"


def _number(key: str, default: float) -> str:
    return (
        f"CASE WHEN json_type(k) <> 'OBJECT' THEN NULL WHEN json_type(k, '$.{key}') IS NULL THEN {default} "
        f"WHEN json_type(k, '$.{key}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
        f"THEN CAST(json_extract_string(k, '$.{key}') AS DOUBLE) END"
    )


def _text(key: str, default: str) -> str:
    return (
        f"CASE WHEN json_type(k) <> 'OBJECT' THEN NULL WHEN json_type(k, '$.{key}') IS NULL THEN '{default}' "
        f"WHEN json_type(k, '$.{key}') = 'VARCHAR' THEN json_extract_string(k, '$.{key}') END"
    )


def _words(key: str) -> str:
    items = f"from_json(json_extract(k, '$.{key}'), '[\"json\"]')"
    return (
        f"CASE WHEN json_type(k, '$.{key}') IS NULL THEN CAST([] AS varchar[]) "
        f"WHEN json_type(k, '$.{key}') = 'ARRAY' AND len([x for x in {items} if json_type(x) <> 'VARCHAR']) = 0 "
        f"THEN [json_extract_string(x, '$') for x in {items}] END"
    )


def _relation(count: str, relation: str, bound: str, exactly: bool) -> str:
    last = f" WHEN ({relation}) = 'exactly' THEN {count} = ({bound})" if exactly else ""
    return (
        f"CASE WHEN ({relation}) = 'at least' THEN {count} >= ({bound}) "
        f"WHEN ({relation}) = 'at most' THEN {count} <= ({bound}){last} END"
    )


def _count(text: str, part: str) -> str:
    return (
        f"CASE WHEN ({part}) = '' THEN length({text}) + 1 ELSE "
        f"(length({text}) - length(replace({text}, ({part}), ''))) / nullif(length({part}), 0) END"
    )


def _matches(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def rule_outcome() -> str:
    """CASE over ``rule_id`` for the columns ``t`` (text) and ``k`` (arguments)."""
    low = "lower(t)"
    words = _matches(f"[^{SPACE}]+")
    sentences = f"len([s for s in string_split_regex(t, '[.!?]+') if {strip('s')} <> ''])"
    paragraphs = f"[{strip('p')} for p in string_split(t, chr(10) || chr(10)) if {strip('p')} <> '']"
    nth = f"CAST({_number('nth_paragraph', 1)} AS BIGINT)"
    nth_word = (
        f"trim(lower(regexp_extract(({paragraphs})[CASE WHEN {nth} >= 1 THEN {nth} END], "
        f"'^[^{SPACE}]+')), '*#_')"
    )
    sections = rf"len(regexp_extract_all(t, '(?i)' || regexp_escape({_text('section_spliter', 'Section')}) || '[{SPACE}]*\d*'))"
    headers = _matches(rf"(?m)^#+[{SPACE}]")
    prompt = _text("prompt_to_repeat", "")
    block = strip(group("t", rf"(?s){FENCE}(?:json)?[{SPACE}]*\n(.*?){FENCE}"))
    body = strip("t")
    cases = {
        "keywords:existence": f"len([w for w in {_words('keywords')} if NOT contains({low}, lower(w))]) = 0",
        "keywords:frequency": _relation(
            _count(low, f"lower({_text('keyword', '')})"), _text("relation", "at least"), _number("frequency", 0), True
        ),
        "keywords:forbidden_words": f"len([w for w in {_words('forbidden_words')} if contains({low}, lower(w))]) = 0",
        "keywords:letter_frequency": _relation(
            _count(low, f"lower({_text('letter', '')})"), _text("let_relation", "at least"), _number("let_frequency", 0), False
        ),
        "language:response_language": (
            f"CASE WHEN lower({_text('language', '')}) IN ('en', 'english') THEN "
            r"length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / greatest(length(t), 1) > 0.8 "
            f"WHEN ({_text('language', '')}) IS NOT NULL THEN true END"
        ),
        "length_constraints:number_words": _relation(words, _text("relation", "at least"), _number("num_words", 0), True),
        "length_constraints:number_sentences": _relation(
            sentences, _text("relation", "at least"), _number("num_sentences", 0), False
        ),
        "length_constraints:number_paragraphs": _relation(
            f"len({paragraphs})", _text("relation", "at least"), _number("num_paragraphs", 0), False
        ),
        "length_constraints:nth_paragraph_first_word": (
            f"len({paragraphs}) >= ({_number('num_paragraphs', 1)}) AND {nth_word} = lower({_text('first_word', '')})"
        ),
        "detectable_format:number_words_in_section": _relation(
            words, _text("relation", "at least"), _number("num_words", 0), False
        ),
        "detectable_content:number_placeholders": rf"{_matches(r'\[.*?\]')} >= ({_number('num_placeholders', 0)})",
        "detectable_content:postscript": (
            f"contains(t, ({_text('postscript_marker', 'P.S.')})) OR "
            f"(contains(t, 'P.S.') AND ({_text('postscript_marker', 'P.S.')}) IS NOT NULL)"
        ),
        "detectable_format:number_bullet_lists": (
            f"{_matches(rf'(?m)^[{SPACE}]*[-*•][{SPACE}]')} >= ({_number('num_bullets', 0)})"
        ),
        "detectable_format:constrained_response": f"{body} <> ''",
        "detectable_format:number_highlighted_sections": rf"{_matches(r'\*[^*]+\*')} >= ({_number('num_highlights', 0)})",
        "detectable_format:multiple_sections": (
            f"CASE WHEN {sections} > 0 THEN {sections} WHEN {sections} = 0 THEN {headers} END >= ({_number('num_sections', 0)})"
        ),
        "detectable_format:json_format": f"json_valid({body}) OR coalesce(json_valid({block}), false)",
        "detectable_format:title": "regexp_matches(t, '<<[^>]+>>')",
        "combination:two_responses": "contains(t, '******')",
        "combination:repeat_prompt": (
            f"json_type(k) = 'OBJECT' AND (json_type(k, '$.prompt_to_repeat') IS NULL "
            f"OR json_type(k, '$.prompt_to_repeat') = 'NULL' OR coalesce(starts_with({body}, {strip(prompt)}), false))"
        ),
        "startend:end_checker": f"ends_with({body}, {strip(_text('end_phrase', ''))})",
        "startend:quotation": f"""starts_with({body}, '"') AND ends_with({body}, '"')""",
        "change_case:english_capital": r"NOT regexp_matches(t, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]')",
        "change_case:english_lowercase": (
            r"NOT regexp_matches(regexp_replace(t, '[ªº]', '', 'g'), '[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]')"
        ),
        "punctuation:no_comma": "NOT contains(t, ',')",
    }
    whens = " ".join(f"WHEN '{rule}' THEN {sql}" for rule, sql in cases.items())
    return f"coalesce(CASE rule_id {whens} ELSE false END, false)"
