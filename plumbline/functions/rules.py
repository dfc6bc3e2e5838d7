"""Verifiable instruction rules as column expressions.

A rule is a function ``(text, args) -> Column`` giving a boolean. ``args``
reads the rule's JSON arguments: a missing key takes its default, a value of
the wrong type (a JSON null included) makes the rule fail. Rules that never
look at their arguments hold whatever the arguments are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.functions.text import (
    FENCE,
    NOT_WS,
    SPACE,
    WS,
    bound_to,
    first_group,
    nonblank_parts,
    strip,
    word_count,
)

Rule = Callable[[Column, "Args"], Column]

RULES: dict[str, Rule] = {}

# What several rules read of a text, and the rules that read it. Computed once a
# text, and only where one of its rules asks for it.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "stripped": strip,
    "num_words": word_count,
    "paragraphs": lambda text: nonblank_parts(text, "\n\n"),
}
READERS: dict[str, list[str]] = {name: [] for name in FEATURES}

# The comparison words of the counting rules.
AT_LEAST, AT_MOST, EXACTLY = "at least", "at most", "exactly"


class Args:
    """Typed access to a MAP<STRING, VARIANT> of rule arguments."""

    def __init__(self, members: Column, features: Column | None = None):
        self.members = members
        self.features = features

    def feature(self, name: str, text: Column) -> Column:
        """A feature of the text: the one computed for all its rules, or a new one."""
        return FEATURES[name](text) if self.features is None else self.features.getField(name)

    def _typed(self, key: str, default: Column, accept: str, target: str) -> Column:
        value = F.try_element_at(self.members, F.lit(key))
        typed = F.when(
            F.rlike(jsontext.kind(value), F.lit(accept)),
            F.try_variant_get(value, "$", target),
        )
        # ``members`` is NULL when the arguments are no object at all: no default.
        return F.when(self.members.isNotNull() & value.isNull(), default).otherwise(typed)

    def number(self, key: str, default: float) -> Column:
        return self._typed(
            key, F.lit(float(default)), "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", "double"
        )

    def integer(self, key: str, default: int) -> Column:
        return self._typed(key, F.lit(default).cast("bigint"), "^(BIGINT|BOOLEAN)", "bigint")

    def text(self, key: str, default: str) -> Column:
        return self._typed(key, F.lit(default), "^STRING$", "string")

    def words(self, key: str) -> Column:
        """A list of strings; NULL when any item is something else.

        A plain string counts as the list of its characters, an object as the
        list of its keys.
        """
        value = F.try_element_at(self.members, F.lit(key))
        kind = jsontext.kind(value)
        items = jsontext.as_items(value)
        all_text = F.forall(items, lambda i: jsontext.kind(i) == "STRING")
        listed = F.when(all_text, F.transform(items, lambda i: F.try_variant_get(i, "$", "string")))
        letters = F.filter(F.split(F.try_variant_get(value, "$", "string"), ""), lambda c: c != "")
        keys = F.map_keys(jsontext.as_members(value))
        return (
            F.when(self.members.isNotNull() & value.isNull(), F.array().cast("array<string>"))
            .when(kind == "STRING", letters)
            .when(F.startswith(kind, F.lit("OBJECT")), keys)
            .otherwise(listed)
        )

    def is_falsy(self, key: str) -> Column:
        """Missing, null, empty, zero or false."""
        value = F.try_element_at(self.members, F.lit(key))
        printed = F.to_json(value)
        number = F.try_variant_get(value, "$", "double")
        numeric = F.rlike(jsontext.kind(value), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"))
        return F.when(self.members.isNotNull() & value.isNull(), F.lit(True)).otherwise(
            printed.isin("null", '""', "[]", "{}") | (numeric & (number == 0))
        )


def register_rule(rule_id: str, reads: str | None = None) -> Callable[[Rule], Rule]:
    """Add a rule under ``rule_id``; later registrations replace earlier ones.

    ``reads`` names the shared feature that the rule asks its ``Args`` for.
    """

    def add(rule: Rule) -> Rule:
        RULES[rule_id] = rule
        for name, readers in READERS.items():
            if rule_id in readers:
                readers.remove(rule_id)
            if name == reads:
                readers.append(rule_id)
        return rule

    return add


def features(text: Column, rule_ids: Column) -> Column:
    """One struct of all features of ``text``, NULL where no rule of the list reads them."""
    fields = []
    for name, make in FEATURES.items():
        asked = F.arrays_overlap(rule_ids, F.array(*map(F.lit, READERS[name]))) if READERS[name] else F.lit(False)
        fields.append(F.when(asked, make(text)).alias(name))
    return F.struct(*fields)


def check(
    text: Column, rule_id: Column, members: Column, only: list[str] | None = None, shared: Column | None = None
) -> Column:
    """Outcome of the rule named by ``rule_id``; unknown rules fail.

    ``only`` restricts the branches to the listed rules, for jobs that know
    which rules their data uses. ``shared`` is the text's ``features``.
    """
    args = Args(members, shared)
    outcome = None
    for known in only if only is not None else RULES:
        branch = RULES[known](text, args)
        outcome = (
            F.when(rule_id == known, branch)
            if outcome is None
            else outcome.when(rule_id == known, branch)
        )
    if outcome is None:
        return F.lit(False)
    return F.coalesce(outcome, F.lit(False))


def compare(count: Column, relation: Column, bound: Column, *, exactly: bool) -> Column:
    """``count`` against ``bound``; a relation the rule does not know fails."""
    verdict = F.when(relation == AT_LEAST, count >= bound).when(relation == AT_MOST, count <= bound)
    if exactly:
        verdict = verdict.when(relation == EXACTLY, count == bound)
    return verdict


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; an empty part occurs length + 1 times."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(part == "", F.length(text) + 1).otherwise(
        removed / F.nullif(F.length(part), F.lit(0))
    )


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# --- keywords ---------------------------------------------------------------


@register_rule("keywords:existence", reads="lower")
def _all_present(text: Column, args: Args) -> Column:
    lowered = args.feature("lower", text)
    return F.forall(args.words("keywords"), lambda w: F.contains(lowered, F.lower(w)))


@register_rule("keywords:frequency", reads="lower")
def _keyword_count(text: Column, args: Args) -> Column:
    count = occurrences(args.feature("lower", text), F.lower(args.text("keyword", "")))
    return compare(
        count, args.text("relation", AT_LEAST), args.number("frequency", 0), exactly=True
    )


@register_rule("keywords:forbidden_words", reads="lower")
def _none_present(text: Column, args: Args) -> Column:
    lowered = args.feature("lower", text)
    return ~F.exists(args.words("forbidden_words"), lambda w: F.contains(lowered, F.lower(w)))


@register_rule("keywords:letter_frequency", reads="lower")
def _letter_count(text: Column, args: Args) -> Column:
    count = occurrences(args.feature("lower", text), F.lower(args.text("letter", "")))
    return compare(
        count, args.text("let_relation", AT_LEAST), args.number("let_frequency", 0), exactly=False
    )


# --- language ---------------------------------------------------------------

# Names of English, share of ASCII characters it must exceed.
ENGLISH_NAMES = ("en", "english")
ENGLISH_ASCII_SHARE = 0.8


@register_rule("language:response_language")
def _language(text: Column, args: Args) -> Column:
    language = F.lower(args.text("language", ""))
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    share = ascii_chars / F.greatest(F.length(text), F.lit(1))
    return F.when(language.isin(*ENGLISH_NAMES), share > ENGLISH_ASCII_SHARE).when(
        language.isNotNull(), F.lit(True)
    )


# --- length -----------------------------------------------------------------


@register_rule("length_constraints:number_words", reads="num_words")
def _words(text: Column, args: Args) -> Column:
    return compare(
        args.feature("num_words", text),
        args.text("relation", AT_LEAST),
        args.number("num_words", 0),
        exactly=True,
    )


@register_rule("length_constraints:number_sentences")
def _sentences(text: Column, args: Args) -> Column:
    return compare(
        F.size(nonblank_parts(text, "[.!?]+")),
        args.text("relation", AT_LEAST),
        args.number("num_sentences", 0),
        exactly=False,
    )


@register_rule("length_constraints:number_paragraphs", reads="paragraphs")
def _paragraphs(text: Column, args: Args) -> Column:
    return compare(
        F.size(args.feature("paragraphs", text)),
        args.text("relation", AT_LEAST),
        args.number("num_paragraphs", 0),
        exactly=False,
    )


@register_rule("length_constraints:nth_paragraph_first_word", reads="paragraphs")
def _paragraph_start(text: Column, args: Args) -> Column:
    nth = args.integer("nth_paragraph", 1)
    fewest = args.number("num_paragraphs", 1)
    paragraph = bound_to(
        args.feature("paragraphs", text),
        lambda parts: F.when(
            (F.size(parts) >= fewest) & (nth >= 1), F.get(parts, (nth - 1).cast("int"))
        ),
    )
    word = F.btrim(F.lower(F.regexp_extract(paragraph, f"^{NOT_WS}+", 0)), F.lit("*#_"))
    return word == F.lower(args.text("first_word", ""))


# --- content ----------------------------------------------------------------


@register_rule("detectable_content:number_placeholders")
def _placeholders(text: Column, args: Args) -> Column:
    return pattern_count(text, r"(?d)\[.*?\]") >= args.number("num_placeholders", 0)


@register_rule("detectable_content:postscript")
def _postscript(text: Column, args: Args) -> Column:
    default = "P.S."
    return F.contains(text, args.text("postscript_marker", default)) | (
        F.contains(text, F.lit(default)) & args.text("postscript_marker", default).isNotNull()
    )


# --- format -----------------------------------------------------------------


@register_rule("detectable_format:number_bullet_lists")
def _bullets(text: Column, args: Args) -> Column:
    return pattern_count(text, f"(?md)^{WS}*[-*•]{WS}") >= args.number("num_bullets", 0)


@register_rule("detectable_format:constrained_response", reads="stripped")
def _not_blank(text: Column, args: Args) -> Column:
    return args.feature("stripped", text) != ""


@register_rule("detectable_format:number_highlighted_sections")
def _highlights(text: Column, args: Args) -> Column:
    return pattern_count(text, r"\*[^*]+\*") >= args.number("num_highlights", 0)


@register_rule("detectable_format:multiple_sections")
def _sections(text: Column, args: Args) -> Column:
    splitter = args.text("section_spliter", "Section")
    quoted = F.concat(
        F.lit("(?iu)\\Q"),
        F.replace(splitter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
        F.lit(f"\\E[{SPACE}]*\\p{{Nd}}*"),
    )
    headers = pattern_count(text, f"(?md)^#+{WS}")
    found = bound_to(
        F.regexp_count(text, quoted),
        lambda named: F.when(named > 0, named).when(named == 0, headers),
    )
    return found >= args.number("num_sections", 0)


@register_rule("detectable_format:json_format")
def _json(text: Column, args: Args) -> Column:
    block = first_group(text, rf"(?s){FENCE}(?:json)?{WS}*\n(.*?){FENCE}")
    return jsontext.is_json(strip(text)) | jsontext.is_json(strip(block))


@register_rule("detectable_format:title")
def _title(text: Column, args: Args) -> Column:
    return F.rlike(text, F.lit("<<[^>]+>>"))


@register_rule("detectable_format:number_words_in_section", reads="num_words")
def _words_overall(text: Column, args: Args) -> Column:
    return compare(
        args.feature("num_words", text),
        args.text("relation", AT_LEAST),
        args.number("num_words", 0),
        exactly=False,
    )


# --- combination ------------------------------------------------------------


@register_rule("combination:two_responses")
def _two_responses(text: Column, args: Args) -> Column:
    return F.contains(text, F.lit("*" * 6))


@register_rule("combination:repeat_prompt", reads="stripped")
def _repeats_prompt(text: Column, args: Args) -> Column:
    prompt = strip(args.text("prompt_to_repeat", ""))
    return args.is_falsy("prompt_to_repeat") | F.startswith(args.feature("stripped", text), prompt)


# --- start and end ----------------------------------------------------------


@register_rule("startend:end_checker", reads="stripped")
def _ends_with(text: Column, args: Args) -> Column:
    return F.endswith(args.feature("stripped", text), strip(args.text("end_phrase", "")))


@register_rule("startend:quotation", reads="stripped")
def _quoted(text: Column, args: Args) -> Column:
    body = args.feature("stripped", text)
    return F.startswith(body, F.lit('"')) & F.endswith(body, F.lit('"'))


# --- case and punctuation ---------------------------------------------------


@register_rule("change_case:english_capital")
def _all_capital(text: Column, args: Args) -> Column:
    return ~F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsUppercase}]]"))


@register_rule("change_case:english_lowercase")
def _all_lower(text: Column, args: Args) -> Column:
    return ~F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsLowercase}]]"))


@register_rule("punctuation:no_comma")
def _no_comma(text: Column, args: Args) -> Column:
    return ~F.contains(text, F.lit(","))
