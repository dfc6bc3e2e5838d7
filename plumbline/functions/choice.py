"""Reading the chosen letter out of a multiple-choice answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import WORD, WS, strip

LETTERS = "ABCDEFGHIJ"


def letter_patterns(num_options: int) -> list[str]:
    """Patterns in order of trust; the first that matches anywhere wins.

    Fixed values: what each pattern accepts decides which letter is read.
    """
    letters = f"([{LETTERS[:num_options]}])"
    return [
        # "the answer is (B", with nothing required after the letter
        rf"(?iumd)(?:the{WS}+)?answer{WS}*(?:is|:){WS}*\(?{letters}\)?",
        # "B." or "B)" at the end of a line
        rf"(?iumd)(?<![{WORD}]){letters}{WS}*[.)]{WS}*$",
        # a line with nothing else
        rf"(?iumd)^{WS}*\(?{letters}\)?{WS}*$",
        # "(B)"
        rf"(?iu)\({letters}\)",
        # the last letter standing alone: a greedy prefix finds it from the end
        rf"(?isu)^.*(?<![{WORD}]){letters}(?![{WORD}])",
    ]


def extract_letter(response: Column, num_options: int = 4) -> Column:
    """Upper-case letter of the answer, NULL when none can be read."""
    text = strip(response)
    found = [
        F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        for pattern in letter_patterns(num_options)
    ]
    return F.upper(F.coalesce(*found))


def choice_matches(letter: Column, expected: Column) -> Column:
    """Letter equality; an unreadable answer is wrong, not unknown."""
    return F.coalesce(F.upper(letter) == F.upper(expected), F.lit(False))
