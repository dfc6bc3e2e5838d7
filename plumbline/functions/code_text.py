"""Code, commands and patches inside response texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import FENCE, WS, first_group, strip

# Fence tags and line starts that mark commands and patches.
_COMMAND_BLOCK = rf"(?s){FENCE}(?:bash|sh)?{WS}*\n(.*?){FENCE}"
_PATCH_BLOCK = rf"(?s){FENCE}(?:diff|patch)?{WS}*\n(.*?){FENCE}"
_PATCH_LINE = r"^(?:\+|-|@@|diff )"
_FEWEST_PATCH_LINES = 3

# White space other than a line feed, as members of a character class.
_BLANK = r"\t\x0b\x0c\r\x1c-\x1f\x85\p{Z}"


def clean_completion(response: Column) -> Column:
    """Strip; if the text opens with a fence, drop that line and a closing one."""
    body = strip(response)
    opened = F.regexp_replace(body, r"^[^\n]*(?:\n|\z)", "")
    closed = F.regexp_replace(opened, rf"(?:\n|^)[{_BLANK}]*{FENCE}[{_BLANK}]*\z", "")
    return F.when(F.startswith(body, F.lit(FENCE)), closed).otherwise(body)


def assemble_program(stub: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """Runnable text; a completion that is a whole function replaces the stub."""
    head = F.when(F.startswith(completion, F.lit("def ")), F.lit("")).otherwise(stub)
    return F.concat(
        head, completion, F.lit("\n"), test, F.lit("\ncheck("), entry_point, F.lit(")\n")
    )


def extract_command(response: Column) -> Column:
    """First shell block, else the first ``$ `` line, else NULL."""
    block = strip(first_group(response, _COMMAND_BLOCK))
    lines = F.transform(F.split(response, "\n"), strip)
    prompts = F.filter(lines, lambda line: F.startswith(line, F.lit("$ ")))
    return F.coalesce(block, F.substring(F.get(prompts, F.lit(0)), 3, 2**31 - 1))


def extract_patch(response: Column) -> Column:
    """First diff block, else the diff-like lines when there are enough, else NULL."""
    block = strip(first_group(response, _PATCH_BLOCK))
    lines = F.filter(F.split(response, "\n"), lambda line: F.rlike(line, F.lit(_PATCH_LINE)))
    loose = F.when(F.size(lines) >= _FEWEST_PATCH_LINES, F.array_join(lines, "\n"))
    return F.coalesce(block, loose)
