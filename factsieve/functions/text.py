"""String expressions shared by the operators. All of them stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# One explicit whitespace set for every operator: space, tab, newline, CR, FF, VT.
WHITESPACE = " \t\n\r\f\x0b"
WHITESPACE_CLASS = r"[ \t\n\r\f\x0B]+"
WORD_CLASS = r"[^ \t\n\r\f\x0B]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def answer_matches(answer: Column, expected: Column) -> Column:
    """Case-insensitive containment of the stripped expected text in the stripped answer."""
    return F.contains(F.lower(strip(answer)), F.lower(strip(expected)))


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, WORD_CLASS, 0)


def fill(template: str, **slots: Column) -> Column:
    """Fill a template in one pass: the slot values themselves are never re-scanned."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        slots[piece] if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pick(key: Column, branches: dict[str, Column]) -> Column:
    """CASE key WHEN name THEN branch ...; null for a key without a branch."""
    out = None
    for name, branch in branches.items():
        out = F.when(key == name, branch) if out is None else out.when(key == name, branch)
    return out if out is not None else F.lit(None).cast("string")


def percent(c: Column) -> Column:
    """One decimal, half-even on the exact binary value; 'n/a' for null."""
    return F.coalesce(
        F.concat(F.call_function("format_number", c * 100, F.lit("0.0")), F.lit("%")), F.lit("n/a")
    )


def two_decimals(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.00"))
