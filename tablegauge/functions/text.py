"""Text normalisation: strip, collapse inner whitespace, fold case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"(?U)\s+", " ")


NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"


def parse_number(value: Column) -> Column:
    """Text as a number: sign, decimal digits and exponent only; type suffixes such as ``1D`` or ``2F`` are not numbers."""
    text = F.trim(value)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_whole(value: Column) -> Column:
    """Text as a whole number of 64 bits."""
    text = F.trim(value)
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


# fixed values: letters whose case folding is not their lower case
FOLDED = {"ß": "ss", "ς": "σ", "ſ": "s"}


def fold(value: Column) -> Column:
    """Case-insensitive matching key."""
    out = F.lower(collapse(value))
    for letter, folded in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out
