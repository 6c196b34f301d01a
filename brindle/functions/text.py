"""Text expressions with Unicode white space spelled out (Java's ``\\s`` is ASCII only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, inside a regex class.
WS = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def normal_key(c: Column | str) -> Column:
    """Outer blanks off, lower case, blank becomes null: one spelling for keys typed by hand."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def words(c: Column | str) -> Column:
    """White-space separated words, as an array; empty array for blank text, null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("bigint")


def clean_text(c: Column | str) -> Column:
    """Runs of spaces to one, three or more line ends (with blanks between) to two, lines and ends stripped."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, " +", " ")
    c = F.regexp_replace(c, f"\n[{WS}]*\n[{WS}]*\n+", "\n\n")
    lines = F.transform(F.split(c, "\n"), strip)
    return strip(F.array_join(lines, "\n"))
