"""Text helpers whose results follow the log formats' Unicode rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when logs are stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The line breaks of a transcript, "\r\n" counting once.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Cut white space from both ends (all of Unicode's, not only blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def not_blank(text: Column) -> Column:
    """True where the text holds something other than white space; null counts as blank."""
    return F.coalesce(F.length(F.ltrim(text, F.lit(WHITESPACE))) > 0, F.lit(False))


def nullif_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def pattern(regex: str, ignore_case: bool = True) -> str:
    """A regex with Unicode classes and boundaries, where only a newline ends a line."""
    return ("(?diU)" if ignore_case else "(?dU)") + regex


def matches(text: Column, regex: str, ignore_case: bool = True) -> Column:
    return F.coalesce(text.rlike(pattern(regex, ignore_case)), F.lit(False))


def contains_any(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return F.coalesce(hit, F.lit(False))


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """Map ``key`` through a small literal table."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def occurrences(text: Column, needle: str) -> Column:
    """How often ``needle`` occurs, counting without overlap."""
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(needle)).cast("int")


def shorten(text: Column, limit: int, marker: str = "...[truncated]") -> Column:
    """The first ``limit`` characters, with a marker when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)
