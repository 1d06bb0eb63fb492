"""Small builders of Spark SQL expression text.

Wide projections are written as SQL text: one parsed string costs far less to build than hundreds of
Column calls, and reads like the query it is.
"""

from __future__ import annotations

from faultline.functions.text import WHITESPACE


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern literal with Unicode classes and boundaries, where only a newline ends a line."""
    return "r'" + ("(?diU)" if ignore_case else "(?dU)") + pattern + "'"


def strip(text: str) -> str:
    """Cut all Unicode white space from both ends."""
    blanks = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"btrim({text}, '{blanks}')"


def matches(text: str, pattern: str) -> str:
    return f"coalesce({text} RLIKE {regex(pattern)}, false)"


def array_of(values: list[str]) -> str:
    return "array(" + ", ".join(quoted(v) for v in values) + ")"
