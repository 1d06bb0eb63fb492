"""Array helpers that stay linear (or n log n) in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is evaluated once.

    A column named inside a lambda may be replaced by its expression and would then run once per
    element; the variable of a one-element array cannot.
    """
    return F.get(F.transform(F.array(value), use), 0)


def group_starts(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Positions where a new key begins in a sorted array (a bound variable), followed by its size."""
    return F.filter(
        F.sequence(F.lit(0), F.size(ordered)),
        lambda i: (i == 0) | (i == F.size(ordered)) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))),
    )


def groups(ordered: Column, starts: Column) -> Column:
    """Cut a sorted array at its ``group_starts``."""
    return F.transform(
        F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
        lambda start, j: F.slice(ordered, start + 1, F.get(starts, j + 1) - start),
    )
