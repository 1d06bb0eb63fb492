"""Keep costly expressions from being evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that a later filter refers to by value.

    A filter on a plain computed column is moved below the projection together with a copy of the whole
    expression. A filter on a generator's output is not, so the expression runs once per row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
