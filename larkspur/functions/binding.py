"""Computing an expensive expression once.

The optimiser copies the expression behind a column to wherever the column is
used, filters included. Higher-order functions are not shared between the
copies, so what is used several times is bound here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once within an expression."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with new columns that are computed once, whatever reads them: they come out of a generator of one row, which nothing is pushed through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
