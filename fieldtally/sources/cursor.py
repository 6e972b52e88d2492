"""Incremental reads by a stored mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_since(df: DataFrame, cursor: str, value, inclusive: bool = False) -> DataFrame:
    """Rows past the mark. The comparison is with a literal, so it prunes files and row groups."""
    mark = F.lit(value)
    return df.where(F.col(cursor) >= mark if inclusive else F.col(cursor) > mark)


def high_water(df: DataFrame, cursor: str, value=None):
    """The next mark: the greatest cursor among the rows, or the old one when there are none."""
    top = df.agg(F.max(cursor)).first()[0]
    return value if top is None else top
