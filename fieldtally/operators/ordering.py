"""Sort orders with stated null positions, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.text import col, natural_key

__all__ = ["up", "down", "order", "top", "natural_key"]


def up(c: Column | str, nulls: str = "last") -> Column:
    c = col(c)
    return c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first()


def down(c: Column | str, nulls: str = "first") -> Column:
    """Descending; nulls first unless said otherwise, as the source database sorts them."""
    c = col(c)
    return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()


def order(df: DataFrame, *by: Column) -> DataFrame:
    return df.orderBy(*by)


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first ``n`` rows: each task keeps only its own ``n``, no full sort."""
    return df.orderBy(*by).limit(n)
