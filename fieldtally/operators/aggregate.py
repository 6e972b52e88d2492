"""Groupings: keyed measures, conditional counts, text lists, totals, shares, panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .windows import position


def summarise(df: DataFrame, keys: list[Column | str], **measures: Column) -> DataFrame:
    """Group by the key columns and compute the named measures.

    Distinct counts are planned by Spark as partial counts per (key, value), so a key holding a
    third of all rows is spread over its values before it is counted.
    """
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def distinct_if(condition: Column, value: Column | str) -> Column:
    """Distinct values among the rows where the condition holds."""
    return F.countDistinct(F.when(condition, col(value)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column | str, otherwise=0) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(otherwise)))


def capped(measure: Column, cap) -> Column:
    return F.least(F.lit(cap), measure)


def exact_sum(c: Column | str) -> Column:
    """Sum through decimals of 15 places, 23 digits before them: the same result whatever the order of the rows."""
    return F.sum(col(c).cast("decimal(38,15)")).cast("double")


def exact_avg(c: Column | str) -> Column:
    """Average from an exact sum."""
    return exact_sum(c) / F.count(col(c))


def join_text(c: Column | str, sep: str = ", ") -> Column:
    """Distinct non-null values as one text in sorted order; null when there are none.

    The list grows with the distinct values of a group: meant for decoded terms, names and dates.
    For lists without such a bound see :func:`paged_text`.
    """
    values = F.array_sort(F.collect_set(col(c).cast("string")))
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def join_text_by(c: Column | str, order: Column | str, sep: str = ",") -> Column:
    """All values as one text, ordered by another column."""
    items = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(c).cast("string").alias("v"))))
    return F.array_join(F.transform(items, lambda p: p["v"]), sep)


def having(df: DataFrame, keys: list, condition: Column, **measures: Column) -> DataFrame:
    return summarise(df, keys, **measures).where(condition)


def panel(**figures: DataFrame) -> DataFrame:
    """One row of independent totals, each from a one-row, one-column frame, as scalar subqueries."""
    spark = next(iter(figures.values())).sparkSession
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in figures.items()])


def panel_rows(**figures: DataFrame) -> DataFrame:
    """The same totals as rows (``item``, ``value``) in the given order."""
    rows = [
        df.toDF("value").select(F.lit(i).alias("position"), F.lit(name).alias("item"), F.col("value").cast("long").alias("value"))
        for i, (name, df) in enumerate(figures.items(), 1)
    ]
    return reduce(DataFrame.unionByName, rows)


def pct(part: Column, total: Column, mode: str = "floor") -> Column:
    """Whole per cent of a total: ``floor`` (integer division) or ``round``; null for an empty total."""
    share = part * 100 / F.nullif(total, F.lit(0))
    return (F.floor(share) if mode == "floor" else F.round(share)).cast("long")


def with_total(df: DataFrame, key: Column | str, label: str = "Total", **measures: Column) -> DataFrame:
    """Breakdown by one key plus a grand total row, in one pass.

    Distinct counts of the total are counted over all rows, not added up.
    """
    named = df.withColumn("_key", col(key).cast("string"))
    out = named.rollup("_key").agg(F.grouping("_key").alias("is_total"), *[m.alias(n) for n, m in measures.items()])
    return out.withColumn("label", F.when(F.col("is_total") == 1, label).otherwise(F.col("_key"))).select(
        "label", "is_total", *measures
    )


def two_stage(df: DataFrame, keys: list, measures: dict[str, Column], outer_keys: list, outer: dict[str, Column]) -> DataFrame:
    """Aggregate per fine key, then aggregate those rows per coarse key."""
    return summarise(summarise(df, keys, **measures), outer_keys, **outer)


def paged(df: DataFrame, keys: list[str], by: Column | str | list, size: int) -> DataFrame:
    """Rows with the ``page`` of their group: ``size`` rows in the order of ``by`` are a page, for every group alike.

    Pages are ready to be collected per (keys, page): a group holding a third of all rows becomes many small
    groups on many tasks and no row is dropped, and a row keeps its page when rows are added behind it. Numbers within
    the groups come from a range sort over all rows (``windows.position``), never from one task for a group. Make
    ``by`` unique within a group for pages that can be repeated. Null keys are a group.
    """
    order = [col(c) for c in (by if isinstance(by, list) else [by])]
    named = df.withColumns({f"_by{i}": c for i, c in enumerate(order)})
    placed = position(named, [*[F.col(k) for k in keys], *[F.col(f"_by{i}") for i in range(len(order))]], "_at_row")
    first = placed.groupBy(*keys).agg(F.min("_at_row").alias("_first")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    out = placed.join(first, same).withColumn("page", F.floor((F.col("_at_row") - F.col("_first")) / size).cast("long"))
    out = out.select(*df.columns, "page")
    return out.repartition(*[F.col(k) for k in keys], F.col("page"))


def paged_text(df: DataFrame, key: str, value: str, into: str, sep: str = ",", size: int = 10000) -> DataFrame:
    """Distinct values per key as sorted text, ``size`` of them to a page."""
    values = df.select(key, F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    pages = paged(values, [key], "_v", size)
    return pages.groupBy(key, "page").agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(into))
