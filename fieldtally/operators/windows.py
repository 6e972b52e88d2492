"""First row per key, ranks, runs and scaling.

Windows over raw rows would put a hot key into one task, so these aggregate first or spread the
sort; the only windows left see one row per period, per week of a user, or per sort partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import col
from ..session import settle


def _picked(df: DataFrame, keys: list[str], pick, order: list[Column | str]) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.distinct()
    best = df.groupBy(*keys).agg(pick(F.struct(*payload), F.struct(*[col(o) for o in order])).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in payload])


def latest_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the greatest ``order`` per key. An aggregate: combined before the shuffle.

    Add a unique column last in ``order`` to make ties repeatable. Nulls order lowest.
    """
    return _picked(df, keys, F.max_by, order)


def earliest_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the least ``order`` per key; nulls order last."""
    nulls_last = []
    for o in order:
        nulls_last += [col(o).isNull(), col(o)]
    return _picked(df, keys, F.min_by, nulls_last)


def position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Row number over the whole frame without putting it into one task.

    The frame is range-sorted, each row gets its number within its sort partition, and the sizes of
    the partitions before it are added (one row per partition, so their window is small). The
    sorted rows are written once, because both the sizes and the result must see the same ranges.
    Make ``order`` unique to get a repeatable order of ties, which also splits a hot tie.
    """
    rows = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_before") + within + 1).cast("long"))
        .drop("_part", "_at", "_before")
    )


def rank_of(df: DataFrame, measure: str, name: str = "rank") -> DataFrame:
    """``rank()`` by a measure, greatest first: ties share the position of their first row.

    Ranks are worked out on one row per distinct measure value and joined back.
    """
    sizes = df.groupBy(measure).agg(F.count(F.lit(1)).alias("_n"))
    rows = settle(sizes.orderBy(F.col(measure).desc()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    in_part = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(part.alias("_part"))
        .agg(F.sum("_n").alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    ranks = (
        rows.withColumn("_part", part)
        .withColumn("_here", F.coalesce(F.sum("_n").over(in_part), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .select(measure, (F.col("_before") + F.col("_here") + 1).cast("long").alias(name))
    )
    return df.join(ranks, measure)


def running_total(df: DataFrame, order: str, value: Column | str, name: str) -> DataFrame:
    """Cumulative sum. The input has one row per period, so the single window partition is short."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(col(value)).over(w))


def longest_run(df: DataFrame, user: str, day: Column | str, name: str = "weeks_in_a_row") -> DataFrame:
    """Longest run of consecutive active weeks per user.

    Rows are reduced to distinct (user, week) first, so a window partition holds at most one row
    per calendar week whatever a user's activity.
    """
    weeks = df.select(user, dates.week_start(day).alias("_week")).where(F.col("_week").isNotNull()).distinct()
    n = F.row_number().over(Window.partitionBy(user).orderBy("_week"))
    runs = weeks.withColumn("_run", F.date_sub("_week", n * 7)).groupBy(user, "_run").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(user).agg(F.max("_n").alias(name))


def minmax_scale(df: DataFrame, measure: str, name: str = "scaled", flat: float | None = None) -> DataFrame:
    """Measure mapped to 0..1 between its least and greatest value; ``flat`` when they are equal."""
    ends = df.agg(F.struct(F.min(measure).alias("lo"), F.max(measure).alias("hi"))).scalar()
    share = (F.col(measure) - ends["lo"]) / F.nullif(ends["hi"] - ends["lo"], F.lit(0))
    return df.withColumn(name, F.when(ends["hi"] == ends["lo"], F.lit(flat)).otherwise(share))


def top_n_other(df: DataFrame, key: str, by: str, measures: list[str], n: int = 6, other: str = "Other") -> DataFrame:
    """Keep the first ``n`` keys by a measure and fold the rest into one row.

    Folding happens only when more than ``n + 1`` keys exist. ``df`` has one row per key; it is
    written once because it is read for the head and for the fold.
    """
    base = settle(df)
    head = base.orderBy(F.col(by).desc(), F.col(key)).limit(n + 2)
    # At most n + 2 rows from here on.
    numbered = head.select(
        key,
        F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(key))).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_found"),
    )
    kept = numbered.where((F.col("_rank") <= n) | (F.col("_found") <= n + 1)).select(key, F.lit(True).alias("_kept"))
    labelled = base.join(F.broadcast(kept), key, "left").withColumn(
        key, F.when(F.col("_kept"), F.col(key)).otherwise(F.lit(other))
    )
    return labelled.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])
