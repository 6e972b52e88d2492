"""Joins beyond the plain equality: optional sides, either-key, hierarchy, paths, synonyms.

No hint is given for sides of unknown size: Spark broadcasts a side only after checking its size
(statistics, or the real shuffle size under AQE) and splits skewed partitions of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_tasks


def inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "inner")


def left(left_df: DataFrame, right: DataFrame, on, where: Column | None = None) -> DataFrame:
    """Left join whose right-side condition belongs to ON: it is applied before joining."""
    return left_df.join(right if where is None else right.where(where), on, "left")


def outer(left_df: DataFrame, right: DataFrame, on, how: str = "full") -> DataFrame:
    """Right or full join on shared key names (keys come out coalesced)."""
    return left_df.join(right, on, how)


def nested(left_df: DataFrame, middle: DataFrame, far: DataFrame, on, far_on) -> DataFrame:
    """``left LEFT JOIN (middle JOIN far)``: a middle row counts only when it has a far row."""
    return left_df.join(middle.join(far, far_on, "inner"), on, "left")


def anti(left_df: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows without a partner (NOT EXISTS)."""
    return left_df.join(right, on, "left_anti")


def not_in(left_df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SQL NOT IN: empty when the right side has a null key, and never keeps a null left key.

    Decided from one aggregated value, so it stays an equi-join instead of a null-aware nested loop.
    """
    # Number of rows and of keys on the right: fewer keys than rows means there is a null.
    sizes = right.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys"))).scalar()
    kept = left_df.join(right.select(key), key, "left_anti")
    return kept.where((sizes["rows"] == 0) | ((sizes["rows"] == sizes["keys"]) & F.col(key).isNotNull()))


def semi(left_df: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows with a partner, without fan-out (EXISTS, IN)."""
    return left_df.join(right, on, "left_semi")


def with_parent(
    df: DataFrame, parents: DataFrame, cols: dict[str, str], key: str = "id", parent_key: str = "parent_id", how: str = "left"
) -> DataFrame:
    """Add columns of the parent row: ``{parent column: new name}``. Apply again for grandparents."""
    side = parents.select(F.col(key).alias(parent_key), *[F.col(c).alias(n) for c, n in cols.items()])
    return df.join(side, parent_key, how)


def join_any(left_df: DataFrame, right: DataFrame, key_pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Rows matching on any of several key pairs, each pair of rows once.

    One equi-join per key pair; a later arm leaves out what an earlier arm already matched, so
    no duplicate removal and no nested loop is needed. Column names must differ between the sides.
    """
    arms, seen = [], []
    for mine, theirs in key_pairs:
        pairs = left_df.join(right, F.col(mine) == F.col(theirs), "inner")
        for before in seen:
            pairs = pairs.where(~F.coalesce(before, F.lit(False)))
        arms.append(pairs)
        seen.append(F.col(mine) == F.col(theirs))
    matched = reduce(DataFrame.unionByName, arms)
    if how == "inner":
        return matched
    lonely = left_df
    for mine, theirs in key_pairs:
        lonely = lonely.join(right.select(theirs), F.col(mine) == F.col(theirs), "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def expand_path(df: DataFrame, path: str = "path", into: str = "ancestor_id") -> DataFrame:
    """One row per node listed in a path array, to be equi-joined instead of tested with ANY."""
    return df.withColumn(into, F.explode(path))


def to_preferred(names: DataFrame) -> DataFrame:
    """Every name with the preferred name of its meaning: adds ``preferred_id`` and ``preferred_name``."""
    preferred = names.where(F.col("preferred") == F.lit(True)).groupBy("meaning_id").agg(
        F.min_by(F.struct("id", "name"), "id").alias("_p")
    )
    best = preferred.select("meaning_id", F.col("_p.id").alias("preferred_id"), F.col("_p.name").alias("preferred_name"))
    return names.join(best, "meaning_id", "left")


def expand_synonyms(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """All names sharing a meaning with the wanted names (``id`` column), each once."""
    meanings = names.join(wanted.select("id"), "id", "left_semi").select("meaning_id").distinct()
    return names.join(meanings, "meaning_id", "left_semi")


def replicated(df: DataFrame, copies: int) -> DataFrame:
    """Each row once per salt value 0..copies-1, to be joined with :func:`salted`."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def salted(df: DataFrame, columns: list[str], copies: int) -> DataFrame:
    """Spread the rows of one key over ``copies`` join keys, by content and so repeatably."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(copies)).cast("int"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], copies: int = 16, how: str = "inner") -> DataFrame:
    """Join that splits every key of ``big`` over several tasks, for keys known to be hot."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the right side")
    joined = salted(big, spread_by, copies).join(replicated(small, copies), [*keys, "_salt"], how)
    return joined.drop("_salt")


#: Rows of the lists of :func:`fanned_join`, powers of two: every row of an outer list is followed by the whole inner list.
OUTER, INNER = 64, 256


def fanned_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], copies: int = 16, inner: str = "small") -> DataFrame:
    """Inner join whose result is far larger than both sides: every key of ``big`` is dealt over ``copies`` of as many tasks as a shuffle has.

    Adaptive execution sizes tasks by what they read and would put the whole result into one or two of them. Short lists of rows meet and are
    unfolded in place, so that each row of one side is followed by the same list of the other (``inner``: ``small`` or ``big``): files
    that encode runs and repeats take few bytes a row however many rows a key has. Repeated rows stay; null keys meet nothing.
    """
    tasks, outer = shuffle_tasks(big), "big" if inner == "small" else "small"
    size = {outer: OUTER, inner: INNER}
    named = reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in keys])
    dealt, others = salted(big.where(named), spread_by, copies), replicated(small.where(named), copies)
    both = listed(dealt, keys, size["big"], tasks, "_big").join(listed(others, keys, size["small"], tasks, "_small"), "_unit")
    # coalesce leaves the partitions as they are, but ends the join's generated code, which holds all rows that come of one list at once.
    pairs = both.coalesce(tasks).withColumn(f"_{outer}", F.explode(f"_{outer}")).withColumn(f"_{inner}", F.explode(f"_{inner}"))
    rest = [(side, c) for side, df in (("_big", big), ("_small", small)) for c in df.columns if c not in keys]
    return pairs.select(*[F.col(f"{side}.`{c}`") for side, c in [("_unit", k) for k in keys] + rest])


def listed(df: DataFrame, keys: list[str], size: int, tasks: int, into: str) -> DataFrame:
    """The rows of each key and salt (``_unit``), dealt over the tasks, in lists of at most ``size``. A unit is sorted, never held."""
    # One column is dealt by: of several, Spark would drop those that it knows to be constant and shuffle once more; so it would if only
    # one side's columns could be null, hence when().
    unit = F.struct(*[F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).alias(c) for c in (*keys, "_salt")])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (*keys, "_salt")])
    units = df.select(unit.alias("_unit"), row.alias("_row")).repartition(tasks, "_unit").sortWithinPartitions("_unit")
    at = F.shiftright(F.monotonically_increasing_id(), size.bit_length() - 1)
    return units.withColumn("_list", at).groupBy("_unit", "_list").agg(F.collect_list("_row").alias(into)).drop("_list")
