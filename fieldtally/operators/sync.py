"""Bringing a stored table in line with a freshly computed one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(columns: list[str], new: str = "new", old: str = "old") -> Column:
    """Some column changed, a null counting as a value of its own."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))
    return out


def sync_set(desired: DataFrame, stored: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """What has to happen to ``stored``: ``change`` is I(nsert), U(pdate), D(elete) or S(ame).

    The payload shown is the new one, or the stored one for deletions.
    """
    on = [F.col(f"new.{k}") == F.col(f"old.{k}") for k in keys]
    new = desired.select(*keys, *payload, F.lit(True).alias("_is")).alias("new")
    old = stored.select(*keys, *payload, F.lit(True).alias("_is")).alias("old")
    change = (
        F.when(F.col("old._is").isNull(), "I")
        .when(F.col("new._is").isNull(), "D")
        .when(differs(payload), "U")
        .otherwise("S")
    )
    gone = F.col("new._is").isNull()
    return new.join(old, on, "full").select(
        *[F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys],
        *[F.when(gone, F.col(f"old.{p}")).otherwise(F.col(f"new.{p}")).alias(p) for p in payload],
        change.alias("change"),
    )


def merge_awards(current: DataFrame, build: DataFrame, as_of) -> DataFrame:
    """Award table after a run: an award once given stays, its first date stays, the figures are renewed.

    Keys are ``user_id`` and ``badge``. ``updated_on`` moves only when a shown column or the award changed.
    Rows of ``current`` the run did not compute are kept as they are.
    """
    now = F.lit(as_of).cast("timestamp")
    shown = ["description", "metric", "metric_meaning", "icon"]
    on = (F.col("old.user_id") == F.col("new.user_id")) & (F.col("old.badge") == F.col("new.badge"))
    both = current.alias("old").join(build.alias("new"), on, "full")
    fresh, kept = F.col("old.user_id").isNull(), F.col("new.user_id").isNull()
    awarded = F.coalesce(F.col("old.awarded"), F.lit(False)) | F.coalesce(F.col("new.awarded"), F.lit(False))
    changed = ~kept & (fresh | differs(shown) | (awarded != F.coalesce(F.col("old.awarded"), F.lit(False))))
    return both.select(
        F.coalesce("old.user_id", "new.user_id").alias("user_id"),
        F.coalesce("old.badge", "new.badge").alias("badge"),
        *[F.when(kept, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in shown],
        awarded.alias("awarded"),
        F.when(awarded, F.coalesce(F.col("old.awarded_on"), now)).alias("awarded_on"),
        F.when(changed, now).otherwise(F.col("old.updated_on")).alias("updated_on"),
    )


def rebuild(df: DataFrame, name: str, version: str, folder: str) -> DataFrame:
    """Write a new version of a derived table beside the old ones, then let the view ``name`` show it.

    Readers see either the old or the new version; earlier versions stay until they are removed.
    ``folder`` is shared storage.
    """
    if not re.fullmatch(r"\w+", version):
        raise ValueError("version may hold letters, digits and underscores only")
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}/{version}"
    df.write.mode("overwrite").parquet(path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    return spark.table(name)
