"""Rows made from ranges and from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

PERIODS = "array<struct<period:string,summary:string,estimate:string>>"


def series(df: DataFrame, start: Column, stop: Column, name: str, step: Column | None = None) -> DataFrame:
    """One row per value of a range computed from each row."""
    values = F.sequence(start, stop) if step is None else F.sequence(start, stop, step)
    return df.withColumn(name, F.explode(values))


def explode_periods(df: DataFrame, doc: str = "summarised_data") -> DataFrame:
    """Rows of a weekly series kept as a JSON array; the text NULL stands for no count."""
    item = F.explode(F.from_json(col(doc), PERIODS)).alias("_p")
    rest = [c for c in df.columns if c != doc]
    return df.select(*rest, item).select(
        *rest,
        F.col("_p.period").cast("int").alias("period"),
        F.when(F.col("_p.summary") != "NULL", F.col("_p.summary")).try_cast("double").alias("summary"),
        F.col("_p.estimate").try_cast("double").alias("estimate"),
    )
