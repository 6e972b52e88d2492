"""Exports: Parquet, CSV, JSON lines, GeoJSON features. Every task writes its own part file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def as_document(df: DataFrame, name: str = "doc") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def as_features(df: DataFrame, wkt: str) -> DataFrame:
    """Each row as one GeoJSON feature text (a line of a GeoJSON sequence)."""
    rest = [c for c in df.columns if c != wkt]
    geometry = F.coalesce(geo.parts_geojson(wkt), F.lit("null"))
    body = F.concat(
        F.lit('{"type":"Feature","geometry":'),
        geometry,
        F.lit(',"properties":'),
        F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}),
        F.lit("}"),
    )
    return df.select(body.alias("value"))


def export(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None, wkt: str | None = None) -> None:
    """Write a result. ``geojson`` writes one feature per line; ``csv`` has a header in every part."""
    if fmt == "geojson":
        if not wkt:
            raise ValueError("geojson needs the geometry column")
        as_features(df, wkt).write.mode("overwrite").text(path)
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
