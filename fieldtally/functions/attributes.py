"""Attributes stored as JSON text keyed by attribute id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def json_attr(c: Column | str, attr_id: int | str, kind: str = "string") -> Column:
    """One attribute of a JSON document; a value that does not fit ``kind`` is null."""
    raw = F.get_json_object(col(c), f"$['{attr_id}']")
    return raw if kind == "string" else raw.try_cast(kind)


def with_json_attrs(df: DataFrame, c: str, wanted: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Several attributes of a JSON column as columns: ``{new column: (attribute id, type)}``.

    The document is parsed into a column of its own first. Taking fields straight from the parse would
    make the optimizer parse it once per field.
    """
    schema = ", ".join(f"`{attr}` string" for attr in sorted({a for a, _ in wanted.values()}))
    keep = [k for k in df.columns if k != c] if keep is None else keep
    parsed = df.select(*keep, F.from_json(c, schema).alias("_doc"))
    fields = []
    for name, (attr, kind) in wanted.items():
        raw = F.col("_doc").getField(attr)
        fields.append((raw if kind == "string" else raw.try_cast(kind)).alias(name))
    return parsed.select(*keep, *fields)
