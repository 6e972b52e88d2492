"""Entity-attribute-value rows: pivots, decoding, maps and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .aggregate import join_text, paged


def pivot_attrs(
    values: DataFrame,
    entity: str | list[str],
    wanted: dict[object, tuple[str, str]],
    attr: str = "attribute_id",
    many: dict[object, tuple[str, str]] | None = None,
    sep: str = "; ",
) -> DataFrame:
    """Attribute rows to columns with one grouping, whatever the number of attributes.

    ``wanted`` maps an attribute id to (new column, value column) for single values; of several,
    the greatest is taken. ``many`` does the same for multi-valued ones, joined as sorted text.
    """
    many = many or {}
    keys = [entity] if isinstance(entity, str) else entity
    ids = [*wanted, *many]
    picked = values.where(F.col(attr).isin(ids))
    aggs = [F.max(F.when(F.col(attr) == F.lit(i), F.col(v))).alias(n) for i, (n, v) in wanted.items()]
    aggs += [join_text(F.when(F.col(attr) == F.lit(i), F.col(v)), sep).alias(n) for i, (n, v) in many.items()]
    return picked.groupBy(*keys).agg(*aggs)


def with_attrs(entities: DataFrame, values: DataFrame, key: str, wanted: dict, **options) -> DataFrame:
    """Entities with their pivoted attributes; entities without any are kept."""
    return entities.join(pivot_attrs(values, key, wanted, **options), key, "left")


def unpivot(df: DataFrame, keys: list[str], columns: dict[str, object], attr: str = "attribute_id", value: str = "value") -> DataFrame:
    """Columns to attribute rows (one scan): ``{column: attribute id}``; nulls give no row."""
    items = F.array(*[F.struct(F.lit(i).alias(attr), F.col(c).cast("double").alias(value)) for c, i in columns.items()])
    return df.select(*keys, F.inline(items)).where(F.col(value).isNotNull())


def decode(df: DataFrame, column: str, terms: DataFrame, into: str, term_id: str = "term_id", term: str = "term") -> DataFrame:
    """Add the term a stored id stands for; unknown ids give null."""
    side = terms.select(F.col(term_id).alias(column), F.col(term).alias(into))
    return df.join(side, column, "left")


def attrs_map(values: DataFrame, entity: str, caption: Column | str, value: Column | str) -> DataFrame:
    """One map per entity: caption -> value; of several values under one caption the greatest."""
    flat = values.groupBy(entity, col(caption).alias("_k")).agg(F.max(col(value)).alias("_v"))
    return flat.groupBy(entity).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias("attrs")
    )


def attrs_list(entities: DataFrame, values: DataFrame, entity: str, fields: list[str], size: int = 10000) -> DataFrame:
    """Entities with all their attributes as an array of structs; an empty array when they have none.

    ``size`` different attributes, in their order, are a page; every entity has a row for each of its pages.
    """
    different = values.select(entity, *fields).distinct()
    pages = paged(different, [entity], list(fields), size)
    lists = pages.groupBy(entity, "page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("attrs"))
    kind = dict(lists.dtypes)["attrs"]
    out = entities.join(lists, entity, "left").withColumn("attrs", F.coalesce("attrs", F.array().cast(kind)))
    return out.withColumn("page", F.coalesce("page", F.lit(0)))
