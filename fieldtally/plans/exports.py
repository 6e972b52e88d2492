"""Listings and downloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.attributes import with_json_attrs
from ..functions.geo_arrow import parts_to_grid
from ..operators import filters
from ..operators.aggregate import join_text_by, paged, paged_text
from ..operators.attributes import attrs_list, decode, pivot_attrs
from ..operators.generators import explode_periods
from ..sources.cursor import read_since


def filtered_listing(
    rows: DataFrame,
    options: list[tuple[object, object]] = (),
    tenants: DataFrame | None = None,
    agreements: DataFrame | None = None,
    lookups: list[tuple[DataFrame, object, str]] = (),
    terms: dict[str, tuple[DataFrame, str]] | None = None,
    flags: dict[str, Column] | None = None,
    columns: list[str] | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """The shared shape of plain lists and downloads.

    ``options``: (value or blank, value -> predicate), applied when given. ``lookups``: (frame, on, how).
    ``terms``: {id column: (terms frame, new column)}. ``flags``: computed columns, after the lookups.
    Filters run before the joins; ``order`` is a distributed range sort.
    """
    out = rows
    for value, predicate in options:
        out = filters.opt(out, filters.none_if(value), predicate)
    if tenants is not None:
        out = filters.visible(out, tenants, agreements)
    for frame, on, how in lookups:
        out = out.join(frame, on, how)
    for column, (frame, into) in (terms or {}).items():
        out = decode(out, column, frame, into)
    for name, value in (flags or {}).items():
        out = out.withColumn(name, value)
    if columns:
        out = out.select(*columns)
    return out.orderBy(*order) if order else out


def attribute_pivot_export(entities: DataFrame, values: DataFrame, key: str, wanted: dict, terms: DataFrame | None = None, decoded: dict[str, str] | None = None, **options) -> DataFrame:
    """Entities with n attributes as columns; ``decoded`` names pivoted id columns to show as terms."""
    out = entities.join(pivot_attrs(values, key, wanted, **options), key, "left")
    for column, into in (decoded or {}).items():
        out = decode(out, column, terms, into).drop(column)
    return out


def json_attribute_export(rows: DataFrame, doc: str, wanted: dict[str, tuple[str, str]], defaults: dict | None = None) -> DataFrame:
    """Rows with attributes of a JSON column as typed columns, parsed once. Values that do not fit are null, or the default."""
    out = with_json_attrs(rows, doc, wanted)
    return out.fillna(defaults) if defaults else out


def attributes_as_list(entities: DataFrame, values: DataFrame, key: str, fields: list[str], page_size: int = 10000) -> DataFrame:
    """Entities with all attributes as an array of structs; an empty array when there are none."""
    return attrs_list(entities, values, key, fields, page_size)


def visit_documents(visits: DataFrame, records: DataFrame, fields: list[str], page_size: int = 10000) -> DataFrame:
    """One JSON document per visit with its records nested inside; visits without records get an empty array.

    ``page_size`` records in their order are a document, numbered by ``page``, for every visit alike, so
    that no document has to be put together from an unbounded group. Records are read once.
    """
    pages = paged(records.select("visit_id", "record_id", *fields), ["visit_id"], ["record_id", *fields], page_size)
    # Sorting by the fields as well makes equal ids repeatable.
    items = F.sort_array(F.collect_list(F.struct("record_id", *fields)))
    nested = pages.groupBy("visit_id", "page").agg(items.alias("records"))
    kind = dict(nested.dtypes)["records"]
    out = visits.join(nested, "visit_id", "left").withColumn("records", F.coalesce("records", F.array().cast(kind)))
    body = F.to_json(F.struct(*visits.columns, "records"))
    return out.select("visit_id", F.coalesce("page", F.lit(0)).alias("page"), F.size("records").alias("n_records"), body.alias("doc"))


def explode_weekly_estimates(series: DataFrame, doc: str = "summarised_data") -> DataFrame:
    """Week, count and estimate rows from a JSON array per site, taxon and year."""
    return explode_periods(series, doc)


def year_index(index: DataFrame, names: DataFrame, language: str) -> DataFrame:
    """Yearly index values with the common names of one language, in the order of their ids.

    ``index``: place_id, taxon_id, year, value. ``names``: name_id, taxon_id, name, language, preferred.
    """
    common = (
        names.where((F.col("language") == language) & (F.col("preferred") == F.lit(False)))
        .groupBy("taxon_id")
        .agg(join_text_by("name", "name_id").alias("common_names"))
    )
    main = names.where(F.col("preferred") == F.lit(True)).select("taxon_id", F.col("name").alias("preferred_name"))
    return index.join(main, "taxon_id").join(common, "taxon_id", "left").select(
        "place_id", "taxon_id", "year", "value", F.coalesce("common_names", "preferred_name").alias("common"), "preferred_name"
    )


def gis_export(rows: DataFrame, wkt: str = "geom", kind: str | None = None, places: int = 6, geojson: bool = False) -> DataFrame:
    """Rows with a Web Mercator geometry in degrees: as WKT (or GeoJSON) text, its type, centre and length.

    ``kind`` keeps only ``point``, ``line`` or ``polygon`` geometries. Every vertex is reprojected, so that lines,
    polygons with holes and MULTI forms come out whole; ``length_m`` is measured in the national grid.
    """
    tests = {"point": geo.is_point, "line": geo.is_line, "polygon": geo.is_polygon}
    chosen = filters.opt(rows, kind, lambda k: tests[k](wkt))
    out = chosen.withColumn("geom_type", geo.geom_type(wkt)).withColumn("_g", geo.parts(wkt))
    out = out.withColumn("length_m", geo.length(geo.edges(parts_to_grid("_g"))))
    out = out.withColumn("_d", geo.reproject_parts("_g", geo.mercator_to_lonlat))
    text = geo.geojson_text(F.col("_d"), F.col("geom_type"), places) if geojson else geo.parts_wkt("_d", F.col("geom_type"), places)
    out = out.withColumn(wkt, text).withColumn("_at", geo.bound(geo.centroid("_g"), lambda c: geo.mercator_to_lonlat(c["x"], c["y"])))
    return out.withColumn("lat", F.round("_at.y", places)).withColumn("lon", F.round("_at.x", places)).drop("_at", "_g", "_d")


def media_list(levels: list[tuple[str, DataFrame]], base_url: str = "") -> DataFrame:
    """Media of several levels (place, visit, record) below each other, with one set of columns."""
    frames = [df.withColumn("level", F.lit(level)) for level, df in levels]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.withColumn("url", F.concat(F.lit(base_url), F.col("path")))


def media_per_visit(visits: DataFrame, visit_media: DataFrame, record_media: DataFrame, page_size: int = 10000) -> DataFrame:
    """Visits with their own and their records' media as text, each list aggregated before joining.

    Pre-aggregating keeps two one-to-many sides from multiplying each other. ``page_size`` media of either kind, in
    their order, are a page; every visit has a row for each of its pages.
    """
    own = paged_text(visit_media, "visit_id", "path", "visit_media", size=page_size)
    theirs = paged_text(record_media, "visit_id", "path", "record_media", size=page_size)
    both = own.join(theirs, ["visit_id", "page"], "full")
    return visits.join(both, "visit_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def workflow_status(visits: DataFrame, records: DataFrame) -> DataFrame:
    """Derived laboratory status of a visit from which results are present.

    ``visits``: visit_id, stage, sugar_result. ``records``: visit_id, taxon_group. Honey analysis is done when
    a sugar result is present, DNA analysis when the visit has a record outside the ``honey`` group.
    """
    per = records.groupBy("visit_id").agg(F.max(F.col("taxon_group") != "honey").alias("dna_done"))
    out = visits.join(per, "visit_id", "left")
    sugar, any_record = F.col("sugar_result").isNotNull(), F.col("dna_done").isNotNull()
    status = (
        F.when(~sugar & ~any_record & F.col("stage").isin("Sample received", "Pack requested"), F.col("stage"))
        .when(sugar & ~any_record, "Sugar results added")
        .when(sugar & any_record, "Species results added")
    )
    return out.select(
        "visit_id", "stage", sugar.alias("honey_done"), F.coalesce("dna_done", F.lit(False)).alias("dna_done"), status.alias("proposed")
    )


def cursor_feed(rows: DataFrame, cursor: str, value, inclusive: bool = False, order: bool = True) -> DataFrame:
    """Rows past a stored mark in cursor order; feed the greatest cursor back as the next mark."""
    out = read_since(rows, cursor, value, inclusive)
    return out.orderBy(cursor) if order else out


def users_since(records: DataFrame, cursor: str, value) -> DataFrame:
    """Users with records past the mark, and their latest record."""
    return read_since(records, cursor, value).groupBy("user_id").agg(F.max(cursor).alias("max_id"))
