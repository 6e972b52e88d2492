"""Jobs about places and maps.

Positions are reduced to distinct coordinates before a spatial join, and results are joined back
by coordinate, so that a spot holding a third of all records is tested once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.geo_arrow import parts_to_grid
from ..functions.text import natural_key
from ..operators import cells, filters, overlay, spatial
from ..operators.aggregate import join_text, paged
from ..operators.joins import with_parent
from ..operators.windows import minmax_scale
from ..session import settle


def site_summary_by_key(places: DataFrame, visits: DataFrame, records: DataFrame) -> DataFrame:
    """Every place with its records, visits and species, through visits at the place or at its child places.

    ``places``: place_id, parent_id, place_name. ``visits``: visit_id, place_id. ``records``: visit_id, taxon_id.
    Places without records are kept with zeros. Records shrink to (visit, taxon) and then to (site, taxon).
    """
    site = F.coalesce("parent_id", "place_id").alias("site_id")
    at = visits.join(places.select("place_id", site), "place_id").select("visit_id", "site_id")
    n_visits = at.groupBy("site_id").agg(F.count(F.lit(1)).alias("visits"))
    per = (
        records.select("visit_id", "taxon_id")
        .join(at, "visit_id")
        .groupBy("site_id", "taxon_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("site_id")
        .agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("species"))
    )
    tops = places.where(F.col("parent_id").isNull()).select(F.col("place_id").alias("site_id"), "place_name")
    out = tops.join(n_visits, "site_id", "left").join(per, "site_id", "left")
    return out.fillna(0, ["visits", "records", "species"])


def site_report(visits: DataFrame) -> DataFrame:
    """Per place: visits, years with a visit, first and last year. ``visits``: place_id, date_start."""
    per = visits.groupBy("place_id", F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("place_id").agg(
        F.sum("n").alias("visits"),
        F.count("year").alias("years"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def region_tagging(positions: DataFrame, regions: DataFrame, boundary: bool = True) -> DataFrame:
    """Distinct positions (``x``, ``y``) with the ids of all regions they lie in, as a sorted array.

    ``regions``: region_id, edges, box (see ``spatial.shapes``). Positions in no region get an empty
    array. The array is as long as regions overlap at one point.
    """
    spots = positions.select("x", "y").distinct()
    found = spatial.tag_points(spots, regions.select("region_id", "edges", "box"), boundary=boundary, keep_outside=True)
    # Null region ids, of spots outside, are not collected.
    return found.groupBy("x", "y").agg(F.array_sort(F.collect_set("region_id")).alias("region_ids"))


def site_summary_by_geometry(records: DataFrame, regions: DataFrame, status: str = "V") -> DataFrame:
    """Per region: records and species, all and verified, by where the record lies.

    ``records``: x, y, taxon_id, record_status. ``regions`` may carry further columns, which are kept;
    regions without records are kept with zeros. Records shrink to one row per (spot, taxon).
    """
    ok = F.col("record_status") == status
    per_spot = records.groupBy("x", "y", "taxon_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_ok")
    )
    # Written once, as the spots to be tagged come from it too: records are read once.
    per_spot = settle(per_spot)
    tags = spatial.tag_points(per_spot.select("x", "y").distinct(), regions.select("region_id", "edges", "box"))
    per = (
        per_spot.join(tags, ["x", "y"])
        .groupBy("region_id", "taxon_id")
        .agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"))
        .groupBy("region_id")
        .agg(
            F.sum("n").alias("records"),
            F.count(F.lit(1)).alias("species"),
            F.sum("n_ok").alias("records_verified"),
            F.count(F.when(F.col("n_ok") > 0, 1)).alias("species_verified"),
        )
    )
    out = regions.drop("edges", "box").join(per, "region_id", "left")
    return out.fillna(0, ["records", "species", "records_verified", "species_verified"])


def combined_tenant_records(records: DataFrame, tenants: DataFrame, agreements: DataFrame, regions: DataFrame, precise: Column | None = None) -> DataFrame:
    """Own records, and records other tenants share that lie inside a region. Each record once, in one scan.

    ``records``: record_id, website_id, x, y and more. ``tenants``: website_id of the caller. ``precise``: a condition that records
    of others must meet too, such as a position finer than the coarse map square; null is not met.
    """
    own = tenants.select("website_id", F.lit(True).alias("_own")).distinct()
    allowed = filters.allowed_tenants(tenants, agreements).join(own, "website_id", "left")
    seen = records.join(allowed, "website_id")
    if precise is not None:
        seen = seen.where(F.col("_own") | precise)
    spots = seen.where(F.col("_own").isNull()).select("x", "y").distinct()
    inside = spatial.tag_points(spots, regions).select("x", "y", F.lit(True).alias("_in")).distinct()
    return seen.join(inside, ["x", "y"], "left").where(F.col("_own") | F.col("_in")).drop("_own", "_in")


def unlinked_site_clusters(visits: DataFrame, places: DataFrame, tolerance: float = 10) -> DataFrame:
    """Grid cells holding several visits not linked to a place, with names of known places visited there.

    ``visits``: x, y (metres), place_id or null. ``places``: place_id, place_name. Visits are counted and
    candidate places made distinct per cell before they are joined, so counts are not multiplied.
    """
    cells = visits.select(geo.snap("x", tolerance).alias("cell_x"), geo.snap("y", tolerance).alias("cell_y"), "place_id")
    unlinked = (
        cells.where(F.col("place_id").isNull())
        .groupBy("cell_x", "cell_y")
        .agg(F.count(F.lit(1)).alias("visits"))
        .where(F.col("visits") > 1)
    )
    known = (
        cells.where(F.col("place_id").isNotNull())
        .distinct()
        .join(places.select("place_id", "place_name"), "place_id")
        .groupBy("cell_x", "cell_y")
        .agg(join_text("place_name", "; ").alias("suggested"))
    )
    key = F.md5(F.concat(F.col("cell_y").cast("bigint").cast("string"), F.lit(","), F.col("cell_x").cast("bigint").cast("string")))
    return unlinked.join(known, ["cell_x", "cell_y"], "left").withColumn("cluster_id", key)


def grid_map(records: DataFrame, size: int) -> DataFrame:
    """Records and visits per fixed map square. ``records``: x, y, visit_id."""
    return records.groupBy(geo.square("x", size).alias("west"), geo.square("y", size).alias("south")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("visit_id").alias("visits")
    )


def time_lapse(records: DataFrame, size: float) -> DataFrame:
    """Records per snapped point and day index, for playing a map through time. ``records``: x, y, seen_on."""
    return records.groupBy(
        geo.snap("x", size).alias("x"), geo.snap("y", size).alias("y"), dates.day_index("seen_on").alias("day")
    ).agg(F.count(F.lit(1)).alias("records"))


def region_grid(regions: DataFrame, size: int = 2000) -> DataFrame:
    """All squares touching each region: lower left corner, centre, grid reference, whether only partly inside.

    ``regions``: region_id, edges, box in national grid metres.
    """
    out = cells.squares(regions, size)
    return out.select(
        "region_id",
        "west",
        "south",
        (F.col("west") + size // 2).alias("centre_e"),
        (F.col("south") + size // 2).alias("centre_n"),
        geo.grid_ref("west", "south", size).alias("square"),
        "partial",
    )


#: Colour at the two ends of the map scale, as red, green, blue.
RAMP = ((255, 255, 178), (189, 0, 38))


def choropleth(points: DataFrame, regions: DataFrame, ramp: tuple = RAMP) -> DataFrame:
    """Points per region with opacity 0.5 to 0.7 and a colour scaled between the least and greatest count.

    ``points``: x, y. ``regions``: region_id, edges, box. When all counts are equal the opacity is 0.6.
    """
    per_spot = settle(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    tags = spatial.tag_points(per_spot.select("x", "y"), regions.select("region_id", "edges", "box"))
    per = per_spot.join(tags, ["x", "y"]).groupBy("region_id").agg(F.sum("n").alias("points"))
    scaled = minmax_scale(per, "points", "_share", 0.5)

    def channel(low, high):
        return F.lpad(F.lower(F.hex(F.round(F.lit(low) + F.col("_share") * (high - low)).cast("long"))), 2, "0")

    colour = F.concat(F.lit("#"), *[channel(a, b) for a, b in zip(*ramp)])
    return scaled.select(
        "region_id", "points", (F.lit(0.5) + 0.2 * F.col("_share")).alias("opacity"), colour.alias("colour")
    )


def layer_overlap(squares: DataFrame, layers: DataFrame) -> DataFrame:
    """Per cent of each square covered by each layer it shares some interior with; ``< 1`` when below one.

    ``squares``: square_id, geom. ``layers``: layer_id, layer_name, geom (``parts`` arrays).
    """
    left = squares.select(F.col("square_id").alias("shape_id"), geo.directed_edges("geom").alias("edges"), geo.bounds("geom").alias("box"))
    right = layers.select(F.col("layer_id").alias("region_id"), geo.directed_edges("geom").alias("edges"), geo.bounds("geom").alias("box"))
    found = cells.shared_area(left, right)
    sizes = squares.select(F.col("square_id").alias("shape_id"), geo.area("geom").alias("area_l"))
    names = layers.select(F.col("layer_id").alias("region_id"), "layer_name", geo.area("geom").alias("area_r"))
    pairs = found.join(sizes, "shape_id").join(names, "region_id").withColumnsRenamed({"shape_id": "square_id", "region_id": "layer_id"})
    pairs = pairs.where(F.col("shared_area") > F.least("area_l", "area_r") * 1e-9)
    share = F.floor(F.round(F.col("shared_area") / F.col("area_l") * 100, 9)).cast("long")
    return pairs.select(
        "square_id",
        "layer_id",
        "layer_name",
        F.when(share == 0, "< 1").otherwise(share.cast("string")).alias("pct_covered"),
    )


def length_check(sections: DataFrame, transects: DataFrame, allowed: float = 1) -> DataFrame:
    """Stored against computed length of each section, and of each transect over its sections.

    ``sections``: section_id, transect_id, wkt (Web Mercator), stored. ``transects``: transect_id, stored_total. Lengths
    are metres of the national grid, in which every vertex is placed before measuring.
    """
    grid = sections.withColumn("_g", parts_to_grid(geo.parts("wkt")))
    measured = grid.withColumn("computed", geo.length(geo.edges("_g"))).drop("_g")
    totals = measured.groupBy("transect_id").agg(F.sum(F.round("computed", 6).cast("decimal(20,6)")).cast("double").alias("computed_total"))
    out = measured.join(totals, "transect_id").join(transects, "transect_id")

    def flag(stored, computed):
        return F.when(F.abs(F.col(computed) - F.col(stored)) > allowed, "x").otherwise("")

    return out.select(
        "section_id",
        "transect_id",
        "stored",
        F.round("computed").cast("long").alias("computed"),
        "stored_total",
        F.round("computed_total").cast("long").alias("computed_total"),
        flag("stored", "computed").alias("section_flag"),
        flag("stored_total", "computed_total").alias("transect_flag"),
    )


def rule_geometry_check(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Places against the polygons of verification rules: one row per (place, rule) that meet.

    ``places``: place_id, x, y. ``rules``: region_id (the rule), edges, box.
    """
    tags = spatial.tag_points(places.select("x", "y").distinct(), rules)
    return places.join(tags, ["x", "y"]).select("place_id", F.col("region_id").alias("rule_id"))


def near_points(centres: DataFrame, sources: dict[str, DataFrame], distance: float) -> DataFrame:
    """Events of several kinds within a distance of each centre: centre_id, kind, event_id, event, distance, sort_date.

    ``centres``: centre_id, x, y. Each source: event_id, event, x, y, sort_date. Equal rows appear once.
    """
    at = centres.select("centre_id", F.col("x").alias("cx0"), F.col("y").alias("cy0"))
    events = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(kind).alias("kind"), "event_id", "event", "x", "y", "sort_date") for kind, df in sources.items()],
    )
    found = spatial.within(events, at, distance)
    return found.select("centre_id", "kind", "event_id", "event", "distance", "sort_date").distinct()


def info_at_point(points: DataFrame, sources: dict[str, DataFrame], tolerance: float) -> DataFrame:
    """Events whose point, line or polygon lies within ``tolerance`` of a clicked point: point_id, id, event, distance, sort_date.

    ``points``: point_id, x, y. Each source: event_id, event, geom (``parts``), sort_date; its name goes before the id.
    Equal rows appear once.
    """
    events = reduce(
        DataFrame.unionByName,
        [df.select(F.concat(F.lit(f"{kind}:"), F.col("event_id").cast("string")).alias("shape_id"), "event", "geom", "sort_date") for kind, df in sources.items()],
    )
    near = overlay.near_shapes(points, events.select("shape_id", "geom"), tolerance)
    shown = events.select("shape_id", "event", "sort_date").distinct()
    return near.join(shown, "shape_id").select("point_id", F.col("shape_id").alias("id"), "event", "distance", "sort_date")


def records_in_regions(shapes: DataFrame, regions: DataFrame) -> DataFrame:
    """(shape_id, region_id) of recorded points, lines and polygons that share some interior with a region, or a point in or on it.

    ``shapes``: shape_id, geom (``parts``). Lines and polygons that only touch a region from outside do not count; points on
    its outline do.
    """
    shell, vertices = F.col("geom")[0]["shell"], F.size(F.col("geom")[0]["ring"])
    at = F.col("geom")[0]["ring"][0]
    points = shapes.where(shell.isNull() & (vertices == 1)).select("shape_id", at["x"].alias("x"), at["y"].alias("y"))
    lines = shapes.where(shell.isNull() & (vertices > 1)).select("shape_id", geo.edges("geom").alias("edges"))
    polygons = shapes.where(shell.isNotNull()).select("shape_id", geo.directed_edges("geom").alias("edges"), geo.bounds("geom").alias("box"))
    areas = regions.select("region_id", "edges", "box")
    found = [
        spatial.tag_points(points, areas).select("shape_id", "region_id"),
        cells.lines_in_regions(lines, areas).where("inside").select("shape_id", "region_id"),
        cells.polygons_meeting(polygons, areas).where("inside").select("shape_id", "region_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def united_boundaries(places: DataFrame, children: DataFrame) -> DataFrame:
    """Places with the union of their child places' polygons: place_id, geom (WKT), kind, area, outline (length)."""
    made = overlay.union_polygons(children.select(F.col("place_id").alias("shape_id"), "parent_id", geo.parts("geom").alias("geom")), "parent_id")
    out = made.select(
        F.col("parent_id").alias("place_id"), geo.parts_wkt("geom", F.col("kind")).alias("geom"), "kind", "area", geo.length(geo.edges("geom")).alias("outline")
    )
    return places.join(out, "place_id")


def transect_lines(places: DataFrame, children: DataFrame) -> DataFrame:
    """Places with the union of their sections' lines (Web Mercator) in degrees and its length in the national grid.

    Stretches that several sections share are drawn and measured once.
    """
    made = overlay.union_lines(children.select(F.col("place_id").alias("shape_id"), "parent_id", geo.parts("geom").alias("geom")), "parent_id")
    made = made.withColumn("_m", parts_to_grid("geom")).withColumn("_d", geo.reproject_parts("geom", geo.mercator_to_lonlat))
    out = made.select(F.col("parent_id").alias("place_id"), geo.parts_wkt("_d", F.col("kind")).alias("geom"), geo.length(geo.edges("_m")).alias("length_m"))
    return places.join(out, "place_id")


def map_layers(layers: list[tuple[str, DataFrame]], box: tuple | None = None) -> DataFrame:
    """Typed map layers below each other with their draw order: draw_order, layer, feature_id, label, geom (WKT).

    ``box`` (xmin, ymin, xmax, ymax) keeps features whose interior meets it (points: that lie in it).
    """
    frames = [
        df.select(F.lit(i).alias("draw_order"), F.lit(name).alias("layer"), "feature_id", "label", "geom")
        for i, (name, df) in enumerate(layers, 1)
    ]
    out = reduce(DataFrame.unionByName, frames).distinct()
    if box is None:
        return out
    window = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), box)])
    bounds = geo.bounds(geo.parts("geom"))
    meets = F.when(geo.is_polygon("geom"), geo.boxes_meet(bounds, window, False)).otherwise(geo.boxes_meet(bounds, window))
    return out.where(meets)


def sections_of(places: DataFrame, parents: DataFrame) -> DataFrame:
    """Line sections with the name of their site, naturally sorted by code."""
    lines = places.where(geo.is_line("geom"))
    named = with_parent(lines, parents, {"place_name": "site_name"}, key="place_id", parent_key="parent_id")
    return named.orderBy("site_name", natural_key(F.coalesce("code", "place_name")), "place_id")


def visits_by_spot(visits: DataFrame, page_size: int = 10000) -> DataFrame:
    """Visits sharing one position: their number, ids as text, and an opacity that grows with the number.

    ``visits``: visit_id, x, y. ``page_size`` ids in their order are a page.
    """
    counts = visits.groupBy("x", "y").agg(F.count(F.lit(1)).alias("visits"))
    pages = paged(visits.select("x", "y", "visit_id"), ["x", "y"], "visit_id", page_size)
    ids = pages.groupBy("x", "y", "page").agg(
        F.array_join(F.array_sort(F.collect_list("visit_id")), ",").alias("visit_ids")
    )
    opacity = F.least(F.lit(1.0), F.lit(0.2) + F.sqrt(F.col("visits") - 1) / 20)
    return ids.join(counts, ["x", "y"]).withColumn("opacity", opacity)


def survey_coverage(places: DataFrame, visits: DataFrame, surveys: list | None = None, since=None) -> DataFrame:
    """Every place with its number of visits of some surveys and whether it was surveyed at all."""
    chosen = filters.opt(visits, surveys, lambda v: F.col("survey_id").isin(list(v)))
    chosen = filters.opt(chosen, since, lambda v: F.col("date_start") >= dates.as_date(v))
    counts = chosen.groupBy("place_id").agg(F.count(F.lit(1)).alias("visits"))
    out = places.join(counts, "place_id", "left").fillna(0, ["visits"])
    return out.withColumn("surveyed", F.when(F.col("visits") > 0, "Yes").otherwise("No"))


def centroids(places: DataFrame, wkt: str = "geom", places_after_point: int = 5) -> DataFrame:
    """Places in Web Mercator with the latitude and longitude of their centre."""
    at = geo.bound(geo.centroid(geo.parts(wkt)), lambda c: geo.mercator_to_lonlat(c["x"], c["y"]))
    return places.withColumn("_at", at).select(
        *places.columns,
        F.round("_at.y", places_after_point).alias("lat"),
        F.round("_at.x", places_after_point).alias("lon"),
    )
