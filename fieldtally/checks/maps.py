"""Spatial operators and map jobs. Coordinates come from key arithmetic, so the twins are plain inequalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo_arrow import grid_to_lonlat, lonlat_to_grid, simplified
from ..operators import cells, spatial
from ..plans import exports, sites
from .projection import grid_sql
from .registry import query

IN_BOX = "{p}.x BETWEEN b.xmin AND b.xmax AND {p}.y BETWEEN b.ymin AND b.ymax"
IN_WEDGE = "{p}.x >= b.xmin AND {p}.y >= b.ymin AND ({p}.x - b.xmin) + ({p}.y - b.ymin) <= 250"


# ---- operators -----------------------------------------------------------------------


@query(
    "points_strictly_inside",
    "G1 G2",
    "SELECT p.user_id, b.region_id FROM people p JOIN boxes b ON p.x > b.xmin AND p.x < b.xmax AND p.y > b.ymin AND p.y < b.ymax",
)
def _(t):
    return spatial.tag_points(t.people.select("user_id", "x", "y"), t.regions, boundary=False).select("user_id", "region_id")


@query(
    "point_in_polygon",
    "G2",
    f"SELECT p.user_id, b.region_id FROM people p JOIN boxes b ON {IN_WEDGE.format(p='p')}",
)
def _(t):
    return spatial.tag_points(t.people.select("user_id", "x", "y"), t.wedges).select("user_id", "region_id")


@query(
    "polygons_sharing_interior",
    "G1 G5",
    """SELECT a.user_id AS left_id, b.region_id AS right_id,
    CAST((least(a.x + 20, b.xmax) - greatest(a.x, b.xmin)) * (least(a.y + 20, b.ymax) - greatest(a.y, b.ymin)) AS DOUBLE) AS shared_area
    FROM people a JOIN boxes b ON a.x < b.xmax AND b.xmin < a.x + 20 AND a.y < b.ymax AND b.ymin < a.y + 20""",
)
def _(t):
    own = geo.box_wkt("x", "y", F.col("x") + 20, F.col("y") + 20)
    left = t.people.select(F.col("user_id").alias("left_id"), geo.parts(own).alias("geom_l"))
    right = t.boxes.select(F.col("region_id").alias("right_id"), geo.parts("wkt").alias("geom_r"))
    return spatial.overlapping(left, right).select("left_id", "right_id", F.round("shared_area", 6).alias("shared_area"))


@query(
    "boxes_touching",
    "G1",
    """SELECT a.user_id AS left_id, b.region_id AS right_id FROM people a JOIN boxes b
    ON a.x <= b.xmax AND b.xmin <= a.x + 10 AND a.y <= b.ymax AND b.ymin <= a.y + 10""",
)
def _(t):
    def box(x0, y0, x1, y1, name):
        ends = zip((x0, y0, x1, y1), ("xmin", "ymin", "xmax", "ymax"))
        return F.struct(*[c.cast("double").alias(n) for c, n in ends]).alias(name)

    x, y = F.col("x"), F.col("y")
    left = t.people.select(F.col("user_id").alias("left_id"), box(x, y, x + 10, y + 10, "box_l"))
    right = t.boxes.select(
        F.col("region_id").alias("right_id"), box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], "box_r")
    )
    return spatial.meeting_boxes(left, right, 100.0, touching=True).select("left_id", "right_id")


@query(
    "within_distance",
    "G3",
    """SELECT c.region_id, p.user_id, round(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 6) AS distance
    FROM (SELECT region_id, xmin + 125 AS x, ymin + 125 AS y FROM boxes) c
    JOIN people p ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 2500""",
)
def _(t):
    centres = t.boxes.select("region_id", (F.col("xmin") + 125).alias("cx0"), (F.col("ymin") + 125).alias("cy0"))
    found = spatial.within(t.people.select("user_id", "x", "y"), centres, 50)
    return found.select("region_id", "user_id", F.round("distance", 6).alias("distance"))


@query(
    "grid_snapping",
    "G4",
    """SELECT user_id, CAST(round_even(x / 40.0, 0) * 40 AS DOUBLE) AS snap_x, CAST(floor(y / 100.0) * 100 AS BIGINT) AS square_y,
    'SK' || lpad(CAST(x // 10 AS VARCHAR), 4, '0') || lpad(CAST(y // 10 AS VARCHAR), 4, '0') AS ref,
    CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2000 ELSE 1000 END AS size FROM people""",
)
def _(t):
    # Grid square SK starts at 400 km east, 300 km north.
    east, north = F.col("x") + 400000, F.col("y") + 300000
    ref = geo.grid_ref(east, north, 10)
    kind = F.col("user_id") % 3
    named = F.when(kind == 0, ref).when(kind == 1, geo.grid_ref(east, north, 2000)).otherwise(geo.grid_ref(east, north, 1000))
    return t.people.select(
        "user_id",
        geo.snap("x", 40).alias("snap_x"),
        geo.square("y", 100).alias("square_y"),
        ref.alias("ref"),
        geo.ref_precision(named).cast("int").alias("size"),
    )


@query(
    "length_and_area",
    "G5 G8",
    """SELECT user_id, 'POLYGON' AS kind, CAST(2 * (x + 1) + 2 * (y + 1) AS DOUBLE) AS outline, CAST((x + 1) * (y + 1) AS DOUBLE) AS area,
    (x + 1) / 2.0::DOUBLE AS cx, (y + 1) / 2.0::DOUBLE AS cy FROM people""",
)
def _(t):
    shape = geo.parts(geo.box_wkt(F.lit(0), F.lit(0), F.col("x") + 1, F.col("y") + 1))
    shape_text = geo.box_wkt(F.lit(0), F.lit(0), F.col("x") + 1, F.col("y") + 1)
    df = t.people.select("user_id", "x", "y", shape.alias("g"), shape_text.alias("wkt"))
    return df.withColumn("centre", geo.centroid("g")).select(
        "user_id",
        geo.geom_type("wkt").alias("kind"),
        geo.length(geo.edges("g")).alias("outline"),
        geo.area("g").alias("area"),
        F.round("centre.x", 6).alias("cx"),
        F.round("centre.y", 6).alias("cy"),
    )


@query(
    "reprojection",
    "G6",
    """SELECT user_id, round(degrees(x * 1000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(y * 1000 / 6378137.0)) - pi() / 2), 6) AS lat,
    'POINT(' || x || ' ' || y || ')' AS wkt, x * 1000 AS back_x, y * 1000 AS back_y FROM people""",
)
def _(t):
    at = geo.mercator_to_lonlat(F.col("x") * 1000, F.col("y") * 1000)
    df = t.people.select("user_id", at.alias("at"), geo.point_wkt("x", "y").alias("wkt"))
    back = geo.lonlat_to_mercator("at.x", "at.y")
    return df.select(
        "user_id",
        F.round("at.x", 6).alias("lon"),
        F.round("at.y", 6).alias("lat"),
        "wkt",
        F.round(back["x"]).cast("long").alias("back_x"),
        F.round(back["y"]).cast("long").alias("back_y"),
    )


@query(
    "national_grid_round_trip",
    "G6",
    "SELECT user_id, 400000 + x * 10 AS east, 300000 + y * 10 AS north, TRUE AS in_range FROM people",
)
def _(t):
    """East and north to degrees and back: the two published formulas must undo each other to the metre."""
    df = t.people.withColumn("at", grid_to_lonlat((F.col("x") * 10 + 400000).cast("double"), (F.col("y") * 10 + 300000).cast("double")))
    back = df.withColumn("en", lonlat_to_grid("at.x", "at.y"))
    return back.select(
        "user_id",
        F.round("en.x").cast("long").alias("east"),
        F.round("en.y").cast("long").alias("north"),
        (F.col("at.x").between(-2.1, -1.8) & F.col("at.y").between(52.5, 52.8)).alias("in_range"),
    )


@query(
    "dissolved_lines",
    "G7",
    """SELECT place_id, 'MULTILINESTRING(' || string_agg('(0 0,' || visit_id || ' 1)', ',' ORDER BY visit_id) || ')' AS geom,
    CAST(page AS BIGINT) AS page FROM (SELECT place_id, visit_id, (row_number() OVER (PARTITION BY place_id ORDER BY visit_id) - 1) // 50 AS page FROM visits) GROUP BY place_id, page""",
)
def _(t):
    lines = t.visits.select("place_id", "visit_id", F.format_string("LINESTRING(0 0,%d 1)", F.col("visit_id")).alias("wkt"))
    return spatial.collect_geom(lines, "place_id", "wkt", "visit_id", size=50)


@query(
    "simplified_outline",
    "G7",
    """SELECT user_id, 'LineString' AS kind, CAST(CASE WHEN y > 100 THEN 3 ELSE 2 END AS INTEGER) AS vertices FROM people""",
)
def _(t):
    # A straight line of five points with one bump of height y: the bump stays when above the tolerance.
    text = F.format_string("LINESTRING(0 0,250 0,500 %d,750 0,1000 0)", F.lit(0))
    bump = F.format_string("LINESTRING(0 0,500 %d,1000 0)", F.col("y"))
    shape = F.when(F.col("y") > 100, bump).otherwise(text)
    thin = t.people.select("user_id", simplified(geo.parts(shape), F.lit(100.0)).alias("g"))
    return thin.select("user_id", F.lit("LineString").alias("kind"), F.size(geo.vertices("g")).alias("vertices"))


@query(
    "geometry_types",
    "G8",
    """SELECT CASE user_id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' ELSE 'POLYGON' END AS kind, count(*) AS n,
    count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS lines FROM people GROUP BY 1""",
)
def _(t):
    k = F.col("user_id") % 3
    wkt = (
        F.when(k == 0, geo.point_wkt("x", "y"))
        .when(k == 1, F.format_string("LINESTRING(0 0,%d %d)", "x", "y"))
        .otherwise(geo.box_wkt(F.lit(0), F.lit(0), F.col("x") + 1, F.col("y") + 1))
    )
    df = t.people.select(wkt.alias("wkt"))
    return df.groupBy(geo.geom_type("wkt").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(geo.is_line("wkt"), 1)).alias("lines")
    )


# ---- jobs ----------------------------------------------------------------------------


@query(
    "site_summary_by_key",
    "job:site_summary_by_key J4 J7 A1",
    """WITH seen AS (SELECT v.visit_id, p.parent_id FROM visits v JOIN places p ON p.place_id = v.place_id AND p.balance > 0)
    SELECT n.parent_id AS site_id, n.parent_name AS place_name, count(DISTINCT seen.visit_id) AS visits, count(r.record_id) AS records,
    count(DISTINCT r.taxon_id) AS species FROM parents n LEFT JOIN seen ON seen.parent_id = n.parent_id LEFT JOIN records r ON r.visit_id = seen.visit_id GROUP BY 1, 2""",
)
def _(t):
    # Parents get negative ids so that both levels fit one frame.
    tops = t.parents.select(
        (-F.col("parent_id") - 1).cast("long").alias("place_id"), F.lit(None).cast("long").alias("parent_id"), F.col("parent_name").alias("place_name")
    )
    below = t.places.where("balance > 0").select("place_id", (-F.col("parent_id") - 1).cast("long").alias("parent_id"), "place_name")
    out = sites.site_summary_by_key(tops.unionByName(below), t.visits.select("visit_id", "place_id"), t.records)
    return out.withColumn("site_id", (-F.col("site_id") - 1).cast("int"))


@query(
    "site_report",
    "job:site_summary_by_key A1 C2",
    """SELECT place_id, count(*) AS visits, count(DISTINCT year(date_start)) AS years, CAST(min(year(date_start)) AS INTEGER) AS first_year,
    CAST(max(year(date_start)) AS INTEGER) AS last_year FROM visits GROUP BY 1""",
)
def _(t):
    return sites.site_report(t.visits)


@query(
    "site_summary_by_geometry",
    "job:site_summary_by_geometry G1 A1 A2",
    f"""SELECT b.region_id, b.region_name, count(r.record_id) AS records, count(DISTINCT r.taxon_id) AS species,
    count(CASE WHEN r.record_status = 'A' THEN 1 END) AS records_verified, count(DISTINCT CASE WHEN r.record_status = 'A' THEN r.taxon_id END) AS species_verified
    FROM boxes b LEFT JOIN records r ON {IN_WEDGE.format(p='r')} GROUP BY 1, 2""",
)
def _(t):
    return sites.site_summary_by_geometry(t.records, t.wedges, "A")


@query(
    "region_tagging",
    "job:region_tagging G1 F7",
    f"""SELECT p.x, p.y, coalesce(string_agg(CAST(b.region_id AS VARCHAR), ',' ORDER BY b.region_id), '') AS region_ids
    FROM (SELECT DISTINCT x, y FROM visits) p LEFT JOIN boxes b ON {IN_BOX.format(p='p')} GROUP BY 1, 2""",
)
def _(t):
    tagged = sites.region_tagging(t.visits, t.regions)
    return tagged.withColumn("region_ids", F.array_join("region_ids", ","))


@query(
    "combined_tenant_records",
    "job:combined_tenant_records U1 G1 F3",
    f"""SELECT v.visit_id, v.user_id % 5 AS website_id FROM visits v WHERE v.user_id % 5 = 1 OR
    (v.user_id % 5 IN (2) AND (v.x // 20 * 20 <> v.x // 100 * 100 OR v.y // 20 * 20 <> v.y // 100 * 100) AND EXISTS (SELECT 1 FROM boxes b WHERE b.region_id IN (3, 8) AND {IN_BOX.format(p='v')}))""",
)
def _(t):
    rows = t.visits.select("visit_id", (F.col("user_id") % 5).alias("website_id"), "x", "y")
    own = t.region.where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("website_id"))
    owner = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("to_website_id")
    granted = t.region.select(F.col("r_regionkey").cast("long").alias("from_website_id"), owner)
    granted = granted.withColumn("receive_for_reporting", F.col("to_website_id") - F.col("from_website_id") == 1)
    inside = t.regions.where("region_id IN (3, 8)")
    fine, coarse = ([geo.square(c, size) for c in ("x", "y")] for size in (20, 100))
    precise = (fine[0] != coarse[0]) | (fine[1] != coarse[1])
    return sites.combined_tenant_records(rows, own, granted, inside, precise).select("visit_id", "website_id")


@query(
    "unlinked_site_clusters",
    "job:unlinked_site_clusters G4 A4 A5",
    """WITH c AS (SELECT CAST(round_even(x / 10.0, 0) * 10 AS BIGINT) AS cx, CAST(round_even(y / 10.0, 0) * 10 AS BIGINT) AS cy,
      CASE WHEN visit_id % 3 > 0 THEN place_id END AS place_id FROM visits),
    u AS (SELECT cx, cy, count(*) AS visits FROM c WHERE place_id IS NULL GROUP BY 1, 2 HAVING count(*) > 1),
    k AS (SELECT cx, cy, string_agg(DISTINCT p.place_name, '; ' ORDER BY p.place_name) AS suggested FROM c JOIN places p ON p.place_id = c.place_id GROUP BY 1, 2)
    SELECT CAST(u.cx AS DOUBLE) AS cell_x, CAST(u.cy AS DOUBLE) AS cell_y, visits, suggested, md5(u.cy || ',' || u.cx) AS cluster_id FROM u LEFT JOIN k ON k.cx = u.cx AND k.cy = u.cy""",
)
def _(t):
    rows = t.visits.select("x", "y", F.when(F.col("visit_id") % 3 > 0, F.col("place_id")).alias("place_id"))
    return sites.unlinked_site_clusters(rows, t.places, 10)


@query(
    "grid_map",
    "job:grid_map G4",
    """SELECT x // 100 * 100 AS west, y // 100 * 100 AS south, count(*) AS records, count(DISTINCT visit_id) AS visits FROM records GROUP BY 1, 2""",
)
def _(t):
    return sites.grid_map(t.records, 100)


@query(
    "time_lapse",
    "job:grid_map G4 C2",
    """SELECT CAST(round_even(x / 50.0, 0) * 50 AS DOUBLE) AS x, CAST(round_even(y / 50.0, 0) * 50 AS DOUBLE) AS y,
    CAST(date_start - DATE '1970-01-01' AS INTEGER) AS day, count(*) AS records FROM visits GROUP BY 1, 2, 3""",
)
def _(t):
    return sites.time_lapse(t.visits.withColumnRenamed("date_start", "seen_on"), 50)


@query(
    "region_grid",
    "job:region_grid T1 G1 G4",
    """WITH w AS (SELECT place_id AS region_id, x AS xmin, y AS ymin, x + 250 AS xmax, y + 250 AS ymax FROM places),
    ends AS (SELECT min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM w),
    e AS (SELECT unnest(range(x0 // 100 * 100, CAST(ceil(x1 / 100.0) * 100 AS BIGINT), 100)) AS west FROM ends),
    n AS (SELECT unnest(range(y0 // 100 * 100, CAST(ceil(y1 / 100.0) * 100 AS BIGINT), 100)) AS south FROM ends)
    SELECT b.region_id, west, south, west + 50 AS centre_e, south + 50 AS centre_n,
      'SV' || lpad(CAST(west // 100 AS VARCHAR), 3, '0') || lpad(CAST(south // 100 AS VARCHAR), 3, '0') AS square,
      NOT (west >= b.xmin AND south >= b.ymin AND (west + 100 - b.xmin) + (south + 100 - b.ymin) <= 250) AS partial
    FROM w b CROSS JOIN e CROSS JOIN n WHERE west <= b.xmax AND west + 100 >= b.xmin AND south <= b.ymax AND south + 100 >= b.ymin
      AND (greatest(west, b.xmin) - b.xmin) + (greatest(south, b.ymin) - b.ymin) <= 250""",
)
def _(t):
    x, y = F.col("x"), F.col("y")
    wedge = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d))", x, y, x + 250, y, x, y + 250, x, y)
    return sites.region_grid(spatial.shapes(t.places.select("place_id", wedge.alias("wkt")), "wkt", "place_id"), 100)


@query(
    "choropleth",
    "job:choropleth G2 W5 C3",
    f"""WITH n AS (SELECT b.region_id, count(*) AS points FROM people p JOIN boxes b ON {IN_BOX.format(p='p')} GROUP BY 1),
    s AS (SELECT region_id, points, CASE WHEN max(points) OVER () = min(points) OVER () THEN 0.5 ELSE (points - min(points) OVER ())::DOUBLE / (max(points) OVER () - min(points) OVER ()) END AS f FROM n)
    SELECT region_id, points, round(0.5 + 0.2 * f, 6)::DOUBLE AS opacity, '#' || lpad(lower(hex(CAST(round(255 + f * (189 - 255)) AS BIGINT))), 2, '0')
      || lpad(lower(hex(CAST(round(255 + f * (0 - 255)) AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(round(178 + f * (38 - 178)) AS BIGINT))), 2, '0') AS colour FROM s""",
)
def _(t):
    return sites.choropleth(t.people, t.regions).withColumn("opacity", F.round("opacity", 6))


@query(
    "layer_overlap",
    "job:layer_overlap G5 G1 A7",
    """SELECT square_id, layer_id, layer_name, CASE WHEN s // 100 = 0 THEN '< 1' ELSE CAST(s // 100 AS VARCHAR) END AS pct_covered FROM
      (SELECT q.user_id AS square_id, b.region_id AS layer_id, b.region_name AS layer_name,
        (least(q.x + 105, b.xmax) - greatest(q.x + 5, b.xmin)) * (least(q.y + 105, b.ymax) - greatest(q.y + 5, b.ymin)) AS s
       FROM people q JOIN boxes b ON q.x + 5 < b.xmax AND b.xmin < q.x + 105 AND q.y + 5 < b.ymax AND b.ymin < q.y + 105)""",
)
def _(t):
    x, y = F.col("x") + 5, F.col("y") + 5
    squares = t.people.select(F.col("user_id").alias("square_id"), geo.parts(geo.box_wkt(x, y, x + 100, y + 100)).alias("geom"))
    layers = t.boxes.select(F.col("region_id").alias("layer_id"), F.col("region_name").alias("layer_name"), geo.parts("wkt").alias("geom"))
    return sites.layer_overlap(squares, layers)


# Sections in Britain, in Web Mercator: a bent line of three points each.
_SECTIONS = """sections AS (SELECT visit_id AS section_id, user_id AS transect_id, -200000 + x * 100 AS mx, 6800000 + y * 100 AS my FROM visits),
    pts AS (SELECT section_id AS id, k, mx + 300 * k AS mx, my + 50 * k * k AS my FROM sections, range(0, 3) AS r(k))"""


def _section_line():
    x, y = F.col("x") * 100 - 200000, F.col("y") * 100 + 6800000
    return F.format_string("LINESTRING(%d %d,%d %d,%d %d)", x, y, x + 300, y + 50, x + 600, y + 200)


@query(
    "length_check",
    "job:length_check G5 G6 A3",
    f"""WITH {_SECTIONS}, {grid_sql("pts")},
    m AS (SELECT a.id AS section_id, sum(sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2)) AS len FROM grid a JOIN grid b ON a.id = b.id AND b.k = a.k + 1 GROUP BY 1),
    q AS (SELECT section_id, transect_id, len, 380 + section_id % 5 AS stored FROM sections JOIN m USING (section_id)),
    n AS (SELECT transect_id, CAST(sum(CAST(round(len, 6) AS DECIMAL(20,6))) AS DOUBLE) AS total, CAST(sum(stored) AS BIGINT) AS stored_total FROM q GROUP BY 1)
    SELECT section_id, transect_id, stored, CAST(round(len) AS BIGINT) AS computed, stored_total, CAST(round(total) AS BIGINT) AS computed_total,
      CASE WHEN abs(len - stored) > 1 THEN 'x' ELSE '' END AS section_flag, CASE WHEN abs(total - stored_total) > 1 THEN 'x' ELSE '' END AS transect_flag
    FROM q JOIN n USING (transect_id)""",
)
def _(t):
    sections = t.visits.select(
        F.col("visit_id").alias("section_id"), F.col("user_id").alias("transect_id"), _section_line().alias("wkt"), (F.lit(380) + F.col("visit_id") % 5).alias("stored")
    )
    transects = sections.groupBy("transect_id").agg(F.sum("stored").alias("stored_total"))
    return sites.length_check(sections, transects)


@query(
    "rule_geometry_check",
    "job:rule_geometry_check G1",
    f"SELECT p.place_id, b.region_id AS rule_id FROM places p JOIN boxes b ON {IN_WEDGE.format(p='p')}",
)
def _(t):
    return sites.rule_geometry_check(t.places, t.wedges)


@query(
    "near_points",
    "job:near_points G3 U1",
    """WITH e AS (SELECT 'visit' AS kind, visit_id AS event_id, 'Visit ' || priority AS event, x, y, date_start AS d FROM visits
      UNION SELECT 'record', visit_id, 'Record of ' || record_status, (visit_id * 37) % 1000, (visit_id * 91) % 1000, seen_on FROM records)
    SELECT c.region_id AS centre_id, kind, event_id, event, round(sqrt((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y)), 6) AS distance,
      strftime(d, '%Y-%m-%d') AS sort_date FROM (SELECT region_id, xmin + 125 AS x, ymin + 125 AS y FROM boxes) c JOIN e ON (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) <= 900""",
)
def _(t):
    return _events_near(t, t.visits)


@query(
    "near_points_all",
    "job:near_points G3 U1",
    """WITH e AS (SELECT 'visit' AS kind, visit_id AS event_id, 'Visit ' || priority AS event, x, y, date_start AS d FROM visits
      UNION SELECT 'record', visit_id, 'Record of ' || record_status, (visit_id * 37) % 1000, (visit_id * 91) % 1000, seen_on FROM records)
    SELECT c.region_id AS centre_id, kind, event_id, event, round(sqrt((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y)), 6) AS distance,
      strftime(d, '%Y-%m-%d') AS sort_date FROM (SELECT region_id, xmin + 125 AS x, ymin + 125 AS y FROM boxes) c JOIN e ON (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) <= 900""",
)
def _(t):
    return _events_near(t, t.visits)


def _events_near(t, visits):
    visits = visits.select(
        F.col("visit_id").alias("event_id"), F.concat(F.lit("Visit "), F.col("priority")).alias("event"), "x", "y", F.col("date_start").alias("sort_date")
    )
    v = F.col("visit_id")
    finds = t.records.select(
        v.alias("event_id"),
        F.concat(F.lit("Record of "), F.col("record_status")).alias("event"),
        ((v * 37) % 1000).alias("x"),
        ((v * 91) % 1000).alias("y"),
        F.col("seen_on").alias("sort_date"),
    )
    centres = t.boxes.select(F.col("region_id").alias("centre_id"), (F.col("xmin") + 125).alias("x"), (F.col("ymin") + 125).alias("y"))
    found = sites.near_points(centres, {"visit": visits, "record": finds}, 30)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "map_layers",
    "job:map_layers U1 G1",
    """SELECT 1 AS draw_order, 'region' AS layer, region_id AS feature_id, region_name AS label,
      'POLYGON((' || xmin || ' ' || ymin || ',' || xmax || ' ' || ymin || ',' || xmax || ' ' || ymax || ',' || xmin || ' ' || ymax || ',' || xmin || ' ' || ymin || '))' AS geom
    FROM boxes WHERE xmin < 500 AND xmax > 100 AND ymin < 700 AND ymax > 300
    UNION ALL SELECT 2, 'place', place_id, place_name, 'POINT(' || x || ' ' || y || ')' FROM places WHERE x BETWEEN 100 AND 500 AND y BETWEEN 300 AND 700
    UNION ALL SELECT 3, 'person', user_id, role, 'POINT(' || x || ' ' || y || ')' FROM people WHERE x BETWEEN 100 AND 500 AND y BETWEEN 300 AND 700""",
)
def _(t):
    def points(df, key, label):
        return df.select(F.col(key).alias("feature_id"), F.col(label).alias("label"), geo.point_wkt("x", "y").alias("geom"))

    regions = t.boxes.select(F.col("region_id").alias("feature_id"), F.col("region_name").alias("label"), F.col("wkt").alias("geom"))
    layers = [("region", regions), ("place", points(t.places, "place_id", "place_name")), ("person", points(t.people, "user_id", "role"))]
    return sites.map_layers(layers, (100, 300, 500, 700))


@query(
    "section_listing",
    "job:gis_export G8 J7 O1",
    """SELECT p.place_id, p.place_name, n.parent_name AS site_name FROM places p LEFT JOIN parents n ON n.parent_id = p.parent_id WHERE p.place_id % 2 = 0""",
)
def _(t):
    shape = F.when(F.col("place_id") % 2 == 0, F.format_string("LINESTRING(0 0,%d %d)", "x", "y")).otherwise(geo.point_wkt("x", "y"))
    lines = t.places.select("place_id", "place_name", "parent_id", shape.alias("geom"), F.lit(None).cast("string").alias("code"))
    parents = t.parents.select(F.col("parent_id").alias("place_id"), F.col("parent_name").alias("place_name"))
    return sites.sections_of(lines, parents).select("place_id", "place_name", "site_name")


@query(
    "centroid_listing",
    "job:gis_export G6",
    """SELECT user_id, round(degrees(2 * atan(exp((y * 1000 + 125.0) / 6378137.0)) - pi() / 2), 5) AS lat, round(degrees((x * 1000 + 125.0) / 6378137.0), 5) AS lon FROM people""",
)
def _(t):
    x, y = F.col("x") * 1000, F.col("y") * 1000
    squares = t.people.select("user_id", geo.box_wkt(x, y, x + 250, y + 250).alias("wkt"))
    return sites.centroids(squares, "wkt").select("user_id", "lat", "lon")


@query(
    "visits_by_spot",
    "job:gis_export A4 C3",
    """WITH n AS (SELECT x, y, count(*) AS visits FROM visits GROUP BY 1, 2),
    p AS (SELECT v.x, v.y, v.visit_id, n.visits, (row_number() OVER (PARTITION BY v.x, v.y ORDER BY v.visit_id) - 1) // 6 AS page FROM visits v JOIN n ON n.x = v.x AND n.y = v.y)
    SELECT x, y, page, string_agg(CAST(visit_id AS VARCHAR), ',' ORDER BY visit_id) AS visit_ids, max(visits) AS visits,
      round(least(1.0, 0.2 + sqrt(max(visits) - 1) / 20), 6)::DOUBLE AS opacity FROM p GROUP BY 1, 2, 3""",
)
def _(t):
    return sites.visits_by_spot(t.visits.select("visit_id", "x", "y"), page_size=6).withColumn("opacity", F.round("opacity", 6))


@query(
    "survey_coverage",
    "job:site_summary_by_key J2 C4 F1",
    """SELECT p.place_id, p.place_name, count(v.visit_id) AS visits, CASE WHEN count(v.visit_id) > 0 THEN 'Yes' ELSE 'No' END AS surveyed
    FROM places p LEFT JOIN visits v ON v.place_id = p.place_id AND v.priority IN ('1-URGENT', '5-LOW') AND v.date_start >= DATE '2001-07-01' GROUP BY 1, 2""",
)
def _(t):
    visits = t.visits.withColumnRenamed("priority", "survey_id")
    return sites.survey_coverage(t.places.select("place_id", "place_name"), visits, ["1-URGENT", "5-LOW"], "2001-07-01")


# ---- lines and polygons --------------------------------------------------------------

# Lines of four directions from a person's position, among them one along each side of the triangles.
_WAYS = "CASE user_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
_DX, _DY = _WAYS.format(30, 0, 50, 60), _WAYS.format(40, 50, 0, -60)


def _way(a, b, c, d):
    k = F.col("user_id") % 4
    return F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(d)


def _lines(t):
    x, y = F.col("x"), F.col("y")
    return t.people.select("user_id", F.format_string("LINESTRING(%d %d,%d %d)", x, y, x + _way(30, 0, 50, 60), y + _way(40, 50, 0, -60)).alias("wkt"))


# Half planes of a triangle, each as its value at the line's start and its change along the line.
_CLIPPED = f"""l AS (SELECT user_id, x, y, {_DX} AS dx, {_DY} AS dy FROM people),
    f AS (SELECT user_id, region_id, dx, dy, x - xmin AS f1, dx AS g1, y - ymin AS f2, dy AS g2, 250 - (x - xmin) - (y - ymin) AS f3, -dx - dy AS g3 FROM l, boxes),
    c AS (SELECT user_id, region_id, sqrt(dx * dx + dy * dy) AS len, f1, g1, f2, g2, f3, g3,
      greatest(0.0, CASE WHEN g1 > 0 THEN -f1 / g1::DOUBLE ELSE 0 END, CASE WHEN g2 > 0 THEN -f2 / g2::DOUBLE ELSE 0 END, CASE WHEN g3 > 0 THEN -f3 / g3::DOUBLE ELSE 0 END) AS t0,
      least(1.0, CASE WHEN g1 < 0 THEN -f1 / g1::DOUBLE ELSE 1 END, CASE WHEN g2 < 0 THEN -f2 / g2::DOUBLE ELSE 1 END, CASE WHEN g3 < 0 THEN -f3 / g3::DOUBLE ELSE 1 END) AS t1
      FROM f WHERE (g1 <> 0 OR f1 >= 0) AND (g2 <> 0 OR f2 >= 0) AND (g3 <> 0 OR f3 >= 0)),
    r AS (SELECT *, t1 > t0 + 1e-9 AND (g1 <> 0 OR f1 > 0) AND (g2 <> 0 OR f2 > 0) AND (g3 <> 0 OR f3 > 0) AS inside FROM c WHERE t0 <= t1 + 1e-12)"""


@query(
    "lines_in_regions",
    "G1 G5 job:site_summary_by_geometry",
    f"""WITH {_CLIPPED}
    SELECT user_id, region_id, inside, NOT inside AS touches, round(CASE WHEN inside THEN (t1 - t0) * len ELSE 0 END, 6)::DOUBLE AS length_inside FROM r""",
)
def _(t):
    lines = _lines(t).select("user_id", geo.edges(geo.parts("wkt")).alias("edges"))
    return cells.lines_in_regions(lines, t.wedges, "user_id").withColumn("length_inside", F.round("length_inside", 6))


@query(
    "polygons_meeting",
    "G1",
    """WITH s AS (SELECT user_id, region_id, greatest(x, xmin) - xmin + greatest(y, ymin) - ymin AS reach, x + 20 - xmin AS past_x, y + 20 - ymin AS past_y FROM people, boxes)
    SELECT user_id, region_id, past_x > 0 AND past_y > 0 AND reach < 250 AS inside, NOT (past_x > 0 AND past_y > 0 AND reach < 250) AS touches
    FROM s WHERE past_x >= 0 AND past_y >= 0 AND reach <= 250""",
)
def _(t):
    geom = geo.parts(geo.box_wkt("x", "y", F.col("x") + 20, F.col("y") + 20))
    own = t.people.select(F.col("user_id").alias("shape_id"), geo.directed_edges(geom).alias("edges"), geo.bounds(geom).alias("box"))
    return cells.polygons_meeting(own, t.wedges).withColumnRenamed("shape_id", "user_id")


@query(
    "records_in_regions",
    "G1 G2 G8 job:combined_tenant_records",
    f"""WITH {_CLIPPED}
    SELECT 'line:' || user_id AS shape_id, region_id FROM r WHERE inside
    UNION ALL SELECT 'point:' || p.user_id, b.region_id FROM people p JOIN boxes b ON {IN_WEDGE.format(p='p')}
    UNION ALL SELECT 'polygon:' || user_id, region_id FROM people, boxes WHERE x + 20 > xmin AND y + 20 > ymin AND greatest(x, xmin) - xmin + greatest(y, ymin) - ymin < 250""",
)
def _(t):
    def named(kind, df):
        return df.select(F.concat(F.lit(f"{kind}:"), F.col("user_id")).alias("shape_id"), geo.parts("wkt").alias("geom"))

    people = t.people
    points = people.select("user_id", geo.point_wkt("x", "y").alias("wkt"))
    polygons = people.select("user_id", geo.box_wkt("x", "y", F.col("x") + 20, F.col("y") + 20).alias("wkt"))
    shapes = named("line", _lines(t)).unionByName(named("point", points)).unionByName(named("polygon", polygons))
    return sites.records_in_regions(shapes, t.wedges)


@query(
    "points_around_holes",
    "G2 G8",
    """SELECT p.user_id, b.region_id FROM people p JOIN boxes b ON p.x BETWEEN xmin AND xmax AND p.y BETWEEN ymin AND ymax
    WHERE NOT (p.x > xmin + 50 AND p.x < xmin + 150 AND p.y > ymin + 50 AND p.y < ymin + 200 AND (p.x - xmin - 50) * 150 + (p.y - ymin - 50) * 100 < 15000)""",
)
def _(t):
    x, y = F.col("xmin"), F.col("ymin")
    ring = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d),(%d %d,%d %d,%d %d,%d %d))", x, y, x + 250, y, x + 250, y + 250, x, y + 250, x, y, x + 50, y + 50, x + 150, y + 50, x + 50, y + 200, x + 50, y + 50)
    regions = spatial.shapes(t.boxes.select("region_id", ring.alias("wkt")), "wkt", "region_id")
    return spatial.tag_points(t.people.select("user_id", "x", "y"), regions).select("user_id", "region_id")


@query(
    "united_boundaries",
    "G7 J7",
    """WITH c AS (SELECT DISTINCT parent_id % 3 AS g, x + i AS cx, y + j AS cy FROM places, range(0, 80) AS a(i), range(0, 80) AS b(j)),
    n AS (SELECT c.g, (w.g IS NULL)::INT + (e.g IS NULL)::INT + (s.g IS NULL)::INT + (o.g IS NULL)::INT AS open FROM c
      LEFT JOIN c w ON w.g = c.g AND w.cx = c.cx - 1 AND w.cy = c.cy LEFT JOIN c e ON e.g = c.g AND e.cx = c.cx + 1 AND e.cy = c.cy
      LEFT JOIN c s ON s.g = c.g AND s.cx = c.cx AND s.cy = c.cy - 1 LEFT JOIN c o ON o.g = c.g AND o.cx = c.cx AND o.cy = c.cy + 1)
    SELECT CAST(g AS BIGINT) AS place_id, count(*)::DOUBLE AS area, sum(open)::DOUBLE AS outline FROM n GROUP BY 1""",
)
def _(t):
    """Areas and outlines of unions of squares, against counts of unit squares."""
    square = geo.box_wkt("x", "y", F.col("x") + 80, F.col("y") + 80)
    children = t.places.select("place_id", (F.col("parent_id") % 3).cast("long").alias("parent_id"), square.alias("geom"))
    tops = children.select(F.col("parent_id").alias("place_id")).distinct()
    return sites.united_boundaries(tops, children).select("place_id", F.round("area", 6).alias("area"), F.round("outline", 6).alias("outline"))


@query(
    "transect_lines",
    "G7 G6 G5",
    f"""WITH steps AS (SELECT DISTINCT CAST(parent_id AS BIGINT) AS parent_id, y // 10 AS row, x // 10 + i AS col FROM places, range(0, 30) AS r(i)),
    pts AS (SELECT parent_id * 100000000 + row * 100000 + col * 10 AS id, k, -200000 + 100 * (col + k) AS mx, 6800000 + 100 * row AS my FROM steps, range(0, 2) AS r(k)), {grid_sql("pts")}
    SELECT CAST(a.id // 100000000 AS BIGINT) AS place_id, round(sum(sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2)), 2) AS length_m
    FROM grid a JOIN grid b ON a.id = b.id AND a.k = 0 AND b.k = 1 GROUP BY 1""",
)
def _(t):
    """Overlapping level sections of 3 km: what several share is measured once. The twin adds up steps of 100 m."""
    x, y = F.floor(F.col("x") / 10) * 100 - 200000, F.floor(F.col("y") / 10) * 100 + 6800000
    points = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat((x + i * 100).cast("long").cast("string"), F.lit(" "), y.cast("long").cast("string"))), ",")
    children = t.places.select("place_id", F.col("parent_id").cast("long").alias("parent_id"), F.concat(F.lit("LINESTRING("), points, F.lit(")")).alias("geom"))
    tops = children.select(F.col("parent_id").alias("place_id")).distinct()
    return sites.transect_lines(tops, children).select("place_id", F.round("length_m", 2).alias("length_m"))


@query(
    "info_at_point",
    "G3 U1 job:near_points",
    f"""WITH c AS (SELECT region_id AS point_id, xmin + 125 AS px, ymin + 125 AS py FROM boxes),
    l AS (SELECT user_id, x, y, {_DX} AS dx, {_DY} AS dy FROM people),
    n AS (SELECT point_id, px, py, user_id, x, y, dx, dy, greatest(0.0, least(1.0, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy)::DOUBLE)) AS k FROM c, l)
    SELECT point_id, 'sample:' || user_id AS id, 'Survey effort' AS event, round(sqrt((px - x - k * dx) ** 2 + (py - y - k * dy) ** 2), 6) AS distance, '2001-01-01' AS sort_date
      FROM n WHERE (px - x - k * dx) ** 2 + (py - y - k * dy) ** 2 <= 900
    UNION ALL SELECT point_id, 'occurrence:' || visit_id, 'Visit ' || priority, round(sqrt((px - x) ** 2 + (py - y) ** 2), 6), strftime(date_start, '%Y-%m-%d') FROM c, visits
      WHERE (px - x) ** 2 + (py - y) ** 2 <= 900
    UNION ALL SELECT point_id, 'treatment:' || place_id, 'Treatment of ' || place_name,
      round(sqrt(greatest(x - px, 0, px - x - 40) ** 2 + greatest(y - py, 0, py - y - 40) ** 2), 6), '2001-02-01' FROM c, places
      WHERE greatest(x - px, 0, px - x - 40) ** 2 + greatest(y - py, 0, py - y - 40) ** 2 <= 900""",
)
def _(t):
    clicks = t.boxes.select(F.col("region_id").alias("point_id"), (F.col("xmin") + 125).alias("x"), (F.col("ymin") + 125).alias("y"))
    day = lambda d: F.lit(d).cast("date").alias("sort_date")
    efforts = _lines(t).select(F.col("user_id").alias("event_id"), F.lit("Survey effort").alias("event"), geo.parts("wkt").alias("geom"), day("2001-01-01"))
    finds = t.visits.select(F.col("visit_id").alias("event_id"), F.concat(F.lit("Visit "), F.col("priority")).alias("event"), geo.parts(geo.point_wkt("x", "y")).alias("geom"), F.col("date_start").alias("sort_date"))
    square = geo.box_wkt("x", "y", F.col("x") + 40, F.col("y") + 40)
    works = t.places.select(F.col("place_id").alias("event_id"), F.concat(F.lit("Treatment of "), F.col("place_name")).alias("event"), geo.parts(square).alias("geom"), day("2001-02-01"))
    found = sites.info_at_point(clicks, {"sample": efforts, "occurrence": finds, "treatment": works}, 30)
    return found.withColumn("distance", F.round("distance", 6))


def _lonlat(x, y):
    text = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(21,6)) AS VARCHAR), '0'), '.')"
    return f"{text.format(f'degrees(({x}) / 6378137.0)')} || ' ' || {text.format(f'degrees(2 * atan(exp(({y}) / 6378137.0)) - pi() / 2)')}"


_X, _Y = "(x * 100 - 200000)", "(y * 100 + 6800000)"


@query(
    "geometries_in_degrees",
    "G6 S2 G8",
    f"""SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'POINT(' || {_lonlat(_X, _Y)} || ')'
      WHEN 1 THEN 'MULTILINESTRING((' || {_lonlat(_X, _Y)} || ',' || {_lonlat(_X + ' + 500', _Y)} || '),(' || {_lonlat(_X, _Y + ' + 90')} || ',' || {_lonlat(_X + ' + 70', _Y + ' + 700')} || '))'
      ELSE 'POLYGON((' || {_lonlat(_X, _Y)} || ',' || {_lonlat(_X + ' + 900', _Y)} || ',' || {_lonlat(_X, _Y + ' + 900')} || ',' || {_lonlat(_X, _Y)} || '),('
        || {_lonlat(_X + ' + 100', _Y + ' + 100')} || ',' || {_lonlat(_X + ' + 200', _Y + ' + 100')} || ',' || {_lonlat(_X + ' + 100', _Y + ' + 200')} || ',' || {_lonlat(_X + ' + 100', _Y + ' + 100')} || '))' END AS geom FROM people""",
)
def _(t):
    x, y, k = F.col("x") * 100 - 200000, F.col("y") * 100 + 6800000, F.col("user_id") % 3
    lines = F.format_string("MULTILINESTRING((%d %d,%d %d),(%d %d,%d %d))", x, y, x + 500, y, x, y + 90, x + 70, y + 700)
    area = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d),(%d %d,%d %d,%d %d,%d %d))", x, y, x + 900, y, x, y + 900, x, y, x + 100, y + 100, x + 200, y + 100, x + 100, y + 200, x + 100, y + 100)
    shape = F.when(k == 0, F.format_string("POINT(%d %d)", x, y)).when(k == 1, lines).otherwise(area)
    return exports.gis_export(t.people.select("user_id", shape.alias("geom"))).select("user_id", "geom")


@query(
    "generalised_outlines",
    "G7 G4 S2",
    """WITH z AS (SELECT user_id, x * 10 AS a, y * 10 AS b, user_id % 8 AS h FROM people)
    SELECT user_id, 'POLYGON((' || round_even(a / 5.0, 0)::BIGINT * 5 || ' ' || round_even(b / 5.0, 0)::BIGINT * 5
      || CASE WHEN h > 4 THEN ',' || round_even((a + 50) / 5.0, 0)::BIGINT * 5 || ' ' || round_even((b - h) / 5.0, 0)::BIGINT * 5 ELSE '' END
      || ',' || round_even((a + 100) / 5.0, 0)::BIGINT * 5 || ' ' || round_even(b / 5.0, 0)::BIGINT * 5
      || ',' || round_even((a + 100) / 5.0, 0)::BIGINT * 5 || ' ' || round_even((b + 80) / 5.0, 0)::BIGINT * 5
      || ',' || round_even(a / 5.0, 0)::BIGINT * 5 || ' ' || round_even((b + 80) / 5.0, 0)::BIGINT * 5
      || ',' || round_even(a / 5.0, 0)::BIGINT * 5 || ' ' || round_even(b / 5.0, 0)::BIGINT * 5 || '))' AS geom FROM z""",
)
def _(t):
    """Rectangles with a bump of height 0 to 7 in the lower side, thinned at 4, set on a grid of 5 and written."""
    a, b, h = F.col("x") * 10, F.col("y") * 10, F.col("user_id") % 8
    shape = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d,%d %d))", a, b, a + 50, b - h, a + 100, b, a + 100, b + 80, a, b + 80, a, b)
    thin = t.people.select("user_id", simplified(geo.parts(shape), F.lit(4.0)).alias("g"))
    return thin.select("user_id", geo.parts_wkt(geo.snap_parts("g", 5), F.lit("POLYGON")).alias("geom"))
