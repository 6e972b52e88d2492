"""Listings with work of their own, next to their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans import awards, listings
from .registry import query


@query(
    "walk_counts",
    "job:filtered_listing J4 A9 A3",
    """WITH v AS (SELECT user_id AS visit_id, user_name AS walker FROM people), c AS (SELECT visit_id AS child_id, user_id AS visit_id FROM visits),
    x AS (SELECT taxon_id, taxon_id // 3 AS taxon_meaning_id, CASE WHEN rank_order % 2 = 0 THEN family END AS common, name AS preferred FROM taxa WHERE rank_order < 40),
    s AS (SELECT c.visit_id, x.taxon_meaning_id, coalesce(x.common, x.preferred) AS common, x.preferred FROM c JOIN records r ON r.visit_id = c.child_id JOIN x USING (taxon_id)),
    m AS (SELECT c.visit_id, CAST(round(avg(floor(v.total / 1000))) AS BIGINT) AS mean_value FROM c JOIN visits v ON v.visit_id = c.child_id GROUP BY 1)
    SELECT v.visit_id, v.walker, s.taxon_meaning_id, s.common, s.preferred, m.mean_value FROM v LEFT JOIN s USING (visit_id) LEFT JOIN m USING (visit_id)""",
)
def _(t):
    walks = t.people.select(F.col("user_id").alias("visit_id"), F.col("user_name").alias("walker"))
    children = t.visits.select(F.col("visit_id").alias("child_id"), F.col("user_id").alias("visit_id"))
    common = F.when(F.col("rank_order") % 2 == 0, F.col("family"))
    taxa = t.taxa.where("rank_order < 40").select("taxon_id", F.floor(F.col("taxon_id") / 3).alias("taxon_meaning_id"), common.alias("common"), F.col("name").alias("preferred"))
    values = t.visits.select(F.col("visit_id").alias("child_id"), F.floor(F.col("total") / 1000).alias("value"))
    return listings.walk_counts(walks, children, t.records.select(F.col("visit_id").alias("child_id"), "taxon_id"), taxa, values)


@query(
    "measured_points",
    "job:filtered_listing A4 A3 J7 E1",
    """WITH p AS (SELECT place_id, place_name, CASE WHEN place_id % 7 > 0 THEN place_id // 7 * 7 END AS parent_id FROM places),
    q AS (SELECT visit_id, string_agg(CAST(CAST(quantity AS BIGINT) AS VARCHAR), ', ' ORDER BY quantity) AS vals, round(avg(CAST(quantity AS BIGINT)), 1) AS mean_value FROM records GROUP BY 1)
    SELECT v.user_id AS parent_visit_id, v.visit_id, p.parent_id AS site_id, s.place_name AS site, n.parent_name AS "group", v.place_id, p.place_name AS point, q.vals AS "values", q.mean_value
    FROM visits v LEFT JOIN p ON p.place_id = v.place_id LEFT JOIN p s ON s.place_id = p.parent_id LEFT JOIN parents n ON n.parent_id = v.place_id LEFT JOIN q ON q.visit_id = v.visit_id""",
)
def _(t):
    k = F.col("place_id")
    places = t.places.select("place_id", "place_name", F.when(k % 7 > 0, F.floor(k / 7) * 7).alias("parent_id"))
    groups = t.parents.select(F.col("parent_id").alias("place_id"), F.col("parent_name").alias("group"))
    visits = t.visits.select("visit_id", F.col("user_id").alias("parent_visit_id"), "place_id")
    return listings.measured_points(visits, places, groups, t.records.select("visit_id", F.col("quantity").cast("long").alias("value")))


@query(
    "projects_of_countries",
    "job:filtered_listing J12 E1 E3",
    """WITH terms AS (SELECT taxon_id AS term_id, taxon_id // 3 AS meaning_id, name AS term, taxon_id % 3 = 0 AS preferred FROM taxa),
    links AS (SELECT place_id AS id, place_id * 2 AS term_id FROM places)
    SELECT p.place_id AS id, p.place_name AS name, a.term AS country_name, b.term AS country_code, CASE WHEN p.balance > 0 THEN 'https://example.org/' || p.place_id END AS url
    FROM places p JOIN links l ON l.id = p.place_id JOIN terms t ON t.term_id = l.term_id JOIN terms a ON a.meaning_id = t.meaning_id AND a.preferred
    JOIN terms b ON b.meaning_id = t.meaning_id AND NOT b.preferred""",
)
def _(t):
    k = F.col("taxon_id")
    terms = t.taxa.select(k.alias("term_id"), F.floor(k / 3).alias("meaning_id"), F.col("name").alias("term"), (k % 3 == 0).alias("preferred"))
    projects = t.places.select(F.col("place_id").alias("id"), F.col("place_name").alias("name"))
    links = t.places.select(F.col("place_id").alias("id"), (F.col("place_id") * 2).alias("term_id"))
    urls = t.places.where("balance > 0").select(F.col("place_id").alias("id"), F.concat(F.lit("https://example.org/"), "place_id").alias("url"))
    return listings.projects_of_countries(projects, links, terms, urls)


@query(
    "results_on_map",
    "job:filtered_listing C4 A1",
    """SELECT visit_id, 'POINT(' || x || ' ' || y || ')' AS geom, CASE record_status WHEN 'R' THEN '#800000' ELSE 'black' END AS stroke,
    CASE record_status WHEN 'R' THEN '#800000' ELSE 'blue' END AS fill, round(0.2 + sqrt(count(*) - 1) / 20, 9)::DOUBLE AS opacity FROM records GROUP BY visit_id, record_status, x, y""",
)
def _(t):
    out = listings.results_on_map(t.records.select("visit_id", "record_status", geo.point_wkt("x", "y").alias("geom")))
    return out.withColumn("opacity", F.round("opacity", 9))


@query(
    "assigned_sites",
    "job:filtered_listing E1 J6",
    """SELECT DISTINCT p.place_id, v.user_id, p.place_name FROM visits v JOIN places p USING (place_id) WHERE v.priority IN ('1-URGENT', '2-HIGH')
    AND EXISTS (SELECT 1 FROM visits f WHERE f.place_id = p.place_id AND f.status = 'P')""",
)
def _(t):
    given = t.visits.select("place_id", F.substring("priority", 1, 1).cast("int").alias("attribute_id"), F.col("user_id").cast("long").alias("value"))
    flag = F.when(F.col("visit_id") > 0, 256).otherwise(0)
    flags = t.visits.where("status = 'P'").select("place_id", flag.alias("attribute_id"), F.lit(1).cast("long").alias("value"))
    attributes = t.spark.createDataFrame([(1, "CMS User ID"), (2, "CMS User ID"), (3, "Owner"), (4, "Owner"), (5, None)], "attribute_id int, caption string")
    return listings.assigned_sites(t.places, given.unionByName(flags), attributes, "CMS User ID", 256).withColumnRenamed("value", "user_id")


@query(
    "country_levels",
    "job:filtered_listing J7 J2",
    """SELECT CAST(r.r_regionkey AS BIGINT) AS country_id, r.r_name AS country, CAST(1000 + n.parent_id AS BIGINT) AS region_id, n.parent_name AS region, CAST(100000 + p.place_id AS BIGINT) AS part_id, p.place_name AS part
    FROM region r LEFT JOIN parents n ON n.region_id = r.r_regionkey LEFT JOIN places p ON p.parent_id = n.parent_id""",
)
def _(t):
    countries = t.region.select(F.col("r_regionkey").cast("long").alias("place_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("place_name"))
    regions = t.parents.select((F.col("parent_id") + 1000).cast("long").alias("place_id"), F.col("region_id").cast("long").alias("parent_id"), F.col("parent_name").alias("place_name"))
    parts = t.places.select((F.col("place_id") + 100000).cast("long").alias("place_id"), (F.col("parent_id") + 1000).cast("long").alias("parent_id"), "place_name")
    return listings.country_levels(countries.unionByName(regions).unionByName(parts), F.col("parent_id").isNull())


@query(
    "walks_of_users",
    "job:filtered_listing J8 U1",
    """WITH a AS (SELECT DISTINCT user_id, place_id FROM visits WHERE priority = '1-URGENT' AND date_start >= DATE '2001-01-01')
    SELECT user_id, visit_id, user_id AS created_by, place_id FROM visits UNION SELECT a.user_id, v.visit_id, v.user_id, v.place_id FROM a JOIN visits v USING (place_id)""",
)
def _(t):
    visits = t.visits.select("visit_id", F.col("user_id").alias("created_by"), "place_id")
    allocations = t.visits.where("priority = '1-URGENT' AND date_start >= DATE '2001-01-01'").select("user_id", F.col("place_id").alias("site_id"))
    return listings.walks_of_users(visits, allocations)


@query(
    "import_history",
    "job:filtered_listing C4 C5 F2",
    """SELECT visit_id AS import_id, place_id % 5 AS website_id, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS inserted, user_id % 2 AS updated,
    coalesce(CASE WHEN user_id % 3 > 0 THEN user_id % 3 END, 0) + user_id % 2 AS rows, CASE place_id % 5 WHEN 0 THEN 'Main' WHEN 1 THEN 'App' ELSE CAST(place_id % 5 AS VARCHAR) END AS site
    FROM visits WHERE user_id % 3 > 0 OR user_id % 2 > 0""",
)
def _(t):
    u = F.col("user_id")
    imports = t.visits.select(F.col("visit_id").alias("import_id"), (F.col("place_id") % 5).alias("website_id"), F.when(u % 3 > 0, u % 3).alias("inserted"), (u % 2).alias("updated"))
    return listings.import_history(imports, {0: "Main", 1: "App"}, hide_empty=True)


@query(
    "plots_of_groups",
    "job:filtered_listing E1 J1 A1",
    """WITH k AS (SELECT place_id, place_name, parent_id AS group_id, count(*) OVER (PARTITION BY parent_id) AS plots_in_group FROM places)
    SELECT p.user_id, k.group_id, k.place_id, k.place_name, k.plots_in_group FROM people p JOIN k ON k.group_id = p.nation_id""",
)
def _(t):
    members = t.people.select("user_id", F.col("nation_id").alias("group_id"))
    return listings.plots_of_groups(members, t.places.select("place_id", F.col("parent_id").alias("group_id")), t.places)


@query(
    "requested_visits",
    "job:filtered_listing F2 F9 J8",
    """SELECT visit_id, status FROM visits WHERE status = 'P' OR visit_id IN (SELECT visit_id FROM records WHERE record_status = 'R' AND substatus = 'F')""",
)
def _(t):
    packs = t.records.select(F.col("visit_id").alias("pack_visit_id"), F.when((F.col("record_status") == "R") & (F.col("substatus") == "F"), "P").otherwise("F").alias("pack_state"))
    return listings.requested_visits(t.visits.select("visit_id", "status"), packs, "P")


#: Visits in trees of two levels, as the listings of child visits see them.
TREE_SQL = "(SELECT *, CASE WHEN visit_id % 4 > 0 THEN visit_id - visit_id % 4 END AS up_id FROM visits)"


def tree(t):
    v = F.col("visit_id")
    return t.visits.withColumn("up_id", F.when(v % 4 > 0, v - v % 4))


@query(
    "activity_visits",
    "job:filtered_listing J7 J8 A1",
    f"""WITH v AS {TREE_SQL}, n AS (SELECT coalesce(v.up_id, v.visit_id) AS visit_id, count(*) AS n FROM records r JOIN v USING (visit_id) WHERE r.quantity > 5 GROUP BY 1)
    SELECT v.visit_id, v.user_id, v.place_id AS group_id, strftime(v.date_start, '%Y-%m-%d') AS date_start, CAST(coalesce(n.n, 0) AS BIGINT) AS sightings FROM v LEFT JOIN n USING (visit_id) WHERE v.up_id IS NULL""",
)
def _(t):
    visits = tree(t).withColumnsRenamed({"up_id": "parent_id", "place_id": "group_id"})
    return listings.activity_visits(visits, t.records.select("visit_id", (F.col("quantity") <= 5).alias("zero_abundance")))


_HABITATS = "(1, 'Heath'), (2, 'Wood'), (3, 'Mire'), (4, 'Coast'), (6, 'Urban')"
_DOWNLOAD = f"""WITH h AS (SELECT DISTINCT a.visit_id, n.term FROM (SELECT visit_id, CAST(substr(priority, 1, 1) AS INTEGER) AS term_id FROM visits WHERE visit_id % 2 = 0
      UNION ALL SELECT visit_id, 6 FROM visits WHERE visit_id % 3 = 0) a LEFT JOIN (VALUES {_HABITATS}) n(term_id, term) USING (term_id)),
    x AS (SELECT taxon_id, CASE taxon_id % 5 WHEN 0 THEN 'Plantae' WHEN 1 THEN 'Fungi' WHEN 2 THEN 'Animalia' END AS kingdom, taxon_group AS order_taxon, family, name FROM taxa),
    d AS (SELECT r.record_id, coalesce(p.place_name, 'near ' || r.visit_id) AS site, x.kingdom, x.order_taxon, x.family, x.name, s.habitat FROM records r JOIN x USING (taxon_id)
      LEFT JOIN (SELECT * FROM places WHERE place_id % 3 > 0) p ON p.place_id = r.place_id LEFT JOIN (SELECT visit_id, {{habitat}} AS habitat FROM h {{group}}) s ON s.visit_id = r.visit_id)
    SELECT *, row_number() OVER (ORDER BY coalesce(kingdom IN ('Plantae', 'Fungi', 'Chromista'), false) DESC, order_taxon, family, name, record_id, site, kingdom NULLS LAST, habitat NULLS LAST) AS row_no FROM d"""


def download_of(t, per_habitat):
    k, v = F.col("taxon_id") % 5, F.col("visit_id")
    kingdom = F.when(k == 0, "Plantae").when(k == 1, "Fungi").when(k == 2, "Animalia")
    taxa = t.taxa.select("taxon_id", kingdom.alias("kingdom"), F.col("taxon_group").alias("order_taxon"), "family", "name")
    records = t.records.select("record_id", "visit_id", "taxon_id", "place_id", F.concat(F.lit("near "), v.cast("string")).alias("site_text"))
    first = t.visits.where(v % 2 == 0).select("visit_id", F.substring("priority", 1, 1).cast("int").alias("term_id"))
    second = t.visits.where(v % 3 == 0).select("visit_id", F.lit(6).alias("term_id"))
    terms = t.spark.createDataFrame([(1, "Heath"), (2, "Wood"), (3, "Mire"), (4, "Coast"), (6, "Urban")], "term_id int, term string")
    return listings.taxonomy_download(records, taxa, t.places.where("place_id % 3 > 0"), first.unionByName(second), terms, per_habitat)


@query("taxonomy_download", "job:filtered_listing O1 A4 E3 S2", _DOWNLOAD.format(habitat="string_agg(term, ', ' ORDER BY term)", group="GROUP BY visit_id"))
def _(t):
    return download_of(t, False)


@query("habitat_download", "job:filtered_listing O1 E3 S2", _DOWNLOAD.format(habitat="term", group=""))
def _(t):
    return download_of(t, True)


@query(
    "site_sections",
    "job:filtered_listing J7 C1 S2",
    """WITH s AS (SELECT *, CASE WHEN parent_id % 2 = 0 THEN 'C' || parent_id END AS site_code, CASE WHEN region_id < 3 THEN 'Transect' WHEN region_id = 3 THEN 'Trap' END AS site_type FROM parents),
    c AS (SELECT *, CASE WHEN place_id % 4 > 0 THEN 'S' || place_id END AS section_code FROM places)
    SELECT s.parent_id AS site_id, s.parent_name AS site_name, s.site_code, s.site_type, c.place_id AS section_id, c.place_name AS section_name, c.section_code,
    coalesce(s.site_code, s.parent_name) || '.' || substr(c.section_code, 2) AS unique_code FROM s JOIN c ON c.parent_id = s.parent_id WHERE s.site_type IS NOT NULL""",
)
def _(t):
    p, k = F.col("parent_id"), F.col("place_id")
    sites = t.parents.select(p.alias("site_id"), F.col("parent_name").alias("site_name"), F.when(p % 2 == 0, F.concat(F.lit("C"), p.cast("string"))).alias("site_code"), F.col("region_id").alias("type_id"))
    sections = t.places.select(k.alias("section_id"), "parent_id", F.col("place_name").alias("section_name"), F.when(k % 4 > 0, F.concat(F.lit("S"), k.cast("string"))).alias("section_code"))
    types = t.region.where("r_regionkey < 4").select(F.col("r_regionkey").alias("type_id"), F.when(F.col("r_regionkey") < 3, "Transect").otherwise("Trap").alias("site_type"))
    return listings.site_sections(sites, sections, types)


@query(
    "app_sites",
    "job:filtered_listing E1 J6 J1",
    """SELECT p.place_id, v.user_id, CAST(p.place_id % 9 AS BIGINT) AS sections, p.place_name FROM visits v JOIN places p USING (place_id)
    WHERE v.priority IN ('1-URGENT', '3-MEDIUM') AND p.place_id % 9 < 8""",
)
def _(t):
    owners = t.visits.select("place_id", F.substring("priority", 1, 1).cast("int").alias("attribute_id"), F.col("user_id").alias("value"))
    counts = t.places.select("place_id", F.when(F.col("place_id") % 9 < 8, 7).otherwise(8).alias("attribute_id"), (F.col("place_id") % 9).cast("long").alias("value"))
    captions = [(1, "CMS User ID"), (2, "CMS User ID"), (3, "CMS User ID"), (4, "Owner"), (7, "No. of sections"), (8, "No. of sections")]
    attributes = t.spark.createDataFrame(captions, "attribute_id int, caption string")
    used = t.spark.createDataFrame([(1, 5), (1, 5), (3, 5), (2, 6), (4, 5), (7, 5), (8, 6)], "attribute_id int, website_id int")
    return listings.app_sites(t.places, owners.unionByName(counts), attributes, used, 5, "CMS User ID", "No. of sections")


@query(
    "landscape_values",
    "job:filtered_listing E1 F6",
    """SELECT r.visit_id, n.name, CAST(r.quantity AS BIGINT) - 10 AS value FROM records r JOIN (VALUES (0, 'LandCover_wood'), (1, 'Crop_wheat'), (2, 'Crop_%')) n(id, name) ON n.id = r.taxon_id % 5
    WHERE r.quantity <> 10""",
)
def _(t):
    values = t.records.select("visit_id", (F.col("taxon_id") % 5).alias("attribute_id"), (F.col("quantity").cast("long") - 10).alias("value"))
    captions = [(0, "LandCover_wood"), (1, "Crop_wheat"), (2, "Crop_%"), (3, "Cropped"), (4, "Landscape")]
    return listings.landscape_values(values, t.spark.createDataFrame(captions, "attribute_id int, caption string"), ["LandCover_", "Crop_"])


_WORKFLOW = "(1, 'Pack requested', 10), (2, 'Pack sent', 20), (3, 'Sample received', 30), (4, 'Results added', 40), (5, 'Species added', 50)"


@query(
    "workflow_visits",
    "job:filtered_listing F1 E3 C2 C4",
    f"""WITH s AS (SELECT visit_id, CAST(substr(priority, 1, 1) AS INTEGER) AS term_id FROM visits WHERE visit_id % 3 > 0)
    SELECT v.visit_id, v.user_id, n.term AS workflow_status, CASE v.status WHEN 'O' THEN 'Incomplete' WHEN 'F' THEN 'Complete' END AS data_entry, strftime(v.date_start, '%d/%m/%Y') AS created,
    coalesce(n.place >= 40, false) AS results_ready FROM visits v LEFT JOIN s USING (visit_id) LEFT JOIN (VALUES {_WORKFLOW}) n(term_id, term, place) USING (term_id)""",
)
def _(t):
    states = {"O": "I", "F": "C"}
    visits = t.visits.select("visit_id", "user_id", F.replace(F.replace("status", F.lit("F"), F.lit(states["F"])), F.lit("O"), F.lit(states["O"])).alias("status"), F.col("date_start").alias("created_on"))
    values = t.visits.where("visit_id % 3 > 0").select("visit_id", F.substring("priority", 1, 1).cast("int").alias("term_id"))
    terms = [(1, "Pack requested", 10), (2, "Pack sent", 20), (3, "Sample received", 30), (4, "Results added", 40), (5, "Species added", 50)]
    return listings.workflow_visits(visits, values, t.spark.createDataFrame(terms, "term_id int, term string, sort_order int"))


@query(
    "packs_by_state",
    "job:filtered_listing F2 F9 J5 J6",
    """WITH k AS (SELECT DISTINCT visit_id FROM records WHERE record_status = 'R')
    SELECT 0 AS pack_state, visit_id, status FROM visits WHERE status = 'F' AND visit_id NOT IN (SELECT visit_id FROM k)
    UNION ALL SELECT 2, visit_id, status FROM visits WHERE status = 'F' AND visit_id IN (SELECT visit_id FROM records WHERE record_status = 'R' AND quantity % 5 = 2)""",
)
def _(t):
    visits = t.visits.select("visit_id", "status")
    values = t.records.select("visit_id", F.when(F.col("record_status") == "R", F.col("quantity").cast("int") % 5).alias("value"))
    values = values.withColumn("value", F.when(F.col("value") == 0, 5).otherwise(F.col("value")))
    one = lambda state: listings.packs_by_state(visits, values, "F", state).select(F.lit(state).alias("pack_state"), "visit_id", "status")
    return one(0).unionByName(one(2))


@query(
    "transect_visits",
    "job:filtered_listing J7 E2 C1 C5",
    f"""WITH v AS {TREE_SQL}, p AS (SELECT c.place_id, c.place_name, coalesce(s.place_name || ' - ', '') || c.place_name AS label FROM (SELECT *, CASE WHEN place_id % 7 > 0 THEN place_id // 7 * 7 END AS above FROM places) c
      LEFT JOIN places s ON s.place_id = c.above)
    SELECT v.up_id AS parent_id, v.visit_id, p.label AS site, u.place_name AS transect, CASE WHEN v.visit_id % 3 > 0 THEN v.user_id % 50 + 0.5 ELSE 0 END::DOUBLE AS slope_distance
    FROM v LEFT JOIN p ON p.place_id = v.place_id LEFT JOIN visits a ON a.visit_id = v.up_id LEFT JOIN places u ON u.place_id = a.place_id WHERE v.up_id IS NOT NULL""",
)
def _(t):
    k = F.col("place_id")
    places = t.places.select("place_id", "place_name", F.when(k % 7 > 0, F.floor(k / 7) * 7).alias("parent_id"))
    text = F.concat(F.lit('{"1497": "'), (F.col("user_id") % 50).cast("string"), F.lit('.5", "1": "7"}'))
    visits = tree(t).select("visit_id", F.col("up_id").alias("parent_id"), "place_id", F.when(F.col("visit_id") % 3 > 0, text).otherwise('{"1497": "none"}').alias("attrs"))
    return listings.transect_visits(visits, places, 1497)


@query(
    "sites_download",
    "job:filtered_listing G2 E3 S2",
    """SELECT p.place_id, p.place_name, n.parent_name AS site_type, p.x, p.y FROM places p JOIN parents n USING (parent_id)
    WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.region_id IN (0, 1, 7) AND p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax)""",
)
def _(t):
    places = t.places.withColumnRenamed("parent_id", "type_id")
    types = t.parents.select(F.col("parent_id").alias("type_id"), F.col("parent_name").alias("site_type"))
    return listings.sites_download(places, types, t.regions.where("region_id IN (0, 1, 7)"))


@query(
    "treatments",
    "job:filtered_listing J12 C1 C5",
    """SELECT v.visit_id, p.user_name || coalesce(', ' || CASE WHEN p.user_id % 3 > 0 THEN p.role END, '') AS input_by, 'Spraying' AS method FROM visits v JOIN people p USING (user_id)
    WHERE substr(v.priority, 1, 1) IN ('1', '2', '3')""",
)
def _(t):
    visits = t.visits.select("visit_id", "user_id", F.substring("priority", 1, 1).cast("int").alias("method_id"))
    people = t.people.select("user_id", F.col("user_name").alias("surname"), F.when(F.col("user_id") % 3 > 0, F.col("role")).alias("first_name"))
    names = [(1, 1, "Spraying", True), (2, 1, "Chwistrellu", False), (3, 1, "Spray", False), (4, 2, "Cutting", True), (5, 2, "Torri", False)]
    methods = t.spark.createDataFrame(names, "id int, meaning_id int, name string, preferred boolean")
    return listings.treatments(visits, people, methods, "Chwistrellu")


@query(
    "latlon_labels",
    "G6 C1",
    """SELECT visit_id, printf('%.3f', abs(x - 500) / 8.0) || CASE WHEN x < 500 THEN 'S' ELSE 'N' END || ', ' || printf('%.3f', abs(y - 500) / 8.0) || CASE WHEN y < 500 THEN 'W' ELSE 'E' END AS label FROM visits""",
)
def _(t):
    return t.visits.select("visit_id", geo.latlon_text((F.col("x") - 500) / 8, (F.col("y") - 500) / 8, 3).alias("label"))


@query(
    "source_labels",
    "C1 C4",
    """SELECT taxon_id, CASE taxon_id % 3 WHEN 1 THEN family ELSE family || ' | ' || name END AS label FROM taxa""",
)
def _(t):
    k = F.col("taxon_id") % 3
    survey = F.when(k == 0, F.concat("family", F.lit(" "), "name")).when(k == 1, F.col("family")).otherwise(F.col("name"))
    return t.taxa.select("taxon_id", "family", survey.alias("survey")).select("taxon_id", text.source_label("family", "survey").alias("label"))


@query(
    "changed_badges",
    "job:badges_merge F1",
    """SELECT user_id, count(*) AS metric, strftime(max(date_start), '%Y-%m-%d') AS updated_on FROM visits GROUP BY 1 HAVING max(date_start) > DATE '2001-01-01'""",
)
def _(t):
    held = t.visits.groupBy("user_id").agg(F.count(F.lit(1)).alias("metric"), F.max("date_start").alias("updated_on"))
    return awards.badges_of(held, updated_since="2001-01-01")
