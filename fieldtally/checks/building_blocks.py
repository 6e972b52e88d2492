"""Operators, one or more queries for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as ja
from ..functions import dates, geo, text
from ..operators import aggregate as agg
from ..operators import attributes as eav
from ..operators import filters, generators, hierarchy, joins, ordering, sets, sync, windows
from ..session import scratch_path
from ..sources import cursor, sinks
from .registry import query

# ---- scans, sources, sinks -----------------------------------------------------------


@query(
    "live_scan",
    "S1",
    "SELECT visit_id, user_id, total FROM visits WHERE status <> 'P'",
)
def _(t):
    flagged = t.visits.withColumn("deleted", F.col("status") == "P")
    return filters.live(flagged).select("visit_id", "user_id", "total")


@query(
    "nested_document_export",
    "S2",
    """SELECT '{"place_id":' || place_id || ',"place_name":"' || place_name || '","x":' || x || ',"y":' || y || '}' AS doc
    FROM places""",
)
def _(t):
    return sinks.as_document(t.places.select("place_id", "place_name", "x", "y"))


@query(
    "geojson_features",
    "S2 G6",
    """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || '.0,' || y || '.0]},"properties":{"user_id":'
    || user_id || ',"role":"' || role || '"}}' AS "value" FROM people""",
)
def _(t):
    rows = t.people.select("user_id", "role", geo.point_wkt("x", "y").alias("geom"))
    return sinks.as_features(rows, "geom")


@query(
    "cursor_read",
    "S3",
    """SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)""",
)
def _(t):
    mark = cursor.high_water(t.events, "event_id", 0) // 2
    return cursor.read_since(t.events, "event_id", mark).select("event_id", "user_id", "event_type")


@query(
    "table_version_swap",
    "S6",
    """SELECT taxon_group, count(*) AS taxa, CAST(max(rank_order) AS INTEGER) AS top_rank FROM taxa GROUP BY 1""",
)
def _(t):
    derived = t.taxa.groupBy("taxon_group").agg(F.count(F.lit(1)).alias("taxa"), F.max("rank_order").alias("top_rank"))
    folder = scratch_path(t.spark, "derived")
    sync.rebuild(derived.where(F.lit(False)), "taxa_per_group", "v1", folder)
    return sync.rebuild(derived, "taxa_per_group", "v2", folder)


# ---- filters -------------------------------------------------------------------------


@query(
    "optional_parameters",
    "F1 F9",
    """SELECT visit_id, user_id, priority FROM visits
    WHERE date_start >= DATE '1999-01-01' AND priority IN ('1-URGENT', '2-HIGH') AND total > 100000""",
)
def _(t):
    request = {"from": "1999-01-01", "to": "", "priorities": ["1-URGENT", "2-HIGH"], "status": "all", "total": 100000, "user": 0}
    df = t.visits
    df = filters.opt(df, filters.none_if(request["from"]), lambda v: F.col("date_start") >= dates.as_date(v))
    df = filters.opt(df, filters.none_if(request["to"]), lambda v: F.col("date_start") <= dates.as_date(v))
    df = filters.opt(df, filters.none_if(request["priorities"]), lambda v: filters.one_of("priority", v))
    df = filters.opt(df, filters.none_if(request["status"]), lambda v: F.col("status") == v)
    df = filters.opt(df, filters.none_if(request["total"]), lambda v: F.col("total") > v)
    df = filters.opt(df, filters.none_if(request["user"]), lambda v: F.col("user_id") == v)
    return df.select("visit_id", "user_id", "priority")


@query(
    "value_branch",
    "F2",
    """SELECT user_id, count(*) AS visits FROM visits WHERE year(date_start) = 2000 GROUP BY 1""",
)
def _(t):
    year = F.year("date_start")
    picked = filters.branch(
        t.visits, "last", {"this": lambda d: d.where(year == 2001), "last": lambda d: d.where(year == 2000)}
    )
    return picked.groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"))


AGREEMENTS_SQL = """agreements AS (SELECT a.region_id AS from_website_id, b.region_id AS to_website_id,
  (a.region_id + b.region_id) % 3 = 0 AS receive_for_reporting
  FROM (SELECT DISTINCT region_id FROM parents) a JOIN parents b ON b.parent_id < 5)"""


def agreements(t):
    """Every tenant (region) with every tenant it may hear from, and whether it does."""
    tenant = F.col("r_regionkey")
    others = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda v: v))
    pairs = t.region.select(tenant.alias("from_website_id"), others.alias("to_website_id"))
    return pairs.withColumn("receive_for_reporting", (F.col("from_website_id") + F.col("to_website_id")) % 3 == 0)


@query(
    "tenant_visibility",
    "F3",
    f"""WITH {AGREEMENTS_SQL}
    SELECT p.user_id, n.region_id AS website_id FROM people p JOIN parents n ON n.parent_id = p.nation_id
    WHERE n.region_id = 1 OR n.region_id IN
      (SELECT to_website_id FROM agreements WHERE from_website_id = 1 AND receive_for_reporting)""",
)
def _(t):
    owned = t.people.join(t.parents, F.col("nation_id") == F.col("parent_id")).select(
        "user_id", F.col("region_id").alias("website_id")
    )
    own = t.region.where(F.col("r_regionkey") == 1).select(F.col("r_regionkey").alias("website_id"))
    return filters.visible(owned, own, agreements(t)).select("user_id", "website_id")


@query(
    "masked_email",
    "F4",
    """SELECT user_id, CASE WHEN role = 'BUILDING' OR balance > 5000 THEN user_name || '@example.org' END AS email FROM people""",
)
def _(t):
    shown = (F.col("role") == "BUILDING") | (F.col("balance") > 5000)
    df = t.people.withColumn("email", F.concat("user_name", F.lit("@example.org")))
    return filters.mask(df, "email", shown).select("user_id", "email")


VAGUE_SQL = """vague AS (SELECT visit_id, CASE visit_id % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'DD' WHEN 2 THEN 'Y' ELSE 'O' END AS date_type,
  CASE visit_id % 4 WHEN 2 THEN date_trunc('year', date_start) WHEN 3 THEN date_trunc('month', date_start) ELSE date_start END AS date_start,
  CASE visit_id % 4 WHEN 0 THEN date_start WHEN 1 THEN date_start + 6
    WHEN 2 THEN date_trunc('year', date_start) + INTERVAL 1 YEAR - INTERVAL 1 DAY ELSE last_day(date_start) END AS date_end FROM visits)"""


def vague_visits(t):
    """Visits with a date known to the day, the week, the year or the month."""
    k, d = F.col("visit_id") % 4, F.col("date_start")
    kind = F.when(k == 0, "D").when(k == 1, "DD").when(k == 2, "Y").otherwise("O")
    start = F.when(k == 2, F.trunc(d, "year")).when(k == 3, F.trunc(d, "month")).otherwise(d)
    year_end = F.make_date(F.year(d), F.lit(12), F.lit(31))
    end = F.when(k == 0, d).when(k == 1, F.date_add(d, 6)).when(k == 2, year_end).otherwise(F.last_day(d))
    return t.visits.select("visit_id", kind.alias("date_type"), start.alias("date_start"), end.alias("date_end"))


@query(
    "vague_date_overlap",
    "F5",
    f"""WITH {VAGUE_SQL}
    SELECT visit_id, CASE date_type WHEN 'D' THEN strftime(date_start, '%d/%m/%Y')
      WHEN 'DD' THEN strftime(date_start, '%d/%m/%Y') || ' to ' || strftime(date_end, '%d/%m/%Y')
      WHEN 'O' THEN strftime(date_start, '%m/%Y') ELSE strftime(date_start, '%Y') END AS date_text
    FROM vague WHERE date_end >= DATE '1998-03-10' AND date_start <= DATE '1998-05-20'""",
)
def _(t):
    found = filters.date_overlap(vague_visits(t), "1998-03-10", "1998-05-20")
    return found.select("visit_id", dates.vague_text("date_start", "date_end", "date_type").alias("date_text"))


@query(
    "text_search",
    "F6",
    """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion of')""",
)
def _(t):
    return filters.search(t.documents, ["text"], "Tion OF").select("doc_id", "lang")


@query(
    "prefix_search",
    "F6",
    """SELECT taxon_id, name FROM taxa WHERE starts_with(lower(name), 'red') OR starts_with(lower(family), 'brand#1')""",
)
def _(t):
    by_name = filters.search(t.taxa, ["name"], "Red", "prefix")
    by_family = filters.search(t.taxa, ["family"], "BRAND#1", "prefix")
    return by_name.union(by_family).select("taxon_id", "name").distinct()


@query(
    "squeezed_search",
    "F6 C1",
    """SELECT taxon_id FROM taxa WHERE contains(replace(lower(name || family), ' ', ''), 'boltbrand#2')
       OR contains(replace(lower(family || name), ' ', ''), 'boltbrand#2')""",
)
def _(t):
    both = t.taxa.withColumn("a", F.concat("name", "family")).withColumn("b", F.concat("family", "name"))
    return filters.search(both, ["a", "b"], "Bolt Brand#2", "squeezed").select("taxon_id")


@query(
    "array_membership",
    "F7",
    """SELECT place_id, list_contains(ids, 3) AS has_3, list_has_any(ids, [2, 9]) AS any_of, list_has_all(ids, [1, 6]) AS all_of
    FROM (SELECT place_id, [parent_id, parent_id % 5, parent_id % 7] AS ids FROM places)
    WHERE list_has_any(ids, [1, 2, 3])""",
)
def _(t):
    p = F.col("parent_id").cast("long")
    df = t.places.withColumn("ids", F.array(p, p % 5, p % 7))
    return df.where(filters.has_any("ids", [1, 2, 3])).select(
        "place_id",
        filters.has("ids", 3).alias("has_3"),
        filters.has_any("ids", [2, 9]).alias("any_of"),
        filters.has_all("ids", [1, 6]).alias("all_of"),
    )


@query(
    "record_quality",
    "F8",
    """SELECT taxon_id, count(*) AS records FROM records WHERE record_status <> 'R' AND substatus = 'F' AND quantity > 0
    AND NOT discount > 0.08 GROUP BY 1""",
)
def _(t):
    df = t.records.withColumn("training", F.col("discount") > 0.08).withColumn("zero_abundance", F.col("quantity") <= 0)
    good = filters.quality(df, status_not=["R"], absent=False)
    good = filters.quality(good, status_in=["F"], status="substatus")
    return good.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("records"))


# ---- joins ---------------------------------------------------------------------------


@query(
    "key_join",
    "J1",
    """SELECT r.taxon_id, a.name, count(*) AS records FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1, 2""",
)
def _(t):
    per = t.records.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("records"))
    return joins.inner(per, t.taxa.select("taxon_id", "name"), "taxon_id")


@query(
    "left_join_filtered_side",
    "J2",
    """SELECT p.user_id, count(v.visit_id) AS urgent FROM people p
    LEFT JOIN visits v ON v.user_id = p.user_id AND v.priority = '1-URGENT' GROUP BY 1""",
)
def _(t):
    urgent = t.visits.where(F.col("priority") == "1-URGENT").groupBy("user_id").agg(F.count(F.lit(1)).alias("urgent"))
    return joins.left(t.people.select("user_id"), urgent, "user_id").fillna(0)


@query(
    "full_join_of_series",
    "J3",
    """SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS visits, coalesce(b.n, 0) AS records FROM
    (SELECT strftime(date_start, '%Y-%m-%d') AS day, count(*) AS n FROM visits WHERE status = 'F' GROUP BY 1) a
    FULL JOIN (SELECT strftime(seen_on, '%Y-%m-%d') AS day, count(*) AS n FROM records WHERE record_status = 'R' GROUP BY 1) b
    ON a.day = b.day""",
)
def _(t):
    day = F.date_format(F.col("date_start"), "yyyy-MM-dd").alias("day")
    a = t.visits.where("status = 'F'").groupBy(day).agg(F.count(F.lit(1)).alias("visits"))
    seen = F.date_format(F.col("seen_on"), "yyyy-MM-dd").alias("day")
    b = t.records.where("record_status = 'R'").groupBy(seen).agg(F.count(F.lit(1)).alias("records"))
    return joins.outer(a, b, "day").fillna(0)


@query(
    "right_join_keeps_visits",
    "J3",
    """SELECT v.visit_id, CAST(coalesce(sum(r.quantity), 0) AS DOUBLE) AS quantity FROM records r
    RIGHT JOIN visits v ON v.visit_id = r.visit_id GROUP BY 1""",
)
def _(t):
    per = t.records.groupBy("visit_id").agg(F.sum("quantity").alias("quantity"))
    return joins.outer(per, t.visits.select("visit_id"), "visit_id", "right").fillna(0.0)


@query(
    "outer_join_nested_inner",
    "J4",
    """SELECT v.visit_id, n.records, n.brands FROM visits v LEFT JOIN
    (SELECT r.visit_id, count(*) AS records, count(DISTINCT a.family) AS brands
     FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id AND a.taxon_group = 'PROMO' GROUP BY 1) n
    ON n.visit_id = v.visit_id""",
)
def _(t):
    promo = t.taxa.where("taxon_group = 'PROMO'").select("taxon_id", "family")
    inside = t.records.join(promo, "taxon_id").groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("family").alias("brands")
    )
    return joins.left(t.visits.select("visit_id"), inside, "visit_id")


@query(
    "nested_outer_rows",
    "J4",
    """SELECT p.place_id, n.parent_name, n.region_name FROM places p LEFT JOIN
    (SELECT a.parent_id, a.parent_name, b.r_name AS region_name FROM parents a JOIN region b
     ON b.r_regionkey = a.region_id AND b.r_name <> 'ASIA') n ON n.parent_id = p.parent_id""",
)
def _(t):
    far = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    return joins.nested(t.places, t.parents, far, "parent_id", "region_id").select("place_id", "parent_name", "region_name")


@query(
    "anti_join",
    "J5",
    "SELECT user_id, role FROM people p WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.user_id = p.user_id AND v.status = 'P')",
)
def _(t):
    return joins.anti(t.people.select("user_id", "role"), t.visits.where("status = 'P'"), "user_id")


@query(
    "not_in_null_rule",
    "J5",
    """SELECT user_id, 'clean' AS list FROM people WHERE user_id NOT IN (SELECT user_id FROM visits WHERE status = 'F')
    UNION ALL SELECT user_id, 'with null' FROM people
    WHERE user_id NOT IN (SELECT CASE WHEN status = 'F' THEN user_id END FROM visits)""",
)
def _(t):
    clean = joins.not_in(t.people.select("user_id"), t.visits.where("status = 'F'").select("user_id"), "user_id")
    holes = t.visits.select(F.when(F.col("status") == "F", F.col("user_id")).alias("user_id"))
    empty = joins.not_in(t.people.select("user_id"), holes, "user_id")
    return clean.withColumn("list", F.lit("clean")).union(empty.withColumn("list", F.lit("with null")))


@query(
    "semi_join",
    "J6",
    """SELECT visit_id, total FROM visits v WHERE EXISTS (SELECT 1 FROM records r WHERE r.visit_id = v.visit_id AND r.discount >= 0.1)""",
)
def _(t):
    return joins.semi(t.visits.select("visit_id", "total"), t.records.where("discount >= 0.1"), "visit_id")


@query(
    "parent_chain",
    "J7",
    """SELECT p.place_id, p.place_name, n.parent_name AS nation, g.r_name AS region FROM places p
    LEFT JOIN parents n ON n.parent_id = p.parent_id LEFT JOIN region g ON g.r_regionkey = n.region_id""",
)
def _(t):
    first = joins.with_parent(t.places, t.parents, {"parent_name": "nation", "region_id": "up"}, key="parent_id", parent_key="parent_id")
    second = joins.with_parent(first, t.region, {"r_name": "region"}, key="r_regionkey", parent_key="up")
    return second.select("place_id", "place_name", "nation", "region")


@query(
    "either_key_join",
    "J8",
    """SELECT v.visit_id, count(p.user_id) AS linked, CAST(max(p.user_id) AS BIGINT) AS last_linked FROM visits v JOIN people p
    ON p.user_id = v.user_id OR p.user_id = v.visit_id GROUP BY 1""",
)
def _(t):
    visits = t.visits.select("visit_id", F.col("user_id").alias("creator"))
    both = joins.join_any(visits, t.people.select("user_id"), [("creator", "user_id"), ("visit_id", "user_id")])
    return both.groupBy("visit_id").agg(F.count("user_id").alias("linked"), F.max("user_id").alias("last_linked"))


@query(
    "either_key_outer_join",
    "J8",
    """SELECT p.place_id, count(DISTINCT u.user_id) AS linked FROM places p LEFT JOIN people u
    ON u.user_id = p.place_id OR u.user_id = p.place_id + 50 GROUP BY 1""",
)
def _(t):
    side = t.places.select("place_id", (F.col("place_id") + 50).alias("second_id"))
    both = joins.join_any(side, t.people.select("user_id"), [("place_id", "user_id"), ("second_id", "user_id")], how="left")
    return both.groupBy("place_id").agg(F.countDistinct("user_id").alias("linked"))


@query(
    "latest_before",
    "J9",
    """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type
    FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def _(t):
    early = t.events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")
    return windows.latest_per(early, ["user_id"], ["event_id"])


@query(
    "one_row_panels",
    "J10 A6",
    """SELECT (SELECT count(*) FROM visits) AS visits, (SELECT count(DISTINCT taxon_id) FROM records) AS species,
    (SELECT count(*) FROM people) AS people""",
)
def _(t):
    return agg.panel(
        visits=t.visits.agg(F.count(F.lit(1))),
        species=t.records.agg(F.countDistinct("taxon_id")),
        people=t.people.agg(F.count(F.lit(1))),
    )


TREE_SQL = """SELECT taxon_id AS id, CASE WHEN taxon_id > 0 THEN (taxon_id - 1) // 2 END AS parent_id, name AS term FROM taxa"""


def taxon_tree(t):
    """Taxa as a binary tree: the parent of k is (k - 1) div 2."""
    k = F.col("taxon_id")
    return t.taxa.select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent_id"), F.col("name").alias("term"))


@query(
    "ancestor_path_join",
    "J11",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    up AS (SELECT id, id AS ancestor_id, 0 AS distance, parent_id FROM tree
      UNION ALL SELECT u.id, p.id, u.distance + 1, p.parent_id FROM up u JOIN tree p ON p.id = u.parent_id)
    SELECT a.family, count(*) AS pairs, CAST(max(distance) AS INTEGER) AS deepest
    FROM up JOIN taxa a ON a.taxon_id = up.ancestor_id GROUP BY 1""",
)
def _(t):
    steps = joins.expand_path(hierarchy.paths(taxon_tree(t)).withColumn("depth", F.size("path") - 1), "path", "taxon_id")
    pairs = steps.withColumn("distance", F.col("depth") + 1 - F.array_position("path", F.col("taxon_id")))
    return pairs.join(t.taxa.select("taxon_id", "family"), "taxon_id").groupBy("family").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("distance").cast("int").alias("deepest")
    )


@query(
    "ancestors_of_recorded",
    "J11 J7 job:ancestor_expand",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    up AS (SELECT id, id AS ancestor_id, 0 AS distance, parent_id FROM tree WHERE id IN (SELECT taxon_id FROM records)
      UNION ALL SELECT u.id, p.id, u.distance + 1, p.parent_id FROM up u JOIN tree p ON p.id = u.parent_id)
    SELECT id, ancestor_id, CAST(distance AS INTEGER) AS distance FROM up""",
)
def _(t):
    return hierarchy.ancestors_of(t.records.select(F.col("taxon_id").alias("id")), taxon_tree(t))


NAMES_SQL = """names AS (SELECT taxon_id AS id, taxon_id // 3 AS meaning_id, name, taxon_id % 3 = 0 AS preferred FROM taxa)"""


def names(t):
    """Taxon names: three with one meaning, the first preferred."""
    k = F.col("taxon_id")
    return t.taxa.select(k.alias("id"), F.floor(k / 3).alias("meaning_id"), "name", (k % 3 == 0).alias("preferred"))


@query(
    "synonyms_to_preferred",
    "J12",
    f"""WITH {NAMES_SQL} SELECT n.id, n.name, p.name AS preferred_name FROM names n
    LEFT JOIN names p ON p.meaning_id = n.meaning_id AND p.preferred""",
)
def _(t):
    return joins.to_preferred(names(t)).select("id", "name", "preferred_name")


@query(
    "synonym_expansion",
    "J12",
    f"""WITH {NAMES_SQL} SELECT id, name FROM names WHERE meaning_id IN (SELECT meaning_id FROM names WHERE name LIKE 'red%')""",
)
def _(t):
    every = names(t)
    return joins.expand_synonyms(every.where(F.col("name").startswith("red")), every).select("id", "name")


@query(
    "salted_hot_key_join",
    "J1",
    """SELECT p.parent_id, count(*) AS records, CAST(sum(r.quantity) AS DOUBLE) AS quantity
    FROM records r JOIN places p ON p.place_id = r.place_id GROUP BY 1""",
)
def _(t):
    side = t.places.select("place_id", "parent_id")
    both = joins.salted_join(t.records.select("place_id", "record_id", "quantity"), side, ["place_id"], ["record_id"], copies=8)
    return both.groupBy("parent_id").agg(F.count(F.lit(1)).alias("records"), F.sum("quantity").alias("quantity"))


# ---- attributes ----------------------------------------------------------------------

ATTRS = {"quantity": 1, "discount": 2, "tax": 3}


def values_of(t):
    """Record attributes as rows: quantity, discount and tax under the ids 1 to 3."""
    return eav.unpivot(t.records, ["record_id"], ATTRS)


@query(
    "attribute_pivot",
    "E1",
    """SELECT record_id, max(quantity) AS quantity, max(discount) AS discount, max(tax) AS tax FROM records GROUP BY 1""",
)
def _(t):
    return eav.pivot_attrs(values_of(t), "record_id", {1: ("quantity", "value"), 2: ("discount", "value"), 3: ("tax", "value")})


@query(
    "attribute_pivot_many",
    "E1 A4",
    """SELECT visit_id, max(price) AS top_price, string_agg(DISTINCT record_status, '; ' ORDER BY record_status) AS statuses
    FROM records GROUP BY 1""",
)
def _(t):
    values = t.records.select(
        "visit_id",
        F.inline(
            F.array(
                F.struct(F.lit("p").alias("attribute_id"), F.col("price").alias("number"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("s").alias("attribute_id"), F.lit(None).cast("double").alias("number"), F.col("record_status").alias("text")),
            )
        ),
    )
    return eav.pivot_attrs(values, "visit_id", {"p": ("top_price", "number")}, many={"s": ("statuses", "text")})


@query(
    "json_attribute",
    "E2",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 AS twice FROM events""",
)
def _(t):
    k = ja.json_attr("props", "k", "int")
    return t.events.select("event_id", k.alias("k"), (k.cast("double") * 2.0).alias("twice"))


@query(
    "term_decode",
    "E3",
    """SELECT user_id, parent_name AS nation FROM people LEFT JOIN parents ON parent_id = nation_id AND parent_id < 20""",
)
def _(t):
    terms = t.parents.where("parent_id < 20").select(F.col("parent_id").alias("term_id"), F.col("parent_name").alias("term"))
    return eav.decode(t.people.select("user_id", "nation_id"), "nation_id", terms, "nation").select("user_id", "nation")


@query(
    "attribute_map",
    "E4",
    """SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS attrs FROM
    (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return eav.attrs_map(per, "user_id", "event_type", "n").select("user_id", F.to_json("attrs").alias("attrs"))


# ---- aggregates ----------------------------------------------------------------------


@query(
    "grouped_counts",
    "A1",
    """SELECT taxon_id, count(*) AS records, count(DISTINCT visit_id) AS visits, count(DISTINCT place_id) AS sites FROM records GROUP BY 1""",
)
def _(t):
    return agg.summarise(
        t.records,
        ["taxon_id"],
        records=F.count(F.lit(1)),
        visits=F.countDistinct("visit_id"),
        sites=F.countDistinct("place_id"),
    )


@query(
    "conditional_counts",
    "A2",
    """SELECT place_id, count(DISTINCT CASE WHEN record_status = 'A' THEN taxon_id END) AS species_a,
    count(CASE WHEN record_status = 'R' THEN 1 END) AS rejected,
    CAST(sum(CASE WHEN substatus = 'F' THEN quantity ELSE 0 END) AS DOUBLE) AS quantity_f FROM records GROUP BY 1""",
)
def _(t):
    return agg.summarise(
        t.records,
        ["place_id"],
        species_a=agg.distinct_if(F.col("record_status") == "A", "taxon_id"),
        rejected=agg.count_if(F.col("record_status") == "R"),
        quantity_f=agg.sum_if(F.col("substatus") == "F", "quantity", 0.0),
    )


@query(
    "numeric_rollups",
    "A3 C3",
    """SELECT place_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total, min(quantity) AS low, max(quantity) AS high,
    round(CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) / count(quantity), 4) AS mean,
    least(20, count(*)) AS capped, greatest(min(seen_on), DATE '1995-06-01')::VARCHAR AS first_seen FROM records GROUP BY 1""",
)
def _(t):
    return agg.summarise(
        t.records,
        ["place_id"],
        total=agg.exact_sum("price"),
        low=F.min("quantity"),
        high=F.max("quantity"),
        mean=F.round(agg.exact_avg("quantity"), 4),
        capped=agg.capped(F.count(F.lit(1)), 20).cast("long"),
        first_seen=F.greatest(F.min("seen_on"), F.lit("1995-06-01").cast("date")),
    )


@query(
    "text_aggregation",
    "A4",
    """SELECT user_id, string_agg(priority, ', ' ORDER BY priority) AS priorities,
    string_agg(priority, ' > ' ORDER BY first_visit) AS in_order FROM
    (SELECT user_id, priority, min(visit_id) AS first_visit FROM visits GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    # One row per (user, priority) first: a text never grows with the number of visits.
    firsts = t.visits.groupBy("user_id", "priority").agg(F.min("visit_id").alias("first_visit"))
    return agg.summarise(
        firsts,
        ["user_id"],
        priorities=agg.join_text("priority"),
        in_order=agg.join_text_by("priority", "first_visit", " > "),
    )


@query(
    "having_filter",
    "A5",
    """SELECT user_id, count(*) AS visits FROM visits GROUP BY 1 HAVING count(*) > 12 OR user_id < 10""",
)
def _(t):
    return agg.having(t.visits, ["user_id"], (F.col("visits") > 12) | (F.col("user_id") < 10), visits=F.count(F.lit(1)))


@query(
    "correlated_scalar",
    "A6",
    """SELECT v.visit_id, (SELECT round(CAST(sum(CAST(r.discount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)
     FROM records r WHERE r.visit_id = v.visit_id) AS mean_discount FROM visits v""",
)
def _(t):
    per = t.records.groupBy("visit_id").agg(F.round(agg.exact_avg("discount"), 6).alias("mean_discount"))
    return t.visits.select("visit_id").join(per, "visit_id", "left")


@query(
    "share_of_total",
    "A7",
    """SELECT taxon_group, count(*) AS n, count(*) * 100 // (SELECT count(*) FROM taxa) AS pct,
    CAST(round(count(*) * 100.0 / (SELECT count(*) FROM taxa)) AS BIGINT) AS pct_round FROM taxa GROUP BY 1""",
)
def _(t):
    total = t.taxa.agg(F.count(F.lit(1))).scalar()
    n = F.col("n")
    per = t.taxa.groupBy("taxon_group").agg(F.count(F.lit(1)).alias("n"))
    return per.select("taxon_group", "n", agg.pct(n, total).alias("pct"), agg.pct(n, total, "round").alias("pct_round"))


@query(
    "total_row",
    "A8",
    """SELECT CASE WHEN grouping(record_status) = 1 THEN 'Total' ELSE record_status END AS label,
    CAST(grouping(record_status) AS INTEGER) AS is_total, count(*) AS records, count(DISTINCT taxon_id) AS species
    FROM records GROUP BY ROLLUP (record_status)""",
)
def _(t):
    out = agg.with_total(t.records, "record_status", records=F.count(F.lit(1)), species=F.countDistinct("taxon_id"))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@query(
    "two_stage_aggregation",
    "A9",
    """SELECT user_id, max(n) AS most_at_one_site, count(*) AS sites FROM
    (SELECT user_id, place_id, priority, count(*) AS n FROM visits GROUP BY 1, 2, 3) GROUP BY 1""",
)
def _(t):
    return agg.two_stage(
        t.visits,
        ["user_id", "place_id", "priority"],
        {"n": F.count(F.lit(1))},
        ["user_id"],
        {"most_at_one_site": F.max("n"), "sites": F.count(F.lit(1))},
    )


# ---- windows -------------------------------------------------------------------------


@query(
    "first_row_per_key",
    "W1",
    """SELECT user_id, visit_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_start, visit_id) AS rn FROM visits)
    WHERE rn = 1""",
)
def _(t):
    rows = t.visits.select("user_id", "visit_id", "priority", "date_start")
    return windows.earliest_per(rows, ["user_id"], ["date_start", "visit_id"]).drop("date_start")


@query(
    "league_position",
    "W2",
    """SELECT user_id, visits, row_number() OVER (ORDER BY visits DESC, user_id) AS position FROM
    (SELECT user_id, count(*) AS visits FROM visits GROUP BY 1)""",
)
def _(t):
    per = t.visits.groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"))
    return windows.position(per, [F.col("visits").desc(), F.col("user_id").asc()])


@query(
    "shared_rank",
    "W2",
    """SELECT taxon_id, records, rank() OVER (ORDER BY records DESC) AS rank FROM
    (SELECT taxon_id, count(*) AS records FROM records GROUP BY 1)""",
)
def _(t):
    per = t.records.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("records"))
    return windows.rank_of(per, "records").select("taxon_id", "records", "rank")


@query(
    "running_total",
    "W3",
    """SELECT month, n, CAST(sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM
    (SELECT strftime(date_start, '%Y-%m') AS month, count(*) AS n FROM visits GROUP BY 1)""",
)
def _(t):
    per = t.visits.groupBy(dates.month_text("date_start").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return windows.running_total(per, "month", "n", "total")


@query(
    "longest_run",
    "W4",
    """WITH weeks AS (SELECT DISTINCT user_id, CAST(date_trunc('week', date_start) AS DATE) AS w FROM visits),
    runs AS (SELECT user_id, w - CAST(7 * row_number() OVER (PARTITION BY user_id ORDER BY w) AS INTEGER) AS g FROM weeks)
    SELECT user_id, max(n) AS weeks_in_a_row FROM (SELECT user_id, g, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return windows.longest_run(t.visits, "user_id", "date_start")


@query(
    "minmax_scale",
    "W5",
    """SELECT parent_id, places, round((places - lo) * 1.0 / nullif(hi - lo, 0), 6) AS scaled FROM
    (SELECT parent_id, count(*) AS places FROM places GROUP BY 1),
    (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM places GROUP BY parent_id))""",
)
def _(t):
    per = t.places.groupBy("parent_id").agg(F.count(F.lit(1)).alias("places"))
    return windows.minmax_scale(per, "places").withColumn("scaled", F.round("scaled", 6))


@query(
    "top_n_other_fold",
    "W6",
    """WITH base AS (SELECT family, count(*) AS n FROM taxa GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, family) AS rn, count(*) OVER () AS c FROM base)
    SELECT CASE WHEN c > 7 AND rn > 6 THEN 'Other' ELSE family END AS family, CAST(sum(n) AS BIGINT) AS n FROM ranked GROUP BY 1""",
)
def _(t):
    base = t.taxa.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_n_other(base, "family", "n", ["n"], 6)


# ---- sets, sorts, generators ---------------------------------------------------------


@query(
    "union_distinct",
    "U1",
    """SELECT user_id AS id, 'visit' AS kind, priority AS label FROM visits UNION
    SELECT user_id, 'person', role FROM people UNION SELECT user_id, 'event', NULL FROM events""",
)
def _(t):
    return sets.stack(
        [
            t.visits.select(F.col("user_id").alias("id"), F.lit("visit").alias("kind"), F.col("priority").alias("label")),
            t.people.select(F.col("user_id").alias("id"), F.lit("person").alias("kind"), F.col("role").alias("label")),
            t.events.select(F.col("user_id").alias("id"), F.lit("event").alias("kind")),
        ],
        distinct=True,
    )


@query("distinct_rows", "D1", "SELECT DISTINCT taxon_id, place_id FROM records")
def _(t):
    return sets.unique(t.records.select("taxon_id", "place_id"))


@query(
    "natural_order",
    "O1",
    """SELECT taxon_id, row_number() OVER (ORDER BY rank_order > 25 DESC, lpad(CAST(rank_order AS VARCHAR), 4, '0'),
      nullif(taxon_group, 'PROMO') ASC NULLS LAST, taxon_id DESC) AS at FROM taxa""",
)
def _(t):
    by = [
        (F.col("rank_order") > 25).desc(),
        ordering.natural_key(F.col("rank_order").cast("string")).asc(),
        ordering.up(F.nullif("taxon_group", F.lit("PROMO"))),
        F.col("taxon_id").desc(),
    ]
    return windows.position(t.taxa.select("taxon_id", "rank_order", "taxon_group"), by, "at").select("taxon_id", "at")


@query(
    "top_k",
    "O2",
    "SELECT visit_id, total FROM visits ORDER BY total DESC, visit_id LIMIT 25",
)
def _(t):
    return ordering.top(t.visits.select("visit_id", "total"), 25, ordering.down("total", "last"), F.col("visit_id"))


@query(
    "year_series",
    "T1",
    """SELECT s.user_id, s.yr AS year, count(v.visit_id) AS visits FROM
    (SELECT user_id, unnest(range(1995, 2002)) AS yr FROM people) s
    LEFT JOIN visits v ON v.user_id = s.user_id AND year(v.date_start) = s.yr GROUP BY 1, 2""",
)
def _(t):
    spine = generators.series(t.people.select("user_id"), F.lit(1995), F.lit(2001), "year").withColumn("year", F.col("year").cast("long"))
    per = t.visits.groupBy("user_id", F.year("date_start").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("visits"))
    return joins.left(spine, per, ["user_id", "year"]).fillna(0, ["visits"])


WEEKLY_SQL = """weekly AS (SELECT user_id, CAST(week(ts) AS INTEGER) AS period, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"""


def weekly_series(t):
    """Weekly counts of each user as a JSON array; weeks under five events carry the text NULL."""
    per = t.events.groupBy("user_id", F.weekofyear("ts").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), agg.exact_sum("value").alias("v")
    )
    item = F.struct(
        F.col("period").cast("string").alias("period"),
        F.when(F.col("n") < 5, "NULL").otherwise(F.col("n").cast("string")).alias("summary"),
        F.col("v").cast("string").alias("estimate"),
    )
    # A user has at most one element per calendar week.
    return per.groupBy("user_id").agg(F.to_json(F.collect_list(item)).alias("summarised_data"))


@query(
    "json_array_rows",
    "T2",
    f"WITH {WEEKLY_SQL} SELECT user_id, period, CASE WHEN n >= 5 THEN CAST(n AS DOUBLE) END AS summary, v AS estimate FROM weekly",
)
def _(t):
    return generators.explode_periods(weekly_series(t))


@query(
    "tree_walk",
    "T3",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    walk AS (SELECT id, 0 AS depth, CAST(id AS VARCHAR) AS chain FROM tree WHERE id = 1
      UNION ALL SELECT c.id, w.depth + 1, w.chain || '/' || c.id FROM walk w JOIN tree c ON c.parent_id = w.id
      WHERE c.term NOT LIKE '%gizmo')
    SELECT id, depth, chain FROM walk""",
)
def _(t):
    tree = taxon_tree(t).withColumn("label", F.col("term")).withColumn("term", F.col("id").cast("string"))
    walked = hierarchy.descend(tree, F.col("id") == 1, F.col("label").endswith("gizmo"), sep="/")
    return walked.select("id", "depth", "chain")


@query(
    "common_table",
    "Q1",
    """WITH in_season AS (SELECT visit_id, place_id FROM visits WHERE month(date_start) BETWEEN 4 AND 9)
    SELECT s.place_id, count(DISTINCT s.visit_id) AS visits, count(r.record_id) AS records
    FROM in_season s LEFT JOIN records r ON r.visit_id = s.visit_id GROUP BY 1""",
)
def _(t):
    in_season = t.visits.where(F.month("date_start").between(4, 9)).select("visit_id", "place_id")
    per = t.records.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"))
    return in_season.join(per, "visit_id", "left").groupBy("place_id").agg(
        F.count(F.lit(1)).alias("visits"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")
    )


# ---- scalars -------------------------------------------------------------------------


@query(
    "string_functions",
    "C1 F6",
    r"""SELECT doc_id, md5(text) AS digest, substring(text, 3, 12) AS part, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded,
    trim(lower(lang)) AS lang, CAST(length(text) AS INTEGER) AS size, split_part(source, '_', 1) AS head,
    regexp_replace(regexp_replace(lower(regexp_replace(text, '\(.+\)', '', 'g')), 'ae', 'e', 'g'), '[^a-z0-9?+]', '', 'g') AS name_key
    FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        F.md5("text").alias("digest"),
        F.substring("text", 3, 12).alias("part"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"),
        F.trim(F.lower("lang")).alias("lang"),
        F.length("text").alias("size"),
        F.split_part("source", F.lit("_"), F.lit(1)).alias("head"),
        text.name_key("text").alias("name_key"),
    )


@query(
    "null_propagating_concat",
    "C1 C5",
    """SELECT user_id, user_name || coalesce(', ' || CASE WHEN balance > 0 THEN role END, '') AS label,
    'Plot ' || CASE WHEN balance > 0 THEN role END || ' at ' || nation_id AS strict FROM people""",
)
def _(t):
    role = F.when(F.col("balance") > 0, F.col("role"))
    return t.people.select(
        "user_id",
        text.full_name(role, "user_name").alias("label"),
        text.joined("Plot ", role, " at ", F.col("nation_id")).alias("strict"),
    )


@query(
    "date_functions",
    "C2",
    """SELECT visit_id, CAST(year(date_start) AS INTEGER) AS y, CAST(month(date_start) AS INTEGER) AS m,
    strftime(date_start, '%d/%m/%Y') AS shown, strftime(date_trunc('month', date_start), '%Y-%m-%d') AS first_of_month,
    CAST(date_start - DATE '1970-01-01' AS INTEGER) AS day_no, CAST(month(date_start) * 100 + day(date_start) AS INTEGER) AS mmdd,
    strftime(date_start - INTERVAL 2 DAY, '%Y-%m-%d') AS two_days_before,
    CAST((visit_id % 24) * 3600 + (visit_id % 60) * 60 + (visit_id % 50) AS DOUBLE) AS seconds FROM visits""",
)
def _(t):
    clock = F.format_string("%02d:%02d:%02d", F.col("visit_id") % 24, F.col("visit_id") % 60, F.col("visit_id") % 50)
    d = F.col("date_start")
    return t.visits.select(
        "visit_id",
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        F.date_format(d, "dd/MM/yyyy").alias("shown"),
        F.trunc(d, "month").alias("first_of_month"),
        dates.day_index(d).alias("day_no"),
        dates.month_day(d).alias("mmdd"),
        (d - F.expr("interval 2 days")).cast("date").alias("two_days_before"),
        dates.duration_seconds(clock).alias("seconds"),
    )


@query(
    "math_functions",
    "C3",
    """SELECT user_id, CAST(round(balance) AS BIGINT) AS rounded, CAST(floor(balance / 100) AS BIGINT) AS hundreds,
    CAST(ceil(balance / 100) AS BIGINT) AS hundreds_up, round(0.2 + sqrt(abs(balance)) / 20, 6) AS opacity,
    lower(hex(user_id % 256)) AS code, abs(balance) AS size FROM people""",
)
def _(t):
    b = F.col("balance")
    return t.people.select(
        "user_id",
        F.round(b).cast("long").alias("rounded"),
        F.floor(b / 100).alias("hundreds"),
        F.ceil(b / 100).alias("hundreds_up"),
        F.round(F.lit(0.2) + F.sqrt(F.abs(b)) / 20, 6).alias("opacity"),
        F.lower(F.hex(F.col("user_id") % 256)).alias("code"),
        F.abs(b).alias("size"),
    )


@query(
    "case_recode",
    "C4",
    """SELECT record_id, taxon_id, price, CASE record_status WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE record_status END AS status,
    CASE WHEN quantity >= 30 THEN 'many' WHEN quantity >= 10 THEN 'some' ELSE 'few' END AS band FROM records""",
)
def _(t):
    status = text.recode("record_status", {"A": "accepted", "R": "rejected"}, F.col("record_status"))
    q = F.col("quantity")
    band = F.when(q >= 30, "many").when(q >= 10, "some").otherwise("few")
    return t.records.select("record_id", "taxon_id", "price", status.alias("status"), band.alias("band"))


@query(
    "null_handling",
    "C5",
    """SELECT user_id, coalesce(nullif(role, 'BUILDING'), 'none') AS role, TRY_CAST(split_part(user_name, '#', 2) AS BIGINT) AS serial,
    TRY_CAST(user_name AS DOUBLE) AS bad, CAST(balance AS VARCHAR) = '' AS blank FROM people""",
)
def _(t):
    return t.people.select(
        "user_id",
        F.coalesce(F.nullif("role", F.lit("BUILDING")), F.lit("none")).alias("role"),
        F.split_part("user_name", F.lit("#"), F.lit(2)).try_cast("long").alias("serial"),
        F.col("user_name").try_cast("double").alias("bad"),
        (F.col("balance").cast("string") == "").alias("blank"),
    )


@query(
    "status_labels",
    "C4 C5",
    f"""SELECT visit_id, CASE code {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.STATUS_LABELS.items())} ELSE code END AS label FROM
    (SELECT visit_id, CASE status WHEN 'F' THEN 'V' WHEN 'O' THEN 'C' ELSE 'R' END ||
      CASE WHEN visit_id % 7 > 5 THEN '' ELSE CAST(visit_id % 7 AS VARCHAR) END AS code FROM visits)""",
)
def _(t):
    status = text.recode("status", {"F": "V", "O": "C"}, "R")
    sub = F.when(F.col("visit_id") % 7 <= 5, F.col("visit_id") % 7)
    return t.visits.select("visit_id", text.status_label(status, sub).alias("label"))




@query(
    "text_ends_and_positions",
    "C1 F6",
    """SELECT doc_id, rtrim(substr(text, 1, 60) || ', ,', ', ') AS head, position('.' IN text) = 0 AS no_stop, CAST(position('e' IN text) AS INTEGER) AS first_e FROM documents""",
)
def _(t):
    start = F.concat(F.substring("text", 1, 60), F.lit(", ,"))
    return t.documents.select("doc_id", text.list_text(start).alias("head"), text.lacks("text", ".").alias("no_stop"), F.position(F.lit("e"), F.col("text")).alias("first_e"))
