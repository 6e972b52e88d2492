"""Listings that work something out of their own, beyond filters, lookups and order.

Each is the whole listing for all users or sites; a report for one is the same with a filter before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import json_attr
from ..functions.text import recode
from ..operators.aggregate import join_text
from ..operators.filters import opt
from ..operators.joins import fanned_join, to_preferred, with_parent
from ..operators.ordering import down, up
from ..operators.sets import stack
from ..operators.spatial import tag_points
from ..operators.windows import position


def walk_counts(visits: DataFrame, children: DataFrame, records: DataFrame, taxa: DataFrame, values: DataFrame) -> DataFrame:
    """Top visits with every record of their child visits, and the mean of an attribute over the child visits.

    ``visits``: visit_id and more. ``children``: child_id, visit_id. ``records``: child_id, taxon_id. ``taxa``: taxon_id, taxon_meaning_id,
    common, preferred. ``values``: child_id, value (whole numbers of one attribute). A child counts only with a record of a known
    taxon; visits without any stay, with nulls. The mean is rounded half up and taken before the records multiply it.
    """
    seen = children.join(records.select("child_id", "taxon_id"), "child_id").join(taxa, "taxon_id")
    seen = seen.select("visit_id", "taxon_meaning_id", F.coalesce("common", "preferred").alias("common"), "preferred")
    mean = values.join(children, "child_id").groupBy("visit_id").agg(F.round(F.avg("value")).cast("long").alias("mean_value"))
    return visits.join(seen, "visit_id", "left").join(mean, "visit_id", "left")


def measured_points(visits: DataFrame, places: DataFrame, groups: DataFrame, values: DataFrame) -> DataFrame:
    """Visits at fixed points with the point, its site (the place above), its group, and all measured values.

    ``visits``: visit_id, parent_visit_id, place_id. ``places``: place_id, place_name, parent_id. ``groups``: place_id, group. ``values``:
    visit_id, value. Adds ``values`` (in ascending order, as text) and ``mean_value`` (one decimal); null without any.
    """
    per = values.groupBy("visit_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("value")), lambda v: v.cast("string")), ", ").alias("values"), F.round(F.avg("value"), 1).alias("mean_value")
    )
    points = with_parent(places, places, {"place_name": "site"}, key="place_id", parent_key="parent_id")
    points = points.select("place_id", F.col("place_name").alias("point"), F.col("parent_id").alias("site_id"), "site")
    out = visits.join(points, "place_id", "left").join(groups.select("place_id", "group"), "place_id", "left").join(per, "visit_id", "left")
    return out.select("parent_visit_id", "visit_id", "site_id", "site", "group", "place_id", "point", F.when(F.col("values") != "", F.col("values")).alias("values"), "mean_value")


def projects_of_countries(projects: DataFrame, links: DataFrame, terms: DataFrame, urls: DataFrame) -> DataFrame:
    """Project terms with the preferred name and every code (other name) of the country they are linked to.

    ``projects``: id, name. ``links``: id (of the project), term_id (any name of the country). ``terms``: term_id, meaning_id, term,
    preferred. ``urls``: id, url; missing ones are null. Names meet through their meaning.
    """
    meaning = links.join(terms.select("term_id", "meaning_id"), "term_id").select("id", "meaning_id")
    named = lambda preferred, into: terms.where(F.col("preferred") == F.lit(preferred)).select("meaning_id", F.col("term").alias(into))
    both = meaning.join(named(True, "country_name"), "meaning_id").join(named(False, "country_code"), "meaning_id")
    return projects.join(both, "id").join(urls, "id", "left").select("id", "name", "country_name", "country_code", "url")


# Colours of a record's status on the map, for its outline and its fill.
STROKE = {"C": "blue", "V": "green", "D": "orange", "R": "#800000"}
FILL = {"V": "green", "D": "orange", "R": "#800000"}


def results_on_map(visits: DataFrame) -> DataFrame:
    """One row per visit, status and geometry with its colours, and an opacity that grows with the rows behind it.

    ``visits``: visit_id, record_status, geom.
    """
    per = visits.groupBy("visit_id", "record_status", "geom").agg(F.count(F.lit(1)).alias("n"))
    return per.select(
        "visit_id", "geom", recode("record_status", STROKE, "black").alias("stroke"), recode("record_status", FILL, "blue").alias("fill"),
        (F.lit(0.2) + F.sqrt(F.col("n") - 1) / 20).alias("opacity"),
    )


def assigned_sites(places: DataFrame, values: DataFrame, attributes: DataFrame, caption: str, required: int) -> DataFrame:
    """Users and the sites given to them by an attribute with a caption, where a second attribute is set to 1.

    ``places``: place_id, place_name. ``values``: place_id, attribute_id, value. ``attributes``: attribute_id, caption.
    """
    chosen = values.join(attributes.where(F.col("caption") == caption).select("attribute_id"), "attribute_id", "left_semi")
    flagged = values.where((F.col("attribute_id") == required) & (F.col("value") == 1)).select("place_id")
    given = chosen.select("place_id", F.col("value").alias("user_id")).distinct()
    return given.join(flagged, "place_id", "left_semi").join(places.select("place_id", "place_name"), "place_id")


def country_levels(places: DataFrame, top: Column) -> DataFrame:
    """Countries with their regions and the parts of these, three names to a row; missing levels are null.

    ``places``: place_id, parent_id, place_name. ``top`` tells which places are countries.
    """
    at = lambda level: places.select(F.col("place_id").alias(f"{level}_id"), F.col("parent_id").alias(f"{level}_parent"), F.col("place_name").alias(level))
    out = places.where(top).select(F.col("place_id").alias("country_id"), F.col("place_name").alias("country"))
    out = out.join(at("region"), F.col("region_parent") == F.col("country_id"), "left").join(at("part"), F.col("part_parent") == F.col("region_id"), "left")
    return out.select("country_id", "country", "region_id", "region", "part_id", "part")


def walks_of_users(visits: DataFrame, allocations: DataFrame) -> DataFrame:
    """Every user's visits: those they made, and those made by anyone at a site allocated to them, each once.

    ``visits``: visit_id, created_by, place_id. ``allocations``: user_id, site_id. Repeats go before the join, and own visits at a
    site allocated to the user come with that site, so that the pairs themselves are never shuffled. A site with many visits is
    dealt over several tasks.
    """
    visits, allocations = visits.distinct(), allocations.select("user_id", "site_id").distinct()
    mine = (F.col("created_by") == F.col("user_id")) & (F.col("place_id") == F.col("site_id"))
    own = visits.where(F.col("created_by").isNotNull()).join(allocations, mine, "left_anti").select(F.col("created_by").alias("user_id"), *visits.columns)
    sites = allocations.withColumnRenamed("site_id", "place_id")
    given = fanned_join(visits.where(F.col("place_id").isNotNull()), sites, ["place_id"], ["visit_id"]).select("user_id", *visits.columns)
    return stack([own, given])


def import_history(imports: DataFrame, site_names: dict, hide_empty: bool = False) -> DataFrame:
    """Imports with the number of rows taken over and the name of the site; ``hide_empty`` leaves out those without any.

    ``imports``: import_id, website_id, inserted, updated, errors. Unknown sites are shown by their number.
    """
    rows = F.coalesce("inserted", F.lit(0)) + F.coalesce("updated", F.lit(0))
    out = imports.withColumn("rows", rows).withColumn("site", recode("website_id", site_names, F.col("website_id").cast("string")))
    return out.where("rows > 0") if hide_empty else out


def plots_of_groups(person_values: DataFrame, plot_values: DataFrame, plots: DataFrame) -> DataFrame:
    """Plots that a user reaches because a person attribute and a place attribute name the same plot group.

    ``person_values``: user_id, group_id. ``plot_values``: place_id, group_id. ``plots``: place_id, place_name. Adds the number
    of plots of the group that exist. Each plot once per user and group. The plots are counted before users meet them,
    and the users of a group are dealt over several tasks.
    """
    known = plot_values.select("place_id", "group_id").distinct().join(plots.select("place_id", "place_name"), "place_id")
    sizes = known.groupBy("group_id").agg(F.count(F.lit(1)).alias("plots_in_group"))
    members = person_values.select("user_id", "group_id").distinct()
    pairs = fanned_join(members, known.join(sizes, "group_id"), ["group_id"], ["user_id"], inner="big")
    return pairs.select("group_id", "user_id", "place_id", "place_name", "plots_in_group")


def requested_visits(visits: DataFrame, pack_states: DataFrame, status: str | None = None) -> DataFrame:
    """Visits of a record status together with those whose pack has the state, each once; without a status, all.

    ``visits``: visit_id, status. ``pack_states``: pack_visit_id, pack_state.
    """
    if status is None:
        return visits
    wanted = pack_states.where(F.col("pack_state") == status).select("pack_visit_id").distinct()
    by_pack = visits.join(wanted, F.col("visit_id") == F.col("pack_visit_id"), "left")
    return by_pack.where((F.col("status") == status) | F.col("pack_visit_id").isNotNull()).select(*visits.columns)


def activity_visits(visits: DataFrame, records: DataFrame) -> DataFrame:
    """Top visits of every user and activity with the number of sightings made on them or on their child visits.

    ``visits``: visit_id, parent_id, user_id, group_id, date_start. ``records``: visit_id, zero_abundance; a record of nothing is no
    sighting, on either level. Records are counted by visit before visits meet their children.
    """
    seen = records.where(~F.col("zero_abundance")).groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"))
    top = visits.select("visit_id", F.coalesce("parent_id", "visit_id").alias("top_id"))
    per = top.join(seen, "visit_id").groupBy(F.col("top_id").alias("visit_id")).agg(F.sum("n").alias("sightings"))
    out = visits.where(F.col("parent_id").isNull()).join(per, "visit_id", "left")
    return out.select("visit_id", "user_id", "group_id", "date_start", F.coalesce("sightings", F.lit(0)).alias("sightings"))


# Kingdoms listed before all others.
PLANTS = ["Plantae", "Fungi", "Chromista"]


def taxonomy_download(records: DataFrame, taxa: DataFrame, places: DataFrame, habitats: DataFrame, terms: DataFrame, per_habitat: bool = False) -> DataFrame:
    """Records with site, taxon and habitats, plants and fungi first, numbered in the order of the download.

    ``records``: record_id, visit_id, taxon_id, place_id, site_text. ``taxa``: taxon_id, kingdom, order_taxon, family, name. ``places``:
    place_id, place_name. ``habitats``: visit_id, term_id. ``terms``: term_id, term. A record is one row with its habitats as text, or
    with ``per_habitat`` one row for each habitat. Habitats without a term and records without habitats stay, with null.
    """
    named = habitats.join(terms, "term_id", "left").select("visit_id", "term").distinct()
    if per_habitat:
        shown = named.withColumnRenamed("term", "habitat")
    else:
        shown = named.groupBy("visit_id").agg(join_text("term").alias("habitat"))
    out = records.join(taxa, "taxon_id").join(places.select("place_id", "place_name"), "place_id", "left").join(shown, "visit_id", "left")
    out = out.select("record_id", F.coalesce("place_name", "site_text").alias("site"), "kingdom", "order_taxon", "family", "name", "habitat")
    plants = F.coalesce(F.col("kingdom").isin(PLANTS), F.lit(False))
    return position(out, [down(plants), up("order_taxon"), up("family"), up("name"), up("record_id"), up("site"), up("kingdom"), up("habitat")], "row_no")


def site_sections(sites: DataFrame, sections: DataFrame, types: DataFrame) -> DataFrame:
    """Sites with their sections, and a code of each section that is unique: the site's code or name, and the section's number.

    ``sites``: site_id, site_name, site_code, type_id. ``sections``: section_id, parent_id, section_name, section_code (a letter and a
    number). ``types``: type_id, site_type. A section without a code has no unique one.
    """
    both = sites.join(types, "type_id").join(sections, F.col("site_id") == F.col("parent_id"))
    unique = F.concat(F.coalesce("site_code", "site_name"), F.lit("."), F.expr("substring(section_code, 2)"))
    return both.select("site_id", "site_name", "site_code", "site_type", "section_id", "section_name", "section_code", unique.alias("unique_code"))


def app_sites(places: DataFrame, values: DataFrame, attributes: DataFrame, attribute_tenants: DataFrame, tenant: int, owner: str, measure: str) -> DataFrame:
    """Users' sites by the attribute captioned ``owner``, with the value of the one captioned ``measure``, both in use by the tenant.

    ``places``: place_id, place_name. ``values``: place_id, attribute_id, value. ``attributes``: attribute_id, caption.
    ``attribute_tenants``: attribute_id, website_id; several rows of an attribute do not multiply its values.
    """
    used = attributes.join(attribute_tenants.where(F.col("website_id") == tenant), "attribute_id", "left_semi")

    def held(caption: str, into: str) -> DataFrame:
        chosen = used.where(F.col("caption") == caption).select("attribute_id")
        return values.join(chosen, "attribute_id", "left_semi").select("place_id", F.col("value").alias(into))

    return held(owner, "user_id").join(held(measure, "sections"), "place_id").join(places.select("place_id", "place_name"), "place_id")


def landscape_values(values: DataFrame, attributes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Every visit's values other than zero of the attributes whose caption begins with a prefix, as (visit_id, name, value).

    ``values``: visit_id, attribute_id, value. ``attributes``: attribute_id, caption. Signs in a prefix have no special meaning.
    """
    named = F.lit(False)
    for prefix in prefixes:
        named = named | F.col("caption").startswith(prefix)
    chosen = attributes.where(named).select("attribute_id", F.col("caption").alias("name"))
    return values.where(F.col("value") != 0).join(chosen, "attribute_id").select("visit_id", "name", "value")


# States of data entry as shown, and the place of the workflow term from which results are ready.
ENTRY_STATES = {"I": "Incomplete", "C": "Complete"}
RESULTS_FROM = 40


def workflow_visits(visits: DataFrame, values: DataFrame, terms: DataFrame, workflow: int | None = None, status: str | None = None, year: int | None = None) -> DataFrame:
    """Visits with their workflow term, the state of data entry, and whether results are ready; three optional filters.

    ``visits``: visit_id, user_id, status, created_on. ``values``: visit_id, term_id of the workflow attribute; a visit without one has
    null and no results. ``terms``: term_id, term, sort_order.
    """
    states = values.join(terms, "term_id", "left").select("visit_id", "term_id", F.col("term").alias("workflow_status"), "sort_order")
    chosen = opt(visits, status, lambda v: F.col("status") == v)
    chosen = opt(chosen, year, lambda v: F.year("created_on") == v)
    out = opt(chosen.join(states, "visit_id", "left"), workflow, lambda v: F.col("term_id") == v)
    ready = F.coalesce(F.col("sort_order") >= RESULTS_FROM, F.lit(False))
    entry = recode("status", ENTRY_STATES)
    return out.select("visit_id", "user_id", "workflow_status", entry.alias("data_entry"), F.date_format("created_on", "dd/MM/yyyy").alias("created"), ready.alias("results_ready"))


def packs_by_state(visits: DataFrame, values: DataFrame, status: str, pack_state: int = 0) -> DataFrame:
    """Visits of a record status whose pack has a state; state 0 stands for packs without one.

    ``visits``: visit_id, status and more. ``values``: visit_id, value of the pack attribute. Each visit once.
    """
    chosen = visits.where(F.col("status") == status)
    if pack_state == 0:
        return chosen.join(values.where(F.col("value").isNotNull()).select("visit_id"), "visit_id", "left_anti")
    return chosen.join(values.where(F.col("value") == pack_state).select("visit_id"), "visit_id", "left_semi")


def transect_visits(visits: DataFrame, places: DataFrame, distance_id: int) -> DataFrame:
    """Child visits with a label of their place below its site, the transect of the visit above, and the distance down the slope.

    ``visits``: visit_id, parent_id, place_id, attrs (JSON). ``places``: place_id, place_name, parent_id. The distance is 0 where it is missing.
    """
    named = with_parent(places, places, {"place_name": "site"}, key="place_id", parent_key="parent_id")
    label = F.concat(F.coalesce(F.concat("site", F.lit(" - ")), F.lit("")), F.col("place_name"))
    above = visits.select(F.col("visit_id").alias("parent_id"), F.col("place_id").alias("above_id"))
    transects = places.select(F.col("place_id").alias("above_id"), F.col("place_name").alias("transect"))
    out = visits.where(F.col("parent_id").isNotNull()).join(named.select("place_id", label.alias("label")), "place_id", "left")
    out = out.join(above, "parent_id", "left").join(transects, "above_id", "left")
    distance = F.coalesce(json_attr("attrs", distance_id, "double"), F.lit(0.0))
    return out.select("parent_id", "visit_id", F.col("label").alias("site"), "transect", distance.alias("slope_distance"))


def sites_download(places: DataFrame, types: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Sites with the term of their type; with ``regions``, those inside one of them, each once.

    ``places``: place_id, place_name, type_id, x, y. ``types``: type_id, site_type. Positions are made distinct before they are looked up.
    """
    out = places.join(types, "type_id")
    if regions is not None:
        inside = tag_points(places.select("x", "y").distinct(), regions).select("x", "y").distinct()
        out = out.join(inside, ["x", "y"], "left_semi")
    return out.select("place_id", "place_name", "site_type", "x", "y")


def treatments(visits: DataFrame, people: DataFrame, methods: DataFrame, wanted: str | None = None) -> DataFrame:
    """Visits with who entered them as "surname, first name" and the preferred name of their method, whichever of its names they hold.

    ``visits``: visit_id, user_id, method_id. ``people``: user_id, surname, first_name (may be null). ``methods``: id, meaning_id, name,
    preferred. ``wanted`` is any name of a method; all visits of that meaning are kept.
    """
    preferred = to_preferred(methods.select("id", "meaning_id", "name", "preferred"))
    if wanted is not None:
        preferred = preferred.join(methods.where(F.col("name") == wanted).select("meaning_id"), "meaning_id", "left_semi")
    named = preferred.select(F.col("id").alias("method_id"), F.col("preferred_name").alias("method"))
    by = F.concat(F.col("surname"), F.coalesce(F.concat(F.lit(", "), F.col("first_name")), F.lit("")))
    return visits.join(people, "user_id").join(named, "method_id", "left" if wanted is None else "inner").select("visit_id", by.alias("input_by"), "method")
