"""Jobs over names, trees and traits, and the curated lists made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators.aggregate import join_text, paged_text
from ..operators.hierarchy import descend, paths
from ..operators.joins import expand_path
from ..operators.sync import rebuild, sync_set


def ancestor_expand(wanted: DataFrame, names: DataFrame, path_of: DataFrame | None = None) -> DataFrame:
    """All ancestors of the wanted taxa, themselves included, each once: with their names.

    ``wanted``: id. ``names``: id, parent_id, name. ``path_of``: id, path, when paths are stored already; without
    them the walk starts from the wanted ids. The path
    is exploded and equi-joined; testing arrays against ids would be a nested loop.
    """
    tree = path_of if path_of is not None else paths(names, wanted)
    nodes = expand_path(tree.join(wanted.select("id"), "id", "left_semi"), "path", "ancestor_id").select(F.col("ancestor_id").alias("id"))
    return names.join(nodes.distinct(), "id", "left_semi")


def with_rank_ancestor(taxa: DataFrame, path_of: DataFrame, ranked: DataFrame, into: str) -> DataFrame:
    """Each taxon with its ancestor of one rank (its phylum, say). ``ranked``: id, name of the taxa of that rank."""
    steps = expand_path(path_of, "path", "ancestor_id")
    hit = steps.join(ranked.select(F.col("id").alias("ancestor_id"), F.col("name").alias(into)), "ancestor_id")
    return taxa.join(hit.select("id", into), "id", "left")


def term_tree_rollup(terms: DataFrame, links: DataFrame, scores: DataFrame, root: Column, excluded: Column | None = None) -> DataFrame:
    """Per node of a term tree below a root: chain text, depth, linked species and a quality index.

    ``terms``: id, parent_id, term. ``links``: id (of the term), taxon_id. ``scores``: taxon_id, score. The index is
    the mean score of the distinct species times 100, rounded; null without any.
    """
    tree = descend(terms, root, excluded)
    pairs = links.select("id", "taxon_id").distinct().join(scores.select("taxon_id", "score"), "taxon_id", "left")
    per = pairs.groupBy("id").agg(
        F.count("taxon_id").alias("species"),
        F.round(F.sum("score") * 100 / F.count("score")).cast("long").alias("quality_index"),
    )
    out = tree.join(per, "id", "left").fillna(0, ["species"])
    return out.select("id", "term", "chain", "depth", "species", "quality_index")


def search_keys(names: DataFrame, columns: list[str]) -> DataFrame:
    """Names with the key column a search runs on; store it sorted by key so that a prefix prunes row groups."""
    return names.withColumn("search_key", name_key(columns[0]))


def name_search(names: DataFrame, query: str, key: str = "search_key") -> DataFrame:
    """Names whose key starts with the key of the query."""
    return names.where(F.col(key).startswith(name_key(F.lit(query))))


# Designation id, abbreviation, label shown, class of the label.
DESIGNATIONS = [
    (304, "RedList_GB_Pre94-Insu", "[Threat]", "IUCN Threat listing"),
    (314, "RedList_pre94-Insu", "[Threat]", "IUCN Threat listing"),
    (354, "BAP-1997", "BAP", "Legal listing"),
    (356, "BAP-Middle", "BAP", "Legal listing"),
    (358, "BAP-2007", "BAP", "Legal listing"),
    (377, "England_NERC_S.41", "S41. Priority Species", "Legal listing"),
    (382, "Legal Protection", "Legal protection", "Legal listing"),
    (383, "Legal Protection", "Legal protection", "Legal listing"),
    (384, "Legal Protection", "Legal protection", "Legal listing"),
    (390, "NT (European)", "NT (European)", "IUCN Threat listing"),
    (391, "CR (European)", "CR (European)", "IUCN Threat listing"),
    (392, "VU (European)", "VU (European)", "IUCN Threat listing"),
    (393, "DD (European)", "DD (European)", "IUCN Threat listing"),
    (394, "EN (European)", "EN (European)", "IUCN Threat listing"),
    (395, "Legal Protection", "Legal protection", "Legal listing"),
    (396, "Legal Protection", "Legal protection", "Legal listing"),
    (397, "Legal Protection", "Legal protection", "Legal listing"),
    (398, "Legal Protection", "Legal protection", "Legal listing"),
    (399, "Legal Protection", "Legal protection", "Legal listing"),
    (400, "NR (marine)", "Nationally Rare (marine species)", "GB Rarity listing"),
    (402, "NS (marine)", "Nationally Scarce (marine species)", "GB Rarity listing"),
    (404, "NS", "Nationally Scarce", "GB Rarity listing"),
    (405, "RDB 3", "[Rare]", "GB Rarity listing"),
    (406, "NR", "Nationally Rare", "GB Rarity listing"),
    (407, "RDB K", "[Threat]", "IUCN Threat listing"),
    (408, "RE", "RE", "IUCN Threat listing"),
    (409, "RDB 2", "[Threat]", "IUCN Threat listing"),
    (410, "RDB 1", "[Threat]", "IUCN Threat listing"),
    (411, "Nb", "[Scarce]", "GB Rarity listing"),
    (412, "RDB I", "[Threat]", "IUCN Threat listing"),
    (413, "Na", "[Scarce]", "GB Rarity listing"),
    (414, "Notable", "[Scarce]", "GB Rarity listing"),
    (417, "pRDB 3", "[Rare]", "GB Rarity listing"),
    (418, "pRDB 1", "[Threat]", "IUCN Threat listing"),
    (419, "pRDB 2", "[Threat]", "IUCN Threat listing"),
    (421, "LC", "LC", "IUCN Threat listing"),
    (423, "DD", "DD", "IUCN Threat listing"),
    (424, "VU", "VU", "IUCN Threat listing"),
    (425, "NT", "NT", "IUCN Threat listing"),
    (426, "EN", "EN", "IUCN Threat listing"),
    (427, "CR", "CR", "IUCN Threat listing"),
    (428, "pVU", "pVU", "IUCN Threat listing"),
    (429, "pLC", "pLC", "IUCN Threat listing"),
    (430, "pEN", "pEN", "IUCN Threat listing"),
    (431, "pNT", "pNT", "IUCN Threat listing"),
    (433, "pDD", "pDD", "IUCN Threat listing"),
    (435, "pCR", "pCR", "IUCN Threat listing"),
    (437, "RE", "RE", "IUCN Threat listing"),
    (438, "CR(PE)", "CR(PE)", "IUCN Threat listing"),
    (440, "(LR)", "[Threat]", "IUCN Threat listing"),
    (442, "Section 41 Priority Species - research only", "S41. Priority Species - research only", "Legal listing"),
    (443, "Section 41 Priority Species", "S41. Priority Species", "Legal listing"),
    (471, "RE", "RE", "IUCN Threat listing"),
    (472, "[Nb]", "[Scarce]", "GB Rarity listing"),
    (473, "[RDB 1]", "[Threat]", "IUCN Threat listing"),
    (474, "NA", "NA", "IUCN Threat listing"),
    (475, "[RDB 2]", "[Threat]", "IUCN Threat listing"),
    (476, "[RDB K]", "[Threat]", "IUCN Threat listing"),
    (477, "[RDB 3]", "[Threat]", "IUCN Threat listing"),
    (478, "[Na]", "[Scarce]", "GB Rarity listing"),
    (479, "[RDB I]", "[Threat]", "IUCN Threat listing"),
    (481, "[NR]", "[Rare]", "GB Rarity listing"),
    (482, "[Extinct]", "[Threat]", "IUCN Threat listing"),
    (483, "[Not assessed]", "[Threat]", "IUCN Threat listing"),
    (485, "[Notable]", "[Scarce]", "GB Rarity listing"),
    (486, "[NS]", "[Scarce]", "GB Rarity listing"),
    (487, "pNS", "pNS", "GB Rarity listing"),
    (489, "NR", "Nationally Rare", "GB Rarity listing"),
]


def designation_mapping(spark: SparkSession) -> DataFrame:
    """The fixed designation rows: designation_id, abbreviation, label, label_class."""
    return spark.createDataFrame(DESIGNATIONS, "designation_id long, abbreviation string, label string, label_class string")


def designations_of(taxon_designations: DataFrame) -> DataFrame:
    """Taxa with their mapped designations: labels, and the number per class (bracketed labels apart).

    ``taxon_designations``: taxon_id, designation_id. The mapping is a literal table, so it is broadcast.
    """
    mapping = F.broadcast(designation_mapping(taxon_designations.sparkSession))
    hits = taxon_designations.join(mapping, "designation_id")
    bracketed = F.col("label").startswith("[")
    shown = F.when(bracketed, F.concat(F.lit("["), F.col("label_class"), F.lit("]"))).otherwise(F.col("label_class"))
    per = hits.groupBy("taxon_id", shown.alias("shown")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("labels"))
    summary = F.array_sort(F.collect_list(F.concat("shown", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels"))))
    return per.groupBy("taxon_id").agg(
        F.array_join(labels, "; ").alias("current_designations"), F.array_join(summary, "; ").alias("designation_summary")
    )


def trait_index(taxa: DataFrame, values: DataFrame, many: dict[int, str], single: dict[int, str], designations: DataFrame, associations: DataFrame, size: int = 10000) -> DataFrame:
    """One wide row per species that has any trait: text lists of multi-valued traits, single values, designations, associates.

    A species may have any number of associates: ``size`` of them, by name, are a ``page``, and a species has a row for each
    page, the first for those without any. The other lists hold terms of fixed lists.

    ``values``: taxon_id, attribute_id, term, number. Every branch is grouped by taxon before it is
    joined, so branches do not multiply each other. ``associations``: taxon_id, name.
    """
    ids = [*many, *single]
    traits = (
        values.where(F.col("attribute_id").isin(ids))
        .groupBy("taxon_id")
        .agg(
            *[join_text(F.when(F.col("attribute_id") == i, F.col("term")), "; ").alias(n) for i, n in many.items()],
            *[F.max(F.when(F.col("attribute_id") == i, F.col("number"))).alias(n) for i, n in single.items()],
        )
    )
    others = paged_text(associations, "taxon_id", "name", "associations", ", ", size)
    out = taxa.join(traits, "taxon_id").join(designations_of(designations), "taxon_id", "left")
    return out.join(others, "taxon_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))


def trait_index_rebuild(index: DataFrame, name: str, version: str, folder: str) -> DataFrame:
    """Store a freshly built index as the next version of ``name``."""
    return rebuild(index, name, version, folder)


# Fixed value: how the title of a country's list begins.
LIST_PREFIX = "EBMS Country List - "


def wanted_lists(countries: DataFrame, prefix: str = LIST_PREFIX) -> DataFrame:
    """Lists that should exist, one per country: title, description. ``countries``: code, place_name (may be null)."""
    text = F.concat(  # fixed value: the description
        F.lit("List generated for managing the species list for "),
        F.col("code"),
        F.coalesce(F.concat(F.lit(" ("), F.col("place_name"), F.lit(").")), F.lit(".")),
    )
    per = countries.groupBy("code").agg(F.min("place_name").alias("place_name"))
    return per.select(F.concat(F.lit(prefix), F.col("code")).alias("title"), text.alias("description"))


def wanted_entries(links: DataFrame, prefix: str = LIST_PREFIX, absent: str = "A") -> DataFrame:
    """Entries that should exist: title, taxon_id, metadata. ``links``: code, taxon_id, presence; absences are left out."""
    present = links.where(F.col("presence") != absent)
    per = present.groupBy("code", "taxon_id").agg(F.min("presence").alias("presence"))
    return per.select(
        F.concat(F.lit(prefix), F.col("code")).alias("title"),
        "taxon_id",
        F.to_json(F.struct(F.col("presence").alias("presence_code"))).alias("metadata"),
    )


def country_list_sync(countries: DataFrame, links: DataFrame, lists: DataFrame, entries: DataFrame, prefix: str = LIST_PREFIX):
    """Changes that bring stored lists and entries in line with the attributes: (list changes, entry changes).

    Lists no longer wanted are left alone, as their entries are what gets removed; entries are inserted,
    re-described or marked deleted.
    """
    list_changes = sync_set(wanted_lists(countries, prefix), lists, ["title"], ["description"]).where(F.col("change") != "D")
    entry_changes = sync_set(wanted_entries(links, prefix), entries, ["title", "taxon_id"], ["metadata"])
    return list_changes, entry_changes


def list_catalogue(lists: DataFrame, entries: DataFrame, groups: DataFrame, places: DataFrame, prefix: str = LIST_PREFIX, size: int = 10000) -> DataFrame:
    """All lists with their groups and places as JSON text, region code, taxa and species groups.

    A list may have any number of places: ``size`` of them are a ``page``, and a list has a row for each page, the first
    for a list without places.

    ``lists``: list_id, title. ``entries``: list_id, taxon_id, taxon_group_id. ``groups``: list_id, group_id, group_title.
    ``places``: list_id, location_id, location_name. Each side is aggregated before it is joined.
    """

    bracketed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    item = lambda *fields: F.to_json(F.struct(*fields)).alias("item")
    in_groups = groups.groupBy("list_id").agg(bracketed(join_text(item("group_id", "group_title"), ",")).alias("group_info"))
    at = paged_text(places.select("list_id", item("location_id", "location_name")), "list_id", "item", "location_info", ",", size)
    per_taxon = entries.groupBy("list_id", "taxon_id").agg(F.max("taxon_group_id").alias("taxon_group_id"))
    taxa = per_taxon.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("taxa_count"), join_text("taxon_group_id", ",").alias("species_groups")
    )
    out = (
        lists.join(in_groups, "list_id", "left")
        .join(at.withColumn("location_info", bracketed(F.col("location_info"))), "list_id", "left")
        .join(taxa, "list_id", "left")
    )
    code = F.when(F.col("title").startswith(prefix), F.replace("title", F.lit(prefix), F.lit("")))
    return out.select(
        "list_id",
        "title",
        F.coalesce("group_info", F.lit("[]")).alias("group_info"),
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        F.coalesce("location_info", F.lit("[]")).alias("location_info"),
        code.alias("region_code"),
        F.coalesce("taxa_count", F.lit(0)).alias("taxa_count"),
        F.concat(F.lit("["), F.coalesce("species_groups", F.lit("")), F.lit("]")).alias("species_groups"),
    )
