"""Species and record summaries.

Records are first reduced to one row per (key, taxon), which combines on the map side and spreads
a hot key over its taxa; names and groups are joined to the reduced rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.attributes import json_attr
from ..functions.text import col
from ..operators import filters
from ..operators.aggregate import count_if, panel_rows, pct
from ..operators.joins import join_any
from ..operators.windows import running_total, top_n_other
from ..session import shuffle_tasks


def species_summary(records: DataFrame, taxa: DataFrame) -> DataFrame:
    """Per taxon: records, individuals, first and last date, with names and path text.

    ``records``: taxon_id, seen_on, quantity (a missing quantity counts as one). ``taxa``: taxon_id, name, taxon_group, family.
    """
    per = records.groupBy("taxon_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.coalesce("quantity", F.lit(1))).alias("individuals"),
        F.min("seen_on").alias("first_date"),
        F.max("seen_on").alias("last_date"),
    )
    path = F.concat("taxon_group", F.lit("::"), "family")
    return per.join(taxa, "taxon_id").select(
        "taxon_id", "name", F.coalesce(path, F.lit("")).alias("path"), "records", "individuals", "first_date", "last_date"
    )


def species_per(records: DataFrame, key: str) -> DataFrame:
    """Distinct species, records per key (a visit, a site, a user)."""
    per = records.groupBy(key, "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.count("taxon_id").alias("species"), F.sum("n").alias("records"))


def taxonomy_breakdown(records: DataFrame, taxa: DataFrame, levels: list[str]) -> DataFrame:
    """Records and distinct species per taxonomic level or group."""
    per = records.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(taxa, "taxon_id").groupBy(*levels).agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("species")
    )


def breakdown_with_total(records: DataFrame, key: Column | str, label: str = "Total") -> DataFrame:
    """Records and species per year or group plus a Total row.

    The total's species are counted over all rows; a species of two years counts once there.
    """
    per = records.groupBy(col(key).cast("string").alias("key"), "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.rollup("key").agg(
        F.grouping("key").alias("is_total"), F.sum("n").alias("records"), F.countDistinct("taxon_id").alias("species")
    )
    return out.select(
        F.when(F.col("is_total") == 1, label).otherwise(F.col("key")).alias("label"),
        F.col("is_total").cast("int").alias("is_total"),
        "records",
        "species",
    )


def two_level_counts(records: DataFrame, places: DataFrame, parents: DataFrame, taxa: DataFrame) -> DataFrame:
    """Records per taxon at every place and, added up, at every parent place.

    ``records``: place_id, taxon_id. ``places``: place_id, place_name, parent_id. ``parents``: parent_id, parent_name.
    Both levels come from one grouped frame. Its rows, at most one per place for a taxon, are dealt by taxon over as many tasks as a
    shuffle has: the names need more memory than the size of the shuffled keys, by which tasks are joined otherwise, tells.
    """
    per = records.groupBy("place_id", "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(places.join(parents, "parent_id"), "place_id").select("taxon_id", "n", "place_name", "parent_name").repartition(shuffle_tasks(records), "taxon_id")
    levels = F.array(
        F.struct(F.lit("square").alias("level"), F.col("parent_name").alias("plot")),
        F.struct(F.lit("plot").alias("level"), F.col("place_name").alias("plot")),
    )
    both = named.select("taxon_id", "n", F.inline(levels))
    counts = both.groupBy("level", "plot", "taxon_id").agg(F.sum("n").alias("records"))
    return counts.join(taxa.select("taxon_id", F.col("name").alias("taxon")), "taxon_id").select("level", "plot", "taxon", "taxon_id", "records")


def visits_and_sites_per_species(records: DataFrame, as_of, period: str = "all", user_id: int | None = None) -> DataFrame:
    """Distinct visits and sites per species, for this year, last year or all years, for one user or all.

    ``records``: taxon_id, visit_id, place_id, seen_on, user_id.
    """
    year = F.year(dates.as_date(as_of))
    chosen = filters.branch(
        records,
        period,
        {
            "this": lambda d: d.where(F.year("seen_on") == year),
            "last": lambda d: d.where(F.year("seen_on") == year - 1),
            "all": lambda d: d,
        },
    )
    chosen = filters.opt(chosen, user_id, lambda v: F.col("user_id") == v)
    return chosen.groupBy("taxon_id").agg(
        F.countDistinct("visit_id").alias("visits"), F.countDistinct("place_id").alias("sites")
    )


def verification_counts(records: DataFrame, untouched: tuple = ("C", "I"), verified: str = "V", machine: str = "M") -> DataFrame:
    """Per place and year: untouched, verified, and of the verified those by people and by machine.

    ``records`` has one row per record: place_id, seen_on, record_status, decision_source. No join
    multiplies them, so plain conditional counts are the distinct counts.
    """
    ok = F.col("record_status") == verified
    by_machine = F.coalesce(F.col("decision_source") == machine, F.lit(False))
    out = records.groupBy("place_id", F.year("seen_on").alias("year")).agg(
        count_if(F.col("record_status").isin(*untouched)).alias("untouched"),
        count_if(ok).alias("verified"),
        count_if(ok & ~by_machine).alias("human"),
        count_if(ok & by_machine).alias("machine"),
    )
    text = F.format_string("%d (%d human, %d machine)", "verified", "human", "machine")
    return out.withColumn("verified_text", text)


def trait_counts(records: DataFrame, traits: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Distinct recorded species per trait flag, one row. ``traits``: taxon_id and the columns the flags read."""
    species = records.select("taxon_id").distinct().join(traits, "taxon_id")
    return species.agg(*[count_if(test).alias(name) for name, test in flags.items()])


def guild_share(species: DataFrame, traits: DataFrame, by: list[str]) -> DataFrame:
    """Distinct species per guild (or group, stage ...) and their share of all species of the sample, in per cent.

    ``species``: taxon_id of the sample or list (:func:`sample_species`). ``traits``: taxon_id and the
    ``by`` columns; a species may have several rows.
    """
    listed = species.select("taxon_id").distinct()
    total = listed.agg(F.count(F.lit(1))).scalar()
    per = listed.join(traits, "taxon_id").groupBy(*by).agg(F.countDistinct("taxon_id").alias("species"))
    return per.withColumn("pct", pct(F.col("species"), total))


def sample_species(records: DataFrame, entries: DataFrame, kind: str, ids: list[int] | None = None) -> DataFrame:
    """Species of visits (``sample``) or of curated lists (``list``): the switch the share reports offer."""
    cases = {
        "sample": lambda _: filters.opt(records, ids, lambda v: F.col("visit_id").isin(list(v))).select("taxon_id"),
        "list": lambda _: filters.opt(entries, ids, lambda v: F.col("list_id").isin(list(v))).select("taxon_id"),
    }
    return filters.branch(records, kind, cases).distinct()


def list_overview(records: DataFrame, analysed: DataFrame, by: str | None = None) -> DataFrame:
    """Size of a sample: species, duplicate records, species with and without traits, per cent with.

    ``analysed``: taxon_id with at least one trait. ``by`` gives one row per visit or list.
    """
    keys = [by] if by else []
    per = records.groupBy(*keys, "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    known = analysed.select("taxon_id", F.lit(True).alias("_known")).distinct()
    out = per.join(known, "taxon_id", "left").groupBy(*keys).agg(
        F.count("taxon_id").alias("species"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        count_if(F.col("_known")).alias("analysed"),
    )
    return out.withColumn("not_analysed", F.col("species") - F.col("analysed")).withColumn(
        "pct_return", pct(F.col("analysed"), F.col("species"), "round")
    )


def stat_panel(**figures: DataFrame) -> DataFrame:
    """Independent totals as rows."""
    return panel_rows(**figures)


def record_totals(records: DataFrame) -> DataFrame:
    """One row: records, individuals, visits, species."""
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("quantity").cast("long").alias("individuals"),
        F.countDistinct("visit_id").alias("visits"),
        F.countDistinct("taxon_id").alias("species"),
    )


def data_accumulation(records: DataFrame, entries: DataFrame, at_least: int = 5) -> DataFrame:
    """Per month: visits and lists with at least so many rows, and their running total.

    ``records``: visit_id, created_on. ``entries``: list_id, created_on. Months with only one kind are kept.
    """

    def monthly(df, key, name):
        rows = df.groupBy(dates.month_text("created_on").alias("month"), key).agg(F.count(F.lit(1)).alias("n"))
        return rows.where(F.col("n") >= at_least).groupBy("month").agg(F.count(F.lit(1)).alias(name))

    both = monthly(records, "visit_id", "visits").join(monthly(entries, "list_id", "lists"), "month", "full")
    both = both.fillna(0, ["visits", "lists"])
    return running_total(both, "month", F.col("visits") + F.col("lists"), "total")


def seasonal_taxon_flower_counts(
    visits: DataFrame,
    records: DataFrame,
    taxa: DataFrame,
    regions: list[int],
    months: tuple[int, int] = (4, 9),
    flower_attr: str = "1050",
    count_attr: str = "666",
) -> DataFrame:
    """Visit, taxon, flower, count rows of a season; visits without a wanted record keep one row with count 0.

    ``visits``: visit_id, date_end, location_ids, attrs_json. ``records``: visit_id, taxon_id, attrs_json.
    """
    season = visits.where(F.month("date_end").between(*months) & filters.has_any("location_ids", regions))
    chosen = season.select("visit_id", json_attr("attrs_json", flower_attr).alias("flower"))
    seen = records.select("visit_id", "taxon_id", json_attr("attrs_json", count_attr, "int").alias("n"))
    named = seen.join(taxa.select("taxon_id", F.col("name").alias("taxon")), "taxon_id", "left")
    return chosen.join(named, "visit_id", "left").select(
        "visit_id", "taxon", "flower", F.coalesce("n", F.lit(0)).alias("n")
    )


def timed_count_species(visits: DataFrame, records: DataFrame, summed: list[int], counted: list[int]) -> DataFrame:
    """Visit x species counts: some surveys add up a count, others count records.

    Records hang on the visit or on one of its child visits. ``visits``: visit_id, survey_id. ``records``:
    sample_id, parent_sample_id, taxon_id, n.
    """
    per = records.groupBy("sample_id", "parent_sample_id", "taxon_id").agg(
        F.sum("n").alias("n_sum"), F.count(F.lit(1)).alias("n_rows")
    )
    both = join_any(
        visits.select("visit_id", "survey_id"), per, [("visit_id", "sample_id"), ("visit_id", "parent_sample_id")]
    )
    rule = F.when(F.col("survey_id").isin(summed), F.coalesce(F.sum("n_sum"), F.lit(0))).when(
        F.col("survey_id").isin(counted), F.sum("n_rows")
    )
    return both.groupBy("visit_id", "survey_id", "taxon_id").agg(rule.cast("long").alias("n"))


def top_n_with_other(records: DataFrame, traits: DataFrame, key: str, n: int = 6) -> DataFrame:
    """Records and species per host (or another trait); only the first ``n`` by species, the rest as Other."""
    per = records.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("records"))
    base = per.join(traits.where(F.col(key).isNotNull()), "taxon_id").groupBy(key).agg(
        F.sum("records").alias("records"), F.countDistinct("taxon_id").alias("species")
    )
    return top_n_other(base, key, "species", ["records", "species"], n)


def associated_species(focal: DataFrame, edges: DataFrame, records: DataFrame, taxa: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` species most often linked to the focal records, whichever end of the link they are on.

    ``focal``: record_id. ``edges``: from_id, to_id. ``records``: record_id, taxon_id. ``font_size`` falls with
    the rank, from 24 in steps of 15 / number of listed species. Links are walked one by one;
    records of a group are never paired up.
    """
    there = F.struct(F.col("from_id").alias("record_id"), F.col("to_id").alias("other_id"))
    back = F.struct(F.col("to_id").alias("record_id"), F.col("from_id").alias("other_id"))
    # A link of a record with itself has only one other end.
    ends = F.when(F.col("from_id") == F.col("to_id"), F.array(there)).otherwise(F.array(there, back))
    links = edges.select(F.inline(ends))
    others = links.join(focal.select("record_id"), "record_id", "left_semi").groupBy("other_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    seen = others.join(records.select(F.col("record_id").alias("other_id"), "taxon_id"), "other_id")
    per = seen.groupBy("taxon_id").agg(F.sum("n").alias("records"))
    head = per.join(taxa.select("taxon_id", "name"), "taxon_id").orderBy(F.col("records").desc(), "name", "taxon_id").limit(n)
    # At most n rows: ranking them in one partition is fine.
    whole = Window.partitionBy()
    rank = F.rank().over(Window.orderBy(F.col("records").desc()))
    size = F.lit(24) - (rank - 1) * 15 / F.count(F.lit(1)).over(whole)
    return head.select("taxon_id", "name", "records", rank.alias("rank"), size.alias("font_size"))


def missing_from_list(records: DataFrame, taxa: DataFrame, listed: DataFrame, rank: str = "all") -> DataFrame:
    """Recorded taxa a curated list lacks, with the date of their last record.

    ``rank``: ``all``, ``species`` or ``species_and_lower`` (rank order 300 and above).
    """
    seen = records.groupBy("taxon_id").agg(F.max("seen_on").alias("last_recorded"))
    named = seen.join(taxa, "taxon_id")
    named = filters.branch(
        named,
        rank,
        {
            "all": lambda d: d,
            "species": lambda d: d.where(F.col("rank_order") == 300),
            "species_and_lower": lambda d: d.where(F.col("rank_order") >= 300),
        },
    )
    return named.join(listed.select("taxon_id"), "taxon_id", "left_anti")
