"""Jobs about recorders: leaderboards, scores, lapsed and broken accounts, allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import full_name
from ..operators import filters
from ..operators.aggregate import capped, count_if, exact_sum, join_text, paged_text, pct
from ..operators.windows import latest_per, position


def leaderboard(
    visits: DataFrame,
    records: DataFrame,
    taxa: DataFrame,
    date_from=None,
    date_to=None,
    excluded_users: list | None = None,
    by: str = "visits",
    viewer: int | None = None,
) -> DataFrame:
    """Per user: visits, distance, minutes, records, species, groups, and the league position.

    ``visits``: visit_id, user_id, date_start, distance, minutes. ``records``: visit_id, taxon_id.
    ``taxa``: taxon_id, taxon_group. Records shrink to (user, taxon) before groups are looked up.
    Ties in position go to the lower user id.
    """
    chosen = filters.date_overlap(visits, date_from, date_to, "date_start", "date_start")
    chosen = filters.opt(chosen, excluded_users, lambda v: ~F.col("user_id").isin(list(v)))
    effort = chosen.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("visits"),
        exact_sum("distance").alias("distance"),
        F.sum("minutes").alias("minutes"),
    )
    seen = (
        records.select("visit_id", "taxon_id")
        .join(chosen.select("visit_id", "user_id"), "visit_id")
        .groupBy("user_id", "taxon_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = (
        seen.join(taxa.select("taxon_id", "taxon_group"), "taxon_id", "left")
        .groupBy("user_id")
        .agg(
            F.sum("n").alias("records"),
            F.count(F.lit(1)).alias("species"),
            F.countDistinct("taxon_group").alias("groups"),
        )
    )
    board = effort.join(found, "user_id", "left").fillna(0, ["records", "species", "groups"])
    ranked = position(board, [F.col(by).desc(), F.col("user_id").asc()])
    if viewer is None:
        return ranked
    return ranked.withColumn("who", F.when(F.col("user_id") == viewer, "me").otherwise("other"))


def user_totals(records: DataFrame, all_species: int, mode: str = "floor") -> DataFrame:
    """Per user: records, species and species as per cent of a fixed list size."""
    per_taxon = records.groupBy("user_id", "taxon_id").agg(F.count(F.lit(1)).alias("n"))
    out = per_taxon.groupBy("user_id").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("species"))
    return out.withColumn("pct_of_list", pct(F.col("species"), F.lit(all_species), mode))


def challenge_score(
    records: DataFrame, taxa: DataFrame, members: DataFrame, per_group: int = 20, total: int = 100, groups: int = 10
) -> DataFrame:
    """Species score (capped per group, then in all) and group score of every member, also with no record."""
    species = records.select("user_id", "taxon_id").distinct().join(members.select("user_id"), "user_id", "left_semi")
    per = (
        species.join(taxa.select("taxon_id", "taxon_group"), "taxon_id")
        .groupBy("user_id", "taxon_group")
        .agg(capped(F.count(F.lit(1)), per_group).alias("n"))
    )
    score = per.groupBy("user_id").agg(
        capped(F.sum("n"), total).alias("species_score"), capped(F.count(F.lit(1)), groups).alias("groups_score")
    )
    return members.join(score, "user_id", "left").fillna(0, ["species_score", "groups_score"])


def award_matrix(members: DataFrame, awards: DataFrame, levels: int) -> DataFrame:
    """Every member with every level of a milestone scheme, and whether the level was reached.

    ``members``: user_id, group_id. ``awards``: user_id, level.
    """
    spine = members.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    reached = awards.select("user_id", "level", F.lit(True).alias("_got")).distinct()
    out = spine.join(reached, ["user_id", "level"], "left")
    return out.withColumn("reached", F.when(F.col("_got"), "Yes").otherwise("No")).drop("_got")


def activity_by_form(records: DataFrame) -> DataFrame:
    """Per user and recording form: first and last use, records. ``records``: user_id, form, created_on."""
    return records.groupBy("user_id", "form").agg(
        F.min("created_on").alias("first_use"), F.max("created_on").alias("last_use"), F.count(F.lit(1)).alias("records")
    )


def records_by_date_basis(records: DataFrame, basis: str, date_from, date_to, by_user: bool = True) -> DataFrame:
    """Records per recorder, or in all, in a date range of the field date or of the input date.

    ``records``: user_id, seen_on, created_on. ``basis``: ``field`` or ``input``.
    """
    column = {"field": "seen_on", "input": "created_on"}[basis]
    chosen = filters.date_overlap(records, date_from, date_to, column, column)
    per = chosen.groupBy("user_id").agg(F.count(F.lit(1)).alias("records"))
    if by_user:
        return per
    return per.agg(F.count("user_id").alias("recorders"), F.sum("records").alias("records"))


def lapsed_allocations(allocations: DataFrame, visits: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(allocations by others, before ``cutoff``, of people with no visit since; last_visit of every user)"""
    since = dates.as_date(cutoff)
    last = visits.groupBy("user_id").agg(F.max("date_start").alias("last_visit"))
    active = last.where(F.col("last_visit") >= since)
    approved = allocations.where((F.col("approved_by_id") != F.col("user_id")) & (F.col("approved_on") < since))
    return approved.join(active, "user_id", "left_anti"), last


def lapsed_users(people: DataFrame, allocations: DataFrame, visits: DataFrame, cutoff, size: int = 10000) -> DataFrame:
    """Allocated people with no visit since ``cutoff``, with their places and the date of their last visit.

    ``size`` places, by name, are a ``page``; a person has a row for each. All pages have all dates of approval, which are days.

    Allocations made by the person themselves, or after the cutoff, do not count.
    ``allocations``: user_id, place_name, approved_by_id, approved_on.
    """
    lapsed, last = lapsed_allocations(allocations, visits, cutoff)
    days = lapsed.groupBy("user_id").agg(join_text(F.date_format("approved_on", "dd/MM/yyyy")).alias("approval_dates"))
    places = paged_text(lapsed, "user_id", "place_name", "places", ", ", size)
    out = people.join(days, "user_id").join(places, "user_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))
    return out.join(last, "user_id", "left").withColumn(
        "last_visit", F.date_format("last_visit", "dd/MM/yyyy")
    )


def unallocated_users(people: DataFrame, allocations: DataFrame) -> DataFrame:
    """People without any live allocation."""
    return people.join(allocations.select("user_id"), "user_id", "left_anti")


def deleted_but_allocated(allocations: DataFrame, live_users: DataFrame) -> DataFrame:
    """People holding allocations whose account is gone, with the places they hold."""
    return (
        allocations.join(live_users.select("user_id"), "user_id", "left_anti")
        .groupBy("user_id")
        .agg(join_text("place_name").alias("places"), F.count(F.lit(1)).alias("allocations"))
    )


# States of an account and of a person.
ACCOUNT_GONE, ACCOUNT_MISSING = "Warehouse User Account Present But Deleted", "Warehouse User Account Missing"
PERSON_GONE, PERSON_MISSING = "Warehouse Person Account Present But Deleted", "Warehouse Person Account Missing"


def broken_accounts(visits: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """Visit creators whose account or person row is missing or deleted.

    Visits shrink to distinct creators first. ``users``: user_id, person_id, deleted. ``people``:
    person_id, surname, deleted.
    """
    creators = visits.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    own = creators.join(users.select("user_id", "person_id"), "user_id", "left")
    accounts = users.groupBy("person_id").agg(
        count_if(F.col("deleted") == F.lit(False)).alias("live_users"), count_if(F.col("deleted")).alias("deleted_users")
    )
    persons = people.select("person_id", "surname", F.col("deleted").alias("person_deleted"))
    found = own.join(accounts, "person_id", "left").join(persons, "person_id", "left")

    def state(live: Column, deleted: Column, gone: str, missing: str) -> Column:
        return F.when(F.coalesce(live, F.lit(False)), "OK").when(F.coalesce(deleted, F.lit(False)), gone).otherwise(missing)

    account = state(F.col("live_users") > 0, F.col("deleted_users") > 0, ACCOUNT_GONE, ACCOUNT_MISSING)
    person = state(~F.col("person_deleted"), F.col("person_deleted"), PERSON_GONE, PERSON_MISSING)
    out = found.select(
        "user_id",
        F.coalesce("surname", F.lit("Person name not found")).alias("surname"),
        account.alias("account_state"),
        person.alias("person_state"),
    )
    return out.where((F.col("account_state") != "OK") | (F.col("person_state") != "OK"))


def inactive_or_orphaned_users(people: DataFrame, allocations: DataFrame, visits: DataFrame, users: DataFrame, cutoff) -> DataFrame:
    """All four account checks as one list: user_id, problem."""
    live_users = filters.live(users)
    checks = {
        "lapsed": people.join(lapsed_allocations(allocations, visits, cutoff)[0].select("user_id"), "user_id", "left_semi"),
        "unallocated": unallocated_users(people, allocations),
        "deleted but allocated": deleted_but_allocated(allocations, live_users),
        "broken account": broken_accounts(visits, users, people),
    }
    out = None
    for problem, df in checks.items():
        rows = df.select("user_id", F.lit(problem).alias("problem"))
        out = rows if out is None else out.unionByName(rows)
    return out


def owner_mismatch(records: DataFrame, owners: DataFrame, people: DataFrame) -> DataFrame:
    """Imported records whose stated email is not their owner's, with the proposed owner.

    ``records``: record_id, user_id, stated_email, stated_surname, stated_first_name (imported ones).
    ``owners``: user_id, email, surname, first_name. ``people``: email of live people.
    """
    known = people.where(F.col("email").isNotNull()).select(F.lower("email").alias("stated_key"), F.lit(True).alias("known")).distinct()
    stated = records.withColumn("stated_key", F.lower("stated_email"))
    both = stated.join(owners, "user_id").where(F.col("stated_key") != F.lower("email"))
    return both.join(known, "stated_key", "left").select(
        "record_id",
        full_name("first_name", "surname").alias("current_owner"),
        F.col("email").alias("current_email"),
        full_name("stated_first_name", "stated_surname").alias("proposed_owner"),
        F.col("stated_email").alias("proposed_email"),
        F.when(F.col("known"), "Yes").otherwise("No").alias("person_exists"),
    )


def visible_plots(plots: DataFrame, allocations: DataFrame, user_id: int, admins: list[int] | None = None, limit: int = 2) -> DataFrame:
    """Plots a user may see: their own, or those on a square with fewer than ``limit`` allocations.

    ``plots``: plot_id, square_id, created_by_id. ``allocations``: square_id.
    """
    counts = allocations.groupBy("square_id").agg(F.count(F.lit(1)).alias("allocations"))
    out = plots.join(counts, "square_id", "left").fillna(0, ["allocations"])
    if admins and user_id in admins:
        return out
    return out.where((F.col("created_by_id") == user_id) | (F.col("allocations") < limit))


def allocation_status(allocations: DataFrame, people: DataFrame, viewer_is_admin: bool | Column, user_id: int | None = None) -> DataFrame:
    """Allocations with their approval state; a person's own allocation awaits approval. Email for admins only.

    ``allocations``: allocation_id, user_id, place_name, updated_by_id.
    """
    chosen = filters.opt(allocations, user_id, lambda v: F.col("user_id") == v)
    waiting = F.col("updated_by_id") == F.col("user_id")
    out = chosen.join(people.select("user_id", "person_name", "email"), "user_id", "left").withColumn(
        "status", F.when(waiting, "Awaiting approval").otherwise("Approved")
    )
    out = out.withColumn("status_int", F.when(waiting, 0).otherwise(1))
    shown = viewer_is_admin if isinstance(viewer_is_admin, Column) else F.lit(viewer_is_admin)
    return filters.mask(out, "email", shown)


def latest_per_email(signups: DataFrame) -> DataFrame:
    """Last opted-in visit per lower-cased email. ``signups``: visit_id, email, created_on, opted_in."""
    opted = signups.where(F.col("opted_in") & F.col("email").isNotNull()).withColumn("email", F.lower("email"))
    return latest_per(opted.drop("opted_in"), ["email"], ["created_on", "visit_id"])


def user_id_remap(lookup: DataFrame, mappings: DataFrame, values: DataFrame, places: DataFrame, pairs: dict, old_attr: int, new_attr: int):
    """Move attribute rows from old to new user ids; returns (mappings, values).

    ``lookup``: old_id, new_id, website_id. ``mappings``: the same, already recorded. ``values``: value_id,
    place_id, attribute_id, int_value. ``places``: place_id, place_type. ``pairs``: website_id -> place types it covers.
    New mappings are appended for ids not mapped yet; only rows of ``old_attr`` on matching places change.
    """
    missing = lookup.join(mappings.select("old_id", "website_id"), ["old_id", "website_id"], "left_anti")
    mapped = mappings.unionByName(missing)
    types = [(w, t) for w, kinds in pairs.items() for t in kinds]
    covered = values.sparkSession.createDataFrame(types, "website_id long, place_type long")
    # Literal table of (website, place type) pairs; one target per (type, old id).
    targets = (
        mapped.join(F.broadcast(covered), "website_id")
        .groupBy("place_type", F.col("old_id").alias("int_value"))
        .agg(F.max("new_id").alias("_new"))
    )
    rows = values.join(places.select("place_id", "place_type"), "place_id", "left").join(targets, ["place_type", "int_value"], "left")
    moved = (F.col("attribute_id") == old_attr) & F.col("_new").isNotNull()
    changed = rows.select(
        "value_id",
        "place_id",
        F.when(moved, F.lit(new_attr)).otherwise(F.col("attribute_id")).alias("attribute_id"),
        F.when(moved, F.col("_new")).otherwise(F.col("int_value")).alias("int_value"),
    )
    return mapped, changed
