"""Jobs on small frames with the corner cases their rules name."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.functions import geo
from fieldtally.operators import spatial
from fieldtally.plans import awards, exports, history, people, sites, summaries, taxonomy
from fieldtally.session import scratch_path

D = dt.date


def walks(spark, data):
    """(visit, user, place, date, start, duration, km, litter) rows as visits with JSON attributes."""
    items = [
        (v, u, p, d, json.dumps({"1715": f"2020-01-01T{start}", "1717": dur, "1718": str(km), "1722": litter}))
        for v, u, p, d, start, dur, km, litter in data
    ]
    return spark.createDataFrame(items, "visit_id long, user_id long, place_name string, date_start date, attrs_json string")


def test_badges_of_one_walker(spark):
    data = [(i, 1, "A" if i < 12 else "B", D(2020, 1, 1) + dt.timedelta(days=7 * i), "07:59" if i < 5 else "08:01", "02:30:00", 4.0 if i else 6.0, "Spotless") for i in range(16)]
    data.append((99, 2, "A", D(2020, 11, 3), "08:00", "01:00:00", 1.0, "Dirty"))
    records = spark.createDataFrame([(0,)] * 10 + [(99,)], "visit_id long")
    built = {(r.user_id, r.badge): r for r in awards.badges_build(walks(spark, data), records, "2020-12-31").collect()}

    def award(user, badge):
        row = built[(user, badge)]
        return row.metric, row.awarded

    assert award(1, "Early Bird") == (5.0, True)
    assert award(2, "Early Bird") == (1.0, False)  # 08:00 itself still counts as early
    assert award(1, "Sperm Whale migration") == (66.0, False)
    assert award(1, "Porpoise") == (12.0, True) and award(1, "Bottlenose Dolphin") == (12.0, True)
    assert award(1, "Short-beaked Common Dolphin") == (12.0, False)
    assert award(1, "Going the distance") == (6.0, True)
    assert award(1, "Time to Track") == (12.0, True)
    assert award(1, "Beachmaster") == (10.0, True) and award(2, "Beachmaster") == (1.0, False)
    assert award(1, "Clean Conscience") == (16.0, True)
    assert award(1, "Four week streak") == (16.0, True)
    quarter = award(1, "Quarterly Track 1 (2020)")
    assert quarter[0] == pytest.approx((4 * 13 + 2) * awards.MILE_FACTOR) and quarter[1] is True
    assert award(1, "Quarterly Track 4 (2020)") == (0.0, False)
    assert award(1, "Ultimate Tracker (2020)") == (1.0, False)
    assert (2, "World Jellyfish Day") in built and (2, "World Basking Shark Day") in built


def test_award_days_are_a_table(spark):
    visits = walks(spark, [(1, 1, "A", D(2021, 4, 27), "09:00", "00:10:00", 1, "x")])
    assert rows(awards.calendar_day_awards(visits), "badge") == [("Marine Mammal Rescue Day",)]


def test_merge_is_sticky_and_repeatable(spark):
    schema = "user_id long, badge string, description string, metric double, metric_meaning string, awarded boolean, icon string"
    stored = schema + ", awarded_on timestamp, updated_on timestamp"
    t0, now = dt.datetime(2020, 1, 1), "2021-05-01"
    current = spark.createDataFrame(
        [
            (1, "A", "d", 10.0, "m", True, "i", t0, t0),  # now below the threshold
            (2, "A", "d", None, "m", False, "i", None, t0),  # stored without a metric
            (3, "A", "d", 4.0, "m", True, "i", t0, t0),  # not computed any more
            (4, "Quarterly Track 1 (2020)", "d", 4.0, "m", True, "i", t0, t0),
            (5, "A", "d", 7.0, "m", False, "i", None, t0),  # unchanged
        ],
        stored,
    )
    build = spark.createDataFrame(
        [(1, "A", "d", 2.0, "m", False, "i"), (2, "A", "d", 9.0, "m", True, "i"), (5, "A", "d", 7.0, "m", False, "i"), (6, "A", "d", 1.0, "m", False, "i")],
        schema,
    )
    merged = awards.badges_merge(current, build, now)
    got = {r.user_id: r for r in merged.collect()}
    today = dt.datetime(2021, 5, 1)
    assert sorted(got) == [1, 2, 3, 5, 6]
    assert got[1].awarded and got[1].awarded_on == t0 and got[1].metric == 2.0 and got[1].updated_on == today
    assert got[2].awarded and got[2].awarded_on == today and got[2].metric == 9.0
    assert got[3].updated_on == t0 and got[3].metric == 4.0
    assert got[5].updated_on == t0 and got[5].awarded_on is None
    assert not got[6].awarded and got[6].awarded_on is None
    again = awards.badges_merge(merged.select(*current.columns), build, "2021-06-01")
    assert rows(again) == rows(merged)


def test_leaderboard_ties_and_absent_records(spark):
    visits = spark.createDataFrame(
        [(1, 1, D(2020, 1, 1), 1.5, 10), (2, 1, D(2020, 2, 1), 2.5, 5), (3, 2, D(2020, 1, 1), 1.0, 1), (4, 2, D(2020, 1, 9), 1.0, 1), (5, 3, D(2019, 1, 1), 1.0, 1), (6, 4, D(2020, 5, 1), 1.0, 1)],
        "visit_id int, user_id int, date_start date, distance double, minutes int",
    )
    records = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 7)], "visit_id int, taxon_id int")
    taxa = spark.createDataFrame([(7, "bee"), (8, "bee")], "taxon_id int, taxon_group string")
    board = people.leaderboard(visits, records, taxa, "2020-01-01", None, excluded_users=[4], viewer=2)
    assert rows(board, "position", "user_id", "visits", "distance", "minutes", "records", "species", "groups", "who") == [
        (1, 1, 2, 4.0, 15, 3, 2, 1, "other"),
        (2, 2, 2, 2.0, 2, 1, 1, 1, "me"),
    ]


def test_challenge_caps(spark):
    records = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 3)], "user_id int, taxon_id int")
    taxa = spark.createDataFrame([(i, f"g{i % 13}") for i in range(200)], "taxon_id int, taxon_group string")
    members = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    assert rows(people.challenge_score(records, taxa, members)) == [(1, 100, 10), (2, 1, 1), (3, 0, 0)]


def test_account_states(spark):
    visits = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (1,), (None,)], "user_id int")
    users = spark.createDataFrame([(1, 1, False), (2, 2, True), (3, 3, False), (5, 5, False)], "user_id int, person_id int, deleted boolean")
    persons = spark.createDataFrame([(1, "A", False), (2, "B", False), (3, "C", True)], "person_id int, surname string, deleted boolean")
    assert rows(people.broken_accounts(visits, users, persons), "user_id", "account_state", "person_state") == [
        (2, "Warehouse User Account Present But Deleted", "OK"),
        (3, "OK", "Warehouse Person Account Present But Deleted"),
        (4, "Warehouse User Account Missing", "Warehouse Person Account Missing"),
        (5, "OK", "Warehouse Person Account Missing"),
    ]


def test_plots_and_allocations(spark):
    plots = spark.createDataFrame([(1, 10, 7), (2, 10, 8), (3, 11, 8), (4, 12, 8)], "plot_id int, square_id int, created_by_id int")
    allocations = spark.createDataFrame([(10,), (10,), (11,)], "square_id int")
    assert rows(people.visible_plots(plots, allocations, 7), "plot_id") == [(1,), (3,), (4,)]
    assert people.visible_plots(plots, allocations, 9, admins=[9]).count() == 4
    held = spark.createDataFrame([(1, 5, "x", 5), (2, 6, "y", 1)], "allocation_id int, user_id int, place_name string, updated_by_id int")
    persons = spark.createDataFrame([(5, "P", "p@x"), (6, "Q", "q@x")], "user_id int, person_name string, email string")
    assert rows(people.allocation_status(held, persons, False), "allocation_id", "status_int", "email") == [(1, 0, None), (2, 1, None)]
    assert rows(people.allocation_status(held, persons, True, 6), "email") == [("q@x",)]


def test_season_keeps_visits_without_records(spark):
    visits = spark.createDataFrame(
        [(1, D(2020, 4, 1), [1, 2], '{"1050":"rose"}'), (2, D(2020, 9, 30), [2], None), (3, D(2020, 10, 1), [2], None), (4, D(2020, 5, 1), None, None)],
        "visit_id int, date_end date, location_ids array<long>, attrs_json string",
    )
    records = spark.createDataFrame([(1, 5, '{"666":"3"}'), (1, 6, "{}")], "visit_id int, taxon_id int, attrs_json string")
    taxa = spark.createDataFrame([(5, "bee")], "taxon_id int, name string")
    got = summaries.seasonal_taxon_flower_counts(visits, records, taxa, [2])
    assert rows(got) == [(1, "bee", "rose", 3), (1, None, "rose", 0), (2, None, None, 0)]


def test_associations_count_both_ends_and_loops_once(spark):
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 1), (4, 5)], "from_id int, to_id int")
    records = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (5, 30)], "record_id int, taxon_id int")
    taxa = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "taxon_id int, name string")
    focal = spark.createDataFrame([(1,)], "record_id int")
    got = summaries.associated_species(focal, edges, records, taxa)
    assert rows(got, "taxon_id", "records", "rank", "font_size") == [(10, 1, 2, 16.5), (20, 2, 1, 24.0)]


def test_union_total_is_the_sum_of_parts(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("key"), (F.col("id") % 11).alias("taxon_id"))
    out = summaries.breakdown_with_total(df, "key").collect()
    total = [r for r in out if r.is_total][0]
    assert total.records == sum(r.records for r in out if not r.is_total) == 300
    assert total.species == 11 and total.label == "Total"


def test_determinations(spark):
    records = spark.createDataFrame([(1, "x", "V", 1, D(2020, 5, 1)), (2, "y", "C", None, None)], "record_id int, taxon string, record_status string, substatus int, verified_on date")
    comments = spark.createDataFrame(
        [(1, 1, "C", 3, D(2020, 4, 1)), (1, 2, "R", 4, D(2020, 4, 2)), (1, 3, "V", 1, D(2020, 6, 1)), (1, 4, None, None, D(2020, 4, 5)), (2, 5, "R", None, D(2020, 1, 1))],
        "record_id int, comment_id int, status string, substatus int, created_on date",
    )
    got = history.last_status_before(records, comments)
    assert rows(got, "record_id", "current_status", "previous_status") == [(1, "accepted as correct", "rejected as unable to verify"), (2, "pending", None)]


def test_documents_of_a_crowded_visit_come_in_pages(spark):
    visits = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "visit_id long, name string")
    records = spark.range(1000).select(F.lit(1).cast("long").alias("visit_id"), F.col("id").alias("record_id"))
    records = records.unionByName(spark.createDataFrame([(2, 5000)], "visit_id long, record_id long"))
    docs = exports.visit_documents(visits, records, [], page_size=100).collect()
    sizes = {(d.visit_id, d.page): d.n_records for d in docs}
    assert len(docs) == 12 and max(sizes.values()) == 100 and sizes[(2, 0)] == 1 and sizes[(3, 0)] == 0
    ids = [r["record_id"] for d in docs if d.visit_id == 1 for r in json.loads(d.doc)["records"]]
    assert sorted(ids) == list(range(1000))


def test_combined_records_need_region_only_for_others(spark):
    records = spark.createDataFrame([(1, 1, 99, 99), (2, 2, 5, 5), (3, 2, 50, 50), (4, 3, 5, 5)], "record_id int, website_id int, x int, y int")
    own = spark.createDataFrame([(1,)], "website_id int")
    agreed = spark.createDataFrame([(1, 2, True)], "from_website_id int, to_website_id int, receive_for_reporting boolean")
    region = spatial.shapes(spark.createDataFrame([(1, "POLYGON((0 0,10 0,10 10,0 10,0 0))")], "id int, boundary_geom string"))
    assert rows(sites.combined_tenant_records(records, own, agreed, region), "record_id") == [(1,), (2,)]
    assert rows(sites.combined_tenant_records(records, own, agreed, region, F.col("x") > 5), "record_id") == [(1,)]
    assert rows(sites.combined_tenant_records(records, own, agreed, region, F.lit(None).cast("boolean")), "record_id") == [(1,)]


def test_clusters_are_not_multiplied_by_known_places(spark):
    visits = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, None), (1.0, 2.0, 7), (2.0, 1.0, 7), (0.0, 0.0, 8), (100.0, 100.0, None)], "x double, y double, place_id int")
    places = spark.createDataFrame([(7, "S"), (8, "A")], "place_id int, place_name string")
    assert rows(sites.unlinked_site_clusters(visits, places, 10), "visits", "suggested") == [(2, "A; S")]


def test_equal_counts_get_the_middle_colour(spark):
    points = spark.createDataFrame([(1, 1), (21, 1)], "x int, y int")
    boxes = [(1, "POLYGON((0 0,10 0,10 10,0 10,0 0))"), (2, "POLYGON((20 0,30 0,30 10,20 10,20 0))")]
    regions = spatial.shapes(spark.createDataFrame(boxes, "id int, boundary_geom string"))
    assert rows(sites.choropleth(points, regions), "opacity", "colour") == [(0.6, "#de806c")] * 2


def test_layer_shares(spark):
    square = spark.createDataFrame([(1, "POLYGON((0 0,100 0,100 100,0 100,0 0))")], "square_id int, w string").select("square_id", geo.parts("w").alias("geom"))
    layers = [(1, "half", "POLYGON((0 0,100 0,0 100,0 0))"), (2, "sliver", "POLYGON((0 0,5 0,5 5,0 5,0 0))"), (3, "beside", "POLYGON((100 0,200 0,200 100,100 100,100 0))")]
    layer = spark.createDataFrame(layers, "layer_id int, layer_name string, w string").select("layer_id", "layer_name", geo.parts("w").alias("geom"))
    assert rows(sites.layer_overlap(square, layer), "layer_name", "pct_covered") == [("half", "50"), ("sliver", "< 1")]


def test_table_versions(spark):
    folder = scratch_path(spark, "t")
    index = spark.createDataFrame([(1, "a")], "taxon_id int, v string")
    taxonomy.trait_index_rebuild(index, "trait_test", "one", folder)
    out = taxonomy.trait_index_rebuild(index.withColumn("v", F.lit("b")), "trait_test", "two", folder)
    assert rows(out) == [(1, "b")] and rows(spark.read.parquet(f"{folder}/trait_test/one")) == [(1, "a")]
    with pytest.raises(ValueError):
        taxonomy.trait_index_rebuild(index, "trait_test", "no; drop", folder)


def test_list_sync_is_stable_after_applying(spark):
    countries = spark.createDataFrame([("GB", "Britain"), ("XX", None)], "code string, place_name string")
    links = spark.createDataFrame([("GB", 1, "P"), ("GB", 2, "A"), ("XX", 1, "M")], "code string, taxon_id int, presence string")
    empty_lists = spark.createDataFrame([], "title string, description string")
    stale = spark.createDataFrame([("EBMS Country List - GB", 9, "{}")], "title string, taxon_id int, metadata string")
    lists, entries = taxonomy.country_list_sync(countries, links, empty_lists, stale)
    assert rows(lists, "description", "change") == [
        ("List generated for managing the species list for GB (Britain).", "I"),
        ("List generated for managing the species list for XX.", "I"),
    ]
    assert rows(entries, "taxon_id", "change") == [(1, "I"), (1, "I"), (9, "D")]
    kept = entries.where("change <> 'D'")
    lists2, entries2 = taxonomy.country_list_sync(countries, links, lists.drop("change"), kept.drop("change"))
    assert {r.change for r in lists2.collect()} == {r.change for r in entries2.collect()} == {"S"}


def test_events_and_media_of_all_visits(spark, folder):
    from fieldtally import checks
    from fieldtally.checks.standin import Frames

    t, queries = Frames(spark, folder), checks.all_queries()
    media = {r["level"]: r["count"] for r in queries["media_list_all"](spark, folder).groupBy("level").count().collect()}
    assert media == {"place": t.places.count(), "visit": t.visits.count(), "record": t.records.count()}
    other = t.visits.where("status <> 'F'").select("visit_id")
    seen = queries["near_points_all"](spark, folder).where("kind = 'visit'")
    assert seen.join(other, seen.event_id == other.visit_id).count() > 0


def test_guild_share_of_all_records(spark, folder):
    from fieldtally import checks
    from fieldtally.checks.standin import Frames

    t = Frames(spark, folder)
    found = checks.all_queries()["guild_share_all"](spark, folder).agg(F.sum("species")).first()[0]
    assert found == t.records.select("taxon_id").distinct().join(t.taxa, "taxon_id").select("taxon_id").distinct().count()
