"""Listings on small tables whose results are written out."""

from __future__ import annotations

import datetime as dt

from fieldtally.operators import spatial
from fieldtally.plans import listings


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_sightings_of_children_count_and_records_of_nothing_do_not(spark):
    day = dt.date(2020, 1, 1)
    visits = spark.createDataFrame(
        [(1, None, 7, 3, day), (2, 1, 7, 3, day), (3, None, 8, 3, day), (4, 99, 8, 3, day)],
        "visit_id long, parent_id long, user_id long, group_id long, date_start date",
    )
    records = spark.createDataFrame([(1, False), (2, False), (2, True), (3, True), (4, False)], "visit_id long, zero_abundance boolean")
    assert rows(listings.activity_visits(visits, records), "visit_id", "sightings") == [(1, 2), (3, 0)]


def test_plants_come_first_and_habitats_are_text_or_rows(spark):
    records = spark.createDataFrame([(1, 5, 1, None, "here"), (2, 6, 2, 9, "there")], "record_id long, visit_id long, taxon_id long, place_id long, site_text string")
    taxa = spark.createDataFrame([(1, None, "A", "F", "n"), (2, "Fungi", "Z", "F", "n")], "taxon_id long, kingdom string, order_taxon string, family string, name string")
    places = spark.createDataFrame([(9, "Wood")], "place_id long, place_name string")
    habitats = spark.createDataFrame([(5, 1), (5, 2), (5, 2), (5, 3)], "visit_id long, term_id int")
    terms = spark.createDataFrame([(1, "mire"), (2, "heath")], "term_id int, term string")
    one = listings.taxonomy_download(records, taxa, places, habitats, terms)
    assert rows(one, "row_no", "record_id", "site", "habitat") == [(1, 2, "Wood", None), (2, 1, "here", "heath, mire")]
    many = listings.taxonomy_download(records, taxa, places, habitats, terms, per_habitat=True)
    assert rows(many, "row_no", "record_id", "habitat") == [(1, 2, None), (2, 1, "heath"), (3, 1, "mire"), (4, 1, None)]


def test_section_codes(spark):
    sites = spark.createDataFrame([(1, "Dale", "D1", 4), (2, "Fell", None, 4), (3, "Tarn", "T", 5)], "site_id int, site_name string, site_code string, type_id int")
    sections = spark.createDataFrame([(10, 1, "a", "S12"), (11, 2, "b", "S3"), (12, 2, "c", None), (13, 3, "d", "S1")], "section_id int, parent_id int, section_name string, section_code string")
    types = spark.createDataFrame([(4, "Transect")], "type_id int, site_type string")
    out = listings.site_sections(sites, sections, types)
    assert rows(out, "section_id", "unique_code") == [(10, "D1.12"), (11, "Fell.3"), (12, None)]


def test_attributes_in_use_twice_do_not_multiply(spark):
    places = spark.createDataFrame([(1, "Dale")], "place_id int, place_name string")
    values = spark.createDataFrame([(1, 1, 70), (1, 2, 71), (1, 7, 15)], "place_id int, attribute_id int, value long")
    attributes = spark.createDataFrame([(1, "owner"), (2, "owner"), (7, "sections")], "attribute_id int, caption string")
    used = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (7, 5)], "attribute_id int, website_id int")
    assert rows(listings.app_sites(places, values, attributes, used, 5, "owner", "sections")) == [(1, 70, 15, "Dale")]
    assert listings.app_sites(places, values, attributes, used, 6, "owner", "sections").count() == 0


def test_signs_in_a_prefix_are_plain(spark):
    values = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 3, 0), (2, 3, None)], "visit_id int, attribute_id int, value int")
    attributes = spark.createDataFrame([(1, "Crop_oats"), (2, "Cropped"), (3, "Crop_rye")], "attribute_id int, caption string")
    assert rows(listings.landscape_values(values, attributes, ["Crop_"])) == [(1, "Crop_oats", 3)]


def test_workflow_filters_and_results(spark):
    visits = spark.createDataFrame([(1, 7, "I", dt.date(2020, 1, 2)), (2, 7, "C", dt.date(2021, 1, 2)), (3, 8, None, None)], "visit_id int, user_id int, status string, created_on date")
    values = spark.createDataFrame([(1, 40), (2, 10)], "visit_id int, term_id int")
    terms = spark.createDataFrame([(40, "added", 40), (10, "sent", 39)], "term_id int, term string, sort_order int")
    out = listings.workflow_visits(visits, values, terms)
    assert rows(out, "visit_id", "workflow_status", "data_entry", "results_ready") == [(1, "added", "Incomplete", True), (2, "sent", "Complete", False), (3, None, None, False)]
    assert rows(listings.workflow_visits(visits, values, terms, workflow=10, year=2021), "visit_id") == [(2,)]
    assert rows(listings.workflow_visits(visits, values, terms, status="I"), "visit_id") == [(1,)]


def test_packs_without_a_state_are_state_zero(spark):
    visits = spark.createDataFrame([(1, "C"), (2, "C"), (3, "C"), (4, "I")], "visit_id int, status string")
    values = spark.createDataFrame([(1, 5), (1, 5), (2, None)], "visit_id int, value int")
    assert rows(listings.packs_by_state(visits, values, "C"), "visit_id") == [(2,), (3,)]
    assert rows(listings.packs_by_state(visits, values, "C", 5), "visit_id") == [(1,)]


def test_transect_of_the_visit_above(spark):
    visits = spark.createDataFrame(
        [(1, None, 20, None), (2, 1, 21, '{"9": "2.5"}'), (3, 1, 20, '{"9": "far"}'), (4, 77, None, None)], "visit_id int, parent_id int, place_id int, attrs string"
    )
    places = spark.createDataFrame([(20, "T1", None), (21, "P1", 20)], "place_id int, place_name string, parent_id int")
    out = listings.transect_visits(visits, places, 9)
    assert rows(out, "visit_id", "site", "transect", "slope_distance") == [(2, "T1 - P1", "T1", 2.5), (3, "T1", "T1", 0.0), (4, None, None, 0.0)]


def test_a_site_in_two_regions_is_listed_once(spark):
    places = spark.createDataFrame([(1, "in", 4, 5, 5), (2, "out", 4, 50, 50), (3, "no type", 9, 5, 5)], "place_id int, place_name string, type_id int, x int, y int")
    types = spark.createDataFrame([(4, "Trap")], "type_id int, site_type string")
    square = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
    regions = spatial.shapes(spark.createDataFrame([(1, square), (2, square)], "id int, boundary_geom string"))
    assert rows(listings.sites_download(places, types), "place_id") == [(1,), (2,)]
    assert rows(listings.sites_download(places, types, regions), "place_id") == [(1,)]


def test_any_name_of_a_method_finds_its_visits(spark):
    visits = spark.createDataFrame([(1, 7, 1), (2, 8, 2), (3, 7, 3), (4, 7, None)], "visit_id int, user_id int, method_id int")
    people = spark.createDataFrame([(7, "Lee", "Ann"), (8, "Ash", None)], "user_id int, surname string, first_name string")
    methods = spark.createDataFrame([(1, 1, "Spraying", True), (2, 1, "Chwistrellu", False), (3, 2, "Cutting", True)], "id int, meaning_id int, name string, preferred boolean")
    assert rows(listings.treatments(visits, people, methods, "Chwistrellu")) == [(1, "Lee, Ann", "Spraying"), (2, "Ash", "Spraying")]
    assert rows(listings.treatments(visits, people, methods), "visit_id", "method") == [(1, "Spraying"), (2, "Spraying"), (3, "Cutting"), (4, None)]


def test_long_lists_come_in_pages(spark):
    from fieldtally.plans import people, taxonomy

    day = dt.date(2020, 1, 1)
    persons = spark.createDataFrame([(1, "Lee"), (2, "Ash"), (3, "Fox")], "user_id int, surname string")
    held = [(1, p, 9, day) for p in "caba"] + [(2, "d", 2, day), (3, "e", 9, day)]
    allocations = spark.createDataFrame(held, "user_id int, place_name string, approved_by_id int, approved_on date")
    visits = spark.createDataFrame([(1, dt.date(2020, 2, 3)), (3, dt.date(2022, 1, 1))], "user_id int, date_start date")
    out = people.lapsed_users(persons, allocations, visits, "2021-01-01", size=2)
    assert rows(out, "user_id", "page", "places", "approval_dates", "last_visit") == [(1, 0, "a, b", "01/01/2020", "03/02/2020"), (1, 1, "c", "01/01/2020", "03/02/2020")]

    lists = spark.createDataFrame([(1, "A"), (2, "B")], "list_id int, title string")
    entries = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (1, 6, 1)], "list_id int, taxon_id int, taxon_group_id int")
    groups = spark.createDataFrame([(1, 3, "g")], "list_id int, group_id int, group_title string")
    places = spark.createDataFrame([(1, n, "p") for n in (3, 1, 2, 2)], "list_id int, location_id int, location_name string")
    out = taxonomy.list_catalogue(lists, entries, groups, places, size=2)
    place = '{"location_id":%d,"location_name":"p"}'
    assert rows(out, "list_id", "page", "location_info", "taxa_count", "species_groups") == [
        (1, 0, f"[{place % 1},{place % 2}]", 2, "[1,2]"), (1, 1, f"[{place % 3}]", 2, "[1,2]"), (2, 0, "[]", 0, "[]"),
    ]
    assert rows(out, "list_id", "group_info")[-1] == (2, "[]")


def test_walks_of_users_are_given_once_and_not_shuffled_as_pairs(spark):
    visits = [(1, 7, 3), (1, 7, 3), (2, 8, 3), (3, 7, 4), (4, None, 3), (5, 9, None), (6, 9, 5)]
    allocations = [(7, 3), (7, 3), (None, 4), (9, None), (6, 5), (9, 6)]
    v = spark.createDataFrame(visits, "visit_id long, created_by long, place_id long")
    out = listings.walks_of_users(v, spark.createDataFrame(allocations, "user_id long, site_id long"))
    own = {(c, i, c, p) for i, c, p in visits if c is not None}
    given = {(u, i, c, p) for u, s in allocations for i, c, p in visits if s is not None and s == p}
    assert rows(out, "user_id", "visit_id", "created_by", "place_id") == sorted(own | given, key=repr)
    steps = [line.strip(" :+-*()0123456789") for line in out._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert not any(s.startswith(("Exchange", "HashAggregate")) for s in steps[: next(i for i, s in enumerate(steps) if s.startswith("Union"))])


def test_plots_of_a_hot_group_come_from_several_tasks(spark):
    from pyspark.sql import functions as F

    people = spark.range(400).select(F.col("id").alias("user_id"), F.lit(1).alias("group_id"))
    plots = spark.range(50).select(F.col("id").alias("place_id"), F.lit("p").alias("place_name"))
    out = listings.plots_of_groups(people.union(people), plots.select("place_id", F.lit(1).alias("group_id")), plots)
    assert out.count() == 400 * 50 and out.where("plots_in_group <> 50").count() == 0
    assert out.groupBy(F.spark_partition_id()).count().count() > 1


def bytes_a_row(spark, df, path):
    # Without broadcasts, as larger tables are joined.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.write.parquet(str(path))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / spark.read.parquet(str(path)).count()


def test_walks_at_sites_of_many_users_take_few_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    visits = spark.range(1000).select(F.col("id").alias("visit_id"), (F.col("id") * 1_000_003 + 7).alias("created_by"), F.lit(1).cast("long").alias("place_id"))
    allocations = spark.range(4001).select((F.col("id") * 999_983).alias("user_id"), F.lit(1).cast("long").alias("site_id"))
    assert bytes_a_row(spark, listings.walks_of_users(visits, allocations), tmp_path / "walks") < 0.4


def test_fanned_join_gives_the_rows_of_a_join(spark):
    from pyspark.sql import functions as F

    from fieldtally.operators.joins import fanned_join

    key = F.when(F.col("id") % 50 > 0, F.when(F.col("id") % 50 == 1, F.lit(2)).otherwise(F.lit(1)))
    big = spark.range(900).select((F.col("id") % 700).alias("a"), key.alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("n.a"))
    small = spark.range(700).select((F.col("id") % 600).cast("string").alias("b"), key.alias("k"))
    wanted = big.join(small, "k")
    for inner in ("small", "big"):
        out = fanned_join(big, small, ["k"], ["a"], inner=inner)
        assert out.dtypes == wanted.dtypes
        assert out.count() == wanted.count() and out.exceptAll(wanted).count() == 0


def test_plots_of_large_groups_take_few_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    people = spark.range(4000).select((F.col("id") * 999_983).alias("user_id"), F.lit(1).alias("group_id"))
    plots = spark.range(2001).select((F.col("id") * 1_000_003).alias("place_id"), F.sha1(F.col("id").cast("string")).alias("place_name"))
    out = listings.plots_of_groups(people, plots.select("place_id", F.lit(1).alias("group_id")), plots)
    assert bytes_a_row(spark, out, tmp_path / "plots") < 0.4
