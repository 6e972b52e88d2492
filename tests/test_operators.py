"""Operators on small frames: nulls, ties, empty input, duplicates, unmatched rows."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.functions import attributes as ja
from fieldtally.functions import dates, text
from fieldtally.operators import aggregate as agg
from fieldtally.operators import attributes as eav
from fieldtally.operators import filters, generators, hierarchy, joins, sync, windows
from fieldtally.sources import cursor, sinks, tables


def test_live_drops_deleted_and_unknown(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "id int, deleted boolean")
    assert rows(filters.live(df), "id") == [(1,)]


def test_blank_parameters():
    assert [filters.none_if(v) for v in ("", "all", 0, "0", "Click here", None, [])] == [None] * 7
    assert filters.none_if(False) is False and filters.none_if(True) is True
    assert filters.none_if("x") == "x" and filters.none_if([1]) == [1] and filters.none_if(7) == 7


def test_branch_rejects_unknown_value(spark):
    with pytest.raises(ValueError):
        filters.branch(spark.range(1), "nope", {"a": lambda d: d})


def test_visibility_keeps_each_row_once(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id int, website_id int")
    own = spark.createDataFrame([(10,), (10,)], "website_id int")
    agreed = spark.createDataFrame(
        [(10, 20, True), (10, 20, True), (10, 30, False), (99, 40, True)],
        "from_website_id int, to_website_id int, receive_for_reporting boolean",
    )
    assert rows(filters.visible(df, own, agreed), "id") == [(1,), (2,)]
    assert rows(filters.visible(df, own), "id") == [(1,)]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("50% cover",), ("500 cover",), (None,)], "t string")
    assert rows(filters.search(df, ["t"], "50%", "prefix")) == [("50% cover",)]
    assert rows(filters.search(df, ["t"], "COVER")) == [("50% cover",), ("500 cover",)]


def test_name_key(spark):
    df = spark.createDataFrame([("Quercus (Oak) robur",), ("Caeruleus-minor",), ("X +Y?",)], "n string")
    assert [r[0] for r in df.select(text.name_key("n")).collect()] == ["quercusrobur", "ceruleusminor", "x+y?"]


def test_concat_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    got = df.select(text.joined(F.col("x"), "-", F.col("y")), text.optional(", ", F.col("y")), text.full_name("y", "x"))
    assert [tuple(r) for r in got.collect()] == [(None, "", "a"), ("a-b", ", b", "a, b")]


def test_source_label(spark):
    df = spark.createDataFrame([("Site", "Site Birds"), ("Site", "Plants"), ("Site", "Site")], "a string, b string")
    assert [r[0] for r in df.select(text.source_label("a", "b")).collect()] == ["Site | Birds", "Site | Plants", "Site"]


def test_durations_and_vague_dates(spark):
    df = spark.createDataFrame([("01:30:15",), ("x",), (None,), ("12:00",)], "d string")
    assert [r[0] for r in df.select(dates.duration_seconds("d")).collect()] == [5415.0, None, None, 43200.0]
    d = dt.date
    df = spark.createDataFrame(
        [(d(2020, 5, 1), d(2020, 5, 1), "D"), (d(2020, 5, 1), d(2020, 5, 9), "DD"), (None, d(2020, 12, 31), "-Y"), (None, None, "U")],
        "s date, e date, k string",
    )
    got = [r[0] for r in df.select(dates.vague_text("s", "e", "k")).collect()]
    assert got == ["01/05/2020", "01/05/2020 to 09/05/2020", "To 2020", "Unknown"]


def test_old_quarter_has_five_buckets(spark):
    df = spark.sql("select explode(sequence(date'2020-01-01', date'2020-12-01', interval 1 month)) as d")
    assert rows(df.select(dates.old_quarter("d").cast("int").alias("q")).distinct()) == [(0,), (1,), (2,), (3,), (4,)]


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for keys, expected in (([(1,)], [(2,)]), ([(1,), (None,)], []), ([], [(1,), (2,), (None,)])):
        right = spark.createDataFrame(keys, "k int")
        assert rows(joins.not_in(left, right, "k")) == sorted(expected, key=repr)


def test_join_any_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 4)], "a int, b int")
    right = spark.createDataFrame([(1,), (5,), (6,), (4,), (None,)], "k int")
    brute = {(a, b, k) for a, b in [(1, 5), (2, 6), (3, None), (4, 4)] for k in [1, 5, 6, 4] if k == a or k == b}
    assert set(rows(joins.join_any(left, right, [("a", "k"), ("b", "k")]), "a", "b", "k")) == brute
    outer = joins.join_any(left, right, [("a", "k"), ("b", "k")], how="left")
    assert set(rows(outer, "a", "b", "k")) == brute | {(3, None, None)}


def test_salted_join_equals_plain_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, n string")
    assert rows(joins.salted_join(big, small, ["k"], ["v"], 8), "k", "v", "n") == rows(big.join(small, "k"), "k", "v", "n")
    left = joins.salted_join(big, small, ["k"], ["v"], 8, "left")
    assert rows(left, "k", "v", "n") == rows(big.join(small, "k", "left"), "k", "v", "n")


def test_pivot_takes_text_lists_and_keeps_entities(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    values = spark.createDataFrame(
        [(1, 10, 1.5, None), (1, 11, None, "b"), (1, 11, None, "a"), (1, 11, None, "a"), (2, 10, 2.0, None), (2, 99, 9.0, None)],
        "id int, attribute_id int, num double, txt string",
    )
    out = eav.with_attrs(entities, values, "id", {10: ("n", "num")}, many={11: ("words", "txt")})
    assert rows(out, "id", "n", "words") == [(1, 1.5, "a; b"), (2, 2.0, None), (3, None, None)]


def test_attribute_list_defaults_to_empty(spark):
    entities = spark.createDataFrame([(1,), (2,)], "id int")
    values = spark.createDataFrame([(1, "x", 1), (1, "a", 2)], "id int, name string, v int")
    out = eav.attrs_list(entities, values, "id", ["name", "v"])
    assert rows(out.select("id", F.to_json("attrs"))) == [(1, '[{"name":"a","v":2},{"name":"x","v":1}]'), (2, "[]")]


def test_json_attributes_with_bad_values(spark):
    df = spark.createDataFrame([('{"1":"5","2":"x"}',), ("nonsense",), (None,)], "j string")
    got = ja.with_json_attrs(df, "j", {"a": ("1", "int"), "b": ("2", "int")}).collect()
    assert [tuple(r) for r in got] == [(5, None), (None, None), (None, None)]
    assert [r[0] for r in df.select(ja.json_attr("j", 1, "int")).collect()] == [5, None, None]


def test_total_counts_distinct_over_all_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), (None, 2)], "k string, t int")
    out = agg.with_total(df, "k", n=F.count(F.lit(1)), species=F.countDistinct("t"))
    assert rows(out, "label", "n", "species") == sorted([("Total", 4, 2), ("a", 2, 2), ("b", 1, 1), (None, 1, 1)], key=repr)


def test_percent_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    got = df.select(agg.pct(F.col("a"), F.col("b")), agg.pct(F.col("a"), F.col("b"), "round")).collect()
    assert [tuple(r) for r in got] == [(33, 33), (None, None)]


def test_paged_groups_lose_nothing(spark):
    df = spark.range(1050).select(F.when(F.col("id") < 1000, 1).otherwise(2).alias("k"), F.col("id"))
    pages = agg.paged(df, ["k"], "id", 100).groupBy("k", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    got = pages.collect()
    assert max(r.n for r in got) <= 100 and sum(r.n for r in got) == 1050 and sum(r.s for r in got) == sum(range(1050))
    assert {r.page for r in got if r.k == 2} == {0} and len([r for r in got if r.k == 1]) == 10


def test_latest_and_earliest_with_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "2020", 1, "a"), (1, "2021", 2, "b"), (1, "2021", 3, "c"), (1, None, 4, "d"), (2, None, 5, "e")],
        "k int, d string, id int, v string",
    )
    assert rows(windows.latest_per(df, ["k"], ["d", "id"]), "k", "v") == [(1, "c"), (2, "e")]
    assert rows(windows.earliest_per(df, ["k"], ["d", "id"]), "k", "v") == [(1, "a"), (2, "e")]


def test_position_and_rank_with_a_hot_tie(spark):
    data = [(i, 1 if i % 3 else 100 + i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "id int, m int").repartition(7)
    got = {r.id: r.position for r in windows.position(df, [F.col("m").desc(), F.col("id").asc()]).collect()}
    expected = {i: n for n, (i, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1)}
    assert got == expected
    ranks = {r.id: r["rank"] for r in windows.rank_of(df, "m").collect()}
    assert ranks == {i: 1 + sum(1 for _, o in data if o > m) for i, m in data}


def test_longest_run_against_a_loop(spark):
    import random

    random.seed(3)
    days = [(u, dt.date(2019, 11, 1) + dt.timedelta(days=random.randrange(400))) for u in range(5) for _ in range(60)]
    days += [(9, dt.date(2020, 12, 28)), (9, dt.date(2021, 1, 4)), (9, dt.date(2021, 1, 6)), (8, None)]
    df = spark.createDataFrame(days, "u int, d date")

    def best(user):
        weeks = sorted({d - dt.timedelta(days=d.weekday()) for u, d in days if u == user and d})
        longest = run = 1 if weeks else 0
        for a, b in zip(weeks, weeks[1:]):
            run = run + 1 if (b - a).days == 7 else 1
            longest = max(longest, run)
        return longest

    got = dict(rows(windows.longest_run(df, "u", "d", "n")))
    assert got == {u: best(u) for u in [0, 1, 2, 3, 4, 9]} and got[9] == 2


def test_other_bucket_needs_more_than_n_plus_one(spark):
    def fold(count):
        df = spark.createDataFrame([(f"k{i:02}", 100 - i) for i in range(count)], "k string, m int")
        return dict(rows(windows.top_n_other(df, "k", "m", ["m"], 6), "k", "m"))

    assert len(fold(7)) == 7 and "Other" not in fold(7)
    nine = fold(9)
    assert len(nine) == 7 and nine["Other"] == 94 + 93 + 92
    assert fold(0) == {}


def test_minmax_of_equal_values(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id int, m int")
    assert rows(windows.minmax_scale(df, "m", flat=0.5), "id", "scaled") == [(1, 0.5), (2, 0.5)]


def test_periods_read_null_text(spark):
    doc = '[{"period":"1","summary":"3","estimate":"2.5"},{"period":"2","summary":"NULL","estimate":"1"}]'
    df = spark.createDataFrame([(1, doc), (2, None), (3, "[]")], "id int, summarised_data string")
    assert rows(generators.explode_periods(df)) == [(1, 1, 3.0, 2.5), (1, 2, None, 1.0)]


def test_tree_walk_stops_at_excluded_cycles_and_strays(spark):
    nodes = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "x"), (5, 4, "e"), (6, 7, "f"), (7, 6, "g"), (8, 99, "h"), (9, 3, "i")]
    df = spark.createDataFrame(nodes, "id long, parent_id long, term string")
    got = rows(hierarchy.descend(df, excluded=F.col("term") == "x"), "id", "chain", "depth")
    assert got == [(1, "a", 0), (2, "a >> b", 1), (3, "a >> b >> c", 2), (9, "a >> b >> c >> i", 3)]


def test_ancestors_of_a_long_chain(spark):
    df = spark.range(100).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    pairs = hierarchy.ancestors(df)
    assert pairs.count() == 100 * 101 // 2
    assert pairs.where(F.col("id") - F.col("ancestor_id") != F.col("distance")).count() == 0
    assert [r.path for r in hierarchy.paths(df).where("id = 3").collect()] == [[0, 1, 2, 3]]


def test_a_node_on_a_cycle_is_found(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id long, parent_id long")
    with pytest.raises(ValueError, match="own ancestor"):
        hierarchy.ancestors(df)


def test_walk_has_no_end_but_the_tree(spark):
    chain = spark.range(40).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("t").alias("term"))
    ring = spark.range(100, 106).select("id", ((F.col("id") - 99) % 6 + 100).alias("parent_id"), F.lit("r").alias("term"))
    assert sorted(rows(hierarchy.descend(chain.union(ring)), "id", "depth")) == [(i, i) for i in range(40)]


def test_sums_keep_small_values(spark):
    df = spark.createDataFrame([(0.004,)] * 3 + [(None,)], "v double")
    assert df.agg(agg.exact_sum("v"), agg.exact_avg("v")).first()[:] == (0.012, 0.004)


def test_natural_key_keeps_long_names_apart(spark):
    names = ["Section-0000012", "Section-0000002", "S10", "S2", "S", "12345678901234567890", "9", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key("n").asc_nulls_last())
    assert [r[0] for r in df.collect()] == ["9", "12345678901234567890", "S", "S2", "S10", "Section-0000002", "Section-0000012", None]


def test_dates_are_refused_or_read(spark):
    got = spark.range(1).select(dates.as_date("2020-03-01"), dates.as_date(dt.datetime(2020, 3, 1, 23, 0)), dates.as_date(dt.date(2020, 3, 1))).first()
    assert set(got) == {dt.date(2020, 3, 1)}
    with pytest.raises(TypeError):
        dates.as_date(20200301)


def test_sync_set_sees_nulls(spark):
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e")], "k int, v string")
    got = rows(sync.sync_set(new, old, ["k"], ["v"]))
    assert got == [(1, "a", "S"), (2, None, "U"), (3, "c", "U"), (4, "d", "I"), (5, "e", "D")]


def test_cursor(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert rows(cursor.read_since(df, "id", 1)) == [(2,), (3,)]
    assert cursor.high_water(df, "id") == 3 and cursor.high_water(df.where("id > 9"), "id", 7) == 7


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "POINT(1 2)"), (2, None, "LINESTRING(0 0,1 1)")], "id int, n string, g string")
    sinks.export(df, f"{tmp_path}/csv", "csv")
    back = tables.read_table(spark, f"{tmp_path}/csv", "csv", "id int, n string, g string", header=True)
    assert rows(back) == rows(df)
    sinks.export(df, f"{tmp_path}/parquet", "parquet", ["id"])
    assert rows(spark.read.parquet(f"{tmp_path}/parquet").select("id", "n", "g")) == rows(df)
    sinks.export(df.select("id", "g"), f"{tmp_path}/geo", "geojson", wkt="g")
    got = sorted(r[0] for r in spark.read.text(f"{tmp_path}/geo").collect())
    assert got[0] == '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]},"properties":{"id":2}}'
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "csv")


def test_synonyms(spark):
    names = spark.createDataFrame(
        [(1, 7, "Bellis", True), (2, 7, "Daisy", False), (3, 8, "Lost", False)], "id int, meaning_id int, name string, preferred boolean"
    )
    assert rows(joins.to_preferred(names), "id", "preferred_name") == [(1, "Bellis"), (2, "Bellis"), (3, None)]
    wanted = spark.createDataFrame([(2,)], "id int")
    assert rows(joins.expand_synonyms(wanted, names), "id") == [(1,), (2,)]


def test_counts_of_two_levels_come_from_several_tasks(spark):
    """Their memory is that of names and taxa, which the size of the shuffled keys does not tell."""
    from fieldtally.plans import summaries

    records = spark.range(3000).select((F.col("id") % 7).alias("place_id"), (F.col("id") % 100).alias("taxon_id"))
    places = spark.range(7).select(F.col("id").alias("place_id"), F.concat(F.lit("p"), "id").alias("place_name"), (F.col("id") % 2).alias("parent_id"))
    parents = spark.range(2).select(F.col("id").alias("parent_id"), F.concat(F.lit("q"), "id").alias("parent_name"))
    out = summaries.two_level_counts(records, places, parents, spark.range(100).select(F.col("id").alias("taxon_id"), F.lit("t").alias("name")))
    assert out.where("level = 'square'").agg(F.sum("records")).first()[0] == 3000 and out.where("level = 'plot'").count() == 700
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
