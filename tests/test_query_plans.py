"""Physical plans: no nested loops over tables, filters and columns reach the scans, no Python in hot paths."""

import re

import pytest
from pyspark.sql import functions as F

from fieldtally import checks
from fieldtally.checks.standin import Frames
from fieldtally.session import tune


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


STREAMS = {"alert_stream", "rule_alert_stream", "rule_alerts_within_outlines"}
#: Queries that need Arrow batches: polygon areas, the national grid, line thinning.
ARROW = {"polygons_sharing_interior", "layer_overlap", "national_grid_round_trip", "simplified_outline"}
#: Lines and polygons clipped by the edges of a cell, outlines strung, whole geometries in the national grid.
ARROW |= {"generalised_outlines", "lines_in_regions", "polygons_meeting", "records_in_regions", "united_boundaries", "transect_lines", "gis_export", "length_check"}


@pytest.fixture(scope="module")
def plans(spark, folder):
    return {n: plan(q(spark, folder)) for n, q in checks.all_queries().items() if n not in STREAMS}


def test_no_nested_loops(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p] == []


def test_python_workers_only_where_needed(plans):
    python = re.compile("ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas")
    assert {n for n, p in plans.items() if python.search(p)} == ARROW


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(checks.all_queries()["live_scan"](spark, folder))
    assert "PushedFilters: [" in text and "o_orderstatus" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"}


def test_counts_combine_before_the_shuffle(spark, folder):
    text = plan(checks.all_queries()["species_summary"](spark, folder))
    assert text.count("partial_count") >= 1 and text.index("partial_count") > 0


def test_no_window_over_raw_rows(plans):
    """Only pre-aggregated or single-row-per-period inputs may meet a window, or a row's own changes of one field."""
    windowed = {n for n, p in plans.items() if re.search(r"\bWindow\b", p)}
    # Pages are numbered by a range sort; their window sees one row per sort partition.
    in_pages = {
        "attributes_as_list", "dissolved_lines", "group_admin_alert", "habitat_download", "lapsed_users", "list_catalogue", "media_per_visit", "rule_recipients",
        "taxonomy_download", "trait_index_rebuild", "visit_documents", "visits_by_spot",
    }
    for name in in_pages & windowed:
        assert all(spec.startswith("_part#") for spec in re.findall(r"windowspecdefinition\(([^,)]*)", plans[name])), name
    assert windowed - in_pages <= {
        "audit_trail",
        "associated_species", "badges_build", "data_accumulation", "league_position", "leaderboard", "longest_run", "natural_order",
        "running_total", "shared_rank", "top_n_other_fold", "top_n_with_other", "weekly_streak",
    }


def test_hot_key_is_spread(spark, folder):
    """A third of all rows under one key: salting leaves no task with more than its share of copies."""
    from fieldtally.operators import joins

    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    spread = joins.salted(hot, ["v"], 16).where("k = 0").groupBy("_salt").count()
    assert spread.count() == 16 and max(r["count"] for r in spread.collect()) < 120


def test_skewed_join_is_split_before_a_grouping_on_its_key(spark):
    """One key with a third of the rows, joined and then grouped by the same key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tune(spark)
        wide = F.sha2(F.col("id").cast("string"), 512).alias("v")
        hot = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), wide)
        side = spark.range(-1, 60000, 1, 4).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
        out = hot.join(side, "k").groupBy("k").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"))
        assert out.where("n > 1").count() == 1
        out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frames_are_lazy(spark):
    frames = Frames(spark, "/nowhere")
    with pytest.raises(AttributeError):
        frames.no_such_table
