"""Alerts on new, changed or verified records, as Structured Streaming jobs.

The rules are plain DataFrame functions, so the same rule runs on a stream, on one micro-batch or
on a whole table. The stream's checkpoint replaces the stored time of the last run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.attributes import json_attr
from ..operators import cells, filters
from ..operators.aggregate import paged_text


# ---- rules over rows (batch or stream) -----------------------------------------------


def alert_stream(
    records: DataFrame,
    condition: Column,
    taxa: list | None = None,
    surveys: list[int] | None = None,
    absent: bool | None = None,
    message: Column | None = None,
) -> DataFrame:
    """One notice per row that meets the rule: chosen taxa and surveys, present or absent, any condition."""
    out = filters.opt(records, taxa, lambda v: F.col("taxon_id").isin(list(v)))
    out = filters.opt(out, surveys, lambda v: F.col("survey_id").isin(list(v)))
    out = filters.opt(out, absent, lambda v: F.col("zero_abundance") == F.lit(v))
    out = out.where(condition)
    return out if message is None else out.withColumn("message", message)


def without_media(records: DataFrame, media: DataFrame) -> DataFrame:
    """Records with no media, to ask their recorder for one."""
    return records.join(media.select("record_id"), "record_id", "left_anti")


def coded_attribute(records: DataFrame, values: DataFrame, terms: DataFrame, attribute_id: int, not_term: str) -> DataFrame:
    """Records whose coded attribute holds any term but one, with the term."""
    chosen = values.where(F.col("attribute_id") == attribute_id).select("record_id", "term_id")
    named = chosen.join(terms, "term_id").where(F.col("term") != not_term)
    return records.join(named, "record_id")


def group_admins(visits: DataFrame, members: DataFrame, page_size: int = 1000) -> DataFrame:
    """New visits with the administrators of their creator's groups. ``members``: group_id, user_id, administrator."""
    admins = rule_members(members.where(F.col("administrator")), page_size)
    own = members.select("group_id", "user_id").distinct().join(admins, "group_id")
    return visits.join(own, "user_id")


def read_rules(rules: DataFrame) -> DataFrame:
    """Rules stored as JSON to one row per (rule, taxon): ``rule_id``, ``group_id``, ``taxon_id``, ``regions``.

    The definition holds comma-separated id lists under ``taxa`` and ``regions``; no regions means anywhere.
    """

    def ids(text):
        return F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("long"))

    taxa, regions = json_attr("definition", "taxa"), json_attr("definition", "regions")
    return rules.select(
        "rule_id",
        "group_id",
        F.explode(ids(taxa)).alias("taxon_id"),
        F.when(F.coalesce(regions, F.lit("")) != "", ids(regions)).alias("regions"),
    )


def rule_members(members: DataFrame, page_size: int = 1000) -> DataFrame:
    """Users to notify per group as text, ``page_size`` users to a page."""
    return paged_text(members, "group_id", "user_id", "notify_user_ids", size=page_size)


def match_rules(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Records and the rules they meet: the taxon is an equi-join, the regions are compared as arrays.

    ``rules`` as given by :func:`read_rules`. A rule without regions matches everywhere.
    """
    return records.join(rules, "taxon_id").where(
        F.col("regions").isNull() | F.arrays_overlap("regions", "region_ids")
    )


def inside_outline(hits: DataFrame, region_cells: DataFrame) -> DataFrame:
    """Hits whose position (``x``, ``y``) lies in or on the outline of a region of their rule, or whose rule has none.

    The regions a record is indexed under may be coarser than their outlines. ``region_cells`` is the static side, as
    given by ``cells.region_cells`` and written once: a record meets the edges of its own cell by an equi-join. A
    record in several regions of a rule gives one hit on tables and micro-batches; on a stream each.
    """
    columns = hits.columns
    shared = F.when(F.col("regions").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array_intersect("regions", "region_ids"))
    each = hits.withColumn("region_id", F.explode(shared))
    sides = region_cells.select("region_id", "side").distinct()
    placed = each.join(sides, "region_id", "left")
    placed = placed.withColumn("cx", F.floor(F.col("x") / F.col("side")).cast("long")).withColumn("cy", F.floor(F.col("y") / F.col("side")).cast("long"))
    met = placed.join(region_cells.drop("side"), ["region_id", "cx", "cy"], "left")
    kept = met.where(F.col("regions").isNull() | F.coalesce(cells.in_cell(F.col("x"), F.col("y")), F.lit(False)))
    out = kept.select(*columns)
    return out if hits.isStreaming else out.dropDuplicates(["record_id", "rule_id"])


def rule_alert_stream(records: DataFrame, rules: DataFrame, members: DataFrame, region_cells: DataFrame | None = None) -> DataFrame:
    """Notices of rules: one row per (record, rule) and user. Users come from the static members table.

    ``user_id`` of the result is the one to notify; that of the record becomes ``recorder_id``. With
    ``region_cells`` a record has to lie within the exact outline of a region, see :func:`inside_outline`.
    """
    hits = match_rules(records, read_rules(rules)).withColumnRenamed("user_id", "recorder_id")
    if region_cells is not None:
        hits = inside_outline(hits, region_cells)
    return hits.join(members.select("group_id", "user_id"), "group_id")


def suppress(notices: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Notices not sent before."""
    return notices.join(sent.select(*keys), keys, "left_anti")


def look_back(df: DataFrame, since, days: int = 2, column: str = "created_on") -> DataFrame:
    """Rows after a time less some days, because their regions may have been tagged late."""
    return df.where(F.col(column) > F.lit(since).cast("timestamp") - F.make_dt_interval(F.lit(days)))


# ---- running on a stream -------------------------------------------------------------


def fresh(stream: DataFrame, event_time: str = "created_on", late: str = "2 days", keys: tuple = ("record_id",)) -> DataFrame:
    """Rows of a stream, repeats dropped while the watermark remembers them.

    State is bounded by the watermark: a key is forgotten ``late`` after its event time.
    """
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def sent_notices(spark, path: str, empty: DataFrame | None = None, day: str | None = None, days: list | None = None) -> DataFrame | None:
    """Notices written so far, or ``empty`` before the first batch; with ``days`` only the folders of those days are opened."""
    try:
        if days is None:
            return spark.read.parquet(path)
        named = ",".join(sorted(str(d) for d in days))
        return spark.read.option("basePath", path).parquet(f"{path}/{day}={{{named}}}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty


def append_notices(path: str, rule: Callable[[DataFrame], DataFrame], keys: list[str], day: str) -> Callable:
    """A ``foreachBatch`` step: apply ``rule``, leave out notices sent before, write the rest.

    Notices lie in folders by day, and by batch within a day. A batch replaces its own folders, and ignores them
    when looking for sent notices, so a batch repeated after a failure gives the same result. ``day`` is a date
    column that is never null nor changes for a record; only the folders of the batch's days are listed and read.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Kept while it is read twice: computing it again would run the stateful part again.
        notices = rule(batch).persist()
        try:
            # As many as a batch has days.
            days = [r[0] for r in notices.select(day).distinct().collect()]
            if not days:
                return
            fresh_ones = notices
            sent = sent_notices(spark, path, day=day, days=days)
            if sent is not None:
                fresh_ones = suppress(notices, sent.where(F.col("batch_id") != batch_id), keys)
            owned = fresh_ones.dropDuplicates(keys).withColumn("batch_id", F.lit(batch_id))
            owned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch_id").parquet(path)
        finally:
            notices.unpersist()

    return step


def run_alerts(
    stream: DataFrame,
    rule: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: list[str],
    day: str = "notice_day",
    once: bool = True,
) -> StreamingQuery:
    """Start the alert job. ``path`` and ``checkpoint`` belong in shared storage.

    ``once`` works off what is there and stops; otherwise the job runs on until stopped.
    """
    writer = stream.writeStream.foreachBatch(append_notices(path, rule, keys, day)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
