"""Alert rules as batch queries, and the streaming jobs run over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, spatial
from ..session import scratch_path, settle
from ..sources.tables import stream_table
from ..streaming import alerts
from .registry import query

RULES_SQL = """rules AS (SELECT parent_id AS rule_id, parent_id AS group_id, unnest([parent_id, parent_id + 25]) AS taxon_id, parent_id FROM parents),
    ev AS (SELECT event_id AS record_id, user_id, user_id % 50 AS taxon_id, [user_id % 5, user_id % 7] AS region_ids, event_type, ts FROM events),
    hits AS (SELECT e.record_id, e.event_type, e.ts, r.rule_id, r.group_id FROM ev e JOIN rules r ON r.taxon_id = e.taxon_id
      AND (r.parent_id % 2 = 0 OR list_has_any(e.region_ids, [r.parent_id % 5, 6]))),
    members AS (SELECT place_id AS user_id, place_id // 4 AS group_id FROM places)"""


def occurrences(events):
    """Events as records: taxon, survey and region ids from the user id."""
    u = F.col("user_id")
    return events.select(
        F.col("event_id").alias("record_id"),
        u,
        (u % 50).alias("taxon_id"),
        F.array(u % 5, u % 7).alias("region_ids"),
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("created_on"),
    )


def rules_of(t):
    """One rule per nation, stored as JSON; odd ones name regions."""
    p = F.col("parent_id")
    taxa = F.concat(p.cast("string"), F.lit(", "), (p + 25).cast("string"))
    regions = F.when(p % 2 == 1, F.concat((p % 5).cast("string"), F.lit(",6")))
    return t.parents.select(
        p.alias("rule_id"), p.alias("group_id"), F.to_json(F.struct(taxa.alias("taxa"), regions.alias("regions"))).alias("definition")
    )


def members_of(t):
    """Groups of four."""
    return t.places.select(F.col("place_id").alias("user_id"), F.floor(F.col("place_id") / 4).cast("int").alias("group_id"))


def event_stream(t):
    return occurrences(stream_table(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet"))


# ---- rules over tables ---------------------------------------------------------------


@query(
    "new_record_alerts",
    "Z1",
    """SELECT event_id AS record_id, 'New ' || event_type || ' by ' || user_id AS message FROM events
    WHERE event_type IN ('error', 'signup') AND value > 50 AND user_id % 50 IN (1, 2, 3, 5, 8, 13, 21, 34)""",
)
def _(t):
    message = F.concat(F.lit("New "), F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string"))
    rows = alerts.alert_stream(
        occurrences(t.events), F.col("event_type").isin("error", "signup") & (F.col("value") > 50), taxa=[1, 2, 3, 5, 8, 13, 21, 34], message=message
    )
    return rows.select("record_id", "message")


@query(
    "late_look_back",
    "Z2",
    "SELECT event_id AS record_id FROM events WHERE ts > TIMESTAMP '2024-01-18' AND event_type = 'view'",
)
def _(t):
    rows = alerts.look_back(occurrences(t.events), "2024-01-20", 2)
    return rows.where("event_type = 'view'").select("record_id")


@query(
    "suppress_sent",
    "Z3",
    """SELECT e.event_id AS record_id, e.user_id FROM events e WHERE e.event_type = 'error'
    AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'click' AND s.user_id = e.user_id AND s.event_id % 1000 = e.event_id % 1000)""",
)
def _(t):
    keyed = occurrences(t.events).withColumn("slot", F.col("record_id") % 1000)
    out = alerts.suppress(keyed.where("event_type = 'error'"), keyed.where("event_type = 'click'"), ["user_id", "slot"])
    return out.select("record_id", "user_id")


@query(
    "rule_table_join",
    "Z4 E2",
    f"WITH {RULES_SQL} SELECT record_id, rule_id, group_id FROM hits",
)
def _(t):
    return alerts.match_rules(occurrences(t.events), alerts.read_rules(rules_of(t))).select("record_id", "rule_id", "group_id")


@query(
    "rule_recipients",
    "Z4 A4",
    f"""WITH {RULES_SQL}
    SELECT h.record_id, h.rule_id, string_agg(CAST(m.user_id AS VARCHAR), ',' ORDER BY CAST(m.user_id AS VARCHAR)) AS notify_user_ids
    FROM hits h JOIN members m ON m.group_id = h.group_id WHERE h.event_type = 'error' GROUP BY 1, 2""",
)
def _(t):
    errors = occurrences(t.events).where("event_type = 'error'")
    hits = alerts.match_rules(errors, alerts.read_rules(rules_of(t)))
    # Users are put together once per group, not once per record.
    return hits.join(alerts.rule_members(members_of(t)), "group_id").select("record_id", "rule_id", "notify_user_ids")


@query(
    "missing_media_alert",
    "Z1 J5",
    """SELECT e.event_id AS record_id FROM events e WHERE e.event_type = 'purchase' AND e.event_id NOT IN (SELECT visit_id FROM visits WHERE status <> 'P')""",
)
def _(t):
    media = t.visits.where("status <> 'P'").select(F.col("visit_id").alias("record_id"))
    return alerts.without_media(occurrences(t.events).where("event_type = 'purchase'"), media).select("record_id")


@query(
    "coded_attribute_alert",
    "Z1 E3",
    """SELECT e.event_id AS record_id, n.parent_name AS term FROM events e JOIN parents n ON n.parent_id = CAST(json_extract_string(e.props, '$.k') AS INTEGER)
    WHERE n.parent_name <> 'NATION_3'""",
)
def _(t):
    values = t.events.select(
        F.col("event_id").alias("record_id"), F.lit(319).alias("attribute_id"), F.get_json_object("props", "$.k").cast("int").alias("term_id")
    )
    terms = t.parents.select(F.col("parent_id").alias("term_id"), F.col("parent_name").alias("term"))
    return alerts.coded_attribute(occurrences(t.events), values, terms, 319, "NATION_3").select("record_id", "term")


@query(
    "group_admin_alert",
    "Z1 A4 J7",
    """WITH m AS (SELECT user_id, nation_id AS group_id, role = 'BUILDING' AND balance > 9000 AS administrator FROM people),
    a AS (SELECT group_id, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS notify_user_ids FROM m WHERE administrator GROUP BY 1)
    SELECT v.visit_id, m.group_id, a.notify_user_ids FROM visits v JOIN m ON m.user_id = v.user_id JOIN a ON a.group_id = m.group_id WHERE v.date_start >= DATE '2001-01-01'""",
)
def _(t):
    members = t.people.select("user_id", F.col("nation_id").alias("group_id"), ((F.col("role") == "BUILDING") & (F.col("balance") > 9000)).alias("administrator"))
    fresh = t.visits.where(F.col("date_start") >= "2001-01-01").select("visit_id", "user_id")
    return alerts.group_admins(fresh, members).select("visit_id", "group_id", "notify_user_ids")


# ---- streaming jobs ------------------------------------------------------------------


@query(
    "alert_stream",
    "job:alert_stream Z1 Z2",
    """SELECT event_id AS record_id, user_id, strftime(ts, '%Y-%m-%d') AS notice_day FROM events WHERE event_type = 'error' AND value > 20""",
)
def _(t):
    """Runs the stream over the event file until it is worked off, then reads the notices back."""
    stream = alerts.fresh(event_stream(t), "created_on", "2 days", ("record_id",))

    def rule(batch):
        found = alerts.alert_stream(batch, (F.col("event_type") == "error") & (F.col("value") > 20))
        return found.select("record_id", "user_id", F.col("created_on").cast("date").alias("notice_day"))

    out = scratch_path(t.spark, "alerts")
    alerts.run_alerts(stream, rule, f"{out}/sent", f"{out}/checkpoint", ["record_id", "user_id"]).awaitTermination()
    return t.spark.read.parquet(f"{out}/sent").select("record_id", "user_id", "notice_day")


@query(
    "rule_alert_stream",
    "job:rule_alert_stream Z2 Z3 Z4",
    f"""WITH {RULES_SQL} SELECT h.record_id, h.rule_id, m.user_id, strftime(h.ts, '%Y-%m-%d') AS notice_day FROM hits h
    JOIN members m ON m.group_id = h.group_id WHERE h.event_type = 'signup'""",
)
def _(t):
    stream = alerts.fresh(event_stream(t).where("event_type = 'signup'"))
    rules, members = rules_of(t), members_of(t)

    def rule(batch):
        found = alerts.rule_alert_stream(batch, rules, members)
        return found.select("record_id", "rule_id", "user_id", F.col("created_on").cast("date").alias("notice_day"))

    out = scratch_path(t.spark, "rule-alerts")
    alerts.run_alerts(stream, rule, f"{out}/sent", f"{out}/checkpoint", ["record_id", "rule_id", "user_id"]).awaitTermination()
    return t.spark.read.parquet(f"{out}/sent").select("record_id", "rule_id", "user_id", "notice_day")


@query(
    "rule_alerts_within_outlines",
    "job:rule_alert_stream Z4 G2",
    f"""WITH {RULES_SQL},
    placed AS (SELECT h.*, (e.user_id * 37) % 1000 AS x, (e.user_id * 91) % 1000 AS y, e.region_ids, r.parent_id FROM hits h JOIN ev e USING (record_id) JOIN parents r ON r.parent_id = h.rule_id),
    inside AS (SELECT * FROM placed WHERE parent_id % 2 = 0 OR len(list_filter(list_intersect(region_ids, [parent_id % 5, 6]), lambda i: x >= 20 * i AND y >= 10 * i AND (x - 20 * i) + (y - 10 * i) <= 900)) > 0)
    SELECT h.record_id, h.rule_id, m.user_id, strftime(h.ts, '%Y-%m-%d') AS notice_day FROM inside h JOIN members m ON m.group_id = h.group_id""",
)
def _(t):
    """As rule_alert_stream; a record of an indexed region has to lie within the region's triangle too."""
    x, y = F.col("parent_id") * 20, F.col("parent_id") * 10
    triangle = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d))", x, y, x + 900, y, x, y + 900, x, y)
    outlines = spatial.shapes(t.parents.select(F.col("parent_id").cast("long").alias("id"), triangle.alias("boundary_geom")))
    outlines = settle(cells.region_cells(outlines))
    stream = alerts.fresh(event_stream(t))
    rules, members = rules_of(t), members_of(t)

    def rule(batch):
        placed = batch.withColumn("x", (F.col("user_id") * 37) % 1000).withColumn("y", (F.col("user_id") * 91) % 1000)
        found = alerts.rule_alert_stream(placed, rules, members, outlines)
        return found.select("record_id", "rule_id", "user_id", F.col("created_on").cast("date").alias("notice_day"))

    out = scratch_path(t.spark, "exact-alerts")
    alerts.run_alerts(stream, rule, f"{out}/sent", f"{out}/checkpoint", ["record_id", "rule_id", "user_id"]).awaitTermination()
    return t.spark.read.parquet(f"{out}/sent").select("record_id", "rule_id", "user_id", "notice_day")
