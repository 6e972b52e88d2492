"""Alert streams: batches, late and repeated rows, restarts, failed batches."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from fieldtally.operators import cells, spatial
from fieldtally.streaming import alerts

SCHEMA = "record_id long, taxon_id long, region_ids array<long>, created_on timestamp"


def feed(spark, folder, data):
    spark.createDataFrame([(i, t, r, dt.datetime.fromisoformat(at)) for i, t, r, at in data], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def notices(batch):
    found = alerts.alert_stream(batch, F.col("taxon_id") == 1)
    return found.select("record_id", F.lit(7).alias("user_id"), F.col("created_on").cast("date").alias("notice_day"))


def run(spark, source, out):
    stream = alerts.fresh(spark.readStream.schema(SCHEMA).parquet(source))
    alerts.run_alerts(stream, notices, f"{out}/sent", f"{out}/checkpoint", ["record_id", "user_id"]).awaitTermination()
    sent = alerts.sent_notices(spark, f"{out}/sent")
    return [] if sent is None else rows(sent, "record_id")


def test_batches_give_the_same_as_one(spark, tmp_path):
    first = [(1, 1, [1], "2024-01-01T10:00:00"), (2, 2, [1], "2024-01-01T11:00:00")]
    later = [(3, 1, [1], "2024-01-02T10:00:00"), (1, 1, [1], "2024-01-01T10:00:00"), (4, 1, [1], "2024-01-01T09:00:00")]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    feed(spark, source, first)
    assert run(spark, source, out) == [(1,)]
    assert run(spark, source, out) == [(1,)]  # restart without news
    feed(spark, source, later)
    in_steps = run(spark, source, out)  # a repeat, and a row older than others but within two days
    assert in_steps == [(1,), (3,), (4,)]
    assert run(spark, source, f"{tmp_path}/other") == in_steps


def test_batch_repeated_after_failure(spark, tmp_path):
    data = [(1, 1, [1], "2024-01-01T10:00:00"), (2, 1, [1], "2024-01-03T10:00:00")]
    batch = spark.createDataFrame([(i, t, r, dt.datetime.fromisoformat(at)) for i, t, r, at in data], SCHEMA)
    step = alerts.append_notices(f"{tmp_path}/sent", notices, ["record_id", "user_id"], "notice_day")
    step(batch.where("record_id = 1"), 0)
    step(batch, 1)
    step(batch, 1)
    step(batch.where("taxon_id = 99"), 2)
    sent = alerts.sent_notices(spark, f"{tmp_path}/sent")
    assert rows(sent, "record_id", "batch_id") == [(1, 0), (2, 1)]


def test_rules(spark):
    records = spark.createDataFrame(
        [(1, 10, [5], 1), (2, 10, [6], 1), (3, 11, [6], 1), (4, 12, [5], 1), (5, 10, None, 1)],
        "record_id long, taxon_id long, region_ids array<long>, user_id long",
    )
    rules = spark.createDataFrame(
        [(1, 1, '{"taxa":"10, 11"}'), (2, 2, '{"taxa":"10","regions":"5,9"}'), (3, 3, '{"taxa":"77"}'), (4, 9, '{"taxa":"12","regions":""}'), (5, 1, "{}")],
        "rule_id long, group_id long, definition string",
    )
    members = spark.createDataFrame([(1, 100), (1, 101), (2, 102)], "group_id long, user_id long")
    hits = alerts.match_rules(records, alerts.read_rules(rules))
    assert rows(hits, "record_id", "rule_id") == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 4), (5, 1)]
    out = alerts.rule_alert_stream(records, rules, members)
    assert rows(out, "record_id", "user_id") == [(1, 100), (1, 101), (1, 102), (2, 100), (2, 101), (3, 100), (3, 101), (5, 100), (5, 101)]
    assert rows(alerts.rule_members(members), "group_id", "notify_user_ids") == [(1, "100,101"), (2, "102")]
    paged = alerts.rule_members(spark.range(500).select(F.lit(1).alias("group_id"), F.col("id").alias("user_id")), 50).collect()
    users = [u for r in paged for u in r.notify_user_ids.split(",")]
    assert len(paged) == 10 and sorted(map(int, users)) == list(range(500))


def test_look_back(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 1)), (2, dt.datetime(2024, 1, 1))], "id int, created_on timestamp")
    assert rows(alerts.look_back(df, "2024-01-03"), "id") == [(1,)]


def test_a_batch_opens_only_the_folders_of_its_days(spark, tmp_path):
    def batch(day, ids):
        return spark.createDataFrame([(i, 1, [1], dt.datetime.fromisoformat(f"{day}T10:00:00")) for i in ids], SCHEMA)

    step = alerts.append_notices(f"{tmp_path}/sent", notices, ["record_id", "user_id"], "notice_day")
    step(batch("2024-01-01", [1, 2]), 0)
    step(batch("2024-01-05", [3]), 1)
    # A day that cannot be read does not matter to batches of other days.
    broken = tmp_path / "sent" / "notice_day=2024-01-01" / "batch_id=0"
    for part in broken.glob("*.parquet"):
        part.write_bytes(b"no parquet")
        (broken / f".{part.name}.crc").unlink(missing_ok=True)
    step(batch("2024-01-05", [3, 4]), 2)
    step(batch("2024-01-05", [3, 4]), 2)
    sent = alerts.sent_notices(spark, f"{tmp_path}/sent", day="notice_day", days=[dt.date(2024, 1, 5), dt.date(2024, 1, 6)])
    assert rows(sent, "record_id", "batch_id") == [(3, 1), (4, 2)]
    assert alerts.sent_notices(spark, f"{tmp_path}/sent", day="notice_day", days=[dt.date(2024, 2, 1)]) is None


def test_rules_on_exact_outlines(spark):
    outlines = spark.createDataFrame(
        [(5, "POLYGON((0 0,10 0,0 10,0 0))"), (6, "POLYGON((0 0,20 0,20 20,0 20,0 0),(5 5,15 5,15 15,5 15,5 5))")], "id long, boundary_geom string"
    )
    region_cells = cells.region_cells(spatial.shapes(outlines))
    # Indexed under both squares around the outlines: inside, on the slant, outside it, in the hole, under no region.
    spots = [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 9.0, 9.0), (4, 10.0, 10.0), (5, 19.0, 19.0)]
    records = spark.createDataFrame([(i, 10, [5, 6], 1, x, y) for i, x, y in spots] + [(6, 10, None, 1, 2.0, 2.0), (7, 10, [5], 1, None, None)], "record_id long, taxon_id long, region_ids array<long>, user_id long, x double, y double")
    rules = spark.createDataFrame([(1, 1, '{"taxa":"10","regions":"5"}'), (2, 1, '{"taxa":"10","regions":"5,6"}'), (3, 1, '{"taxa":"10"}')], "rule_id long, group_id long, definition string")
    members = spark.createDataFrame([(1, 100)], "group_id long, user_id long")
    got = rows(alerts.rule_alert_stream(records, rules, members, region_cells), "record_id", "rule_id")
    assert got == sorted([(1, 1), (2, 1), (1, 2), (2, 2), (5, 2)] + [(i, 3) for i in range(1, 8)])
