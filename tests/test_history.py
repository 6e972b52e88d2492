"""Row images replayed from a log, estimated dates, walks from wanted ids."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.operators import hierarchy
from fieldtally.plans import history, taxonomy

LOG = "log_id long, record_id long, entity string, id long, action string, at timestamp, user_id long, session string, changed map<string,string>"


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def trail(spark):
    records = spark.createDataFrame([(1, dt.datetime(2015, 1, 1), 7), (2, day(1), 8)], "record_id long, created_on timestamp, user_id long")
    inserted = spark.createDataFrame(
        [(1, "occurrences", 1, "taxon", "oak"), (1, "occurrences", 1, "status", "C"), (1, "values", 50, "count", "3"), (2, "occurrences", 2, "taxon", "elm"), (3, "occurrences", 3, "taxon", "ash")],
        "record_id long, entity string, id long, field string, value string",
    )
    log = [
        (10, 1, "occurrences", 1, "U", day(2), 7, "web", {"status": "V"}), (11, 1, "occurrences", 1, "U", day(3), 7, "postgres", {"taxon": "beech", "status": "R"}),
        (12, 1, "values", 50, "U", day(3), 8, "web", {"count": "4"}), (13, 1, "occurrences", 1, "U", day(2), 9, "indicia_data_user", {"last_verification_check_date": "x"}),
        (14, 1, "values", 50, "D", day(5), 8, "web", {}), (15, 1, "values", 51, "I", day(6), 8, "web", {"count": "1"}), (16, 3, "occurrences", 3, "U", day(6), 8, "web", {"taxon": "fir"}),
    ]
    people = spark.createDataFrame([(7, "Ann"), (8, "Bo")], "user_id long, user_name string")
    return history.audit_trail(records, spark.createDataFrame(log, LOG), people, inserted, "2017-05-11 12:30:27").collect()


def test_rows_before_each_action(trail):
    got = [(r.action, r.entity, r.id, r.row_before and json.loads(r.row_before), r.changed and json.loads(r.changed)) for r in trail if r.record_id == 1]
    want = [
        ("Inserted", "occurrences", 1, None, {"status": "C", "taxon": "oak"}),
        ("Update ", "occurrences", 1, {"status": "C", "taxon": "oak"}, {"status": "V"}),
        ("Update ", "occurrences", 1, {"status": "V", "taxon": "oak"}, {"status": "R", "taxon": "beech"}),
        ("Update ", "occurrences", 1, {"status": "R", "taxon": "beech"}, {"last_verification_check_date": "x"}),
        ("Update ", "values", 50, {"count": "3"}, {"count": "4"}),
        ("Delete ", "values", 50, {"count": "4"}, {}),
        ("Insert ", "values", 51, None, {"count": "1"}),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_notes_of_actions(trail):
    notes = {(r.id, r.at.day, r.user_name): r.notes for r in trail if r.record_id == 1}
    assert notes[1, 3, "Ann"] == history.NOTE_BACK_END and notes[50, 3, "Bo"] == ""
    assert notes[1, 2, None] == f"{history.NOTE_RULE_CHECK}. {history.NOTE_BACK_END}" and notes[1, 1, "Ann"] == history.NOTE_BEFORE_LOG
    assert [(r.action, r.notes) for r in trail if r.record_id == 2] == [("Inserted", None)] and not [r for r in trail if r.record_id == 3]


def test_estimated_dates_of_determinations(spark):
    records = spark.createDataFrame([(i, "oak", "V", None, day(20)) for i in (1, 2, 3, 4)], "record_id long, taxon string, record_status string, substatus long, verified_on timestamp")
    made = [(1, 1, "a", day(1), day(9)), (2, 2, "b", day(1), day(9)), (2, 3, "c", day(2), day(2)), (3, 4, "d", day(2), day(2))]
    given = spark.createDataFrame(made, "record_id long, determination_id long, taxon string, created_on timestamp, updated_on timestamp")
    notes = [(2, 1, None, None, day(8), history.EDITED), (2, 2, None, None, day(5), history.EDITED), (2, 3, "V", None, day(3), "fine"), (1, 4, None, None, day(5), history.EDITED)]
    comments = spark.createDataFrame(notes, "record_id long, comment_id long, status string, substatus long, created_on timestamp, text string")
    got = history.redeterminations(records, given, comments)
    assert rows(got, "record_id", "last_determination", "current_determination_date") == [
        (1, "a", "2024-01-09 00:00:00"), (2, "c", "2024-01-05 00:00:00, 2024-01-08 00:00:00 (estimate from edit comments)"), (3, "d", None)
    ]


def test_walks_start_from_the_wanted_ids(spark, monkeypatch):
    written = []
    real = hierarchy.settle
    monkeypatch.setattr(hierarchy, "settle", lambda df: (written.append((out := real(df)).count()), out)[1])
    # A binary tree of 4,095 nodes; two wanted leaves, an inner node, one that does not exist, one named twice.
    nodes = spark.range(1, 4096).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent_id"), F.col("id").cast("string").alias("name"))
    wanted = spark.createDataFrame([(4095,), (4094,), (100,), (9999,), (100,)], "id long")
    got = hierarchy.ancestors_of(wanted, nodes)
    want = {(i, i >> k, k) for i in (4095, 4094, 100) for k in range(i.bit_length())}
    assert set(rows(got, "id", "ancestor_id", "distance")) == want and got.count() == len(want)
    assert sum(written) == len(want)
    assert rows(hierarchy.paths(nodes, wanted).where("id = 100"), "path") == [([1, 3, 6, 12, 25, 50, 100],)]
    assert rows(taxonomy.ancestor_expand(wanted, nodes), "id") == sorted({(a,) for _, a, _ in want}, key=repr)
    assert hierarchy.ancestors_of(wanted.where("id = 9999"), nodes).count() == 0


def test_walks_end_on_cycles(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, None), (6, 77)], "id long, parent_id long")
    with pytest.raises(ValueError, match="its own ancestor"):
        hierarchy.ancestors_of(spark.createDataFrame([(1,)], "id long"), nodes)
    assert rows(hierarchy.ancestors_of(spark.createDataFrame([(5,), (6,)], "id long"), nodes), "id", "ancestor_id") == [(5, 5), (6, 6)]


def test_row_states_read_a_hot_row_once_and_in_order(spark):
    """A thousand actions on one row, among them values set to null and a repeated action; no join of a row's actions with its values."""
    inserted = spark.createDataFrame([(1, "t", 1, "a", "0")], "record_id long, entity string, id long, field string, value string")
    acts = [(i, 1, "t", 1, {"a": None if i == 5 else str(i)} if i % 2 else {"b": str(i)}) for i in range(1, 1001)]
    acts += [acts[8], (2000, 1, "t", None, {"a": "x"}), (2001, 2, "t", 1, {"a": "x"})]
    log = spark.createDataFrame(acts, "log_id long, record_id long, entity string, id long, changed map<string,string>")
    out = history.row_states(inserted, log, spark.createDataFrame([(1,), (1,)], "record_id long"))
    got = {}
    for r in out.collect():
        got.setdefault(r.log_id, []).append(r.row_before)
    assert got.keys() == {*range(1, 1001), 2000} and got[2000] == [None] and got[1] == [{"a": "0"}] and got[2] == [{"a": "1"}]
    assert got[7] == [{"a": None, "b": "6"}] and got[9] == [{"a": "7", "b": "8"}] * 2 and got[1000] == [{"a": "999", "b": "998"}]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # actions with the records, these with their entered rows
