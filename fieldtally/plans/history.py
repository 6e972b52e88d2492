"""Jobs over the history of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recode, status_label
from ..operators.windows import latest_per
from ..session import shuffle_tasks


def latest_determination(records: DataFrame, determinations: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per redetermined record: its last determination, and its last status before verification.

    ``records``: record_id, taxon, record_status, substatus, verified_on. ``determinations``: record_id,
    determination_id, taxon, created_on. ``comments``: record_id, comment_id, status, substatus, created_on.
    """
    last = latest_per(determinations, ["record_id"], ["determination_id"]).select(
        "record_id", F.col("taxon").alias("last_determination"), F.col("created_on").alias("determined_on")
    )
    return last_status_before(records, comments).join(last, "record_id")


# What the edit of a verified record is noted as, and what marks a date taken from such notes.
EDITED = "This record's verification status needs to be rechecked as it has been edited."
ESTIMATED = " (estimate from edit comments)"


def redeterminations(records: DataFrame, determinations: DataFrame, comments: DataFrame) -> DataFrame:
    """Redetermined records with the day of their present determination, estimated where it was not kept.

    As :func:`latest_determination`, with ``determinations`` also holding updated_on and ``comments`` text. A determination
    that was changed after it was made was set aside then: that time is the present one's. For one that never
    changed, the times of the record's edit comments stand in, in their order and marked as an estimate; null
    without any. Adds ``current_determination_date``, as text.
    """
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    last = latest_per(determinations, ["record_id"], ["determination_id"]).select("record_id", F.col("created_on").alias("_made"), F.col("updated_on").alias("_changed"))
    edits = comments.where(F.col("text") == EDITED).join(last.where("_made = _changed").select("record_id"), "record_id", "left_semi")
    estimates = edits.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list(when("created_on"))), ", ").alias("_edits"))
    dated = last.join(estimates, "record_id", "left").select(
        "record_id", F.when(F.col("_made") == F.col("_changed"), F.concat("_edits", F.lit(ESTIMATED))).otherwise(when("_changed")).alias("current_determination_date")
    )
    return latest_determination(records, determinations, comments).join(dated, "record_id")


def last_status_before(records: DataFrame, comments: DataFrame) -> DataFrame:
    """Records with the last status they had before they were verified.

    Comments made before verification are kept by an equi-join on the record and a comparison.
    """
    given = comments.where(F.col("status").isNotNull()).select(
        "record_id", "comment_id", F.col("status").alias("_s"), F.col("substatus").alias("_ss"), F.col("created_on").alias("_on")
    )
    earlier = given.join(records.select("record_id", "verified_on"), "record_id").where(F.col("_on") < F.col("verified_on"))
    last = latest_per(earlier.drop("verified_on"), ["record_id"], ["comment_id"])
    return records.join(last, "record_id", "left").select(
        "record_id",
        "taxon",
        status_label("record_status", "substatus").alias("current_status"),
        "verified_on",
        status_label("_s", "_ss").alias("previous_status"),
        F.col("_on").alias("previous_on"),
    )


# Change codes of the log (two end in a space) and the notes.
ACTIONS = {"U": "Update ", "I": "Insert ", "D": "Delete ", "T": "Truncate"}
NOTE_BEFORE_LOG = "Record entered before audit logging feature added to the warehouse so initial data values may be inaccurate."
NOTE_RULE_CHECK = "Record cleaner rule check"


def audit_history(records: DataFrame, log: DataFrame, people: DataFrame, logging_since=None) -> DataFrame:
    """First entry and all logged changes of records: record_id, action, at, user_id, user_name, changed, notes.

    ``records``: record_id, created_on, user_id. ``log``: record_id, action, at, user_id, changed. Only records of the
    given frame are reported. ``logging_since`` marks entries older than the log.
    """
    late = F.lit(False) if logging_since is None else F.col("created_on") < F.lit(logging_since).cast("timestamp")
    first = records.select(
        "record_id",
        F.lit("Inserted").alias("action"),
        F.col("created_on").alias("at"),
        "user_id",
        F.lit(None).cast("string").alias("changed"),
        F.when(late, NOTE_BEFORE_LOG).alias("notes"),
    )
    check = F.col("changed").startswith('"last_verification_check_date"')
    changes = log.join(records.select("record_id"), "record_id", "left_semi").select(
        "record_id",
        recode("action", ACTIONS).alias("action"),
        "at",
        "user_id",
        "changed",
        F.when(check, NOTE_RULE_CHECK).alias("notes"),
    )
    both = first.unionByName(changes).distinct()
    return both.join(people.select("user_id", "user_name"), "user_id", "left").select(
        "record_id", "action", "at", "user_id", "user_name", "changed", "notes"
    )


#: Sessions that write to the tables without the application.
BACK_END = ("postgres", "indicia_data_user")
NOTE_BACK_END = "Action carried out directly on the back-end database"


def row_states(inserted: DataFrame, log: DataFrame, records: DataFrame) -> DataFrame:
    """The logged actions on ``records`` (record_id) with ``row_before``: the row as it was before each action, as a map.

    ``inserted``: record_id, entity, id, field, value: the fields of each row when it was entered. ``log``: log_id (a whole number),
    record_id, entity, id, changed (map of new values). A value holds from the action that set it to the next that sets the
    field; actions follow their log_id. The fields, which are the columns of the logged tables, are listed first, so
    that one ordered pass over each row's actions carries all values: log and entered rows are shuffled once, by record.
    """
    fields = sorted(r["k"] for r in log.select(F.explode(F.map_keys("changed")).alias("k")).union(inserted.select("field")).distinct().collect())
    rows = inserted.groupBy("record_id", "entity", "id").agg(F.collect_list(F.struct("field", "value")).alias("entered"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("entity", "id"), F.map_from_entries("entered")))).alias("_rows"))
    known = records.select("record_id").distinct().join(rows, "record_id", "left")
    own = log.repartition(shuffle_tasks(log), "record_id").join(known, "record_id").withColumn("_row", F.col("_rows")[F.struct("entity", "id")]).drop("_rows")
    # A value that was set to null is a value too.
    earlier = Window.partitionBy("record_id", "entity", "id").orderBy("log_id").rangeBetween(Window.unboundedPreceding, -1)
    given = lambda m, f: F.when(F.map_contains_key(m, f), F.struct(F.lit(f).alias("field"), F.col(m)[f].alias("value")))
    held = [F.coalesce(F.last(given("changed", f), True).over(earlier), given("_row", f)) for f in fields]
    none = F.array().cast("array<struct<field:string,value:string>>")
    out = own.withColumn("_held", F.filter(F.concat(none, F.array(*held)), lambda h: h.isNotNull()))
    placed = F.col("entity").isNotNull() & F.col("id").isNotNull() & F.col("log_id").isNotNull()
    return out.select(*log.columns, F.when(placed & (F.size("_held") > 0), F.map_from_entries("_held")).alias("row_before"))


def audit_trail(records: DataFrame, log: DataFrame, people: DataFrame, inserted: DataFrame, logging_since=None) -> DataFrame:
    """All actions on the records and on the rows that belong to them, with the row before each and notes.

    ``records``: record_id, created_on, user_id. ``log``: log_id, record_id, entity (table), id (of the row), action, at, user_id,
    session, changed (map). ``inserted``: see :func:`row_states`; the record's own rows have entity ``occurrences``.
    Result: record_id, action, entity, id, at, user_id, user_name, row_before, changed (JSON), notes.
    """
    late = F.lit(False) if logging_since is None else F.col("created_on") < F.lit(logging_since).cast("timestamp")
    entered = inserted.where((F.col("entity") == "occurrences") & (F.col("id") == F.col("record_id"))).groupBy("record_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("changed")
    )
    first = records.join(entered, "record_id", "left").select(
        "record_id", F.lit("Inserted").alias("action"), F.lit("occurrences").alias("entity"), F.col("record_id").alias("id"), F.col("created_on").alias("at"), "user_id",
        F.lit(None).cast("string").alias("row_before"), "changed", F.when(late, NOTE_BEFORE_LOG).alias("notes"),
    )
    states = row_states(inserted, log, records)
    checked = (F.col("entity") == "occurrences") & (F.size("changed") == 1) & F.map_contains_key("changed", "last_verification_check_date")
    notes = F.concat_ws(". ", F.when(checked, NOTE_RULE_CHECK), F.when(F.col("session").isin(*BACK_END), NOTE_BACK_END))
    changes = states.select(
        "record_id", recode("action", ACTIONS).alias("action"), "entity", "id", "at", "user_id", F.to_json("row_before").alias("row_before"), F.to_json("changed").alias("changed"), notes.alias("notes")
    )
    return first.unionByName(changes).join(people.select("user_id", "user_name"), "user_id", "left").select(
        "record_id", "action", "entity", "id", "at", "user_id", "user_name", "row_before", "changed", "notes"
    )
