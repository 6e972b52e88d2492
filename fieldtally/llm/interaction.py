"""Which filter removes what, in every order: an audit from the cells of failure masks.

Every document is reduced to the set (mask) of filters it fails, and documents are counted by part and mask.
A walk over the subsets of filters in Gray-code order switches one filter at a time and keeps, for each mask, the
number of active filters it fails and, over all masks, the survivors. The states of all subsets answer every
order: what a filter removes at a step is the difference of two states.
"""

from __future__ import annotations

import math
import sys
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The filters of ``document_cells``, in the order of their bits.
FILTERS = "ABCDE"
#: What parts words.
_GAP = r"[\x20\x09-\x0D]+"
_RESULT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_masks(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, key, mask) of every row: ``key`` is the SHA-256 of the text, ``mask`` the filters A to D that it fails.

    A: under 200 words. B: distinct words fewer than half of the words. C: capitals A-Z over 3 % of the code points.
    D: one of ``#$%&*|``. A null text is empty and an empty text fails A only; a null part is the empty string.
    """
    plain = docs.select(
        column(docs, id).alias("doc_id"), F.coalesce(column(docs, part).cast("string"), F.lit("")).alias("part"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text")
    )
    cut = plain.withColumn("words", F.split("text", _GAP, -1))
    # Only the first and the last word can be empty.
    first, last = F.col("words")[0] == "", F.element_at("words", -1) == ""
    sized = cut.select(
        "doc_id", "part", F.sha2("text", 256).alias("key"),
        (F.size("words") - first.cast("int") - F.when(F.size("words") > 1, last.cast("int")).otherwise(0)).cast("long").alias("n"),
        (F.size(F.array_distinct("words")) - (first | last).cast("int")).cast("long").alias("different"),
        F.length("text").cast("long").alias("chars"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.col("text").rlike(r"[#$%&*|]").alias("marked"),
    )
    fails = [F.col("n") < 200, 100 * F.col("different") < 50 * F.col("n"), 100 * F.col("capitals") > 3 * F.col("chars"), F.col("marked")]
    return sized.select("doc_id", "part", "key", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def document_cells(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, documents, good, toxic): rows of ``docs`` by the filters they fail, among them E: the text of a smaller id.

    Texts are compared by SHA-256 over the whole table. Rows without an id are never smaller nor fail E; rows that
    repeat an id are no smaller than each other. An id is good or toxic if any of its labels says 1; without labels it is neither.
    """
    own = labels.select(column(labels, "doc_id").alias("id"), column(labels, "quality").alias("quality"), column(labels, "toxic").alias("toxic")).where("id is not null")
    own = own.groupBy("id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = text_masks(docs, id, text, part)
    rows = rows.join(own, rows["doc_id"] == own["id"], "left").select("doc_id", "part", "key", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Copies shrink to a row per text, part and labels before the smallest id of a text is sought.
    alike = ["key", "part", "mask", "good", "toxic"]
    each = rows.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    texts = each.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    least = F.min("least").over(Window.partitionBy("key"))
    later = F.col("known") - F.when(F.col("least") == F.col("overall"), F.col("at_least")).otherwise(0)
    split = texts.withColumn("overall", least).withColumn("later", later)
    fails = F.array(F.struct(F.lit(16).alias("bit"), F.col("later").alias("n")), F.struct(F.lit(0).alias("bit"), (F.col("n") - F.col("later")).alias("n")))
    cells = split.select("part", "mask", "good", "toxic", F.explode(fails).alias("e")).where("e.n > 0")
    return cells.groupBy("part", (F.col("mask") + F.col("e.bit")).alias("mask")).agg(
        F.sum("e.n").alias("documents"), F.sum(F.col("e.n") * F.col("good")).alias("good"), F.sum(F.col("e.n") * F.col("toxic")).alias("toxic")
    )


def gray_states(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters: ``cells`` is (parts, masks, measures), the result (parts, subsets, measures).

    Neighbours in the Gray code differ by one filter: the masks that fail it gain or lose one active failure,
    and those that come to one or go to none leave or rejoin the survivors.
    """
    masks = 1 << filters
    fails = (np.arange(masks)[:, None] >> np.arange(filters)) & 1
    active = np.zeros(masks, np.int64)
    running = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = running
    subset = 0
    for k in range(1, masks):
        f = (k & -k).bit_length() - 1
        subset ^= 1 << f
        touched = fails[:, f] == 1
        if subset >> f & 1:
            running = running - cells[:, touched & (active == 0)].sum(axis=1)
            active[touched] += 1
        else:
            active[touched] -= 1
            running = running + cells[:, touched & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def audit_rows(cells: np.ndarray, filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(order, step, counts as (parts, orders x steps, 7)) from the states of all subsets; counts as in ``audit``."""
    n = len(filters)
    states = gray_states(cells, n)
    failing = states[:, 0, 0][:, None] - states[:, [1 << f for f in range(n)], 0]
    shapley = np.zeros((len(cells), n), np.int64)
    for f in range(n):
        for before in range(1 << n):
            if not before >> f & 1:
                size = before.bit_count()
                orders = math.factorial(size) * math.factorial(n - 1 - size)
                shapley[:, f] += orders * (states[:, before, 0] - states[:, before | 1 << f, 0])
    names, steps, counts = [], [], []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = states[:, before] - states[:, after]
            counts.append(np.stack([states[:, after, 0], gone[:, 0], failing[:, f] - gone[:, 0], cells[:, 1 << f, 0], gone[:, 1], gone[:, 2], shapley[:, f]], axis=1))
            names.append("".join(filters[i] for i in order))
            steps.append(step)
            before = after
    return names, np.array(steps, np.int32), np.stack(counts, axis=1)


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part and order.

    ``cells``: part, mask (bit i: fails ``filters[i]``), documents, good, toxic; at most one row per part and mask, so
    that a part has at most 2 ** len(filters) rows. Every part gives a row per order and step, zeros included; no cells, no rows.
    """
    masks = 1 << len(filters)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("mask", "documents", "good", "toxic")])).alias("cells"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                own = np.zeros((1, masks, 3), np.int64)
                for c in batch.column(1)[at].as_py():
                    own[0, c["mask"]] = c["documents"], c["good"], c["toxic"]
                names, steps, counts = audit_rows(own, filters)
                columns = [pa.array([batch.column(0)[at].as_py()] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(steps)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[0, :, i]) for i in range(len(_RESULT))], names=["part", "filter_order", "step", *_RESULT])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _RESULT))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(document_cells(read_table(spark, folder, "documents"), read_table(spark, folder, "labels")))


#: DuckDB: every order is replayed document by document (cells by mask, counted once).
OP12_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
labelled AS (
    SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
marked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * list_unique(w) < 50 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
    FROM docs LEFT JOIN labelled ON doc_id = id),
cells AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS earlier FROM orders, range(1, 6) AS s(step)),
seen AS (
    SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS only_this,
        len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone
    FROM cells, steps),
counted AS (
    SELECT part, filter_order, step, f, CAST(sum(CASE WHEN gone OR failing THEN 0 ELSE n END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN only_this THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM seen GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""
