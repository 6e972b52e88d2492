"""From ``documents`` to tokens: language, near duplicates, personal data, mixing, byte-level BPE.

Each stage reads what the one before wrote and returns the columns of ``documents``; the last adds tokens.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import language, mixing, near_text, personal, tokens
from fieldtally.llm.common import discard, read_table, table

#: Percent of shingles that near duplicates share.
SIMILAR = 80


#: Columns that the stages read or write; others are set aside under names that no operator uses.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """``stage`` with the other columns of its documents set aside, so that none is taken for one of its results."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"kept_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those without text or letters go. Where no language was learnt, the others stay."""
    found = language.identify(docs, language.prototypes(docs))
    return found.where("has_letters").select(*docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; of rows that repeat an id one, without id the last choice."""
    # A key of each row's own, written, so that every row has its decision.
    rows = table(docs.withColumn("row_key", F.monotonically_increasing_id()), "rows")
    found = near_text.near_duplicates(rows, id="row_key", percent=SIMILAR).select("row_key", "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = found.join(rows.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(rank).alias("first")).select("first.row_key")
    return rows.join(kept, "row_key", "left_semi").select(*docs.columns)


@apart
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; the length follows the text."""
    found = personal.personal(docs)
    text = personal.redacted(F.col("text"), personal.together(F.col("base"), F.col("extra")))
    changed = F.size("base") + F.size("extra") > 0
    out = found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens and the digests of ids and decoded bytes.

    Columns of theirs with the name of a result give way to it.
    """
    return tokens.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = table(stage(spark, docs, sf_dir), name)
        discard(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted models and tokenizers stand in the way of SQL.
ORACLE_SQL = None
