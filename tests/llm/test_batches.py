"""Arrow batches of long texts stay small, so that memory outside the heap does not follow the number of rows."""

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from fieldtally.llm import common, tokens


def long_texts(spark):
    """400 texts of 20,000 bytes, and one of 3,000,000, in one task."""
    size = F.when(F.col("id") == 7, 3_000_000).otherwise(20_000)
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), (size / 5).cast("int")))
    return spark.range(0, 401, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))


def held(spark):
    """Bytes of text in the batch of each row."""

    def make():
        return lambda texts: [pa.array([texts.buffers()[2].size] * len(texts), pa.int64())]

    return {r[0]: r[1] for r in common.annotate(long_texts(spark), "text", "held long", make, ["doc_id"]).collect()}


def test_batches_end_by_bytes(spark):
    spark.conf.unset(common.BATCH_LIMIT)
    try:
        found = held(spark)
        assert len(found) == 401
        # Beside the long text, a batch has its limit and the text that passes it, in buffers that double.
        assert max(n for i, n in found.items() if abs(i - 7) > 100) <= 2 * (common.SLICE_BYTES + 20_100)
        assert max(found.values()) <= 2 * (common.SLICE_BYTES + 3_000_100)
    finally:
        spark.conf.unset(common.BATCH_LIMIT)


def test_a_limit_that_was_set_stays(spark):
    spark.conf.set(common.BATCH_LIMIT, "123456")
    try:
        assert max(n for i, n in held(spark).items() if i > 100) <= 2 * (123_456 + 20_100)
        assert spark.conf.get(common.BATCH_LIMIT) == "123456"
    finally:
        spark.conf.unset(common.BATCH_LIMIT)


def test_round_trip_over_many_batches_is_whole(spark):
    found = {r["doc_id"]: r for r in tokens.round_trip(long_texts(spark), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]).collect()}
    texts = {r["doc_id"]: r["text"] for r in long_texts(spark).collect()}
    assert {i: r["decoded_sha256"] for i, r in found.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
