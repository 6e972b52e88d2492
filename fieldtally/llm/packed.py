"""Token ids in Arrow files of equal-length sequences, and their reading.

Documents in ascending id order form one stream of ids. A range partition of it is a shard: one Arrow
IPC file (the stream format with a footer) whose batches hold ``ids`` and ``mask`` as fixed-size lists.
A batch's values are one flat buffer, so that sequence ``i`` of a memory-mapped file is a view, without
a copy. The last sequence of a shard is filled up with zeros under a zero mask.
"""

from __future__ import annotations

import sys
import zlib
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_text, column, read_table, slices, table
from .tokens import Encoder, as_small_bytes, vocabulary

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sequences in a record batch.
BATCH = 256
#: Bytes of text encoded at once.
TEXT_BYTES = 4 << 20


def store(uri: str):
    """(file system, path) of a folder all executors share, as pyarrow sees it."""
    from pyarrow import fs

    parsed = urlparse(uri)
    return (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def shard_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends ids; whole batches go to the file as they fill."""

    def __init__(self, folder: str, shard: int, attempt: int, length: int, wide: bool):
        self.files, root = store(folder)
        self.files.create_dir(root, recursive=True)
        self.path = f"{root}/shard-{shard:06d}.arrow"
        self.own = f"{root}/.shard-{shard:06d}-{attempt}"
        self.schema, self.length = shard_schema(length, wide), length
        self.kind = np.uint32 if wide else np.uint16
        self.sink = self.files.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.kind))
        self.waiting += len(ids)
        full = self.length * BATCH
        if self.waiting >= full:
            flat = np.concatenate(self.rest)
            cut = len(flat) // full * full
            for lo in range(0, cut, full):
                self.write(flat[lo : lo + full], full)
            self.rest, self.waiting = [flat[cut:]], len(flat) - cut

    def write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.rest, np.empty(0, self.kind)])
        if len(flat):
            self.write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()
        self.sink.close()
        self.files.move(self.own, self.path)  # a repeated task puts the same file in its place


def write_packed(
    docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 2
) -> DataFrame:
    """Encode all documents, append ``end_id`` to each, write shards to ``folder``; returns the index.

    Index: (doc_id, shard, first, n_tokens, start): ``first`` counts within the shard, ``start`` over
    all documents before. Null ids come first, rows that share an id follow by their text; a null
    text is empty and has its end id only. Strings of special tokens become those tokens, as in the
    library. An empty table gives an empty index and no file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    plain = docs.select(column(docs, id).alias("doc_id"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches):
        context = TaskContext.get()
        encoder = Encoder(shared.value, True, as_small_bytes)
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        writer, begun = None, 0
        for batch in batches:
            for part in slices(batch, batch.column(1), TEXT_BYTES):
                ids, offsets = encoder(as_text(part.column(1)))
                sizes = np.diff(offsets)
                ids = np.insert(ids, offsets[1:], end_id)
                writer = writer or ShardWriter(folder, context.partitionId(), context.taskAttemptId(), length, wide)
                writer.add(ids)
                n = sizes + 1
                first = begun + np.cumsum(n) - n
                begun += int(n.sum())
                shard = pa.array(np.full(len(n), context.partitionId()), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), shard, pa.array(first), pa.array(n)], names=["doc_id", "shard", "first", "n_tokens"])
        if writer:
            writer.close()

    kind = plain.schema["doc_id"].dataType.simpleString()
    index = table(ordered.mapInArrow(run, f"doc_id {kind}, shard int, first long, n_tokens long"), "token-index")
    # One row per shard; the shards follow the ids.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return index.join(before, "shard").select("doc_id", "shard", "first", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


class ShardReader:
    """Random access to one shard; local files are mapped, not read."""

    def __init__(self, folder: str, shard: int):
        files, root = store(folder)
        path = f"{root}/shard-{shard:06d}.arrow"
        local = files.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def values(self, batch: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids as numpy, mask as Arrow booleans, one bit each) of a batch, flat, as views of its buffers."""
        if batch != self.at:
            self.at, found = batch, self.reader.get_batch(batch)
            self.batch = found.column(0).flatten().to_numpy(zero_copy_only=True), found.column(1).flatten()
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = self.values(i // BATCH)
        lo = i % BATCH * self.length
        return ids[lo : lo + self.length], mask.slice(lo, self.length)

    def span(self, first: int, n: int):
        """The ids ``first .. first + n``, batch by batch; padding is an error."""
        full = self.length * BATCH
        while n > 0:
            ids, mask = self.values(first // full)
            lo = first % full
            part = ids[lo : lo + n]
            if mask.slice(lo, len(part)).true_count < len(part):
                raise ValueError("padding inside a document")
            yield part
            first, n = first + len(part), n - len(part)


def read_packed(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with ``ids_crc32`` (unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers),
    read from the shards; each shard is opened by the task that holds its rows."""
    names = ["doc_id", "start", "n_tokens", "shard", "first"]
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        at, reader = None, None
        for batch in batches:
            sums = []
            for shard, first, n in zip(*(batch.column(i).to_pylist() for i in (3, 4, 2))):
                if shard != at:
                    at, reader = shard, ShardReader(folder, shard)
                crc = 0
                for part in reader.span(first, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=[*names[:3], "ids_crc32"])

    ordered = index.select(*names).repartition("shard").sortWithinPartitions("shard", "first")
    return ordered.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op9_packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "packed")
    index = write_packed(read_table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_packed(index, out)
