"""What the operators of this package share: scratch tables, columnar passes over texts, components of a graph.

Texts are handled as Arrow buffers in slices of bounded bytes, so that memory does not follow the batch size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Executors get these functions with the task; the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: The session's limit of an Arrow batch on its way to Python, beside the number of rows.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, executors may be lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        if t is not None:
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(t.scratch)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def column(df: DataFrame, name: str):
    """The column of that very name, also if dots are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, for ``mapInArrow`` over texts: the session's batches end at ``SLICE_BYTES``, unless a limit was set.

    By number of rows alone a batch holds 10,000 texts, several times over: in the vectors and the buffer of the
    executor's JVM, outside its heap, and in the Python worker.
    """
    if df.sparkSession.conf.get(BATCH_LIMIT, None) is None:
        df.sparkSession.conf.set(BATCH_LIMIT, str(SLICE_BYTES))
    return df


def annotate(
    df: DataFrame, text: str, results: str, make: Callable[[], Callable[[pa.Array], list]], keep: list[str] | None = None, most: int = SLICE_BYTES
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``results`` computed from ``text``, row by row and in slices of ``most`` bytes.

    ``make()`` runs once per task and returns a function from an Arrow string array to the result
    arrays. An existing column with the name of a result is replaced.
    """
    found = T._parse_datatype_string(results).fields
    new = {f.name.lower() for f in found}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    n = len(kept)
    plain = df.select(*[column(df, f.name).alias(f"c{i}") for i, f in enumerate(kept)], column(df, text).cast("string").alias(f"c{n}"))
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]
    fields += [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(found)]

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, batch.column(n), most):
                values = compute(as_text(part.column(n)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *values], names=[f.name for f in fields])

    out = in_batches(plain).mapInArrow(run, T.StructType(fields))
    return out.toDF(*[f.name for f in kept], *[f.name for f in found])


def as_text(values: pa.Array) -> pa.Array:
    return values if values.type == pa.string() else values.cast(pa.string())


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = SLICE_BYTES):
    """Consecutive rows of ``batch`` whose texts have at most ``most`` bytes together, or one row."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text is empty."""
    texts = pa.compute.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---- words and their hashes -----------------------------------------------------------

#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd factors, one for each place in a shingle.
PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


def range_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit rolling hash of each byte range, ASCII capitals as small letters if ``lower``."""
    sums = np.empty(len(body) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[body] * _power(_BASE, len(body))[: len(body)], dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(body))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_ranges(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each text and of the end)."""
    inside = ~SPACE[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(body))]  # where a text begins directly after another
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words within a text, index of its first word)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = len(hashes) - n + 1
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * PLACES[k]
    return mix(total + np.uint64(n)), at


# ---- components -----------------------------------------------------------------------


def scattered(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, are not yet stars: a node has two lower neighbours, or neighbours on both sides."""
    lower = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    upper = edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    per = lower.union(upper).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return per.where("below > 1 or (below > 0 and above > 0)").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a, b): the smallest id that can be reached.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of
    them, by an aggregate that combines before its shuffle and a join; about log(n) rounds, until only
    stars around smallest ids are left. Each round is written to the shared folder.
    """
    kind = edges.schema["a"].dataType.simpleString()
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = table(ordered, "edges")
    while scattered(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = table(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(now, large)
        now = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).select(F.col("id").cast(kind), F.col("component").cast(kind))
