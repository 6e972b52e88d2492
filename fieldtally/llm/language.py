"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its letters, each rotated
by its place; a document bundles (adds) its trigrams, a language bundles its documents. The nearest
language by cosine wins. Runs of other characters count as one gap, a letter of its own.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, column, read_table, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 1024
#: About so many documents of each language are learnt from, chosen by a hash of their id.
LEARNT = 5000
#: Most languages that can be told apart; more distinct values of ``lang`` are an error.
LANGUAGES = 2000
NONE = "und"
#: Trigrams bound at once.
_BLOCK = 4096
_SCALE = 4096


class Letters:
    """Random vectors by code point, the same in every task."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.known:
            self.known[code] = np.random.default_rng([20240607, code]).choice(np.float32([-1, 1]), self.dimensions)
        return self.known[code]

    def bundles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(one bundle per text, whether the text has a letter)"""
        body, offsets = text_bytes(texts)
        out = np.zeros((len(offsets) - 1, self.dimensions), np.float32)
        codes = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        cuts = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offsets]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
        if not len(codes):
            return out, np.zeros(len(out), bool)
        present = np.flatnonzero(np.bincount(codes))
        small = {int(c): (ord(chr(c).lower()[0]) if chr(c).isalpha() else 0) for c in present}
        alphabet = np.array(sorted({0, *small.values()}))
        place = np.zeros(int(present[-1]) + 1, np.int64)
        place[present] = np.searchsorted(alphabet, [small[int(c)] for c in present])
        letter = place[codes]
        has = np.bincount(text[letter > 0], minlength=len(out)) > 0
        gap = letter == 0
        stay = ~gap
        stay[1:] |= gap[1:] & (~gap[:-1] | (text[1:] != text[:-1]))
        stay[0] = True
        letter, text = letter[stay], text[stay]
        whole = np.flatnonzero(text[2:] == text[:-2])
        m = len(alphabet)
        key = ((text[whole] * m + letter[whole]) * m + letter[whole + 1]) * m + letter[whole + 2]
        key, count = np.unique(key, return_counts=True)
        owner, gram = np.divmod(key, m**3)
        grams, column_of = np.unique(gram, return_inverse=True)
        vectors = np.stack([self.vector(int(a)) for a in alphabet])
        first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
        order = np.argsort(column_of, kind="stable")
        owner, column_of, count = owner[order], column_of[order], count[order]
        for lo in range(0, len(grams), _BLOCK):
            part = grams[lo : lo + _BLOCK]
            bound = first[part // (m * m)] * second[part // m % m] * vectors[part % m]
            a, b = np.searchsorted(column_of, [lo, lo + _BLOCK])
            counts = np.zeros((len(out), len(part)), np.float32)
            counts[owner[a:b], column_of[a:b] - lo] = count[a:b]
            out += counts @ bound
        return out, has


def held_out(id):
    """Whether CRC-32 of the id as text, modulo 3, is 1; a null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def prototypes(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", learnt: int = LEARNT, dimensions: int = DIMENSIONS):
    """(languages in order, unit prototypes) from texts with a language that are not held out.

    Rows of about ``learnt`` documents of each language, by a hash of the id; all, if there are fewer.
    Bundles are rounded to integers before they are added, so that the sum has no order.
    """
    rows = docs.select(column(docs, id).alias("id"), column(docs, text).cast("string").alias("text"), column(docs, lang).cast("string").alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null").where(~held_out(F.col("id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((0, dimensions), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, learnt / n) * 1_000_000))])
    rows = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")])

    def make():
        letters = Letters(dimensions)

        def run(texts):
            bundle, _ = letters.bundles(texts)
            norm = np.linalg.norm(bundle.astype(np.float64), axis=1, keepdims=True)
            whole = np.rint(bundle / np.maximum(norm, 1e-9) * (_SCALE * np.sqrt(dimensions))).astype(np.int32)
            cuts = pa.array(np.arange(len(whole) + 1) * dimensions, pa.int32())
            return [pa.ListArray.from_arrays(cuts, pa.array(whole.ravel()))]

        return run

    made = annotate(rows, "text", "bundle array<int>", make, keep=["lang"])
    summed = made.select("lang", F.posexplode("bundle").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in found]
    matrix = np.array([[x["v"] for x in r["v"]] for r in found], np.float64).reshape(len(names), dimensions)
    return names, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine with the nearest prototype, 0 to 1) and ``has_letters``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learnt; of equal scores the
    first name wins.
    """
    names, matrix = model

    def make():
        letters = Letters(matrix.shape[1])

        def run(texts):
            bundle, has = letters.bundles(texts)
            if not names:
                return [pa.array([NONE] * len(has), pa.string()), pa.array(np.zeros(len(has))), pa.array(has)]
            cosine = (bundle @ matrix.T).astype(np.float64) / np.maximum(np.linalg.norm(bundle.astype(np.float64), axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(axis=1)
            score = np.where(has, cosine.max(axis=1).clip(0, 1), 0.0)
            return [pa.array([names[b] if h else NONE for b, h in zip(best, has)], pa.string()), pa.array(score), pa.array(has)]

        return run

    return annotate(docs, text, "lang_pred string, score double, has_letters boolean", make, keep)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    out = identify(docs, prototypes(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
