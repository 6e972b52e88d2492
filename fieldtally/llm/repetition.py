"""Repetition coverage: characters inside duplicated n-grams of words and duplicated lines.

Words and lines are hashed by a rolling hash over the byte buffer of many texts at once; n-grams combine
the hashes of their words. Everything is a pass over numpy arrays, text by text in bounded slices.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, annotate, mix, range_hashes, read_table, text_bytes, windows, word_ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest share of a text's word characters that may lie in duplicated n-grams, by n.
NGRAM_SHARES = {5: 0.45, 6: 0.42, 8: 0.40, 10: 0.38}
#: Largest share of a text's characters that may lie in repeated lines.
LINE_SHARE = 0.30
#: The fixed rule: fewest words, and largest percentage of words in repeated windows of eight.
LEAST_WORDS, WINDOW, WINDOW_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def by_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between the cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])


def repeated(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a hash comes twice or more in its text, whether an equal one came before)."""
    keys = hashes ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def covered(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words found twice or more in their text."""
    grams, at = windows(hashes, bounds, n)
    text = np.searchsorted(bounds, at, "right") - 1
    hit = at[repeated(grams, text)[0]]
    depth = np.bincount(hit, minlength=len(hashes) + n) - np.bincount(hit + n, minlength=len(hashes) + n)[: len(hashes) + n]
    return np.cumsum(depth)[: len(hashes)] > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts and shares, one entry per text."""
    body, offsets = text_bytes(texts)
    begins = (body & 0xC0) != 0x80
    starts, ends, bounds = word_ranges(body, offsets)
    hashes = range_hashes(body, starts, ends)
    chars = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    word_chars = chars[ends] - chars[starts]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": by_text(begins & ~SPACE[body], offsets),
        "n_symbols": by_text(_SYMBOL[body], offsets),
    }
    total = np.maximum(out["word_chars"], 1)
    for n in sorted({*NGRAM_SHARES, WINDOW}):
        inside = covered(hashes, bounds, n)
        if n == WINDOW:
            out["n_repeat_words"] = by_text(inside, bounds)
        out[f"share_{n}"] = by_text(np.where(inside, word_chars, 0), bounds) / total

    breaks = body == 10
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(breaks) + 1]))
    line_starts = line_starts[line_starts < len(body)]
    next_text = offsets[np.searchsorted(offsets, line_starts, "right").clip(max=len(offsets) - 1)]
    next_break = np.append(np.flatnonzero(breaks), len(body))
    line_ends = np.minimum(next_break[np.searchsorted(next_break, line_starts)], next_text)
    solid = np.concatenate([[0], np.cumsum(~SPACE[body], dtype=np.int64)])
    full = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_bounds = np.searchsorted(line_starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(line_bounds))
    later = repeated(range_hashes(body, line_starts, line_ends), text)[1]
    out["n_dup_lines"] = by_text(later, line_bounds)
    out["line_share"] = by_text(np.where(later, chars[line_ends] - chars[line_starts], 0), line_bounds) / np.maximum(by_text(begins, offsets), 1)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > WINDOW_PERCENT * m["n_words"])
    kept = ~failed & (m["line_share"] <= LINE_SHARE)
    for n, most in NGRAM_SHARES.items():
        kept &= m[f"share_{n}"] <= most
    return failed, kept


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [f"share_{n}" for n in NGRAM_SHARES] + ["line_share"]


def repetition(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts, shares of repeated characters, ``base_failed`` and ``kept``.

    A null text has no words: zero counts and shares, failed, not kept. Words are ``[^\\x20\\x09-\\x0D]+``;
    a line counts as repeated if it has a word and equals an earlier one.
    """

    def make():
        def run(texts):
            m = measure(texts)
            return [pa.array(m[c], pa.int64()) for c in COUNTS] + [pa.array(m[c], pa.float64()) for c in SHARES] + [pa.array(v) for v in verdict(m)]

        return run

    results = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])
    return annotate(docs, text, results + ", base_failed boolean, kept boolean", make, keep)


def op4_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(read_table(spark, folder, "documents"), keep=["doc_id"])
