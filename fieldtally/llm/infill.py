"""Fill-in-middle transformation by secondary sort.

A text is cut into units (lines). Runs of whole units travel as pieces keyed by document and output
position; documents are dealt by key and sorted within partitions (the DataFrame form of
``repartitionAndSortWithinPartitions``), so that the pieces of an output stream past a running digest and no
text needs to fit in a task's memory. The stream is read like the output alone: its markers tell each piece's
place in the original text. A second sort within the same partitions restores that order; nothing is dealt twice.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, column, read_table, slices, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Markers of prefix, suffix and middle; a text that contains one of them stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the markers in each form.
FORMS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of each marked part in the original text.
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Bytes of a piece; a longer unit is cut.
CHUNK = 1 << 14
#: Bytes of pieces that a task hands over at once.
BATCH_BYTES = 1 << 22
#: Above the number of pieces in a part of a text.
_PART = 1 << 40

_PIECES = "row long, at long, body binary, doc_id string, n long, form string, prefix_chars long, middle_chars long"
_NAMES = ["row", "at", "body", "doc_id", "n", "form", "prefix_chars", "middle_chars"]


def draws(id: Column, seed: int = 7) -> list[Column]:
    """Four numbers from the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


class Rows:
    """Collects rows of pieces and hands them over as Arrow batches of bounded bytes."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.rows, self.bytes = [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)], names=self.names)
        self.rows, self.bytes = [], 0
        return made


def runs(ends: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that make up ``lo .. hi``: whole units (ending at ``ends``) up to CHUNK bytes, longer units cut."""
    while hi - lo > CHUNK:
        k = int(np.searchsorted(ends, lo + CHUNK, "right")) - 1
        cut = int(ends[k]) if k >= 0 and ends[k] > lo else lo + CHUNK
        yield lo, cut
        lo = cut
    if hi > lo:
        yield lo, hi


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Pieces (row, at, body) of every document's output, the first with the document's id, units, form and sizes.

    ``rate`` percent of the documents are transformed, ``spm`` percent of those with the suffix first. ``row``
    numbers the input's rows, so that repeated rows and null ids keep to themselves; the input has to come in the
    same order when a task is repeated, as a table does. A null text is empty; an empty text has one empty piece.
    """
    key = column(docs, id)
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), key.cast("string").alias("doc_id"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"),
        *[h.alias(f"h{k + 1}") for k, h in enumerate(draws(key, seed))],
    )
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        out = Rows(_NAMES, types)
        for batch in batches:
            for part in slices(batch, batch.column(2)):
                body, offsets = text_bytes(as_text(part.column(2)))
                whole = body.tobytes()
                chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                breaks = np.flatnonzero(body == 10) + 1
                first = np.searchsorted(breaks, offsets, "right")
                own = [part.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)]
                for i, (row, doc, h1, h2, h3, h4) in enumerate(zip(*own)):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    ends = breaks[first[i] : first[i + 1]]
                    if hi > lo and (not len(ends) or ends[-1] < hi):
                        ends = np.append(ends, hi)
                    n = len(ends)
                    marked = any(whole.find(m, lo, hi) >= 0 for m in PLACES)
                    form = "plain" if not n or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
                    if form == "plain":
                        parts, sizes = [(b"", lo, hi)], (None, None)
                    else:
                        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                        cuts = [int(ends[k - 1]) if k else lo for k in (a, b)]
                        spans = {PREFIX: (lo, cuts[0]), MIDDLE: (cuts[0], cuts[1]), SUFFIX: (cuts[1], hi)}
                        parts = [(m, *spans[m]) for m in FORMS[form]]
                        sizes = tuple(int(chars[spans[m][1]] - chars[spans[m][0]]) for m in (PREFIX, MIDDLE))
                    at = 0
                    for marker, begin, end in parts:
                        for x, y in list(runs(ends, begin, end)) or [(begin, begin)]:
                            head = (doc, n, form, *sizes) if at == 0 else (None,) * 5
                            out.add((row, at, marker + whole[x:y], *head), y - x)
                            marker, at = b"", at + 1
                            if out.full():
                                yield out.batch()
        if out.rows:
            yield out.batch()

    return plain.mapInArrow(run, _PIECES)


def streamed(pieces: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row of pieces.

    Pieces stream in output order past the output's digest; read by their markers, they are sorted into the
    original order within the same partitions and stream past the digest of the restored text. ``texts`` adds
    the texts ``output`` and ``restored``, which then have to fit in memory one by one.
    """
    moved_names = ["row", "at", "body", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output"]
    moved_types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    shown_names = [*moved_names[3:9], "restored_sha256", "output", "restored"]
    shown_types = [*moved_types[3:9], pa.string(), pa.string(), pa.string()]

    def read_output(batches):
        out, at, head, digest, kept, place, seen = Rows(moved_names, moved_types), None, None, None, [], 0, 0

        def finish():
            out.add((at, -1, None, *head, digest.hexdigest(), b"".join(kept).decode() if texts else None), 200 + sum(map(len, kept)))

        for batch in batches:
            rows = batch.column(0).to_numpy()
            body = batch.column(2)
            heads = [batch.column(k) for k in range(3, 8)]
            for i in range(batch.num_rows):
                data = body[i].as_buffer().to_pybytes()
                if rows[i] != at:
                    if head:
                        finish()
                    at, head = int(rows[i]), tuple(h[i].as_py() for h in heads)
                    digest, kept, place, seen, markers = hashlib.sha256(), [], 0, 0, list(FORMS[head[2]])
                digest.update(data)
                if texts:
                    kept.append(data)
                if markers and data.startswith(markers[0]):
                    place, seen = PLACES[markers[0]], 0
                    data = data[len(markers.pop(0)) :]
                if data:
                    out.add((at, place * _PART + seen, data, *(None,) * 7), len(data))
                    seen += 1
                if out.full():
                    yield out.batch()
        if head:
            finish()
        if out.rows:
            yield out.batch()

    def restore(batches):
        out, head, digest, kept = Rows(shown_names, shown_types), None, None, []

        def finish():
            text = b"".join(kept).decode() if texts else None
            out.add((*head[:6], digest.hexdigest(), head[6], text), 300 + 2 * len(text or ""))

        for batch in batches:
            begins = batch.column(1).to_numpy() < 0
            body = batch.column(2)
            heads = [batch.column(k) for k in range(3, 10)]
            for i in range(batch.num_rows):
                if begins[i]:
                    if head:
                        finish()
                    head, digest, kept = tuple(h[i].as_py() for h in heads), hashlib.sha256(), []
                else:
                    data = body[i].as_buffer()
                    digest.update(data)
                    if texts:
                        kept.append(data.to_pybytes())
                if out.full():
                    yield out.batch()
        if head:
            finish()
        if out.rows:
            yield out.batch()

    dealt = pieces.repartition("row").sortWithinPartitions("row", "at")
    moved = dealt.mapInArrow(read_output, f"{_PIECES}, output_sha256 string, output string")
    restored = moved.sortWithinPartitions("row", "at").mapInArrow(
        restore, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string, restored string"
    )
    return restored if texts else restored.drop("output", "restored")


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7, texts: bool = True) -> DataFrame:
    """Every document's output and the text restored from it, with digests; see ``pieces`` and ``streamed``.

    Other columns of ``docs`` are not carried, so none can clash; each row gives one row, repeated ones too. An
    empty table gives an empty result.
    """
    found = streamed(pieces(docs, id, text, rate, spm, seed), texts)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id].dataType)).withColumnRenamed("doc_id", id)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(read_table(spark, folder, "documents"), texts=False)


#: DuckDB: units by pattern, parts by joining them.
OP11_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents),
drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 100
            THEN 'plain' WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM units),
parts AS (
    SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1:n], '') AS s
    FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts"""
