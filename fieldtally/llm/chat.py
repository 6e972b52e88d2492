"""Chat formatting by columnar byte assembly.

A batch of turns becomes one preallocated buffer: segment lengths give offsets, offsets give scatter
indices, and headers, contents and ends are copied to their places in numpy. The buffer is the data of the
resulting Arrow strings. Template of a turn: ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line end becomes ``\\n`` besides.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, column, read_table, slices, spread, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, BREAK, END = b"<|turn|>", b"\n", b"<|end|>\n"
#: Roles whose texts are under the loss mask.
TRAINED = ("assistant",)
_BACKSLASH, _LESS, _BAR, _LINE = b"\\<|\n"
_TURN = re.compile(r"<\|turn\|>((?:[^\\<\n]|\\.|<(?!\|))*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.S)


def escaped(body: np.ndarray, offsets: np.ndarray, lines: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts with a backslash set before what would read as control."""
    mark = body == _BACKSLASH
    mark[1:] |= (body[1:] == _BAR) & (body[:-1] == _LESS)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    mark[first] = body[first] == _BACKSLASH  # what stands before belongs to another text
    if lines:
        mark |= body == _LINE
        body = np.where(body == _LINE, ord("n"), body).astype(np.uint8)
    moved = np.concatenate([[0], np.cumsum(mark)])
    out = np.full(len(body) + int(moved[-1]), _BACKSLASH, np.uint8)
    out[np.arange(len(body)) + moved[1:]] = body
    return out, offsets + moved[offsets]


def unescaped(text: str, lines: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if lines and m[1] == "n" else m[1], text, flags=re.S)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(formatted turns, characters of each, where its text begins and ends, in characters)"""
    role, role_at = escaped(*text_bytes(roles), lines=True)
    text, text_at = escaped(*text_bytes(texts))
    n = len(roles)
    fixed = [np.frombuffer(b, np.uint8) for b in (OPEN, BREAK, END)]
    sizes = np.stack([np.full(n, len(OPEN)), np.diff(role_at), np.full(n, len(BREAK)), np.diff(text_at), np.full(n, len(END))], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for at, part in zip((0, 2, 4), fixed):
        out[(starts[:, at, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    out[spread(starts[:, 1], sizes[:, 1])] = role
    out[spread(starts[:, 3], sizes[:, 3])] = text
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    cuts = np.concatenate([starts[:, 0], ends[-1:, 4]]) if n else np.zeros(1, np.int64)
    turns = pa.StringArray.from_buffers(n, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out))
    begin = chars[starts[:, 0]]
    return turns, chars[ends[:, 4]] - begin, chars[starts[:, 3]] - begin, chars[ends[:, 3]] - begin


def format_chats(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(id, turn, formatted, loss_start, loss_end) per turn, in characters of ``formatted``; no loss: both null.

    A conversation is the concatenation of its turns in the order of ``turn``, then role and text (ties,
    repeated rows); null turns come first. Null roles and texts are empty. Rows without an id are one
    conversation. Each turn stands for itself, so that a long conversation needs no task of its own.
    """
    plain = turns.select(column(turns, id).alias("id"), column(turns, turn).alias("turn"), column(turns, role).cast("string").alias("role"), column(turns, text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.column(3)):
                roles, texts = as_text(part.column(2)), as_text(part.column(3))
                formatted, _, start, end = assembled(roles, texts)
                loss = pa.compute.fill_null(pa.compute.is_in(roles, pa.array(trained, pa.string())), False).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], formatted, pa.array(start, pa.int32(), mask=~loss), pa.array(end, pa.int32(), mask=~loss)],
                    names=["id", "turn", "formatted", "loss_start", "loss_end"],
                )

    kinds = [plain.schema[c].dataType.simpleString() for c in ("id", "turn")]
    out = plain.mapInArrow(run, f"id {kinds[0]}, turn {kinds[1]}, formatted string, loss_start int, loss_end int")
    return out.withColumnsRenamed({"id": id, "turn": turn})


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation; anything else is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(m[1], True), unescaped(m[2])))
        at = m.end()
    return out


def tie_order(formatted: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn, unescaped: the order of turns with the same number, computed where they tie."""
    role = F.regexp_extract(formatted, r"^<\|turn\|>([^\n]*)", 1)
    text = F.regexp_extract(formatted, r"(?s)^[^\n]*\n(.*)<\|end\|>\n$", 1)
    line = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(line, r"(?s)\\(.)", "$1"), F.regexp_replace(text, r"(?s)\\(.)", "$1")


def read_back(formatted: DataFrame, id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of each conversation from its formatted turns, parsed and unescaped again.

    Turns stream in order past running digests, so that a conversation of any length needs little memory.
    """
    plain = formatted.select(column(formatted, id).alias("id"), column(formatted, turn).alias("turn"), "formatted", "loss_start", "loss_end")
    ordered = plain.repartition("id").sortWithinPartitions("id", "turn", *tie_order(F.col("formatted")))
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        at, state, done = None, None, []
        for batch in batches:
            for own, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or own != at:
                    if state:
                        done.append(state)
                    at, state = own, [own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    loss = unescaped(text[start:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
            if done:
                yield rows(done)
                done = []
        if state:
            yield rows([state])

    def rows(states):
        shown = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]] for s in states]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*shown), kinds)], names=names)

    kind = plain.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out = ordered.mapInArrow(run, f"id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id)


#: A conversation whose texts hold control strings of common templates.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(probe)))


#: DuckDB: the same digests straight from the table.
OP8_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(17 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
        + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
