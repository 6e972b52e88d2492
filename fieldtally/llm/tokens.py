"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Merges never cross a pre-token, and a pre-token never holds a white-space character after another
character, nor a mark after a letter. So a text may be cut there; the pieces are found on the byte
buffer, made distinct by Arrow, and only distinct pieces go through the library.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Callable
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from . import common
from .common import annotate, spread, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct pieces a task remembers before it starts anew; bounds memory, results do not depend on it.
REMEMBERED = 400_000
#: Bytes of text encoded at once: arrays of a slice take some 60 bytes for each.
SLICE = 1 << 19

_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A, 0x0D, 0x09]] = True
# The byte before a cut at white space: certainly the end of a character that is no white space.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # two-byte characters past U+00BF: none is white space
# A cut also stands between a Latin letter and an ASCII mark or digit.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PLAIN & ~_LETTER
_ACCENTED = np.zeros(256, bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False  # after 0xC3: the multiplication and division signs
_WORD = re.compile("[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def pieces(body: np.ndarray, offsets: np.ndarray, marks: np.ndarray = _MARK) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the pieces, index of the first piece of each text and of the end)."""
    cut = np.zeros(len(body) + 1, bool)
    if len(body) > 1:
        before, here = body[:-1], body[1:]
        safe, letter = _PLAIN[before], _LETTER[before]
        safe[1:] |= (before[1:] >= 0x80) & _LEAD[before[:-1]]
        letter[1:] |= (before[:-1] == 0xC3) & _ACCENTED[before[1:]]
        cut[1:-1] = (_CUT[here] & safe) | (marks[here] & letter)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at, np.searchsorted(at, offsets)


class Encoder:
    """Ids of many texts: distinct pieces are encoded once, then gathered.

    ``shown`` turns a piece of one word into the string that the library's BPE model sees, by the
    byte table; other pieces go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, specials: bool, shown: Callable[[str], tuple[str, ...]]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not specials
        self.shown = shown
        self.marks = _MARK.copy()
        if specials:  # no cut inside their strings
            for t in self.tokenizer.get_added_tokens_decoder().values():
                self.marks[list(t.content.encode())] = False
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def learn(self, new: list[str]) -> None:
        merge, shown, flat, ends = self.tokenizer.model.tokenize, self.shown, self.flat, self.ends
        words = [w if _WORD.fullmatch(w) else None for w in new]
        other = [w for w, word in zip(new, words) if word is None]
        encoded = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        for word in words:
            if word is None:
                flat.extend(next(encoded).ids)
            else:
                for part in shown(word):
                    flat.extend([t.id for t in merge(part)])
            ends.append(len(flat))
        self.known.update(zip(new, range(len(ends) - 1 - len(new), len(ends) - 1)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets by text)"""
        body, offsets = text_bytes(texts)
        if not len(body):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        at, first = pieces(body, offsets, self.marks)
        data = pa.py_buffer(np.ascontiguousarray(body))
        whole = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), data).dictionary_encode()
        distinct = whole.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        place[missing] = np.arange(len(missing)) + len(self.ends) - 1
        self.learn([distinct[i] for i in missing])
        code = place[whole.indices.to_numpy(zero_copy_only=False)]
        ends = np.frombuffer(self.ends, np.int64)
        lengths = ends[code + 1] - ends[code]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.frombuffer(self.flat, np.uint32)[spread(ends[code], lengths)], total[first]


def byte_table() -> dict[str, int]:
    """The character that stands for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


_SHOWN = {b: c for c, b in byte_table().items()}


def as_bytes(piece: str) -> tuple[str, ...]:
    """Each byte as its character; a line end stands alone, a space goes with its word."""
    if piece[0] == "\n":
        return _SHOWN[10], as_bytes(piece[1:])[0]
    if piece.isascii():
        return (_SHOWN[32] + piece[1:] if piece[0] == " " else piece,)
    return (piece.encode().decode("latin-1").translate(_SHOWN),)


def as_small_bytes(piece: str) -> tuple[str, ...]:
    """The same for vocabularies in small letters that drop white space."""
    piece = piece.strip().lower()
    return (piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN),)


class Decoder:
    """Bytes of ids: the vocabulary's characters turned back by the byte table, then gathered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer, back = Tokenizer.from_str(vocabulary), byte_table()
        specials = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        words = [specials[i] if i in specials else bytes(back[c] for c in tokenizer.id_to_token(i)) for i in range(size)]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offset of each token and of the end); a character split between tokens comes back whole."""
        lengths = self.lengths[ids]
        return self.bytes[spread(self.starts[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def char_offsets(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters begun before each byte offset, whether the offset lies inside a character)."""
    inner = (body & 0xC0) == 0x80
    begun = np.concatenate([[0], np.cumsum(~inner)])
    return begun[ends], np.concatenate([inner, [False]])[ends]


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``starts``, ``ends``: each token's characters in the text.

    A character split between tokens belongs to all of them. A null or empty text has empty arrays;
    strings of special tokens are ordinary text. Repeated rows give repeated results. The vocabulary
    file, of fixed size, is read by the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        encoder, decoder = Encoder(shared.value, False, as_bytes), Decoder(shared.value)

        def run(texts):
            ids, offsets = encoder(texts)
            body, at = decoder(ids, offsets)
            begun, inside = char_offsets(body, at)
            base = np.repeat(begun[offsets[:-1]], np.diff(offsets))
            starts, ends = (begun[:-1] - inside[:-1] - base), begun[1:] - base
            cuts = pa.array(offsets, pa.int32())
            return [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (ids, starts, ends)]

        return run

    return annotate(docs, text, "ids array<int>, starts array<int>, ends array<int>", make, keep, SLICE)


def decode(tokens: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded``: the bytes of ``ids`` (null: empty), which may end inside a character."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [f for f in tokens.schema.fields if f.name.lower() != "decoded" and (keep is None or f.name in keep)]
    plain = tokens.select(*[common.column(tokens, f.name).alias(f"c{i}") for i, f in enumerate(kept)], common.column(tokens, ids).alias("ids"))
    from pyspark.sql import types as T

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("decoded", T.BinaryType())]

    def run(batches):
        decoder = Decoder(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = pa.compute.fill_null(batch.column(len(kept)), [])
                cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
                body, at = decoder(lists.flatten().to_numpy(zero_copy_only=False), cuts)
                out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[cuts].astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out], names=[f.name for f in fields])

    return common.in_batches(plain).mapInArrow(run, T.StructType(fields)).toDF(*[f.name for f in kept], "decoded")


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256``, ``n_split`` (tokens that begin inside a character).

    Null and empty texts have no tokens and the digests of nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        encoder, decoder = Encoder(shared.value, False, as_bytes), Decoder(shared.value)

        def run(texts):
            ids, offsets = encoder(texts)
            body, at = decoder(ids, offsets)
            _, inside = char_offsets(body, at)
            split = np.concatenate([[0], np.cumsum(inside[:-1])])
            raw, plain, cuts = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(body), at[offsets]
            return [
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])], pa.string()),
                pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string()),
                pa.array(np.diff(split[offsets]), pa.int64()),
            ]

        return run

    return annotate(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long", make, keep, SLICE)


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(common.read_table(spark, folder, "documents"), path, keep=["doc_id"])
