"""Near duplicates of texts: one-permutation MinHash with optimal densification, banded buckets, stars.

A document's set holds its distinct five-word shingles. One hash per shingle falls into one of many bins;
a bin keeps its smallest. Empty bins borrow from the first filled bin in a random order of their own. Bands
of bins are bucket keys. Texts with one set are one class, and only classes go on.

Candidates are stars: a class meets the most central class of its buckets, and a few that are drawn. Where
stars leave a bucket in several components, exact follow-ups finish it: few strays are paired with all
others; the classes of a bucket with many strays meet anew by their rarest shingles, of which linked sets must
share one, and which parts texts that only share a passage. Pairs are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACES, annotate, as_text, column, components, discard, in_batches, mix, range_hashes, read_table, slices, spread, table, text_bytes, windows, word_ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
BANDS, ROWS = 56, 7
#: A bucket with so many strays at most is finished by pairing each with all others.
STRAYS = 8
#: Drawn classes that each class is compared with, besides the most central one.
DRAWN = 4
#: Members of a star that one task compares with its centre.
STAR = 512
#: Cells of the sketch that orders shingles by how often they come, and of one of the parts it is added up in.
SKETCH, PART = 1 << 17, 1 << 10
_CELL = np.uint64(64 - 17)

_rng = np.random.default_rng(20240608)
#: For each bin, the order in which an empty one asks the others.
_ORDER = np.stack([_rng.permutation(BANDS * ROWS) for _ in range(BANDS * ROWS)])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z in small letters, words ``[^\\x20\\x09-\\x0D]+``.

    With fewer than five words the whole sequence is the one shingle; without words the set is empty.
    """
    body, offsets = text_bytes(texts)
    starts, ends, bounds = word_ranges(body, offsets)
    words = range_hashes(body, starts, ends, lower=True)
    grams, at = windows(words, bounds, SHINGLE)
    cuts = np.searchsorted(at, bounds)
    out = []
    for i in range(len(bounds) - 1):
        n = bounds[i + 1] - bounds[i]
        if 0 < n < SHINGLE:
            out.append(mix(np.array([(words[bounds[i] : bounds[i + 1]] * PLACES[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of each bin (rows: sets that are not empty), empty bins filled from others."""
    k = BANDS * ROWS
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = owner * k + ((flat >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sets are sorted, and so are their bins
    values, filled = np.zeros(len(sets) * k, np.uint64), np.zeros(len(sets) * k, bool)
    values[cell[first]], filled[cell[first]] = flat[first], True
    out, empty = values.copy(), np.flatnonzero(~filled)
    for step in range(k):
        if not len(empty):
            break
        lender = empty // k * k + _ORDER[empty % k, step]
        found = filled[lender]
        out[empty[found]] = values[lender[found]]
        empty = empty[~found]
    return out.reshape(len(sets), k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    banded = signature.reshape(len(signature), BANDS, ROWS)
    total = (banded * PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACES[ROWS]
    return mix(total).view(np.int64)


def digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketches(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n_shingles, digest of the set, bands); an empty set has no digest and no bands."""

    def make():
        def run(texts):
            sets = shingle_sets(texts)
            full = [s for s in sets if len(s)]
            keys = band_keys(signatures(full)).ravel() if full else np.empty(0, np.int64)
            cuts = np.concatenate([[0], np.cumsum([BANDS * (len(s) > 0) for s in sets])])
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys)),
            ]

        return run

    plain = docs.select(column(docs, id).alias("id"), column(docs, text).alias("text"))
    return annotate(plain, "text", "n_shingles long, digest binary, bands array<long>", make, keep=["id"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets meet the similarity, as edges (a, b).

    Stars around ``a`` are compared in portions of bounded size: the centre's text goes to each portion,
    comes first, and the members stream past it.
    """
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("portions"))
    members = pairs.join(portions, "a").select(
        F.col("b").alias("id"), F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("portions")).alias("portion"), F.lit(True).alias("member")
    )
    centres = portions.select(F.col("a").alias("id"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(False).alias("member"))
    dealt = members.union(centres).join(texts, "id").select("star", "portion", "member", "id", "digest", "text")
    dealt = dealt.repartition("star", "portion").sortWithinPartitions("star", "portion", "member")

    def run(batches):
        centre = None
        for batch in batches:
            for part in slices(batch, batch.column(5)):
                stars, members, ids, digests = (part.column(i).to_pylist() for i in (0, 2, 3, 4))
                a, b = [], []
                for star, member, own, mark, s in zip(stars, members, ids, digests, shingle_sets(as_text(part.column(5)))):
                    if digest(s) != mark:  # another text under the same id
                        continue
                    if not member:
                        centre = s
                    else:
                        common = len(np.intersect1d(centre, s, assume_unique=True))
                        if 100 * common >= percent * (len(centre) + len(s) - common):
                            a.append(star)
                            b.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(a, part.schema.field(0).type), pa.array(b, part.schema.field(3).type)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return in_batches(dealt).mapInArrow(run, f"a {kind}, b {kind}")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity and that share two bands at least."""
    sides = {s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("bands").alias(f"bands{s}")) for s in "ab"}
    both = pairs.join(sides["a"], "a").join(sides["b"], "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(fits & (F.size(F.array_intersect("bandsa", "bandsb")) >= 2)).select("a", "b")


def buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, node) with the ``size`` of their bucket, where that is two classes or more."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "key")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (centre, other): each class with the most central class it meets, and with a few drawn ones.

    A bucket's centre is the class that meets most others, then the smallest; another is drawn by a hash. A
    class takes the best of its buckets' centres and DRAWN of those drawn, so that pairs stay in proportion.
    """
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.select("key", "node").join(weight, "node")
    rank, lot = F.struct(-F.col("weight"), F.col("node")), F.struct(F.xxhash64("key", "node"), F.col("node"))
    centre = weighed.groupBy("key").agg(F.min(rank).alias("rank"), F.min(lot).alias("lot")).select("key", "rank", F.col("lot.node").alias("drawn"))
    met = members.join(centre, "key").groupBy("node").agg(F.min("rank").alias("rank"), F.collect_set(F.struct(F.xxhash64("key").alias("h"), "drawn")).alias("drawn"))
    some = F.transform(F.slice(F.array_sort(F.filter("drawn", lambda d: d["drawn"] != F.col("node"))), 1, DRAWN), lambda d: d["drawn"])
    chosen = F.array_distinct(F.concat(F.array(F.col("rank.node")), some))
    return met.select(F.explode(chosen).alias("a"), F.col("node").alias("b")).where("a <> b")


def opened(members: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows (key, node, c, main, strays) of the buckets that still are in several components."""
    label = reach.select(F.col("id").alias("node"), "component")
    own = table(members.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "labelled")
    parts = own.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("most"), F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("main")
    )
    mixed = mixed.where("parts > 1").select("key", "main", (F.col("size") - F.col("most")).alias("strays"))
    state = table(own.join(mixed, "key"), "open")
    discard(own)
    return state


def stray_pairs(state: DataFrame) -> DataFrame:
    """Every pair of different components in a bucket: each class outside the main one with all others."""
    one = state.where("c <> main").select("key", F.col("node").alias("a"), F.col("c").alias("ca"))
    other = state.select("key", F.col("node").alias("b"), F.col("c").alias("cb"))
    return one.join(other, "key").where("ca <> cb").select("a", "b")


def counted(nodes: DataFrame) -> np.ndarray:
    """About how often the shingles of ``nodes`` (text) come, in SKETCH cells by hash.

    Each task adds up its own cells and hands them over in parts, which are dealt by their number and added up, so
    that the driver gets each cell once, in rows of PART cells: SKETCH cells in all, however many tasks there are.
    """

    def rows(parts):
        full = [(i, cells.tobytes()) for i, cells in parts if cells.any()]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in full], pa.int32()), pa.array([p[1] for p in full], pa.binary())], names=["part", "cells"])

    def first(batches):
        cells = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                for s in shingle_sets(as_text(part.column(0))):
                    np.add.at(cells, (s >> _CELL).astype(np.int64), 1)
        yield rows(enumerate(cells.reshape(-1, PART)))

    def add(batches):
        found = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[part] = found.get(part, 0) + np.frombuffer(own.as_buffer(), np.int64)
        yield rows(found.items())

    kind = "part int, cells binary"
    out = np.zeros((SKETCH // PART, PART), np.int64)
    for part, own in in_batches(nodes.select("text")).mapInArrow(first, kind).repartition("part").mapInArrow(add, kind).collect():
        out[part] += np.frombuffer(own, np.int64)
    return out.ravel()


def rarest(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Rows (key, node): each class's rarest shingles, as many as let no link pass.

    Sets that share ``percent`` of their union share one of their n - ceil(percent n / 100) + 1 first elements in
    any common order; the order is by the sketched count, then the hash. Only those first elements become rows.
    """
    own = table(texts.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "digest", "text"), "crowded")
    shared = own.sparkSession.sparkContext.broadcast(counted(own))

    def make():
        cells = shared.value

        def run(found):
            chosen, marks = [], []
            for s in shingle_sets(found):
                n = len(s)
                order = np.lexsort((s, cells[(s >> _CELL).astype(np.int64)]))
                chosen.append(s[order[: n - -(-percent * n // 100) + 1]] if n else s)
                marks.append(digest(s))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in chosen])])
            flat = np.concatenate([*chosen, np.empty(0, np.uint64)])
            return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.view(np.int64))), pa.array(marks, pa.binary())]

        return run

    made = annotate(own, "text", "first array<long>, mark binary", make, keep=["id", "digest"])
    out = table(made.where("digest = mark").select(F.explode("first").alias("key"), F.col("id").alias("node")).distinct(), "rarest")
    discard(own)
    return out


def tiled(state: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join the components of each bucket, compared bucket by bucket without pair rows.

    A tile holds STAR strays at most and streams all members of the bucket past them; one search in the
    strays' merged shingles gives a member's overlap with all of them. A tile gives an edge only if it joins
    what its edges have not joined yet.
    """
    parts = F.ceil(F.col("strays") / STAR)
    asks = state.where("c <> main").select("key", F.pmod(F.xxhash64("node"), parts).alias("part"), F.lit(0).alias("turn"), F.col("node").alias("id"), "c")
    other = state.select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(1).alias("turn"), F.col("node").alias("id"), "c")
    dealt = asks.union(other).join(texts, "id").select("key", "part", "turn", "id", "c", "digest", "text")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "turn")

    def run(batches):
        tile = None
        for batch in batches:
            for rows in slices(batch, batch.column(6)):
                keys, portions, turns, ids, own, digests = (rows.column(i).to_pylist() for i in range(6))
                edges = []
                for key, portion, turn, node, c, mark, s in zip(keys, portions, turns, ids, own, digests, shingle_sets(as_text(rows.column(6)))):
                    if digest(s) != mark:
                        continue
                    if tile is None or tile.at != (key, portion):
                        tile = Tile((key, portion), percent)
                    if turn == 0:
                        tile.add(node, c, s)
                    else:
                        edges += tile.compare(node, c, s)
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], rows.schema.field(3).type) for i in (0, 1)], names=["a", "b"])

    kind = state.schema["node"].dataType.simpleString()
    return in_batches(dealt).mapInArrow(run, f"a {kind}, b {kind}")


class Tile:
    """Some strays of a bucket, by their shingles."""

    def __init__(self, at, percent: int):
        self.at, self.percent = at, percent
        self.strays, self.sets, self.parent, self.flat = [], [], {}, None

    def add(self, node, c, s: np.ndarray) -> None:
        self.strays.append((node, c))
        self.sets.append(s)

    def root(self, c):
        while self.parent.get(c, c) != c:
            c = self.parent[c]
        return c

    def compare(self, node, c, s: np.ndarray) -> list:
        if self.flat is None:
            flat = np.concatenate([*self.sets, np.empty(0, np.uint64)])
            order = np.argsort(flat, kind="stable")
            self.flat, self.sizes = flat[order], np.array([len(x) for x in self.sets])
            self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.sets = []
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        common = np.bincount(self.owner[spread(lo, hi - lo)], minlength=len(self.sizes))
        out = []
        for i in np.flatnonzero(100 * common >= self.percent * (self.sizes + len(s) - common)):
            other, d = self.strays[i]
            if other != node and self.root(c) != self.root(d):
                self.parent[self.root(d)] = self.root(c)
                out.append((node, other))
        return out


def links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all classes that have a link.

    First the stars. Then, in buckets still in several components, all pairs that could join them: directly
    where strays are few; else among classes that share a rarest shingle. Pairs inside a component are never
    needed.
    """
    rows = classes.select("node", F.explode("bands").alias("key")).select("key", "node")
    members = table(buckets(rows), "buckets")
    ids = members.select("node").distinct().join(classes.select("node", "digest"), "node").withColumnRenamed("node", "id")
    wanted = table(texts.join(ids, "id"), "candidates")
    tested = table(stars(members), "pairs")
    edges = table(confirmed(likely(tested, classes, percent), wanted, percent), "links")
    reach = components(edges)

    state = opened(members, reach)
    discard(members)
    first = rarest(state.where(F.col("strays") > STRAYS), wanted, percent)
    closer = table(buckets(first), "closer")
    again = opened(closer, reach)
    pairs = stray_pairs(state.where(F.col("strays") <= STRAYS)).distinct()
    done = tested.union(tested.select("b", "a"))
    fresh = table(likely(pairs.join(done, ["a", "b"], "left_anti"), classes, percent), "pairs")
    found = table(confirmed(fresh, wanted, percent).union(tiled(again, wanted, percent)), "links")
    if not found.isEmpty():
        # What is known already comes in as stars, not as the edges that led to them.
        reach = components(found.union(reach.select("id", "component")))
    discard(state, first, closer, again, wanted, tested, fresh, found, edges)
    return reach


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked if 100 * common shingles >= percent * all shingles of both. A component's id is
    its smallest id; that document is kept. Texts that are null, empty or without words link with
    nothing. Rows that repeat an id take their text's component; copies of a row are all kept or none. A
    row without an id links with nothing, has no component and is kept.
    """
    drawn = table(sketches(docs, id, text), "sketches")
    known = drawn.where("id is not null and digest is not null")
    # Equal sets are one class, named by its smallest id.
    classes = known.groupBy("digest").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = table(classes, "classes")
    texts = docs.select(column(docs, id).alias("id"), column(docs, text).cast("string").alias("text"))
    reach = links(classes, texts, percent)
    named = classes.select("digest", "node").join(reach.select(F.col("id").alias("node"), "component"), "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("component"))
    out = drawn.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), percent=85)
