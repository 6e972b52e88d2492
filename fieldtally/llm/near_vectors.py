"""Near duplicates of embeddings: inverted lists with residual product quantisation, exact cosine at the end.

Unit vectors go to their nearest coarse centroid's list; what is left of them is coded per subspace. A
query probes every list whose centroid is nearly as close as its own. In a list, asymmetric distances come
from tables of the query against the code books; a candidate stays while its estimate plus its own coding
error can reach the threshold, so that quantisation loses nothing; exact cosines decide.

Lists are cut into tiles of bounded size. A tile gives link counts and a spanning forest of its links, not
the links themselves, so that a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, components, discard, read_table, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct vectors, chosen by hash, that centroids and code books are fitted on.
SAMPLE = 16_384
#: Vectors per list aimed at, and most lists.
LIST, LISTS = 64, 1024
SUBSPACES, CODES = 8, 256
#: A list is probed if its centroid's cosine is less than the best by this at most.
MARGIN = 0.25
#: Stored vectors and queries in a tile.
STORED, ASKED = 2048, 2048
_CHUNK = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(vectors).max(axis=1, keepdims=True)


def means(points: np.ndarray, k: int, rounds: int, spherical: bool, rng) -> np.ndarray:
    """k-means; an empty cluster takes a random point."""
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        score = points @ centres.T
        if not spherical:
            score -= (centres**2).sum(axis=1) / 2
        label = score.argmax(axis=1)
        order = np.argsort(label, kind="stable")
        cuts = np.searchsorted(label[order], np.arange(k))
        size = np.bincount(label, minlength=k)
        total = np.add.reduceat(points[order], np.minimum(cuts, len(points) - 1), axis=0)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], points[rng.choice(len(points), k)])
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Index:
    """Coarse centroids and code books, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, total: int):
        rng = np.random.default_rng(20240609)
        self.lists = max(1, min(LISTS, total // LIST, len(sample) // 4))
        self.centres = means(sample, self.lists, 8, True, rng)
        rest = sample - self.centres[(sample @ self.centres.T).argmax(axis=1)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [means(rest[:, p], min(CODES, len(sample)), 6, False, rng) for p in self.parts]

    def assign(self, x: np.ndarray):
        """(home list, codes, norm of the coding error, which lists to probe)"""
        near = x @ self.centres.T
        home = near.argmax(axis=1)
        rest = x - self.centres[home]
        codes, error = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m] = (rest[:, p] @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
            error += ((rest[:, p] - book[codes[:, m]]) ** 2).sum(axis=1)
        probes = near >= near.max(axis=1, keepdims=True) - MARGIN
        return home, codes, np.sqrt(error), probes

    def estimates(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Cosines of queries with the coded vectors of list ``at``, by table look-up."""
        out = np.repeat((x @ self.centres[at])[:, None], len(codes), axis=1)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            out += (x[:, p] @ book.T)[:, codes[:, m]]
        return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of ``a[i]`` and ``b[i]``."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def tile_links(indexes: dict[int, Index], least: float):
    """For the rows of a tile: (node, vectors linked, root of its component in the tile)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        dim = int(rows.column("dim")[0].as_py())
        index = indexes[dim]
        get = lambda name: rows.column(name).combine_chunks() if rows.num_rows else rows.column(name)
        node, home, copies, asks = (get(n).to_numpy(zero_copy_only=False) for n in ("node", "home", "copies", "asks"))
        x = unit(matrix(get("vec"), dim))
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        at = int(rows.column("list")[0].as_py())
        distinct, place = np.unique(node, return_inverse=True)
        label, count = np.arange(len(distinct)), np.zeros(len(distinct), np.int64)
        _, codes, error, probes = index.assign(x[d])
        for lo in range(0, len(q), _CHUNK):
            some = q[lo : lo + _CHUNK]
            i, j = np.nonzero(index.estimates(x[some], at, codes) + error >= least - 1e-9)
            i, j, stored = some[i], d[j], j
            keep = node[i] != node[j]
            i, j, stored = i[keep], j[keep], stored[keep]
            near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
            near = near >= least
            i, j, stored = i[near], j[near], stored[near]
            np.add.at(count, place[i], copies[j])
            unseen = ~probes[stored, home[i]]  # the other will not ask here
            np.add.at(count, place[j[unseen]], copies[i[unseen]])
            label = merge(label, place[i], place[j])
        hit = count > 0
        joined = hit | (label != np.arange(len(label)))
        return pa.table({"node": distinct[joined], "n": count[joined], "root": distinct[label[joined]]})

    return run


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors are linked if their cosine in double precision is at least ``least``. Vectors that are null,
    zero or hold null or non-finite components link with nothing. Vectors of different lengths are never linked; each
    length has an index of its own, fitted on SAMPLE of its vectors at most. Every row with an id is a vector, also
    if its id or vector is repeated; a row without an id links with nothing, has no component and is kept.
    """
    rows = vectors.select(column(vectors, id).alias("id"), column(vectors, embedding).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0)
    valid = rows.where("id is not null").where(F.coalesce(fine, F.lit(False)))
    alone = lambda df: df.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = valid.groupBy("vec").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    classes = table(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    totals = {r["dim"]: r["count"] for r in classes.groupBy(F.size("vec").alias("dim")).count().collect()}
    if not totals:
        return alone(rows)
    indexes = {}
    for dim, total in sorted(totals.items()):
        picked = classes.where(F.size("vec") == dim).select("vec", F.xxhash64("node").alias("h")).orderBy("h").limit(SAMPLE).select("vec")
        indexes[dim] = Index(unit(np.array([r[0] for r in picked.collect()], np.float64)), total)

    # The indexes, bounded by LISTS and CODES for each length, travel with the tasks.
    def assign(batches):
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                rows_of = np.flatnonzero(lengths == dim)
                for lo in range(0, len(rows_of), 4096):
                    part = batch.take(pa.array(rows_of[lo : lo + 4096]))
                    home, _, _, probes = indexes[int(dim)].assign(unit(matrix(part.column(2), int(dim))))
                    owner, found = np.nonzero(probes)
                    cuts = np.searchsorted(owner, np.arange(len(home) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))
                    sizes = pa.array(np.full(len(home), dim), pa.int32())
                    yield pa.RecordBatch.from_arrays([*part.columns, sizes, pa.array(home, pa.int32()), lists], names=["node", "copies", "vec", "dim", "home", "probes"])

    placed = table(classes.select("node", "copies", "vec").mapInArrow(assign, "node long, copies long, vec array<double>, dim int, home int, probes array<int>"), "placed")
    stored = placed.groupBy("dim", F.col("home").alias("list")).agg(F.ceil(F.count("*") / STORED).alias("parts"))
    asked = placed.select("dim", F.explode("probes").alias("list")).groupBy("dim", "list").agg(F.ceil(F.count("*") / ASKED).alias("turns"))
    shape = F.broadcast(stored.join(asked, ["dim", "list"]))  # one row per list, LISTS at most for a length
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = ["dim", "list", "node", "copies", "vec", "home"]
    keep = placed.withColumn("list", F.col("home")).join(shape, ["dim", "list"]).select(*base, F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), each("turns").alias("turn"), F.lit(False).alias("asks"))
    ask = placed.withColumn("list", F.explode("probes")).join(shape, ["dim", "list"]).select(*base, each("parts").alias("part"), F.pmod(F.xxhash64("node"), F.col("turns")).alias("turn"), F.lit(True).alias("asks"))
    found = table(keep.union(ask).groupBy("dim", "list", "part", "turn").applyInArrow(tile_links(indexes, least), "node long, n long, root long"), "tiles")
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    reach = components(edges)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("node", "least_id", "copies", "vec").join(reach.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("smallest"))
    named = named.join(smallest, "component").select("vec", "smallest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = table(named, "named")
    discard(placed, found, classes)
    out = rows.join(named, F.col("id").isNotNull() & (rows["vec"] == named["vec"]), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id"))
    return out.select(
        F.col("id").alias(id),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op2_quantised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings"))
