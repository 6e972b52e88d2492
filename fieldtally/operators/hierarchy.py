"""Trees stored as (id, parent_id).

Walks use path doubling: every round joins each node's topmost known ancestor with that
ancestor's own link, so a tree of depth d needs about log2(d) joins instead of d.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def descend(
    nodes: DataFrame,
    root: Column | None = None,
    excluded: Column | None = None,
    sep: str = " >> ",
) -> DataFrame:
    """Every node below the roots, with ``root_id``, ``chain`` (names from the root) and ``depth``.

    ``nodes`` has ``id``, ``parent_id`` and ``term``. ``root`` tells which nodes are roots (default: no
    parent). An excluded node is dropped with everything below it, as are nodes on a cycle and
    nodes below no root.
    """
    is_root = root if root is not None else F.col("parent_id").isNull()
    out_of = excluded if excluded is not None else F.lit(False)
    base = nodes.where(is_root | ~F.coalesce(out_of, F.lit(False)))
    links = base.select(
        "id",
        F.when(~F.coalesce(is_root, F.lit(False)), F.col("parent_id")).alias("up"),
        F.col("term").alias("chain"),
        F.lit(0).alias("depth"),
        F.coalesce(is_root, F.lit(False)).alias("done"),
    )
    # A node whose parent is missing or excluded has an ``up`` that never resolves.
    links = links.where(F.col("done") | F.col("up").isNotNull())
    # ``top`` is the highest node reached; ``up`` is that node's parent.
    links = settle(links.withColumn("top", F.col("id")))
    # No path has more steps than there are nodes; what is open beyond that is on a cycle, or below one.
    total, span = links.count(), 1
    while span <= total:
        open_ = links.where(~F.col("done"))
        if open_.isEmpty():
            break
        hop = links.select(
            F.col("id").alias("up"),
            F.col("top").alias("_top"),
            F.col("up").alias("_up"),
            F.col("chain").alias("_chain"),
            F.col("depth").alias("_depth"),
            F.col("done").alias("_done"),
        )
        moved = open_.join(hop, "up").select(
            "id",
            F.col("_up").alias("up"),
            F.concat("_chain", F.lit(sep), "chain").alias("chain"),
            (F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.col("_done").alias("done"),
            F.col("_top").alias("top"),
        )
        on_cycle = ~F.col("done") & ((F.col("top") == F.col("id")) | F.col("up").eqNullSafe(F.col("id")))
        links = settle(links.where(F.col("done")).unionByName(moved.where(~on_cycle)))
        span *= 2
    reached = links.where(F.col("done")).select("id", F.col("top").alias("root_id"), "chain", "depth")
    return nodes.join(reached, "id")


def ancestors(nodes: DataFrame) -> DataFrame:
    """All (``id``, ``ancestor_id``, ``distance``) pairs, a node being its own ancestor at 0.

    The result has one row per node and level. Pairs at distance up to 2^k - 1 are known after k rounds.
    A node that comes out as its own ancestor is on a cycle: ``ValueError``.
    """
    self_pairs = nodes.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance"))
    steps = nodes.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("ancestor_id"))
    steps = settle(steps.join(nodes.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi"))
    pairs = settle(self_pairs)
    span = 1
    while not steps.isEmpty():
        # steps: exactly ``span`` levels up; pairs: all distances below ``span``.
        further = pairs.join(steps.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("_far")), "ancestor_id").select(
            "id", F.col("_far").alias("ancestor_id"), (F.col("distance") + span).alias("distance")
        )
        pairs = settle(pairs.unionByName(further))
        loop = pairs.where((F.col("distance") > 0) & (F.col("id") == F.col("ancestor_id"))).first()
        if loop:
            raise ValueError(f"{loop['id']} is its own ancestor, {loop['distance']} levels up")
        steps = settle(
            steps.join(steps.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("_far")), "ancestor_id").select(
                "id", F.col("_far").alias("ancestor_id")
            )
        )
        span *= 2
    return pairs


def ancestors_of(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``id``, ``ancestor_id``, ``distance``) pairs of the wanted ids only, each its own ancestor at 0.

    A walk up from the wanted ids, level by level: a round joins the ids of the level before with their own
    links, so that what is written is bounded by wanted ids times depth, whatever the size of the tree. Wanted ids
    that are no nodes have no pairs; an id that comes up twice on one path is on a cycle: ``ValueError``.
    """
    links = nodes.select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("_up"))
    level = wanted.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    level = settle(level.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        known = links.join(level.select("ancestor_id").distinct(), "ancestor_id", "left_semi").where(F.col("_up").isNotNull())
        higher = level.join(known, "ancestor_id").select("id", F.col("_up").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))
        level = settle(higher.join(nodes.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi").select("id", "ancestor_id", "distance"))
        if len(levels) & (len(levels) - 1) == 0:  # at 1, 2, 4, .. levels
            again = level.join(reduce(DataFrame.unionByName, levels).select("id", "ancestor_id"), ["id", "ancestor_id"], "left_semi").first()
            if again:
                raise ValueError(f"{again['ancestor_id']} is its own ancestor")
    return reduce(DataFrame.unionByName, levels) if levels else level


def paths(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Path array of each node, or of the ``wanted`` ids, from the topmost ancestor down to itself: ``id``, ``path``.

    A path is as long as the tree is deep, whatever the number of nodes. For all nodes the whole tree is
    closed; for wanted ids only what is above them is read.
    """
    pairs = ancestors(nodes) if wanted is None else ancestors_of(wanted, nodes)
    found = pairs.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("distance", "ancestor_id")), asc=False).alias("_p")
    )
    return found.select("id", F.transform("_p", lambda p: p["ancestor_id"]).alias("path"))
