"""Spatial joins as equi-joins on grid cells, followed by an exact test.

A bare geometry predicate would be planned as a nested loop. Here every geometry is listed under
the square cells its bounding box meets and the join key is the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo_arrow import overlap_area
from ..functions.text import col
from . import cells
from .cells import LEAST_SIDE, candidates
from .joins import replicated, salted



def shapes(df: DataFrame, wkt: str = "boundary_geom", id_col: str = "id") -> DataFrame:
    """``region_id``, ``edges`` (a polygon's inside on their left) and ``box`` of each geometry."""
    geom = geo.parts(wkt)
    return df.select(F.col(id_col).alias("region_id"), geo.directed_edges(geom).alias("edges"), geo.bounds(geom).alias("box"))


def side_of(box: str = "box", size: float | None = None) -> Column:
    """Side of the cells a box is listed under: the power of two next above its longer side, or ``size``.

    So a box meets four cells or little more, however wide other boxes are.
    """
    if size:
        return F.lit(float(size))
    b = F.col(box)
    longer = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    fitting = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(longer, F.lit(LEAST_SIDE)))))
    return F.greatest(fitting, F.lit(LEAST_SIDE))


def cell(c: Column | str, side: Column | float) -> Column:
    return F.floor(col(c) / (side if isinstance(side, Column) else F.lit(float(side)))).cast("long")


def covered(df: DataFrame, side: Column | float, box: str = "box") -> DataFrame:
    """One row per cell (``cx``, ``cy``) that a box meets."""

    def steps(axis):
        return F.sequence(cell(F.col(f"{box}.{axis}min"), side), cell(F.col(f"{box}.{axis}max"), side))

    return df.withColumn("cx", F.explode(steps("x"))).withColumn("cy", F.explode(steps("y")))


def tag_points(
    points: DataFrame,
    regions: DataFrame,
    x: str = "x",
    y: str = "y",
    boundary: bool = True,
    size: float | None = None,
    keep_outside: bool = False,
    portion: int | None = None,
) -> DataFrame:
    """Points with the ``region_id`` of every region they lie in (:func:`shapes` gives ``regions``).

    ``region_id`` names one region each. ``keep_outside`` keeps points of no region too: every point then
    also has a row with a null id. Outlines are cut into cells (``cells.region_cells``): a point meets the edges of
    its own cell, and crowded cells are spread by their counts, ``portion`` points to a task. Pass distinct
    positions, not records, where many records share one.
    """
    found = cells.tag(points, regions, x, y, boundary, size, portion)
    if keep_outside:
        found = found.unionByName(points, allowMissingColumns=True)
    return found


def within(points: DataFrame, centres: DataFrame, distance: float, copies: int = 4) -> DataFrame:
    """Pairs no further apart than ``distance``; ``centres`` has ``cx0``, ``cy0`` and its own columns.

    Cells are as wide as the distance, so a centre needs its own and the eight cells around it.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    near = (
        centres.withColumn("_dx", F.explode(around))
        .withColumn("_dy", F.explode(around))
        .withColumn("cx", cell("cx0", distance) + F.col("_dx"))
        .withColumn("cy", cell("cy0", distance) + F.col("_dy"))
        .drop("_dx", "_dy")
    )
    placed = salted(points.withColumn("cx", cell("x", distance)).withColumn("cy", cell("y", distance)), ["x", "y"], copies)
    pairs = placed.join(replicated(near, copies), ["cx", "cy", "_salt"])
    away = geo.distance("x", "y", "cx0", "cy0")
    return pairs.withColumn("distance", away).where(F.col("distance") <= distance).drop("cx", "cy", "_salt")


def meeting_boxes(left: DataFrame, right: DataFrame, size: float | None = None, touching: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose boxes (``box_l``, ``box_r``) meet, each pair once; ``by`` names columns that must be equal too.

    A pair meets at the level of its larger box: every box is listed at its own level and at the wider
    levels of the other side. Own cells on the left meet all cells on the right (turn 0), and the left's
    wider cells meet own cells on the right (turn 1), so that small boxes do not meet each other in the cells
    of a wide one. A pair is kept only in the cell of the lower left corner of the two boxes' overlap, so
    no duplicate removal is needed.
    """
    sides = [df.agg(F.collect_set(side_of(box, size))).scalar() for df, box in ((left, "box_l"), (right, "box_r"))]

    def listed(df, box, others, turn, wider):
        own = side_of(box, size)
        at = lambda side, k: F.struct(side.alias("side"), F.lit(k).alias("turn"))
        more = F.transform(F.filter("_sides", lambda v: wider(v, own)), lambda v: at(v, 1 - turn))
        out = df.withColumn("_sides", others).withColumn("_at", F.explode(F.concat(F.array(at(own, turn)), more)))
        return covered(out.withColumn("_side", F.col("_at.side")).withColumn("_turn", F.col("_at.turn")).drop("_sides", "_at"), F.col("_side"), box)

    a = listed(left, "box_l", sides[1], 0, lambda v, own: v > own)
    b = listed(right, "box_r", sides[0], 1, lambda v, own: v >= own)
    pairs = a.join(b, [*by, "_side", "_turn", "cx", "cy"])
    first_x = cell(F.greatest(F.col("box_l.xmin"), F.col("box_r.xmin")), F.col("_side"))
    first_y = cell(F.greatest(F.col("box_l.ymin"), F.col("box_r.ymin")), F.col("_side"))
    own_cell = (F.col("cx") == first_x) & (F.col("cy") == first_y)
    return pairs.where(own_cell & geo.boxes_meet(F.col("box_l"), F.col("box_r"), touching)).drop("_side", "_turn", "cx", "cy")


def overlapping(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """Polygon pairs that share some interior ("intersects and not touches"), with ``shared_area``.

    ``left`` and ``right`` carry ``geom_l`` / ``geom_r`` (``parts``) next to their own columns; the
    result has the areas ``area_l`` and ``area_r`` in their place. The shared area is worked out in Arrow
    batches, for pairs whose boxes meet only. Less than a billionth of the smaller shape is contact.
    """

    def side(df, s):
        geom = f"geom_{s}"
        out = df.withColumn(f"box_{s}", geo.bounds(geom)).withColumn(f"area_{s}", geo.area(geom))
        return out.withColumn(f"edges_{s}", geo.turned_edges(geom)).drop(geom)

    left, right = side(left, "l"), side(right, "r")
    pairs = meeting_boxes(left, right, size).withColumn("shared_area", overlap_area("edges_l", "edges_r"))
    least = F.least("area_l", "area_r") * 1e-9
    return pairs.where(F.col("shared_area") > least).drop("edges_l", "edges_r", "box_l", "box_r")


def grid_of(regions: DataFrame, size: int, box: str = "box") -> DataFrame:
    """Squares of ``size`` that a region's box meets or touches: ``west``, ``south``.

    Squares outside the common extent of all regions are left out, so a square that only touches a
    region from outside counts where the grid has it for another region.
    """
    b = F.col(box)

    def low(v):
        return F.floor(v / size) * size

    def high(v):
        return F.ceil(v / size) * size - size

    extent = regions.agg(
        F.struct(
            *[low(F.min(b[f"{a}min"])).cast("long").alias(f"{a}0") for a in "xy"],
            *[high(F.max(b[f"{a}max"])).cast("long").alias(f"{a}1") for a in "xy"],
        )
    ).scalar()

    def steps(axis):
        first = F.greatest(high(b[f"{axis}min"]).cast("long"), extent[f"{axis}0"])
        last = F.least(low(b[f"{axis}max"]).cast("long"), extent[f"{axis}1"])
        return F.sequence(first, F.greatest(first, last), F.lit(size).cast("long"))

    # The subquery is read into columns first: a generator may not hold one.
    spans = regions.withColumn("_xs", steps("x")).withColumn("_ys", steps("y"))
    return spans.withColumn("west", F.explode("_xs")).withColumn("south", F.explode("_ys")).drop("_xs", "_ys")


def collect_geom(df: DataFrame, key: str, wkt: str, id_col: str, size: int = 10000) -> DataFrame:
    """Child lines of a parent as MULTILINESTRINGs, ``size`` lines in the order of their ids to a page."""
    from .aggregate import paged

    bodies = paged(df.select(key, id_col, F.regexp_extract(wkt, r"(\(.*\))", 1).alias("_body")), [key], id_col, size)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("_body").alias("b"))))
    text = F.array_join(F.transform(ordered, lambda p: p["b"]), ",")
    return bodies.groupBy(key, "page").agg(F.concat(F.lit("MULTILINESTRING("), text, F.lit(")")).alias("geom"))
