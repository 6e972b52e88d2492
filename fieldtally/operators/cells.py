"""Regions cut into square cells, so that a test needs the edges of one cell only.

A region has its own grid: cells as wide as its box, or finer where it has many edges. A cell holds the edges
that run through it and whether its lower left corner lies in the region; cells without an edge are
inside as a whole, or left out. Points, and the pieces of lines in a cell, are then decided by the cell alone: the
corner's state changes with every edge between the corner and the point. Outlines are never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo_arrow import PIECE, pieces_in_cells

#: The smallest width of a region's grid.
LEAST_SIDE = 2.0**-20
#: Edges for which a region is one cell wide; the grid is finer by a power of two for more, up to FINEST cells.
EDGES, FINEST = 64, 64
#: Points of one cell that one task is meant to take, and the most cells that are spread for having more.
PORTION, HOT = 100_000, 1_000
_EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def grid_side(edges: str = "edges", box: str = "box", size: float | None = None) -> Column:
    """Width of a region's cells: a power of two, or ``size``."""
    if size:
        return F.lit(float(size))
    b = F.col(box)
    longer = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"], F.lit(LEAST_SIDE))
    finer = F.least(F.lit(float(FINEST)), F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(edges) / EDGES)))))
    return F.pow(F.lit(2.0), F.ceil(F.log2(longer))) / F.coalesce(finer, F.lit(1.0))


def _index(value: Column, side: Column) -> Column:
    return F.floor(value / side).cast("long")


def _each(first: Column, last: Column) -> Column:
    """The whole numbers from first to last, none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _edge_cells(one: DataFrame, closed: bool = False) -> DataFrame:
    """(region_id, cx, cy, e) of every cell an edge runs through; ``closed`` adds cells it only touches.

    Cells are listed column by column; a hair is added so that rounding loses none.
    """
    s, e = F.col("side"), F.col("e")
    low_x, high_x, low_y, high_y = (f(e[f"{a}1"], e[f"{a}2"]) for a in "xy" for f in (F.least, F.greatest))
    first = (lambda v: F.ceil(v / s).cast("long") - 1) if closed else (lambda v: _index(v, s))
    strips = one.select("region_id", "side", "e", F.explode(F.sequence(first(low_x), _index(high_x, s))).alias("cx"))
    at = lambda x: e["y1"] + (x - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
    begin, end = at(F.least(high_x, F.greatest(low_x, F.col("cx") * s))), at(F.greatest(low_x, F.least(high_x, (F.col("cx") + 1) * s)))
    upright = e["x1"] == e["x2"]
    bottom = F.when(upright, low_y).otherwise(F.greatest(low_y, F.least(begin, end) - s * 1e-9))
    top = F.when(upright, high_y).otherwise(F.least(high_y, F.greatest(begin, end) + s * 1e-9))
    return strips.select("region_id", "side", "cx", F.explode(F.sequence(first(bottom), _index(F.greatest(bottom, top), s))).alias("cy"), "e")


def _corner_turns(one: DataFrame) -> DataFrame:
    """(region_id, cy, ks): an edge that crosses the lower border of a row changes the state of all its corners from the k-th on."""
    s, e = F.col("side"), F.col("e")
    low_y, high_y = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    rows = one.where(e["y1"] != e["y2"]).select("region_id", "side", "e", F.explode(_each(F.ceil(low_y / s).cast("long"), F.ceil(high_y / s).cast("long") - 1)).alias("cy"))
    y0 = F.col("cy") * s
    cross = e["x1"] + (y0 - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    near = F.rint(cross / s)
    right = (near * s - e["x1"]) * (e["y2"] - e["y1"]) - (e["x2"] - e["x1"]) * (y0 - e["y1"])
    right = F.when(e["y2"] > e["y1"], right >= 0).otherwise(right <= 0)
    first = F.when(F.abs(cross - near * s) < s * 1e-6, F.when(right, near).otherwise(near + 1)).otherwise(F.ceil(cross / s)).cast("long")
    odd = rows.groupBy("region_id", "cy", first.alias("k")).agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    return odd.groupBy("region_id", "cy").agg(F.collect_list("k").alias("ks"))


def _corner_inside() -> Column:
    return F.coalesce(F.size(F.filter("ks", lambda k: k <= F.col("cx"))) % 2 == 1, F.lit(False))


def region_cells(regions: DataFrame, size: float | None = None) -> DataFrame:
    """(region_id, side, cx, cy, inside, local) from (region_id, edges, box): the cells that meet a region.

    ``inside`` is the state of the lower left corner, ``local`` the edges that run through the cell (null: none, the
    cell lies inside). Edges of one region are closed rings (even-odd rule); without ``size`` a region has at most
    (FINEST + 1) squared cells.
    """
    sized = regions.select("region_id", "box", grid_side(size=size).alias("side"), "edges")
    one = sized.select("region_id", "side", F.explode("edges").alias("e"))
    local = _edge_cells(one).groupBy("region_id", "cx", "cy").agg(F.collect_list("e").alias("local"))
    s, b = F.col("side"), F.col("box")
    frame = sized.select("region_id", "side", "box", F.explode(F.sequence(_index(b["ymin"], s), _index(b["ymax"], s))).alias("cy"))
    frame = frame.join(_corner_turns(one), ["region_id", "cy"], "left")
    frame = frame.select("region_id", "side", "cy", "ks", F.explode(F.sequence(_index(b["xmin"], s), _index(b["xmax"], s))).alias("cx"))
    cells = frame.select("region_id", "side", "cx", "cy", _corner_inside().alias("inside")).join(local, ["region_id", "cx", "cy"], "left")
    return cells.where(F.col("inside") | F.col("local").isNotNull()).select("region_id", "side", "cx", "cy", "inside", "local")


def squares(regions: DataFrame, size: int) -> DataFrame:
    """(region_id, west, south, partial) of the squares of ``size`` that a region meets or touches.

    The squares of a region's box are listed with its id alone; edges are listed under the squares they touch, and
    an edge through a square's inside makes it partial. A square that no edge runs through has the state of its
    corner, taken a hair inside. See ``spatial.grid_of`` for the extent.
    """
    from .spatial import grid_of

    one = regions.select("region_id", F.lit(float(size)).alias("side"), F.explode("edges").alias("e"))
    listed = _edge_cells(one, closed=True)
    west, south = F.col("cx") * size, F.col("cy") * size
    e = F.col("e")
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

    def limits(a, d, low):
        first, last = (low - a) / F.nullif(d, F.lit(0.0)), (low + size - a) / F.nullif(d, F.lit(0.0))
        apart = (d == 0) & ((low > a) | (low + size < a))
        return F.when(apart, 2.0).when(d == 0, 0.0).otherwise(F.least(first, last)), F.when(apart, -1.0).when(d == 0, 1.0).otherwise(F.greatest(first, last))

    x0, x1 = limits(e["x1"], dx, west)
    y0, y1 = limits(e["y1"], dy, south)
    begin, end = F.greatest(F.lit(0.0), x0, y0), F.least(F.lit(1.0), x1, y1)
    # The middle of the stretch in the square is off its border, if the edge runs through its inside.
    mx, my = e["x1"] + dx * (begin + end) / 2, e["y1"] + dy * (begin + end) / 2
    through = (begin < end) & (mx > west) & (mx < west + size) & (my > south) & (my < south + size)
    met = listed.withColumn("touched", begin <= end).withColumn("through", through).where("touched")
    met = met.groupBy("region_id", "cx", "cy").agg(F.max("through").alias("through"))
    frame = grid_of(regions.select("region_id", "box"), size).select("region_id", "west", "south", F.floor(F.col("west") / size).cast("long").alias("cx"), F.floor(F.col("south") / size).cast("long").alias("cy"))
    out = frame.join(_corner_turns(one), ["region_id", "cy"], "left").withColumn("inside", _corner_inside()).join(met, ["region_id", "cx", "cy"], "left")
    return out.where(F.col("inside") | F.col("through").isNotNull()).select("region_id", "west", "south", (~F.col("inside") | F.coalesce("through", F.lit(False))).alias("partial"))


def _odd_crossings(x: Column, y: Column, x0: Column, y0: Column, local: Column) -> Column:
    """Whether an odd number of edges lies between the corner (x0, y0) and the point, up the border and then across.

    Both are taken a hair to the upper right, so that edges through them have a side.
    """

    def changes(e):
        def turn(px, py):
            return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])

        def left_of(px):
            t = turn(px, y)
            return F.when(((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y2"] > e["y1"], t <= 0).otherwise(t >= 0), 1).otherwise(0)

        def below(py):
            t = turn(x0, py)
            level = (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]) <= 0
            under = F.when(t == 0, level).when(e["x2"] > e["x1"], t > 0).otherwise(t < 0)
            return F.when(((e["x1"] > x0) != (e["x2"] > x0)) & under, 1).otherwise(0)

        return left_of(x) + left_of(x0) + below(y) + below(y0)

    return F.aggregate(local, F.lit(0), lambda acc, e: acc + changes(e)) % 2 == 1


def in_cell(x: Column, y: Column, boundary: bool = True) -> Column:
    """Whether a point lies in the region of its cell (columns side, cx, cy, inside, local)."""
    side = F.col("side")
    inside = F.col("inside") != _odd_crossings(x, y, F.col("cx") * side, F.col("cy") * side, F.col("local"))
    edge = geo.on_boundary(x, y, "local")
    exact = (edge | inside) if boundary else (~edge & inside)
    return F.when(F.col("local").isNull(), F.col("inside")).otherwise(exact)


def spread(big: DataFrame, small: DataFrame, keys: list[str], by: list[str], portion: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: keys with over ``portion`` rows of ``big`` are dealt over as many salts as they need.

    Rows are counted; of the crowded keys the HOT most crowded are spread, a table of bounded size.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (portion or PORTION))
    hot = counts.orderBy(F.col("_n").desc(), *keys).limit(HOT).select(*keys, F.ceil(F.col("_n") / (portion or PORTION)).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), copies).cast("int")).drop("_copies")
    several = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt, several


def candidates(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y", size: float | None = None, portion: int | None = None) -> DataFrame:
    """Points with every region that has a cell in common with them: region_id, and the cell's columns.

    A point has one cell in each width of grid in use, so each pair is found once; an equi-join on the cell
    brings the few edges that decide it. Crowded cells are spread by their counts (see :func:`spread`).
    """
    # The subquery is read into a column first: a generator may not hold one.
    levels = points.withColumn("_sides", regions.agg(F.collect_set(grid_side(size=size))).scalar())
    levels = levels.withColumn("side", F.explode("_sides")).drop("_sides")
    placed = levels.withColumn("cx", _index(F.col(x), F.col("side"))).withColumn("cy", _index(F.col(y), F.col("side")))
    keys = ["side", "cx", "cy"]
    placed, cells = spread(placed, region_cells(regions, size), keys, [x, y], portion)
    return placed.join(cells, [*keys, "_salt"]).drop("_salt")


def tag(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y", boundary: bool = True, size: float | None = None, portion: int | None = None) -> DataFrame:
    """Points next to the ``region_id`` of every region they lie in."""
    found = candidates(points, regions, x, y, size, portion)
    return found.where(in_cell(F.col(x), F.col(y), boundary)).drop("side", "cx", "cy", "inside", "local")


# ---- lines in regions ----------------------------------------------------------------


def segments(df: DataFrame, id: str, edges: str = "edges") -> DataFrame:
    """(shape_id, seg, ax, ay, bx, by): one row per edge, numbered within its shape."""
    e = F.col("_e")
    out = df.select(F.col(id).alias("shape_id"), F.posexplode(edges).alias("seg", "_e"))
    return out.select("shape_id", "seg", e["x1"].alias("ax"), e["y1"].alias("ay"), e["x2"].alias("bx"), e["y2"].alias("by"))


def segment_box() -> Column:
    a, b = ("ax", "ay"), ("bx", "by")
    ends = [f(F.col(p), F.col(q)).alias(n) for f, names in ((F.least, ("xmin", "ymin")), (F.greatest, ("xmax", "ymax"))) for p, q, n in zip(a, b, names)]
    return F.struct(*ends)


def clip(lines: DataFrame, regions: DataFrame, pairs: DataFrame | None = None, by: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """The pieces of segments in or on regions: the segments' columns, region_id, ta, tb, where.

    ``lines``: shape_id, seg, ax, ay, bx, by (see :func:`segments`) and more. ``where``: ``in`` (inside), ``along`` and
    ``against`` (on the outline, its way or the other, so that the region lies to the left or right), ``at`` (a
    point of contact, ta = tb). ``ta`` and ``tb`` are shares of the segment. Pieces end at the borders of cells.
    ``pairs`` (shape_id, region_id) leaves only those pairs; ``by`` names columns that both sides must have in common;
    ``apart`` leaves out a shape's own region.
    """
    from .spatial import meeting_boxes

    sized = regions.select("region_id", "box", *by, grid_side().alias("side"))
    left = lines.withColumn("box_l", segment_box())
    met = meeting_boxes(left, sized.withColumnRenamed("box", "box_r"), touching=True, by=by)
    if apart:
        met = met.where("shape_id <> region_id")
    if pairs is not None:
        met = met.join(pairs.select("shape_id", "region_id"), ["shape_id", "region_id"], "left_semi")
    s, b = F.col("side"), F.col("box_r")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def limits(a, d, low, high):
        first, last = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        return F.when(d == 0, F.lit(0.0)).otherwise(F.least(first, last)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(first, last))

    x0, x1 = limits(F.col("ax"), dx, b["xmin"], b["xmax"])
    y0, y1 = limits(F.col("ay"), dy, b["ymin"], b["ymax"])
    spans = met.withColumn("_t0", F.greatest(F.lit(0.0), x0, y0)).withColumn("_t1", F.least(F.lit(1.0), x1, y1))
    # Rounding may part ends that meet the box in one point.
    spans = spans.where("_t0 <= _t1 + 1e-12").withColumn("_t1", F.greatest("_t0", "_t1"))

    def crossings(a, d):
        begin, end = a + d * F.col("_t0"), a + d * F.col("_t1")
        lines_between = _each(F.ceil(F.least(begin, end) / s).cast("long"), F.floor(F.greatest(begin, end) / s).cast("long"))
        return F.when(d == 0, F.array().cast("array<double>")).otherwise(F.transform(lines_between, lambda k: F.least(F.col("_t1"), F.greatest(F.col("_t0"), (k * s - a) / d))))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array("_t0", "_t1"), crossings(F.col("ax"), dx), crossings(F.col("ay"), dy))))
    cut = spans.withColumn("_cuts", cuts)
    span = lambda a, c: F.struct(a.alias("ta"), c.alias("tb"))
    between = F.zip_with(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), F.slice("_cuts", F.lit(2), F.size("_cuts") - 1), span)
    points = F.transform("_cuts", lambda t: span(t, t))
    some = cut.withColumn("_p", F.explode(F.concat(points, F.when(F.size("_cuts") > 1, between).otherwise(F.array().cast("array<struct<ta:double,tb:double>>")))))
    some = some.withColumn("ta", F.col("_p.ta")).withColumn("tb", F.col("_p.tb")).drop("_p", "_cuts", "_t0", "_t1", "box_l", "box_r")
    middle = (F.col("ta") + F.col("tb")) / 2
    # A point on a border, up to rounding, belongs to the cell that begins there, as the edges do.
    nudge = F.when(F.col("ta") == F.col("tb"), F.lit(1e-9)).otherwise(0.0)
    some = some.withColumn("cx", F.floor((F.col("ax") + dx * middle) / s + nudge).cast("long")).withColumn("cy", F.floor((F.col("ay") + dy * middle) / s + nudge).cast("long"))
    found = some.join(region_cells(regions).drop("side"), ["region_id", "cx", "cy"])
    # Inside as a whole: no edge to look at.
    whole = F.array(F.struct(F.col("ta").alias("ta"), F.col("tb").alias("tb"), F.lit("in").alias("where")))
    measured = pieces_in_cells(*[F.col(c).cast("double") for c in ("ax", "ay", "bx", "by", "ta", "tb")], F.col("cx") * s, F.col("cy") * s, s, "inside", "local")
    none = F.array().cast(PIECE)
    plain = found.where("local is null").withColumn("_q", F.when(F.col("ta") < F.col("tb"), whole.cast(PIECE)).otherwise(none))
    mixed = found.where("local is not null").withColumn("_q", measured)
    keep = [c for c in lines.columns] + ["region_id"]
    out = plain.unionByName(mixed).select(*keep, F.explode("_q").alias("_q"))
    return out.select(*keep, F.col("_q.ta").alias("ta"), F.col("_q.tb").alias("tb"), F.col("_q.where").alias("where"))


def lines_in_regions(lines: DataFrame, regions: DataFrame, id: str = "shape_id") -> DataFrame:
    """(id, region_id, inside, touches, length_inside) of every line and region that share a point.

    ``lines``: id, edges. ``inside``: some stretch lies in the region's interior (intersects and does not touch);
    ``touches``: contact with the outline only. ``length_inside`` leaves out what runs along the outline.
    """
    found = clip(segments(lines, id), regions)
    stretch = (F.col("tb") - F.col("ta")) * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    out = found.groupBy("shape_id", "region_id").agg(
        F.max(F.col("where") == "in").alias("inside"), F.sum(F.when(F.col("where") == "in", stretch).otherwise(0.0)).alias("length_inside")
    )
    return out.select(F.col("shape_id").alias(id), "region_id", "inside", (~F.col("inside")).alias("touches"), "length_inside")


def _renamed(df: DataFrame) -> DataFrame:
    """The same pairs from the other side."""
    swapped = {"shape_id": "region_id", "region_id": "shape_id"}
    return df.select(*[F.col(swapped.get(c, c)).alias(c) for c in df.columns])


def polygon_pieces(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pieces of either outline in or on the other polygon, with ``own`` (true: of the left outline).

    ``left``: shape_id, edges, box; ``right``: region_id, edges, box; edges as in ``geo.directed_edges``.
    """
    mine = clip(segments(left, "shape_id"), right, pairs).withColumn("own", F.lit(True))
    as_regions = left.withColumnRenamed("shape_id", "region_id")
    theirs = clip(segments(right, "region_id"), as_regions, None if pairs is None else _renamed(pairs))
    return mine.unionByName(_renamed(theirs).withColumn("own", F.lit(False)))


def polygons_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(shape_id, region_id, inside, touches) of every two polygons that share a point; ``inside``: some interior.

    Outlines that run the same way along each other have interior on the same side.
    """
    shared = F.col("where") == "in"
    out = polygon_pieces(left, right).groupBy("shape_id", "region_id").agg(F.max(shared | (F.col("where") == "along")).alias("inside"))
    return out.withColumn("touches", ~F.col("inside"))


def shared_area(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(shape_id, region_id, shared_area) of polygons that share some interior.

    The outline of the shared part consists of each outline's pieces inside the other and of those both have
    in common; half the sum of their cross products is its area. Every piece is found in its own cell.
    """
    boxes = left.select("shape_id", F.col("box.xmin").alias("_ox"), F.col("box.ymin").alias("_oy"))
    found = polygon_pieces(left, right, pairs).where((F.col("where") == "in") | ((F.col("where") == "along") & F.col("own")))
    found = found.join(boxes, "shape_id")
    at = lambda axis, t: F.col(f"a{axis}") - F.col(f"_o{axis}") + (F.col(f"b{axis}") - F.col(f"a{axis}")) * F.col(t)
    cross = at("x", "ta") * at("y", "tb") - at("x", "tb") * at("y", "ta")
    return found.groupBy("shape_id", "region_id").agg((F.sum(cross) / 2).alias("shared_area"))
