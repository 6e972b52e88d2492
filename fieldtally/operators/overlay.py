"""Unions of the geometries of a group, and distances from lines and polygons.

A union is worked out edge by edge: what lies inside another polygon of the group goes, what runs along another's
outline stays once, what runs against one goes on both sides. The pieces that are left are the outline; only they
come together, group by group, to be strung into rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo_arrow import PARTS, strung
from ..session import shuffle_tasks
from . import cells
from .spatial import meeting_boxes

_SPANS = "array<struct<ta:double,tb:double>>"
#: Share of an edge below which a gap is rounding.
_HAIR = 1e-9


def _firsts(rows: DataFrame, alike: list[Column], of: list[str]) -> DataFrame:
    """The rows of the smallest ``of`` (then the other columns) among those ``alike``; a row that is there several times stays so.

    Of parts that lie on each other as a whole only the first is left in a union and covers what the others cover,
    so that copies need not meet each other.
    """
    rest = [c for c in rows.columns if c not in of]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    named = {f"_like{i}": c for i, c in enumerate(alike)}
    first = counted.withColumns(named).groupBy(*named).agg(F.min(F.struct(*of, *rest, "_n")).alias("_f"))
    return first.select(*[F.col(f"_f.{c}").alias(c) for c in rows.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("_f._n"))).alias("_n")).drop("_n")


def _left_over(removed: Column) -> Column:
    """The spans of 0..1 that none of ``removed`` covers."""
    begin = F.struct(F.lit(0.0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, r):
        gap = F.when(r["ta"] > acc["at"] + _HAIR, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("ta"), r["ta"].alias("tb"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], r["tb"]).alias("at"), gap.alias("out"))

    rest = lambda acc: F.when(acc["at"] < 1 - _HAIR, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("ta"), F.lit(1.0).alias("tb"))))).otherwise(acc["out"])
    return F.aggregate(F.array_sort(removed), begin, step, rest)


def _kept(segments: DataFrame, removed: DataFrame, group: str) -> DataFrame:
    """(group, shape_id, seg, ta, sx, sy, ex, ey): what is left of each segment without its removed spans."""
    gone = removed.groupBy("shape_id", "seg").agg(F.collect_list(F.struct("ta", "tb")).alias("_gone"))
    left = segments.join(gone, ["shape_id", "seg"], "left").withColumn("_s", F.explode(_left_over(F.coalesce("_gone", F.array().cast(_SPANS)))))
    at = lambda axis, t: F.col(f"a{axis}") + (F.col(f"b{axis}") - F.col(f"a{axis}")) * F.col(f"_s.{t}")
    return left.select(group, "shape_id", "seg", F.col("_s.ta").alias("ta"), at("x", "ta").alias("sx"), at("y", "ta").alias("sy"), at("x", "tb").alias("ex"), at("y", "tb").alias("ey"))


def _strung(pieces: DataFrame, group: str, closed: bool) -> DataFrame:
    """(group, geom): the pieces of each group strung into rings (with holes after their shells) or lines."""

    def build(key, table):
        import pyarrow as pa

        made = strung(*[table.column(c).to_numpy() for c in ("shape_id", "seg", "ta", "sx", "sy", "ex", "ey")], closed)
        return pa.table({group: pa.array([key[0].as_py()], table.schema.field(group).type), "geom": pa.array([made], geom_type)})

    from pyspark.sql.pandas.types import to_arrow_type

    geom_type = to_arrow_type(PARTS)
    kind = pieces.schema[group].dataType.simpleString()
    return pieces.groupBy(group).applyInArrow(build, f"{group} {kind}, geom {PARTS.simpleString()}")


def union_polygons(shapes: DataFrame, group: str) -> DataFrame:
    """(group, geom, kind, area): the union of each group's polygons; the sides of touching ones vanish.

    ``shapes``: shape_id (unique), group, geom (``parts``). Groups of null are left out, as are shapes that are no
    polygons. Equal polygons of a group are compared as one; of the others only those that meet, cell by cell.
    """
    plain = shapes.where(F.col(group).isNotNull() & F.col("geom")[0]["shell"].isNotNull())
    known = plain.select("shape_id", group, geo.directed_edges("geom").alias("edges"), geo.bounds("geom").alias("box"))
    known = _firsts(known, [F.col(group), F.array_sort("edges")], ["shape_id"])
    e = F.col("_e")
    segs = known.select("shape_id", group, F.posexplode("edges").alias("seg", "_e")).select("shape_id", group, "seg", e["x1"].alias("ax"), e["y1"].alias("ay"), e["x2"].alias("bx"), e["y2"].alias("by"))
    # Few rows with much work each.
    segs = segs.repartition(shuffle_tasks(segs), "shape_id", "seg")
    found = cells.clip(segs, known.withColumnRenamed("shape_id", "region_id"), by=(group,), apart=True)
    # Of outlines that run along each other the first shape's stays.
    gone = found.where((F.col("where") == "in") | (F.col("where") == "against") | ((F.col("where") == "along") & (F.col("region_id") < F.col("shape_id"))))
    out = _strung(_kept(segs, gone.select("shape_id", "seg", "ta", "tb"), group), group, True)
    kind = F.when(F.size(F.filter("geom", lambda p: p["shell"])) > 1, "MULTIPOLYGON").otherwise("POLYGON")
    return out.select(group, "geom", kind.alias("kind"), geo.area("geom").alias("area"))


def union_lines(shapes: DataFrame, group: str) -> DataFrame:
    """(group, geom, kind, length): the lines of each group, stretches that several share once.

    ``shapes``: shape_id (unique), group, geom (``parts``). Where stretches lie on each other, that of the first shape
    (then of its first segment) stays.
    """
    plain = shapes.where(F.col(group).isNotNull()).select("shape_id", group, geo.edges("geom").alias("edges"))
    e = F.col("_e")
    segs = plain.select("shape_id", group, F.posexplode("edges").alias("seg", "_e")).select("shape_id", group, "seg", e["x1"].alias("ax"), e["y1"].alias("ay"), e["x2"].alias("bx"), e["y2"].alias("by"))
    begin, end = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    # The grouping also tells Spark how many segments there are: from the size of the files alone it may send all of them through the driver.
    segs = _firsts(segs.where("ax <> bx or ay <> by"), [F.col(group), F.least(begin, end), F.greatest(begin, end)], ["shape_id", "seg"])
    other = segs.select(group, *[F.col(c).alias(f"o_{c}") for c in ("shape_id", "seg", "ax", "ay", "bx", "by")])
    o = {c: F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")}
    box_r = F.struct(F.least(o["ax"], o["bx"]).alias("xmin"), F.least(o["ay"], o["by"]).alias("ymin"), F.greatest(o["ax"], o["bx"]).alias("xmax"), F.greatest(o["ay"], o["by"]).alias("ymax"))
    met = meeting_boxes(segs.withColumn("box_l", cells.segment_box()), other.withColumn("box_r", box_r), touching=True, by=(group,))
    met = met.where(F.struct("o_shape_id", "o_seg") < F.struct("shape_id", "seg"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.hypot(dx, dy)
    off = lambda x, y: F.abs(dx * (y - F.col("ay")) - dy * (x - F.col("ax"))) / size
    along = lambda x, y: ((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / (size * size)
    u1, u2 = along(o["ax"], o["ay"]), along(o["bx"], o["by"])
    flat = (off(o["ax"], o["ay"]) <= size * _HAIR) & (off(o["bx"], o["by"]) <= size * _HAIR)
    gone = met.where(flat).select("shape_id", "seg", F.greatest(F.lit(0.0), F.least(u1, u2)).alias("ta"), F.least(F.lit(1.0), F.greatest(u1, u2)).alias("tb")).where(F.col("tb") - F.col("ta") > _HAIR)
    out = _strung(_kept(segs, gone, group), group, False)
    kind = F.when(F.size("geom") > 1, "MULTILINESTRING").otherwise("LINESTRING")
    return out.select(group, "geom", kind.alias("kind"), geo.length(geo.edges("geom")).alias("length"))


# ---- distances -----------------------------------------------------------------------


def _segments_of(geom: Column) -> Column:
    """Edges of a geometry; a point is an edge without length."""

    def of_ring(p):
        at = p["ring"][0]
        point = F.array(F.struct(at["x"].alias("x1"), at["y"].alias("y1"), at["x"].alias("x2"), at["y"].alias("y2")))
        return F.when(F.size(p["ring"]) == 1, point).otherwise(geo.ring_edges(p["ring"]))

    return F.flatten(F.transform(geom, of_ring))


def near_shapes(points: DataFrame, shapes: DataFrame, distance: float, key: str = "point_id", portion: int | None = None) -> DataFrame:
    """(key, shape_id, distance) of every point and geometry no further apart than ``distance``.

    ``points``: key, x, y. ``shapes``: shape_id, geom (``parts`` of points, lines or polygons). The distance is that of
    the nearest edge, 0 inside a polygon. Segments are listed in all cells, as wide as the distance, that
    points so near may lie in, column by column; crowded cells are spread by their counts.
    """
    d = float(distance)
    one = shapes.select("shape_id", F.explode(_segments_of(F.col("geom"))).alias("e"))
    e = F.col("e")
    low_x, high_x, low_y, high_y = (f(e[f"{a}1"], e[f"{a}2"]) for a in "xy" for f in (F.least, F.greatest))
    index = lambda v: F.floor(v / d).cast("long")
    strips = one.select("shape_id", "e", F.explode(F.sequence(index(low_x - d), index(high_x + d))).alias("cx"))
    at = lambda x: F.when(e["x1"] == e["x2"], e["y1"]).otherwise(e["y1"] + (x - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"]))
    inside = lambda v: F.least(high_x, F.greatest(low_x, v))
    begin, end = at(inside((F.col("cx") - 1) * d)), at(inside((F.col("cx") + 2) * d))
    upright = e["x1"] == e["x2"]
    bottom = F.when(upright, low_y).otherwise(F.least(begin, end)) - d * (1 + 1e-9)
    top = F.when(upright, high_y).otherwise(F.greatest(begin, end)) + d * (1 + 1e-9)
    listed = strips.select("shape_id", "e", "cx", F.explode(F.sequence(index(bottom), index(top))).alias("cy"))
    placed = points.select(key, "x", "y", index(F.col("x")).alias("cx"), index(F.col("y")).alias("cy"))
    placed, listed = cells.spread(placed, listed, ["cx", "cy"], ["x", "y"], portion)
    pairs = placed.join(listed, ["cx", "cy", "_salt"])
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = ((F.col("x") - e["x1"]) * dx + (F.col("y") - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    away = F.hypot(F.col("x") - e["x1"] - t * dx, F.col("y") - e["y1"] - t * dy)
    near = pairs.withColumn("distance", away).where(F.col("distance") <= d).select(key, "shape_id", "distance")
    areas = shapes.where(F.col("geom")[0]["shell"].isNotNull())
    regions = areas.select(F.col("shape_id").alias("region_id"), geo.directed_edges("geom").alias("edges"), geo.bounds("geom").alias("box"))
    within = cells.tag(points.select(key, "x", "y"), regions, portion=portion).select(key, F.col("region_id").alias("shape_id"), F.lit(0.0).alias("distance"))
    return near.unionByName(within).groupBy(key, "shape_id").agg(F.min("distance").alias("distance"))
