"""Geometry as Column expressions.

A geometry travels as WKT text and is read into ``parts``: an array of
``struct(shell boolean, ring array<struct(x, y)>)``. ``shell`` is false on holes and null on points and lines.
Tests use ``edges``: an array of ``struct(x1, y1, x2, y2)`` over all rings, so that holes and
multi-polygons need no special case (even-odd rule).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Radius of the sphere behind Web Mercator (EPSG 3857 and its old code 900913), metres.
MERCATOR_RADIUS = 6378137.0


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A Column used several times inside a lambda is otherwise evaluated at each use.
    """
    return F.transform(F.array(value), body)[0]


# ---- reading and writing -------------------------------------------------------------


def geom_type(wkt: Column | str) -> Column:
    """``POINT``, ``LINESTRING``, ``POLYGON`` or a ``MULTI`` form."""
    return F.upper(F.regexp_extract(col(wkt), r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))


def is_point(wkt):
    return geom_type(wkt).isin("POINT", "MULTIPOINT")


def is_line(wkt):
    return geom_type(wkt).isin("LINESTRING", "MULTILINESTRING")


def is_polygon(wkt):
    return geom_type(wkt).isin("POLYGON", "MULTIPOLYGON")


def parts(wkt: Column | str) -> Column:
    """Rings of a WKT text. A ring opened by a double bracket starts a polygon, others are its holes.

    White space is made regular once per text, so that vertices are cut at single characters and no
    pattern is compiled per vertex. Further ordinates (Z, M) are ignored.
    """
    tidy = F.regexp_replace(F.regexp_replace(col(wkt), r"\s+", " "), r" ?([(),]) ?", "$1")

    def vertex(text):
        y = F.substring_index(F.substring_index(text, " ", 2), " ", -1)
        return F.struct(F.substring_index(text, " ", 1).cast("double").alias("x"), y.cast("double").alias("y"))

    polygon = is_polygon(wkt)

    def ring(text):
        inner = F.btrim(text, F.lit("()"))
        shell = F.when(polygon, text.startswith("(("))
        return F.struct(shell.alias("shell"), F.transform(F.split(inner, ","), vertex).alias("ring"))

    return F.transform(F.regexp_extract_all(tidy, F.lit(r"\(*\([^()]+\)"), F.lit(0)), ring)


def vertices(geom: Column | str) -> Column:
    """All vertices of ``parts``."""
    return F.flatten(F.transform(col(geom), lambda p: p["ring"]))


def ring_edges(ring: Column) -> Column:
    last = F.size(ring) - 1
    return F.when(
        last > 0,
        F.zip_with(
            F.slice(ring, F.lit(1), last),
            F.slice(ring, F.lit(2), last),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def edges(geom: Column | str) -> Column:
    """All edges of ``parts``."""
    return F.flatten(F.transform(col(geom), lambda p: ring_edges(p["ring"])))


def directed_edges(geom: Column | str) -> Column:
    """Edges of ``parts`` with a polygon's inside on their left: shells counter-clockwise, holes clockwise.

    Edges of lines keep their way.
    """

    def of_ring(p):
        def turned(e):
            twice = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + (v["x1"] * v["y2"] - v["x2"] * v["y1"]))
            back = F.transform(e, lambda v: F.struct(v["x2"].alias("x1"), v["y2"].alias("y1"), v["x1"].alias("x2"), v["y1"].alias("y2")))
            return bound(twice, lambda a: F.when(p["shell"].isNull() | ((a > 0) == p["shell"]), e).otherwise(back))

        return bound(ring_edges(p["ring"]), turned)

    return F.flatten(F.transform(col(geom), of_ring))


def bounds(geom: Column | str) -> Column:
    """``struct(xmin, ymin, xmax, ymax)``."""

    def ends(v):
        return F.struct(
            F.array_min(v["x"]).alias("xmin"),
            F.array_min(v["y"]).alias("ymin"),
            F.array_max(v["x"]).alias("xmax"),
            F.array_max(v["y"]).alias("ymax"),
        )

    return bound(vertices(geom), ends)


def point_wkt(x: Column | str, y: Column | str) -> Column:
    return F.concat(F.lit("POINT("), col(x).cast("string"), F.lit(" "), col(y).cast("string"), F.lit(")"))


def box_wkt(xmin, ymin, xmax, ymax) -> Column:
    """Closed rectangle, counter-clockwise from its lower left corner."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    text = F.concat_ws(",", *[F.concat_ws(" ", col(x).cast("string"), col(y).cast("string")) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), text, F.lit("))"))


def parts_geojson(wkt: Column | str) -> Column:
    """GeoJSON text of a point, line or polygon (and MULTI forms), from WKT."""
    return geojson_text(parts(wkt), geom_type(wkt))


def geojson_text(geom: Column, kind: Column, places: int | None = None) -> Column:
    """GeoJSON text of ``parts`` of a geometry type, coordinates rounded to ``places`` decimals."""

    def pair(p):
        x, y = p["x"], p["y"]
        return F.array(x, y) if places is None else F.array(F.round(x, places), F.round(y, places))

    rings = F.transform(geom, lambda p: F.transform(p["ring"], pair))
    names = {
        "POINT": "Point",
        "MULTIPOINT": "MultiPoint",
        "LINESTRING": "LineString",
        "MULTILINESTRING": "MultiLineString",
        "POLYGON": "Polygon",
        "MULTIPOLYGON": "MultiPolygon",
    }

    def doc(name, coords):
        return F.to_json(F.struct(F.lit(name).alias("type"), coords.alias("coordinates")))

    # Polygons of a multi-polygon start where a shell starts.
    polygons = F.aggregate(
        geom,
        F.array().cast("array<array<array<array<double>>>>"),
        lambda acc, p: F.when(
            F.coalesce(p["shell"], F.lit(True)),
            F.concat(acc, F.array(F.array(F.transform(p["ring"], pair)))),
        ).otherwise(
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.concat(F.element_at(acc, -1), F.array(F.transform(p["ring"], pair)))),
            )
        ),
    )
    return (
        F.when(kind == "POINT", doc(names["POINT"], rings[0][0]))
        .when(kind == "MULTIPOINT", doc(names["MULTIPOINT"], F.flatten(rings)))
        .when(kind == "LINESTRING", doc(names["LINESTRING"], rings[0]))
        .when(kind == "MULTILINESTRING", doc(names["MULTILINESTRING"], rings))
        .when(kind == "POLYGON", doc(names["POLYGON"], rings))
        .when(kind == "MULTIPOLYGON", doc(names["MULTIPOLYGON"], polygons))
    )


def number_text(value: Column, places: int = 6) -> Column:
    """A number with at most ``places`` decimals, without closing zeros."""
    fixed = value.cast(f"decimal({places + 15},{places})").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")) if places else fixed


def parts_wkt(geom: Column | str, kind: Column, places: int = 6) -> Column:
    """WKT of ``parts`` of a geometry type (see :func:`geom_type`); numbers with at most ``places`` decimals."""
    geom = col(geom)

    def ring_text(p):
        pairs = F.transform(p["ring"], lambda v: F.concat(number_text(v["x"], places), F.lit(" "), number_text(v["y"], places)))
        return F.array_join(pairs, ",")

    # A shell of a multi-polygon closes the polygon before it.
    opened = F.transform(geom, lambda p, i: F.concat(F.when(F.coalesce(p["shell"], F.lit(True)), F.when(i > 0, F.lit("),(")).otherwise(F.lit("("))).otherwise(F.lit(",")), F.lit("("), ring_text(p), F.lit(")")))
    listed = F.array_join(F.transform(geom, lambda p: F.concat(F.lit("("), ring_text(p), F.lit(")"))), ",")
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), listed)
        .when(kind == "MULTIPOINT", F.concat(F.lit("("), F.array_join(F.transform(geom, ring_text), ","), F.lit(")")))
        .when(kind.isin("POLYGON", "MULTILINESTRING"), F.concat(F.lit("("), listed, F.lit(")")))
        .when(kind == "MULTIPOLYGON", F.concat(F.lit("("), F.array_join(opened, ""), F.lit("))")))
    )
    return F.concat(kind, body)


def latlon_text(lat: Column | str, lon: Column | str, places: int = 5) -> Column:
    """``52.20000N, 1.50000W``."""
    lat, lon = col(lat), col(lon)

    def side(value, positive, negative):
        text = F.format_string(f"%.{places}f", F.abs(value))
        return F.concat(text, F.when(value < 0, negative).otherwise(positive))

    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


# ---- measures ------------------------------------------------------------------------


def length(edge_array: Column | str) -> Column:
    """Total edge length, in the units of the coordinates."""
    return F.aggregate(
        col(edge_array),
        F.lit(0.0),
        lambda acc, e: acc + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]),
    )


def _moments(ring: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, e):
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"),
            (acc["my"] + (e["y1"] + e["y2"]) * cross).alias("my"),
        )

    return F.aggregate(ring_edges(ring), zero, step)


def area(geom: Column | str) -> Column:
    """Shells minus holes, whatever way the rings turn."""
    return F.aggregate(
        F.transform(
            col(geom),
            lambda p: F.when(p["shell"].isNull(), 0.0).otherwise(
                F.when(p["shell"], 0.5).otherwise(-0.5) * F.abs(_moments(p["ring"])["a"])
            ),
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def turned_edges(geom: Column | str) -> Column:
    """Edges of a polygon as one flat array (x1, y1, x2, y2, ...), shells counter-clockwise and holes clockwise."""

    def flat(p):
        def turned(m):
            forward = (m["a"] > 0) == p["shell"]
            return F.transform(
                ring_edges(p["ring"]),
                lambda e: F.when(forward, F.array(e["x1"], e["y1"], e["x2"], e["y2"])).otherwise(
                    F.array(e["x2"], e["y2"], e["x1"], e["y1"])
                ),
            )

        return bound(_moments(p["ring"]), lambda m: F.flatten(turned(m)))

    return F.flatten(F.transform(F.filter(col(geom), lambda p: p["shell"].isNotNull()), flat))


def centroid(geom: Column | str) -> Column:
    """Area-weighted centre of polygons, length-weighted of lines, mean of points."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def weight(w, x, y):
        return F.struct(w.alias("w"), x.alias("x"), y.alias("y"))

    def total(items):
        return F.aggregate(
            items, zero, lambda acc, m: weight(acc["w"] + m["w"], acc["x"] + m["x"], acc["y"] + m["y"])
        )

    def mean(sums):
        return F.when(sums["w"] > 0, F.struct((sums["x"] / sums["w"]).alias("x"), (sums["y"] / sums["w"]).alias("y")))

    def ring_weight(p):
        def signed(m):
            # Shells count positive and holes negative, whatever way they turn.
            sign = F.when(p["shell"], 1.0).otherwise(-1.0) * F.signum(m["a"])
            return weight(sign * m["a"] * 3, sign * m["mx"], sign * m["my"])

        return bound(_moments(p["ring"]), signed)

    def edge_weight(e):
        n = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
        return bound(n, lambda w: weight(w, w * (e["x1"] + e["x2"]) / 2, w * (e["y1"] + e["y2"]) / 2))

    def by_area(g):
        return bound(total(F.transform(g, ring_weight)), mean)

    def by_length(g):
        return bound(total(F.transform(edges(g), edge_weight)), mean)

    def by_count(g):
        return bound(total(F.transform(vertices(g), lambda p: weight(F.lit(1.0), p["x"], p["y"]))), mean)

    # Polygons by area, lines by length; points, and shapes without extent, by count.
    return bound(
        col(geom),
        lambda g: F.coalesce(F.when(g[0]["shell"].isNotNull(), by_area(g)), F.when(F.size(g[0]["ring"]) > 1, by_length(g)), by_count(g)),
    )


# ---- tests ---------------------------------------------------------------------------


def on_boundary(x, y, edge_array) -> Column:
    """The point lies on an edge."""
    x, y = col(x), col(y)
    return F.exists(
        col(edge_array),
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def strictly_inside(x, y, edge_array) -> Column:
    """Even-odd test; the result for a point on an edge is not defined, see :func:`contains`."""
    x, y = col(x), col(y)
    crossings = F.aggregate(
        col(edge_array),
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e["y1"] > y) != (e["y2"] > y))
            & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def contains(x, y, edge_array, boundary: bool = True) -> Column:
    """Point in polygon. ``boundary`` says whether contact with the edge counts."""
    edge = on_boundary(x, y, edge_array)
    inside = strictly_inside(x, y, edge_array)
    return (edge | inside) if boundary else (~edge & inside)


def boxes_meet(a: Column, b: Column, touching: bool = True) -> Column:
    """Two ``bounds`` structs share a point (or, without ``touching``, some interior)."""
    if touching:
        return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    return (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area of two ``bounds`` structs."""
    wide = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    high = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1))


# ---- grids ---------------------------------------------------------------------------


def snap(c: Column | str, size: float) -> Column:
    """Nearest grid line (halves to even, as a grid snap does)."""
    return F.rint(col(c) / size) * size


def snap_parts(geom: Column | str, size: float) -> Column:
    """``parts`` with every vertex on the nearest grid lines; vertices that fall together with the one before are dropped."""

    def snapped(p):
        ring = F.transform(p["ring"], lambda v: F.struct(snap(v["x"], size).alias("x"), snap(v["y"], size).alias("y")))
        fresh = bound(ring, lambda r: F.filter(r, lambda v, i: (i == 0) | (v != F.get(r, i - 1))))
        return F.struct(p["shell"].alias("shell"), fresh.alias("ring"))

    return F.transform(col(geom), snapped)


def square(c: Column | str, size: int) -> Column:
    """Lower edge of the fixed map square holding the coordinate."""
    return (F.floor(col(c) / size) * size).cast("long")


def _grid_letter(index: Column) -> Column:
    # The grid alphabet has no I.
    return F.char(F.lit(65) + index + F.when(index > 7, 1).otherwise(0))


def grid_letters(easting: Column, northing: Column) -> Column:
    """Two letters of the 100 km square of the British national grid."""
    e, n = F.floor(easting / 100000).cast("int"), F.floor(northing / 100000).cast("int")
    row = F.lit(19) - n
    first = row - row % 5 + F.floor((e + 10) / 5).cast("int")
    second = row * 5 % 25 + e % 5
    return F.concat(_grid_letter(first), _grid_letter(second))


def grid_ref(easting: Column | str, northing: Column | str, size: int) -> Column:
    """National grid reference of the square of ``size`` metres holding a point.

    2000 m squares are named by their 10 km square and a letter (tetrads, A to Z without O).
    """
    e, n = col(easting).cast("long"), col(northing).cast("long")
    letters = grid_letters(e, n)
    if size == 100000:
        return letters
    if size == 2000:
        step = F.floor(e % 10000 / 2000) * 5 + F.floor(n % 10000 / 2000)
        tetrad = F.substring(F.lit("ABCDEFGHIJKLMNPQRSTUVWXYZ"), step.cast("int") + 1, F.lit(1))
        return F.concat(
            letters,
            F.floor(e % 100000 / 10000).cast("string"),
            F.floor(n % 100000 / 10000).cast("string"),
            tetrad,
        )
    digits = 5 - int(round(math.log10(size)))
    if 10 ** (5 - digits) != size:
        raise ValueError("size must be 2000 or a power of ten up to 100000")

    def part(v):
        return F.lpad(F.floor(v % 100000 / size).cast("string"), digits, "0")

    return F.concat(letters, part(e), part(n))


def ref_precision(ref: Column | str) -> Column:
    """Side in metres of the square a grid reference names; null for other text."""
    clean = F.upper(F.replace(col(ref), F.lit(" "), F.lit("")))
    figures = F.length(F.regexp_extract(clean, r"^[A-Z]{1,2}(\d*)$", 1))
    plain = F.pow(F.lit(10.0), F.lit(5) - figures / 2).cast("int")
    return (
        F.when(clean.rlike(r"^[A-Z]{1,2}\d{2}[A-NP-Z]$"), F.lit(2000))
        .when(clean.rlike(r"^[A-Z]{1,2}\d{2}(NW|NE|SW|SE)$"), F.lit(5000))
        .when(clean.rlike(r"^[A-Z]{1,2}(\d\d){0,5}$"), plain)
    )


# ---- projections ---------------------------------------------------------------------


def mercator_to_lonlat(x: Column | str, y: Column | str) -> Column:
    """Web Mercator metres to degrees: ``struct(x = lon, y = lat)``."""
    lon = col(x) / MERCATOR_RADIUS * (180 / math.pi)
    lat = (F.atan(F.exp(col(y) / MERCATOR_RADIUS)) * 2 - math.pi / 2) * (180 / math.pi)
    return F.struct(lon.alias("x"), lat.alias("y"))


def lonlat_to_mercator(lon: Column | str, lat: Column | str) -> Column:
    """Degrees to Web Mercator metres: ``struct(x, y)``."""
    x = col(lon) * (math.pi / 180) * MERCATOR_RADIUS
    y = F.log(F.tan(F.lit(math.pi / 4) + col(lat) * (math.pi / 360))) * MERCATOR_RADIUS
    return F.struct(x.alias("x"), y.alias("y"))


def reproject_parts(geom: Column | str, to_point) -> Column:
    """Apply a point projection (``(x, y) -> struct(x, y)``) to every vertex of ``parts``."""
    return F.transform(
        col(geom),
        lambda p: F.struct(
            p["shell"].alias("shell"), F.transform(p["ring"], lambda v: to_point(v["x"], v["y"])).alias("ring")
        ),
    )
