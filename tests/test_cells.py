"""Regions cut into cells, clipping, unions and distances against plain geometry."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.functions import geo, geo_arrow
from fieldtally.operators import cells, overlay, spatial
from fieldtally.plans import exports, sites


def star(draw, x, y, radius, n):
    """A ring around (x, y) whose radius changes from vertex to vertex."""
    at = [(2 * math.pi * k / n, radius * draw.uniform(0.3, 1)) for k in range(n)]
    ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in at]
    return "POLYGON((" + ",".join(f"{u} {v}" for u, v in [*ring, ring[0]]) + "))"


def box(x, y, w, h):
    return f"POLYGON(({x} {y},{x} {y + h},{x + w} {y + h},{x + w} {y},{x} {y}))"


@pytest.fixture(scope="module")
def shapes(spark):
    draw = random.Random(4)
    out = [(i, star(draw, draw.uniform(0, 100), draw.uniform(0, 100), draw.choice([2, 10, 40]), draw.choice([5, 8, 200, 1000]))) for i in range(20)]
    out += [(i, box(draw.randrange(90), draw.randrange(90), draw.choice([1, 4, 16, 30]), draw.choice([2, 8, 20]))) for i in range(20, 40)]
    out += [
        (100, "POLYGON((0 0,64 0,64 64,0 64,0 0),(16 16,48 16,48 48,16 48,16 16))"),
        (101, "MULTIPOLYGON(((70 70,80 70,80 80,70 70)),((80 80,90 80,90 90,80 90,80 80)))"),
        (102, None),
    ]
    return spark.createDataFrame(out, "id long, boundary_geom string").repartition(2)


@pytest.mark.parametrize("boundary", [True, False])
def test_tagging_by_cells_equals_the_outline_test(spark, shapes, boundary):
    draw = random.Random(5)
    spots = [(draw.uniform(-5, 105), draw.uniform(-5, 105)) for _ in range(600)] + [(float(a), float(b)) for a in range(0, 100, 4) for b in range(0, 100, 4)]
    points = spark.createDataFrame(spots, "x double, y double")
    regions = spatial.shapes(shapes)
    want = points.join(F.broadcast(regions), geo.contains("x", "y", "edges", boundary))
    assert rows(cells.tag(points, regions, boundary=boundary), "x", "y", "region_id") == rows(want, "x", "y", "region_id")


def test_crowded_cells_are_spread_by_their_counts(spark):
    points = spark.range(2000).select(F.when(F.col("id") < 1500, F.col("id") / 1500).otherwise(F.col("id") * 1.0).alias("x"), F.lit(0.5).alias("y"))
    regions = spatial.shapes(spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, box(-1, -1, 3, 3))], "id long, boundary_geom string"))
    assert cells.tag(points, regions, portion=100).groupBy("region_id").count().orderBy("region_id").collect() == [(1, 1500), (2, 1500)]
    placed = points.select("x", "y", F.floor("x").alias("cx"))
    dealt, several = cells.spread(placed, spark.createDataFrame([(0,), (7,)], "cx long"), ["cx"], ["x", "y"], 100)
    assert dealt.where("cx = 0").agg(F.countDistinct("_salt")).first()[0] == 15 and several.where("cx = 0").count() == 15
    assert dealt.where("cx <> 0").agg(F.max("_salt")).first()[0] == 0 and several.where("cx = 7").count() == 1


def test_no_outline_travels_with_points_or_squares(spark, shapes):
    regions = spatial.shapes(shapes)
    per_cell = cells.region_cells(regions).select("region_id", F.size("local").alias("n"))
    edges = {r.region_id: r.n for r in regions.select("region_id", F.size("edges").alias("n")).collect()}
    big = [r for r in per_cell.collect() if edges[r.region_id] >= 1000]
    assert big and max(r.n or 0 for r in big) < 200
    assert "edges" not in cells.candidates(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), regions).columns


def test_shared_areas_by_cells(spark, shapes):
    geom = geo.parts("boundary_geom")
    known = shapes.where("boundary_geom is not null")
    plain = spatial.overlapping(known.select(F.col("id").alias("shape_id"), geom.alias("geom_l")), known.select(F.col("id").alias("region_id"), geom.alias("geom_r")))
    want = {(r.shape_id, r.region_id): r.shared_area for r in plain.collect()}
    regions = spatial.shapes(known)
    got = {(r.shape_id, r.region_id): r.shared_area for r in cells.shared_area(regions.withColumnRenamed("region_id", "shape_id"), regions).collect()}
    assert all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-6 for k in got.keys() | want.keys()) and len(want) > 80


def test_overlap_of_two_long_outlines(spark):
    def ring(x, n=5000):
        at = [(math.cos(2 * math.pi * k / n) + x, math.sin(2 * math.pi * k / n)) for k in range(n)]
        return "POLYGON((" + ",".join(f"{a} {b}" for a, b in [*at, at[0]]) + "))"

    df = spark.createDataFrame([(1, ring(0.0)), (2, ring(1.0))], "id long, w string").withColumn("geom", geo.parts("w"))
    squares = df.where("id = 1").select(F.col("id").alias("square_id"), "geom")
    got = sites.layer_overlap(squares, df.where("id = 2").select(F.col("id").alias("layer_id"), F.lit("l").alias("layer_name"), "geom")).collect()
    assert [r.pct_covered for r in got] == [str(int((2 * math.pi / 3 - math.sqrt(3) / 2) / math.pi * 100))]


LINES = [
    (1, "LINESTRING(-5 5,15 5)", True, 10), (2, "LINESTRING(0 0,10 0)", False, 0), (3, "LINESTRING(10 2,10 8,20 8)", False, 0), (4, "LINESTRING(-2 2,2 -2)", False, 0),
    (5, "LINESTRING(4 4,6 6)", False, None), (6, "LINESTRING(1 1,2 1)", True, 1), (7, "LINESTRING(-1 -1,0 0)", False, 0), (8, "LINESTRING(0 10,5 10,5 9)", True, 1),
    (9, "MULTILINESTRING((20 20,30 30),(9 9,11 11))", True, math.sqrt(2)), (10, "LINESTRING(3 5,7 5)", False, 0), (11, "LINESTRING(-9 -9,-1 -1)", False, None), (12, "LINESTRING(2 5,8 5)", True, 2),
]


def test_lines_against_a_region_with_a_hole(spark):
    region = spatial.shapes(spark.createDataFrame([(1, "POLYGON((0 0,10 0,10 10,0 10,0 0),(3 3,7 3,7 7,3 7,3 3))")], "id long, boundary_geom string"))
    lines = spark.createDataFrame([(i, w) for i, w, _, _ in LINES], "id long, w string").select("id", geo.edges(geo.parts("w")).alias("edges"))
    got = {r.id: (r.inside, r.touches, r.length_inside) for r in cells.lines_in_regions(lines, region, "id").collect()}
    want = {i: (inside, not inside, length) for i, _, inside, length in LINES if length is not None}
    want[1] = (True, False, 6)  # less the hole
    assert got.keys() == want.keys()
    assert all(got[i][:2] == want[i][:2] and got[i][2] == pytest.approx(want[i][2]) for i in want)


def test_lines_inside_equal_counted_points(spark, shapes):
    draw = random.Random(8)
    lines = [(i, *(draw.uniform(-10, 110) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(lines, "id long, a double, b double, c double, d double")
    edge = F.struct(F.col("a").alias("x1"), F.col("b").alias("y1"), F.col("c").alias("x2"), F.col("d").alias("y2"))
    regions = spatial.shapes(shapes)
    got = {(r.id, r.region_id): r.length_inside for r in cells.lines_in_regions(df.select("id", F.array(edge).alias("edges")), regions, "id").collect()}
    n = 800
    steps = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", (F.col("k") + 0.5) / n)
    steps = steps.select("id", "k", (F.col("a") + (F.col("c") - F.col("a")) * F.col("t")).alias("x"), (F.col("b") + (F.col("d") - F.col("b")) * F.col("t")).alias("y"))
    size = {i: math.hypot(c - a, d - b) for i, a, b, c, d in lines}
    counted = {(r.id, r.region_id): r.n / n * size[r.id] for r in cells.tag(steps, regions).groupBy("id", "region_id").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got.get(k, 0) - counted.get(k, 0)) < 0.05 * size[k[0]] for k in got.keys() | counted.keys()) and len(counted) > 100


def test_polygons_that_only_touch(spark):
    df = spark.createDataFrame([(1, box(0, 0, 10, 10)), (2, box(10, 0, 5, 10)), (3, box(10, 10, 5, 5)), (4, box(2, 2, 3, 3)), (5, box(0, 0, 10, 10)), (6, box(30, 30, 1, 1))], "id long, boundary_geom string")
    regions = spatial.shapes(df)
    got = {(r.shape_id, r.region_id): r.inside for r in cells.polygons_meeting(regions.withColumnRenamed("region_id", "shape_id"), regions).collect()}
    inside = {(1, 1), (1, 4), (1, 5), (4, 4), (4, 5), (5, 5), (2, 2), (3, 3), (6, 6)}
    touching = {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)}
    want = {p: True for p in inside} | {p: False for p in touching}
    assert got == want | {(b, a): v for (a, b), v in want.items()}


UNIONS = {
    "adjoining": ([box(0, 0, 10, 10), box(10, 0, 10, 10)], "POLYGON((0 0,20 0,20 10,0 10,0 0))", 200),
    "crossing": ([box(0, 0, 10, 10), box(5, 5, 10, 10)], "POLYGON((0 0,10 0,10 5,15 5,15 15,5 15,5 10,0 10,0 0))", 175),
    "frame": ([box(0, 0, 30, 10), box(0, 20, 30, 10), box(0, 0, 10, 30), box(20, 0, 10, 30)], "POLYGON((0 0,30 0,30 30,0 30,0 0),(10 10,10 20,20 20,20 10,10 10))", 800),
    "repeated": ([box(0, 0, 10, 10), box(0, 0, 10, 10), box(2, 2, 3, 3)], "POLYGON((0 0,10 0,10 10,0 10,0 0))", 100),
    "corner": ([box(0, 0, 10, 10), box(10, 10, 10, 10)], "MULTIPOLYGON(((0 0,10 0,10 10,0 10,0 0)),((10 10,20 10,20 20,10 20,10 10)))", 200),
    "slanted": (["POLYGON((0 0,6 0,3 6,0 0))", "POLYGON((0 4,6 4,3 -2,0 4))"], None, 24),
    "hole filled": (["POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,6 3,6 6,3 6,3 3))", box(3, 3, 3, 3)], "POLYGON((0 0,9 0,9 9,0 9,0 0))", 81),
}


def test_unions_with_known_outlines(spark):
    listed = [(f"{name}-{k}", name, w) for name, (shapes, _, _) in UNIONS.items() for k, w in enumerate(shapes)] + [("null", None, box(0, 0, 1, 1)), ("line", "frame", "LINESTRING(0 0,99 99)")]
    df = spark.createDataFrame(listed, "shape_id string, g string, w string").withColumn("geom", geo.parts("w"))
    got = {r.g: (r.w, r.area) for r in overlay.union_polygons(df, "g").select("g", geo.parts_wkt("geom", F.col("kind")).alias("w"), "area").collect()}
    assert got.keys() == UNIONS.keys()
    for name, (_, outline, area) in UNIONS.items():
        assert got[name][1] == pytest.approx(area) and outline in (None, got[name][0]), name


def test_union_area_of_many_discs(spark):
    """Against counted points of a grid."""
    draw = random.Random(3)
    discs = [(draw.uniform(0, 40), draw.uniform(0, 40), draw.uniform(1, 8)) for _ in range(40)]

    def disc(x, y, r, n=64):
        at = [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return "POLYGON((" + ",".join(f"{a} {b}" for a, b in [*at, at[0]]) + "))"

    df = spark.createDataFrame([(i, 1, disc(*d)) for i, d in enumerate(discs)], "shape_id long, g int, w string").withColumn("geom", geo.parts("w"))
    area = overlay.union_polygons(df, "g").first().area
    at = np.arange(-10, 60, 0.05) + 0.025
    x, y = np.meshgrid(at, at)
    covered = np.any([(x - a) ** 2 + (y - b) ** 2 <= (r * math.sqrt(math.sin(2 * math.pi / 64) / (2 * math.pi / 64))) ** 2 for a, b, r in discs], axis=0).sum() * 0.05**2
    assert area == pytest.approx(covered, rel=0.005)


def test_lines_that_share_stretches_are_drawn_once(spark):
    lines = [(1, "a", "LINESTRING(0 0,10 0,10 10)"), (2, "a", "LINESTRING(5 0,15 0)"), (3, "a", "LINESTRING(10 10,10 0)"), (4, "b", "LINESTRING(0 0,10 10)"), (5, "b", "LINESTRING(0 10,10 0)"), (6, "c", "MULTILINESTRING((0 0,1 0),(1 0,2 0))"), (7, "d", "LINESTRING(1 1,1 1)")]
    df = spark.createDataFrame(lines, "shape_id long, g string, w string").withColumn("geom", geo.parts("w"))
    got = {r.g: (r.w, round(r.length, 6)) for r in overlay.union_lines(df, "g").select("g", geo.parts_wkt("geom", F.col("kind")).alias("w"), "length").collect()}
    assert got == {
        "a": ("MULTILINESTRING((0 0,10 0,10 10),(10 0,15 0))", 25.0),
        "b": ("MULTILINESTRING((0 0,10 10),(0 10,10 0))", 28.284271),
        "c": ("LINESTRING(0 0,2 0)", 2.0),
    }


def test_distances_from_points_lines_and_polygons(spark):
    draw = random.Random(6)
    shapes = [(i, f"LINESTRING({draw.randrange(100)} {draw.randrange(100)},{draw.randrange(100)} {draw.randrange(100)})") for i in range(30)]
    shapes += [(100 + i, f"POINT({draw.randrange(100)} {draw.randrange(100)})") for i in range(30)] + [(200 + i, box(draw.randrange(100), draw.randrange(100), 12, 9)) for i in range(10)]
    points = [(i, draw.uniform(0, 100), draw.uniform(0, 100)) for i in range(80)]

    def away(p, a, b):
        d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    def least(p, wkt):
        v = [tuple(map(float, c.split())) for c in wkt[wkt.rindex("(") + 1 : wkt.index(")")].split(",")]
        if wkt.startswith("POLYGON") and min(a for a, _ in v) <= p[0] <= max(a for a, _ in v) and min(b for _, b in v) <= p[1] <= max(b for _, b in v):
            return 0.0
        return min(away(p, a, b) for a, b in zip(v, v[1:] or v))

    want = {(i, s): least((x, y), w) for i, x, y in points for s, w in shapes if least((x, y), w) <= 7}
    df = spark.createDataFrame(shapes, "shape_id long, w string").select("shape_id", geo.parts("w").alias("geom"))
    for portion in (None, 3):
        got = {(r.point_id, r.shape_id): r.distance for r in overlay.near_shapes(spark.createDataFrame(points, "point_id long, x double, y double"), df, 7, portion=portion).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 100


WKT = [
    "POINT(1 2)", "LINESTRING(0 0,1.25 2)", "MULTILINESTRING((0 0,1 1),(2 2,3 3.123457))", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,1 1))",
    "MULTIPOLYGON(((0 0,4 0,4 4,0 0),(1 1,1 2,2 2,1 1)),((10 10,14 10,14 14,10 10)))",
]


def test_wkt_is_written_as_it_was_read(spark):
    df = spark.createDataFrame([(w,) for w in [*WKT, None]], "w string")
    assert [r[0] for r in df.select(geo.parts_wkt(geo.parts("w"), geo.geom_type("w"))).collect()] == [*WKT, None]


def test_whole_geometries_reprojected_at_known_points(spark):
    # Published places: the origin and antimeridian of Web Mercator, and the square whose corner is 2 W, 49 N plus the datum shift.
    edge = math.pi * 6378137
    df = spark.createDataFrame([(1, f"POLYGON((0 0,{edge} 0,{edge} {edge},0 0))"), (2, "LINESTRING(0 0,111319.490793 111325.142866)")], "id int, geom string")
    got = {r.id: r.geom for r in exports.gis_export(df).collect()}
    assert got == {1: "POLYGON((0 0,180 0,180 85.051129,0 0))", 2: "LINESTRING(0 0,1 1)"}
    docs = {r.id: r.geom for r in exports.gis_export(df, geojson=True, places=3).collect()}
    assert docs[2] == '{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]}'
    # A control point of the national survey: Airy 52 39 27.2531 N, 1 43 4.5177 E is 651409.903 E, 313177.270 N.
    lat, lon = np.radians(52 + 39 / 60 + 27.2531 / 3600), np.radians(1 + 43 / 60 + 4.5177 / 3600)
    wgs = geo_arrow._geodetic(geo_arrow._helmert(geo_arrow._cartesian(np.array([lat]), np.array([lon]), geo_arrow._AIRY), -1), geo_arrow._WGS84)
    at = geo.lonlat_to_mercator(F.lit(float(np.degrees(wgs[1][0]))), F.lit(float(np.degrees(wgs[0][0]))))
    x, y = spark.range(1).select(at.alias("p")).first().p
    line = spark.createDataFrame([(f"LINESTRING({x} {y},{x + 100} {y})",), (None,)], "w string").select(geo_arrow.parts_to_grid(geo.parts("w")).alias("g")).collect()
    assert (line[0].g[0].ring[0].x, line[0].g[0].ring[0].y) == (pytest.approx(651409.903, abs=0.05), pytest.approx(313177.270, abs=0.05))
    # A hundred metres of Web Mercator are about 60 in the grid at this latitude.
    assert math.dist(line[0].g[0].ring[0], line[0].g[0].ring[1]) == pytest.approx(100 * math.cos(math.radians(52.66)), rel=0.005) and line[1].g is None


def test_equal_lines_meet_as_one(spark, monkeypatch):
    """Forty copies of two sections, one half over the other, drawn either way: two segments are compared, not eighty."""
    met = []
    plain = overlay.meeting_boxes
    monkeypatch.setattr(overlay, "meeting_boxes", lambda left, right, **k: met.append((left.count(), right.count())) or plain(left, right, **k))
    ways = ["LINESTRING(0 0,10 0)", "LINESTRING(15 0,5 0)", "LINESTRING(10 0,0 0)"]
    df = spark.createDataFrame([(i, 1, ways[i % 3]) for i in range(80)], "shape_id long, g long, wkt string")
    out = overlay.union_lines(df.select("shape_id", "g", geo.parts("wkt").alias("geom")), "g")
    assert met == [(2, 2)] and [r["length"] for r in out.collect()] == [15.0]


def test_equal_polygons_meet_as_one(spark, monkeypatch):
    """Copies of two squares, begun at any corner and turned either way, with a third of another group."""
    met = []
    plain = cells.clip
    monkeypatch.setattr(cells, "clip", lambda lines, regions, **k: met.append((lines.count(), regions.count())) or plain(lines, regions, **k))
    squares = ["POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((1 1,3 1,3 3,1 3,1 1))", "POLYGON((2 2,0 2,0 0,2 0,2 2))", "POLYGON((0 0,0 2,2 2,2 0,0 0))"]
    df = spark.createDataFrame([(i, int(i == 5), squares[i % 4]) for i in range(60)], "shape_id long, g long, wkt string")
    out = overlay.union_polygons(df.select("shape_id", "g", geo.parts("wkt").alias("geom")), "g")
    assert met == [(12, 3)] and sorted((r["g"], r["area"]) for r in out.collect()) == [(0, 7.0), (1, 4.0)]
