"""Geometry: parsing, measures, tests and joins against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.functions import geo, geo_arrow
from fieldtally.operators import spatial
from fieldtally.plans import sites

DONUT = "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))"
TWO = "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)),((5 5,6 5,6 6,5 6,5 5)))"


def one(spark, column, wkt=DONUT):
    return spark.createDataFrame([(wkt,)], "w string").select(column).first()[0]


@pytest.mark.parametrize(
    "wkt, length, area, centre",
    [
        (DONUT, 48.0, 96.0, (488 / 96, 488 / 96)),
        ("LINESTRING (0 0, 3 4)", 5.0, 0.0, (1.5, 2.0)),
        ("POINT(5 6)", 0.0, 0.0, (5.0, 6.0)),
        ("MULTIPOINT((0 0),(2 4))", 0.0, 0.0, (1.0, 2.0)),
        ("MULTILINESTRING((0 0,2 0),(0 2,2 2))", 4.0, 0.0, (1.0, 1.0)),
        ("LINESTRING(3 3,3 3)", 0.0, 0.0, (3.0, 3.0)),
        ("SRID=4326;POLYGON Z ((0 0 9, 4 0 9, 4 4 9, 0 4 9, 0 0 9))", 16.0, 16.0, (2.0, 2.0)),
        ("POLYGON((0 0,0 4,4 4,4 0,0 0))", 16.0, 16.0, (2.0, 2.0)),
    ],
)
def test_measures(spark, wkt, length, area, centre):
    df = spark.createDataFrame([(wkt,)], "w string").withColumn("g", geo.parts("w"))
    got = df.select(geo.length(geo.edges("g")), geo.area("g"), geo.centroid("g").alias("c")).first()
    assert got[0] == pytest.approx(length) and got[1] == pytest.approx(area)
    assert (got.c.x, got.c.y) == pytest.approx(centre)


def test_geojson(spark):
    assert one(spark, geo.parts_geojson("w"), TWO) == (
        '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],'
        "[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,6.0],[5.0,5.0]]]]}"
    )
    assert one(spark, geo.geom_type("w"), "SRID=27700;LineString(0 0,1 1)") == "LINESTRING"


@pytest.mark.parametrize(
    "x, y, inside, boundary",
    [(1, 1, True, True), (3, 3, False, False), (2, 3, False, True), (0, 5, False, True), (10, 10, False, True), (11, 5, False, False), (5, 4, True, True)],
)
def test_contains(spark, x, y, inside, boundary):
    e = geo.edges(geo.parts("w"))
    assert one(spark, geo.contains(F.lit(float(x)), F.lit(float(y)), e, False)) is inside
    assert one(spark, geo.contains(F.lit(float(x)), F.lit(float(y)), e, True)) is boundary


def test_grid_references(spark):
    df = spark.createDataFrame([(651409, 313177), (400000, 300000), (0, 0)], "e int, n int")
    got = df.select(*[geo.grid_ref("e", "n", s) for s in (100000, 10000, 2000, 1000, 100, 1)]).collect()
    assert tuple(got[0]) == ("TG", "TG51", "TG51B", "TG5113", "TG514131", "TG5140913177")
    assert tuple(got[1])[:3] == ("SK", "SK00", "SK00A") and got[2][0] == "SV"
    refs = spark.createDataFrame([("TG51",), ("TG 514 131",), ("TG51B",), ("H99",), ("TG51NE",), ("nonsense",)], "r string")
    assert [r[0] for r in refs.select(geo.ref_precision("r")).collect()] == [10000, 100, 2000, 10000, 5000, None]


def test_projections():
    # Published worked example of the projection, in the datum of the grid: 52 39 27.2531 N, 1 43 4.5177 E.
    lon, lat = geo_arrow.grid_to_lonlat_xy(np.array([651409.903]), np.array([313177.270]))
    east, north = geo_arrow.lonlat_to_grid_xy(lon, lat)
    assert abs(east[0] - 651409.903) < 0.5 and abs(north[0] - 313177.270) < 0.5
    assert lat[0] == pytest.approx(52.65798, abs=2e-4) and lon[0] == pytest.approx(1.71605, abs=2e-4)


def test_latlon_text(spark):
    assert one(spark, geo.latlon_text(F.lit(52.2), F.lit(-1.5), 3)) == "52.200N, 1.500W"


SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
ARROWHEAD = "POLYGON((0 0,10 5,0 10,4 5,0 0))"
BESIDE = "POLYGON((10 0,20 0,20 10,10 10,10 0))"
CLOCKWISE = "POLYGON((0 0,0 10,10 10,10 0,0 0))"
TURNED_HOLE = "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,2 4,4 4,4 2,2 2))"
PAIR = "MULTIPOLYGON(((1 1,3 1,3 3,1 3,1 1)),((8 8,12 8,12 12,8 12,8 8)))"


@pytest.mark.parametrize(
    "a, b, area",
    [
        (SQUARE, SQUARE, 100),
        (SQUARE, DONUT, 96),
        (DONUT, DONUT, 96),
        (DONUT, TURNED_HOLE, 96),
        (ARROWHEAD, SQUARE, 30),
        (SQUARE, BESIDE, 0),
        (CLOCKWISE, SQUARE, 100),
        (PAIR, SQUARE, 8),
        (PAIR, DONUT, 7),
        (SQUARE, "POLYGON((5 5,15 5,15 15,5 15,5 5))", 25),
        (SQUARE, "POLYGON((-5 5,5 -5,15 5,5 15,-5 5))", 100),
        ("POLYGON((-5 5,5 -5,15 5,5 15,-5 5))", "POLYGON((0 -5,10 -5,10 15,0 15,0 -5))", 150),
    ],
)
def test_shared_area(spark, a, b, area):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    edges = df.select(geo.turned_edges(geo.parts("a")).alias("a"), geo.turned_edges(geo.parts("b")).alias("b"))
    assert edges.select(geo_arrow.overlap_area("a", "b"), geo_arrow.overlap_area("b", "a")).first() == pytest.approx((area, area))


def test_shared_area_of_random_triangles():
    """Against counting points of a fine lattice."""
    rng = np.random.default_rng(5)
    grid = (np.stack(np.meshgrid(np.arange(400), np.arange(400)), -1).reshape(-1, 2) + 0.5) / 40

    def turn(u, v):
        return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]

    def inside(t):
        cross = [turn(t[(i + 1) % 3] - t[i], grid - t[i]) for i in range(3)]
        return np.all([c > 0 for c in cross], axis=0) | np.all([c < 0 for c in cross], axis=0)

    def flat(t):
        t = t if turn(t[1] - t[0], t[2] - t[0]) > 0 else t[::-1]
        return np.concatenate([np.concatenate([t[i], t[(i + 1) % 3]]) for i in range(3)])

    pairs = [(rng.uniform(0, 10, (3, 2)), rng.uniform(0, 10, (3, 2))) for _ in range(30)]
    got = geo_arrow.shared_areas([flat(a) for a, _ in pairs], [flat(b) for _, b in pairs])
    counted = [np.sum(inside(a) & inside(b)) / 1600 for a, b in pairs]
    assert np.allclose(got, counted, atol=0.25)


def test_tagging_equals_brute_force(spark):
    random.seed(1)
    points = [(i, random.randrange(0, 100) / 2, random.randrange(0, 100) / 2) for i in range(300)]
    points += [(i, 7.0, 7.0) for i in range(300, 500)]  # one spot with 40 per cent of all points
    shapes = []
    for r in range(12):
        x, y, w, h = random.randrange(0, 40), random.randrange(0, 40), random.randrange(1, 30), random.randrange(1, 30)
        shapes.append((r, f"POLYGON(({x} {y},{x + w} {y},{x} {y + h},{x} {y}))", x, y, w, h))
    p = spark.createDataFrame(points, "id int, x double, y double")
    regions = spatial.shapes(spark.createDataFrame([s[:2] for s in shapes], "id int, boundary_geom string"))
    for boundary in (True, False):
        def holds(px, py, x, y, w, h):
            a, b, c = px - x, py - y, (px - x) * h + (py - y) * w - w * h
            return (a >= 0 and b >= 0 and c <= 0) if boundary else (a > 0 and b > 0 and c < 0)

        brute = {(i, s[0]) for i, px, py in points for s in shapes if holds(px, py, *s[2:])}
        for size in (None, 3.0, 1000.0):
            got = spatial.tag_points(p, regions, boundary=boundary, size=size)
            assert set(rows(got, "id", "region_id")) == brute and got.count() == len(brute)


def test_one_wide_region_does_not_crowd_the_cells(spark):
    small = [(i, f"POLYGON(({x} {y},{x + 10} {y},{x + 10} {y + 10},{x} {y + 10},{x} {y}))") for i, (x, y) in enumerate((20 * (k % 40), 20 * (k // 40)) for k in range(1600))]
    wide = (-1, "POLYGON((-100 -100,99900 -100,99900 99900,-100 99900,-100 -100))")
    regions = spatial.shapes(spark.createDataFrame([*small, wide], "id int, boundary_geom string"))
    spots = spark.range(900).select(((F.col("id") % 30) * 20 + 5.0).alias("x"), (F.floor(F.col("id") / 30) * 20 + 5.0).alias("y"))
    assert spatial.candidates(spots, regions).count() < 8 * 900
    got = spatial.tag_points(spots, regions, keep_outside=True)
    counts = {r["region_id"]: r["count"] for r in got.groupBy("region_id").count().collect()}
    assert counts[None] == counts[-1] == 900 and len(counts) == 902 and all(n == 1 for i, n in counts.items() if i not in (None, -1))
    boxes = regions.select(F.col("region_id").alias("a"), F.col("box").alias("box_l"))
    pairs = spatial.meeting_boxes(boxes, regions.select(F.col("region_id").alias("b"), F.col("box").alias("box_r")))
    want = {(a, a) for a in range(-1, 1600)} | {(-1, a) for a in range(1600)} | {(a, -1) for a in range(1600)}
    assert set(rows(pairs, "a", "b")) == want and pairs.count() == len(want)
    assert spatial.tag_points(spots, regions.limit(0)).count() == 0


def test_large_polygons_overlap_in_bounded_memory():
    def ring(n, x):
        at = 2 * np.pi * np.arange(n + 1) / n
        xy = np.stack([np.cos(at) + x, np.sin(at)], axis=1)
        return np.concatenate([xy[:-1], xy[1:]], axis=1).ravel()

    tracemalloc.start()
    got = geo_arrow.shared_areas([ring(1500, 0.0)], [ring(1500, 1.0)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(got[0] - (2 * np.pi / 3 - np.sqrt(3) / 2)) < 1e-3 and peak < 200e6


def test_overlap_runs_once_per_pair(spark):
    df = spark.createDataFrame([(1, "POLYGON((0 0,10 0,10 10,0 10,0 0))")], "id int, w string").withColumn("g", geo.parts("w"))
    found = spatial.overlapping(df.select(F.col("g").alias("geom_l")), df.select(F.col("g").alias("geom_r")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("ArrowEvalPython") == 1


def test_within_equals_brute_force(spark):
    random.seed(2)
    points = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(300)]
    centres = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(20)]
    got = spatial.within(
        spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(centres, "c int, cx0 double, cy0 double"), 10
    )
    brute = {(i, c) for i, x, y in points for c, a, b in centres if (x - a) ** 2 + (y - b) ** 2 <= 100}
    assert set(rows(got, "id", "c")) == brute and got.count() == len(brute)


def test_overlapping_ignores_touching(spark):
    boxes = [(1, "POLYGON((0 0,10 0,10 10,0 10,0 0))"), (2, "POLYGON((10 0,20 0,20 10,10 10,10 0))"), (3, "POLYGON((9 9,11 9,11 11,9 11,9 9))")]
    df = spark.createDataFrame(boxes, "id int, w string").withColumn("g", geo.parts("w"))
    got = spatial.overlapping(df.select(F.col("id").alias("a"), F.col("g").alias("geom_l")), df.select(F.col("id").alias("b"), F.col("g").alias("geom_r")), 3.0)
    assert rows(got.where("a < b"), "a", "b", "shared_area") == [(1, 3, 1.0), (2, 3, 1.0)]


def test_region_grid_of_a_donut(spark):
    df = spark.createDataFrame([(1, "POLYGON((0 0,500 0,500 500,0 500,0 0),(150 150,350 150,350 350,150 350,150 150))")], "id int, boundary_geom string")
    got = {(r.west, r.south): r.partial for r in sites.region_grid(spatial.shapes(df), 100).collect()}
    assert (200, 200) not in got and len(got) == 24
    assert got[(0, 0)] is False and got[(100, 100)] is True


def test_simplify_keeps_far_vertices(spark):
    wkt = "LINESTRING(0 0,1 0.1,2 -0.1,3 5,4 6,5 7,6 8.1,7 9)"
    df = spark.createDataFrame([(wkt,)], "w string").select(geo.parts("w").alias("g"))
    out = df.select(geo_arrow.simplified("g", F.lit(1.0)).alias("g")).first().g
    assert [(v.x, v.y) for v in out[0].ring] == [(0, 0), (2, -0.1), (3, 5), (7, 9)]


def test_collected_lines(spark):
    lines = spark.createDataFrame([(1, i, f"LINESTRING({i} 0,{i} 1)") for i in range(5)], "k int, id int, w string")
    got = spatial.collect_geom(lines, "k", "w", "id")
    assert rows(got, "geom") == [("MULTILINESTRING((0 0,0 1),(1 0,1 1),(2 0,2 1),(3 0,3 1),(4 0,4 1))",)]
