"""The few geometry computations that Column expressions express badly: Arrow-batched UDFs over numpy.

Each works on one row's vertices; Spark does the partitioning and the joins around them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the task; the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(
    T.StructType([T.StructField("shell", T.BooleanType()), T.StructField("ring", T.ArrayType(POINT))])
)


# ---- WGS84 degrees <-> national grid metres ------------------------------------------
# Published method: seven-parameter shift between WGS84 and the Airy 1830 datum, then the
# transverse Mercator series. Accuracy of the shift is about 5 m, enough for 10 m squares at best.

# Ellipsoids (semi-axes, metres) and the grid's projection constants.
_WGS84 = (6378137.0, 6356752.314245)
_AIRY = (6377563.396, 6356256.909)
_SCALE, _LAT0, _LON0 = 0.9996012717, np.radians(49.0), np.radians(-2.0)
_E0, _N0 = 400000.0, -100000.0
# Shift WGS84 -> Airy (metres, parts per million, seconds of arc).
_SHIFT = (-446.448, 125.157, -542.060)
_PPM = 20.4894
_TURN = (-0.1502, -0.2470, -0.8421)


def _cartesian(lat, lon, ellipsoid):
    a, b = ellipsoid
    e2 = 1 - b * b / (a * a)
    nu = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return np.stack([nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), (1 - e2) * nu * np.sin(lat)])


def _geodetic(xyz, ellipsoid):
    a, b = ellipsoid
    e2 = 1 - b * b / (a * a)
    p = np.hypot(xyz[0], xyz[1])
    lat = np.arctan2(xyz[2], p * (1 - e2))
    for _ in range(6):
        nu = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(xyz[2] + e2 * nu * np.sin(lat), p)
    return lat, np.arctan2(xyz[1], xyz[0])


def _helmert(xyz, direction):
    t = np.array(_SHIFT)[:, None] * direction
    s = 1 + _PPM * 1e-6 * direction
    rx, ry, rz = np.radians(np.array(_TURN) / 3600) * direction
    turn = np.array([[s, -rz, ry], [rz, s, -rx], [-ry, rx, s]])
    return t + turn @ xyz


def _arc(lat, n, b):
    d, m = lat - _LAT0, lat + _LAT0
    return (
        b
        * _SCALE
        * (
            (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
            - (3 * n + 3 * n**2 + 21 / 8 * n**3) * np.sin(d) * np.cos(m)
            + (15 / 8) * (n**2 + n**3) * np.sin(2 * d) * np.cos(2 * m)
            - (35 / 24) * n**3 * np.sin(3 * d) * np.cos(3 * m)
        )
    )


def _radii(lat):
    a, b = _AIRY
    e2 = 1 - b * b / (a * a)
    w = 1 - e2 * np.sin(lat) ** 2
    nu = a * _SCALE / np.sqrt(w)
    rho = a * _SCALE * (1 - e2) / w**1.5
    return nu, rho, nu / rho - 1


def lonlat_to_grid_xy(lon_deg, lat_deg):
    xyz = _helmert(_cartesian(np.radians(lat_deg), np.radians(lon_deg), _WGS84), 1)
    lat, lon = _geodetic(xyz, _AIRY)
    a, b = _AIRY
    nu, rho, eta2 = _radii(lat)
    sin, cos, tan2 = np.sin(lat), np.cos(lat), np.tan(lat) ** 2
    d = lon - _LON0
    north = (
        _arc(lat, (a - b) / (a + b), b)
        + _N0
        + nu / 2 * sin * cos * d**2
        + nu / 24 * sin * cos**3 * (5 - tan2 + 9 * eta2) * d**4
        + nu / 720 * sin * cos**5 * (61 - 58 * tan2 + tan2**2) * d**6
    )
    east = (
        _E0
        + nu * cos * d
        + nu / 6 * cos**3 * (nu / rho - tan2) * d**3
        + nu / 120 * cos**5 * (5 - 18 * tan2 + tan2**2 + 14 * eta2 - 58 * tan2 * eta2) * d**5
    )
    return east, north


def grid_to_lonlat_xy(east, north):
    a, b = _AIRY
    n = (a - b) / (a + b)
    lat = _LAT0 + (north - _N0) / (a * _SCALE)
    for _ in range(8):
        lat = lat + (north - _N0 - _arc(lat, n, b)) / (a * _SCALE)
    nu, rho, eta2 = _radii(lat)
    tan, sec = np.tan(lat), 1 / np.cos(lat)
    d = east - _E0
    t2 = tan**2
    phi = (
        lat
        - tan / (2 * rho * nu) * d**2
        + tan / (24 * rho * nu**3) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * d**4
        - tan / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2**2) * d**6
    )
    lam = (
        _LON0
        + sec / nu * d
        - sec / (6 * nu**3) * (nu / rho + 2 * t2) * d**3
        + sec / (120 * nu**5) * (5 + 28 * t2 + 24 * t2**2) * d**5
        - sec / (5040 * nu**7) * (61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3) * d**7
    )
    lat, lon = _geodetic(_helmert(_cartesian(phi, lam, _AIRY), -1), _WGS84)
    return np.degrees(lon), np.degrees(lat)


@F.pandas_udf(POINT)
def lonlat_to_grid(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    """WGS84 degrees to national grid easting and northing, metres."""
    x, y = lonlat_to_grid_xy(lon.to_numpy(float), lat.to_numpy(float))
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(POINT)
def grid_to_lonlat(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    """National grid metres to WGS84 degrees."""
    x, y = grid_to_lonlat_xy(east.to_numpy(float), north.to_numpy(float))
    return pd.DataFrame({"x": x, "y": y})


def mercator_to_grid_xy(x, y):
    """Web Mercator metres to national grid metres."""
    lon = np.degrees(x / 6378137.0)
    lat = np.degrees(2 * np.arctan(np.exp(y / 6378137.0)) - np.pi / 2)
    return lonlat_to_grid_xy(lon, lat)


def reprojected(geom: pa.Array, project) -> pa.Array:
    """A column of ``parts`` with every vertex projected: one call over the flat coordinates of the batch."""
    rings = geom.flatten()
    ring = rings.field("ring")
    points = ring.flatten()
    x, y = (np.asarray(points.field(c).to_numpy(zero_copy_only=False), float) for c in ("x", "y"))
    east, north = project(x, y) if len(x) else (x, y)
    vertices = pa.StructArray.from_arrays([pa.array(east), pa.array(north)], names=["x", "y"])
    lists = lambda values, like: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(like), 0).to_numpy(zero_copy_only=False))]), pa.int32()), values)
    shells = pa.StructArray.from_arrays([rings.field("shell"), lists(vertices, ring)], names=["shell", "ring"])
    out = lists(shells, geom)
    return pa.compute.if_else(geom.is_valid(), out, pa.scalar(None, out.type))


@F.arrow_udf(PARTS)
def parts_to_grid(geom: pa.Array) -> pa.Array:
    """``parts`` in Web Mercator to national grid metres."""
    return reprojected(geom, mercator_to_grid_xy)


@F.arrow_udf(PARTS)
def lonlat_parts_to_grid(geom: pa.Array) -> pa.Array:
    """``parts`` in WGS84 degrees to national grid metres."""
    return reprojected(geom, lonlat_to_grid_xy)


@F.arrow_udf(PARTS)
def grid_parts_to_lonlat(geom: pa.Array) -> pa.Array:
    """``parts`` in national grid metres to WGS84 degrees."""
    return reprojected(geom, grid_to_lonlat_xy)


# ---- shared area of two polygons -----------------------------------------------------
# Polygons come as flat edge lists (``geo.turned_edges``). Both are written as signed sums of
# triangles with one common corner, so only triangle pairs are left, and those are worked out for
# a whole batch at once: the area of an intersection is half the sum of the cross products of the
# boundary pieces of each triangle that lie in the other.


def _fan(edges, origin):
    """Signed triangles (origin, start, end), moved so that the origin is 0."""
    xy = np.asarray(edges, dtype=float).reshape(-1, 2, 2) - origin
    twice = xy[:, 0, 0] * xy[:, 1, 1] - xy[:, 1, 0] * xy[:, 0, 1]
    xy, twice = xy[twice != 0], twice[twice != 0]
    # Counter-clockwise throughout; the sign keeps the direction.
    xy = np.where((twice > 0)[:, None, None], xy, xy[:, ::-1])
    return np.concatenate([np.zeros((len(xy), 1, 2)), xy], axis=1), np.sign(twice)


def _boundary_inside(t1, t2, shared):
    """Sum of cross products of the pieces of the edges of ``t1`` inside ``t2``.

    An edge both have in common counts for one of the two (``shared``), and only if both
    triangles lie on the same side of it.
    """
    d = np.roll(t1, -1, axis=1) - t1
    start, stop = np.zeros(t1.shape[:2]), np.ones(t1.shape[:2])
    inside = np.ones(t1.shape[:2], dtype=bool)
    for j in range(3):
        a = t2[:, None, j]
        e = t2[:, None, (j + 1) % 3] - a
        offset = e[..., 0] * (t1[..., 1] - a[..., 1]) - e[..., 1] * (t1[..., 0] - a[..., 0])
        slope = e[..., 0] * d[..., 1] - e[..., 1] * d[..., 0]
        at = -offset / np.where(slope == 0, 1.0, slope)
        start = np.where(slope > 0, np.maximum(start, at), start)
        stop = np.where(slope < 0, np.minimum(stop, at), stop)
        along = (offset == 0) & ((e * d).sum(axis=-1) > 0) & shared
        inside &= (slope != 0) | (offset > 0) | along
    p, q = t1 + start[..., None] * d, t1 + stop[..., None] * d
    cross = p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    return np.where(inside & (stop > start), cross, 0.0).sum(axis=1)


#: Triangle pairs worked out at once.
PAIRS = 1 << 16


def shared_areas(left, right) -> np.ndarray:
    """Shared area of each pair of edge lists, in portions of bounded memory."""
    total = np.zeros(len(left))
    held, n = [], 0
    for i, (a, b) in enumerate(zip(left, right)):
        if a is None or b is None or len(a) == 0 or len(b) == 0:
            continue
        origin = np.asarray(a[:2], dtype=float)
        ta, sa = _fan(a, origin)
        tb, sb = _fan(b, origin)
        step = max(1, PAIRS // max(1, len(tb)))
        for lo in range(0, len(ta), step):
            t, s = ta[lo : lo + step], sa[lo : lo + step]
            held.append((np.repeat(t, len(tb), axis=0), np.tile(tb, (len(t), 1, 1)), np.outer(s, sb).ravel(), np.full(len(t) * len(tb), i)))
            n += len(t) * len(tb)
            if n >= PAIRS:
                total += _signed_sums(held, len(left))
                held, n = [], 0
    if held:
        total += _signed_sums(held, len(left))
    return np.abs(total)


def _signed_sums(held, rows: int) -> np.ndarray:
    t1, t2, sign, row = (np.concatenate(c) for c in zip(*held))
    areas = (_boundary_inside(t1, t2, True) + _boundary_inside(t2, t1, False)) / 2
    return np.bincount(row, areas * sign, minlength=rows)


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared area of two polygons given by ``geo.turned_edges``."""
    return pd.Series(shared_areas(a, b))


# A filter on the result would otherwise run it a second time.
overlap_area = overlap_area.asNondeterministic()


# ---- pieces of segments in cells -----------------------------------------------------

PIECE = T.ArrayType(T.StructType([T.StructField("ta", T.DoubleType()), T.StructField("tb", T.DoubleType()), T.StructField("where", T.StringType())]))
#: Where a piece lies: see ``cells.clip``.
_WHERE = ["in", "along", "against", "at"]
#: Distance, in widths of a cell, below which a point lies on an edge.
_HAIR = 1e-9


def _parity(x, y, x0, y0, e):
    """Edges (x1, y1, x2, y2) between the corner and the point, up the border and then across, as 0 or 1 each."""
    x1, y1, x2, y2 = e

    def turn(px, py):
        return (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)

    def left_of(px):
        t = turn(px, y)
        return ((y1 > y) != (y2 > y)) & np.where(y2 > y1, t <= 0, t >= 0)

    def below(py):
        t = turn(x0, py)
        under = np.where(t == 0, (y2 - y1) * (x2 - x1) <= 0, np.where(x2 > x1, t > 0, t < 0))
        return ((x1 > x0) != (x2 > x0)) & under

    return left_of(x) ^ left_of(x0) ^ below(y) ^ below(y0)


def clipped(ax, ay, bx, by, ta, tb, x0, y0, side, inside, owner, e):
    """(row, ta, tb, where) of the pieces of each row's segment between ta and tb that its cell's region holds.

    ``e`` are the edges (four arrays) of all rows one after the other, ``owner`` the row of each.
    """
    rows = len(ax)
    x1, y1, x2, y2 = e
    dx, dy, long = bx - ax, by - ay, np.hypot(bx - ax, by - ay)
    fx, fy, span = x2 - x1, y2 - y1, np.hypot(x2 - x1, y2 - y1)
    hair = _HAIR * side[owner]
    pax, pay, pdx, pdy = ax[owner], ay[owner], dx[owner], dy[owner]
    with np.errstate(divide="ignore", invalid="ignore"):
        from_a = (fx * (pay - y1) - fy * (pax - x1)) / span  # distances of the segment's ends from the edge's line
        from_b = (fx * (pay + pdy - y1) - fy * (pax + pdx - x1)) / span
        flat = (np.abs(from_a) <= hair) & (np.abs(from_b) <= hair) & (span > 0)
        cross = from_a / (from_a - from_b)
        # Where the edge's ends lie along the segment, and how far to its side.
        size = long[owner]
        u1, u2 = ((x1 - pax) * pdx + (y1 - pay) * pdy) / size**2, ((x2 - pax) * pdx + (y2 - pay) * pdy) / size**2
        off1, off2 = (pdx * (y1 - pay) - pdy * (x1 - pax)) / size, (pdx * (y2 - pay) - pdy * (x2 - pax)) / size
        met = ~flat & (span > 0) & (size > 0) & (np.minimum(off1, off2) <= hair) & (np.maximum(off1, off2) >= -hair) & np.isfinite(cross)
        slack = np.where(size > 0, hair / size, 0)
    lo, hi = ta[owner], tb[owner]
    hit = met & (cross >= lo - slack) & (cross <= hi + slack)
    # Contact of a point, or of a segment without length: its distance from the edge itself.
    middle = (lo + hi) / 2
    mx, my = pax + pdx * middle - x1, pay + pdy * middle - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.clip((mx * fx + my * fy) / span**2, 0, 1)
    near = (np.hypot(mx - along * fx, my - along * fy) <= hair) & (lo == hi) & (span > 0)
    flat_hit = flat & (size > 0) & (np.minimum(u1, u2) <= hi + slack) & (np.maximum(u1, u2) >= lo - slack)
    contact = np.zeros(rows, bool)
    contact[owner[hit | near | flat_hit]] = True

    cut_row = np.concatenate([np.arange(rows), np.arange(rows), owner[hit], owner[flat_hit], owner[flat_hit]])
    cut_t = np.concatenate([ta, tb, cross[hit], u1[flat_hit], u2[flat_hit]])
    cut_t = np.clip(cut_t, ta[cut_row], tb[cut_row])
    order = np.lexsort((cut_t, cut_row))
    cut_row, cut_t = cut_row[order], cut_t[order]
    real = (cut_row[1:] == cut_row[:-1]) & ((cut_t[1:] - cut_t[:-1]) * long[cut_row[1:]] > _HAIR * side[cut_row[1:]])
    row, begin, end = cut_row[1:][real], cut_t[:-1][real], cut_t[1:][real]
    # Every piece against all edges of its cell.
    count = np.bincount(owner, minlength=rows)
    first = np.cumsum(count) - count
    each = count[row]
    piece = np.repeat(np.arange(len(row)), each)
    edge = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[row], each)
    half = ((begin + end) / 2)[piece]
    px, py = (ax + 0)[row][piece] + dx[row][piece] * half, ay[row][piece] + dy[row][piece] * half
    odd = _parity(px, py, x0[row][piece], y0[row][piece], (x1[edge], y1[edge], x2[edge], y2[edge]))
    state = inside[row] ^ (np.bincount(piece[odd], minlength=len(row)) % 2 == 1)
    lies = flat_hit[edge] & (half >= np.minimum(u1, u2)[edge] - slack[edge]) & (half <= np.maximum(u1, u2)[edge] + slack[edge])
    forward = (fx * pdx + fy * pdy)[edge] > 0
    where = np.where(state, 0, -1)
    where[piece[lies & ~forward]] = 2
    where[piece[lies & forward]] = 1
    keep = where >= 0
    touched = np.flatnonzero(contact)
    return (
        np.concatenate([row[keep], touched]),
        np.concatenate([begin[keep], ta[touched]]),
        np.concatenate([end[keep], ta[touched]]),
        np.concatenate([where[keep], np.full(len(touched), 3)]),
    )


#: Pairs of a piece and an edge worked out at once.
PIECE_EDGES = 1 << 18


@F.arrow_udf(PIECE)
def pieces_in_cells(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array, ta: pa.Array, tb: pa.Array, x0: pa.Array, y0: pa.Array, side: pa.Array, inside: pa.Array, local: pa.Array) -> pa.Array:
    """The pieces of segments inside or on the region of their cell; see ``cells.clip``."""
    plain = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in (ax, ay, bx, by, ta, tb, x0, y0, side)]
    within = np.asarray(inside.to_numpy(zero_copy_only=False), bool)
    counts = pa.compute.list_value_length(local).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = local.flatten()
    edges = [np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in ("x1", "y1", "x2", "y2")]
    starts = np.concatenate([[0], np.cumsum(counts)])
    found, lo = [], 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE_EDGES, "right")) - 1)
        part = slice(lo, hi)
        owner = np.repeat(np.arange(hi - lo), counts[part])
        row, begin, end, where = clipped(*[c[part] for c in plain], within[part], owner, [c[starts[lo] : starts[hi]] for c in edges])
        found.append((row + lo, begin, end, where))
        lo = hi
    row, begin, end, where = (np.concatenate(c) if found else np.empty(0) for c in zip(*found)) if found else [np.empty(0, np.int64)] * 4
    order = np.argsort(row, kind="stable")
    row = row[order].astype(np.int64)
    names = pa.array(_WHERE).take(pa.array(where[order].astype(np.int64)))
    values = pa.StructArray.from_arrays([pa.array(begin[order], pa.float64()), pa.array(end[order], pa.float64()), names], names=["ta", "tb", "where"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32()), values)


# ---- outlines from pieces ------------------------------------------------------------


def _nodes(x, y):
    """A number for each point, the same for points that differ by rounding only."""
    size = max(np.ptp(x), np.ptp(y), 1e-300) * 1e-9
    size = max(size, max(np.abs(x).max(), np.abs(y).max()) * 1e-13)
    node = np.arange(len(x))
    while True:
        before = node.copy()
        for sx in (0.0, 0.5):
            for sy in (0.0, 0.5):
                cell = np.stack([np.floor(x / size + sx), np.floor(y / size + sy)], axis=1)
                _, own = np.unique(cell, axis=0, return_inverse=True)
                own = own.ravel()
                least = np.full(own.max() + 1, len(x))
                np.minimum.at(least, own, node)
                node = np.minimum(node, least[own])
        node = node[node]
        if (node == before).all():
            return node


def _ring_area(ring) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _holds(ring, point) -> bool:
    (x, y), (x1, y1), (x2, y2) = point, ring[:-1].T, ring[1:].T
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return bool(cross.sum() % 2)


def _straight(ring, closed: bool):
    """The ring or line without vertices on a straight stretch, which are left from cuts."""
    keep, n = [], len(ring) - 1 if closed else len(ring)
    for i in range(n):
        if not closed and i in (0, n - 1):
            keep.append(i)
            continue
        a, b, c = ring[i - 1 if i else n - 1], ring[i], ring[(i + 1) % n]
        turn = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        size = np.hypot(*(b - a)) * np.hypot(*(c - b))
        if abs(turn) > 1e-9 * size or (b - a) @ (c - b) < 0:
            keep.append(i)
    out = ring[keep]
    return np.concatenate([out, out[:1]]) if closed and len(out) else out


def strung(shape, seg, ta, sx, sy, ex, ey, closed: bool) -> list[dict]:
    """``parts`` from directed pieces: rings with their inside on the left, shells each followed by its holes; or lines.

    Where several pieces leave a point, a ring goes on with the one that turns most to the left of its way back, so that
    rings that share a point stay apart.
    """
    order = np.lexsort((ta, seg, shape))
    start, end = np.stack([sx, sy], axis=1)[order], np.stack([ex, ey], axis=1)[order]
    every = np.concatenate([start, end])
    node = _nodes(every[:, 0], every[:, 1])
    begin, stop = node[: len(start)], node[len(start) :]
    if not closed:
        lines, now = [], [start[0], end[0]]
        for i in range(1, len(start)):
            if begin[i] == stop[i - 1]:
                now.append(end[i])
            else:
                lines.append(now)
                now = [start[i], end[i]]
        lines.append(now)
        return [{"shell": None, "ring": [{"x": float(x), "y": float(y)} for x, y in _straight(np.array(p), False)]} for p in lines]
    real = begin != stop
    start, end, begin, stop = start[real], end[real], begin[real], stop[real]
    leaving: dict[int, list[int]] = {}
    for i, b in enumerate(begin):
        leaving.setdefault(int(b), []).append(i)
    way = np.arctan2(*(end - start).T[::-1])
    used, rings = np.zeros(len(start), bool), []
    for first in range(len(start)):
        if used[first]:
            continue
        ring, i = [], first
        while not used[i]:
            used[i] = True
            ring.append(start[i])
            back = way[i] + np.pi
            free = [k for k in leaving.get(int(stop[i]), ()) if not used[k] or k == first]
            if not free:
                break
            # The smallest turn clockwise from the way back keeps the inside on the left.
            i = min(free, key=lambda k: ((back - way[k]) % (2 * np.pi)) or 2 * np.pi)
        ring = _straight(np.array([*ring, ring[0]]), True)
        if len(ring) > 3:
            ring = np.roll(ring[:-1], -int(np.lexsort(ring[:-1].T[::-1])[0]), axis=0)  # from its lowest left vertex
            rings.append(np.concatenate([ring, ring[:1]]))
    areas = [_ring_area(r) for r in rings]
    shells = sorted((i for i, a in enumerate(areas) if a > 0), key=lambda i: tuple(rings[i].min(axis=0)))
    holes: dict[int, list[int]] = {}
    for h in (i for i, a in enumerate(areas) if a < 0):
        inside = (rings[h][0] + rings[h][1]) / 2
        own = [s for s in shells if _holds(rings[s], inside)]
        if own:
            holes.setdefault(min(own, key=lambda s: areas[s]), []).append(h)
    listed = [(i, k == 0) for s in shells for k, i in enumerate([s, *sorted(holes.get(s, []), key=lambda i: tuple(rings[i].min(axis=0)))])]
    return [{"shell": shell, "ring": [{"x": float(x), "y": float(y)} for x, y in rings[i]]} for i, shell in listed]


# ---- generalisation ------------------------------------------------------------------


def _thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a ring or line stay."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, b = points[lo], points[hi]
        between = points[lo + 1 : hi]
        base = b - a
        span = base @ base
        at = np.clip(((between - a) @ base) / span, 0, 1) if span else np.zeros(len(between))
        off = np.hypot(*(between - a - at[:, None] * base).T)
        far = int(np.argmax(off))
        if off[far] > tolerance:
            mid = lo + 1 + far
            keep[mid] = True
            todo += [(lo, mid), (mid, hi)]
    return keep


@F.arrow_udf(PARTS)
def simplified(geom: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Rings thinned so that no dropped vertex was further than ``tolerance`` from the result.

    Coordinates stay flat arrays with the offsets of their rings; a ring's own vertices are looked at only.
    """
    rings = geom.flatten()
    lines = rings.field("ring")
    points = lines.flatten()
    xy = np.stack([np.asarray(points.field(c).to_numpy(zero_copy_only=False), float) for c in "xy"], axis=1)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    per_shape = pa.compute.fill_null(pa.compute.list_value_length(geom), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    limits = np.repeat(tolerance.to_numpy(zero_copy_only=False).astype(float), per_shape)
    ends = np.cumsum(sizes)
    keep = np.ones(len(xy), bool)
    for lo, hi, limit in zip(ends - sizes, ends, limits):
        if hi - lo > 2:
            keep[lo:hi] = _thin(xy[lo:hi], limit)
    kept = np.concatenate([[0], np.cumsum(keep)])
    vertices = pa.StructArray.from_arrays([pa.array(xy[keep, 0]), pa.array(xy[keep, 1])], names=["x", "y"])
    ring = pa.ListArray.from_arrays(pa.array(kept[np.concatenate([[0], ends])], pa.int32()), vertices)
    shapes = pa.StructArray.from_arrays([rings.field("shell"), ring], names=["shell", "ring"])
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_shape)]), pa.int32()), shapes)
    return pa.compute.if_else(geom.is_valid(), out, pa.scalar(None, out.type))
