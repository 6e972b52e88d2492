"""Web Mercator to the national grid as SQL, for the twins of queries that measure in the grid.

The published method step by step: WGS84 degrees, cartesian coordinates, seven-parameter shift, Airy latitude by
iteration, transverse Mercator series.
"""

# Semi-axes (WGS84, Airy 1830), shift (metres, parts per million, seconds), projection constants.
WGS84, AIRY = ("6378137.0e0", "6356752.314245e0"), ("6377563.396e0", "6356256.909e0")
SHIFT, PPM, TURN = ("-446.448e0", "125.157e0", "-542.060e0"), "20.4894e0", ("-0.1502e0", "-0.2470e0", "-0.8421e0")
SCALE, LAT0, LON0, EAST0, NORTH0 = "0.9996012717e0", "radians(49)", "radians(-2)", "400000", "-100000"


def grid_sql(points: str) -> str:
    """WITH terms from ``points`` (id, k, mx, my) to ``grid`` (id, k, east, north)."""
    (wa, wb), (aa, ab) = WGS84, AIRY
    rx, ry, rz = (f"radians({v} / 3600)" for v in TURN)
    we, ae = f"(1 - {wb} * {wb} / ({wa} * {wa}))", f"(1 - {ab} * {ab} / ({aa} * {aa}))"
    nu = f"({aa} / sqrt(1 - {ae} * sin(lat) * sin(lat)))"
    steps = ", ".join(f"t{i + 1} AS (SELECT * REPLACE (atan2(z + {ae} * {nu} * sin(lat), p) AS lat) FROM t{i})" for i in range(6))
    n = f"(({aa} - {ab}) / ({aa} + {ab}))"
    return f"""g0 AS (SELECT id, k, mx / {wa} AS lon, 2 * atan(exp(my / {wa})) - pi() / 2 AS lat FROM {points}),
    g1 AS (SELECT id, k, {wa} / sqrt(1 - {we} * sin(lat) * sin(lat)) AS nu, lon, lat FROM g0),
    g2 AS (SELECT id, k, nu * cos(lat) * cos(lon) AS x, nu * cos(lat) * sin(lon) AS y, (1 - {we}) * nu * sin(lat) AS z FROM g1),
    g3 AS (SELECT id, k, {SHIFT[0]} + (1 + {PPM} * 1e-6) * x - {rz} * y + {ry} * z AS x, {SHIFT[1]} + {rz} * x + (1 + {PPM} * 1e-6) * y - {rx} * z AS y,
      {SHIFT[2]} - {ry} * x + {rx} * y + (1 + {PPM} * 1e-6) * z AS z FROM g2),
    t0 AS (SELECT id, k, z, sqrt(x * x + y * y) AS p, atan2(y, x) - {LON0} AS d, atan2(z, sqrt(x * x + y * y) * (1 - {ae})) AS lat FROM g3), {steps},
    u AS (SELECT id, k, d, lat, sin(lat) AS s, cos(lat) AS c, tan(lat) ** 2 AS q, {aa} * {SCALE} / sqrt(1 - {ae} * sin(lat) ** 2) AS nu,
      {aa} * {SCALE} * (1 - {ae}) / (1 - {ae} * sin(lat) ** 2) ** 1.5 AS rho, lat - {LAT0} AS dl, lat + {LAT0} AS sl FROM t6),
    w AS (SELECT *, nu / rho - 1 AS eta, {ab} * {SCALE} * ((1 + {n} + 1.25 * {n} ** 2 + 1.25 * {n} ** 3) * dl - (3 * {n} + 3 * {n} ** 2 + 2.625 * {n} ** 3) * sin(dl) * cos(sl)
      + 1.875 * ({n} ** 2 + {n} ** 3) * sin(2 * dl) * cos(2 * sl) - 35.0 / 24 * {n} ** 3 * sin(3 * dl) * cos(3 * sl)) AS arc FROM u),
    grid AS (SELECT id, k, {EAST0} + nu * c * d + nu / 6 * c ** 3 * (nu / rho - q) * d ** 3 + nu / 120 * c ** 5 * (5 - 18 * q + q * q + 14 * eta - 58 * q * eta) * d ** 5 AS east,
      arc + {NORTH0} + nu / 2 * s * c * d ** 2 + nu / 24 * s * c ** 3 * (5 - q + 9 * eta) * d ** 4 + nu / 720 * s * c ** 5 * (61 - 58 * q + q * q) * d ** 6 AS north FROM w)"""
