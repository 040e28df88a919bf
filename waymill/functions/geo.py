"""Geometry and road attributes as column expressions; none needs Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
SCALE = 1e7
METRES_PER_DEGREE = 111111.0
LAT_BOUNDS, LON_BOUNDS = (33.0, 43.0), (124.0, 132.0)

# The road classes that carry traffic, the levels above 2, and the gates.
ALLOWED_CLASSES = [
    "motorway", "motorway_link", "primary", "primary_link", "residential", "secondary",
    "secondary_link", "service", "tertiary", "tertiary_link", "trunk", "trunk_link",
]
LEVEL_0 = ["motorway", "motorway_link", "trunk", "trunk_link"]
LEVEL_1 = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]
GATE_CLASSES = ["motorway_link", "primary_link", "trunk_link"]
# Speed in km/h and weight of levels 0, 1, 2.
SPEED_WEIGHT = [(100.0, 0.5), (60.0, 1.0), (30.0, 1.5)]
HEURISTIC_SPEED, HEURISTIC_WEIGHT, NEAR_TARGET = 100.0, 1.5, 0.1


def road_class(fclass: Column) -> Column:
    return F.coalesce(F.trim(F.lower(fclass)), F.lit("unclassified"))


def is_allowed(fclass: Column) -> Column:
    return road_class(fclass).isin(ALLOWED_CLASSES)


def road_level(fclass: Column) -> Column:
    c = road_class(fclass)
    return F.when(c.isin(LEVEL_0), 0).when(c.isin(LEVEL_1), 1).otherwise(2)


def is_gate(fclass: Column) -> Column:
    return road_class(fclass).isin(GATE_CLASSES)


def next_level(level: Column) -> Column:
    """The level below: 0 to 1, 1 to 2, none after 2."""
    return F.when(level == 0, 1).when(level == 1, 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = (F.radians(lat2) - F.radians(lat1)) / 2.0, (F.radians(lon2) - F.radians(lon1)) / 2.0
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return 2.0 * F.lit(EARTH_KM) * F.asin(F.sqrt(a))


def edge_cost(km: Column, level: Column) -> Column:
    (s0, w0), (s1, w1), (s2, w2) = SPEED_WEIGHT
    return F.when(level == 0, km / s0 * w0).when(level == 1, km / s1 * w1).otherwise(km / s2 * w2)


def heuristic_cost(km: Column) -> Column:
    return km / HEURISTIC_SPEED * HEURISTIC_WEIGHT


def is_near_target(km: Column) -> Column:
    return km / HEURISTIC_SPEED <= NEAR_TARGET


def _truncated(degrees: Column) -> Column:
    return (degrees * SCALE).cast("long")


def pack(lon: Column, lat: Column) -> Column:
    """Both coordinates, at 1e-7 degrees and cut toward zero, in one long: lon above lat."""
    return F.shiftleft(_truncated(lon), 32).bitwiseOR(_truncated(lat).bitwiseAND(F.lit(0xFFFFFFFF)))


def packed_lon(key: Column) -> Column:
    return F.shiftright(key, 32) / SCALE


def packed_lat(key: Column) -> Column:
    return F.shiftright(F.shiftleft(key, 32), 32) / SCALE


def pack_with_layer(lon: Column, lat: Column, layer: Column) -> Column:
    """The layer's low 16 bits above the low 48 bits of pack(); no layer, or no number, is 0."""
    number = F.coalesce(layer.try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number.bitwiseAND(F.lit(0xFFFF)), 48).bitwiseOR(pack(lon, lat).bitwiseAND(F.lit((1 << 48) - 1)))


def layer_of(packed: Column) -> Column:
    """The signed layer of pack_with_layer()."""
    return F.shiftright(packed, 48)


def envelope(lat: Column, lon: Column, metres: float) -> dict[str, Column]:
    d_lat = F.lit(metres / METRES_PER_DEGREE)
    d_lon = F.lit(metres) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return {"min_lat": lat - d_lat, "max_lat": lat + d_lat, "min_lon": lon - d_lon, "max_lon": lon + d_lon}


def envelope_wkt(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """The envelope as a closed polygon with 7 decimals."""
    corner = "%.7f %.7f"
    shape = f"POLYGON(({', '.join([corner] * 5)}))"
    return F.format_string(shape, min_lon, min_lat, min_lon, max_lat, max_lon, max_lat, max_lon, min_lat, min_lon, min_lat)


def point_wkt(lat: Column, lon: Column) -> Column:
    return F.format_string("POINT(%.7f %.7f)", lon, lat)


def same_coordinate(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (F.abs(lat1 - lat2) < 1e-7) & (F.abs(lon1 - lon2) < 1e-7)


def nearest_on_line(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """(x, y) of c's unclamped projection on the line a-b, in plane degrees; null if a is b."""
    length = F.pow(bx - ax, F.lit(2)) + F.pow(by - ay, F.lit(2))
    t = ((cx - ax) * (bx - ax) + (cy - ay) * (by - ay)) / F.nullif(length, F.lit(0.0))
    return ax + t * (bx - ax), ay + t * (by - ay)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north, 0 up to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_difference(after: Column, before: Column) -> Column:
    """Over -180 up to 180 degrees."""
    d = after - before
    return F.when(d <= -180, d + 360.0).when(d > 180, d - 360.0).otherwise(d)


def turn(difference: Column) -> Column:
    return F.when(F.abs(difference) <= 30, "STRAIGHT").when(F.abs(difference) >= 150, "U_TURN").when(difference > 0, "RIGHT").otherwise("LEFT")


def round6(x: Column) -> Column:
    return F.round(x, 6)


def manhattan_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.abs(lat1 - lat2) + F.abs(lon1 - lon2)


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(*LAT_BOUNDS) & lon.between(*LON_BOUNDS)


def node_offset(node_id: Column) -> Column:
    return 6 + 24 * node_id.cast("long")


def edge_offset(edge_id: Column) -> Column:
    return 6 + 30 * edge_id.cast("long")


def index_offset(node_id: Column) -> Column:
    return 5 + 46 * node_id.cast("long")


# EPSG:5174, a transverse Mercator on Bessel's ellipsoid, and its shift to WGS 84
# (metres, arc seconds, parts in a million; position vector convention).
TM_LAT, TM_LON, TM_X, TM_Y = 38.0, 127.0028902777778, 200000.0, 500000.0
BESSEL_A, BESSEL_F = 6377397.155, 1 / 299.1528128
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
TM_SHIFT, TM_ROTATION, TM_SCALE = (-115.80, 474.99, 674.11), (1.16, -2.31, -1.63), 6.43


def korean_tm(lat, lon, m=F):
    """(x, y) in EPSG:5174 of WGS 84 degrees on the ellipsoid.

    m has the functions: pyspark's for columns, the module math for numbers.
    """
    phi, lam = m.radians(lat), m.radians(lon)
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / m.sqrt(1 - e2 * m.sin(phi) * m.sin(phi))
    tx, ty, tz = TM_SHIFT
    rx, ry, rz = (math.radians(r / 3600) for r in TM_ROTATION)
    k = 1 + TM_SCALE * 1e-6
    x, y, z = (n * m.cos(phi) * m.cos(lam) - tx) / k, (n * m.cos(phi) * m.sin(lam) - ty) / k, (n * (1 - e2) * m.sin(phi) - tz) / k
    x, y, z = x + rz * y - ry * z, y - rz * x + rx * z, z + ry * x - rx * y
    # To degrees on Bessel's ellipsoid.
    a, b, e2 = BESSEL_A, BESSEL_A * (1 - BESSEL_F), BESSEL_F * (2 - BESSEL_F)
    second = e2 / (1 - e2)
    p = m.sqrt(x * x + y * y)
    theta = m.atan2(z * a, p * b)
    s, c = m.sin(theta), m.cos(theta)
    phi, lam = m.atan2(z + second * b * s * s * s, p - e2 * a * c * c * c), m.atan2(y, x)
    # The projection, by its series in the distance from the central meridian.
    s, c, t = m.sin(phi), m.cos(phi), m.tan(phi)
    n, t2, c2, d = a / m.sqrt(1 - e2 * s * s), t * t, second * c * c, (lam - math.radians(TM_LON)) * c
    d2 = d * d
    terms = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    arc = lambda f, o: a * (terms[0] * f - terms[1] * o.sin(2 * f) + terms[2] * o.sin(4 * f) - terms[3] * o.sin(6 * f))
    east = n * d * (1 + d2 * ((1 - t2 + c2) / 6 + d2 * (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * second) / 120))
    north = n * t * d2 * (0.5 + d2 * ((5 - t2 + 9 * c2 + 4 * c2 * c2) / 24 + d2 * (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * second) / 720))
    return TM_X + east, TM_Y + arc(phi, m) - arc(math.radians(TM_LAT), math) + north
