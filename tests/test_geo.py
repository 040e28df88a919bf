"""Scalar functions against plain Python."""

import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymill.config import CacheMode
from waymill.errors import InvalidCoordinate
from waymill.functions import geo
from waymill.functions.od import parse_coordinate, parse_list, parse_requests
from waymill.operators.guidance import turn_steps
from waymill.operators.stores import PageRequest, like_pattern


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_pack_round_trips_for_all_signs(spark):
    for lon, lat in [(126.5, 33.25), (-126.5, 33.25), (126.5, -33.25), (-0.0000001, -0.0000001), (0.0, 0.0)]:
        key = geo.pack(F.lit(lon), F.lit(lat))
        got = one(spark, lon=geo.packed_lon(key), lat=geo.packed_lat(key))
        assert got["lon"] == pytest.approx(int(lon * 1e7) / 1e7) and got["lat"] == pytest.approx(int(lat * 1e7) / 1e7)


def test_layer(spark):
    for text, want in [("3", 3), ("-2", -2), (None, 0), ("x", 0)]:
        packed = geo.pack_with_layer(F.lit(127.0), F.lit(37.0), F.lit(text).cast("string"))
        assert one(spark, x=geo.layer_of(packed))["x"] == want


def test_levels_and_gates(spark):
    levels = {"motorway": 0, "Trunk_Link": 0, " primary ": 1, "tertiary_link": 1, "residential": 2, "path": 2, None: 2}
    for c, want in levels.items():
        assert one(spark, x=geo.road_level(F.lit(c).cast("string")))["x"] == want
    for c, want in {"motorway": True, "service": True, "unknown_type": False, None: False}.items():
        assert one(spark, x=geo.is_allowed(F.lit(c).cast("string")))["x"] == want
    assert [one(spark, x=geo.next_level(F.lit(k)))["x"] for k in range(3)] == [1, 2, None]


def test_turns(spark):
    def turn(*places):
        path = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(places)], "req_id int, step int, lat double, lon double")
        return [r["turn"] for r in turn_steps(path).orderBy("step").collect()]

    assert turn((0, 0), (1, 0), (2, 0))[1] == "STRAIGHT"
    assert turn((0, 0), (1, 0), (1, 1)) == ["START", "RIGHT", "END"]
    assert turn((0, 0), (1, 0), (1, -1))[1] == "LEFT"
    assert turn((0, 0), (1, 0), (0, 0))[1] == "U_TURN"
    assert turn((0, 0), (1, 1), (2, 2), (3, 3)) == ["START", "STRAIGHT", "STRAIGHT", "END"]
    assert turn((5, 5)) == ["START"]


def test_nearest_on_line_of_a_point_is_null(spark):
    x, y = geo.nearest_on_line(*[F.lit(v) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 2.0)])
    assert one(spark, x=x, y=y)["x"] is None
    x, y = geo.nearest_on_line(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 2.0, 5.0)])
    assert tuple(one(spark, x=x, y=y)) == (2.0, 0.0)


def test_requests_as_text(spark):
    texts = ["33.4824388/126.4898217|33.4845859/126.4963428", "33.4824388-126.4898217|33.4845859/126.4963428", "33.2417782/126.5647375", "126.4824388/33.4898217|33.4845859/126.4963428", "33.5/126.5|99/200", None]
    rows = parse_requests(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, od string")).orderBy("id").collect()
    assert [r["valid"] for r in rows] == [True, False, False, False, True, False]
    assert rows[0]["end_lon"] == 126.4963428 and rows[1]["start_lat"] is None
    assert parse_list(texts[0]) == [(33.4824388, 126.4898217, 33.4845859, 126.4963428)]
    for t in texts[1:4]:
        with pytest.raises(InvalidCoordinate):
            parse_list(t)
    lat, lon = parse_coordinate(F.lit("33.5,126.5"))
    assert tuple(one(spark, a=lat, b=lon)) == (33.5, 126.5)


def test_cache_modes():
    for text in ("edge", "EDGE-DATA", "index and edge", " Index_Edge "):
        assert CacheMode.parse(text) is CacheMode.EDGE
    for text in (None, "", "index", "index-only"):
        assert CacheMode.parse(text) is CacheMode.INDEX_ONLY
    with pytest.raises(ValueError):
        CacheMode.parse("all")


def test_pages_and_patterns():
    assert [(PageRequest(p, 10).index, PageRequest(p, 10).offset) for p in (-1, 0, 1, 3)] == [(0, 0), (0, 0), (0, 0), (2, 20)]
    with pytest.raises(ValueError):
        PageRequest(1, 0)
    assert like_pattern(r"a\bc\%\\d_" + "\\") == r"abc\%\\d_" + "\\\\"


@given(st.floats(-80, 80), st.floats(-179, 179), st.floats(-80, 80), st.floats(-179, 179))
def test_network_distance_is_symmetric(a, b, c, d):
    import numpy as np

    from waymill.operators.search import Network

    net = Network(np.array([b, d]), np.array([a, c]), ())
    assert net.km(0, 1) == pytest.approx(net.km(1, 0)) and 0 <= net.km(0, 1) <= math.pi * 6371


def test_envelope(spark):
    box = one(spark, **geo.envelope(F.lit(60.0), F.lit(10.0), 111111.0))
    assert box["max_lat"] == pytest.approx(61) and box["max_lon"] == pytest.approx(12)


def test_shapefile(spark, tmp_path):
    lines = [[(127.0, 37.0), (127.1, 37.1)], [(127.1, 37.1), (127.2, 37.2), (127.3, 37.2)]]
    attributes = [("11", "motorway", "B", "100"), ("12", "", "F", "")]
    shp, shx = b"", b""
    for i, line in enumerate(lines):
        flat = [v for p in line for v in p]
        content = struct.pack("<i4d2ii", 3, 0, 0, 0, 0, 1, len(line), 0) + struct.pack(f"<{len(flat)}d", *flat)
        shx += struct.pack(">ii", (100 + len(shp)) // 2, len(content) // 2)
        shp += struct.pack(">ii", i + 1, len(content) // 2) + content
    (tmp_path / "roads.shp").write_bytes(b"\0" * 100 + shp)
    (tmp_path / "roads.shx").write_bytes(b"\0" * 100 + shx)
    fields = [("osm_id", b"N", 10), ("fclass", b"C", 12), ("oneway", b"C", 1), ("maxspeed", b"N", 3)]
    head = b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields) + b"\r"
    size = 1 + sum(w for _, _, w in fields)
    rows = b"".join(b" " + b"".join(v.encode().ljust(w) for v, (_, _, w) in zip(a, fields)) for a in attributes)
    (tmp_path / "roads.dbf").write_bytes(struct.pack("<4xIHH20x", len(lines), 32 + len(head), size) + head + rows)
    from waymill.sources.shapefile import ShapefileSource

    spark.dataSource.register(ShapefileSource)
    got = spark.read.format("shapefile").load(str(tmp_path / "roads.shp")).orderBy("osm_id").collect()
    assert [(r["osm_id"], r["fclass"], r["oneway"], r["maxspeed"], [tuple(p) for p in r["geometry"]]) for r in got] == [
        (11, "motorway", "B", 100, lines[0]),
        (12, None, "F", None, lines[1]),
    ]
    with pytest.raises(Exception, match="roads2"):
        spark.read.format("shapefile").load(str(tmp_path / "roads2.shp")).collect()


def test_korean_tm():
    import math

    x0, y0 = geo.korean_tm(38.0, 127.0, math)
    # A minute of arc further is as far on the map as on the ground.
    for lat, lon, km in ((38.0 + 1 / 60, 127.0, 111.0 / 60), (38.0, 127.0 + 1 / 60, 87.8 / 60)):
        x, y = geo.korean_tm(lat, lon, math)
        assert math.hypot(x - x0, y - y0) == pytest.approx(1000 * km, rel=2e-3)
    # The origin lies about ten seconds north of 38 degrees and three seconds east of 127.
    assert x0 == pytest.approx(200000 - (0.0028902777778 - 7.5 / 3600) * 87800, abs=60) and y0 == pytest.approx(500000 - 10.1 / 3600 * 111000, abs=60)
    # Seoul's city hall.
    x, y = geo.korean_tm(37.566535, 126.977969, math)
    assert (x, y) == pytest.approx((197_980, 451_590), abs=120)


def test_korean_tm_of_columns(spark):
    import math

    points = [(33.0, 124.0), (37.5, 127.0), (38.9, 131.9)]
    df = spark.createDataFrame(points, "lat double, lon double")
    x, y = geo.korean_tm(F.col("lat"), F.col("lon"))
    got = [tuple(r) for r in df.select(x, y).collect()]
    assert got == [pytest.approx(geo.korean_tm(*p, math), abs=1e-6) for p in points]


def test_an_area_is_whole_or_none():
    from waymill.operators.stores import projected_corners

    corners = projected_corners(37.0, 127.0, 38.0, 128.0)
    assert len(corners) == 4 and corners[0][0] != corners[3][0] and corners[0][1] < corners[3][1]
