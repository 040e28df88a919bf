"""Well-known binary against struct."""

import struct

from pyspark.sql import functions as F

from waymill.functions import wkb


def test_points(spark):
    places = [(126.5, 33.25), (-0.0, 1e-300), (5e-324, -1.7976931348623157e308), (0.1, -123456.789), (1.0, 2.0)]
    rows = []
    for x, y in places:
        rows += [(struct.pack("<BIdd", 1, 1, x, y), x, y), (struct.pack(">BIdd", 0, 1, x, y), x, y), (struct.pack("<BIIdd", 1, 0x20000001, 5174, x, y), x, y), (struct.pack(">BIIdd", 0, 0x20000001, 4326, x, y), x, y)]
    bad = [None, b"", b"\1", struct.pack("<BIdd", 1, 2, 1, 2), struct.pack("<BIdd", 7, 1, 1, 2), struct.pack("<BIdd", 1, 1, float("nan"), 2), struct.pack("<BIdd", 1, 1, 1, 2)[:-1], struct.pack("<BIdd", 1, 1, 1, 2) + b"\0"]
    df = spark.createDataFrame([(i, None if r[0] is None else bytearray(r[0]), *r[1:]) for i, r in enumerate(rows + [(b, None, None) for b in bad])], "i int, b binary, x double, y double")
    for r in df.withColumn("p", wkb.point_of(F.col("b"))).withColumn("h", wkb.point_of_hex(F.hex("b"))).collect():
        assert r["p"] == r["h"]
        assert (r["p"] is None) if r["x"] is None else (tuple(r["p"]) == (r["x"], r["y"]))
    back = df.where("x is not null").withColumn("p", wkb.point_of(wkb.to_wkb(F.col("x"), F.col("y")))).collect()
    assert all(tuple(r["p"]) == (r["x"], r["y"]) for r in back)
    assert spark.range(1).select(wkb.to_wkb(F.lit(None), F.lit(1.0))).first()[0] is None
    assert spark.range(1).select(wkb.point_of_hex(F.lit("xyz"))).first()[0] is None
