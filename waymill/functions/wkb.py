"""Points as well-known binary, plain or with an SRID, in either byte order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SRID_FLAG, POINT = 0x20000000, 1  # fixed values of the format
RECORD = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _bytes(hexed: Column, start: int, count: int, little: Column) -> Column:
    """count bytes from byte start on as hex digits, the most significant first."""
    parts = [F.substring(hexed, 2 * (start + i) + 1, 2) for i in range(count)]
    return F.when(little, F.concat(*parts[::-1])).otherwise(F.concat(*parts))


def _double(digits: Column) -> Column:
    """The number of 16 hex digits of an IEEE double; null if it isn't finite."""
    high, low = _number(F.substring(digits, 1, 8)), _number(F.substring(digits, 9, 8))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    mantissa = (high.bitwiseAND(F.lit(0xFFFFF)) * (1 << 32) + low).cast("double")
    sign = F.when(F.shiftright(high, 31) == 1, -1.0).otherwise(1.0)
    size = F.when(exponent == 0, mantissa * 2.0**-1074).when(exponent < 0x7FF, (1.0 + mantissa / 2.0**52) * F.pow(F.lit(2.0), exponent - 1023))
    return sign * size


def point_of(wkb: Column) -> Column:
    """struct(x, y) of a binary point; null if it is null, empty, malformed, or another shape."""
    hexed = F.hex(wkb)
    little = F.substring(hexed, 1, 2) == "01"
    known = little | (F.substring(hexed, 1, 2) == "00")
    kind = _number(_bytes(hexed, 1, 4, little))
    plain, with_srid = (kind == POINT) & (F.length(hexed) == 42), (kind == SRID_FLAG + POINT) & (F.length(hexed) == 50)
    at = lambda start: F.when(plain, _double(_bytes(hexed, start, 8, little))).otherwise(_double(_bytes(hexed, start + 4, 8, little)))
    x, y = at(5), at(13)
    return F.when(known & (plain | with_srid) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def point_of_hex(text: Column) -> Column:
    """point_of() of hex digits; null if they are no hex digits."""
    return point_of(F.when(text.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(text)))


@F.pandas_udf(BinaryType())
def _packed(x: pd.Series, y: pd.Series) -> pd.Series:
    points = np.empty(len(x), RECORD)
    points["order"], points["kind"], points["x"], points["y"] = 1, POINT, x, y
    raw, size = points.tobytes(), RECORD.itemsize
    whole = [raw[at : at + size] for at in range(0, len(raw), size)]
    return pd.Series(whole, dtype=object).where((x.notna() & y.notna()).to_numpy(), None)


def to_wkb(x: Column, y: Column) -> Column:
    """A little-endian point; null if a coordinate is."""
    return _packed(x.cast("double"), y.cast("double"))
