"""Origin-destination strings: `lat/lon|lat/lon`, and single `lat,lon` coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidCoordinate
from .geo import in_bounds


def parse_coordinate(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of `lat,lon`; null where a part is missing or no number."""
    parts = F.split(text, ",")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def parse_requests(requests: DataFrame, column: str = "od") -> DataFrame:
    """requests with start_lat, start_lon, end_lat, end_lon and valid.

    Only the start is held to the bounds, as the service does; both ends must be there and
    be numbers. Coordinates of an invalid request are null.
    """
    ends = F.split(F.col(column), r"\|")
    of = lambda end, i: F.get(F.split(F.get(ends, F.lit(end)), "/"), F.lit(i)).try_cast("double")
    parts = {"start_lat": of(0, 0), "start_lon": of(0, 1), "end_lat": of(1, 0), "end_lon": of(1, 1)}
    whole = (F.size(ends) == 2) & in_bounds(parts["start_lat"], parts["start_lon"]) & parts["end_lat"].isNotNull() & parts["end_lon"].isNotNull()
    valid = F.coalesce(whole, F.lit(False))
    return requests.select("*", *[F.when(valid, c).alias(name) for name, c in parts.items()], valid.alias("valid"))


def parse_list(text: str) -> list[tuple[float, float, float, float]]:
    """Requests of one comma-separated list; InvalidCoordinate if any is malformed or out of bounds."""
    found = []
    for item in text.split(","):
        try:
            (a, b), (c, d) = (map(float, end.split("/")) for end in item.split("|"))
        except ValueError as e:
            raise InvalidCoordinate(item) from e
        if not (33 <= a <= 43 and 124 <= b <= 132):
            raise InvalidCoordinate(item)
        found.append((a, b, c, d))
    return found
