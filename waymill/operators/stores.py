"""Store search: keyword, category and area filters, paging and counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ItemEmpty
from ..functions.geo import korean_tm

OPEN = "영업"  # how the state of an open store starts
LIST_COLUMNS = ["id", "trd_state_nm", "bplc_nm", "uptae_gbn_nm", "rdn_whl_addr", "tel_no", "x", "y", "homepage", "building_id", "center_x", "center_y"]


@dataclass(frozen=True)
class PageRequest:
    """Pages count from 1; 0 and less are the first."""

    page: int = 0
    size: int = 10

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("a page holds one row or more")

    @property
    def index(self) -> int:
        return max(self.page - 1, 0)

    @property
    def offset(self) -> int:
        return self.index * self.size


@dataclass(frozen=True)
class Page:
    content: DataFrame
    total_elements: int
    request: PageRequest

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total_elements / self.request.size)

    @property
    def current_page(self) -> int:
        return self.request.index + 1


def like_pattern(text: str) -> str:
    """A pattern whose backslashes mean what PostgreSQL takes them for: the next character as it is."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text) and text[at + 1] not in "%_\\":
            at += 1  # an escaped plain character is that character
        elif text[at] == "\\" and at + 1 < len(text):
            out.append(text[at])
            at += 1
        elif text[at] == "\\":
            out.append("\\")
        out.append(text[at])
        at += 1
    return "".join(out)


def inside_quad(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether (x, y) lies in the convex quadrilateral of corners, in ring order, its border included.

    The bounding rectangle comes first, as comparisons that reach the Parquet scan.
    """
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1]))
    ring = corners if area >= 0 else corners[::-1]
    test = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        test = test & (F.lit(bx - ax) * (y - ay) - F.lit(by - ay) * (x - ax) >= 0)
    return test


def projected_corners(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> list[tuple[float, float]]:
    """The corners of an area in degrees, in the stores' CRS: reprojected, it is a quadrilateral."""
    ring = [(min_lat, min_lon), (min_lat, max_lon), (max_lat, max_lon), (max_lat, min_lon)]
    return [korean_tm(lat, lon, math) for lat, lon in ring]


class Stores:
    """Queries over food_store and building_info, joined on building_id = ogc_fid."""

    def __init__(self, food_store: DataFrame, building_info: DataFrame):
        self.food_store, self.building_info = food_store, building_info

    def _open(self) -> DataFrame:
        return self.food_store.where(F.col("trd_state_nm").startswith(OPEN))

    def _joined(self, stores: DataFrame) -> DataFrame:
        return stores.join(self.building_info, stores["building_id"] == self.building_info["ogc_fid"])

    def _page(self, rows: DataFrame, page: PageRequest) -> DataFrame:
        return rows.orderBy("id").offset(page.offset).limit(page.size)

    def count_all(self) -> int:
        """All stores, joined or not, open or not."""
        return self.food_store.count()

    def rows_by_id(self, store_id: int) -> DataFrame:
        return self._joined(self.food_store.where(F.col("id") == store_id)).select(self.food_store.columns)

    def by_id(self, store_id: int):
        """The store's row, whatever its state; ItemEmpty if there is none."""
        found = self.rows_by_id(store_id).limit(1).collect()
        if not found:
            raise ItemEmpty(f"store {store_id}")
        return found[0]

    def select_all(self, page: PageRequest = PageRequest()) -> DataFrame:
        """A page of open stores by id."""
        return self._page(self._joined(self._open()).select(self.food_store.columns), page)

    def matching(self, keyword: str | None = None, category: str | None = None, corners: list[tuple[float, float]] | None = None, bbox: tuple | None = None) -> DataFrame:
        """Open stores that meet the criteria given; blank ones don't filter.

        corners: of the area, in the stores' CRS. bbox: (min_lat, min_lon, max_lat, max_lon) in WGS 84
        degrees, whose four corners are reprojected; it doesn't filter unless it is whole.
        """
        rows = self._open()
        if bbox and all(v is not None for v in bbox):
            rows = rows.where(inside_quad(F.col("x"), F.col("y"), projected_corners(*bbox)))
        if keyword:
            rows = rows.where(F.col("bplc_nm").like(f"%{like_pattern(keyword)}%"))
        if category:
            rows = rows.where(F.col("uptae_gbn_nm") == category)
        if corners:
            rows = rows.where(inside_quad(F.col("x"), F.col("y"), corners))
        joined = self._joined(rows)
        return joined.select([c for c in LIST_COLUMNS if c in joined.columns])

    def search_rows(self, page: PageRequest = PageRequest(), **criteria) -> DataFrame:
        return self._page(self.matching(**criteria), page)

    def count(self, **criteria) -> int:
        return self.matching(**criteria).count()

    def search(self, page: PageRequest = PageRequest(), **criteria) -> Page:
        """A page and the number of all matches; ItemEmpty for an empty page, also past the last."""
        content = self.search_rows(page, **criteria)
        if content.isEmpty():
            raise ItemEmpty("no store on this page")
        return Page(content, self.count(**criteria), page)
