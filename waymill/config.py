"""Configuration of graph building and search."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass


class CacheMode(enum.Enum):
    """What a search keeps of the graph: exact costs, or level 0 costs in single precision."""

    INDEX_ONLY = "INDEX_ONLY"
    EDGE = "EDGE"

    @classmethod
    def parse(cls, text: str | None) -> "CacheMode":
        name = re.sub(r"[-\s]", "_", (text or "").strip()).upper()
        if name in ("", "INDEX", "INDEX_ONLY"):
            return cls.INDEX_ONLY
        if name in ("EDGE", "EDGE_DATA", "INDEX_AND_EDGE", "INDEX_EDGE"):
            return cls.EDGE
        raise ValueError(f"unknown cache mode {text!r}")


@dataclass(frozen=True)
class RouteConfig:
    """Search settings: snapping distance, candidates, cache mode, the most edges and bytes to broadcast,
    requests that a task answers, and nodes whose edges are packed together."""

    snap_metres: float = 100.0
    snap_candidates: int = 5
    cache_mode: CacheMode = CacheMode.INDEX_ONLY
    broadcast_edges: int = 50_000_000
    broadcast_bytes: int = 1 << 30
    requests_per_task: int = 64
    nodes_per_range: int = 1 << 16
