"""Coordinates to nodes: range search in the node index, nearest nodes and nearest edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NodeIndexNotFound
from ..functions import geo

CELL = 0.001  # degrees; about the reach of a 100 m envelope
NARROWEST = 1e-6  # the least cosine of a latitude by which cells widen


def _cells(low: Column, high: Column):
    return F.explode(F.sequence(low, high))


def _column(lon: Column, row: Column) -> Column:
    """The cell of lon in a row of cells. Cells widen towards the poles as envelopes do, so that an envelope
    meets a few of a row's wherever it lies; what is beyond a full turn shares the last cell."""
    wide = F.lit(CELL) / F.greatest(F.abs(F.cos(F.radians(row * CELL))), F.lit(NARROWEST))
    return F.floor(F.greatest(F.least(lon, F.lit(360.0)), F.lit(-360.0)) / wide)


def within_envelope(points: DataFrame, index: DataFrame, metres: float = 100.0) -> DataFrame:
    """points(req_id, lat, lon) joined to the index entries in their envelopes, borders included.

    A point is sent to the grid cells that its envelope meets, an entry to its own: an equi-join. Neither side
    is broadcast, as the points' size is unknown until they are sent to their cells. Beyond a
    pole an envelope's west lies east of its east, and it is empty.
    """
    boxed = points.select("*", *[c.alias(f"_{n}") for n, c in geo.envelope(F.col("lat"), F.col("lon"), metres).items()])
    rows = boxed.where("_min_lon <= _max_lon").withColumn("_cy", _cells(F.floor(F.col("_min_lat") / CELL), F.floor(F.col("_max_lat") / CELL)))
    sent = rows.withColumn("_cx", _cells(_column(F.col("_min_lon"), F.col("_cy")), _column(F.col("_max_lon"), F.col("_cy"))))
    entries = index.select("node_id", F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"), "offset", F.floor(F.col("lat") / CELL).alias("_cy"))
    entries = entries.withColumn("_cx", _column(F.col("node_lon"), F.col("_cy")))
    met = sent.join(entries.hint("merge"), ["_cy", "_cx"])
    inside = F.col("node_lat").between(F.col("_min_lat"), F.col("_max_lat")) & F.col("node_lon").between(F.col("_min_lon"), F.col("_max_lon"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    return met.where(inside).withColumn("km", km).drop("_cx", "_cy", "_min_lat", "_max_lat", "_min_lon", "_max_lon")


def nearest_nodes(points: DataFrame, index: DataFrame, metres: float = 100.0, most: int = 5) -> DataFrame:
    """The most nearest entries of each point, by distance and node_id, with rank from 1."""
    order = Window.partitionBy("req_id").orderBy("km", "node_id")
    return within_envelope(points, index, metres).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest_node(index: DataFrame, lat: float, lon: float, metres: float = 100.0, or_all: bool = False) -> int:
    """The nearest entry's id; NodeIndexNotFound if the envelope is empty, unless all entries then count."""
    one = index.sparkSession.range(1).select(F.col("id").alias("req_id"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    found = nearest_nodes(one, index, metres, 1).select("node_id").collect()
    if not found and or_all:
        km = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
        found = index.select("node_id", km.alias("km")).orderBy("km", "node_id").limit(1).collect()
    if not found:
        raise NodeIndexNotFound(f"no node within {metres} m of {lat},{lon}")
    return found[0]["node_id"]


def by_coordinate(points: DataFrame, index: DataFrame) -> DataFrame:
    """points(req_id, lat, lon) with the node_id and offset of the entry at exactly that key."""
    entries = index.select(geo.pack(F.col("lon") + 1e-9, F.col("lat") + 1e-9).alias("key"), "node_id", "offset")
    return points.withColumn("key", geo.pack(F.col("lon") + 1e-9, F.col("lat") + 1e-9)).join(entries, "key").drop("key")


def offset_by_id(index: DataFrame, node_id: int) -> int:
    found = index.where(F.col("node_id") == node_id).select("offset").collect()
    if not found:
        raise NodeIndexNotFound(f"no node {node_id}")
    return found[0]["offset"]


def snap(points: DataFrame, index: DataFrame, nodes: DataFrame, metres: float = 100.0, most: int = 5) -> DataFrame:
    """(req_id, lat, lon, node_id, km): the candidate whose stored coordinate is nearest.

    Candidates are the most nearest entries of the index; ids without a record are left out.
    Points without a candidate have no row.
    """
    near = nearest_nodes(points, index.join(nodes.where("has_record").select("node_id"), "node_id", "left_semi"), metres, most)
    stored = nodes.select("node_id", F.col("lat").alias("stored_lat"), F.col("lon").alias("stored_lon"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("stored_lat"), F.col("stored_lon"))
    best = near.join(stored, "node_id").select("req_id", "lat", "lon", "node_id", km.alias("km"), "rank")
    return best.groupBy("req_id", "lat", "lon").agg(F.min_by(F.struct("node_id", "km"), F.struct("km", "rank")).alias("n")).select("req_id", "lat", "lon", "n.*")


def nearest_edge(snapped: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(req_id, edge_id, src, dst, km): of the node's outgoing edges that whose end is nearest; none, no row."""
    ends = nodes.select(F.col("node_id").alias("dst"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    out = snapped.select("req_id", "lat", "lon", F.col("node_id").alias("src")).join(edges.select("edge_id", "src", "dst"), "src").join(ends, "dst")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    scored = out.select("req_id", "edge_id", "src", "dst", km.alias("km"))
    return scored.groupBy("req_id").agg(F.min_by(F.struct("edge_id", "src", "dst", "km"), F.struct("km", "edge_id")).alias("e")).select("req_id", "e.*")


def upsert(index: DataFrame, changes: DataFrame) -> DataFrame:
    """index with changes(node_id, lon, lat, offset) put in by id; ValueError, and nothing changed, if one lacks a field."""
    if not changes.where("node_id is null or lon is null or lat is null or offset is null").isEmpty():
        raise ValueError("a change lacks a field")
    cols = ["node_id", "lon", "lat", "offset"]
    return index.select(cols).join(changes.select("node_id"), "node_id", "left_anti").unionByName(changes.select(cols))
