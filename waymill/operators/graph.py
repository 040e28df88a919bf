"""Graph building: features to vertices, nodes, directed edges, layouts and adjacency.

A feature is (osm_id long, fclass string, oneway string, maxspeed int, geometry
array<struct<x double, y double>>); features are numbered by osm_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExtractionFailed
from ..functions import geo
from ..functions.sequence import dense_number, running_sum

KEY_RANGE_BITS = 42  # a range of packed keys is 1024 units of longitude wide
FEATURES_PER_RANGE = 4096
NODES_PER_RANGE = 4096


def vertices(features: DataFrame) -> DataFrame:
    """One row a vertex of any feature: osm_id, seq, x, y, coord_key, fclass."""
    v = features.select("osm_id", "fclass", F.posexplode("geometry").alias("seq", "p"))
    return v.select("osm_id", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"), geo.pack(F.col("p.x"), F.col("p.y")).alias("coord_key"), "fclass")


def node_ids(vertices: DataFrame, phantom_zero: bool = False) -> DataFrame:
    """(coord_key, node_id): dense ids from 0 of the distinct keys, in ascending order.

    Vertices of all features count, also of classes that carry no traffic. phantom_zero adds
    a node at key 0, as an id array with unused slots does.
    """
    keys = vertices.select("coord_key").distinct()
    if phantom_zero:
        keys = keys.unionByName(keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("coord_key"))).distinct()
    return dense_number(keys, F.shiftright("coord_key", KEY_RANGE_BITS), ["coord_key"], "node_id")


def nodes(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, coord_key, lon, lat, has_record): a row an id.

    lon and lat are those of the first vertex of an allowed feature, by (osm_id, seq); an id
    without one has no record, and the coordinates decoded from its key.
    """
    allowed = vertices.where(geo.is_allowed(F.col("fclass")))
    first = allowed.groupBy("coord_key").agg(F.min_by(F.struct("x", "y"), F.struct("osm_id", "seq")).alias("p"))
    return ids.join(first, "coord_key", "left").select(
        "node_id",
        "coord_key",
        F.coalesce("p.x", geo.packed_lon(F.col("coord_key"))).alias("lon"),
        F.coalesce("p.y", geo.packed_lat(F.col("coord_key"))).alias("lat"),
        F.col("p").isNotNull().alias("has_record"),
    )


def segments(features: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of allowed features, with length and level."""
    g = F.col("geometry")
    pairs = F.when(F.size(g) > 1, F.arrays_zip(F.slice(g, 1, F.size(g) - 1).alias("a"), F.slice(g, 2, F.size(g) - 1).alias("b"))).otherwise(F.array())
    s = features.where(geo.is_allowed(F.col("fclass"))).select("osm_id", "fclass", "oneway", "maxspeed", F.posexplode(pairs).alias("seq", "s"))
    x1, y1, x2, y2 = (F.col(c) for c in ("s.a.x", "s.a.y", "s.b.x", "s.b.y"))
    return s.select(
        "osm_id", "seq", "oneway", F.col("maxspeed").alias("speed"), geo.road_level(F.col("fclass")).alias("road_level"),
        geo.pack(x1, y1).alias("key1"), geo.pack(x2, y2).alias("key2"), geo.haversine_km(y1, x1, y2, x2).alias("distance_km"),
    )


def directed(segments: DataFrame) -> DataFrame:
    """Each segment once a direction it may be driven in: F forward, T backward, all else both; dir 0 is forward."""
    way = F.col("oneway")
    dirs = F.when(way == "F", F.array(F.lit(0))).when(way == "T", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    d = segments.select("*", F.explode(dirs).alias("dir"))
    forward = F.col("dir") == 0
    return d.select(
        "osm_id", "seq", "dir", F.when(forward, F.col("key1")).otherwise(F.col("key2")).alias("src_key"),
        F.when(forward, F.col("key2")).otherwise(F.col("key1")).alias("dst_key"), "distance_km", "speed", "road_level",
    )


def check_features(features: DataFrame) -> None:
    """ExtractionFailed if an allowed feature lacks oneway or maxspeed: no edge is built then."""
    bad = features.where(geo.is_allowed(F.col("fclass")) & (F.size("geometry") > 1) & (F.col("oneway").isNull() | F.col("maxspeed").isNull()))
    first = bad.select("osm_id").limit(1).collect()
    if first:
        raise ExtractionFailed(f"feature {first[0][0]} lacks oneway or maxspeed")


def edges(features: DataFrame, ids: DataFrame) -> DataFrame:
    """(edge_id, src, dst, distance_km, speed, road_level, cost), ids by feature, segment and direction.

    Parallel edges, self loops and duplicates all stay.
    """
    # Numbered before the joins, which neither add nor drop rows: numbering reads its input twice.
    d = dense_number(directed(segments(features)), F.floor(F.col("osm_id") / FEATURES_PER_RANGE), ["osm_id", "seq", "dir"], "edge_id")
    src = ids.select(F.col("coord_key").alias("src_key"), F.col("node_id").alias("src"))
    dst = ids.select(F.col("coord_key").alias("dst_key"), F.col("node_id").alias("dst"))
    named = d.join(src, "src_key").join(dst, "dst_key").withColumn("cost", geo.edge_cost(F.col("distance_km"), F.col("road_level")))
    return named.select("edge_id", "src", "dst", "distance_km", "speed", "road_level", "cost")


def forward_layout(edges: DataFrame) -> DataFrame:
    return edges.repartitionByRange("src").sortWithinPartitions("src", "road_level", "edge_id")


def reverse_layout(edges: DataFrame) -> DataFrame:
    return edges.repartitionByRange("dst").sortWithinPartitions("dst", "road_level", "edge_id")


def adjacency(edges: DataFrame, end: str = "src") -> DataFrame:
    """(node_id, start_0, count_0, ... count_2): where a node's edges of a level stand in the layout by end.

    A level without edges has start -1 and count 0; nodes without edges have no row.
    """
    counts = edges.groupBy(end, "road_level").agg(F.count("*").alias("n"))
    placed = running_sum(counts, F.floor(F.col(end) / NODES_PER_RANGE), [end, "road_level"], F.col("n"), "start")
    cells = []
    for level in range(3):
        here = F.col("road_level") == level
        cells += [F.coalesce(F.max(F.when(here, F.col("start"))), F.lit(-1)).alias(f"start_{level}"), F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"count_{level}")]
    return placed.groupBy(F.col(end).alias("node_id")).agg(*cells)


def node_index(ids: DataFrame) -> DataFrame:
    """(node_id, lon, lat, offset) of every id, coordinates decoded from the key."""
    key = F.col("coord_key")
    return ids.select("node_id", geo.packed_lon(key).alias("lon"), geo.packed_lat(key).alias("lat"), geo.node_offset(F.col("node_id")).alias("offset"))


def node_index_csv_rows(index: DataFrame) -> DataFrame:
    """(node_id, line): `nodeId,x,y,offset` with 7 decimals."""
    return index.select("node_id", F.format_string("%d,%.7f,%.7f,%d", F.col("node_id"), F.col("lon"), F.col("lat"), F.col("offset")).alias("line"))


def cache_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, edges of level 0, and the nodes that level 0 edges touch."""
    hot = edges.where("road_level = 0")
    ends = hot.select(F.explode(F.array("src", "dst")).alias("n"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(hot.agg(F.count("*").alias("hot_edges"))).crossJoin(ends.agg(F.count_distinct("n").alias("hot_nodes")))


def edges_at_level(edges: DataFrame, level: int, with_next: bool = False, end: str = "src") -> DataFrame:
    """Edges of one level by node, with those of the level below too if with_next."""
    levels = [level, level + 1] if with_next and level < 2 else [level]
    return edges.where(F.col("road_level").isin(levels)).select(F.col(end).alias("node_id"), "edge_id", "road_level")


@dataclass(frozen=True)
class Graph:
    """The tables of one road graph."""

    nodes: DataFrame
    edges: DataFrame
    index: DataFrame


def build(features: DataFrame, phantom_zero: bool = False, check: bool = True) -> Graph:
    """The graph of features; ExtractionFailed if check finds one without oneway or maxspeed."""
    if check:
        check_features(features)
    v = vertices(features)
    ids = node_ids(v, phantom_zero)
    return Graph(nodes(v, ids), edges(features, ids), node_index(ids))


