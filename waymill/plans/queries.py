"""Registered queries over the derived road network, each with its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.od import parse_requests
from ..operators import exact, guidance, search, snap
from ..operators import graph as g
from ..operators.stores import PageRequest, Stores
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUAD = [(200350.0, 500150.0), (201950.0, 500450.0), (201750.0, 502650.0), (200150.0, 502250.0)]
KEYWORD, CATEGORY = "7", "BUILDING"
BBOX = (38.004, 127.003, 38.026, 127.022)  # degrees: min_lat, min_lon, max_lat, max_lon


def query(sql: str | None = None, base: str = "roads"):
    """Register a query; sql goes after the common table expressions of base."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            tables = {"roads": fx.ROADS_SQL, "stores": fx.STORES_SQL}[base]
            ORACLE_SQL[f.__name__] = f"WITH {tables} {sql}"
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_KEPT: list = []  # the network that is kept: its key, its tables, its graph, its files once they are asked for


class Net:
    """The derived network's tables, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.features = fx.features(spark, sf_dir)
        self.vertices = g.vertices(self.features)

    @property
    def ids(self) -> DataFrame:
        return g.node_ids(self.vertices)

    @property
    def edges(self) -> DataFrame:
        return g.edges(self.features, self.ids)

    @property
    def nodes(self) -> DataFrame:
        return g.nodes(self.vertices, self.ids)

    @property
    def index(self) -> DataFrame:
        return g.node_index(self.ids)

    @property
    def graph(self) -> g.Graph:
        """All three tables, kept once made: a search reads each of them several times. One network is kept;
        asking for another releases it."""
        key = self.spark.sparkContext.applicationId, self.sf_dir
        if not _KEPT or _KEPT[0] != key:
            if _KEPT and _KEPT[0][0] == key[0]:
                for table in _KEPT[1]:
                    table.unpersist()
            ids = self.ids.persist()
            tables = g.nodes(self.vertices, ids).persist(), g.edges(self.features, ids).persist(), g.node_index(ids).persist()
            _KEPT[:] = [key, [ids, *tables], g.Graph(*tables)]
        return _KEPT[2]

    @property
    def network(self) -> search.MappedNetwork:
        """The graph's arrays for searches, as files, kept with it."""
        graph = self.graph
        if len(_KEPT) < 4:
            _KEPT.append(search.filed_network(graph))
        return _KEPT[3]

    @property
    def resolved(self) -> DataFrame:
        """The requests' nodes, snapped once and kept with the network: queries read them several times."""
        graph = self.graph
        kept = [t for t in _KEPT[1] if "start_node" in t.columns]
        if not kept:
            kept = [search.resolve(fx.requests(self.spark, self.sf_dir), graph).persist()]
            _KEPT[1].extend(kept)
        return kept[0]

    @property
    def points(self) -> DataFrame:
        return search.ends(fx.requests(self.spark, self.sf_dir))


# -- features, vertices, scalar functions


@query("SELECT fclass, count(*) AS n FROM ends WHERE fclass <> 'footway' GROUP BY fclass")
def road_type_filter(spark, sf_dir):
    f = Net(spark, sf_dir).features
    return f.where(geo.is_allowed(F.col("fclass"))).groupBy("fclass").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(CASE osm_id % 5 WHEN 0 THEN NULL WHEN 1 THEN fclass ELSE lower(fclass) END, 'unclassified') AS fclass, count(*) AS n
    FROM ends GROUP BY 1""")
def road_class_normalise(spark, sf_dir):
    shouted = F.when(F.col("osm_id") % 5 == 0, None).when(F.col("osm_id") % 5 == 1, F.concat(F.lit("  "), F.upper("fclass"), F.lit(" "))).otherwise(F.col("fclass"))
    return Net(spark, sf_dir).features.select(geo.road_class(shouted).alias("fclass")).groupBy("fclass").agg(F.count("*").alias("n"))


@query("""SELECT osm_id, CASE WHEN fclass = 'motorway' THEN 0 WHEN fclass IN ('primary', 'secondary') THEN 1 ELSE 2 END AS road_level FROM ends""")
def road_level_classify(spark, sf_dir):
    return Net(spark, sf_dir).features.select("osm_id", geo.road_level(F.col("fclass")).alias("road_level"))


@query("""SELECT osm_id, fclass IN ('motorway', 'primary') AND maxspeed >= 80 AS is_gate FROM ends""")
def gate_flag(spark, sf_dir):
    linked = F.when(F.col("maxspeed") >= 80, F.concat("fclass", F.lit("_link"))).otherwise(F.col("fclass"))
    return Net(spark, sf_dir).features.select("osm_id", geo.is_gate(linked).alias("is_gate"))


@query("""SELECT 0 AS road_level, 1 AS below UNION ALL SELECT 1, 2 UNION ALL SELECT 2, NULL""")
def next_road_level(spark, sf_dir):
    levels = spark.range(3).select(F.col("id").cast("int").alias("road_level"))
    return levels.select("road_level", geo.next_level(F.col("road_level")).alias("below"))


@query("SELECT osm_id, seq, coord_key FROM keyed")
def coord_pack(spark, sf_dir):
    return Net(spark, sf_dir).vertices.select("osm_id", "seq", "coord_key")


@query("""SELECT osm_id, seq, round(-lonk / 1e7, 7) AS lon, round(-latk / 1e7, 7) AS lat FROM keyed""")
def coord_unpack(spark, sf_dir):
    v = Net(spark, sf_dir).vertices.withColumn("key", geo.pack(-F.col("x"), -F.col("y")))
    return v.select("osm_id", "seq", F.round(geo.packed_lon(F.col("key")), 7).alias("lon"), F.round(geo.packed_lat(F.col("key")), 7).alias("lat"))


@query("""SELECT osm_id, seq, CASE WHEN osm_id % 4 = 3 THEN 0 ELSE osm_id % 7 - 3 END AS layer,
    coord_key & 281474976710655 AS low FROM keyed""")
def coord_layer_pack(spark, sf_dir):
    layer = F.when(F.col("osm_id") % 4 == 3, "none").otherwise((F.col("osm_id") % 7 - 3).cast("string"))
    v = Net(spark, sf_dir).vertices.withColumn("packed", geo.pack_with_layer(F.col("x"), F.col("y"), layer))
    return v.select("osm_id", "seq", geo.layer_of(F.col("packed")).alias("layer"), F.col("packed").bitwiseAND(F.lit((1 << 48) - 1)).alias("low"))


@query("SELECT osm_id, seq, round(x, 7) AS x, round(y, 7) AS y FROM road_vertex")
def vertex_explode(spark, sf_dir):
    return Net(spark, sf_dir).vertices.select("osm_id", "seq", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query("SELECT coord_key, node_id FROM node_ids")
def node_ids(spark, sf_dir):
    return Net(spark, sf_dir).ids


@query("SELECT node_id, coord_key, round(lon, 7) AS lon, round(lat, 7) AS lat, has_record FROM nodes")
def node_build(spark, sf_dir):
    return Net(spark, sf_dir).nodes.select("node_id", "coord_key", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "has_record")


@query("SELECT node_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM nodes")
def node_record_read(spark, sf_dir):
    return Net(spark, sf_dir).nodes.select("node_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("SELECT osm_id, seq, key1, key2, round(km, 6) AS km FROM segments")
def segmentize(spark, sf_dir):
    return g.segments(Net(spark, sf_dir).features).select("osm_id", "seq", "key1", "key2", r6("distance_km").alias("km"))


@query("SELECT osm_id, seq, dir, src_key, dst_key FROM two_way")
def direction_expand(spark, sf_dir):
    return g.directed(g.segments(Net(spark, sf_dir).features)).select("osm_id", "seq", "dir", "src_key", "dst_key")


@query("SELECT edge_id, src, dst, round(km, 6) AS km, speed, road_level FROM edges")
def edge_build(spark, sf_dir):
    return Net(spark, sf_dir).edges.select("edge_id", "src", "dst", r6("distance_km").alias("km"), "speed", "road_level")


@query("SELECT road_level, count(*) AS n, round(sum(cost), 6) AS cost FROM edges GROUP BY road_level")
def edge_cost(spark, sf_dir):
    return Net(spark, sf_dir).edges.groupBy("road_level").agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("cost"))


@query("SELECT edge_id, speed FROM edges")
def edge_field_view(spark, sf_dir):
    return Net(spark, sf_dir).edges.select("edge_id", "speed")


@query("SELECT edge_id, row_number() OVER (ORDER BY src, road_level, edge_id) - 1 AS pos FROM edges")
def edge_sort_forward(spark, sf_dir):
    return g.dense_number(Net(spark, sf_dir).edges, F.floor(F.col("src") / g.NODES_PER_RANGE), ["src", "road_level", "edge_id"], "pos").select("edge_id", "pos")


@query("SELECT edge_id, row_number() OVER (ORDER BY dst, road_level, edge_id) - 1 AS pos FROM edges")
def edge_sort_reverse(spark, sf_dir):
    return g.dense_number(Net(spark, sf_dir).edges, F.floor(F.col("dst") / g.NODES_PER_RANGE), ["dst", "road_level", "edge_id"], "pos").select("edge_id", "pos")


def _adjacency_sql(end: str) -> str:
    cells = ", ".join(f"coalesce(min(pos) FILTER (WHERE road_level = {k}), -1) AS start_{k}, count(*) FILTER (WHERE road_level = {k}) AS count_{k}" for k in range(3))
    return f"SELECT {end} AS node_id, {cells} FROM (SELECT *, row_number() OVER (ORDER BY {end}, road_level, edge_id) - 1 AS pos FROM edges) p GROUP BY {end}"


@query(_adjacency_sql("src"))
def adjacency_forward(spark, sf_dir):
    return g.adjacency(Net(spark, sf_dir).edges, "src")


@query(_adjacency_sql("dst"))
def adjacency_reverse(spark, sf_dir):
    return g.adjacency(Net(spark, sf_dir).edges, "dst")


@query('SELECT node_id, round(lon, 7) AS lon, round(lat, 7) AS lat, "offset" FROM node_index')
def node_index_rows(spark, sf_dir):
    return Net(spark, sf_dir).index.select("node_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "offset")


@query("""SELECT node_id, printf('%d,%.7f,%.7f,%d', node_id, lon, lat, "offset") AS line FROM node_index""")
def node_index_csv_rows(spark, sf_dir):
    return g.node_index_csv_rows(Net(spark, sf_dir).index)


@query("""SELECT node_id, round(CASE WHEN node_id % 10 = 0 THEN lon + 1 ELSE lon END, 6) AS lon, "offset" FROM node_index
    UNION ALL SELECT node_id + 1000000000, round(lon, 6), "offset" FROM node_index WHERE node_id % 10 = 0""")
def node_index_upsert(spark, sf_dir):
    index = Net(spark, sf_dir).index
    tenth = index.where("node_id % 10 = 0")
    changes = tenth.withColumn("lon", F.col("lon") + 1).unionByName(tenth.withColumn("node_id", F.col("node_id") + 1000000000))
    return snap.upsert(index, changes).select("node_id", r6("lon").alias("lon"), "offset")


@query("""SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE road_level = 0) AS hot_edges,
    (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM edges WHERE road_level = 0 UNION ALL SELECT dst FROM edges WHERE road_level = 0) h) AS hot_nodes""")
def hot_cache_stats(spark, sf_dir):
    return g.cache_stats(Net(spark, sf_dir).edges)


@query("SELECT edge_id, 6 + 24 * src AS src_offset, 6 + 30 * edge_id AS edge_offset, 5 + 46 * src AS index_offset FROM edges")
def record_offsets(spark, sf_dir):
    e = Net(spark, sf_dir).edges
    return e.select("edge_id", geo.node_offset(F.col("src")).alias("src_offset"), geo.edge_offset(F.col("edge_id")).alias("edge_offset"), geo.index_offset(F.col("src")).alias("index_offset"))


# -- node index, snapping


@query("""SELECT req_id, round(lat - 100e0 / 111111e0, 6) AS min_lat, round(lat + 100e0 / 111111e0, 6) AS max_lat,
    round(lon - 100e0 / (111111e0 * cos(radians(lat))), 6) AS min_lon, round(lon + 100e0 / (111111e0 * cos(radians(lat))), 6) AS max_lon FROM point""")
def search_envelope(spark, sf_dir):
    box = geo.envelope(F.col("lat"), F.col("lon"), 100.0)
    return Net(spark, sf_dir).points.select("req_id", *[r6(c).alias(n) for n, c in box.items()])


@query("""SELECT req_id, printf('POINT(%.7f %.7f)', lon, lat) AS point,
    printf('POLYGON((%.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f))', lon - 1e0, lat - 1e0, lon - 1e0, lat + 1e0, lon + 1e0, lat + 1e0, lon + 1e0, lat - 1e0, lon - 1e0, lat - 1e0) AS box
    FROM point""")
def wkt_text(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return Net(spark, sf_dir).points.select("req_id", geo.point_wkt(lat, lon).alias("point"), geo.envelope_wkt(lat - 1.0, lat + 1.0, lon - 1.0, lon + 1.0).alias("box"))


@query("SELECT req_id, node_id, round(km, 6) AS km, rank FROM ranked WHERE rank <= 5")
def nearest_nodes_top5(spark, sf_dir):
    net = Net(spark, sf_dir)
    return snap.nearest_nodes(net.points, net.index).select("req_id", "node_id", r6("km").alias("km"), F.col("rank").cast("long").alias("rank"))


@query("SELECT req_id, node_id FROM ranked WHERE rank = 1")
def nearest_node(spark, sf_dir):
    net = Net(spark, sf_dir)
    return snap.nearest_nodes(net.points, net.index, most=1).select("req_id", "node_id")


@query("""SELECT node_id AS req_id, node_id, "offset" FROM node_index""")
def node_by_coordinate(spark, sf_dir):
    net = Net(spark, sf_dir)
    points = net.index.select(F.col("node_id").alias("req_id"), "lat", "lon")
    return snap.by_coordinate(points, net.index).select("req_id", "node_id", "offset")


@query("""SELECT node_id, "offset" FROM node_index WHERE node_id = 77""")
def offset_by_id(spark, sf_dir):
    return Net(spark, sf_dir).index.where("node_id = 77").select("node_id", "offset")


@query("SELECT req_id, node_id, round(km, 6) AS km FROM snapped")
def snap_requests(spark, sf_dir):
    net = Net(spark, sf_dir)
    return snap.snap(net.points, net.index, net.nodes).select("req_id", "node_id", r6("km").alias("km"))


_NEAREST_EDGE = """n_edge AS (
  SELECT req_id, edge_id, src, dst, lat, lon FROM (
    SELECT s.req_id, e.edge_id, e.src, e.dst, s.lat, s.lon, row_number() OVER (PARTITION BY s.req_id ORDER BY
      2e0 * 6371e0 * asin(sqrt(pow(sin((radians(n.lat) - radians(s.lat)) / 2e0), 2)
        + cos(radians(s.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(s.lon)) / 2e0), 2))), e.edge_id) AS r
    FROM snapped s JOIN edges e ON e.src = s.node_id JOIN nodes n ON n.node_id = e.dst) z WHERE r = 1)"""


@query(f", {_NEAREST_EDGE} SELECT req_id, edge_id, src, dst FROM n_edge".lstrip())
def nearest_edge(spark, sf_dir):
    net = Net(spark, sf_dir)
    return snap.nearest_edge(snap.snap(net.points, net.index, net.nodes), net.edges, net.nodes).select("req_id", "edge_id", "src", "dst")


@query(f""", {_NEAREST_EDGE} SELECT req_id, round(ax + t * (bx - ax), 6) AS x, round(ay + t * (by_ - ay), 6) AS y FROM (
    SELECT req_id, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_,
      ((e.lon - a.lon) * (b.lon - a.lon) + (e.lat - a.lat) * (b.lat - a.lat)) / nullif(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2), 0e0) AS t
    FROM n_edge e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst) z""".lstrip())
def nearest_point_on_line(spark, sf_dir):
    net = Net(spark, sf_dir)
    best = snap.nearest_edge(snap.snap(net.points, net.index, net.nodes), net.edges, net.nodes).join(net.points, "req_id")
    at = lambda end, p: net.nodes.select(F.col("node_id").alias(end), F.col("lon").alias(f"{p}x"), F.col("lat").alias(f"{p}y"))
    x, y = geo.nearest_on_line(*[F.col(c) for c in ("ax", "ay", "bx", "by", "lon", "lat")])
    return best.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("req_id", r6(x).alias("x"), r6(y).alias("y"))


@query("SELECT src AS node_id, edge_id, road_level FROM edges")
def connected_edges_all(spark, sf_dir):
    return Net(spark, sf_dir).edges.select(F.col("src").alias("node_id"), "edge_id", "road_level")


@query("SELECT dst AS node_id, edge_id, road_level FROM edges WHERE road_level = 0")
def connected_edges_level(spark, sf_dir):
    return g.edges_at_level(Net(spark, sf_dir).edges, 0, end="dst")


@query("SELECT src AS node_id, edge_id, road_level FROM edges WHERE road_level IN (1, 2)")
def connected_edges_level_exit(spark, sf_dir):
    return g.edges_at_level(Net(spark, sf_dir).edges, 1, with_next=True)


# -- requests as text, guidance

_OD = """od AS (SELECT req_id, CASE req_id % 5
    WHEN 0 THEN printf('%.6f/%.6f', start_lat, start_lon)
    WHEN 1 THEN printf('%.6f-%.6f|%.6f/%.6f', start_lat, start_lon, end_lat, end_lon)
    WHEN 2 THEN printf('%.6f/%.6f|%.6f/%.6f', start_lon, start_lat, end_lat, end_lon)
    ELSE printf('%.6f/%.6f|%.6f/%.6f', start_lat, start_lon, end_lat, end_lon) END AS od FROM route_request)"""


def _od(spark, sf_dir):
    names = ("start_lat", "start_lon", "end_lat", "end_lon")
    a, b, c, d = (F.col(n) for n in names)
    four, kind = "%.6f/%.6f|%.6f/%.6f", F.col("req_id") % 5
    text = F.when(kind == 0, F.format_string("%.6f/%.6f", a, b)).when(kind == 1, F.format_string("%.6f-%.6f|%.6f/%.6f", a, b, c, d)).when(kind == 2, F.format_string(four, b, a, c, d)).otherwise(F.format_string(four, a, b, c, d))
    return fx.requests(spark, sf_dir).select("req_id", text.alias("od"))


@query(f""", {_OD} SELECT req_id, CASE WHEN req_id % 5 > 2 THEN round(start_lat, 6) END AS start_lat, CASE WHEN req_id % 5 > 2 THEN round(end_lon, 6) END AS end_lon
    FROM route_request""".lstrip())
def parse_od_requests(spark, sf_dir):
    return parse_requests(_od(spark, sf_dir)).select("req_id", r6("start_lat").alias("start_lat"), r6("end_lon").alias("end_lon"))


@query(f", {_OD} SELECT req_id, req_id % 5 > 2 AS valid FROM od".lstrip())
def validate_coordinates(spark, sf_dir):
    return parse_requests(_od(spark, sf_dir)).select("req_id", "valid")


_BEARING = """(degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})),
    cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1})))) + 360e0) % 360e0"""


@query(f"SELECT osm_id, seq, round({_BEARING.format(x1='x', y1='y', x2='x2', y2='y2')}, 6) AS bearing FROM seg WHERE x2 IS NOT NULL")
def bearing(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("osm_id").orderBy("seq")
    v = Net(spark, sf_dir).vertices.select("osm_id", "seq", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return v.select("osm_id", "seq", r6(geo.bearing(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))).alias("bearing"))


@query(f""", b AS (
      SELECT osm_id, seq, x, lag(x) OVER w AS px, lag(y) OVER w AS py, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM road_vertex WINDOW w AS (PARTITION BY osm_id ORDER BY seq)),
    c AS (SELECT osm_id, seq, px, nx, {_BEARING.format(x1='x', y1='y', x2='nx', y2='ny')} - {_BEARING.format(x1='px', y1='py', x2='x', y2='y')} AS d0 FROM b),
    d AS (SELECT *, CASE WHEN d0 <= -180 THEN d0 + 360 WHEN d0 > 180 THEN d0 - 360 ELSE d0 END AS d FROM c)
    SELECT osm_id, seq AS step, CASE WHEN px IS NULL THEN 'START' WHEN nx IS NULL THEN 'END' WHEN abs(d) <= 30 THEN 'STRAIGHT' WHEN abs(d) >= 150 THEN 'U_TURN'
      WHEN d > 0 THEN 'RIGHT' ELSE 'LEFT' END AS turn FROM d""".lstrip())
def turn_guidance(spark, sf_dir):
    path = Net(spark, sf_dir).vertices.select("osm_id", F.col("seq").alias("step"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    return guidance.turn_steps(path, "osm_id").select("osm_id", "step", "turn")


@query("SELECT osm_id, seq, round(x, 6) AS x FROM road_vertex")
def round_coordinate(spark, sf_dir):
    return Net(spark, sf_dir).vertices.select("osm_id", "seq", geo.round6(F.col("x")).alias("x"))


@query("SELECT req_id, round(abs(start_lat - end_lat) + abs(start_lon - end_lon), 6) AS degrees FROM route_request")
def manhattan_degrees(spark, sf_dir):
    a, b, c, d = (F.col(n) for n in ("start_lat", "start_lon", "end_lat", "end_lon"))
    return fx.requests(spark, sf_dir).select("req_id", r6(geo.manhattan_degrees(a, b, c, d)).alias("degrees"))


_KM = "2e0 * 6371e0 * asin(sqrt(pow(sin((radians(end_lat) - radians(start_lat)) / 2e0), 2) + cos(radians(start_lat)) * cos(radians(end_lat)) * pow(sin((radians(end_lon) - radians(start_lon)) / 2e0), 2)))"


@query(f"SELECT req_id, round({_KM}, 6) AS km, round({_KM} / 100e0 * 1.5e0, 6) AS estimate, {_KM} / 100e0 <= 0.1e0 AS is_near FROM route_request")
def heuristic_estimate(spark, sf_dir):
    km = geo.haversine_km(*[F.col(n) for n in ("start_lat", "start_lon", "end_lat", "end_lon")])
    return fx.requests(spark, sf_dir).select("req_id", r6(km).alias("km"), r6(geo.heuristic_cost(km)).alias("estimate"), geo.is_near_target(km).alias("is_near"))


# -- stores


def _stores(spark, sf_dir) -> Stores:
    return Stores(*fx.stores(spark, sf_dir))


_LIST = "id, trd_state_nm, bplc_nm, uptae_gbn_nm, x, y, building_id"
_QUAD_SQL = " AND ".join(f"({bx - ax}e0) * (y - {ay}e0) - ({by - ay}e0) * (x - {ax}e0) >= 0" for (ax, ay), (bx, by) in zip(QUAD, QUAD[1:] + QUAD[:1]))


@query("SELECT count(*) AS n FROM food_store", "stores")
def store_count_all(spark, sf_dir):
    return fx.stores(spark, sf_dir)[0].agg(F.count("*").alias("n"))


@query("SELECT A.* FROM food_store A JOIN building_info B ON A.building_id = B.ogc_fid WHERE id = 33", "stores")
def store_by_id(spark, sf_dir):
    return _stores(spark, sf_dir).rows_by_id(33)


@query("SELECT * FROM open_store ORDER BY id LIMIT 10 OFFSET 20", "stores")
def store_select_all(spark, sf_dir):
    return _stores(spark, sf_dir).select_all(PageRequest(3, 10))


@query(f"SELECT {_LIST} FROM open_store WHERE bplc_nm LIKE '%{KEYWORD}%' ORDER BY id LIMIT 25", "stores")
def store_search_keyword(spark, sf_dir):
    return _stores(spark, sf_dir).search_rows(PageRequest(1, 25), keyword=KEYWORD)


@query(f"SELECT {_LIST} FROM open_store WHERE uptae_gbn_nm = '{CATEGORY}' ORDER BY id LIMIT 25 OFFSET 25", "stores")
def store_search_category(spark, sf_dir):
    return _stores(spark, sf_dir).search_rows(PageRequest(2, 25), category=CATEGORY)


@query(f"SELECT {_LIST} FROM open_store WHERE {_QUAD_SQL}", "stores")
def store_search_quad(spark, sf_dir):
    return _stores(spark, sf_dir).matching(corners=QUAD)


def _projected_sql(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> str:
    """Common table expressions that end in quad(x0, y0, ... y3): the area's corners in EPSG:5174."""
    rx, ry, rz = (math.radians(r / 3600) for r in geo.TM_ROTATION)
    tx, ty, tz = geo.TM_SHIFT
    k, a, b = 1 + geo.TM_SCALE * 1e-6, geo.BESSEL_A, geo.BESSEL_A * (1 - geo.BESSEL_F)
    w, e = geo.WGS84_F * (2 - geo.WGS84_F), geo.BESSEL_F * (2 - geo.BESSEL_F)
    s = e / (1 - e)
    arc = f"{a!r} * ({1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256!r} * {{f}} - {3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024!r} * sin(2e0 * {{f}}) + {15 * e**2 / 256 + 45 * e**3 / 1024!r} * sin(4e0 * {{f}}) - {35 * e**3 / 3072!r} * sin(6e0 * {{f}}))"
    picked = ", ".join(f"max({c}) FILTER (WHERE i = {i}) AS {c}{i}" for i in range(4) for c in "xy")
    return f"""
corner(i, lat, lon) AS (VALUES (0, {min_lat}e0, {min_lon}e0), (1, {min_lat}e0, {max_lon}e0), (2, {max_lat}e0, {max_lon}e0), (3, {max_lat}e0, {min_lon}e0)),
wgs AS (SELECT i, radians(lat) AS p, radians(lon) AS l, {geo.WGS84_A!r} / sqrt(1e0 - {w!r} * pow(sin(radians(lat)), 2)) AS n FROM corner),
moved AS (SELECT i, (n * cos(p) * cos(l) - {tx!r}) / {k!r} AS u, (n * cos(p) * sin(l) - {ty!r}) / {k!r} AS v, (n * {1 - w!r} * sin(p) - {tz!r}) / {k!r} AS z FROM wgs),
turned AS (SELECT i, u + {rz!r} * v - {ry!r} * z AS x, v - {rz!r} * u + {rx!r} * z AS y, z + {ry!r} * u - {rx!r} * v AS z FROM moved),
leaned AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * {a!r}, sqrt(x * x + y * y) * {b!r}) AS t FROM turned),
bessel AS (SELECT i, atan2(z + {s * b!r} * pow(sin(t), 3), r - {e * a!r} * pow(cos(t), 3)) AS p, atan2(y, x) - {math.radians(geo.TM_LON)!r} AS l FROM leaned),
parts AS (SELECT i, p, {a!r} / sqrt(1e0 - {e!r} * pow(sin(p), 2)) AS n, pow(tan(p), 2) AS t, {s!r} * pow(cos(p), 2) AS c, l * cos(p) AS d FROM bessel),
placed AS (SELECT i,
    {geo.TM_X!r} + n * (d + (1e0 - t + c) * pow(d, 3) / 6e0 + (5e0 - 18e0 * t + t * t + 72e0 * c - {58 * s!r}) * pow(d, 5) / 120e0) AS x,
    {geo.TM_Y!r} + {arc.format(f='p')} - {arc.format(f=f'({math.radians(geo.TM_LAT)!r})')}
      + n * tan(p) * (d * d / 2e0 + (5e0 - t + 9e0 * c + 4e0 * c * c) * pow(d, 4) / 24e0 + (61e0 - 58e0 * t + t * t + 600e0 * c - {330 * s!r}) * pow(d, 6) / 720e0) AS y
  FROM parts),
quad AS (SELECT {picked} FROM placed)"""


_INSIDE_SQL = " AND ".join(f"(x{(i + 1) % 4} - x{i}) * (y - y{i}) - (y{(i + 1) % 4} - y{i}) * (x - x{i}) >= 0" for i in range(4))


@query(f", {_projected_sql(*BBOX)} SELECT {_LIST} FROM open_store CROSS JOIN quad WHERE {_INSIDE_SQL}".lstrip(), "stores")
def store_search_bbox(spark, sf_dir):
    """Open stores in an area given in degrees, whose corners are reprojected."""
    return _stores(spark, sf_dir).matching(bbox=BBOX)


@query(f"SELECT {_LIST} FROM open_store WHERE {_QUAD_SQL} AND bplc_nm LIKE '%{KEYWORD}%' AND uptae_gbn_nm = '{CATEGORY}' ORDER BY id LIMIT 10", "stores")
def store_search_combined(spark, sf_dir):
    return _stores(spark, sf_dir).search_rows(PageRequest(0, 10), keyword=KEYWORD, category=CATEGORY, corners=QUAD)


@query(f"SELECT count(*) AS n FROM open_store WHERE uptae_gbn_nm = '{CATEGORY}' AND bplc_nm LIKE '%{KEYWORD}%'", "stores")
def store_count_by_search(spark, sf_dir):
    return _stores(spark, sf_dir).matching(keyword=KEYWORD, category=CATEGORY).agg(F.count("*").alias("n"))


# -- costs and routes


_SOURCES_SQL = "sources AS (SELECT DISTINCT node_id AS source FROM snapped)"
_HOPS = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(5))
_HOP_SQL = ", ".join(["h0 AS (SELECT source, source AS node_id, 0e0 AS cost FROM sources)", *[f"h{k} AS (SELECT h.source, e.dst AS node_id, min(h.cost + e.cost) AS cost FROM h{k - 1} h JOIN edges e ON e.src = h.node_id GROUP BY 1, 2)" for k in range(1, 5)]])


@query(f", {_SOURCES_SQL}, {_HOP_SQL} SELECT source, node_id, round(min(cost), 6) AS cost FROM ({_HOPS}) u GROUP BY 1, 2".lstrip())
def sssp_bounded_hops(spark, sf_dir):
    """Least costs over at most four edges from every node that a request starts or ends at."""
    net = Net(spark, sf_dir)
    sources = snap.snap(net.points, net.index, net.nodes).select(F.col("node_id").alias("source")).distinct()
    return exact.bounded_costs(net.edges, sources, 4).select("source", "node_id", r6("cost").alias("cost"))


def _pairs(spark, sf_dir) -> DataFrame:
    """The requests with both their nodes, of which there are about as many as requests."""
    return Net(spark, sf_dir).resolved.where("start_node is not null and end_node is not null")


@query(None)
def sssp_exact(spark, sf_dir):
    """The least cost of every request, and whether the search's route, if it found one, is no cheaper."""
    _, found = _routes(spark, sf_dir)
    best = exact.exact_pair_costs(_pairs(spark, sf_dir), Net(spark, sf_dir).network, fx.requests(spark, sf_dir).count())
    both = best.join(found.select("req_id", F.col("cost").alias("found")), "req_id")
    return both.select("req_id", r6("cost").alias("cost"), F.coalesce(F.col("found") >= F.col("cost") - 1e-9, F.col("found").isNull()).alias("no_cheaper"))


ORACLE_SQL["sssp_exact"] = f"""WITH RECURSIVE {fx.ROADS_SQL},
    pair AS (SELECT a.req_id // 2 AS req_id, a.node_id AS start_node, b.node_id AS end_node FROM snapped a JOIN snapped b ON b.req_id = a.req_id + 1 AND a.req_id % 2 = 0),
    best(source, node_id, cost) USING KEY (source, node_id) AS (
      SELECT DISTINCT start_node, start_node, 0e0 FROM pair
      UNION
      SELECT b.source, e.dst, min(b.cost + e.cost) FROM best b JOIN edges e ON e.src = b.node_id
        LEFT JOIN recurring.best r ON r.source = b.source AND r.node_id = e.dst
      WHERE r.cost IS NULL OR b.cost + e.cost < r.cost GROUP BY 1, 2)
    SELECT req_id, round(cost, 6) AS cost, true AS no_cheaper FROM pair LEFT JOIN best ON source = start_node AND node_id = end_node"""


def _routes(spark, sf_dir) -> tuple[g.Graph, DataFrame]:
    net = Net(spark, sf_dir)
    return net.graph, search.find_paths(fx.requests(spark, sf_dir), net.graph, network=net.network, resolved=net.resolved)


def _kept_routes(spark, sf_dir) -> tuple[g.Graph, DataFrame]:
    """_routes(), each searched once however often they are read; they go with the network."""
    graph, found = _routes(spark, sf_dir)
    _KEPT[1].append(found.persist(StorageLevel.DISK_ONLY))
    return graph, found


@query(None)
def route_bidirectional(spark, sf_dir):
    _, found = _routes(spark, sf_dir)
    return found.select("req_id", "status", "path", r6("cost").alias("cost"))


@query("SELECT req_id, true AS ends_match, true AS hops_are_edges, true AS cost_in_range FROM route_request")
def route_invariants(spark, sf_dir):
    """Per request: a route runs from the start's node to the end's, over edges, at a cost that parallel edges allow."""
    graph, found = _kept_routes(spark, sf_dir)
    resolved = Net(spark, sf_dir).resolved
    hops = found.where("path is not null").select("req_id", "path", "cost", F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("src"), F.expr("slice(path, 2, size(path) - 1)").alias("dst"))).alias("i", "h"))
    hops = hops.select("req_id", F.col("cost").alias("total"), "i", "h.src", "h.dst")
    cheapest = graph.edges.groupBy("src", "dst").agg(F.min("cost").alias("step"), F.max("cost").alias("most"))
    checked = hops.join(cheapest, ["src", "dst"], "left").groupBy("req_id").agg(F.bool_and(F.col("step").isNotNull()).alias("hops"), F.first("total").between(F.sum("step") - 1e-9, F.sum("most") + 1e-9).alias("adds"))
    ends = (F.col("path")[0] == F.col("start_node")) & (F.element_at("path", -1) == F.col("end_node"))
    whole = resolved.select("req_id", "start_node", "end_node").join(found, "req_id").join(checked, "req_id", "left")
    true = lambda c: F.coalesce(c, F.lit(True))
    return whole.select("req_id", true(ends).alias("ends_match"), true(F.col("hops")).alias("hops_are_edges"), true(F.col("adds")).alias("cost_in_range"))


@query(None)
def route_by_node(spark, sf_dir):
    """Routes between the nodes of every request, also of those without an edge."""
    net = Net(spark, sf_dir)
    return search.routes_by_node(_pairs(spark, sf_dir), net.network, count=fx.requests(spark, sf_dir).count()).select("req_id", "path", r6("cost").alias("cost"))


@query("""SELECT req_id, true AS same_as_batch FROM route_request""")
def route_by_node_checked(spark, sf_dir):
    """Per request: the route between its nodes is the one that the batch of coordinates gives."""
    _, found = _routes(spark, sf_dir)
    by_node = search.routes_by_node(_pairs(spark, sf_dir), Net(spark, sf_dir).network, count=fx.requests(spark, sf_dir).count()).select("req_id", F.col("path").alias("by_node"), F.col("cost").alias("by_node_cost"))
    both = found.join(by_node, "req_id", "left")
    same = F.col("path").eqNullSafe(F.col("by_node")) & F.col("cost").eqNullSafe(F.col("by_node_cost"))
    return both.select("req_id", (same | (F.col("status") == "NO_EDGE")).alias("same_as_batch"))


def _traces(spark, sf_dir, visited: bool = False) -> DataFrame:
    """The traces of _routes()."""
    net = Net(spark, sf_dir)
    return search.traces(net.resolved.where("status = 'OK'"), net.network, count=fx.requests(spark, sf_dir).count(), visited=visited)


@query(None)
def route_trace(spark, sf_dir):
    return _traces(spark, sf_dir).select("req_id", "seq", "side", r6("lat").alias("lat"), r6("lon").alias("lon"), "n_visited")


def _placed_routes(spark, sf_dir) -> DataFrame:
    """The routes of _routes() with their nodes' places."""
    net = Net(spark, sf_dir)
    return search.placed_routes(net.resolved.where("status = 'OK'"), net.network, count=fx.requests(spark, sf_dir).count())


@query(None)
def route_steps(spark, sf_dir):
    return search.route_steps(_placed_routes(spark, sf_dir)).select("req_id", "step", "node_id", "turn")


@query("SELECT req_id, true AS dense, true AS ends_marked, true AS turns_between FROM route_request")
def route_steps_checked(spark, sf_dir):
    """Per request: steps number the route's nodes, the first is START, the last END, all between are turns."""
    found = _placed_routes(spark, sf_dir).persist(StorageLevel.DISK_ONLY)
    _KEPT[1].append(found)  # each searched once however often they are read; they go with the network
    steps = search.route_steps(found)
    last = F.col("path_size") - 1
    known = steps.join(found.select("req_id", F.col("path"), F.size("path").alias("path_size")), "req_id")
    of = known.groupBy("req_id", "path_size").agg(
        ((F.count("*") == F.max("path_size")) & (F.count_distinct("step") == F.max("path_size")) & F.bool_and(F.col("path")[F.col("step")] == F.col("node_id"))).alias("dense"),
        F.bool_and(F.when(F.col("step") == 0, F.col("turn") == "START").when(F.col("step") == last, F.col("turn") == "END").otherwise(True)).alias("ends_marked"),
        F.bool_and(F.when((F.col("step") > 0) & (F.col("step") < last), F.col("turn").isin("STRAIGHT", "LEFT", "RIGHT", "U_TURN")).otherwise(True)).alias("turns_between"),
    )
    true = lambda c: F.coalesce(F.col(c), F.lit(True)).alias(c)
    whole = Net(spark, sf_dir).resolved.select("req_id").join(found.select("req_id", "path"), "req_id", "left")
    return whole.join(of, "req_id", "left").select("req_id", F.coalesce("dense", F.col("path").isNull()).alias("dense"), true("ends_marked"), true("turns_between"))


def trace_checks(batches):
    """(req_id, dense, each_once, reaches_route) of search.traces() with visited, a partition as it comes: a request's rows
    stand together, so none of them is shuffled or kept but the places that were expanded."""
    names = ["req_id", "dense", "each_once", "reaches_route"]

    def checked(req, seqs, sides, places, missing) -> pa.RecordBatch:
        seq, side, place = (np.concatenate(parts) for parts in (seqs, sides, places))
        dense = not len(seq) or bool(seq.min() == 0 and len(seq) == seq.max() + 1)
        once = sum(len(np.unique(place[side == way])) for way in (False, True)) == len(place)
        return pa.RecordBatch.from_arrays([pa.array([req], pa.int64()), *(pa.array([ok]) for ok in (dense, once, not len(missing)))], names)

    now = None
    for batch in batches:
        first = np.append(np.flatnonzero(batch.column("seq").is_null().to_numpy(zero_copy_only=False)), batch.num_rows)
        column = batch.column("visited")
        ends = np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1, 4 * column.offset)
        # A place is one complex number.
        seen = lambda start, stop: np.frombuffer(column.buffers()[2], np.complex128, (ends[stop] - ends[start]) // 16, ends[start]) if ends[stop] > ends[start] else np.zeros(0, complex)
        seq, lat, lon = (batch.column(c).fill_null(0).to_numpy() for c in ("seq", "lat", "lon"))
        back, place = pc.equal(batch.column("side"), "REVERSE").fill_null(False).to_numpy(zero_copy_only=False), lat + 1j * lon
        for i, (start, stop) in enumerate(zip([0, *first], first)):  # the rest of the request before, then a request each
            if i:
                if now:
                    yield checked(*now)
                now = [batch.column("req_id")[int(start)].as_py(), [seq[:0]], [back[:0]], [place[:0]], np.unique(seen(start, start + 1)[1:-1])]
                start += 1
            if start == stop:
                continue
            for kept, part in zip(now[1:4], (seq, back, place)):
                kept.append(part[start:stop])
            if len(now[4]):
                now[4] = now[4][~np.isin(now[4], np.concatenate([place[start:stop], seen(start, stop)]))]
    if now:
        yield checked(*now)


@query("SELECT req_id, true AS dense, true AS each_once, true AS reaches_route FROM route_request")
def route_trace_checked(spark, sf_dir):
    """Per request: a trace is numbered from 0, expands a node once a side, and has seen the route's every inner node."""
    checked = _traces(spark, sf_dir, visited=True).mapInArrow(trace_checks, "req_id long, dense boolean, each_once boolean, reaches_route boolean")
    true = lambda c: F.coalesce(F.col(c), F.lit(True)).alias(c)
    return Net(spark, sf_dir).resolved.select("req_id").join(checked, "req_id", "left").select("req_id", true("dense"), true("each_once"), true("reaches_route"))


@query("SELECT req_id, 'NO_NODE' AS status FROM route_request")
def route_not_found(spark, sf_dir):
    """Requests that end 60 degrees south of the network, however far north that reaches."""
    net = Net(spark, sf_dir)
    south = net.graph.index.agg(F.min("lat")).first()[0]
    far = fx.requests(spark, sf_dir).withColumn("end_lat", F.least(F.col("end_lat"), F.lit(south)) - 60.0)
    return search.find_paths(far, net.graph).select("req_id", "status")
