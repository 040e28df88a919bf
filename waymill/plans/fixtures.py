"""A road network, stores and requests derived from the star-schema tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40  # customers in a row of the grid


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a road of three vertices between neighbours of the customers' grid."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    n = _read(spark, sf_dir, "customer").count()
    key, k = F.col("o_orderkey"), F.col("o_custkey")
    right = (key % 2 == 0) & (k % WIDTH < WIDTH - 1) & (k + 1 < n)
    k2 = F.when(right, k + 1).when(k + WIDTH < n, k + WIDTH)
    kinds = {"1-URGENT": "motorway", "2-HIGH": "primary", "3-MEDIUM": "secondary", "4-NOT SPECIFIED": "footway"}
    fclass, oneway = F.lit("residential"), F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "P", "T").otherwise("B")
    for priority, kind in kinds.items():
        fclass = F.when(F.col("o_orderpriority") == priority, kind).otherwise(fclass)
    x1, y1, x2, y2 = 126.2 + (k % WIDTH) * 5e-3, 33.2 + F.floor(k / 40.0) * 5e-3, 126.2 + (F.col("k2") % WIDTH) * 5e-3, 33.2 + F.floor(F.col("k2") / 40.0) * 5e-3
    bend = (key % 3) * 5e-4
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(point(x1, y1), point((x1 + x2) / 2.0 + bend, (y1 + y2) / 2.0 + bend), point(x2, y2))
    roads = orders.withColumn("k2", k2).where("k2 is not null")
    return roads.select(key.alias("osm_id"), fclass.alias("fclass"), oneway.alias("oneway"), (30 + (key % 8) * 10).cast("int").alias("maxspeed"), line.alias("geometry"))


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(food_store, building_info) of customers and nations; two nations have no building."""
    k = F.col("c_custkey")
    food = _read(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("bplc_nm"), F.col("c_mktsegment").alias("uptae_gbn_nm"),
        F.when(F.col("c_acctbal") >= 0.0, "영업/정상").otherwise("폐업").alias("trd_state_nm"), F.col("c_nationkey").alias("building_id"),
        (2e5 + (k % WIDTH) * 1e2).alias("x"), (5e5 + F.floor(k / 40.0) * 1e2).alias("y"),
    )
    building = _read(spark, sf_dir, "nation").where("n_nationkey < 23").select(F.col("n_nationkey").alias("ogc_fid"), F.col("n_name").alias("building_nm"))
    return food, building


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An origin and a destination for each supplier, a little off the grid."""
    n = _read(spark, sf_dir, "customer").count()
    s = F.col("s_suppkey")
    a, b = (s * 37) % n, (s * 101 + 7) % n
    lat = lambda k: 33.2 + F.floor(k / 40.0) * 5e-3
    lon = lambda k: 126.2 + (k % WIDTH) * 5e-3
    return _read(spark, sf_dir, "supplier").select(
        s.cast("long").alias("req_id"), (lat(a) + 1e-4).alias("start_lat"), lon(a).alias("start_lon"), (lat(b) - 1e-4).alias("end_lat"), lon(b).alias("end_lon")
    )


#: The same network as common table expressions, for the oracle.
ROADS_SQL = """
cust AS (SELECT count(*) AS n FROM customer),
link AS (
  SELECT o_orderkey AS osm_id, o_custkey AS k,
    CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 40 < 39 AND o_custkey + 1 < cust.n THEN o_custkey + 1
         WHEN o_custkey + 40 < cust.n THEN o_custkey + 40 END AS k2,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary'
         WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'footway' ELSE 'residential' END AS fclass,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'P' THEN 'T' ELSE 'B' END AS oneway,
    CAST(30 + (o_orderkey % 8) * 10 AS INT) AS maxspeed
  FROM orders CROSS JOIN cust),
ends AS (
  SELECT *, 1.262e2 + (k % 40) * 5e-3 AS x1, 3.32e1 + floor(k / 4e1) * 5e-3 AS y1,
            1.262e2 + (k2 % 40) * 5e-3 AS x2, 3.32e1 + floor(k2 / 4e1) * 5e-3 AS y2
  FROM link WHERE k2 IS NOT NULL),
road_vertex AS (
  SELECT osm_id, fclass, oneway, maxspeed, 0 AS seq, x1 AS x, y1 AS y FROM ends
  UNION ALL
  SELECT osm_id, fclass, oneway, maxspeed, 1, (x1 + x2) / 2e0 + (osm_id % 3) * 5e-4, (y1 + y2) / 2e0 + (osm_id % 3) * 5e-4 FROM ends
  UNION ALL
  SELECT osm_id, fclass, oneway, maxspeed, 2, x2, y2 FROM ends),
keyed AS (
  SELECT *, CAST(floor(x * 1e7) AS BIGINT) AS lonk, CAST(floor(y * 1e7) AS BIGINT) AS latk,
    CAST(floor(x * 1e7) AS BIGINT) * 4294967296 + CAST(floor(y * 1e7) AS BIGINT) AS coord_key FROM road_vertex),
node_ids AS (SELECT coord_key, lonk, latk, row_number() OVER (ORDER BY coord_key) - 1 AS node_id FROM (SELECT DISTINCT coord_key, lonk, latk FROM keyed) d),
seg AS (
  SELECT osm_id, fclass, oneway, maxspeed, seq, coord_key, x, y,
    lead(coord_key) OVER (PARTITION BY osm_id ORDER BY seq) AS coord_key2,
    lead(x) OVER (PARTITION BY osm_id ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY osm_id ORDER BY seq) AS y2
  FROM keyed),
segments AS (
  SELECT osm_id, seq, oneway, maxspeed AS speed, coord_key AS key1, coord_key2 AS key2,
    2e0 * 6371e0 * asin(sqrt(pow(sin((radians(y2) - radians(y)) / 2e0), 2)
      + cos(radians(y)) * cos(radians(y2)) * pow(sin((radians(x2) - radians(x)) / 2e0), 2))) AS km,
    CASE WHEN fclass = 'motorway' THEN 0 WHEN fclass = 'residential' THEN 2 ELSE 1 END AS road_level
  FROM seg WHERE coord_key2 IS NOT NULL AND fclass <> 'footway'),
two_way AS (
  SELECT osm_id, seq, 0 AS dir, key1 AS src_key, key2 AS dst_key, km, speed, road_level FROM segments WHERE oneway IN ('F', 'B')
  UNION ALL
  SELECT osm_id, seq, 1, key2, key1, km, speed, road_level FROM segments WHERE oneway IN ('T', 'B')),
edges AS (
  SELECT row_number() OVER (ORDER BY b.osm_id, b.seq, b.dir) - 1 AS edge_id, s.node_id AS src, d.node_id AS dst, km, speed, road_level,
    CASE road_level WHEN 0 THEN km / 100e0 * 0.5e0 WHEN 1 THEN km / 60e0 * 1e0 ELSE km / 30e0 * 1.5e0 END AS cost
  FROM two_way b JOIN node_ids s ON s.coord_key = b.src_key JOIN node_ids d ON d.coord_key = b.dst_key),
nodes AS (
  SELECT i.node_id, i.coord_key, coalesce(f.x, i.lonk / 1e7) AS lon, coalesce(f.y, i.latk / 1e7) AS lat, f.x IS NOT NULL AS has_record
  FROM node_ids i LEFT JOIN (
    SELECT coord_key, arg_min(x, osm_id * 4 + seq) AS x, arg_min(y, osm_id * 4 + seq) AS y FROM keyed WHERE fclass <> 'footway' GROUP BY coord_key) f
  ON f.coord_key = i.coord_key),
node_index AS (SELECT node_id, lonk / 1e7 AS lon, latk / 1e7 AS lat, 6 + 24 * node_id AS "offset" FROM node_ids),
route_request AS (
  SELECT s_suppkey AS req_id,
    3.32e1 + floor((s_suppkey * 37) % cust.n / 4e1) * 5e-3 + 1e-4 AS start_lat, 1.262e2 + ((s_suppkey * 37) % cust.n % 40) * 5e-3 AS start_lon,
    3.32e1 + floor((s_suppkey * 101 + 7) % cust.n / 4e1) * 5e-3 - 1e-4 AS end_lat, 1.262e2 + ((s_suppkey * 101 + 7) % cust.n % 40) * 5e-3 AS end_lon
  FROM supplier CROSS JOIN cust),
point AS (
  SELECT 2 * req_id AS req_id, start_lat AS lat, start_lon AS lon FROM route_request
  UNION ALL SELECT 2 * req_id + 1, end_lat, end_lon FROM route_request),
near AS (
  SELECT p.req_id, p.lat, p.lon, i.node_id, i."offset",
    2e0 * 6371e0 * asin(sqrt(pow(sin((radians(i.lat) - radians(p.lat)) / 2e0), 2)
      + cos(radians(p.lat)) * cos(radians(i.lat)) * pow(sin((radians(i.lon) - radians(p.lon)) / 2e0), 2))) AS km
  FROM point p JOIN node_index i
    ON i.lat BETWEEN p.lat - 100e0 / 111111e0 AND p.lat + 100e0 / 111111e0
   AND i.lon BETWEEN p.lon - 100e0 / (111111e0 * cos(radians(p.lat))) AND p.lon + 100e0 / (111111e0 * cos(radians(p.lat)))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY km, node_id) AS rank FROM near),
ranked_kept AS (SELECT r.*, row_number() OVER (PARTITION BY req_id ORDER BY km, node_id) AS rank2 FROM near r JOIN nodes USING (node_id) WHERE has_record),
snapped AS (
  SELECT req_id, lat, lon, node_id, km2 AS km FROM (
    SELECT k.req_id, k.lat, k.lon, k.node_id,
      2e0 * 6371e0 * asin(sqrt(pow(sin((radians(n.lat) - radians(k.lat)) / 2e0), 2)
        + cos(radians(k.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(k.lon)) / 2e0), 2))) AS km2,
      row_number() OVER (PARTITION BY k.req_id ORDER BY km2, k.rank2) AS best
    FROM ranked_kept k JOIN nodes n USING (node_id) WHERE k.rank2 <= 5) z WHERE best = 1)
"""

STORES_SQL = """
food_store AS (
  SELECT c_custkey AS id, c_name AS bplc_nm, c_mktsegment AS uptae_gbn_nm,
    CASE WHEN c_acctbal >= 0e0 THEN '영업/정상' ELSE '폐업' END AS trd_state_nm, c_nationkey AS building_id,
    2e5 + (c_custkey % 40) * 1e2 AS x, 5e5 + floor(c_custkey / 4e1) * 1e2 AS y FROM customer),
building_info AS (SELECT n_nationkey AS ogc_fid, n_name AS building_nm FROM nation WHERE n_nationkey < 23),
open_store AS (SELECT A.* FROM food_store A JOIN building_info B ON A.building_id = B.ogc_fid WHERE A.trd_state_nm LIKE '영업%')
"""
