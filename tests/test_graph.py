"""Graph building, layouts, adjacency, snapping and stored graphs on small features."""

import pytest
from pyspark.sql import functions as F

from waymill.errors import EmptyGeometry, ExtractionFailed, ItemEmpty, NodeIndexNotFound
from waymill.functions import geo
from waymill.functions.sequence import dense_number, running_sum
from waymill.operators import graph as g
from waymill.operators import search, snap
from waymill.operators.stores import PageRequest, Stores
from waymill.sources.graph_store import GraphStore, write_index_csv

SCHEMA = "osm_id long, fclass string, oneway string, maxspeed int, geometry array<struct<x:double,y:double>>"
TWO = [(127.0, 37.0), (127.1, 37.1)]
THREE = [*TWO, (127.2, 37.2)]


def features(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    ("line", "fclass", "oneway", "want"),
    [(TWO, "motorway", "B", 2), (THREE, "motorway", "B", 4), (TWO, "motorway", "F", 1), (TWO, "motorway", "T", 1), (TWO, "unknown_type", "B", 0), (TWO, None, "B", 0), (TWO[:1], "motorway", "B", 0)],
)
def test_edges_of_a_feature(spark, line, fclass, oneway, want):
    graph = g.build(features(spark, (fclass, oneway, 100, line)))
    edges = graph.edges.orderBy("edge_id").collect()
    assert len(edges) == want and [e["edge_id"] for e in edges] == list(range(want))
    if oneway == "T":
        assert (edges[0]["src"], edges[0]["dst"]) == (1, 0)


def test_a_missing_oneway_fails_the_whole_extraction(spark):
    with pytest.raises(ExtractionFailed):
        g.build(features(spark, ("motorway", "B", 100, TWO), ("motorway", None, 100, TWO)))
    g.build(features(spark, ("footway", None, None, TWO)))


def test_nodes_keep_the_first_coordinate_and_ids_of_all_features(spark):
    rows = [("footway", "B", 3, [(126.0, 36.0)]), ("primary", "B", 60, [(127.00000001, 37.0), (127.1, 37.1)]), ("primary", "B", 60, [(127.00000002, 37.0), (127.1, 37.1)])]
    graph = g.build(features(spark, *rows))
    nodes = graph.nodes.orderBy("node_id").collect()
    assert [(n["node_id"], n["lon"], n["has_record"]) for n in nodes] == [(0, 126.0, False), (1, 127.00000001, True), (2, 127.1, True)]
    assert graph.index.count() == 3
    phantom = g.build(features(spark, *rows), phantom_zero=True)
    assert phantom.nodes.count() == 4 and phantom.edges.agg(F.min("src")).first()[0] == 2


def test_parallel_edges_and_self_loops_stay(spark):
    rows = [("primary", "B", 60, TWO), ("primary", "F", 60, TWO), ("primary", "F", 60, [TWO[0], TWO[0]])]
    assert g.build(features(spark, *rows)).edges.count() == 4


MIX = [(0, 20, 30, 2), (1, 10, 50, 1), (2, 20, 10, 0), (3, 10, 20, 0), (4, 30, 40, 1), (5, 10, 30, 2), (6, 20, 20, 1)]


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, src long, dst long, road_level int")


def test_layouts(spark):
    forward = [(r["src"], r["road_level"]) for r in g.forward_layout(edge_table(spark, MIX)).collect()]
    assert forward == [(10, 0), (10, 1), (10, 2), (20, 0), (20, 1), (20, 2), (30, 1)]
    assert [r["dst"] for r in g.reverse_layout(edge_table(spark, MIX)).collect()] == [10, 20, 20, 30, 30, 40, 50]


def test_adjacency(spark):
    rows = [(0, 11, 22, 0), (1, 11, 33, 1), (2, 11, 55, 1), (3, 44, 55, 2)]
    got = {r["node_id"]: tuple(r)[1:] for r in g.adjacency(edge_table(spark, rows)).collect()}
    assert got == {11: (0, 1, 1, 2, -1, 0), 44: (-1, 0, -1, 0, 3, 1)}
    rows = [(0, 11, 22, 0), (1, 33, 22, 1), (2, 44, 55, 2)]
    got = {r["node_id"]: tuple(r)[1:] for r in g.adjacency(edge_table(spark, rows), "dst").collect()}
    assert got == {22: (0, 1, 1, 1, -1, 0), 55: (-1, 0, -1, 0, 2, 1)}


def test_running_numbers_cross_ranges(spark):
    df = spark.range(0, 1000, 7).withColumn("v", F.lit(2))
    got = dense_number(df, F.floor(F.col("id") / 100), ["id"], "n").orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(len(got)))
    got = running_sum(df, F.floor(F.col("id") / 100), ["id"], F.col("v"), "s").orderBy("id").collect()
    assert [r["s"] for r in got] == [2 * i for i in range(len(got))]


ROWS = [(1000053, 33.24019619, 126.56186369), (1000054, 33.24008459, 126.56200559), (1001006, 33.24033079, 126.56246739), (1002943, 33.24030459, 126.56188999), (1002944, 33.24064889, 126.56173109)]


def index_table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "node_id long, lat double, lon double").withColumn("offset", geo.node_offset(F.col("node_id")))


def test_nearest_and_exact_lookup(spark):
    index = index_table(spark)
    assert snap.nearest_node(index, 33.24033079, 126.56246739) == 1001006
    with pytest.raises(NodeIndexNotFound):
        snap.nearest_node(index, 34.0, 127.0)
    assert snap.nearest_node(index, 34.0, 127.0, or_all=True) == 1002944
    point = spark.createDataFrame([(1, 33.24008459, 126.56200559), (2, 1.0, 1.0)], "req_id long, lat double, lon double")
    assert [tuple(r) for r in snap.by_coordinate(point, index).select("req_id", "node_id").collect()] == [(1, 1000054)]
    assert snap.offset_by_id(index, 1000053) == 6 + 24 * 1000053
    with pytest.raises(NodeIndexNotFound):
        snap.offset_by_id(index, 5)


def test_upsert_is_all_or_nothing(spark):
    index = index_table(spark)
    changes = spark.createDataFrame([(1000053, 1.0, 2.0, 3), (7, 1.0, 2.0, 3)], "node_id long, lon double, lat double, offset long")
    assert snap.upsert(index, changes).count() == 6
    with pytest.raises(ValueError):
        snap.upsert(index, changes.unionByName(spark.createDataFrame([(8, None, 2.0, 3)], changes.schema)))


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    assert store.extract(features(spark).limit(0)) is None and not store.has_extracted_data()
    seen = []
    data = features(spark, ("motorway", "B", 100, THREE), ("residential", "F", 30, TWO))
    graph = store.extract(data, progress=lambda stage, state: seen.append((stage, state)))
    assert store.has_extracted_data() and graph.edges.count() == 5 == store.read("edges_reverse").count()
    again = []
    store.extract(data, progress=lambda *x: again.append(x))
    assert len(seen) == 12 and again == []
    assert store.node(1)["lon"] == pytest.approx(127.1)
    with pytest.raises(NodeIndexNotFound):
        store.node(99)
    write_index_csv(graph.index, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "nodeId,x,y,offset" and lines[1] == "0,127.0000000,37.0000000,6"
    write_index_csv(graph.index.limit(0), str(tmp_path / "empty"))
    assert next((tmp_path / "empty").glob("part-*")).read_text().split() == ["nodeId,x,y,offset"]


def sink_graph(spark):
    return g.build(features(spark, ("primary", "F", 60, [(127.0, 37.0), (127.01, 37.0)]), ("primary", "B", 60, [(127.02, 37.0), (127.03, 37.0)])))


def request(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "req_id long, start_lat double, start_lon double, end_lat double, end_lon double")


def test_statuses(spark):
    graph = sink_graph(spark)
    rows = [(37, 127.0, 37, 127.01), (37, 127.0, 38, 128), (37, 127.0, 37, 127.03), (37, 127.02, 37, 127.03), (37, 127.02, 37, 127.02)]
    found = {r["req_id"]: r for r in search.find_paths(request(spark, *rows), graph).collect()}
    assert [found[i]["status"] for i in range(5)] == ["NO_EDGE", "NO_NODE", "NO_ROUTE", "OK", "OK"]
    assert found[3]["path"] == [2, 3] and found[4]["path"] == [2]
    with pytest.raises(EmptyGeometry):
        search.find_paths(request(spark, *rows), graph, strict=True)
    assert search.find_paths_text(spark, "37.0/127.02|37.0/127.03", graph).first()["path"] == [2, 3]


def test_stores(spark):
    food = spark.createDataFrame(
        [(1, "피자 집", "한식", "영업/정상", 1, 0.0, 0.0), (2, "Pizza_1", "양식", "폐업", 1, 1.0, 1.0), (3, "Pizza 1", "양식", "영업/정상", 9, 1.0, 1.0), (4, "100%", "한식", "영업/정상", 1, 5.0, 5.0)],
        "id long, bplc_nm string, uptae_gbn_nm string, trd_state_nm string, building_id int, x double, y double",
    )
    stores = Stores(food, spark.createDataFrame([(1, "A")], "ogc_fid int, building_nm string"))
    assert stores.count_all() == 4 and [r["id"] for r in stores.select_all().collect()] == [1, 4]
    assert stores.by_id(2)["bplc_nm"] == "Pizza_1"
    with pytest.raises(ItemEmpty):
        stores.by_id(3)
    page = stores.search(PageRequest(1, 1), category="한식")
    assert page.total_elements == 2 and page.total_pages == 2 and page.current_page == 1 and [r["id"] for r in page.content.collect()] == [1]
    with pytest.raises(ItemEmpty):
        stores.search(PageRequest(9, 10), category="한식")
    assert [r["id"] for r in stores.matching(keyword="피자").collect()] == [1]
    assert [r["id"] for r in stores.matching(keyword=r"\%").collect()] == [4]
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert [r["id"] for r in stores.matching(corners=square).collect()] == [1] == [r["id"] for r in stores.matching(corners=square[::-1], keyword="", category=None).collect()]


def test_envelopes_at_the_poles_and_no_broadcast_of_cells(spark):
    points = spark.createDataFrame([(1, 90.0, 10.0), (2, 89.9999, 10.0), (3, 90.0001, 10.0), (4, -90.0, 10.0), (5, 45.0, 10.0)], "req_id long, lat double, lon double")
    index = spark.createDataFrame([(1, 89.9995, -170.0), (2, 90.0, 100.0), (3, 89.99, 10.0), (4, -89.9995, 0.0), (5, 45.0005, 10.001), (6, 45.0, 10.002)], "node_id long, lat double, lon double").withColumn("offset", F.lit(0))
    met = snap.within_envelope(points, index)
    assert sorted((r["req_id"], r["node_id"]) for r in met.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 4), (5, 5)]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
