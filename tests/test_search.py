"""The search kernel on hand-made graphs, and its invariants on random ones."""

import heapq
import inspect
import random

import pandas as pd
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from waymill.config import CacheMode, RouteConfig
from waymill.errors import GraphTooLarge
from waymill.operators import exact, kernel, search

SPEED_WEIGHT = [(100.0, 0.5), (60.0, 1.0), (30.0, 1.5)]


def network(nodes, edges, mode=CacheMode.INDEX_ONLY):
    """nodes: {id: (lat, lon)}; edges: (id, from, to, km, level)."""
    n = pd.DataFrame([(i, lon, lat) for i, (lat, lon) in nodes.items()], columns=["node_id", "lon", "lat"])
    e = pd.DataFrame([(i, a, b, km / SPEED_WEIGHT[level][0] * SPEED_WEIGHT[level][1], level) for i, a, b, km, level in edges], columns=["edge_id", "src", "dst", "cost", "road_level"])
    return search.Network.of(n, e, mode)


FIVE = {1: (127.1, 33.1), 2: (127.1, 33.2), 3: (127.2, 33.2), 4: (127.2, 33.4), 5: (127.2, 33.3)}
FOUR = {1: (127.1, 33.1), 2: (127.1, 33.2), 3: (127.15, 33.25), 4: (127.2, 33.4)}
L0 = [(1, 1, 2, 40, 0), (3, 1, 3, 1, 0), (2, 2, 1, 2, 0), (5, 2, 4, 2, 0), (4, 3, 1, 1, 0), (7, 3, 4, 1, 0), (6, 4, 2, 2, 0), (8, 4, 3, 1, 0)]


def test_hand_made_graphs():
    assert search.search(network(FIVE, L0), 1, 4)[0] == [1, 3, 4]
    upper = [(1, 1, 2, 100, 0), (2, 1, 4, 1, 1), (3, 2, 4, 100, 0), (4, 4, 1, 1, 1)]
    assert search.search(network(FOUR, upper), 1, 4)[0] == [1, 4]
    apart = [(1, 1, 2, 1, 0), (2, 2, 1, 1, 0), (3, 3, 4, 1, 0), (4, 4, 3, 1, 0)]
    path, cost, trace = search.search(network(FOUR, apart), 1, 4)
    assert path is None and cost is None and trace == []
    assert search.search(network(FIVE, L0), 2, 2, track=True) == ([2], 0.0, [])


def test_trace():
    path, _, trace = search.search(network(FIVE, L0), 1, 4, track=True)
    assert path == [1, 3, 4] and trace and trace[0][:2] == (search.FORWARD, 1)
    assert set(trace[0][2]) == {2, 3}


def test_one_sided_search_agrees_here():
    assert search.search_one_sided(network(FIVE, L0), 1, 4)[0] == [1, 3, 4]
    assert search.search_one_sided(network(FOUR, [(1, 1, 2, 1, 0)]), 1, 4) == (None, None)


def random_network(seed, mode=CacheMode.INDEX_ONLY):
    r = random.Random(seed)
    nodes = {i: (33.2 + r.random() * 0.3, 126.2 + r.random() * 0.3) for i in range(60)}
    edges = [(k, r.randrange(60), r.randrange(60), 1 + r.random() * 9, r.randrange(3)) for k in range(220)]
    return network(nodes, edges, mode), edges


@pytest.mark.parametrize("seed", range(15))
def test_routes_are_walks_at_their_cost_and_never_beat_the_optimum(seed):
    net, edges = random_network(seed)
    cost_of = lambda km, level: km / SPEED_WEIGHT[level][0] * SPEED_WEIGHT[level][1]
    r = random.Random(seed)
    for _ in range(20):
        s, t = r.randrange(60), r.randrange(60)
        best = exact.least_costs(net, s)
        path, cost, _ = search.search(net, s, t)
        if path is None:
            continue
        assert path[0] == s and path[-1] == t and t in best
        steps = [[cost_of(km, level) for _, a, b, km, level in edges if (a, b) == hop] for hop in zip(path, path[1:])]
        assert all(steps)
        assert sum(map(min, steps)) - 1e-9 <= cost <= sum(map(max, steps)) + 1e-9
        assert cost >= best[t] - 1e-9


def test_single_precision_mode_rounds_level_zero_only():
    plain, single = random_network(3)[0], random_network(3, CacheMode.EDGE)[0]
    a, b = plain.sides[0], single.sides[0]
    assert (a.cost[a.level > 0] == b.cost[b.level > 0]).all() and (a.cost[a.level == 0] != b.cost[b.level == 0]).any()


def test_least_costs_match_relaxation():
    net, edges = random_network(9)
    want = {0: 0.0}
    queue = [(0.0, 0)]
    while queue:
        c, n = heapq.heappop(queue)
        if c > want[n]:
            continue
        for _, a, b, km, level in edges:
            total = c + km / SPEED_WEIGHT[level][0] * SPEED_WEIGHT[level][1]
            if a == n and total < want.get(b, 1e9):
                want[b] = total
                heapq.heappush(queue, (total, b))
    assert exact.least_costs(net, 0) == pytest.approx(want)


def test_too_large_a_graph_is_refused(spark):
    from tests.test_graph import sink_graph

    for config in (RouteConfig(broadcast_edges=1), RouteConfig(broadcast_bytes=100)):
        with pytest.raises(GraphTooLarge):
            search.network_of(sink_graph(spark), config)


def test_packed_ranges_make_the_same_network(spark):
    from tests.test_graph import sink_graph

    graph = sink_graph(spark)
    for mode in CacheMode:
        want = search.Network.of(graph.nodes.toPandas(), graph.edges.toPandas(), mode)
        for span in (1, 3, 1 << 16):
            got = search.network_of(graph, RouteConfig(nodes_per_range=span, cache_mode=mode))
            assert (got.lon == want.lon).all() and (got.lat == want.lat).all()
            for a, b in zip(got.sides, want.sides):
                assert all((getattr(a, part) == getattr(b, part)).all() for part in search.LAYOUT)


def test_pair_costs_of_a_mapped_network(spark, tmp_path):
    from tests.test_graph import sink_graph

    graph = sink_graph(spark)
    net = search.network_of(graph)
    n = len(net.lon)
    pairs = spark.createDataFrame([(i * n + j, i, j) for i in range(n) for j in range(n)], "req_id long, start_node long, end_node long")
    want = {i * n + j: exact.least_costs(net, i).get(j) for i in range(n) for j in range(n)}
    for network_ in (net, search.map_network(graph, str(tmp_path))):
        got = {r["req_id"]: r["cost"] for r in exact.exact_pair_costs(pairs, network_).collect()}
        assert got == pytest.approx(want)
        every = exact.exact_costs(pairs.select("start_node").distinct().withColumnRenamed("start_node", "source"), network_).collect()
        assert {(r["source"], r["node_id"]) for r in every} == {(k // n, k % n) for k, c in want.items() if c is not None}


def test_a_large_graph_is_mapped_from_files(spark, tmp_path):
    from tests.test_graph import request, sink_graph

    graph = sink_graph(spark)
    plain, mapped = search.network_of(graph), search.map_network(graph, str(tmp_path), RouteConfig(nodes_per_range=2))
    opened = search.Network.open(mapped.folder)
    for a, b in zip(plain.sides, opened.sides):
        assert all((getattr(a, part) == getattr(b, part)).all() for part in search.LAYOUT)
    assert (plain.lon == opened.lon).all()
    rows = request(spark, (37, 127.02, 37, 127.03), (37, 127.0, 37, 127.03))
    found = search.find_paths(rows, graph, config=RouteConfig(broadcast_edges=1)).collect()
    assert sorted((r["req_id"], r["status"], r["path"]) for r in found) == sorted((r["req_id"], r["status"], r["path"]) for r in search.find_paths(rows, graph).collect())


def test_stream_of_requests(spark, tmp_path):
    from tests.test_graph import request, sink_graph
    from waymill.streaming.requests import answer_stream

    request(spark, (37, 127.02, 37, 127.03), (37, 127.0, 37, 127.03)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("req_id long, start_lat double, start_lon double, end_lat double, end_lon double").parquet(str(tmp_path / "in"))
    for name, config in (("out", RouteConfig()), ("mapped", RouteConfig(broadcast_edges=1))):
        answer_stream(stream, sink_graph(spark), str(tmp_path / name), str(tmp_path / f"mark_{name}"), config).awaitTermination()
        got = {r["req_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert got == {0: "OK", 1: "NO_ROUTE"}


def test_no_network_is_made_where_no_request_needs_one(spark, monkeypatch):
    from tests.test_graph import request, sink_graph

    monkeypatch.setattr(search, "shared_network", lambda *_: pytest.fail("a network"))
    found = search.find_paths(request(spark, (-37, 127.0, 37, 127.03)), sink_graph(spark), track=True).collect()
    assert [tuple(r) for r in found] == [(0, "NO_NODE", None, None, None)]


def test_requests_end_south_of_a_network_of_any_height(spark, tmp_path, monkeypatch):
    """Of three rows of customers 60 degrees apart: none ends where another is."""
    from waymill.plans import fixtures, queries

    rows = [(0, 1, "F", "1-URGENT"), (2, 480_001, "F", "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(480_100).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1).select(F.lit(0).cast("long").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    far = spark.createDataFrame([(0, 33.2001, 126.205, 93.1999, 126.205)], "req_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    monkeypatch.setattr(fixtures, "requests", lambda *_: far)
    assert [tuple(r) for r in queries.route_not_found(spark, str(tmp_path)).collect()] == [(0, "NO_NODE")]


def test_a_trace_of_routes_by_node(spark):
    from tests.test_graph import sink_graph

    graph = sink_graph(spark)
    net = search.network_of(graph)
    n = len(net.lon)
    pairs = spark.createDataFrame([(i * n + j, i, j) for i in range(n) for j in range(n)], "req_id long, start_node long, end_node long")
    place = lambda i: (net.lat[i], net.lon[i])
    for r in search.routes_by_node(pairs, net, track=True).collect():
        path, cost, trace = search.search(net, r["req_id"] // n, r["req_id"] % n, True)
        got = [(t["seq"], t["side"], tuple(t["parent"]), [tuple(v) for v in t["visited"]]) for t in r["trace"]]
        assert (r["path"], r["cost"]) == (path, cost) and got == [(i, search.SIDES[s], place(v), [place(w) for w in seen]) for i, (s, v, seen) in enumerate(trace)]


def ask(spark, nodes):
    return spark.createDataFrame([(i * nodes + j, i, j) for i in range(nodes) for j in range(nodes)], "req_id long, start_node long, end_node long")


@pytest.mark.parametrize("seed", range(3))
def test_routes_and_costs_in_the_jvm_are_those_of_the_method(spark, seed):
    """Of all pairs of a network whose near ends, gates and missing ways make every branch count; none is left to Python."""
    net, _ = random_network(seed)
    n = len(net.lon)
    found = search.routes_by_node(ask(spark, n), net)
    costs = exact.exact_pair_costs(ask(spark, n), net)
    for table in (found, costs):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "MapPartitions" in plan and "InArrow" not in plan and "InPandas" not in plan
    got, least = {r["req_id"]: r for r in found.collect()}, {r["req_id"]: r["cost"] for r in costs.collect()}
    assert len(got) == len(least) == n * n
    for i in range(n):
        best = exact.least_costs(net, i)
        for j in range(n):
            path, cost, _ = search.search(net, i, j)
            assert (got[i * n + j]["path"], got[i * n + j]["cost"], got[i * n + j]["trace"]) == (path, pytest.approx(cost) if cost else cost, None)
            assert least[i * n + j] == (pytest.approx(best[j]) if j in best else None)


def test_equal_estimates_leave_the_queue_in_order_in_the_jvm(spark):
    """A grid of unit steps, in which nearly all estimates are equal to others."""
    side = range(12)
    nodes = {12 * a + b: (33.0, 127.0) for a in side for b in side}
    steps = [(12 * a + b, 12 * c + d) for a in side for b in side for c, d in ((a + 1, b), (a, b + 1), (a - 1, b), (a, b - 1)) if c in side and d in side]
    net = network(nodes, [(k, a, b, 1, (a + b) % 2 + 1) for k, (a, b) in enumerate(steps)])
    got = {r["req_id"]: r["path"] for r in search.routes_by_node(ask(spark, 144).where("req_id % 7 = 0"), net).collect()}
    assert got == {k: search.search(net, k // 144, k % 144)[0] for k in range(0, 144 * 144, 7)}


def test_a_network_is_handed_out_as_files(spark, tmp_path, monkeypatch):
    """Spark hands out no local folder where executors are on other machines."""
    from tests.test_graph import sink_graph

    added = []
    monkeypatch.setattr(type(spark.sparkContext), "addFile", lambda _, path, recursive=False: added.append((path, recursive)))
    search.map_network(sink_graph(spark), str(tmp_path)).share(spark)
    assert len(added) == 10 and all(path.endswith(".npy") and not folder for path, folder in added)


@pytest.mark.parametrize("name", ["route_invariants", "route_steps_checked"])
def test_a_check_of_routes_searches_each_once(spark, name):
    """Wherever the plan reads routes, it reads those that are kept."""
    from waymill.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("InMemoryRelation") and "path#" in line]
    assert len(read) > 1 and all("path#" not in line for line in plan.splitlines() if "MapPartitions" in line)


def kept_edges(spark, net):
    """How many edges either direction of the JVM's network keeps of each node, by the files' numbers."""
    folder = SparkFiles.get(search.stored(net, spark))
    made = kernel._loader(spark).loadClass("waymill.Routes$Network").getDeclaredConstructors()[0]
    made.setAccessible(True)
    args = spark._jvm.java.util.ArrayList()
    args.add(folder)
    network_ = made.newInstance(args.toArray())

    def field(of, name):
        found = of.getClass().getDeclaredField(name)
        found.setAccessible(True)
        return found.get(of)

    count = spark._jvm.java.lang.Class.forName("waymill.Routes$Layout", True, kernel._loader(spark)).getDeclaredMethods()
    count = next(m for m in count if m.getName() == "count")
    count.setAccessible(True)
    number = field(network_, "numberOf")

    def of(side, node):
        args = spark._jvm.java.util.ArrayList()
        args.add(int(number[node]))
        return count.invoke(side, args.toArray())

    return [[of(side, node) for node in range(len(net.lon))] for side in field(network_, "sides")]


def test_parallel_edges_that_lower_nothing_are_left_out_in_the_jvm(spark):
    """An edge after one as cheap to the same node; not one of another level, nor one after a dearer one."""
    nodes = {0: (33.2, 126.2), 1: (33.3, 126.2), 2: (33.3, 126.3)}
    edges = [(0, 0, 1, 5, 0), (1, 0, 1, 5, 0), (2, 0, 1, 9, 0), (3, 0, 1, 4, 0), (4, 0, 1, 4, 2), (5, 0, 1, 4, 2), (6, 1, 2, 1, 1), (7, 1, 2, 1, 2)]
    assert kept_edges(spark, network(nodes, edges)) == [[3, 1, 0], [0, 3, 1]]


@pytest.mark.parametrize("seed", range(2))
def test_routes_over_parallel_edges_in_the_jvm_are_those_of_the_method(spark, seed):
    r = random.Random(seed)
    nodes = {i: (33.2 + r.random() * 0.3, 126.2 + r.random() * 0.3) for i in range(25)}
    near = [(i, (i + r.randrange(1, 4)) % 25) for i in range(25)]
    net = network(nodes, [(k, *r.choice(near), r.choice((3, 6, 9)), r.randrange(3)) for k in range(500)])
    found = {r["req_id"]: r for r in search.routes_by_node(ask(spark, 25), net).collect()}
    costs = {r["req_id"]: r["cost"] for r in exact.exact_pair_costs(ask(spark, 25), net).collect()}
    for i in range(25):
        best = exact.least_costs(net, i)
        for j in range(25):
            path, cost, _ = search.search(net, i, j)
            assert (found[i * 25 + j]["path"], found[i * 25 + j]["cost"]) == (path, pytest.approx(cost) if cost else cost)
            assert costs[i * 25 + j] == (pytest.approx(best[j]) if j in best else None)


def test_ranges_are_packed_in_as_many_partitions(spark):
    """The driver fetches them by a job a partition, however many a session shuffles to."""
    from tests.test_graph import sink_graph

    for ranges in (1, 9):
        assert search._packed_edges(sink_graph(spark), 1, ranges, CacheMode.INDEX_ONLY).rdd.getNumPartitions() == 2 * ranges


@pytest.mark.parametrize("name", ["route_by_node", "route_by_node_checked", "sssp_exact"])
def test_requests_are_counted_before_they_are_snapped(spark, name, monkeypatch):
    """The number of tasks needs no second snapping of all requests."""
    from waymill.plans import queries

    counts = []
    for module, f in ((search, search.routes_by_node), (exact, exact.exact_pair_costs)):
        monkeypatch.setattr(module, f.__name__, lambda *a, f=f, **b: counts.append(inspect.signature(f).bind(*a, **b).arguments.get("count")) or f(*a, **b))
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert counts and set(counts) == {n}


@pytest.mark.parametrize("name", ["route_by_node_checked", "sssp_exact"])
def test_requests_are_snapped_once(spark, name, monkeypatch):
    """Both sides of a comparison read the nodes that are kept with the network."""
    from waymill.plans import queries

    calls = []
    monkeypatch.setattr(search, "resolve", lambda *a, f=search.resolve: calls.append(a) or f(*a))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) <= 1


@pytest.mark.parametrize("seed", range(2))
def test_steps_from_a_routes_own_row_are_those_of_all_hops(spark, seed):
    r = random.Random(seed)
    nodes = {i: (33.2 + r.random() * 0.3, 126.2 + r.random() * 0.3) for i in range(25)}
    net = network(nodes, [(k, i, (i + r.randrange(1, 4)) % 25, r.choice((3, 6, 9)), r.randrange(3)) for k, i in enumerate([*range(25)] * 4)])
    places = spark.createDataFrame([(i, *p) for i, p in nodes.items()], "node_id long, lat double, lon double")
    want = search.route_steps(search.routes_by_node(ask(spark, 25), net), places)
    got = search.route_steps(search.placed_routes(ask(spark, 25), net))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {row["turn"] for row in got.where("step = 0").collect()} == {"START"}


def test_route_steps_neither_shuffles_nor_sorts_all_steps(spark):
    """What was a join with all nodes, a shuffle by request and a window took a quarter of the query's time."""
    from waymill.plans import queries

    plan = queries.QUERIES["route_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapPartitions")[0]
    assert "Generate posexplode" in above and not any(kind in above for kind in ("Join", "Window", "Sort", "Repartition"))


def bent(r, crossings: int, roads: int):
    """Crossings, and roads between them over one or two bends, some one-way, some parallel or a loop at a bend."""
    nodes = {i: (33.2 + r.random() * 0.3, 126.2 + r.random() * 0.3) for i in range(crossings + 2 * roads)}
    steps = []
    for k in range(roads):
        a, b = r.randrange(crossings), r.randrange(crossings)
        line = [a, crossings + 2 * k, *([crossings + 2 * k + 1] if k % 3 == 0 else []), b]
        for way in r.choice(([line], [line[::-1]], [line, line[::-1]])):
            steps += [*zip(way, way[1:])] * r.choice((1, 1, 2))
        steps += [(line[1], line[1])] * (k % 7 == 0)
    return nodes, [(k, a, b, r.randrange(1, 20), r.randrange(3)) for k, (a, b) in enumerate(steps)]


def test_least_costs_pass_over_bends_in_the_jvm(spark):
    """From and to every node, bends and nodes without a road too."""
    r = random.Random(5)
    nodes, edges = bent(r, 8, 18)
    net = network(nodes, edges)
    n = len(nodes)
    costs = {r["req_id"]: r["cost"] for r in exact.exact_pair_costs(ask(spark, n), net).collect()}
    for i in range(n):
        best = exact.least_costs(net, i)
        assert {j: costs[i * n + j] for j in range(n) if costs[i * n + j] is not None} == pytest.approx(best)


def test_bends_are_not_in_the_core(spark):
    """A search for least costs meets crossings alone: of a road a - bend - bend - b one bend is passed over, of a - bend - b the only one."""
    nodes = {i: (33.2 + i / 100, 126.2 + (i % 3) / 100) for i in range(9)}
    ways = [(0, 4), (4, 1), (1, 5), (5, 2), (2, 6), (6, 0), (0, 7), (7, 8), (8, 3), (1, 3), (2, 3), (0, 1), (1, 2)]
    net = network(nodes, [(k, a, b, 1, 2) for k, (a, b) in enumerate([*ways, *[(b, a) for a, b in ways]])])
    folder = SparkFiles.get(search.stored(net, spark))

    def made(name, *values):
        args = spark._jvm.java.util.ArrayList()
        for v in values:
            args.add(v)
        constructor = kernel._loader(spark).loadClass(f"waymill.Routes${name}").getDeclaredConstructors()[0]
        constructor.setAccessible(True)
        return constructor.newInstance(args.toArray())

    def field(of, name):
        found = of.getClass().getDeclaredField(name)
        found.setAccessible(True)
        return found.get(of)

    opened = made("Network", folder)
    passed, number = field(made("Core", opened), "passed"), field(opened, "numberOf")
    assert [bool(passed[number[n]]) for n in (0, 1, 2, 4, 5, 6)] == [False] * 3 + [True] * 3
    assert sum(bool(passed[number[n]]) for n in (7, 8)) == 1


@pytest.mark.parametrize("seed", range(2))
def test_flat_traces_in_the_jvm_are_those_of_the_method(spark, seed):
    """Over parallel edges, each of which counts as seen."""
    from waymill.plans.queries import trace_checks

    r = random.Random(seed)
    nodes = {i: (33.2 + r.random() * 0.3, 126.2 + r.random() * 0.3) for i in range(25)}
    near = [(i, (i + r.randrange(1, 4)) % 25) for i in range(25)]
    net = network(nodes, [(k, *r.choice(near), r.choice((3, 6, 9)), r.randrange(3)) for k in range(120)])
    want = search.flat_trace(search.routes_by_node(ask(spark, 25), net, track=True))
    got = search.traces(ask(spark, 25), net)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for row in search.traces(ask(spark, 25).where("req_id % 25 = 7"), net, visited=True).where("seq is not null").collect():
        seen = search.search(net, row["req_id"] // 25, 7, True)[2][row["seq"]][2]
        assert pd.Series(memoryview(row["visited"]).cast("d")).tolist() == [v for node in seen for v in nodes[node]]
    checks = search.traces(ask(spark, 25), net, visited=True).mapInArrow(trace_checks, "req_id long, dense boolean, each_once boolean, reaches_route boolean").collect()
    assert sorted(map(tuple, checks)) == [(i, True, True, True) for i in range(625)]


@pytest.mark.parametrize("size", (1, 2, 100))
def test_checks_of_traces_find_what_is_wrong(size):
    """However a request's rows are cut into batches."""
    import pyarrow as pa

    from waymill.plans.queries import trace_checks

    at = lambda *places: pd.Series([float(v) for p in places for v in (p, 100 + p)], dtype=float).to_numpy().tobytes()
    route = lambda req, *places: (req, None, None, None, None, len(places), at(*places))
    step = lambda req, seq, side, place, *seen: (req, seq, side, float(place), 100.0 + place, len(seen), at(*seen))
    rows = [
        route(1, 1, 2, 3, 4), step(1, 0, "FORWARD", 1, 2), step(1, 1, "REVERSE", 4, 3), step(1, 2, "REVERSE", 1),
        route(2, 1, 2, 3), step(2, 0, "FORWARD", 1, 4),  # the route's inner node isn't seen
        route(3, 1, 2), step(3, 0, "FORWARD", 1, 2), step(3, 2, "FORWARD", 3),  # a number is missing
        route(4), step(4, 0, "FORWARD", 1, 2), step(4, 1, "FORWARD", 1),  # one is expanded twice
        route(5, 1),
    ]
    schema = pa.schema([("req_id", pa.int64()), ("seq", pa.int32()), ("side", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("n_visited", pa.int32()), ("visited", pa.binary())])
    batches = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema).to_batches(size)
    got = [tuple(r.values()) for batch in trace_checks(iter(batches)) for r in batch.to_pylist()]
    assert got == [(1, True, True, True), (2, True, True, False), (3, False, True, True), (4, True, False, True), (5, True, True, True)]


@pytest.mark.parametrize("name", ["route_trace", "route_trace_checked"])
def test_traces_need_no_network_on_the_driver(spark, name, monkeypatch):
    from waymill.plans import queries

    monkeypatch.setattr(search, "network_of", lambda *_: pytest.fail("a network on the driver"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_the_driver_gives_back_what_a_network_took_to_make(spark, tmp_path, monkeypatch):
    """Before its searches, which at sixty times sf0.1 began with 1,308 MB of the driver taken."""
    from tests.test_graph import sink_graph

    given, fill = [], search._fill
    monkeypatch.setattr(kernel, "release", lambda session, f=kernel.release: given.append(f(session)) or given[-1])
    monkeypatch.setattr(search, "_fill", lambda *a: (made := fill(*a), given.append("filled"))[0])
    search.map_network(sink_graph(spark), str(tmp_path))
    assert given == [True, True, True, "filled"]


def test_route_invariants_snaps_requests_once(spark, monkeypatch):
    from waymill.plans import queries

    calls = []
    assert queries.Net(spark, "/root/testdata/sf0.001").resolved.columns
    monkeypatch.setattr(search, "resolve", lambda *a, f=search.resolve: calls.append(a) or f(*a))
    queries.QUERIES["route_invariants"](spark, "/root/testdata/sf0.001")
    assert not calls
