"""Batched route search: hierarchical bidirectional best-first search over a shared graph.

The graph is two compressed layouts (out-edges by source, in-edges by destination), each with
a node's edges in the order of their levels, so an expansion reads one slice. Requests are dealt
to tasks. search() is the method; kernel.py says the same in the JVM, which answers requests
and gives traces as flat rows; a trace as one nested value is search()'s own. The heuristic overestimates on level 0, and a node keeps one label though the levels it may go on
to depend on the edge it was reached by: a route isn't always the cheapest one, and a reachable
pair can be missed. Equal estimates leave the queue in the order they came.
"""

from __future__ import annotations

import heapq
import math
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CacheMode, RouteConfig
from ..errors import EmptyGeometry, GraphTooLarge
from ..functions.geo import EARTH_KM, HEURISTIC_SPEED, HEURISTIC_WEIGHT, NEAR_TARGET
from . import kernel
from . import snap as snapping
from .graph import Graph
from .guidance import turn_steps, turns_of_paths

FORWARD, REVERSE = 0, 1
SIDES = ("FORWARD", "REVERSE")
TRACE = "array<struct<seq:int,side:string,parent:struct<lat:double,lon:double>,visited:array<struct<lat:double,lon:double>>>>"
FOUND = f"req_id long, path array<int>, cost double, trace {TRACE}"


@dataclass
class Layout:
    """Edges by node and level: those of node n at level l are at[3n + l] up to at[3n + l + 1]."""

    at: np.ndarray
    other: np.ndarray
    cost: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, other: np.ndarray, cost: np.ndarray, level: np.ndarray, edge: np.ndarray, nodes: int) -> "Layout":
        order = np.lexsort((edge, level, node))
        at = np.zeros(3 * nodes + 1, np.int64)
        np.add.at(at, node * 3 + level + 1, 1)
        return cls(np.cumsum(at), other[order], cost[order], level[order])


LAYOUT = ("at", "other", "cost", "level")


@dataclass
class Network:
    lon: np.ndarray
    lat: np.ndarray
    sides: tuple[Layout, Layout]
    files: tuple[str, str] | None = None  # the application and the name that stored() shared it by

    def __post_init__(self):
        self.x, self.y = np.radians(self.lon), np.radians(self.lat)
        self.cos_y = np.cos(self.y)

    @classmethod
    def of(cls, nodes: pd.DataFrame, edges: pd.DataFrame, mode: CacheMode = CacheMode.INDEX_ONLY) -> "Network":
        """nodes(node_id, lon, lat) and edges(edge_id, src, dst, cost, road_level)."""
        n = int(max(nodes["node_id"].max() if len(nodes) else -1, edges[["src", "dst"]].max().max() if len(edges) else -1)) + 1
        lon, lat = np.zeros(n), np.zeros(n)
        lon[nodes["node_id"]], lat[nodes["node_id"]] = nodes["lon"], nodes["lat"]
        src, dst, level = edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64), edges["road_level"].to_numpy(np.int64)
        cost, edge = edges["cost"].to_numpy(np.float64), edges["edge_id"].to_numpy(np.int64)
        if mode is CacheMode.EDGE:
            cost = np.where(level == 0, cost.astype(np.float32).astype(np.float64), cost)
        small = level.astype(np.int8)
        return cls(lon, lat, (Layout.of(src, dst.astype(np.int32), cost, small, edge, n), Layout.of(dst, src.astype(np.int32), cost, small, edge, n)))

    @classmethod
    def open(cls, folder: str) -> "Network":
        """The network whose arrays lie in folder, mapped into memory."""
        path = kernel.prefix(folder)
        load = lambda name: np.asarray(np.load(f"{path}{name}.npy", mmap_mode="r" if os.path.getsize(f"{path}{name}.npy") > 128 else None))
        return cls(load("lon"), load("lat"), tuple(Layout(*(load(f"{side}_{part}") for part in LAYOUT)) for side in ("out", "in")))

    def km(self, a: int, b: int) -> float:
        h = math.sin((self.y[b] - self.y[a]) / 2) ** 2 + self.cos_y[a] * self.cos_y[b] * math.sin((self.x[b] - self.x[a]) / 2) ** 2
        return 2 * EARTH_KM * math.asin(math.sqrt(h))

    def edges(self, side: int, node: int, arrived: int | None, km_left: float):
        """(other end, cost, level) of the edges that a node reached by an edge of level `arrived`,
        km_left from the target, goes on with."""
        layout = self.sides[side]
        start, above, _, stop = layout.at[3 * node : 3 * node + 4].tolist()
        if arrived == 0 and above > start:
            stop = above
        elif arrived == 1 and km_left / HEURISTIC_SPEED > NEAR_TARGET:
            start = above
        return zip(layout.other[start:stop].tolist(), layout.cost[start:stop].tolist(), layout.level[start:stop].tolist())


class _Side:
    """One direction's labels and queue."""

    def __init__(self, network: Network, side: int, start: int, target: int):
        self.network, self.side, self.target = network, side, target
        self.cost, self.previous, self.done = {start: 0.0}, {}, set()
        self.left: dict[int, float] = {}
        # Views give plain floats, which are much faster here than an array's own.
        self.x, self.y, self.cos_y = memoryview(network.x), memoryview(network.y), memoryview(network.cos_y)
        self.end = self.x[target], self.y[target], self.cos_y[target]
        self.queue, self.pushed = [(self.estimate(start), 0, start, 0.0, None)], 0

    def km_left(self, node: int) -> float:
        km = self.left.get(node)
        if km is None:
            x, y, cos_y = self.end
            h = math.sin((y - self.y[node]) / 2) ** 2 + self.cos_y[node] * cos_y * math.sin((x - self.x[node]) / 2) ** 2
            km = self.left[node] = 2 * EARTH_KM * math.asin(math.sqrt(h))
        return km

    def estimate(self, node: int) -> float:
        return self.km_left(node) / HEURISTIC_SPEED * HEURISTIC_WEIGHT

    def push(self, node: int, cost: float, level: int) -> None:
        self.pushed += 1
        heapq.heappush(self.queue, (cost + self.estimate(node), self.pushed, node, cost, level))

    def back(self, node: int) -> list[int]:
        line = [node]
        while node in self.previous:
            node = self.previous[node]
            line.append(node)
        return line


def search(network: Network, start: int, end: int, track: bool = False):
    """(path or None, cost, trace) from start to end; the trace is [(side, node, nodes seen from it)]."""
    trace: list = []
    if start == end:
        return [start], 0.0, trace
    sides = (_Side(network, FORWARD, start, end), _Side(network, REVERSE, end, start))
    best, meet = math.inf, None
    while sides[0].queue and sides[1].queue:
        tops = sides[0].queue[0][0], sides[1].queue[0][0]
        if meet is not None and min(tops) >= best:
            break
        own, opposite = sides if tops[0] <= tops[1] else sides[::-1]
        _, _, node, cost, level = heapq.heappop(own.queue)
        if cost > own.cost[node] or node in own.done:
            continue
        own.done.add(node)
        seen: list[int] = []
        if track:
            trace.append((own.side, node, seen))
        if node in opposite.cost and cost + opposite.cost[node] < best:
            best, meet = cost + opposite.cost[node], node
        for other, step, below in network.edges(own.side, node, level, own.km_left(node)):
            if other in own.done:
                continue
            seen.append(other)
            total = cost + step
            if total < own.cost.get(other, math.inf):
                own.cost[other], own.previous[other] = total, node
                own.push(other, total, below)
                if other in opposite.cost and total + opposite.cost[other] < best:
                    best, meet = total + opposite.cost[other], other
    if meet is None:
        return None, None, trace
    return sides[0].back(meet)[::-1] + sides[1].back(meet)[1:], best, trace


def search_one_sided(network: Network, start: int, end: int):
    """(path or None, cost): the same policy from the start only, until the end leaves the queue."""
    side = _Side(network, FORWARD, start, end)
    while side.queue:
        _, _, node, cost, level = heapq.heappop(side.queue)
        if node == end:
            return side.back(end)[::-1], cost
        if cost > side.cost[node] or node in side.done:
            continue
        side.done.add(node)
        for other, step, below in network.edges(FORWARD, node, level, side.km_left(node)):
            total = cost + step
            if other not in side.done and total < side.cost.get(other, math.inf):
                side.cost[other], side.previous[other] = total, node
                side.push(other, total, below)
    return None, None


def _packed_nodes(graph: Graph, span: int) -> DataFrame:
    """(part, at, lon, lat): the nodes of each range of span ids as packed arrays; at: their ids."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("node_id").to_numpy()
        order = np.argsort(ids)
        columns = [table.column("part")[:1], *(pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary()) for a, kind in ((ids[order], np.int64), (table.column("lon").to_numpy()[order], np.float64), (table.column("lat").to_numpy()[order], np.float64)))]
        return pa.table(columns, names=["part", "at", "lon", "lat"])

    nodes = graph.nodes.select(F.floor(F.col("node_id") / span).alias("part"), "node_id", "lon", "lat")
    return nodes.groupBy("part").applyInArrow(pack, "part long, at binary, lon binary, lat binary")


def _packed_edges(graph: Graph, span: int, ranges: int, mode: CacheMode) -> DataFrame:
    """(side, part, n, at, other, cost, level): both layouts' ranges of span nodes, sorted and packed by executors.

    As many partitions as ranges: the driver fetches them by a job each.
    """
    both = [graph.edges.select(F.lit(side).alias("side"), F.floor(F.col(node) / span).alias("part"), F.col(node).alias("node"), F.col(other).alias("other"), "cost", "road_level", "edge_id") for side, (node, other) in enumerate((("src", "dst"), ("dst", "src")))]

    def pack(table: pa.Table) -> pa.Table:
        node, other, cost, level, edge = (table.column(c).to_numpy() for c in ("node", "other", "cost", "road_level", "edge_id"))
        part = table.column("part")[0].as_py()
        if mode is CacheMode.EDGE:
            cost = np.where(level == 0, cost.astype(np.float32).astype(np.float64), cost)
        made = Layout.of(node.astype(np.int64) - part * span, other.astype(np.int32), cost.astype(np.float64), level.astype(np.int8), edge.astype(np.int64), span)
        data = [pa.array([np.ascontiguousarray(getattr(made, name)).tobytes()], pa.binary()) for name in LAYOUT]
        return pa.table([table.column("side")[:1], table.column("part")[:1], pa.array([len(node)], pa.int64()), *data], names=["side", "part", "n", *LAYOUT])

    kinds = ", ".join(f"{name} binary" for name in LAYOUT)
    return both[0].unionByName(both[1]).repartition(2 * ranges, "side", "part").groupBy("side", "part").applyInArrow(pack, f"side int, part long, n long, {kinds}")


def _fill(graph: Graph, config: RouteConfig, new) -> tuple:
    """(lon, lat, sides) made by new(name, kind, size) from ranges that executors pack, one range at a time.

    The driver holds the arrays and one range, and neither sorts nor converts a row.
    """
    top = graph.nodes.agg(F.max("node_id")).first()[0], *graph.edges.agg(F.max("src"), F.max("dst")).first()
    n, span = 1 + max((int(t) for t in top if t is not None), default=-1), config.nodes_per_range
    lon, lat = new("lon", np.float64, n), new("lat", np.float64, n)
    kernel.release(graph.nodes.sparkSession)  # of what the graph's own tables took to make
    for row in _packed_nodes(graph, span).toLocalIterator(prefetchPartitions=True):
        at = np.frombuffer(row["at"], np.int64)
        lon[at], lat[at] = np.frombuffer(row["lon"], np.float64), np.frombuffer(row["lat"], np.float64)
    ranges = max(1, -(-n // span))
    parts = _packed_edges(graph, span, ranges, config.cache_mode).persist(StorageLevel.DISK_ONLY)
    sizes = np.zeros((2, ranges + 1), np.int64)
    for row in parts.select("side", "part", "n").collect():
        sizes[row["side"], row["part"] + 1] = row["n"]
    starts = np.cumsum(sizes, axis=1)
    kinds = dict(zip(LAYOUT, (np.int64, np.int32, np.float64, np.int8)))
    sides = [{name: new(f"{side}_{name}", kind, 3 * n + 1 if name == "at" else int(starts[i, -1])) for name, kind in kinds.items()} for i, side in enumerate(("out", "in"))]
    for side, arrays in enumerate(sides):
        for part in range(len(starts[side]) - 1):
            arrays["at"][3 * part * span : 3 * (part + 1) * span] = starts[side, part]
        arrays["at"][3 * n] = starts[side, -1]
    kernel.release(parts.sparkSession)
    for row in parts.toLocalIterator(prefetchPartitions=True):
        arrays, start, low = sides[row["side"]], starts[row["side"], row["part"]], row["part"] * span
        at = np.frombuffer(row["at"], np.int64)[: 3 * (min(n, low + span) - low) + 1]
        arrays["at"][3 * low : 3 * low + len(at)] = at + start
        for name in LAYOUT[1:]:
            arrays[name][start : start + row["n"]] = np.frombuffer(row[name], kinds[name])
    parts.unpersist()
    kernel.release(parts.sparkSession)
    return lon, lat, sides


def network_of(graph: Graph, config: RouteConfig = RouteConfig()) -> Network:
    """The graph's arrays on the driver, to be broadcast; GraphTooLarge beyond config's edges or bytes."""
    count, nodes = graph.edges.count(), graph.nodes.count()
    size = 2 * 13 * count + (2 * 8 * 3 + 5 * 8) * nodes
    if count > config.broadcast_edges or size > config.broadcast_bytes:
        raise GraphTooLarge(f"{count} edges and {size} bytes; at most {config.broadcast_edges} and {config.broadcast_bytes} are broadcast")
    lon, lat, sides = _fill(graph, config, lambda name, kind, size: np.zeros(size, kind))
    return Network(lon, lat, tuple(Layout(**arrays) for arrays in sides))


def map_network(graph: Graph, folder: str, config: RouteConfig = RouteConfig()) -> "MappedNetwork":
    """The graph's arrays as files in folder on the driver, which Spark hands to the executors.

    For graphs too large to broadcast: executors map the files and share their pages.
    """
    made = []

    def new(name: str, kind, size: int):
        if not size:  # an empty file can't be mapped
            np.save(f"{kernel.prefix(folder)}{name}.npy", np.zeros(0, kind))
            return np.zeros(0, kind)
        made.append(np.lib.format.open_memmap(f"{kernel.prefix(folder)}{name}.npy", "w+", kind, (size,)))
        return made[-1]

    _fill(graph, config, new)
    for array in made:
        array.flush()
    return MappedNetwork(folder)


def filed_network(graph: Graph, config: RouteConfig = RouteConfig()) -> "MappedNetwork":
    """map_network() among the session's own files, which end with it."""
    return map_network(graph, tempfile.mkdtemp(prefix="network", dir=SparkFiles.getRootDirectory()), config)


def shared_network(graph: Graph, config: RouteConfig = RouteConfig()) -> "Network | MappedNetwork":
    """network_of(), or where the graph is too large for that filed_network()."""
    try:
        return network_of(graph, config)
    except GraphTooLarge:
        return filed_network(graph, config)


def opener(network: "Network | MappedNetwork", spark: SparkSession):
    """A function that gives the network on executors."""
    if isinstance(network, MappedNetwork):
        return network.share(spark)
    shared = spark.sparkContext.broadcast(network)
    return lambda: shared.value


def stored(network: "Network | MappedNetwork", spark: SparkSession) -> str:
    """kernel.share() of the network's files; a Network's are written once an application."""
    if isinstance(network, MappedNetwork):
        return kernel.share(network.folder, spark)
    key = spark.sparkContext.applicationId
    if network.files is None or network.files[0] != key:
        folder = tempfile.mkdtemp(prefix="network", dir=SparkFiles.getRootDirectory())
        kernel.save(network, folder)
        network.files = key, kernel.share(folder, spark)
    return network.files[1]


@dataclass(frozen=True)
class MappedNetwork:
    """A folder of map_network()'s files; Spark hands it to the executors."""

    folder: str

    def share(self, spark: SparkSession):
        name = kernel.share(self.folder, spark)
        return lambda: Network.open(SparkFiles.get(name))


def _dealt(requests: DataFrame, config: RouteConfig, count: int | None) -> DataFrame:
    # A number of tasks of our own: rows are few, but each is a search, so they mustn't be coalesced.
    count = requests.count() if count is None else count
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-count // config.requests_per_task))
    return requests.select("req_id", "start_node", "end_node").repartition(tasks, "req_id")


def placed_routes(requests: DataFrame, network: Network | MappedNetwork, config: RouteConfig = RouteConfig(), count: int | None = None) -> DataFrame:
    """(req_id, path, cost, lat, lon): routes_by_node(), with the coordinates of the path's nodes as arrays beside it."""
    return kernel.run(_dealt(requests, config, count), stored(network, requests.sparkSession), places=True)


def traces(requests: DataFrame, network: Network | MappedNetwork, config: RouteConfig = RouteConfig(), count: int | None = None, visited: bool = False) -> DataFrame:
    """flat_trace() of requests(req_id, start_node, end_node), searched in the executors' JVMs, a row at a time.

    A request's rows stand together, in order. visited: with them their places, and the route before them, as Traces in Routes.java says.
    """
    return kernel.run(_dealt(requests, config, count), stored(network, requests.sparkSession), places=visited, traced=True)


def routes_by_node(requests: DataFrame, network: Network | MappedNetwork, track: bool = False, config: RouteConfig = RouteConfig(), count: int | None = None) -> DataFrame:
    """FOUND for requests(req_id, start_node, end_node); path, cost are null where no route is found, trace without track. count: about how many requests there are, if known.

    Routes are searched in the executors' JVMs (kernel.py), traces by search() in Python.
    """
    spark, dealt = requests.sparkSession, _dealt(requests, config, count)
    if not track:
        return kernel.run(dealt, stored(network, spark)).select("*", F.lit(None).cast(TRACE).alias("trace"))
    opened = opener(network, spark)
    place = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
    names, kinds = ["req_id", "path", "cost", "trace"], [pa.int64(), pa.list_(pa.int32()), pa.float64()]
    kinds.append(pa.list_(pa.struct([("seq", pa.int32()), ("side", pa.string()), ("parent", place), ("visited", pa.list_(place))])))

    def run(batches):
        network = opened()

        def places(nodes: np.ndarray) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array(network.lat[nodes]), pa.array(network.lon[nodes])], ["lat", "lon"])

        def steps(trace: list) -> pa.Array:
            """One row: the trace as a list, from arrays, as a Python object a place takes a hundred times the room."""
            count = len(trace)
            side, node = (np.fromiter((t[i] for t in trace), np.int64, count) for i in (0, 1))
            ends = np.cumsum([0, *(len(t[2]) for t in trace)])
            seen = np.fromiter((v for t in trace for v in t[2]), np.int64, int(ends[-1]))
            trace.clear()
            visited = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places(seen))
            sides = pa.array(SIDES).take(pa.array(side))
            rows = pa.StructArray.from_arrays([pa.array(np.arange(count), pa.int32()), sides, places(node), visited], ["seq", "side", "parent", "visited"])
            return pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), rows)

        for batch in batches:
            for req, start, end in zip(*(batch.column(c).to_pylist() for c in ("req_id", "start_node", "end_node"))):
                path, cost, trace = search(network, start, end, True)
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((req, path, cost), kinds)] + [steps(trace).cast(kinds[3])], names)

    return dealt.mapInArrow(run, FOUND)


def ends(requests: DataFrame) -> DataFrame:
    """Both ends of requests(req_id, start_lat, ..., end_lon) as points, numbered 2 * req_id and one more."""
    both = F.explode(F.array(*[F.struct((F.col("req_id") * 2 + i).alias("req_id"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for i, e in enumerate(("start", "end"))]))
    return requests.select(both.alias("p")).select("p.*")


def resolve(requests: DataFrame, graph: Graph, config: RouteConfig = RouteConfig()) -> DataFrame:
    """requests with start_node, end_node and status: OK, NO_NODE near an end, or NO_EDGE out of its node."""
    snapped = snapping.snap(ends(requests), graph.index, graph.nodes, config.snap_metres, config.snap_candidates)
    out = graph.edges.select(F.col("src").alias("node_id")).distinct().withColumn("has_edge", F.lit(True))
    known = snapped.join(out, "node_id", "left").select(F.floor(F.col("req_id") / 2).alias("req_id"), (F.col("req_id") % 2).alias("end"), "node_id", F.coalesce("has_edge", F.lit(False)).alias("has_edge"))
    at = lambda i, c: F.max(F.when(F.col("end") == i, F.col(c)))
    pairs = known.groupBy("req_id").agg(at(0, "node_id").alias("start_node"), at(1, "node_id").alias("end_node"), F.min("has_edge").alias("edges"))
    missing = F.col("start_node").isNull() | F.col("end_node").isNull()
    status = F.when(missing, "NO_NODE").when(~F.col("edges"), "NO_EDGE").otherwise("OK")
    return requests.join(pairs, "req_id", "left").withColumn("status", status).drop("edges")


def find_paths(requests: DataFrame, graph: Graph, track: bool = False, strict: bool = False, config: RouteConfig = RouteConfig(), network: Network | MappedNetwork | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """(req_id, status, path, cost, trace) of requests(req_id, start_lat, start_lon, end_lat, end_lon). resolved: their resolve(), if known.

    status is that of resolve(), or NO_ROUTE. strict raises EmptyGeometry if any request
    can't be resolved, which fails the whole batch. Without a network given, one is mapped from
    files, as the driver has no room for its arrays; none is made if no request
    has both its nodes and edges.
    """
    resolved = resolve(requests, graph, config) if resolved is None else resolved
    if strict:
        bad = resolved.where("status <> 'OK'").select("req_id", "status").limit(1).collect()
        if bad:
            raise EmptyGeometry(f"request {bad[0]['req_id']}: {bad[0]['status']}")
    if network is None and resolved.where("status = 'OK'").isEmpty():
        nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("path", "array<int>"), ("cost", "double"), ("trace", TRACE))]
        return resolved.select("req_id", "status", *nothing)
    if network is None:
        network = filed_network(graph, config)
    found = routes_by_node(resolved.where("status = 'OK'"), network, track, config, requests.count())
    status = F.when((F.col("status") == "OK") & F.col("path").isNull(), "NO_ROUTE").otherwise(F.col("status"))
    return resolved.join(found, "req_id", "left").select("req_id", status.alias("status"), "path", "cost", "trace")


def route_steps(found: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(req_id, step, node_id, lat, lon, turn) of the routes of find_paths() or routes_by_node(), or of placed_routes().

    The last need no nodes: a route's steps are made from its one row, without a shuffle or a sort of all steps.
    """
    if nodes is None:
        return turns_of_paths(found.where("path is not null"))
    hops = found.where("path is not null").select("req_id", F.posexplode("path").alias("step", "node_id"))
    return turn_steps(hops.join(nodes.select("node_id", "lat", "lon"), "node_id")).select("req_id", "step", "node_id", "lat", "lon", "turn")


def flat_trace(found: DataFrame) -> DataFrame:
    """(req_id, seq, side, lat, lon, n_visited): a row for each expanded node."""
    t = found.where("trace is not null").select("req_id", F.explode("trace").alias("t"))
    return t.select("req_id", "t.seq", "t.side", F.col("t.parent.lat").alias("lat"), F.col("t.parent.lon").alias("lon"), F.size("t.visited").alias("n_visited"))


def find_paths_text(spark: SparkSession, text: str, graph: Graph, track: bool = False) -> DataFrame:
    """find_paths() for one comma-separated list of `lat/lon|lat/lon`; InvalidCoordinate if malformed."""
    from ..functions.od import parse_list

    rows = [(i, *r) for i, r in enumerate(parse_list(text))]
    return find_paths(spark.createDataFrame(rows, "req_id long, start_lat double, start_lon double, end_lat double, end_lon double"), graph, track, strict=True)
