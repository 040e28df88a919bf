"""Exact least costs: bounded relaxation as joins, and to convergence over a shared graph."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RouteConfig
from . import kernel
from .search import FORWARD, MappedNetwork, Network, opener, stored


def bounded_costs(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node_id, cost): least costs over at most hops edges from sources(source)."""
    step = edges.groupBy("src", "dst").agg(F.min("cost").alias("step"))
    best = sources.select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("cost"))
    front = best
    for _ in range(hops):
        front = front.join(step, front["node_id"] == step["src"]).groupBy("source", F.col("dst").alias("node_id")).agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
        best = best.unionByName(front)
    return best.groupBy("source", "node_id").agg(F.min("cost").alias("cost"))


def least_costs(network: Network, source: int, target: int | None = None) -> dict[int, float]:
    """Least costs from source to all that it reaches; with a target, until that is settled."""
    layout, cost, done = network.sides[FORWARD], {source: 0.0}, set()
    queue = [(0.0, source)]
    while queue:
        c, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        if node == target:
            break
        for e in range(layout.at[3 * node], layout.at[3 * node + 3]):
            other, total = int(layout.other[e]), c + float(layout.cost[e])
            if total < cost.get(other, float("inf")):
                cost[other] = total
                heapq.heappush(queue, (total, other))
    return cost


def exact_costs(sources: DataFrame, network: Network | MappedNetwork) -> DataFrame:
    """(source, node_id, cost): least costs to every node that sources(source) reach, a task's batch at a time."""
    opened = opener(network, sources.sparkSession)

    def run(batches):
        network = opened()
        for pdf in batches:
            for source in pdf["source"]:
                found = least_costs(network, int(source))
                yield pd.DataFrame({"source": source, "node_id": list(found), "cost": list(found.values())})

    return sources.repartition("source").mapInPandas(run, "source long, node_id long, cost double")


def exact_pair_costs(pairs: DataFrame, network: Network | MappedNetwork, count: int | None = None) -> DataFrame:
    """(req_id, cost) of pairs(req_id, start_node, end_node): the least cost, null where there is no way. count: about how many pairs there are, if known.

    A start is searched once for each of its ends, and no further than to them, in the executors' JVMs (kernel.py).
    """
    spark = pairs.sparkSession
    count = pairs.count() if count is None else count
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // RouteConfig().requests_per_task))
    return kernel.run(pairs.select("req_id", "start_node", "end_node").repartition(tasks, "req_id"), stored(network, spark), exact=True)
