"""A stream of origin-destination requests, answered a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import RouteConfig
from ..operators.graph import Graph
from ..operators.search import find_paths, shared_network


def answer_stream(requests: DataFrame, graph: Graph, path: str, checkpoint: str, config: RouteConfig = RouteConfig(), **trigger) -> StreamingQuery:
    """Routes of the streamed requests, appended to path in a folder for each batch; the graph is read once."""
    network = shared_network(graph, config)

    def answer(batch: DataFrame, number: int) -> None:
        found = find_paths(batch, graph, config=config, network=network)
        # Rewriting a batch's own folder makes a repeated batch harmless.
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
