"""Graph tables on disk: layouts sorted for the readers, and a manifest that tells what is whole."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NodeIndexNotFound
from ..operators import graph as g

STAGES = ("nodes", "edges", "edges_reverse", "adjacency", "adjacency_reverse", "node_index")


@dataclass(frozen=True)
class GraphStore:
    """A folder with one Parquet table a stage; a stage's manifest is written after its table."""

    spark: SparkSession
    path: str

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def manifest(self, stage: str) -> dict | None:
        try:
            lines = self.spark.read.text(self._at(f"_manifest_{stage}")).collect()
        except Exception as e:  # the folder isn't there
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return json.loads(lines[0][0]) if lines else None

    def save(self, stage: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self._at(stage))
        line = json.dumps({"stage": stage, "rows": self.spark.read.parquet(self._at(stage)).count(), "complete": True})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(self._at(f"_manifest_{stage}"))

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._at(stage))

    def is_complete(self, stage: str) -> bool:
        """A complete manifest, and as many rows as it says."""
        m = self.manifest(stage)
        return bool(m and m["complete"]) and self.read(stage).count() == m["rows"]

    def has_extracted_data(self) -> bool:
        return all(map(self.is_complete, STAGES))

    def extract(self, features: DataFrame, phantom_zero: bool = False, progress=None) -> g.Graph:
        """Build what isn't complete: new nodes rebuild the edges, new edges both adjacencies. No features write nothing."""
        tell = progress or (lambda stage, state: None)
        if features.isEmpty():
            return None
        if not self.has_extracted_data():
            v = g.vertices(features)
            ids = g.node_ids(v, phantom_zero)
            stale = not self.is_complete("nodes")
            steps = {
                "nodes": lambda: g.nodes(v, ids),
                "edges": lambda: g.forward_layout(g.edges(features, ids)),
                "edges_reverse": lambda: g.reverse_layout(self.read("edges")),
                "adjacency": lambda: g.adjacency(self.read("edges"), "src"),
                "adjacency_reverse": lambda: g.adjacency(self.read("edges"), "dst"),
                "node_index": lambda: g.node_index(ids),
            }
            for stage, make in steps.items():
                if stage == "edges":
                    g.check_features(features)
                stale = stale or not self.is_complete(stage)
                if stale:
                    tell(stage, "start")
                    self.save(stage, make())
                    tell(stage, "end")
        return self.load()

    def load(self) -> g.Graph:
        return g.Graph(self.read("nodes"), self.read("edges"), self.read("node_index"))

    def rebuild_index(self, features: DataFrame, phantom_zero: bool = False) -> None:
        self.save("node_index", g.node_index(g.node_ids(g.vertices(features), phantom_zero)))

    def node(self, node_id: int):
        found = self.read("nodes").where(F.col("node_id") == node_id).limit(1).collect()
        if not found:
            raise NodeIndexNotFound(f"no node {node_id}")
        return found[0]


ONE_FILE_ROWS = 10_000_000


def write_index_csv(index: DataFrame, path: str, one_file_rows: int = ONE_FILE_ROWS) -> None:
    """CSV with the header nodeId,x,y,offset, in the order of ids; an empty index gives the header alone.

    One part up to one_file_rows rows; a larger index is written in parts by id, each with the
    header, that follow one another by name.
    """
    decimals = lambda c: F.format_string("%.7f", F.col(c))
    rows = index.orderBy("node_id").select(F.col("node_id").alias("nodeId"), decimals("lon").alias("x"), decimals("lat").alias("y"), "offset")
    rows = rows.coalesce(1) if index.count() <= one_file_rows else rows
    rows.write.mode("overwrite").csv(path, header=True)
