"""Route search and least costs in the executors' JVMs: Routes.java, compiled by the compiler that Spark ships.

A search expands tens of thousands of nodes one after the other, which Python takes about ten times as long for.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, HEURISTIC_SPEED, HEURISTIC_WEIGHT, NEAR_TARGET

SOURCE = Path(__file__).with_name("Routes.java")
_LOADED: list = []  # the application that has the classes, and their loader


def _loader(spark: SparkSession):
    """The class loader of Routes, whose classes every executor gets as a jar, once an application."""
    context = spark.sparkContext
    if not _LOADED or _LOADED[0] != context.applicationId:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        codes = compiler.getBytecodes()
        jar = f"{tempfile.mkdtemp(prefix='routes', dir=SparkFiles.getRootDirectory())}/routes.jar"
        with zipfile.ZipFile(jar, "w") as archive:
            for name in codes.keySet():
                archive.writestr(f"{name.replace('.', '/')}.class", bytes(codes[name]))
        context._jsc.addJar(jar)
        _LOADED[:] = [context.applicationId, compiler.getClassLoader()]
    return _LOADED[1]


def release(spark: SparkSession) -> bool:
    """Give back what the driver's JVM holds without use: garbage, with the heap it made grow, and freed native memory,
    which malloc keeps in an arena a thread. Building a network leaves hundreds of MB of both to the searches after it.
    False where the JVM can't give back the second."""
    spark._jvm.System.gc()
    return _loader(spark).loadClass("waymill.Routes").newInstance().trim()


def prefix(folder: str) -> str:
    """What the names of a network's files begin with: they are told apart among all files of an application,
    as Spark hands out files, but no local folders, beyond one machine. folder: one, or where addFile() put its files."""
    return f"{folder}/{os.path.basename(folder.rstrip('/'))}-" if os.path.isdir(folder) else f"{folder}-"


def share(folder: str, spark: SparkSession) -> str:
    """Hand a network's files to the executors; SparkFiles.get() of the returned name is their prefix()'s folder there."""
    for name in sorted(os.listdir(folder)):
        spark.sparkContext.addFile(f"{folder}/{name}")
    return os.path.basename(folder.rstrip("/"))


def save(network, folder: str) -> None:
    """A Network's arrays as the files of map_network()."""
    arrays = {"lon": network.lon, "lat": network.lat}
    for name, layout in zip(("out", "in"), network.sides):
        arrays |= {f"{name}_{part}": getattr(layout, part) for part in ("at", "other", "cost", "level")}
    for name, array in arrays.items():
        np.save(f"{prefix(folder)}{name}.npy", array)


def run(pairs: DataFrame, files: str, exact: bool = False, places: bool = False, traced: bool = False) -> DataFrame:
    """(req_id, path, cost), with places also lat and lon of the path's nodes, or (req_id, cost) if exact, for pairs(req_id, start_node, end_node), a partition a task.

    traced: (req_id, seq, side, lat, lon, n_visited) instead, with places also visited, as Traces in Routes.java gives them.

    files: what share() returned for the network.
    """
    spark = pairs.sparkSession
    routes = _loader(spark).loadClass("waymill.Routes").newInstance()
    routes.set(files, exact, places, traced, *map(float, (EARTH_KM, HEURISTIC_SPEED, HEURISTIC_WEIGHT, NEAR_TARGET)))
    columns = "req_id BIGINT, cost DOUBLE" if exact else "req_id BIGINT, path ARRAY<INT>, cost DOUBLE" + ", lat ARRAY<DOUBLE>, lon ARRAY<DOUBLE>" * places
    if traced:
        columns = "req_id BIGINT, seq INT, side STRING, lat DOUBLE, lon DOUBLE, n_visited INT" + ", visited BINARY" * places
    schema = spark._jvm.org.apache.spark.sql.types.StructType.fromDDL(columns)
    rows = pairs.select(*[F.col(c).cast("long") for c in ("req_id", "start_node", "end_node")])
    return DataFrame(rows._jdf.mapPartitions(routes, spark._jvm.org.apache.spark.sql.Encoders.row(schema)), spark)
