"""Turn-by-turn guidance over vertex sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def turn_steps(path: DataFrame, key: str = "req_id") -> DataFrame:
    """path(key, step, lat, lon, ...) with turn: START, END, or the turn between both neighbours."""
    w = Window.partitionBy(key).orderBy("step")
    before = [F.lag(c).over(w).alias(f"_b{c}") for c in ("lat", "lon")]
    after = [F.lead(c).over(w).alias(f"_a{c}") for c in ("lat", "lon")]
    return _turned(path.select("*", *before, *after))


def turns_of_paths(paths: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, step, node_id, lat, lon, turn) as turn_steps() has them, of paths(key, path, lat, lon): a row a path, arrays of its nodes and their places."""
    none, inner = F.array(F.lit(None).cast("double")), F.size("path") - 1
    before = [F.concat(none, F.slice(c, F.lit(1), inner)).alias(f"_b{c}") for c in ("lat", "lon")]
    after = [F.concat(F.slice(c, F.lit(2), inner), none).alias(f"_a{c}") for c in ("lat", "lon")]
    places = F.arrays_zip(F.col("path").alias("node_id"), "lat", "lon", *before, *after)
    names = ["node_id", "lat", "lon", "_blat", "_blon", "_alat", "_alon"]
    steps = paths.where(F.size("path") > 0).select(key, F.posexplode(places).alias("step", "_at"))
    return _turned(steps.select(key, "step", *[F.col("_at")[name].alias(name) for name in names]))


def _turned(p: DataFrame) -> DataFrame:
    """p(lat, lon, _blat, _blon, _alat, _alon) with turn, without the places before and after."""
    lat, lon = F.col("lat"), F.col("lon")
    ahead, behind = geo.bearing(lat, lon, F.col("_alat"), F.col("_alon")), geo.bearing(F.col("_blat"), F.col("_blon"), lat, lon)
    # Columns of their own are computed once a row, however often what follows reads them.
    p = p.withColumns({"_ahead": ahead, "_behind": behind}).withColumn("_change", geo.bearing_difference(F.col("_ahead"), F.col("_behind")))
    turn = F.when(F.col("_blat").isNull(), "START").when(F.col("_alat").isNull(), "END").otherwise(geo.turn(F.col("_change")))
    return p.withColumn("turn", turn).drop("_blat", "_blon", "_alat", "_alon", "_ahead", "_behind", "_change")
