"""Shapefile reader for Spark: polylines of a .shp with the attributes of its .dbf.

Register with spark.dataSource.register(ShapefileSource) and read
spark.read.format("shapefile").load(path). Files are opened by path on the executors, so the
path must be mounted there.
"""

from __future__ import annotations

import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "osm_id long, fclass string, oneway string, maxspeed int, layer long, geometry array<struct<x:double,y:double>>"
POLYLINES = (3, 13, 23)  # fixed values: plain, with z, with m
RECORDS_PER_PARTITION = 100_000


class Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def read_fields(path: str, encoding: str = "utf-8") -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header bytes, record bytes, [(name, type, offset, length)]) of a .dbf."""
    with open(path, "rb") as f:
        count, header, record = struct.unpack("<4xIHH20x", f.read(32))
        fields, at = [], 1
        while (first := f.read(1)) not in (b"\r", b""):
            rest = f.read(31)
            name = (first + rest[:10]).split(b"\0")[0].decode(encoding, "replace").lower()
            fields.append((name, chr(rest[10]), at, rest[15]))
            at += rest[15]
    return count, header, record, fields


def read_polyline(content: bytes) -> list[tuple[float, float]] | None:
    """All parts' points, one part after another; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind not in POLYLINES:
        raise ValueError(f"shape type {kind} is no polyline")
    parts, points = struct.unpack_from("<ii", content, 36)
    flat = struct.unpack_from(f"<{2 * points}d", content, 44 + 4 * parts)
    return list(zip(flat[::2], flat[1::2]))


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.base = path.removesuffix(".shp")
        if not os.path.exists(self.base + ".shp"):
            raise FileNotFoundError(self.base + ".shp")
        self.count, self.header, self.record, self.fields = read_fields(self.base + ".dbf")

    def partitions(self):
        return [Part(s, min(s + RECORDS_PER_PARTITION, self.count)) for s in range(0, max(self.count, 1), RECORDS_PER_PARTITION)]

    def read(self, partition: Part):
        wanted = {"osm_id": int, "fclass": str, "oneway": str, "maxspeed": int, "layer": int}
        fields = {name: (at, size, wanted[name]) for name, _, at, size in self.fields if name in wanted}
        with open(self.base + ".shp", "rb") as shp, open(self.base + ".shx", "rb") as shx, open(self.base + ".dbf", "rb") as dbf:
            shx.seek(100 + 8 * partition.start)
            dbf.seek(self.header + self.record * partition.start)
            for number in range(partition.start, partition.stop):
                at, words = struct.unpack(">ii", shx.read(8))
                shp.seek(2 * at + 8)
                line = read_polyline(shp.read(2 * words))
                row, values = dbf.read(self.record), {}
                for name, (start, size, kind) in fields.items():
                    text = row[start : start + size].decode("utf-8", "replace").strip(" \0")
                    values[name] = kind(float(text)) if kind is int and text else (text or None) if kind is str else None
                values["osm_id"] = number if values.get("osm_id") is None else values["osm_id"]
                yield (values["osm_id"], values.get("fclass"), values.get("oneway"), values.get("maxspeed"), values.get("layer"), line)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShapefileReader(self.options["path"])
