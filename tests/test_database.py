"""Reads and upserts over JDBC, with the embedded database that Spark brings along."""

import pytest

from waymill.errors import ReadOnly
from waymill.sources import database

SCHEMA = "node_id long, lon double, lat double, offset_ long"


def url(name):
    return f"jdbc:derby:memory:{name};create=true"


def test_upsert_is_whole_or_not_at_all(spark):
    at = url("nodes")
    first = spark.createDataFrame([(i, 127.0 + i, 37.0, 6 + 24 * i) for i in range(100)], SCHEMA)
    first.write.jdbc(at, "node_index")
    changes = spark.createDataFrame([(i, 1.0, 2.0, 3) for i in range(50, 150)], SCHEMA)
    database.upsert_jdbc(changes, at, "node_index", "node_id")
    rows = {r[0]: r[1:] for r in map(tuple, database.read_jdbc(spark, at, "node_index").collect())}
    assert rows == {i: (127.0 + i, 37.0, 6 + 24 * i) if i < 50 else (1.0, 2.0, 3) for i in range(150)}
    broken = lambda *x: database.merge_sql(*x) + " no such thing"
    with pytest.raises(Exception):
        database.upsert_jdbc(changes.withColumn("lon", changes["lon"] + 5), at, "node_index", "node_id", broken)
    assert {r[0]: r[1:] for r in map(tuple, database.read_jdbc(spark, at, "node_index").collect())} == rows
    database.upsert_jdbc(changes.limit(0), at, "node_index", "node_id")
    assert database.read_jdbc(spark, at, "node_index").count() == 150


def test_partitioned_read(spark):
    at = url("parts")
    spark.range(1000).selectExpr("id - 100 as id", "id * 2 as v").write.jdbc(at, "t")
    read = database.read_jdbc(spark, at, "t", "id", 5)
    assert read.rdd.getNumPartitions() == 5 and read.count() == 1000 and read.agg({"v": "sum"}).first()[0] == 999_000
    spark.range(0).write.jdbc(at, "nothing")
    assert database.read_jdbc(spark, at, "nothing", "id", 5).collect() == []


def test_statements():
    assert database.on_duplicate_key_sql("t", "s", "id", ["id", "x"]) == "INSERT INTO t (`id`, `x`) SELECT `id`, `x` FROM s ON DUPLICATE KEY UPDATE `x` = VALUES(`x`)"


def test_where_the_index_goes(spark, caplog):
    index, got = spark.range(3), []
    assert database.save_node_index(index, got.append) and got == [index]
    assert not database.save_node_index(index) and "isn't saved" in caplog.text
    for sink in (None, got.append):
        with pytest.raises(ReadOnly):
            database.save_node_index(index, sink, read_only=True)
