"""Tables of external databases over JDBC: partitioned reads, and upserts in one transaction."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ReadOnly

BATCH = 10_000


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 8, quote: str = '"', **options) -> DataFrame:
    """A table of an external database, by any JDBC driver on the class path.

    With a numeric partition_column it is read in that many ranges of it at once; the ends are
    asked of the database first, the column's name between quote marks. Rows with a null there come
    with the first range.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column:
        name = f"{quote}{partition_column}{quote}"
        ends = reader.option("query", f"SELECT min({name}) AS lo, max({name}) AS hi FROM {table}").load().first()
        reader = spark.read.format("jdbc").options(url=url, **options)
        if ends[0] is not None:
            reader = reader.options(partitionColumn=partition_column, lowerBound=str(ends[0]), upperBound=str(int(ends[1]) + 1), numPartitions=str(partitions))
    return reader.option("dbtable", table).load()


def merge_sql(table: str, staging: str, key: str, columns: list[str]) -> str:
    """The standard's MERGE of a staging table by key. Columns are quoted, as Spark writes them."""
    q = {c: f'"{c}"' for c in columns}
    sets = ", ".join(f"{q[c]} = s.{q[c]}" for c in columns if c != key)
    names, values = ", ".join(q.values()), ", ".join(f"s.{c}" for c in q.values())
    return f"MERGE INTO {table} t USING {staging} s ON t.{q[key]} = s.{q[key]} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def on_duplicate_key_sql(table: str, staging: str, key: str, columns: list[str]) -> str:
    """The same for databases that know ON DUPLICATE KEY UPDATE, and quote by backticks, instead."""
    q = {c: f"`{c}`" for c in columns}
    sets = ", ".join(f"{q[c]} = VALUES({q[c]})" for c in columns if c != key)
    names = ", ".join(q.values())
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"


def upsert_jdbc(changes: DataFrame, url: str, table: str, key: str, statement: Callable[..., str] = merge_sql, properties: dict[str, str] | None = None) -> None:
    """changes put into a database table by key, whole or not at all.

    Executors write a staging table, BATCH rows a batch; one statement in one transaction then
    merges it, and a failure of either leaves the table as it was. The staging table goes in the end.
    """
    properties = properties or {}
    spark, staging = changes.sparkSession, f"{table}_staging"
    manager = spark._jvm.java.sql.DriverManager
    known = spark._jvm.java.util.Properties()
    for name, value in properties.items():
        known.setProperty(name, value)
    changes.write.jdbc(url, staging, mode="overwrite", properties={"batchsize": str(BATCH), **properties})
    connection = manager.getConnection(url, known)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        try:
            run.executeUpdate(statement(table, staging, key, changes.columns))
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            run.executeUpdate(f"DROP TABLE {staging}")
            connection.commit()
            run.close()
    finally:
        connection.close()


def save_node_index(index: DataFrame, sink: Callable[[DataFrame], None] | None = None, read_only: bool = False) -> bool:
    """Hand the node index to sink; whether it was saved. ReadOnly if the store is; without a sink a warning."""
    if read_only:
        raise ReadOnly("the node index can't be saved in a read-only store")
    if sink is None:
        logging.getLogger(__name__).warning("no database is set; the node index isn't saved")
        return False
    sink(index)
    return True
