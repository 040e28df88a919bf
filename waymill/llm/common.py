"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are re-cut to about this many bytes of text before array work.
BATCH_BYTES = 4 << 20
ROWS_PER_FILE = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at spark.checkpoint.dir.

    Where it is unset, as in tests, a local session gets a temporary folder; a cluster's executors
    don't share one, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))


def checkpointed(df: DataFrame, narrow: bool = False) -> DataFrame:
    """df written once to the shared checkpoint folder, its lineage cut.

    A narrow table, of a few numbers a row, is gathered into files of ROWS_PER_FILE rows
    first: many tasks' few rows would else make as many files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not narrow:
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    files = max(1, -(-kept.count() // ROWS_PER_FILE))
    done = kept.coalesce(files).checkpoint(eager=True)
    kept.unpersist()
    return done


def spilled(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks once it is made, for wide tables that are read several times.

    What a lost executor held is made again from df's own lineage.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_groups(batches, column: str = "text", limit: int = BATCH_BYTES):
    """(record batch, encoded texts) of consecutive rows that hold about limit bytes; null is empty.

    Only one group's texts are Python objects at a time.
    """
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= limit):
                size += sizes[end]
                end += 1
            part = texts.slice(at, end - at).cast(pa.binary()).to_pylist()
            yield batch.slice(at, end - at), [b"" if t is None else t for t in part]
            at = end


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as (node, smallest node it reaches), without the smallest nodes themselves."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared checkpoint folder, read back.

    For tables too wide for checkpoint(), whose files are neither columnar nor compressed. They
    stay until the folder is cleared.
    """
    return kept_at(df)[0]


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """written(df), and the path of its table, for deleted()."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a table of kept_at() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of plans that nothing refers to: it does so when the driver's heap is swept."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most most_rows rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
