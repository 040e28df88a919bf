"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards of about SHARD_DOCS rows by a hash of their id, so a hot source or
cluster spreads over all shards, and each shard packs on its own. A shard's bins are kept in the
order of their residual capacity, each with a bitmap of the sources and the duplicate clusters
that it holds. An item goes to the tightest bin that it fits and has no conflict with: the
search starts at its own length and goes on to the next larger residual until a bin is
compatible. Every inner node of the residual order holds the AND of its bins' bitmaps, so a
range in which all bins conflict is passed over at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_DOCS = 4096


class BestFit:
    """Bins ordered by residual capacity; bitmaps of what they hold prune the successor search."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(1, capacity).bit_length()
        self.all = [-1] * (2 * self.leaves)  # AND of the bitmaps below; -1, all ones, if there is no bin
        self.at: list[dict[int, int]] = [{} for _ in range(self.leaves)]  # residual -> bin: bitmap
        self.bins = 0

    def _refresh(self, residual: int) -> None:
        held = -1
        for bits in self.at[residual].values():
            held &= bits
            if not held:
                break
        node = residual + self.leaves
        while self.all[node] != held:
            self.all[node] = held
            node >>= 1
            if not node:
                break
            held = self.all[2 * node] & self.all[2 * node + 1]

    def find(self, size: int, bits: int) -> tuple[int, int] | None:
        """(residual, bin) of the tightest bin that holds size more and none of bits; the oldest on ties."""
        node = size + self.leaves
        while node:
            stack = [node]
            while stack:
                n = stack.pop()
                if self.all[n] == -1 or self.all[n] & bits:
                    continue  # no bin below, or one bit that all of them hold
                if n < self.leaves:
                    stack += [2 * n + 1, 2 * n]
                    continue
                for b, held in self.at[n - self.leaves].items():
                    if not held & bits:
                        return n - self.leaves, b
            while node & 1:
                node >>= 1
            node += node > 0
        return None

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """(bin, offset in it) for an item of at most the capacity."""
        found = self.find(size, bits)
        if found:
            residual, b = found
            held = self.at[residual].pop(b)
            self._refresh(residual)
        else:
            residual, b, held = self.capacity, self.bins, 0
            self.bins += 1
        self.at[residual - size][b] = held | bits
        self._refresh(residual - size)
        return b, self.capacity - residual


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, bin, offset, length) for items in the order given, longest first for best-fit decreasing.

    An item over the capacity gives full pieces, each a bin of its own, and its rest is packed.
    Items of one source, or of one cluster, never share a bin; None conflicts with nothing.
    """
    bit: dict = {}
    shared = {c for c, n in pd.Series(clusters, dtype=object).value_counts().items() if n > 1}
    fit, out = BestFit(capacity), []
    for i, size in enumerate(sizes):
        bits = 0
        for kind, key in (("source", sources[i]), ("cluster", clusters[i] if clusters[i] in shared else None)):
            if key is not None:
                bits |= 1 << bit.setdefault((kind, key), len(bit))
        full, rest = divmod(size, capacity)
        for piece in range(full):
            out.append((i, piece, *fit.place(capacity, bits), capacity))
        if rest or not full:
            out.append((i, full, *fit.place(rest, bits), rest))
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, start, length) of docs(doc_id, text, source): where each piece goes.

    Lengths are in words; start is the piece's first word. Clusters are groups of equal texts.
    bin_id is unique over all shards. A null or empty text is a piece of length 0; a null source
    conflicts with no source, a null text with no text; repeated rows are packed each, in bins of
    their own, and dealt over all shards by their number; other columns are not read; no rows give
    no rows.
    """
    items = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.md5("text").alias("cluster"), n_words(F.col("text")).cast("long").alias("n"))
    alike = items.groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("rows"))
    numbered = alike.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    shards = max(1, -(-docs.count() // shard_docs))
    items = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(shards))).drop("row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        blank = lambda c: [None if x is None or x != x else x for x in pdf[c].tolist()]
        rows = np.array(pack_shard(pdf["n"].astype(int).tolist(), blank("source"), blank("cluster"), capacity), np.int64).reshape(-1, 5)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].astype("Int64").take(rows[:, 0]).reset_index(drop=True),
                "piece": rows[:, 1],
                "bin_id": int(pdf["shard"].iloc[0]) + rows[:, 2] * shards,
                "bin_offset": rows[:, 3],
                "start": rows[:, 1] * capacity,
                "length": rows[:, 4],
            }
        )

    return items.groupBy("shard").applyInPandas(run, "doc_id long, piece long, bin_id long, bin_offset long, start long, length long")
