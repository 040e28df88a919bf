"""Exact top-k inner-product search over KD-trees, one per shard of vectors.

Space is cut into cells at the medians of a bounded sample's widest dimensions, and a cell's rows,
all of them, are dealt to shards of bounded size. A shard's tree splits at the median of the
widest dimension; every node has a tight bounding box. The largest inner product that a query can
reach in a box bounds the node, and nodes are visited best bound first until the bound falls under
the query's k-th score. A query first searches its own shard, then the cell with the best bound,
and with the k-th score that these two give it all other cells whose box can still hold a better
row. A tree is loaded once and meets its queries as a stream of blocks.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

LEAF = 256
SHARD_ROWS = 8192
CELLS = 1024  # at most, so that their boxes are few numbers
SAMPLE = 16 * CELLS  # rows that place the cells' cuts; every row is indexed
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class Tree:
    """Rows sorted by node; per node the row range, the box and the children (0: a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, counts: np.ndarray | None = None):
        order, nodes = np.arange(len(ids)), []
        todo = [(0, len(ids), None)]
        while todo:
            start, stop, parent = todo.pop()
            own = rows[order[start:stop]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            k = len(nodes)
            nodes.append([start, stop, 0, 0, lo, hi])
            if parent is not None:
                nodes[parent[0]][parent[1]] = k
            if stop - start > leaf and (hi > lo).any():
                widest = int(np.argmax(hi - lo))
                order[start:stop] = order[start:stop][np.argsort(own[:, widest], kind="stable")]
                half = (start + stop) // 2
                todo += [(half, stop, (k, 3)), (start, half, (k, 2))]
        self.ids, self.rows = ids[order], rows[order]
        self.counts = np.ones(len(ids), np.int64) if counts is None else counts[order]
        self.visited = 0  # leaves, over all searches
        self.span = np.array([n[:4] for n in nodes])
        self.lo, self.hi = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray):
        """(query's index, ids, scores) of each query's k best rows with a score of its floor or more.

        Ties go to the smaller id; a row that stands for several counts as many; the query's own
        row, by id and vector, counts one less. Scores beyond a long are cut to its ends.
        """
        width = max(queries.shape[1], self.rows.shape[1])
        pad = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        queries, rows, lo, hi = pad(queries), pad(self.rows), pad(self.lo), pad(self.hi)
        size = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
        top = width * size(queries) * max(size(lo), size(hi))
        kind = np.float64 if top < EXACT else object  # beyond 2^53, Python's integers
        queries, rows, lo, hi = (a.astype(np.int64).astype(kind) for a in (queries, rows, lo, hi))
        bounds = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
        span = self.span.tolist()
        for i, own_id in enumerate(query_ids):
            bound, q, least = bounds[i], queries[i], floors[i]
            best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
            heap = [(-bound[0], 0)]
            while heap:
                at, node = heapq.heappop(heap)
                if -at < least:
                    break
                start, stop, left, right = span[node]
                if left:
                    for child in (left, right):
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                self.visited += 1
                scores = rows[start:stop] @ q
                if kind is object:
                    scores = np.array([min(max(x, -LONG - 1), LONG) for x in scores.tolist()], object)
                keep = np.flatnonzero(scores >= least)
                if not len(keep):
                    continue
                times = np.minimum(self.counts[start:stop][keep], k + 1)
                own = np.flatnonzero(self.ids[start:stop][keep] == own_id)
                times[own] -= (rows[start:stop][keep[own]] == q).all(axis=1)
                keep = np.repeat(keep, times)
                best_ids, best = np.concatenate([best_ids, self.ids[start:stop][keep]]), np.concatenate([best, scores[keep]])
                if len(best) > k:
                    order = np.lexsort((best_ids, -best))[:k] if kind is np.float64 else np.array(sorted(range(len(best)), key=lambda j: (-best[j], best_ids[j]))[:k])
                    best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    least = max(least, best.min())
            yield i, best_ids, best


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v, n): floor(scale * x) of every component x of vectors(vec_id, embedding), cut to a
    long's range, and how many rows are alike in both.

    Vectors that are null or hold a null or non-finite component, and rows without an id, are left out.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    ints = good.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(scale * e)).alias("v"))
    return ints.groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def _matrix(rows: list, width: int = 1) -> np.ndarray:
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Cells:
    """Cuts of space at medians: cut k sends rows under its value to cut 2k + 1, the others to 2k + 2."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.width = levels, sample.shape[1]
        cuts = (1 << levels) - 1
        self.dim, self.value = np.zeros(cuts, np.int64), np.zeros(cuts, np.int64)
        groups = [sample]
        for k in range(cuts):
            own = groups[k].astype(np.float64)
            if len(own):
                self.dim[k] = int(np.argmax(own.std(axis=0)))
                self.value[k] = np.sort(groups[k][:, self.dim[k]])[len(own) // 2]
            under = groups[k][:, self.dim[k]] < self.value[k]
            groups += [groups[k][under], groups[k][~under]]

    def of(self, rows: np.ndarray) -> np.ndarray:
        rows = np.pad(rows, ((0, 0), (0, max(0, self.width - rows.shape[1]))))
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (rows[np.arange(len(rows)), self.dim[at]] >= self.value[at])
        return at - (1 << self.levels) + 1


def _bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest product of each query with anything in each box, a little more where doubles are inexact."""
    width = max(queries.shape[1], lo.shape[1])
    q, lo, hi = (np.pad(a, ((0, 0), (0, width - a.shape[1]))).astype(np.float64) for a in (queries, lo, hi))
    bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    size = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    return bound + np.where(size < EXACT, 0, size * 1e-9)


FOUND = "home long, query_id long, vec_id long, score long"
BLOCKS = "shard long, kind int, home long, data binary"


def _block(home: int, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray, shard: int) -> tuple:
    return shard, 1, home, pickle.dumps((ids, rows, floors))


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], [c.split()[0] for c in BLOCKS.split(", ")])


def _searched(trees: DataFrame, blocks: DataFrame, k: int, tasks: int) -> DataFrame:
    """FOUND: the k best rows that blocks of queries find in the trees of their shards.

    A shard's tree comes first in its task, then its queries, one block at a time.
    """

    def run(batches):
        at, tree = None, None
        for batch in batches:
            for shard, kind, home, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "home", "data"))):
                if not kind:
                    at, tree = shard, pickle.loads(data)
                elif at == shard:
                    ids, rows, floors = pickle.loads(data)
                    q, v, s = [], [], []
                    for i, found, scores in tree.search(ids, rows, k, floors):
                        q += [int(ids[i])] * len(found)
                        v += found.tolist()
                        s += [int(x) for x in scores]
                    yield pa.RecordBatch.from_arrays([pa.array([home] * len(q), pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], [c.split()[0] for c in FOUND.split(", ")])

    return trees.unionByName(blocks).repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each row whose vec_id is divisible by every.

    Scores are integer inner products of the vectors as quantised() gives them, shorter ones
    padded with zeros, cut to a long's range; ties go to the smaller vec_id. Every row counts, also
    one that repeats an id: of rows with a query's id the smallest vector is the query, and the
    others are candidates. Fewer than k other rows give all of them, none give none. Other columns
    are not read.
    """
    vectors = checkpointed(quantised(vectors, scale))
    count = vectors.count()
    levels = min(CELLS.bit_length() - 1, max(0, int(np.ceil(np.log2(max(1, count / shard_rows))))))
    sample = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect() if levels else []
    cells = Cells(_matrix([r["v"] for r in sample]), levels)
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def dealt(batches):
        for batch in batches:
            rows = _matrix(batch.column("v").to_pylist(), cells.width)
            yield batch.append_column("cell", pa.array(cells.of(rows), pa.int64()))

    schema = "vec_id long, v array<long>, n long, cell long"
    placed = checkpointed(vectors.mapInArrow(dealt, schema))
    # A cell's shards: as many as its rows need, also where all its rows are alike. At most CELLS rows.
    parts = checkpointed(placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), narrow=True)
    salts = {r["cell"]: r["parts"] for r in parts.collect()}
    most = max(salts.values(), default=1)

    def sharded(rows: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
        return rows.join(F.broadcast(parts), "cell").withColumn("shard", F.col("cell") * most + own)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"].tolist()), counts=pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "kind": [0], "home": [0], "data": [pickle.dumps(tree)], "lo": [tree.lo[0].tolist()], "hi": [tree.hi[0].tolist()]})

    made = checkpointed(sharded(placed).groupBy("shard").applyInPandas(build, f"{BLOCKS}, lo array<long>, hi array<long>"))
    trees = made.select("shard", "kind", "home", "data")
    low: dict[int, list] = {}
    high: dict[int, list] = {}
    cell = F.floor(F.col("shard") / most)
    for name, into, pick in (("lo", low, F.min), ("hi", high, F.max)):
        ends = made.select(cell.alias("cell"), F.posexplode(name).alias("i", "x")).groupBy("cell", "i").agg(pick("x").alias("x"))
        for r in ends.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("x")).collect():
            into[r["cell"]] = r["x"]
    names = np.array(sorted(salts), np.int64)
    widths = made.agg(F.min(F.size("lo")).alias("least"), F.max(F.size("lo")).alias("most")).first()
    lo, hi = _matrix([low[c] for c in names.tolist()], widths["most"] or 1), _matrix([high[c] for c in names.tolist()], widths["most"] or 1)
    if widths["least"] != widths["most"]:  # a shorter vector has zeros where its cell's box has other numbers
        lo, hi = np.minimum(lo, 0), np.maximum(hi, 0)
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, sum(salts.values()))

    # First, every query in its own shard, which is also the home that its blocks go by.
    asked = sharded(queries.select("vec_id", "v", F.lit(1).cast("long").alias("n")).mapInArrow(dealt, schema))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, rows = pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"].tolist())
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame([_block(shard, ids, rows, np.full(len(ids), -np.inf), shard)], columns=["shard", "kind", "home", "data"])

    blocks = checkpointed(asked.groupBy("shard").applyInPandas(first, BLOCKS))
    found = checkpointed(_searched(trees, blocks, k, tasks), narrow=True)

    def waves(found: DataFrame, wave: int) -> DataFrame:
        """The next blocks: the queries whose k-th score in found lies under a cell's bound, by shard."""
        floor = F.expr(f"case when size(s) >= {k} then sort_array(s, false)[{k - 1}] end")
        floors = found.groupBy("home", "query_id").agg(F.collect_list("score").alias("s")).groupBy("home").agg(F.collect_list(F.struct("query_id", floor.alias("floor"))).alias("floors"))
        both = blocks.join(floors, "home", "left").select("shard", "home", "data", "floors")

        def run(batches):
            for batch in batches:
                for own, home, data, known in zip(*(batch.column(c).to_pylist() for c in ("shard", "home", "data", "floors"))):
                    ids, rows, _ = pickle.loads(data)
                    least = {r["query_id"]: r["floor"] for r in known or () if r["floor"] is not None}
                    floors = np.array([least.get(i, -np.inf) for i in ids.tolist()], np.float64)
                    floors = np.where(np.abs(floors) < EXACT, floors, np.nextafter(floors, -np.inf))
                    bound = _bounds(rows, lo, hi)
                    cell = np.searchsorted(names, own // most)
                    others = bound.copy()
                    if salts[own // most] == 1:
                        others[:, cell] = -np.inf  # searched already
                    best = others.argmax(axis=1)
                    open_ = bound >= floors[:, None]
                    chosen = np.arange(len(names))[None, :] == best[:, None]
                    for c in range(len(names)):
                        at = np.flatnonzero(open_[:, c] & (chosen[:, c] if wave == 1 else ~chosen[:, c]))
                        if not len(at):
                            continue
                        base = int(names[c])
                        for part in range(salts[base]):
                            to = base * most + part
                            if to != own:
                                yield _blocks([_block(home, ids[at], rows[at], floors[at], to)])

        return both.mapInArrow(run, BLOCKS)

    found = checkpointed(found.unionByName(_searched(trees, waves(found, 1), k, tasks)), narrow=True)
    found = found.unionByName(_searched(trees, waves(found, 2), k, tasks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
