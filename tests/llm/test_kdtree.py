"""Top-k search against all products."""

import math
import random

import numpy as np
import pytest

from waymill.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>, score int"


def plain(rows, k=20, every=20):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [min(max(math.floor(64 * float(np.float32(x))), -(1 << 63)), (1 << 63) - 1) for x in v]))
    out = []
    for q in sorted({i for i, _ in good}):
        if q % every == 0:
            own = min(v for i, v in good if i == q)
            others = list(good)
            others.remove((q, own))
            cut = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
            best = sorted((-cut(sum(a * b for a, b in zip(own, v))), i) for i, v in others)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_products(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice((0.0, 0.5, -0.25, 1.0)) if seed == 1 else r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 6), (360, [float("inf")] + [0.0] * 5), (380, []), (400, [1.0, 2.0]), (None, [1.0] * 6), (20, [0.0] * 6), (20, [0.0] * 6), (7, [9.0] * 6)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)]  # ties beyond k
    rows += [(40, [0.25] * 6), (40, [0.75] * 4), *[(13, [0.5] * 6)] * 30]  # repeated ids, alike and not
    if seed == 2:
        rows += [(600, [1e18, -1e18, 1.0]), (601, [1e19] * 6), (620, [3e38] * 6), (621, [-3e38] * 6), (622, [2.0**57, 1.0]), (640, [2.0**57, 0.5])]
    if seed == 0:
        rows += [(1000 + i, [4.0] * 6) for i in range(150)]  # a third of all, alike: more than a shard
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in kdtree.top_k(df, shard_rows=100).collect())
    assert got == plain(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert [tuple(x) for x in kdtree.top_k(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert kdtree.top_k(df.where("vec_id = 0")).collect() == [] == kdtree.top_k(df.limit(0)).collect()


def test_numbers_beyond_doubles_stay_exact():
    big = 1 << 30
    rows = np.array([[big, 1], [big, 2], [big, 3]], np.int64)
    tree = kdtree.Tree(np.array([1, 2, 3]), rows, leaf=1)
    (_, ids, scores), = tree.search(np.array([9]), np.array([[big, 1]]), 2, np.array([-np.inf]))
    assert sorted(zip(scores.tolist(), ids.tolist()), reverse=True) == [(big * big + 3, 3), (big * big + 2, 2)]
    # Beyond a long all are alike, and ties go to the smaller id.
    (_, ids, scores), = tree.search(np.array([9]), np.array([[1 << 40, 1]]), 2, np.array([-np.inf]))
    assert sorted(zip(scores.tolist(), ids.tolist())) == [((1 << 63) - 1, 1), ((1 << 63) - 1, 2)]


def test_pruning_skips_far_leaves():
    r = np.random.default_rng(0)
    rows = np.concatenate([r.integers(-5, 5, (500, 8)) + 60 * c for c in r.integers(-3, 4, (10, 8))])
    tree = kdtree.Tree(np.arange(len(rows)), rows, leaf=32)
    leaves = int((tree.span[:, 2] == 0).sum())
    assert (tree.lo[0] == rows.min(axis=0)).all() and (tree.span[:, 1] - tree.span[:, 0])[tree.span[:, 2] == 0].max() <= 32
    queries = rows[::100]
    found = list(tree.search(np.arange(len(rows))[::100], queries, 5, np.full(len(queries), -np.inf)))
    assert tree.visited < leaves * len(queries) / 10
    for i, ids, scores in found:
        want = sorted(((-int(s), j) for j, s in enumerate(rows @ queries[i]) if j != 100 * i))[:5]
        assert sorted(zip((-scores).astype(int).tolist(), ids.tolist())) == want
    # A floor that no row reaches lets nothing be visited.
    tree.visited = 0
    assert all(not len(ids) for _, ids, _ in tree.search(np.array([-1]), queries[:1], 5, np.array([1e9]))) and tree.visited == 0


def test_cells_hold_equal_shares_and_bounds_hold():
    r = np.random.default_rng(1)
    rows = r.integers(-50, 50, (4000, 5))
    cells = kdtree.Cells(rows, 4)
    sizes = np.bincount(cells.of(rows), minlength=16)
    assert len(sizes) == 16 and sizes.min() > 150 and sizes.max() < 400
    lo = np.array([rows[cells.of(rows) == c].min(axis=0) for c in range(16)])
    hi = np.array([rows[cells.of(rows) == c].max(axis=0) for c in range(16)])
    bounds = kdtree._bounds(rows[:20], lo, hi)
    for c in range(16):
        assert ((rows[:20] @ rows[cells.of(rows) == c].T).max(axis=1) <= bounds[:, c]).all()
