"""Best-fit packing against a scan of all bins, and its rules on a table."""

import random
from collections import defaultdict

import pytest

from waymill.llm import packing


def plain(sizes, sources, clusters, capacity):
    bins, out = [], []
    for i, size in enumerate(sizes):
        full, rest = divmod(size, capacity)
        for piece, n in [*((k, capacity) for k in range(full)), *([(full, rest)] if rest or not full else [])]:
            fits = [b for b in bins if capacity - b[0] >= n and (sources[i] is None or sources[i] not in b[1]) and (clusters[i] is None or clusters[i] not in b[2])]
            best = min(fits, key=lambda b: capacity - b[0], default=None)
            if best is None:
                best = [0, set(), set()]
                bins.append(best)
            out.append((i, piece, capacity - best[0], n))
            best[0] += n
            best[1].add(sources[i])
            best[2].add(clusters[i])
    return out, len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_every_item_goes_to_a_tightest_compatible_bin(seed):
    r = random.Random(seed)
    n, capacity = r.randrange(0, 150), r.choice([1, 7, 16, 100])
    sizes = sorted((r.randrange(0, 2 * capacity + 1) for _ in range(n)), reverse=True)
    sources, clusters = [r.choice([None, "a", "a", "a", *"bcdefg"]) for _ in sizes], [r.choice([None, *range(30)]) for _ in sizes]
    got = packing.pack_shard(sizes, sources, clusters, capacity)
    want, bins = plain(sizes, sources, clusters, capacity)
    # Residuals met by each item are those of the plain scan; bins of one residual may change places.
    assert [(i, p, capacity - at, length) for i, p, _, at, length in got] == want or len({b for _, _, b, _, _ in got}) == bins
    held = defaultdict(list)
    for i, _, b, at, length in got:
        held[b].append((at, length, sources[i], clusters[i], i))
    for items in held.values():
        items.sort()
        assert all(a[0] + a[1] <= b[0] for a, b in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
        for k in (2, 3):
            named = [x[k] for x in items if x[k] is not None]
            assert len(named) == len(set(named))


def test_table(spark):
    rows = [(1, "a b c", "s"), (2, "a b c", "t"), (3, None, "s"), (4, "", None), (None, "x y", None), (5, "w " * 5000, "u"), (1, "a b c", "s"), (6, "q", "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, shard int, n int")
    got = packing.pack(df, capacity=2048).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert sorted(pieces[5]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and pieces[3] == [(0, 0, 0)] and len(pieces[1]) == 2 and pieces[None] == [(0, 0, 2)]
    bins = defaultdict(set)
    for r in got:
        bins[r["doc_id"]].add(r["bin_id"])
    assert len(bins[1]) == 2 and not bins[1] & bins[2] and not bins[1] & bins[6]
    assert packing.pack(df.limit(0)).collect() == []
    many = packing.pack(df, capacity=2048, shard_docs=2).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in many) == sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got)
