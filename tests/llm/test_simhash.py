"""SimHash against all pairs, on planted neighbours at every distance."""

import random

import numpy as np
import pytest
import xxhash

from waymill.llm import simhash
from waymill.llm.common import star_forest
from waymill.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_majority_of_long_and_empty_texts():
    text = " ".join(f"w{i % 700}" for i in range(3000))
    for t in ("", "One", "one  two", "A\x0bB\tc d É", text, "same " * 400):
        got = simhash.majority([simhash.shingle_hashes(t.encode()), simhash.shingle_hashes(b"")])
        assert int(got[0]) == plain_fingerprint(t) and int(got[1]) == 0


@pytest.mark.parametrize("at_once", [1 << 21, 3000])
def test_links_find_every_pair_within_three_bits(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    r = random.Random(5)
    fps = []
    for _ in range(60):
        base = r.getrandbits(64)
        fps += [base, *(base ^ sum(1 << b for b in r.sample(range(64), d)) for d in (1, 2, 3, 4, 5))]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 64
    order = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(order[a])] = find(order[b])
    want = plain_components(list(range(len(fps))), fps)
    groups = {}
    for i in range(len(fps)):
        assert groups.setdefault(find(i), want[i]) == want[i]
    assert len(groups) == len(set(want))


def test_documents(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(40):
        text = [r.choice(words) for _ in range(120)]
        rows.append((100 - i, " ".join(text)))
        text[r.randrange(120)] = "changed"
        rows.append((200 + i, " ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(500, None), (501, ""), (502, "  "), (503, "tiny"), (504, "TINY"), (500, None), (None, rows[0][1]), (None, "alone"), (505, "long " * 50_000)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA + ", fp int, component_id string")
    got = sorted((tuple(x) for x in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, plain_components([d for d, _ in rows], fps))), key=str)
    assert got == want
    kept = sorted((x["doc_id"] for x in simhash.keep_first(df).collect()), key=str)
    assert kept == sorted({d for d, _, c in want if d == c}, key=str)
    assert simhash.keep_first(df).columns == df.columns


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    r = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (7, d), (7, e), (None, e), (7, d), (8, c)]
    kept = sorted(((x["doc_id"], x["text"]) for x in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, d), (7, e), (8, c)], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_lines_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 299), (300, 299)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 299: 299, 300: 299}
    node, root = star_forest(np.array([5, 9, 9]), np.array([9, 2, 3]))
    assert dict(zip(node.tolist(), root.tolist())) == {3: 2, 5: 2, 9: 2}
