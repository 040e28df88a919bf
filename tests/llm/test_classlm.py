"""Language model scoring: the base exactly, the model as a distribution that beats it."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from waymill.llm import classlm

DOCS = "doc_id long, text string, score string, held int"


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, got):
    toks = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    counts = Counter()
    for (d, _), w in zip(rows, toks):
        if not held(d):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held(d), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for (d, _), w in zip(rows, toks)), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9, rel=1e-9)
        assert g[6] <= 1e-9


def test_odd_rows(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(30))) for i in range(40)] + [(100, None), (101, ""), (102, "New"), (None, "w1 W1"), (3, "w1"), (103, "unknown " * 40_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS)
    check(rows, classlm.score(df).collect())
    monkeypatch.setattr(classlm, "BATCH", 200)  # many batches and buckets say the same
    monkeypatch.setattr(classlm, "BUCKET_WORDS", 5)
    check(rows, classlm.score(df).collect())
    assert classlm.score(df.limit(0)).collect() == []


def test_without_training_documents(spark):
    only = next(i for i in range(100) if held(i))
    got = classlm.score(spark.createDataFrame([(only, "some words", "s", 1)], DOCS)).collect()
    assert tuple(got[0])[:5] == (only, True, 3, 0, 0) and got[0]["base_score"] == 0 and math.isfinite(got[0]["score"])


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = classlm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    model, base = (-sum(r[c] for r in rows) / n for c in ("score", "base_score"))
    assert model < base


def texts(n=150, seed=0, words=400):
    """Sentences of a small grammar, so that classes of words exist to be found; some words occur once."""
    r = np.random.default_rng(seed)
    kinds = [[f"{k}{i}" for i in range(words // 4)] for k in "abcd"]
    out = []
    for i in range(n):
        line = [kinds[(j + r.integers(0, 2)) % 4][min(r.zipf(1.4), words // 4) - 1] for j in range(r.integers(1, 60))]
        out.append((i, " ".join([*line, f"once{i}"])))
    return out


def plain_score(rows, exchanges=classlm.EXCHANGES):
    """(likelihoods, score of each row) of the model over one vocabulary, without batches or buckets."""
    toks = [[*t.encode().lower().split(), b""] for _, t in rows]
    train = [w for (d, _), w in zip(rows, toks) if not held(d)]
    counts = Counter(x for w in train for x in w)
    words = sorted(counts)
    place = {w: i for i, w in enumerate(words)}
    total = np.array([counts[w] for w in words])
    seeded = sorted((w for w in words if w), key=lambda w: (-counts[w], w))[: classlm.OTHERS - 1]
    z = np.full(len(words), classlm.OTHERS)
    z[[place[w] for w in seeded]] = np.arange(len(seeded)) + 1
    end = place[b""]
    z[end] = classlm.END
    flat = np.array([place[x] for w in train for x in w])
    before, size = np.concatenate([[end], flat[:-1]]), classlm.CLASSES

    def moves(z):
        out = np.zeros((size, size))
        np.add.at(out, (z[before], z[flat]), 1)
        return out

    def value(m):
        log = lambda x: sum(v * math.log(v) for v in x.ravel().tolist() if v)
        return log(m) - log(m.sum(axis=0)) - log(m.sum(axis=1))

    found = []
    for k in range(exchanges):
        contexts = np.zeros((len(words), 2 * size))
        np.add.at(contexts, (flat, z[before]), 1)
        np.add.at(contexts, (before, size + z[flat]), 1)
        own, start = None, np.where(total > 1, z, classlm.RARE)
        start[end] = classlm.END
        for step in range(classlm.ROUNDS + 1):
            if step:
                profile = np.zeros((size, 2 * size))
                np.add.at(profile, own, contexts)
                smooth = profile + 0.1
                left, right = smooth[:, :size], smooth[:, size:]
                logs = np.log(np.concatenate([left / left.sum(axis=1, keepdims=True), right / right.sum(axis=1, keepdims=True)], axis=1))
                fit = contexts @ logs.T
                fit[:, profile.sum(axis=1) == 0] = -np.inf
                fit[:, [classlm.END, classlm.RARE]] = -np.inf
                own = np.where(total > 1, fit.argmax(axis=1), classlm.RARE)
                own[end] = classlm.END
            else:
                own = start
        found.append(value(moves(own)))
        if k and found[-1] < found[-2]:
            break
        z = own
    m = moves(z)
    log_moves = np.log10((m + 1) / (m.sum(axis=1, keepdims=True) + size))
    once, twice = (total == 1).sum(), (total == 2).sum()
    unknown = once / (once + 2 * twice)
    scores = []
    for w in toks:
        last, score = classlm.END, 0.0
        for x in w:
            c = int(z[place[x]]) if x in place else classlm.RARE
            n = counts[x]
            score += log_moves[last, c]
            score += math.log10(unknown) if not n else math.log10((1 - unknown) / once) if n == 1 else 0.0 if not x else math.log10(n / m[:, c].sum())
            last = c
        scores.append(score)
    return found, scores


@pytest.mark.parametrize(("seed", "batch"), [(0, 12 << 20), (0, 3000), (1, 900)])
def test_scores_are_those_of_a_plain_computation(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(classlm, "BATCH", batch)
    monkeypatch.setattr(classlm, "BUCKET_WORDS", 1 << 20 if batch > 3000 else 60)
    rows = texts(seed=seed)
    likelihoods, want = plain_score(rows)
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS)
    got = {r["doc_id"]: r["score"] for r in classlm.score(df).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-9)
    split = df.selectExpr("doc_id", "text").withColumn("held", classlm.crc_bucket(df["doc_id"], 7) == 2)
    clustered = classlm.Clustered(classlm.encode(split))
    assert clustered.likelihoods == pytest.approx(likelihoods)
    assert clustered.column == ("old" if len(likelihoods) > 1 and likelihoods[-1] < likelihoods[-2] else "classes")


def test_exchanges_raise_the_likelihood(spark):
    rows = texts(400, 3)
    split = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false as held")
    found = classlm.Clustered(classlm.encode(split), exchanges=4).likelihoods
    assert len(found) > 1 and all(b >= a for a, b in zip(found[:-1], found[1:-1])) and max(found) > found[0]


def test_seeds_go_by_whole_counts(spark, monkeypatch):
    """A word that is never among a batch's best, but the most frequent over all, is a seed."""
    monkeypatch.setattr(classlm, "BATCH", 10)
    lines = []
    for b in range(12):
        lines.append(" ".join([f"local{b}x{k}" for k in range(3) for _ in range(4)] + ["steady"] * 3))
    split = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").selectExpr("*", "false as held").coalesce(1)
    encoded = classlm.encode(split)
    assert encoded.count() == 12
    assert classlm.seeds(encoded, 2) == {b"steady": 1, b"local0x0": 2}


def test_model_is_a_distribution(spark):
    import zstandard

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(40)) + f" once{i}", "s", 1) for i in range(60)], DOCS).selectExpr("doc_id", "text", "false as held")
    encoded = classlm.encode(docs)
    gathered = classlm.gather(classlm.requests(encoded, classlm.seeds(encoded), 8))
    merged = classlm.assign(encoded, gathered, classlm.exchange(gathered), True)
    found = classlm.Clustered(encoded, 1)
    model = classlm.Model(found.counts, classlm.transitions(merged))
    totals, classes = {}, {}
    for row in merged.collect():
        names = zstandard.decompress(row["words"]).split(b" ")
        totals |= dict(zip(names, np.frombuffer(zstandard.decompress(row["totals"]), np.int64).tolist()))
        classes |= dict(zip(names, np.frombuffer(zstandard.decompress(row["classes"]), np.uint8).tolist()))
    t = np.array([*totals.values(), 0])
    c = np.array([*(classes[w] for w in totals), classlm.RARE])
    emissions = 10 ** model.emissions(t, c)
    for k in set(c.tolist()):
        assert emissions[c == k].sum() == pytest.approx(1)
    assert (10**model.log_moves).sum(axis=1) == pytest.approx(1)
    assert classes[b""] == classlm.END and all(classes[w] == classlm.RARE for w, n in totals.items() if n == 1)
