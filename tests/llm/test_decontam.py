"""Decontamination against a plain scan."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from waymill.llm import decontam

DOCS, ITEMS = "doc_id long, text string, n_hit string, id int", "item_id long, text string, pos int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width=13):
    found = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for item_id, passage in items:
            p = words(passage)
            n = min(width, len(p))
            wins = {tuple(p[j : j + n]) for j in range(len(p) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    if item_id is not None:
                        got.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        found.append((doc_id, len(w), len(hit), len(got), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(found, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    return sorted((tuple(r) for r in decontam.contamination(d, spark.createDataFrame([(*r, 2) for r in items], ITEMS)).collect()), key=str)


def test_against_a_plain_scan(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Été", "naïve", "x9"]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate((13, 20, 40, 14, 5, 1, 0, 60))] + [(8, None), (None, line(15)), (1, line(20)), (10, "same " * 30), (9, "... --- ,,")]
    docs = []
    for i in range(60):
        text = line(r.randrange(0, 80))
        if i % 3 == 0:
            passage = r.choice(items)[1] or ""
            cut = passage.split()
            a = r.randrange(0, len(cut) + 1)
            text += " , " + " ".join(cut[a : a + r.choice((5, 13, 30))]).upper().replace("É", "é") + "; " + line(5)
        docs.append((i, text))
    docs += [(60, None), (61, ""), (62, "!!"), (None, items[1][1]), (5, docs[5][1]), (63, "filler " * 20_000 + items[2][1]), (64, "same " * 50), (64, items[0][1]), (65, ", " + items[0][1] + " .")]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == plain([(1, "a b c")], [])


def test_keep_clean(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage, "a", 1), (2, "clean words", "b", 2), (3, "filler " * 900 + passage, "c", 3), (None, passage, "d", 4), (5, None, "e", 5), (2, passage, "f", 6)], DOCS).withColumn("bad_id", F.lit(1)).withColumn("bad_th", F.lit(2))
    kept = decontam.keep_clean(docs, spark.createDataFrame([(1, passage, 2)], ITEMS))
    assert kept.columns == docs.columns and sorted(r["n_hit"] for r in kept.collect()) == ["b", "c", "e"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green", "", 1), (2, "red " + "x " * 50 + "blue green", "", 1), (3, "green blue red", "", 1), (4, "red red", "", 1)], DOCS)
    index = decontam.Index(docs, spark.createDataFrame([(1, "Red blue green", 2)], ITEMS))
    found = index.proximity(terms=3, span=10).collect()
    assert {r["id"] for r in found} == {1, 3}
    phrases = decontam.Index(docs, spark.createDataFrame([(1, "Red blue green", 2), (2, "blue red", 1)], ITEMS)).phrases()
    assert [(r["id"], r["item_id"], r["start"], r["length"]) for r in phrases.collect()] == [(3, "2", 1, 2)]
