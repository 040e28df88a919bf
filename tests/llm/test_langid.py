"""Language ID: vectors against the definition, accuracy on held-out documents, odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from waymill.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, lang_pred string"


def plain_vector(text, letters):
    out, s = np.zeros(letters.shape[1]), langid.symbols(text)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundles_follow_the_definition():
    letters = langid.letter_vectors(64)
    texts = ["The cat", "", "été  ÉTÉ 12 ß", "x", "\U0001d400 y"]
    got = langid.bundle(texts, letters)
    for t, v in zip(texts, got):
        assert np.allclose(v, plain_vector(t, letters))
    assert not got[1].any()


def plain_cosines(texts, langs, want, dim=256):
    """Best language and cosine of each of want, by the definition."""
    letters = langid.letter_vectors(dim)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    sums = {x: unit(sum(unit(plain_vector(t, letters)) for t, y in zip(texts, langs) if x == y)) for x in sorted(set(langs))}
    centre = sum(sums.values()) / len(sums)
    out = []
    for t in want:
        v = unit(plain_vector(t, letters)) - centre
        cos = {x: float(unit(v) @ unit(p - centre)) for x, p in sums.items()}
        best = max(cos, key=cos.get)
        out.append((best, min(max(cos[best], 0), 1)))
    return out


def test_predictions_are_plain_cosines(spark):
    texts = ["the cat and the dog", "this is the house", "der hund und die katze", "das ist das haus", "le chat et le chien", "\U00010330\U00010331\U00010332 \U00010333"]
    langs = ["en", "en", "de", "de", "fr", "got"]
    df = spark.createDataFrame(list(enumerate(zip(texts, langs))), "i int, x struct<text:string,lang:string>").select("x.*")
    model = langid.prototypes(df, 256)
    want = ["a dog in the house", "die hunde", "chien", "\U00010331\U00010332", "x", *texts]
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(t,) for t in want], "text string").coalesce(1), model).collect()]
    plain = plain_cosines(texts, langs, want)
    assert [g[0] for g in got] == [p[0] for p in plain] and np.allclose([g[1] for g in got], [p[1] for p in plain], atol=1e-4)
    assert got[3][0] == "got" and got[3][1] > 0  # letters beyond the basic plane


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_odd_rows(spark):
    en, de = "the cat and the dog are in the house with their toys", "der hund und die katze sind im haus mit den kindern"
    rows = [(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(40)] + [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, en, None), (None, de, "de"), (0, en, "en"), (104, en * 5000, "xx")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA)
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102))
    assert by[None]["lang_pred"] == "de" and by[1]["lang_pred"] == "de" and 0 < by[1]["score"] <= 1
    kept = langid.keep_identified(df)
    assert kept.dtypes == df.dtypes and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in (100, 101, 102)), key=str)
    assert {r["doc_id"]: r["lang"] for r in kept.collect()}[103] == "en"  # was null
    assert {r["doc_id"]: r["lang"] for r in kept.collect()}[104] == "xx"
    untaught = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(untaught).count() == kept.count() and langid.keep_identified(df.limit(0)).collect() == []
    assert langid.identify(df.limit(0)).collect() == []
    none = langid.identify(df.where("lang is null")).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
