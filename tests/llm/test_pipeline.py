"""The pipeline's stages: what each one decides takes effect, columns stay, clean documents too."""

import random
from collections import defaultdict
from zlib import crc32

import corpus_pipeline
from tests.llm import test_decontam, test_langid, test_nearcopies, test_packing
from waymill.llm import langid, packing
from waymill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, again))


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) < set(QUERIES)


def without_repeats(rows, width=50):
    """rows(doc_id, text) without the bytes of strings that a smaller doc_id has too; cut characters go whole."""
    first = {}
    for doc_id, text in rows:
        data = text.encode()
        for p in range(len(data) - width + 1):
            first[data[p : p + width]] = min(first.get(data[p : p + width], doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < doc_id:
                gone[p : p + width] = b"\1" * width
        out.append((doc_id, bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")))
    return out


def expected(docs, items, capacity):
    """What the five stages keep and pack, by plain scans of all rows."""
    taught = [(t or "", lang) for i, t, lang, _, _ in docs if lang and crc32(str(i).encode()) % 4 != 2]
    told = test_langid.plain_cosines([t for t, _ in taught], [x for _, x in taught], [t or "" for _, t, *_ in docs], langid.DIM)
    spoken = [r for r, (_, score) in zip(docs, told) if any(c.isalpha() for c in r[1] or "") and score > 0]
    kept = test_nearcopies.plain([(r[0], r[1]) for r in spoken])
    cut = without_repeats(kept)
    judged = {(r[0], r[1]): r[5] for r in test_decontam.plain([(i, t) for i, t in cut], items)}
    clean = [(i, t) for (i, t) in cut if not next(r[5] for r in test_decontam.plain([(i, t)], items))]
    assert judged
    source = {r[0]: r[3] for r in docs}
    rows = sorted(((len(t.split()), i, source[i], t) for i, t in clean), key=lambda r: (-r[0], r[1]))
    pieces, bins = test_packing.plain([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], capacity)
    return [r[0] for r in spoken], [i for i, _ in kept], clean, sorted((rows[i][1], p, n) for i, p, _, n in pieces), bins


def test_run_against_plain_scans(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    words = {"en": "the of and to in that with for was house".split(), "de": "der die das und ist nicht ein mit auf haus".split(), "es": "el la de que y los una por con casa".split()}
    spell = {"en": "abcdehilmnorstw", "de": "abdeghiklmnrsuz", "es": "aacdeilmnoorsu"}

    def line(lang, n):
        return [r.choice(words[lang]) if r.random() < 0.4 else "".join(r.choice(spell[lang]) for _ in range(r.randrange(3, 9))) for _ in range(n)]

    items = [(k, " ".join(line("en", 25))) for k in range(4)]
    passage = "this passage of more than fifty bytes stands in several of the documents here"
    docs = []
    for i in range(60):
        lang = r.choice(list(words))
        text = line(lang, r.choice([3, 30, 80, 150]))
        if i % 6 == 0:
            text[1:1] = passage.split()
        if i % 10 == 3:
            text = [*items[i % 4][1].split(), *text[:60]]
        docs.append((i, " ".join(text), lang, f"s{i % 5}"))
        if i % 7 == 0 and len(text) > 70:
            near = list(text)
            near[10] = near[50] = "changed"
            docs += [(200 + i, " ".join(near), lang, "s9"), (300 + i, " ".join(text), None, "s8")]
    docs += [(400, None, "en", "s1"), (401, "", "en", None), (402, "12 34 !!", None, "s1"), (403, "x " * 3000, "en", "s2")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spoken, kept, clean, pieces, bins = expected(docs, items, packing.CAPACITY)
    assert len(docs) > len(spoken) > len(kept) > len(clean) > 40

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), want in zip(corpus_pipeline.STAGES, (spoken, kept)):
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert sorted(x["doc_id"] for x in frame.collect()) == sorted(want)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        frame = stage(spark, frame, str(tmp_path)).cache()
    assert sorted((x["doc_id"], x["text"]) for x in frame.collect()) == sorted(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["piece"], x["length"]) for x in got) == pieces
    assert len({x["bin_id"] for x in got}) == bins
    held, source = defaultdict(list), {i: s for i, _, _, s, _ in docs}
    for x in got:
        held[x["bin_id"]].append((x["bin_offset"], x["length"], source[x["doc_id"]]))
    for rows in held.values():
        rows.sort(key=lambda v: v[:2])
        assert all(a[0] + a[1] <= b[0] for a, b in zip(rows, rows[1:])) and sum(v[1] for v in rows) <= packing.CAPACITY
        named = [v[2] for v in rows if v[2]]
        assert len(named) == len(set(named))
