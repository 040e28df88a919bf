"""Suffix sorting against Python's sort, and substring dedup against sets of substrings."""

import hashlib
import random

import numpy as np
import pytest

from waymill.llm import sufdedup, suffix

DOCS = "doc_id long, text string, lang string, n_chars long, c_id int"


def test_cover_holds_every_distance():
    assert {int((a - b) % suffix.PERIOD) for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


@pytest.mark.parametrize("seed", range(60))
def test_suffixes(seed):
    r = random.Random(seed)
    n, letters = r.choice([0, 1, 2, 5, 60, 200, 700]), r.choice([1, 2, 3, 26])
    data = bytes(r.choice(range(letters)) for _ in range(n))
    if seed % 2 and n:
        data = (data[: max(1, n // 7)] * 8)[:n]
    text = np.frombuffer(data, np.uint8)
    for block in (1 << 20, 17):
        assert [p for o in suffix.sorted_suffixes(text, block=block) for p in o.tolist()] == sorted(range(n), key=lambda i: data[i:])
    for width in (1, 8, 11, 50):
        places = np.arange(max(0, n - width + 1))
        classes = suffix.equal_windows(text, places, width, block=23).tolist() if n else []
        assert len({data[p : p + width] for p in places.tolist()}) == len(set(classes)) == len(set(zip(classes, (data[p : p + width] for p in places.tolist()))))


def plain(rows, width=50):
    """By document: its bytes, what stays, the spans."""
    first, out = {}, []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = float("inf") if doc_id is None else doc_id
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            first[w] = min(first.get(w, key), key)
    for doc_id, text in rows:
        data = (text or "").encode()
        key = float("inf") if doc_id is None else doc_id
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < key:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passages = [line(n) for n in (49, 50, 51, 80, 200)]
    rows = [(i, line(r.randrange(0, 150)) + r.choice(passages) + line(r.randrange(0, 100)) + r.choice(passages)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, ""), (202, "x" * 300), (203, "x" * 120), (204, "ab" * 100), (205, "ba" * 90), (None, rows[3][1]), (None, passages[4] + "tail"), (3, rows[3][1]), (206, "word " * 60_000), (207, "é" * 26 + passages[3])]
    return rows


def interleaved():
    """Windows alike for the 40 bytes that are sorted by themselves and told apart, or not, by what follows."""
    r = random.Random(5)
    head = bytes(r.randrange(97, 123) for _ in range(41))
    tails = [bytes(r.randrange(97, 123) for _ in range(30)) for _ in range(6)]
    text = b"".join(head + tails[r.randrange(6)] for _ in range(300))
    places = np.arange(0, 300 * 71 - 71, 71)
    return np.frombuffer(text, np.uint8), places, [text[p : p + 50] for p in places.tolist()]


def test_the_ranks_decide_which_windows_are_equal(monkeypatch):
    text, places, windows = interleaved()

    def right():
        got = suffix.equal_windows(text, places, 50)
        return len({*zip(got.tolist(), windows)}) == len(set(got.tolist())) == len(set(windows))

    assert suffix.PERIOD < 50 and right()
    monkeypatch.setattr(suffix, "cover_ranks", lambda keys, n: np.zeros(n + suffix.PERIOD, np.int64))
    assert not right()


@pytest.mark.parametrize("unit", [b"a", b"ab", b"abc" * 30, bytes(range(50)) * 3])
def test_long_ties(unit):
    text = np.frombuffer(unit * (3000 // len(unit)) + b"a" + unit * (1000 // len(unit)), np.uint8)
    data = text.tobytes()
    got = np.concatenate(list(suffix.sorted_suffixes(text, block=500)))
    assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_one_passage_in_every_group_is_few_numbers(spark, monkeypatch):
    """A passage that all documents share costs a segment an anchor and group, but for those at its ends, which differ."""
    monkeypatch.setattr(sufdedup, "GROUP_BYTES", 20_000)
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(200))
    rows = [(i, " ".join(passage + "".join(r.choice("ijklmnop") for _ in range(60)) for _ in range(4))) for i in range(200)]
    work = sufdedup.SubstringDedup(spark.createDataFrame(rows, "doc_id long, text string"))
    sent = work._segments().collect()
    whole = sum(len(sufdedup._unpack(x["lengths"])) for x in sent)
    assert work.groups > 5 and whole < 800 * 3
    got = sorted((tuple(x) for x in sufdedup.removed_spans(spark.createDataFrame([(*x, "l", 5, 6) for x in rows], DOCS)).drop("spans").collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(sufdedup, "CHUNK", 3000)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "l", 5, 6) for r in rows], DOCS)
    assert sorted((tuple(r) for r in sufdedup.removed_spans(df).drop("spans").collect()), key=str) == plain(rows)


def test_a_copy_takes_no_other_text_of_its_id_along(spark, monkeypatch):
    monkeypatch.setattr(sufdedup.F, "pmod", lambda *_: sufdedup.F.lit(0))  # all documents in one group
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh") for _ in range(120)) for _ in range(4)]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (2, texts[0]), (2, texts[2]), (3, texts[3])]
    df = spark.createDataFrame([(*r, "l", 5, 6) for r in rows], DOCS)
    assert sorted((tuple(r) for r in sufdedup.removed_spans(df).drop("spans").collect()), key=str) == plain(rows)


def test_texts_without_repeats(spark):
    shared = "this passage is shared by two documents and is longer than fifty bytes "
    rows = [(1, shared + "one"), (2, "two " + shared), (3, None), (4, "ééé" + shared)]
    df = spark.createDataFrame([(*r, "l", len(r[1] or ""), 6) for r in rows], DOCS)
    got = sufdedup.without_repeats(df)
    assert got.dtypes == df.dtypes
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] == rows[0][1] and by[2]["text"] == "two " and by[2]["n_chars"] == 4 and by[3]["text"] is None and by[3]["n_chars"] == 0 and by[4]["text"] == "ééé" and by[4]["lang"] == "l"


def test_empty_table_and_narrow_width(spark):
    df = spark.createDataFrame([], DOCS)
    assert sufdedup.removed_spans(df).collect() == []
    with pytest.raises(ValueError):
        sufdedup.SubstringDedup(df, 20)


def test_the_sql_says_the_same():
    import duckdb

    from waymill.llm.queries import ORACLE_SQL

    rows = corpus(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op8_suffix_array_dedup"]).fetchall(), key=str) == plain(rows)
