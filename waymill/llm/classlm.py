"""Class-based bigram language model with exchange-clustered word classes.

p(word | previous word) = p(class of word | class of previous word) * p(word | its class).

Texts are encoded once into batches: a dictionary of the batch's distinct words and the tokens
as its numbers. Words then travel as packed 128-bit keys, once a batch, to buckets, where their
training counts and the counts of their neighbours' classes are added up. The most frequent words
seed the classes. An exchange moves every word to the class whose contexts explain its own best,
until its rounds are over, and the batches learn their words' new classes; the next exchange counts
the contexts anew, in these classes. After each exchange the likelihood of the training tokens
under the class bigrams is counted, and an exchange that lowers it is undone and ends the
clustering, so the likelihood never falls. Words seen once are a class of their own, which also
holds the unknown word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, crc_bucket, deleted, kept_at, spilled, text_groups

CLASSES = 64  # the end's, the seeds', the others', and that of words seen once
END, RARE, OTHERS = 0, CLASSES - 1, CLASSES - 2
SLOTS = 2 * CLASSES  # a word's contexts: the class before it, then the class after it
ROUNDS = 4  # of moves within an exchange
EXCHANGES = 2
BATCH = 12 << 20
BUCKET_WORDS = 150_000  # a bucket's words, a batch each, on average

BATCHES = "batch string, ids array<long>, held array<boolean>, lengths array<int>, codes binary, words binary, counts binary, n_words int, totals binary, classes binary, old binary"
REQUESTS = "bucket int, batch string, at binary, keys binary, counts binary, classes binary, sizes binary, slots binary, numbers binary"
BUCKETS = "bucket int, batches array<string>, ats array<binary>, words array<binary>, totals binary, classes binary, sizes binary, slots binary, numbers binary"
REPLIES = "batch string, at binary, totals binary, classes binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(a, kind) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, dtype=kind).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [() for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end, which is the empty word."""
    return [*text.lower().split(), b""]


def encode(docs: DataFrame) -> DataFrame:
    """The batches of docs(doc_id, text, held): see BATCHES. Word 0 of a batch is the end; classes are not known yet."""

    def run(batches):
        for batch, texts in text_groups(batches, limit=BATCH):
            known: dict[bytes, int] = {b"": 0}
            add = known.setdefault
            held = batch.column("held").to_pylist()
            parts = []
            for text in texts:
                words = tokens(text)
                parts.append(np.fromiter((add(w, len(known)) for w in words), np.uint32, len(words)))
            lengths = np.array([len(p) for p in parts], np.int64)
            codes = np.concatenate(parts)
            counts = np.bincount(codes[np.repeat(~np.array(held, bool), lengths)], minlength=len(known))
            first = xxhash.xxh3_64_hexdigest(codes.tobytes()) + f"-{batch.column('doc_id')[0].as_py()}-{batch.column('part')[0].as_py()}"
            row = (first, batch.column("doc_id").to_pylist(), held, lengths.tolist(), _packed(codes, np.uint32), zstandard.compress(b" ".join(known)), _packed(counts, np.uint32), len(known), None, None, None)
            yield _record([row], BATCHES)

    part = F.monotonically_increasing_id()
    return spilled(docs.select(F.col("doc_id").cast("long"), "text", "held", part.alias("part")).mapInArrow(run, BATCHES))


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(previous, current) word numbers of all training tokens; before a text's first stands the end."""
    codes = _unpacked(row["codes"], np.uint32)
    now = codes[np.repeat(~np.array(row["held"], bool), row["lengths"])].astype(np.int64)
    return np.concatenate([[0], now[:-1]]), now


def _counted(encoded: DataFrame, pick) -> DataFrame:
    """(word, n) of the words that pick(words, counts) names by their places, added up over all batches."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = zstandard.decompress(row["words"]).split(b" "), _unpacked(row["counts"], np.uint32)
                rows = [(words[i], int(counts[i])) for i in pick(words, counts) if i and counts[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    return encoded.select("words", "counts").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def seeds(encoded: DataFrame, count: int = OTHERS - 1) -> dict[bytes, int]:
    """Classes of the words that seed them: the count most frequent of all, by whole counts.

    The count-th best sum of the batches' own best words is a floor. A word whose counts all lie
    under its share a batch can't reach it; all others are counted in every batch.
    """
    top = lambda df: df.orderBy(F.desc("n"), "word").limit(count).collect()
    best = top(_counted(encoded, lambda words, counts: np.argsort(-counts.astype(np.int64), kind="stable")[: count + 1]))
    if len(best) == count:
        share = best[-1]["n"] / encoded.count()
        wanted = {bytes(r["word"]) for r in _counted(encoded, lambda words, counts: np.flatnonzero(counts >= share)).select("word").collect()}
        best = top(_counted(encoded, lambda words, counts: [i for i, w in enumerate(words) if w in wanted]))
    return {bytes(r["word"]): i + 1 for i, r in enumerate(best)}


def requests(batches: DataFrame, seeded: dict[bytes, int], buckets: int) -> DataFrame:
    """Every batch's words for every bucket: keys, training counts, classes and counts of context slots.

    Words whose classes aren't known are in those that seeded tells, or in OTHERS.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = zstandard.decompress(row["words"]).split(b" ")
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
                if row["classes"] is None:
                    classes = np.fromiter((seeded.get(w, OTHERS) for w in words), np.int64, len(words))
                    classes[0] = END
                else:
                    classes = _unpacked(row["classes"], np.uint8).astype(np.int64)
                before, now = _training(row)
                pairs = np.concatenate([now * SLOTS + classes[before], before * SLOTS + CLASSES + classes[now]])
                pairs, number = np.unique(pairs, return_counts=True)
                sizes = np.bincount(pairs // SLOTS, minlength=len(words))
                ends = np.cumsum(sizes)
                bucket = (digests[:, 0] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
                counts = _unpacked(row["counts"], np.uint32)
                for s, e in zip(cut, np.append(cut[1:], len(order))):
                    own = order[s:e]
                    n = sizes[own]
                    at = np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    yield _record(
                        [(int(bucket[own[0]]), row["batch"], _packed(own, np.uint32), np.ascontiguousarray(digests[own]).tobytes(), _packed(counts[own], np.uint32), _packed(classes[own], np.uint8), _packed(n, np.uint16), _packed(pairs[at] % SLOTS, np.uint8), _packed(number[at], np.uint32))],
                        REQUESTS,
                    )

    return batches.select("batch", "held", "lengths", "codes", "words", "counts", "classes").mapInArrow(run, REQUESTS)


def gather(asked: DataFrame) -> DataFrame:
    """The buckets: distinct words with their totals over all batches, and who asked for which."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64).reshape(-1, 2) for r in rows])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.concatenate([[True], (np.diff(keys[order], axis=0) != 0).any(axis=1)])
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        words = int(new.sum())
        classes = np.zeros(words, np.uint8)
        classes[number] = np.concatenate([_unpacked(r["classes"], np.uint8) for r in rows])
        counts = np.concatenate([_unpacked(r["counts"], np.uint32) for r in rows])
        totals = np.bincount(number, counts, words).astype(np.int64)
        size = np.concatenate([_unpacked(r["sizes"], np.uint16) for r in rows])
        slots = np.concatenate([_unpacked(r["slots"], np.uint8) for r in rows])
        n = np.concatenate([_unpacked(r["numbers"], np.uint32) for r in rows])
        pairs, where = np.unique(np.repeat(number, size) * SLOTS + slots, return_inverse=True)
        n = np.bincount(where, n, len(pairs)).astype(np.int64)
        asked_for = np.split(number, np.cumsum([len(r["keys"]) // 16 for r in rows])[:-1])
        row = (
            rows[0]["bucket"], [r["batch"] for r in rows], [r["at"] for r in rows], [_packed(a, np.uint32) for a in asked_for],
            _packed(totals, np.int64), _packed(classes, np.uint8), _packed(np.bincount(pairs // SLOTS, minlength=words), np.uint16), _packed(pairs % SLOTS, np.uint8), _packed(n, np.int64),
        )
        return pa.Table.from_batches([_record([row], BUCKETS)])

    return asked.groupBy("bucket").applyInArrow(run, BUCKETS)


def _contexts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(words x slots counts, totals) of a bucket."""
    sizes, totals = _unpacked(row["sizes"], np.uint16), _unpacked(row["totals"], np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes) * SLOTS + _unpacked(row["slots"], np.uint8)
    return np.bincount(at, _unpacked(row["numbers"], np.int64), len(sizes) * SLOTS).reshape(-1, SLOTS), totals


def choose(contexts: np.ndarray, totals: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """The class of each word: the one whose context profile makes the word's contexts likeliest.

    Words seen once, or never, are RARE. A class without words attracts none; ties go to the first.
    """
    smooth = profiles + 0.1
    logs = np.log(smooth / smooth.reshape(-1, 2, CLASSES).sum(axis=2).repeat(CLASSES, axis=1))
    fit = contexts @ logs.T
    fit[:, profiles.sum(axis=1) == 0] = -np.inf
    fit[:, [END, RARE]] = -np.inf
    best = np.where(np.isfinite(fit.max(axis=1)), fit.argmax(axis=1), OTHERS)
    return np.where(totals > 1, best, RARE)


def _classes(row: dict, profiles: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, totals, classes) of a bucket: by profiles, or without them the classes so far. The end stays apart."""
    contexts, totals = _contexts(row)
    own = _unpacked(row["classes"], np.uint8).astype(np.int64)
    classes = np.where(totals > 1, own, RARE) if profiles is None else choose(contexts, totals, profiles)
    return contexts, totals, np.where(own == END, END, classes)


def _summed(partial: DataFrame, cells: int) -> np.ndarray:
    """The sum of partial(v array<long>) over its rows, added up before it reaches the driver."""
    total = partial.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(cells)
    for r in total.collect():
        out[r["i"]] = r["x"]
    return out


def exchange(gathered: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """(classes x slots): the context profiles of the classes after rounds of moves, contexts in the classes so far."""
    profiles = None
    for _ in range(rounds):

        def run(batches, profiles=profiles):
            for batch in batches:
                for row in batch.to_pylist():
                    contexts, _, classes = _classes(row, profiles)
                    sums = np.zeros((CLASSES, SLOTS))
                    np.add.at(sums, classes, contexts)
                    yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], ["v"])

        partial = gathered.select("totals", "classes", "sizes", "slots", "numbers").mapInArrow(run, "v array<long>")
        profiles = _summed(partial, CLASSES * SLOTS).reshape(CLASSES, SLOTS)
    return profiles


def assign(batches: DataFrame, gathered: DataFrame, profiles: np.ndarray, again: bool) -> DataFrame:
    """The batches with the total and the new class of each of their words; old: the class before, if there was
    one. The words themselves stay only if they are asked for again."""

    def reply(rows):
        for batch in rows:
            for row in batch.to_pylist():
                _, totals, classes = _classes(row, profiles)
                for name, at, words in zip(row["batches"], row["ats"], row["words"]):
                    own = _unpacked(words, np.uint32)
                    yield _record([(name, at, _packed(totals[own], np.int64), _packed(classes[own], np.uint8))], REPLIES)

    def merge(batch: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in batch.to_pylist():
            totals, classes = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.uint8)
            for r in replies.to_pylist():
                at = _unpacked(r["at"], np.uint32)
                totals[at], classes[at] = _unpacked(r["totals"], np.int64), _unpacked(r["classes"], np.uint8)
            out.append((*[row[c] for c in ("batch", "ids", "held", "lengths", "codes", "words", "counts", "n_words")], _packed(totals, np.int64), _packed(classes, np.uint8), row["classes"]))
        return pa.Table.from_batches([_record(out, BATCHES)])

    if not again:
        none = F.lit(None).cast("binary")
        batches = batches.withColumn("words", none).withColumn("counts", none)
    answers = gathered.mapInArrow(reply, REPLIES)
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(merge, BATCHES)


def transitions(batches: DataFrame, column: str = "classes") -> np.ndarray:
    """(classes x classes): how often a training token of one class follows one of another."""

    def run(rows):
        for batch in rows:
            for row in batch.to_pylist():
                classes, (before, now) = _unpacked(row[column], np.uint8).astype(np.int64), _training(row)
                n = np.bincount(classes[before] * CLASSES + classes[now], minlength=CLASSES**2)
                yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.int64()))], ["v"])

    return _summed(batches.select("held", "lengths", "codes", column).mapInArrow(run, "v array<long>"), CLASSES**2).reshape(CLASSES, CLASSES)


def likelihood(moved: np.ndarray) -> float:
    """What classes add to the training tokens' log likelihood; the rest depends on the words alone."""
    plogp = lambda n: float((n * np.log(np.maximum(n, 1))).sum())
    return plogp(moved) - plogp(moved.sum(axis=0)) - plogp(moved.sum(axis=1))


class Clustered:
    """The words' classes after the exchanges: batches, the column of the classes that hold, their
    transitions, the likelihood after each exchange, and counts of the training tokens: all, distinct,
    seen once and twice. Each exchange's buckets and batches are written to the shared folder, so that
    the shuffles that made them, and the tables before, can be released at once."""

    def __init__(self, encoded: DataFrame, exchanges: int = EXCHANGES):
        words = encoded.agg(F.sum("n_words")).first()[0] or 0
        buckets = max(8, -(-words // BUCKET_WORDS))
        seeded, self.batches, self.column, self.likelihoods = seeds(encoded), encoded, "classes", []
        spark, path = encoded.sparkSession, None
        for k in range(exchanges):
            gathered, buckets_at = kept_at(gather(requests(self.batches, seeded, buckets)))
            collect_garbage(spark)
            if not k:
                self.counts = self._count(gathered)
            moved, written_to = kept_at(assign(self.batches, gathered, exchange(gathered), k + 1 < exchanges))
            deleted(spark, buckets_at)
            self.batches.unpersist(blocking=True)
            if path:
                deleted(spark, path)
            self.batches, path = moved, written_to
            del gathered, moved
            collect_garbage(spark)
            after = transitions(self.batches)
            self.likelihoods.append(likelihood(after))
            if k and self.likelihoods[-1] < self.likelihoods[-2]:
                self.column = "old"  # undone; self.moved is still that of the classes before
                break
            self.moved = after

    def _count(self, gathered: DataFrame) -> np.ndarray:
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    t = _unpacked(row["totals"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([[int(t.sum()), int((t > 0).sum()), int((t == 1).sum()), int((t == 2).sum())]], pa.list_(pa.int64()))], ["v"])

        return _summed(gathered.select("totals").mapInArrow(run, "v array<long>"), 4)


class Model:
    """Training counts that score texts: tokens, distinct tokens, those seen once and twice, class transitions."""

    def __init__(self, counts: np.ndarray, moved: np.ndarray):
        self.n, self.v, once, twice = counts
        self.log_moves = np.log10((moved + 1) / (moved.sum(axis=1, keepdims=True) + CLASSES))
        self.class_tokens = moved.sum(axis=0)
        # The share of RARE that is unknown, by how much rarer words seen twice are than those seen once.
        self.unknown = once / (once + 2 * twice) if once + twice else 0.5
        if not once:
            self.unknown = 1.0
        self.once = once

    def emissions(self, totals: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of p(word | its class), for words by their totals and classes."""
        p = totals / np.maximum(self.class_tokens[classes], 1)
        p = np.where(totals == 0, self.unknown, np.where(totals == 1, (1 - self.unknown) / max(self.once, 1), p))
        p = np.where(classes == END, 1.0, p)
        return np.log10(p, out=np.full(len(p), -300.0), where=p > 0)


def score_batches(batches: DataFrame, column: str, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                totals, classes = _unpacked(row["totals"], np.int64), _unpacked(row[column], np.uint8)
                codes, lengths = _unpacked(row["codes"], np.uint32), np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((totals + 1) / (model.n + model.v + 1))
                own = classes[codes]
                before = np.concatenate([np.array([END], np.uint8), own[:-1]])
                before[starts] = END
                logs = model.log_moves[before, own]
                logs += model.emissions(totals, classes)[codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths),
                        pa.array(np.add.reduceat((totals > 0)[codes].astype(np.int64), starts)), pa.array(np.full(len(lengths), int(model.n))),
                        pa.array(np.add.reduceat(base[codes], starts)), pa.array(np.add.reduceat(logs, starts)),
                    ],
                    [c.split()[0] for c in SCORES.split(", ")],
                )

    return batches.select("ids", "held", "lengths", "codes", "totals", column).mapInArrow(run, SCORES)


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """SCORES of every row of docs(doc_id, text): the base's and the model's log10 probability.

    Documents whose crc32(doc_id as text) modulo modulus is held teach nothing. Tokens are
    words and one end a text; a null text is its end alone; a null id counts as the empty text;
    repeated rows are learned and returned each time; an empty table gives no rows, and without
    training documents all words are the unknown one. Perplexity is 10 ** (-score / n_tokens).
    Other columns are not read.
    """
    split = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id").cast("long"), modulus) == held).alias("held"))
    found = Clustered(encode(split))
    return score_batches(found.batches, found.column, Model(found.counts, found.moved))
