"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors,
each permuted by its place: rot(rot(a)) * rot(b) * c. A text's vector bundles (adds) those of
all its n-grams, a language's prototype those of its texts, and a text is compared with the
prototypes by cosine after the mean of all prototypes is taken off both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, text_groups

DIM = 1024
SYMBOLS = 96  # 26 letters, the word edge, and 69 classes of other letters by code point
SEED = 7
UNKNOWN = "und"


def letter_vectors(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim)) * 2 - 1).astype(np.float32)


def _symbol(code: int) -> int:
    """Symbol of a code point: letters by lower case, all else the word edge."""
    if not chr(code).isalpha():
        return 0
    o = ord(chr(code).lower()[0])
    return o - 96 if 97 <= o <= 122 else 27 + o % (SYMBOLS - 27)


PLANE = 0x10000
_TABLE: list[np.ndarray] = []  # of the basic plane
_BEYOND: dict[int, int] = {}  # of the letters met beyond it


def symbols(text: str) -> np.ndarray:
    """The symbols of a text's letters and one edge for each run of anything else, edges at both ends."""
    if not _TABLE:
        _TABLE.append(np.array([_symbol(c) for c in range(PLANE)], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes) + 2, np.uint8)
    out[1:-1] = _TABLE[0][np.minimum(codes, PLANE - 1)]
    beyond = np.flatnonzero(codes >= PLANE)
    if len(beyond):
        found, where = np.unique(codes[beyond], return_inverse=True)
        for c in found.tolist():
            if c not in _BEYOND:
                _BEYOND[c] = _symbol(c)
        out[1 + beyond] = np.array([_BEYOND[c] for c in found.tolist()], np.uint8)[where]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def bundle(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """(texts, dim): the sum of each text's trigram vectors; zeros where it has no letter."""
    grams, owners = [], []
    for i, text in enumerate(texts):
        s = symbols(text).astype(np.int32)
        if len(s) > 2:
            grams.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])
            owners.append(np.full(len(s) - 2, i, np.int32))
    out = np.zeros((len(texts), letters.shape[1]), np.float32)
    if not grams:
        return out
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    present = np.flatnonzero(np.bincount(grams, minlength=SYMBOLS**3))
    column = np.zeros(SYMBOLS**3, np.int32)
    column[present] = np.arange(len(present))
    counts = np.bincount(owners.astype(np.int64) * len(present) + column[grams], minlength=len(texts) * len(present))
    counts = counts.reshape(len(texts), len(present)).astype(np.float32)
    first, second, third = present // SYMBOLS**2, present // SYMBOLS % SYMBOLS, present % SYMBOLS
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    for at in range(0, len(present), 4096):
        part = slice(at, at + 4096)
        out += counts[:, part] @ (twice[first[part]] * once[second[part]] * letters[third[part]])
    return out


def _groups(batches, rows: int = 96, column: str = "text"):
    for batch, texts in text_groups(batches, column, 1 << 20):
        for at in range(0, len(texts), rows):
            yield batch.slice(at, rows), [t.decode("utf-8", "surrogatepass") for t in texts[at : at + rows]]


def prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Language to prototype, from all rows of docs(text, lang) with a language.

    Every text counts alike (its vector is scaled to length one). Tasks send one partial sum a
    language, and those are added before they reach the driver, which gets languages x dim numbers.
    """

    def run(batches):
        letters, sums = letter_vectors(dim), {}
        for batch, texts in _groups(batches):
            vectors = bundle(texts, letters)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
            for lang in set(langs := batch.column("lang").to_pylist()):
                own = [i for i, x in enumerate(langs) if x == lang]
                sums[lang] = sums.get(lang, 0) + vectors[own].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    partial = docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    # Rounded before they are added, so that the sum doesn't depend on the order of the tasks.
    cells = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    whole = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: np.array([c["x"] for c in r["v"]], np.float64) / 1e6 for r in whole.orderBy("lang").collect()}


class Scorer:
    """Cosines of texts with a model's prototypes, both centred on the prototypes' mean."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.langs, self.letters = sorted(model), None
        dim = len(next(iter(model.values()))) if model else DIM
        unit = np.stack([model[x] / max(np.linalg.norm(model[x]), 1e-12) for x in self.langs]) if model else np.zeros((0, dim))
        self.centre = (unit.mean(axis=0) if len(unit) > 1 else np.zeros(dim)).astype(np.float32)
        unit = unit - self.centre
        self.unit = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; 'und' and 0 without a letter or without a model."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.letters is None:
            self.letters = letter_vectors(len(self.centre))
        vectors = bundle(texts, self.letters)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        centred = vectors / np.maximum(norm, 1e-12) - self.centre
        cos = centred @ self.unit.T / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        best, known = cos.argmax(axis=1), norm[:, 0] > 0
        score = np.where(known, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], score


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs' doc_id (and held_out, if there) with lang_pred and score, from text alone.

    score: the cosine with the best prototype, both centred, cut to 0..1. A null text, one
    without a letter, or an empty model gives 'und' and 0. Ties go to the first language by name.
    """
    scorer = Scorer(model)
    carried = [c for c in ("doc_id", "held_out") if c in docs.columns]

    def run(batches):
        for batch, texts in _groups(batches):
            pred, score = scorer(texts)
            columns = [batch.column(c) for c in carried] + [pa.array(pred, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "lang_pred", "score"])

    kinds = {"doc_id": "doc_id long", "held_out": "held_out boolean"}
    return docs.select(*carried, "text").mapInArrow(run, ", ".join([*(kinds[c] for c in carried), "lang_pred string", "score double"]))


def _split(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang, ...).

    Documents whose crc32(doc_id as text) mod 4 is 2 are held out: they are predicted but never
    learned from. Null ids count as the empty text there; rows with a null lang teach nothing;
    repeated rows are learned and returned each time; no rows give no rows.
    """
    split = _split(docs)
    return predict(split.drop("lang"), prototypes(split.where("not held_out")))


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs without the rows that are in no language; where lang is null, the predicted one takes its place.

    A text without a letter is in none, and one whose score isn't over least: 0 is a text that is
    no closer to its best language than to the mean of all. The model is learned as in identify();
    where no row teaches one, every text with a letter stays, and a null lang stays null. All
    other values and columns of the rows kept stay as they are, whatever their names.
    """
    model = prototypes(_split(docs).where("not held_out"))
    scorer = Scorer(model or {UNKNOWN: np.ones(DIM)})
    names, text, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(f"c{lang}", F.col(f"c{lang}").cast("string"))

    def run(batches):
        for batch, texts in _groups(batches, column=f"c{text}"):
            pred, score = scorer(texts)
            if model:
                known = pc.if_else(pc.is_null(batch.column(lang)), pa.array(pred, pa.string()), batch.column(lang))
                batch = batch.set_column(lang, batch.schema.field(lang), known)
                keep = [p != UNKNOWN and s > least for p, s in zip(pred, score)]
            else:
                keep = [bool((symbols(t) != 0).any()) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    back = [F.col(f"c{i}").cast(docs.schema[n].dataType).alias(n) if i == lang else F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return numbered.mapInArrow(run, numbered.schema).select(*back)
