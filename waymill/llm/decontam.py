"""Benchmark decontamination over a distributed positional inverted index, DataFrames only.

The index stores a posting (term, document, position) for every occurrence of a benchmark term
in the training documents. A benchmark window of 13 words can only occur where its rarest term
does, so its posting list, adjusted by the term's offset, gives the candidate alignments; the
offset-adjusted lists of the next rarest terms are intersected with them, then those of all
other words of the item, and runs of at least 13 words are the exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, written

WINDOW = 13
LISTS = 3  # posting lists intersected, from the rarest, before whole items are compared
SMALL_ROWS = 500_000  # a side of at most so many narrow rows is broadcast, a larger one shuffled
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # what stands between words, before A-Z are lower-cased
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["id", "th"]


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, th, text): id and th key a row by its id and text, nulls included."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def word_rows(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, word) of every word of table's text, lower-cased; pos counts words from 0."""
    # Apart from the explode, or it would be worked out again for every word.
    led = table.select(*keys, "text", F.left("text", F.lit(1)).rlike(SEPARATOR).cast("int").alias("lead"))
    parts = led.select(*keys, "lead", F.posexplode(F.split("text", f"{SEPARATOR}+")).alias("at", "raw"))
    return parts.where("raw <> ''").select(*keys, (F.col("at") - F.col("lead")).alias("pos"), lower_ascii(F.col("raw")).alias("word"))


def n_words(text: Column) -> Column:
    """The words of a text that is not null; empty parts stand before a first and after a last separator."""
    edges = F.left(text, F.lit(1)).rlike(SEPARATOR).cast("int") + F.right(text, F.lit(1)).rlike(SEPARATOR).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{SEPARATOR}+")) - edges).cast("long")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number of their own in the column name, the same on every later read."""
    return checkpointed(rows.withColumn(name, F.monotonically_increasing_id()), narrow=True)


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, pos, word) of every word of benchmark(item_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = numbered(benchmark.select(F.col("item_id").cast("string").alias("item_id"), text.alias("text")).distinct(), "item")
    items = items.select("*", n_words(F.col("text")).cast("int").alias("n"))
    return word_rows(items, "item", "item_id", "n")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written postings (term, id, th, pos) of docs(doc_id, text) for terms(word, term)."""
    tokens = word_rows(keyed(docs), *DOC)
    return written(tokens.join(small(terms, SMALL_ROWS), "word").select("term", *DOC, "pos"))


class Index:
    """A positional index of docs for the words of benchmark, with the corpus count of each term."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        words = item_words(benchmark)
        terms = numbered(words.select("word").distinct(), "term")
        self.postings = build_index(docs, terms)
        counts = self.postings.groupBy("term").agg(F.count("*").alias("count"))
        self.items = checkpointed(words.join(terms, "word").join(counts, "term", "left").select("item", "item_id", "n", "pos", "term", F.coalesce("count", F.lit(0)).alias("count")), narrow=True)

    def windows(self, width: int) -> DataFrame:
        """(item, t0, p0, t1, p1, ...): the rarest terms of each window and their places in the item."""
        start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - width + 1), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - width))))
        rare = self.items.select("item", "pos", "term", "count", start.alias("j")).groupBy("item", "j").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "pos", "term"))), 1, LISTS).alias("r"))
        # A window of fewer words repeats its last one.
        at = lambda k: F.coalesce(F.get("r", F.lit(k)), F.element_at("r", -1))
        return rare.select("item", *[c for k in range(LISTS) for c in (at(k)["term"].alias(f"t{k}"), at(k)["pos"].alias(f"p{k}"))]).distinct()

    def alignments(self, width: int) -> DataFrame:
        """(id, th, item, delta): where LISTS rarest terms of a window of item stand as in item."""
        rarest = checkpointed(self.windows(width), narrow=True)
        found = self.postings.withColumnRenamed("term", "t0").join(small(rarest, SMALL_ROWS), "t0").withColumn("delta", F.col("pos") - F.col("p0")).drop("pos", "t0", "p0")
        for k in range(1, LISTS):
            wanted = rarest.select(F.col(f"t{k}").alias("term")).distinct()
            lists = self.postings.join(small(wanted, SMALL_ROWS), "term", "left_semi").withColumnRenamed("term", f"t{k}")
            found = found.withColumn("pos", F.col("delta") + F.col(f"p{k}")).join(lists, [*DOC, "pos", f"t{k}"]).drop("pos", f"t{k}", f"p{k}")
        return checkpointed(found.select(*DOC, "item", "delta").distinct(), narrow=True)

    def phrases(self, width: int = WINDOW) -> DataFrame:
        """(id, th, item, item_id, start, length): the maximal exact matches that hold a whole window.

        A window is width consecutive words of an item, or all of a shorter one. start is the
        first word in the document.
        """
        found = self.alignments(width)
        near = self.postings.join(small(found.select(*DOC).distinct(), SMALL_ROWS), DOC, "left_semi")
        words = found.join(small(self.items.drop("count"), SMALL_ROWS), "item").withColumn("pos", F.col("delta") + F.col("pos"))
        same = words.join(near, [*DOC, "pos", "term"]).select(*DOC, "item", "item_id", "n", "delta", "pos")
        line = Window.partitionBy(*DOC, "item", "delta").orderBy("pos")
        runs = same.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy(*DOC, "item", "delta", "run").agg(
            F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.min("pos").alias("start"), F.count("*").cast("int").alias("length")
        )
        return runs.where(F.col("length") >= F.least(F.lit(width), F.col("n"))).select(*DOC, "item", "item_id", "start", "length")

    def proximity(self, terms: int = 4, span: int = 30) -> DataFrame:
        """(id, th, item, item_id, start): the `terms` rarest words of an item, all within span words
        of the rarest one's place start, in any order. Items of fewer distinct words use them all."""
        order = Window.partitionBy("item").orderBy("count", "term")
        rare = self.items.groupBy("item", "item_id", "term", "count").agg(F.min("pos").alias("pos")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= terms)
        rare = checkpointed(rare.withColumn("wanted", F.count("*").over(Window.partitionBy("item"))).select("item", "item_id", "term", "k", "wanted"), narrow=True)
        lists = self.postings.join(small(rare.select("term").distinct(), SMALL_ROWS), "term", "left_semi")
        cell = F.floor(F.col("pos") / span)
        first = lists.join(small(rare.where("k = 1").drop("k"), SMALL_ROWS), "term").select(*DOC, "item", "item_id", "wanted", F.col("pos").alias("start"), cell.alias("cell"))
        others = first.join(small(rare.where("k > 1").select("item", "term"), SMALL_ROWS), "item").withColumn("cell", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])))
        close = others.join(lists.withColumn("cell", cell), [*DOC, "term", "cell"]).where(F.abs(F.col("pos") - F.col("start")) <= span)
        whole = close.groupBy(*DOC, "item", "item_id", "wanted", "start").agg(F.count_distinct("term").alias("got")).where("got = wanted - 1").drop("got", "wanted")
        return whole.unionByName(first.where("wanted = 1").drop("wanted", "cell"))


def hit_words(matches: DataFrame) -> DataFrame:
    """(id, th, n_hit): how many words of a document any of its matches covers."""
    places = matches.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
    return places.distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A null text has no words; a null or wordless item has no window; items with a null id
    hit words but aren't counted; repeated rows each come back with the same figures, and
    repeated items count once. No documents give no rows; no items hit nothing. Other columns
    are not read.
    """
    matches = checkpointed(Index(docs, benchmark).phrases(width), narrow=True)
    hit = hit_words(matches)
    items = matches.groupBy(*DOC).agg(F.collect_set("item_id").alias("items"))
    found = hit.join(items, DOC)
    rows = keyed(docs).select("doc_id", *DOC, n_words(F.col("text")).alias("n_words")).join(small(checkpointed(found, narrow=True), SMALL_ROWS), DOC, "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows, as contamination() judges them; columns as they are."""
    hit = hit_words(checkpointed(Index(docs, benchmark).phrases(), narrow=True))
    judged = keyed(docs).select(*DOC, n_words(F.col("text")).alias("n_words")).join(small(checkpointed(hit, narrow=True), SMALL_ROWS), DOC).where("20 * n_hit >= n_words")
    bad = small(checkpointed(judged.select(F.col("id").alias("bad_id"), F.col("th").alias("bad_th")).distinct(), narrow=True), SMALL_ROWS)
    text, doc_id = F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    return docs.join(bad, (doc_id == bad["bad_id"]) & (F.xxhash64(text) == bad["bad_th"]), "left_anti")
