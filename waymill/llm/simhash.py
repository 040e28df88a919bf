"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every document's fingerprint is the bitwise majority of its shingles' 64-bit hashes. Two
fingerprints within three bits meet in the middle: one of them has a variant at one flipped
bit that is a variant of the other at two. A distance of exactly three joins fingerprints of
unequal bit parity, and two of its three bits lie in the same 32-bit half; so fingerprints of
odd parity emit their variants of up to one bit, those of even parity also the two-bit
variants within a half. The variants are shuffled by a prefix of balanced bits: all variants of
a fingerprint that share a prefix travel as one row and are spelled out where they meet. A
variant's group is verified and deduplicated there and leaves as a star, so a group of n
colliding fingerprints costs n links and never n * n.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, star_forest, text_groups
from .components import connected_components

BITS, HALF, RADIUS = 64, 32, 3
#: Variants that one task spells out at a time; larger buckets are cut by further bits.
VARIANTS_AT_ONCE = 1 << 21
SMALL_ROWS = 500_000  # keys of dropped rows that may be broadcast; more are shuffled

_NEAR = [0] + [1 << i for i in range(BITS)]
_FAR = [(1 << i) | (1 << j) for lo in (0, HALF) for i, j in combinations(range(lo, lo + HALF), 2)]


def shingle_hashes(data: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of width words; the whole sequence if shorter, none without words."""
    words = data.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops)), np.uint64, len(starts))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: bit set in over half of them; empty: zero.

    Bits are counted in byte lanes of 64-bit words, at most 255 hashes to a lane.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, n = np.concatenate([hashes[i] for i in full]), sizes[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    blocks = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    lane, fp = np.uint64(0x0101010101010101), np.zeros(len(full), np.uint64)
    for k in range(8):
        counts = np.add.reduceat((flat >> np.uint64(k)) & lane, at)
        counts = np.add.reduceat(counts.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            fp |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of docs, fp the fingerprint's bits as a signed long; its digest too, if there."""
    carried = [c for c in docs.columns if c == "digest"]

    def run(batches):
        for batch, texts in text_groups(batches):
            fps = majority([shingle_hashes(t, width, seed) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), *map(batch.column, carried)], ["doc_id", "fp", *carried])

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} binary" for c in carried)]))


def _masks(even: bool) -> tuple[np.ndarray, int]:
    """Flip masks of a fingerprint of this parity, and how many at the front flip at most a bit."""
    return np.array(_NEAR + (_FAR if even else []), np.uint64), len(_NEAR)


def _bucket_links(fps: np.ndarray, bits: list[int], key: int, spare: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Verified star links among the variants of fps whose bits at `bits` spell key."""
    chosen = np.uint64(sum(1 << b for b in bits))
    want = np.uint64(sum(1 << b for i, b in enumerate(bits) if key >> i & 1))
    flips = (fps ^ want) & chosen
    even = (np.bitwise_count(fps) & 1) == 0
    parts = []
    for parity in (False, True):
        masks, near = _masks(parity)
        own = np.flatnonzero(even == parity)
        if not len(own):
            continue
        needed, which = np.unique(flips[own], return_inverse=True)
        for i, need in enumerate(needed):
            fit = np.flatnonzero((masks & chosen) == need)
            if len(fit):
                parts.append((own[which == i], masks[fit], fit < near))
    total = sum(len(x) * len(m) for x, m, _ in parts)
    if total > VARIANTS_AT_ONCE and spare:
        reach = np.unique(np.concatenate([x for x, _, _ in parts]))
        found = [_bucket_links(fps[reach], [*bits, spare[0]], key | side << len(bits), spare[1:]) for side in (0, 1)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    variant = np.concatenate([(fps[x][:, None] ^ m).ravel() for x, m, _ in parts])
    member = np.concatenate([np.repeat(x, len(m)) for x, m, _ in parts])
    close = np.concatenate([np.tile(c, len(x)) for x, _, c in parts])
    order = np.argsort(variant)
    variant, member, close = variant[order], member[order], close[order]
    start = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    size = np.diff(np.append(start, len(variant)))
    keep = np.repeat(size > 1, size)
    if not keep.any():
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    member, close, group = member[keep], close[keep], np.repeat(np.arange(len(size)), size)[keep]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    # A member that flips at most one bit is within three bits of every other member of its group.
    centre = np.maximum.reduceat(np.where(close, member, -1), start)
    centre = np.repeat(centre, size)
    linked = (centre >= 0) & (centre != member)
    a, b = fps[centre[linked]], fps[member[linked]]
    good = np.bitwise_count(a ^ b) <= RADIUS
    node, root = star_forest(a[good].view(np.int64), b[good].view(np.int64))
    return node.view(np.uint64), root.view(np.uint64)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps(fp) within three bits."""
    one = fps.agg(F.count("*").alias("n"), *[F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(str(i)) for i in range(BITS)]).first()
    n = one["n"]
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    balanced = sorted(range(BITS), key=lambda i: (abs(2 * (one[str(i)] or 0) - n), i))
    width = max(4, min(24, int(np.ceil(np.log2(n * (len(_FAR) / 2 + len(_NEAR)) / VARIANTS_AT_ONCE + 1)))))
    bits, spare = balanced[:width], balanced[width:]
    even = F.bit_count("fp") % 2 == 0
    key = sum((F.shiftright("fp", b).bitwiseAND(F.lit(1)) * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    near = F.array(F.lit(0), *[F.lit(1 << i) for i in range(width)])
    far = [1 << i | 1 << j for i, j in combinations(range(width), 2) if bits[i] // HALF == bits[j] // HALF]
    flips = F.when(even, F.concat(near, F.array(*map(F.lit, far)))).otherwise(near) if far else near

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _bucket_links(pdf["fp"].to_numpy().view(np.uint64), bits, int(pdf["bucket"].iloc[0]), spare)
        return pd.DataFrame({"a": found[0].view(np.int64), "b": found[1].view(np.int64)})

    sent = fps.select("fp", key.cast("int").alias("k"), F.explode(flips).alias("flip")).select("fp", F.col("k").bitwiseXOR(F.col("flip")).alias("bucket"))
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, least, root) of every fingerprint in prints(doc_id, fp): its smallest doc_id and its component."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), narrow=True)
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text, ...).

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reached over
    links of three bits or fewer, its own included. A null text has no words, and so the
    fingerprint zero, as has an empty one; both are linked like any other. Repeated rows
    come back repeated; a null doc_id takes the smallest id of its component, null if there
    is none. Other columns are not read. No rows give no rows.
    """
    prints = checkpointed(fingerprints(docs.select("doc_id", "text"), width, seed), narrow=True)
    rooted = _rooted(prints)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_digest(docs: DataFrame) -> Column:
    """SHA-256 of a row's text; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each group in rows(doc_id, digest, group), which names every row of docs.

    That of the smallest doc_id stays, null being larger than all others, and of these the one
    with the smallest digest; rows alike in doc_id and text are one row. Groups of more rows than
    one, and the dropped rows' keys, are broadcast while they are few; docs itself is shuffled only
    where they aren't, or, of it, the rows that have others alike.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    crowds = rows.groupBy("group").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("group").alias("of"), "first")
    crowds = small(checkpointed(crowds, narrow=True), SMALL_ROWS)
    members = rows.join(crowds, F.col("group") == F.col("of")).groupBy("doc_id", "digest", (first == F.col("first")).alias("stays")).count()
    members = checkpointed(members.select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"), "stays", "count"), narrow=True)
    named = lambda df, keys: df["doc_id"].cast("long").eqNullSafe(keys["own_id"]) & (text_digest(df) == keys["own_digest"])
    gone = small(members.where("not stays").select("own_id", "own_digest"), SMALL_ROWS)
    rest = docs.join(gone, named(docs, gone), "left_anti")
    twice = members.where("stays and count > 1").select("own_id", "own_digest")
    if twice.isEmpty():
        return rest
    twice, name = small(twice, SMALL_ROWS), "digest"
    while name in docs.columns:
        name += "_"
    alike = rest.join(twice, named(rest, twice), "left_semi")
    return rest.join(twice, named(rest, twice), "left_anti").unionByName(alike.withColumn(name, text_digest(alike)).dropDuplicates(["doc_id", name]).drop(name))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id.

    Rows without a doc_id stay, one of each group, where no row of their group has one. Rows of
    other groups don't matter, whatever their doc_ids.
    """
    prints = checkpointed(fingerprints(docs.select("doc_id", "text", text_digest(docs).alias("digest"))), narrow=True)
    return one_of_each(docs, prints.join(_rooted(prints).select("fp", F.col("root").alias("group")), "fp"))
