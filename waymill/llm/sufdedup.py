"""Exact substring dedup across documents by blockwise suffix sorting.

Every width-byte string is judged by the smallest document that it starts in. Sorting all
suffixes of a corpus at once needs its whole text in one place, so strings are first dealt to
buckets by their anchor: the smallest of the hashed 16-byte strings in them, which depends on
their bytes alone, so equal strings meet. Anchors of one document only can't repeat and are
left out; around the others, each bucket sorts the suffixes of its distinct segments with
suffix.sorted_suffixes(). Texts travel once, keyed by a group of documents, and all else as
packed arrays. A group tells a bucket each anchor and each distinct segment once, with the
smallest and the largest id that has it there, and is told the smallest id of all for the
segment's windows; so the inside of a passage that many documents share costs a few numbers a
group, however often it occurs; the segments at its two ends reach into what differs. Exact copies are found by digest first: only the smallest copy is searched, so
a group of copies costs a narrow row for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small
from .suffix import equal_windows

WIDTH = 50
GRAM = 16
GROUP_BYTES = 4 << 20  # text in a group of documents, on average
BUCKET_BYTES = 8 << 20  # text whose anchors share a bucket, on average
CHUNK = 1 << 19
SMALL_ROWS = 500_000  # digests of copied texts that may be broadcast; more are shuffled
NO_ID = (1 << 63) - 1

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place of text that has as many after it."""
    n = len(text) - GRAM + 1
    keys = np.empty(len(text) - 7, np.uint64)
    for o in range(8):
        count = len(keys[o::8])
        keys[o::8] = np.frombuffer(text[o : o + 8 * count].tobytes(), np.uint64)
    h = keys[:n] * _M1
    h += (keys[8 : n + 8] ^ (h >> np.uint64(31))) * _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def _anchors(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's hash) of the runs of width-byte windows with one anchor."""
    windows = len(text) - width + 1
    h = _gram_hashes(text)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, reach = 1, width - GRAM + 1
    while span < reach:
        step = min(span, reach - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    place = (low[:windows] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    h = h[place[first]]
    # Anchors are small hashes: mixed again, they spread over all buckets.
    h = (h ^ (h >> np.uint64(31))) * _M2
    return first, np.diff(np.append(first, windows)), h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], width: int = WIDTH):
    """(text, first window, windows, anchor's hash) arrays over texts; an anchor's windows may come in two runs."""
    out = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[at:end]])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        whole = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        for lo in range(0, max(1, len(whole) - width + 1), CHUNK):
            part = whole[lo : lo + CHUNK + width - 1]
            if len(part) < width:
                continue
            first, count, h = _anchors(part, width)
            first = first + lo
            # Cut the runs at the texts' ends: a text's windows end width - 1 before it does.
            doc = np.searchsorted(starts, first, side="right") - 1
            last = np.searchsorted(starts, first + count - 1, side="right") - 1
            more = last - doc
            owner = np.repeat(np.arange(len(first)), more + 1)
            k = doc[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            begin = np.maximum(first[owner], starts[k])
            stop = np.minimum(first[owner] + count[owner], starts[k + 1] - width + 1)
            good = stop > begin
            k, begin, stop = k[good], begin[good], stop[good]
            out.append((k + at, begin - starts[k], stop - begin, h[owner[good]]))
        at = end
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out))


class _Group:
    """The distinct (id, text) of a group of documents, in one order whatever order they came in."""

    def __init__(self, table: pa.Table):
        ids = [NO_ID if i is None else i for i in table.column("c_id").to_pylist()]
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table.column("c_text").to_pylist()]
        rows = sorted(set(zip(ids, texts)))
        slot = {r: i for i, r in enumerate(rows)}
        self.slots = [slot[r] for r in zip(ids, texts)]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]

    def copied(self, copies: pa.Table, width: int) -> np.ndarray:
        """Whether each slot of width bytes or more is one of copies(id, digest): the same id and the same text."""
        out = np.zeros(len(self.ids), bool)
        if not copies.num_rows:
            return out
        wanted = set(zip(copies.column("id").to_pylist(), copies.column("digest").to_pylist()))
        maybe = np.isin(self.ids, np.array([i for i, _ in wanted if i is not None], np.int64))
        for i in np.flatnonzero(maybe):
            if len(self.texts[i]) >= width:
                out[i] = (int(self.ids[i]), hashlib.sha256(self.texts[i]).digest()) in wanted
        return out


def _pack(a: np.ndarray, kind=np.uint32) -> bytes:
    """Numbers as compressed bytes: by their differences, which are small where they are in order."""
    return zstandard.compress(np.diff(np.asarray(a, np.int64), prepend=0).astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind=np.uint32) -> np.ndarray:
    if kind is np.int64:
        return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int32).astype(np.int64))


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _least_ids(table: pa.Table, width: int) -> pa.Table:
    """What one bucket's segments tell: the smallest id of each of their windows, by group of documents."""
    seen: dict[bytes, int] = {}
    rows, parts = [], []
    for row in _rows(table):
        ends = np.cumsum(_unpack(row["lengths"])).tolist()
        text = zstandard.decompress(row["text"])
        known = np.array([seen.setdefault(text[s:e], len(seen)) for s, e in zip([0, *ends], ends)], np.int64)
        parts.append((known, _unpack(row["least"], np.int64)))
        rows.append((row["group"], known, _hashes(row["hashes"]), _hashes(row["digests"]), _unpack(row["most"], np.int64)))
    segment, ids = (np.concatenate(c) for c in zip(*parts))
    least = np.full(len(seen), NO_ID, np.int64)
    np.minimum.at(least, segment, ids)
    lengths = np.fromiter(map(len, seen), np.int64, len(seen))
    begin = np.cumsum(lengths) - lengths
    windows = lengths - width + 1
    offset = np.cumsum(windows) - windows
    places = np.repeat(begin - offset, windows) + np.arange(windows.sum())
    of = np.repeat(np.arange(len(seen)), windows)
    classes = equal_windows(np.frombuffer(b"".join(seen), np.uint8), places, width)
    best = np.full(int(classes.max(initial=0)) + 1, NO_ID, np.int64)
    np.minimum.at(best, classes, least[of])
    best = best[classes]  # by window of the distinct segments
    lowest = np.minimum.reduceat(best, offset)
    edge = np.ones(len(best), bool)
    edge[1:] = (best[1:] != best[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(edge)  # windows of one smallest id
    runs = np.bincount(of[run], minlength=len(seen))
    first = np.cumsum(runs) - runs
    out = {"group": [], "hashes": [], "digests": [], "runs": [], "starts": [], "least": []}
    for group, known, hashes, digests, most in rows:
        use = np.flatnonzero(lowest[known] < most)
        if len(use):
            own = known[use]
            at = run[np.repeat(first[own] - (np.cumsum(runs[own]) - runs[own]), runs[own]) + np.arange(runs[own].sum())]
            out["group"].append(group)
            out["hashes"].append(hashes[use].tobytes())
            out["digests"].append(digests[use].tobytes())
            out["runs"].append(_pack(runs[own]))
            out["starts"].append(_pack(at - offset[of[at]]))
            out["least"].append(_pack(best[at], np.int64))
    return _typed(out, TOLD)


def _spans(group: _Group, told: list[dict], width: int, skip: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The byte ranges to remove from each slot of group, by what the buckets told."""
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for row in told:
        runs, starts, least = _unpack(row["runs"]), _unpack(row["starts"]), _unpack(row["least"], np.int64)
        ends = np.cumsum(runs).tolist()
        for h, d, s, e in zip(_hashes(row["hashes"]).tolist(), _hashes(row["digests"]).tolist(), [0, *ends], ends):
            known[h, d] = starts[s:e], least[s:e]
    found: dict[int, list[tuple[int, int]]] = {}
    if not known:
        return found
    wanted = np.unique(np.array([h for h, _ in known], np.uint64))
    use = np.flatnonzero(~skip)
    slot, start, count, h = anchors([group.texts[i] for i in use], width)
    keep = np.isin(h, wanted)
    for i, a, n, key in zip(use[slot[keep]].tolist(), start[keep].tolist(), count[keep].tolist(), h[keep].tolist()):
        told_of = known.get((key, _digest(group.texts[i][a : a + n + width - 1])))
        if told_of is None:
            continue
        starts, least = told_of
        for s, e, low in zip(starts.tolist(), [*starts[1:].tolist(), n], least.tolist()):
            if low < group.ids[i]:
                found.setdefault(i, []).append((a + s, a + e - 1 + width))
    for i, spans in found.items():
        spans.sort()
        whole = [spans[0]]
        for s, e in spans[1:]:
            if s > whole[-1][1]:
                whole.append((s, e))
            elif e > whole[-1][1]:
                whole[-1] = whole[-1][0], e
        found[i] = whole
    return found


def _digest(segment: bytes) -> int:
    return xxhash.xxh3_64_intdigest(segment)


class SubstringDedup:
    """The dedup's stages over docs; `told` is what they find, `cut` applies a function to it."""

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        if width < GRAM + 8:
            raise ValueError(f"width must be {GRAM + 8} or more")
        self.width, self.columns = width, docs.columns
        text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("long")
        size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
        self.groups, self.buckets = max(8, -(-size // GROUP_BYTES)), max(8, -(-size // BUCKET_BYTES))
        group = F.pmod(F.xxhash64(doc_id, text), F.lit(self.groups)).cast("int")
        # One exchange of the texts, shared by every stage.
        self.base = docs.select(group.alias("group"), doc_id.alias("c_id"), text.alias("c_text"), *[docs[c].alias(f"d{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])
        key = docs.select(group.alias("group"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")).where("digest is not null")
        least = key.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
        self.copies = key.join(small(checkpointed(least, narrow=True), SMALL_ROWS), "digest").where("id > least").select("group", "id", "digest").distinct()

    def _sent_anchors(self) -> DataFrame:
        width, buckets = self.width, self.buckets

        def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
            group = _Group(docs)
            kept = np.flatnonzero(~group.copied(copies, width))
            slot, start, _, h = anchors([group.texts[i] for i in kept], width)
            slot = kept[slot] if len(slot) else slot
            bucket = _bucket_of(h, buckets)
            order = np.lexsort((group.ids[slot], h, bucket))
            ids, h, bucket = group.ids[slot[order]], h[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            low, high = ids[first], ids[np.append(first[1:], len(h)) - 1] if len(h) else ids
            h, bucket = h[first], bucket[first]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.empty(0, np.int64)
            rows = {"bucket": [], "group": [], "hashes": [], "least": [], "most": []}
            number = docs.column("group")[0].as_py() if docs.num_rows else 0
            for s, e in zip(cut, np.append(cut[1:], len(h))):
                rows["bucket"].append(int(bucket[s]))
                rows["group"].append(number)
                rows["hashes"].append(_pack(h[s:e].view(np.int64), np.int64))
                rows["least"].append(_pack(low[s:e], np.int64))
                rows["most"].append(_pack(high[s:e] - low[s:e], np.int64))
            return _typed(rows, SENT)

        return self._cogroup(self.copies, run, SENT)

    def _cogroup(self, other: DataFrame, run, schema: str) -> DataFrame:
        return self.base.groupBy("group").cogroup(other.groupBy("group")).applyInArrow(run, schema)

    def _repeated(self) -> DataFrame:
        """(group, hashes): the anchors that more than one document has."""

        def run(sent: pa.Table) -> pa.Table:
            parts = []
            for row in _rows(sent):
                low = _unpack(row["least"], np.int64)
                parts.append((_unpack(row["hashes"], np.int64).view(np.uint64), low, low + _unpack(row["most"], np.int64), np.full(len(low), row["group"], np.int32)))
            h, low, high, group = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
            shared = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
            found = order[np.repeat(shared, np.diff(np.append(first, len(h))))]
            found = found[np.lexsort((h[found], group[found]))]
            cut = np.flatnonzero(np.concatenate([[True], group[found[1:]] != group[found[:-1]]])) if len(found) else np.empty(0, np.int64)
            rows = {"group": [], "hashes": []}
            for s, e in zip(cut, np.append(cut[1:], len(found))):
                rows["group"].append(int(group[found[s]]))
                rows["hashes"].append(_pack(h[found[s:e]].view(np.int64), np.int64))
            return _typed(rows, REPEATED)

        return self._sent_anchors().groupBy("bucket").applyInArrow(run, REPEATED)

    def _segments(self) -> DataFrame:
        """The distinct texts under those anchors' runs in a group, dealt out by anchor, with the ids that have them."""
        width, buckets = self.width, self.buckets

        def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
            rows = {k: [] for k in ("bucket", "group", "hashes", "digests", "least", "most", "lengths", "text")}
            told = [r["hashes"] for r in _rows(notes) if r["hashes"] is not None]
            if docs.num_rows and told:
                group = _Group(docs)
                wanted = np.unique(np.concatenate([_unpack(x, np.int64) for x in told]).view(np.uint64))
                use = np.flatnonzero(~group.copied(notes, width))
                slot, start, count, h = anchors([group.texts[i] for i in use], width)
                keep = np.flatnonzero(np.isin(h, wanted))
                keep = keep[np.lexsort((h[keep], _bucket_of(h[keep], buckets)))]
                slot, start, count, h = use[slot[keep]], start[keep], count[keep], h[keep]
                bucket = _bucket_of(h, buckets)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(slot) else []
                for s, e in zip(cut, np.append(cut[1:], len(slot))):
                    seen: dict[tuple[int, bytes], int] = {}
                    segment = [
                        seen.setdefault((k, group.texts[d][a : a + n + width - 1]), len(seen))
                        for d, a, n, k in zip(slot[s:e].tolist(), start[s:e].tolist(), count[s:e].tolist(), h[s:e].tolist())
                    ]
                    least, most = np.full(len(seen), NO_ID, np.int64), np.full(len(seen), -NO_ID - 1, np.int64)
                    np.minimum.at(least, segment, group.ids[slot[s:e]])
                    np.maximum.at(most, segment, group.ids[slot[s:e]])
                    rows["bucket"].append(int(bucket[s]))
                    rows["group"].append(docs.column("group")[0].as_py())
                    rows["hashes"].append(np.array([k for k, _ in seen], np.uint64).tobytes())
                    rows["digests"].append(np.array([_digest(t) for _, t in seen], np.uint64).tobytes())
                    rows["least"].append(_pack(least, np.int64))
                    rows["most"].append(_pack(most, np.int64))
                    rows["lengths"].append(_pack([len(t) for _, t in seen]))
                    rows["text"].append(zstandard.compress(b"".join(t for _, t in seen), 1))
            return _typed(rows, SEGMENTS)

        return self._cogroup(self._with_copies(self._repeated()), run, SEGMENTS)

    def _with_copies(self, notes: DataFrame) -> DataFrame:
        """notes by group, and behind them the group's copies(id, digest)."""
        own = [c for c in notes.columns if c != "group"]
        copies = self.copies.select("group", *[F.lit(None).cast("binary").alias(c) for c in own], "id", "digest")
        return notes.select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest")).unionByName(copies)

    def told(self) -> DataFrame:
        """TOLD: for the segments of a group, the smallest ids that have their windows, as runs."""
        width = self.width
        return self._segments().groupBy("bucket").applyInArrow(lambda table: _least_ids(table, width), TOLD)

    def cut(self, emit, schema: str) -> DataFrame:
        """emit(table of documents, [(bytes, [(start, stop), ...]) of each row]) over the groups of documents."""
        width = self.width
        notes = self._with_copies(self.told())

        def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
            group = _Group(docs)
            copied = group.copied(notes, width)
            found = _spans(group, [r for r in _rows(notes) if r["hashes"] is not None], width, copied)
            for i in np.flatnonzero(copied).tolist():
                found[i] = [(0, len(group.texts[i]))]
            return emit(docs, [(group.texts[i], found.get(i, [])) for i in group.slots])

        return self._cogroup(notes, run, schema)


SENT = "bucket int, group int, hashes binary, least binary, most binary"
REPEATED = "group int, hashes binary"
SEGMENTS = "bucket int, group int, hashes binary, digests binary, least binary, most binary, lengths binary, text binary"
TOLD = "group int, hashes binary, digests binary, runs binary, starts binary, least binary"


def _typed(rows: dict[str, list], schema: str) -> pa.Table:
    kinds = dict(c.split() for c in schema.split(", "))
    return pa.table({c: pa.array(v, pa.int32() if kinds[c] == "int" else pa.binary()) for c, v in rows.items()})


def _rows(table: pa.Table):
    return table.to_pylist()


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, stop in spans:
        out.append(text[at:start])
        at = stop
    return b"".join([*out, text[at:]])


def removed_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs(doc_id, text).

    A byte goes if a width-byte string that covers it also starts in a document with a smaller
    doc_id. A null text is empty; a null doc_id is larger than all others; rows with one doc_id
    never remove each other's bytes, so repeated rows fare alike; no rows give no rows. Other
    columns are not read.
    """

    def emit(table: pa.Table, rows) -> pa.Table:
        columns = [
            table.column("c_id").cast(pa.int64()),
            pa.array([len(t) for t, _ in rows], pa.int64()),
            pa.array([sum(e - s for s, e in spans) for _, spans in rows], pa.int64()),
            pa.array([len(spans) for _, spans in rows], pa.int64()),
            pa.array([hashlib.sha256(_kept(t, spans)).hexdigest() for t, spans in rows], pa.string()),
            pa.array([[{"start": s, "stop": e} for s, e in spans] for _, spans in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    narrow = docs.select("doc_id", "text")
    return SubstringDedup(narrow, width).cut(emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the bytes of removed_spans() cut out of text, and n_chars, if there, the new length.

    A character cut in two goes whole. All rows and columns stay; a null text stays null.
    """
    names = docs.columns
    others = [i for i, c in enumerate(names) if c not in ("doc_id", "text")]

    def emit(table: pa.Table, rows) -> pa.Table:
        nulls = table.column("c_text").is_null().to_pylist()
        texts = [None if null else _kept(t, spans).decode("utf-8", "ignore") for (t, spans), null in zip(rows, nulls)]
        sizes = [None if t is None else len(t) for t in texts]
        columns = [table.column("c_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), *(table.column(f"d{i}") for i in others)]
        return pa.table(columns, names=["c_id", "c_text", "size", *(f"d{i}" for i in others)])

    work = SubstringDedup(docs, width)
    kinds = dict(work.base.dtypes)
    schema = ", ".join([f"c_id {kinds['c_id']}", "c_text string", "size long", *(f"d{i} {kinds[f'd{i}']}" for i in others)])
    done = work.cut(emit, schema)
    back = {"doc_id": F.col("c_id"), "text": F.col("c_text"), "n_chars": F.coalesce(F.col("size"), F.lit(0))}
    pick: list[Column] = [(back[c] if c in back else F.col(f"d{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(names)]
    return done.select(*pick)
