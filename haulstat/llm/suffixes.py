"""Exact substring dedup: repeated byte strings across documents, found with suffix arrays.

1. Anchors. Of every ``length`` bytes the smallest hash of ``GRAM`` bytes is an
   anchor, so equal strings have equal anchors at equal places; only anchors
   that two documents share can lie in a repeated string (no string is missed).
2. Each shared anchor's surroundings, pre-collapsed by content in each task, go
   to the anchor's group, and a group's texts get a suffix array in two stages:
   suffixes smaller than their successors are sorted directly, the others are
   induced by a scan over the byte buckets. Adjacent common prefixes then give
   every repeated string its smallest document id.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_rows

LENGTH = 50
GRAM = 16
BUCKET_BYTES = 16 << 20  # text behind one bucket of anchors
BLOCK_ANCHORS = 1_500_000  # anchors a task holds before it hands them on
BATCH_BYTES = 2 << 20  # text under one suffix array (a larger group of one anchor stays whole)
HELD_BYTES = 24 << 20
SLICE = 1 << 17  # string starts looked at together
LAST = (1 << 63) - 1
_M = np.uint64(0x9E3779B97F4A7C15)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours, by doubling."""
    step = 1
    out = values
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[:len(out) - (width - step)], out[width - step:]) if step < width else out


def anchor_windows(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, wanted: np.ndarray | None = None):
    """Yields (positions, hashes, first start, last start) of anchors, slice by slice of a byte array.

    The starts are those of the ``length``-byte strings whose smallest hash,
    the leftmost on ties, is the anchor: every string belongs to one anchor,
    and equal strings to equal places in it. ``gram`` is a power of two. With
    ``wanted`` (sorted positions) only those anchors are told.
    """
    width = length - gram + 1
    for begin in range(0, len(data) - length + 1, SLICE):
        part = data[begin:begin + SLICE + length - 1]
        h, factor, size = part.astype(np.uint64) + np.uint64(1), int(_M), 1
        while size < gram:
            h = h[:-size] * np.uint64(factor) + h[size:]
            factor, size = factor * factor % (1 << 64), size * 2
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.nonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)[0]
        own = h[at]
        order = np.lexsort((at, own))
        earlier = np.full(len(at), -1)
        again = own[order[1:]] == own[order[:-1]]
        earlier[order[1:][again]] = at[order[:-1][again]]
        if wanted is not None:
            a, b = np.searchsorted(wanted, [begin, begin + len(part)])
            asked = np.isin(at, wanted[a:b] - begin, assume_unique=True)
            at, own, earlier = at[asked], own[asked], earlier[asked]
        padded = np.concatenate([edge, low, edge])  # padded[s + width - 1] is low[s]; 0 is no hash of an anchor's window
        starts = at[:, None] + np.arange(1 - width, 1)
        mine = (padded[starts + width - 1] == own[:, None]) & (starts > earlier[:, None]) & (starts >= 0) & (starts < len(low))
        count = mine.sum(axis=1)
        first = at + 1 - width + mine.argmax(axis=1)
        some = count > 0
        yield begin + at[some], own[some], begin + first[some], begin + (first + count)[some] - 1


def _planes(values: np.ndarray) -> bytes:
    """Byte planes one after the other: sorted or small numbers then compress well in the shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _batches(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` whose worker yields tuples of whole columns (numpy arrays or lists)."""
    shape = T._parse_datatype_string(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(shape)
        work = make()

        def told(columns):
            n = len(columns[0])
            for at in range(0, n, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 50_000], type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                for columns in work(zip(*(c.to_pylist() for c in batch.slice(part, 512).columns))):
                    yield from told(columns)
        for columns in work.finish():
            yield from told(columns)

    return df.mapInArrow(run, shape)


class _Anchors:
    """Documents in, one row per bucket and block of documents out: (bucket, hashes, oids, positions)."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self):
        self.held, self.parts = 0, []

    def __call__(self, rows):
        for oid, text in rows:
            for at, h, _, _ in anchor_windows(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)):
                self.parts.append((oid, at.astype(np.uint32), h))
                self.held += len(at)
                if self.held >= BLOCK_ANCHORS:
                    yield self.flush()

    def flush(self):
        h = np.concatenate([p[2] for p in self.parts]) >> np.uint64(16)  # 48 bits: a chance meeting is sorted out later
        at = np.concatenate([p[1] for p in self.parts])
        oid = np.repeat(np.array([p[0] for p in self.parts], np.int64), [len(p[1]) for p in self.parts])
        self.clear()
        order = np.argsort(h, kind="stable")
        h, at, oid = h[order], at[order], oid[order]
        cuts = np.searchsorted(h, np.array([(i << 48) // self.buckets for i in range(1, self.buckets)], np.uint64))
        ends = [0, *cuts.tolist(), len(h)]
        out = [(i, _planes(h[a:b]), _planes(oid[a:b]), _planes(at[a:b])) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        return tuple(map(list, zip(*out)))

    def finish(self):
        if self.parts:
            yield self.flush()


class _Shared:
    """Rows of one bucket after the other in, (oid, position) of the anchors that two documents share out."""

    def __init__(self):
        self.bucket, self.parts = None, []

    def __call__(self, rows):
        for bucket, h, oid, at in rows:
            if bucket != self.bucket:
                yield from self.finish()
                self.bucket = bucket
            self.parts.append((_from_planes(h, np.uint64), _from_planes(oid, np.int64), _from_planes(at, np.uint32)))

    def finish(self):
        if self.parts:
            h, oid, at = (np.concatenate(c) for c in zip(*self.parts))
            self.parts = []
            order = np.argsort(h, kind="stable")
            h, oid, at = h[order], oid[order], at[order]
            first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            several = np.minimum.reduceat(oid, first) != np.maximum.reduceat(oid, first)
            several = np.repeat(several, np.diff(np.append(first, len(h))))
            if several.any():
                yield oid[several], at[several].astype(np.int64)


def check_of(text: bytes) -> int:
    """31 bits that tell texts of one repeated id apart."""
    import xxhash
    return xxhash.xxh32_intdigest(text) >> 1


class _Surroundings:
    """(oid, text, positions) in; distinct surroundings of anchors out, each with where it occurs."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.held, self.found = 0, {}

    def __call__(self, rows):
        for oid, text, places in rows:
            if not places:
                continue
            data = (text or "").encode("utf-8", "surrogatepass")
            check, wanted = check_of(data), np.unique(np.array(places, np.int64))
            for _, own, first, last in anchor_windows(np.frombuffer(data, np.uint8), wanted=wanted):
                for key, a, b in zip((own >> np.uint64(1)).tolist(), first.tolist(), last.tolist()):
                    piece = data[a:b + LENGTH]
                    known = self.found.get(piece)
                    if known is None:
                        known = self.found[piece] = (key, [])
                        self.held += 4 * LENGTH
                    known[1].extend((oid, check << 32 | a))
                    self.held += 16
                if self.held > HELD_BYTES:
                    yield self.flush()

    def flush(self):
        out = [(key, piece, np.array(places, np.int64).tobytes()) for piece, (key, places) in self.found.items()]
        self.clear()
        return tuple(map(list, zip(*out)))

    def finish(self):
        if self.found:
            yield self.flush()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, most significant first."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    out = padded.copy()
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        out = (out[:-step] << np.uint64(shift)) | out[step:]
    return out


def suffix_array(text: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` bytes at least, in two stages.

    With ``wanted`` (a flag per position) only those suffixes and the ones they
    are induced from, up to the next directly sorted one, are placed.

    A suffix smaller than its successor is sorted directly. Every other suffix
    starts with a larger or equal byte than its successor, so a scan over the
    byte buckets in order places it behind those already placed.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.concatenate([text[:-1] != text[1:], [True]])
    until = np.nonzero(change)[0]
    end = until[np.searchsorted(until, np.arange(n))]  # last position of the run of equal bytes
    following = np.append(text, 0)[end + 1]
    rises = np.where(end + 1 < n, following > text, False)  # smaller than its successor
    direct = np.nonzero(rises)[0]
    keep = np.ones(n, bool)
    if wanted is not None:
        ask = np.nonzero(wanted)[0]
        to = np.append(direct, n - 1)[np.searchsorted(direct, ask)]
        keep = np.cumsum(np.bincount(ask, minlength=n + 1) - np.bincount(to + 1, minlength=n + 1)[:n + 1])[:n] > 0
        direct = direct[keep[direct]]
    words = _words(text)
    keys = [words[direct + 8 * k] for k in reversed(range((depth + 7) // 8))]
    direct = direct[np.lexsort(keys)] if len(direct) else direct
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if keep[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []

    def hand_on(placed: np.ndarray) -> np.ndarray:
        """Induce the falling predecessors of ``placed``; those with the same byte come back at once."""
        before = placed[placed > 0] - 1
        before = before[~rises[before] & keep[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        first = np.nonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))[0] if len(byte) else []
        again = np.zeros(0, np.int64)
        for a, b in zip(first, [*first[1:], len(byte)]):
            if byte[a] == now:
                again = before[a:b]
            else:
                waiting[byte[a]].append(before[a:b])
        return again

    for now in range(256):
        placed = np.concatenate(waiting[now]) if waiting[now] else np.zeros(0, np.int64)
        while len(placed):
            out.append(placed)
            placed = hand_on(placed)
        rising = direct[cuts[now]:cuts[now + 1]]
        if len(rising):
            out.append(rising)
            hand_on(rising)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``depth``; 0 for the first."""
    words = _words(text)
    n = len(text)
    shared = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    a, b = order[:-1], order[1:]
    for k in range((depth + 7) // 8):
        x = words[a + 8 * k] ^ words[b + 8 * k]
        zero = np.full(len(x), 8)
        some = x != 0
        zero[some] = 7 - np.floor(np.log2((x[some] >> np.uint64(1)).astype(float) * 2 + 1)).astype(np.int64) // 8
        shared[1:][same] += zero[same]
        same &= ~some
    return np.minimum(np.minimum(shared, depth), np.append(0, n - np.maximum(a, b)))


def earliest(pieces: list[bytes], oids: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every string start of the joined ``pieces`` the smallest of ``oids`` that has the string; starts of each piece.

    Pieces are joined with a byte that UTF-8 never uses.
    """
    lengths = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)[:len(text)]
    usable = np.arange(len(text)) <= (begin + lengths - depth)[owner]
    order = suffix_array(text, depth, usable)
    order = order[usable[order]]
    first = np.nonzero(common_prefixes(text, order, depth) < depth)[0]
    value = oids[owner[order]]
    least = np.repeat(np.minimum.reduceat(value, first), np.diff(np.append(first, len(order))))
    out = np.full(len(text), LAST)
    out[order] = least
    return out, begin


class _Repeats:
    """Surroundings sorted by anchor in, (oid, check, start, end) of repeated bytes out."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.held, self.found, self.key = 0, {}, None

    def __call__(self, rows):
        for key, piece, places in rows:
            if key != self.key and self.held >= BATCH_BYTES:
                yield from self.finish()
            self.key = key
            if piece not in self.found:
                self.held += len(piece)
            self.found.setdefault(piece, []).append(places)

    def finish(self):
        if self.found:
            pieces = list(self.found)
            joined = [b"".join(parts) for parts in self.found.values()]
            self.clear()
            sizes = np.array([len(j) // 16 for j in joined])
            oid, place = np.frombuffer(b"".join(joined), np.int64).reshape(-1, 2).T
            least, begin = earliest(pieces, np.minimum.reduceat(oid, np.cumsum(sizes) - sizes))
            lengths = np.array([len(p) for p in pieces])
            starts = lengths - LENGTH + 1
            edges = np.stack([begin, begin + starts], axis=1).ravel()
            padded = np.append(least, LAST)
            lows = np.minimum.reduceat(padded, edges)[::2]
            highs = np.maximum.reduceat(padded, edges)[::2]
            of = np.repeat(np.arange(len(pieces)), sizes)
            whole = oid > highs[of]
            yield self.told(oid[whole], place[whole], 0, lengths[of[whole]])
            partly = np.nonzero((oid > lows[of]) & ~whole)[0]
            for at in range(0, len(partly), SLICE // LENGTH):
                part = partly[at:at + SLICE // LENGTH]
                yield self.runs(least, oid[part], place[part], begin[of[part]], starts[of[part]])

    @classmethod
    def runs(cls, least, oid, place, begin, starts):
        """The runs of string starts in each occurrence that a smaller document has too."""
        row = np.repeat(np.arange(len(oid)), starts)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        hit = least[begin[row] + inside] < oid[row]
        same = row[1:] == row[:-1]
        opens = np.nonzero(hit & ~np.append(False, hit[:-1] & same))[0]
        closes = np.nonzero(hit & ~np.append(hit[1:] & same, False))[0]
        return cls.told(oid[row[opens]], place[row[opens]], inside[opens], inside[closes] + LENGTH)

    @staticmethod
    def told(oid, place, a, b):
        return oid, place >> 32, (place & 0xFFFFFFFF) + a, (place & 0xFFFFFFFF) + b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256) for every row of ``docs``.

    A byte is removed if some ``LENGTH``-byte string that covers it also starts
    in a document of a smaller id. Needs doc_id and text; other columns are not
    read. Null and empty texts have no bytes; a null id counts as larger than
    any other (null ids do not remove each other); equal ids never remove each
    other, and rows that repeat an id are each judged on their own text; an
    empty table gives an empty result. Exact copies are settled by their
    SHA-256 first; only the first of each text goes on. The text is shuffled
    once, by id, and that exchange serves all three joins.
    """
    oid = F.coalesce("doc_id", F.lit(LAST))
    body = F.coalesce("text", F.lit(""))
    narrow = cut_lineage(docs.select(oid.alias("oid"), F.octet_length(body).cast("long").alias("n"), F.sha2(body.cast("binary"), 256).alias("sha")))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(8, total // BUCKET_BYTES))
    leads = narrow.where(F.col("n") >= LENGTH).groupBy("sha").agg(F.min("oid").alias("oid"))
    leads = cut_lineage(leads.groupBy("oid").agg(F.collect_set("sha").alias("shas")))
    texts = docs.select(oid.alias("oid"), body.alias("text"))
    based = texts.join(leads, "oid", "left")
    mine = based.where(F.array_contains("shas", F.sha2(F.col("text").cast("binary"), 256))).select("oid", "text")

    grouped = _batches(mine, lambda: _Anchors(buckets), "bucket int, h binary, oids binary, places binary")
    grouped = grouped.repartition("bucket").sortWithinPartitions("bucket")
    shared = _batches(grouped, _Shared, "oid long, place long").groupBy("oid").agg(F.collect_list("place").alias("places"))

    sites = texts.join(leads, "oid", "left").join(shared, "oid", "left")
    sites = sites.where(F.array_contains("shas", F.sha2(F.col("text").cast("binary"), 256)) & F.col("places").isNotNull()).select("oid", "text", "places")
    around = _batches(sites, _Surroundings, "key long, piece binary, places binary")
    around = around.repartition("key").sortWithinPartitions("key")
    found = _batches(around, _Repeats, "oid long, check int, a int, b int")
    spans = found.groupBy("oid").agg(F.collect_list(F.struct("check", "a", "b")).alias("found"))

    judged = texts.join(leads, "oid", "left").join(spans, "oid", "left")

    def work(rows):
        for oid, text, shas, found in rows:
            data = text.encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(data).hexdigest()
            if len(data) >= LENGTH and digest not in (shas or ()):
                yield oid, len(data), [(0, len(data))], hashlib.sha256(b"").hexdigest()
            elif not found:
                yield oid, len(data), [], digest
            else:
                check = check_of(data)
                gone = merged([(f["a"], f["b"]) for f in found if f["check"] == check])
                kept, last = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[last:a])
                    last = b
                kept.update(data[last:])
                yield oid, len(data), gone, kept.hexdigest()

    out = map_rows(judged, _as_dicts(work), "oid long, n_bytes long, spans array<struct<a: int, b: int>>, kept_sha256 string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select(F.when(F.col("oid") != LAST, F.col("oid")).alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256")


def _as_dicts(work):
    def run(rows):
        for oid, n, spans, sha in work(rows):
            yield oid, n, [{"a": int(a), "b": int(b)} for a, b in spans], sha
    return run
