"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that agree in two of ``radius + 2`` bit ranges meet in a bucket
(at most ``radius`` differing bits leave two ranges alone, so no link is
missed). Buckets are compared on bit planes: one word holds the same bit of 64
fingerprints, carry-save counters add up their differences plane by plane, and
a word is abandoned once all of its 64 fingerprints are beyond the radius.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut_lineage, map_rows
from .components import Forest, components

SHINGLE = 3
RADIUS = 3
BLOCK = 2048  # fingerprints of a bucket that one task compares with as many others
BATCH = 512  # small buckets are compared together up to this many fingerprints
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for a text without words."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 8192):
        upto = min(n, at + 8192)
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:upto], ends[at + width - 1:upto + width - 1])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row."""
    def work(rows):
        for doc_id, text in rows:
            yield doc_id, fingerprint(text, shingle)

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def close_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of uint64 ``prints`` that differ in at most ``radius`` bits."""
    n = len(prints)
    words = (n + 63) // 64
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.packbits(padded.T.copy(), axis=1, bitorder="little").view(np.uint64)  # (64 planes, words)
    masks = np.where(bits.T.astype(bool), ALL, np.uint64(0))  # (64 planes, n): the query's bit in every lane
    query, word = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(words), indexing="ij"))
    keep = word >= query // 64
    query, word = query[keep], word[keep]
    levels = max(1, (radius + 1).bit_length())
    counters = [np.zeros(len(query), np.uint64) for _ in range(levels)]
    beyond = np.zeros(len(query), np.uint64)
    for p in range(64):
        carry = planes[p][word] ^ masks[p][query]
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry
        over = _above(counters, radius)
        beyond |= over
        if p % 8 == 7:
            alive = beyond != ALL
            if not alive.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            query, word, beyond = query[alive], word[alive], beyond[alive]
            counters = [c[alive] for c in counters]
    lanes = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    at, lane = np.nonzero(lanes)
    i, j = query[at], word[at] * 64 + lane
    good = (j > i) & (j < n)
    return i[good], j[good]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than ``radius``, compared bit by bit from the top."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def link_buckets(rows_per_batch: int = BATCH, radius: int = RADIUS):
    """A task's worker over rows (bucket, fp) sorted by bucket: yields links that join two trees of this task."""
    def make():
        return _Linker(rows_per_batch, radius)
    make.per_task = True
    return make


class _Linker:
    def __init__(self, batch: int, radius: int):
        self.batch, self.radius, self.forest = batch, radius, Forest()
        self.held: list[int] = []
        self.run: list[int] = []
        self.bucket = None

    def __call__(self, rows):
        for bucket, fp in rows:
            if bucket != self.bucket:
                self.held.extend(self.run)
                self.run, self.bucket = [], bucket
                if len(self.held) >= self.batch:
                    yield from self.compare()
            self.run.append(fp)

    def compare(self):
        prints = np.unique(np.array(self.held, np.int64))
        self.held = []
        if len(self.forest.up) > 1_000_000:
            self.forest = Forest()  # links may repeat then, none is lost
        for i, j in zip(*close_pairs(prints.view(np.uint64), self.radius)):
            a, b = int(prints[i]), int(prints[j])
            if self.forest.joins(a, b):
                yield a, b

    def finish(self):
        self.held.extend(self.run)
        if self.held:
            yield from self.compare()


def bucket_masks(radius: int) -> list[int]:
    """Signed masks of every two of ``radius + 2`` bit ranges."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [x | y for x, y in combinations(ranges, 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked_fingerprints(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` at most ``radius`` bits apart.

    A bucket above ``block`` fingerprints is dealt out by hash into blocks, and
    each pair of blocks is its own task-sized piece, so no task sees a whole
    hot bucket. Buckets of one fingerprint never travel again.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(bucket_masks(radius))])
    keyed = prints.select("fp", F.explode(masks).alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"]).withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    met = met.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    bucket = F.xxhash64("t", "key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    met = met.select(bucket.alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket")
    return map_rows(met, link_buckets(radius=radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Needs doc_id and text; other columns are not read. Null, empty and blank
    texts have fingerprint 0 and are linked like any other; repeated rows share
    a component; the component id is its smallest non-null id (null if it has
    none); an empty table gives an empty result. Equal fingerprints collapse
    before any comparison, so a group of copies costs one fingerprint.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(cut_lineage(linked_fingerprints(nodes.select("fp"), radius)))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = nodes.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
