"""Near copies of whole documents: SimHash and min-hash bands propose, the exact Jaccard of five-word shingles decides.

The groups that op2's links join are compared as they are. Its radius alone cannot
stand in for a similarity: at a Jaccard of 0.8 the
distance of two fingerprints scatters around 10 bits with a deviation of 3. So what lies beyond it meets in
min-hash bands: ``BANDS`` bands of ``ROWS`` min-hashes miss a pair of exactly ``THRESHOLD``
with a chance below 1e-9, and every pair that meets is verified exactly.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut_lineage, map_rows
from .components import Forest, components
from .passages import SHINGLE, band_keys, shingle_hashes
from .simhash import fingerprint, linked_fingerprints

THRESHOLD = 0.8
ROWS, BANDS = 4, 40  # (1 - 0.8 ** 4) ** 40 = 7e-10
BLOCK = 512  # documents of a bucket that one task compares with as many others
FEWEST = 4  # sets below 4 shingles have no other set within 0.8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the five-word shingles; a shorter text is one shingle, a text without words has none."""
    import xxhash
    if len(words) >= SHINGLE:
        return shingle_hashes(words)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), 11)] if words else [], np.uint64)


class _Sketches:
    """(_row, h, keys): the name of each shingle set, with its band keys where the task meets it first.

    With ``prints`` a fourth value is the SimHash fingerprint of such a text.
    """

    def __init__(self, prints: bool = False):
        self.prints = prints
        self.seen: set[int] = set()
        self.rows, self.lists, self.words = [], [], 0

    def __call__(self, rows):
        import xxhash
        for row, text in rows:
            words = words_of(text)
            shingles = shingle_set(words)
            h = int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))
            if len(shingles) < FEWEST or h in self.seen:
                yield (row, h, None, None) if self.prints else (row, h, None)
                continue
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            self.seen.add(h)
            self.rows.append((row, h, fingerprint(text, SHINGLE)) if self.prints else (row, h))
            self.lists.append(words)
            self.words += len(words)
            if self.words >= 20_000:
                yield from self.finish()

    def finish(self):
        if self.lists:
            for (row, h, *fp), keys in zip(self.rows, band_keys(self.lists, BANDS, ROWS).tolist()):
                yield row, h, keys, *fp
        self.rows, self.lists, self.words = [], [], 0


def _sketches():
    return _Sketches()


_sketches.per_task = True


def _prints():
    return _Sketches(True)


_prints.per_task = True


class _Verifier:
    """Rows (bucket, h, shingles) sorted by bucket in, links that join two trees of this task out."""

    def __init__(self, threshold: float):
        self.threshold, self.forest, self.bucket, self.run = threshold, Forest(), None, {}

    def __call__(self, rows):
        for bucket, h, shingles in rows:
            if bucket != self.bucket:
                yield from self.finish()
                self.bucket = bucket
            self.run[h] = np.frombuffer(shingles, np.uint64)

    def finish(self):
        if len(self.forest.up) > 500_000:
            self.forest = Forest()  # links may repeat then, none is lost
        names = sorted(self.run, key=lambda m: (len(self.run[m]), m))
        trees: dict[int, list[int]] = {}
        for b in names:
            mine = self.run[b]
            root = self.forest.find(b)
            for other in list(trees):
                if other == root or other not in trees:
                    continue
                for a in reversed(trees[other]):  # the closest sizes first
                    theirs = self.run[a]
                    if len(theirs) < self.threshold * len(mine) - 1e-9:
                        break
                    both = len(mine) + len(theirs) - len(np.union1d(mine, theirs))
                    if both >= self.threshold * (len(mine) + len(theirs) - both) - 1e-9:
                        self.forest.joins(a, b)
                        yield a, b
                        held = trees.pop(other) + trees.pop(root, [])
                        root = self.forest.find(b)
                        trees[root] = sorted(held, key=lambda m: (len(self.run[m]), m))
                        break
            trees.setdefault(root, []).append(b)
        self.run = {}


def simhash_groups(prints: DataFrame) -> DataFrame:
    """(key, h): shingle sets whose fingerprints are equal or joined by op2's links share a key."""
    named = cut_lineage(prints.where("fp is not null").select("h", "fp").distinct())
    roots = components(cut_lineage(linked_fingerprints(named.select("fp").distinct()))).withColumnRenamed("node", "fp")
    root = F.coalesce("root", "fp")
    return named.join(roots, "fp", "left").select(F.xxhash64(F.lit("simhash"), root).alias("key"), "h").distinct()


def similar_sets(rows: DataFrame, prints: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between names of different shingle sets with an exact Jaccard of at least ``threshold``.

    Sets meet in their bands and, where ``prints`` has fingerprints (``fp``), in their SimHash group.
    Buckets with the same members are compared once. A bucket above ``block``
    members is dealt into blocks, each pair of blocks a piece of its own. Only
    shingles of documents that share a bucket with another one travel.
    """
    keyed = prints.where("keys is not null").select(F.explode("keys").alias("key"), "h").distinct()
    keyed = cut_lineage(keyed.unionByName(simhash_groups(prints)) if "fp" in prints.columns else keyed)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor("h").alias("y"))
    sizes = sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    met = keyed.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    met = (met.withColumn("_own", F.pmod(F.xxhash64("h"), F.col("_blocks")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    bucket = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    met = cut_lineage(met.select(bucket.alias("bucket"), "h"))
    wanted = prints.join(met.select("h").distinct(), "h").groupBy("h").agg(F.min("_row").alias("_row"))

    def sets_of(batch):
        for h, text in batch:
            yield h, shingle_set(words_of(text)).tobytes()

    sets = map_rows(rows.select("_row", "text").join(wanted, "_row").select("h", "text"), sets_of, "h long, shingles binary", rows=256)
    full = met.join(sets, "h").select("bucket", "h", "shingles").repartition("bucket").sortWithinPartitions("bucket")

    def make():
        return _Verifier(threshold)

    make.per_task = True
    return map_rows(full, make, "a long, b long")


def first_of_near_copies(docs: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component of near copies: that of the smallest id.

    Rows are told apart by a key written with them, so rows with a null id
    (last in the order) and repeated rows are compared like any other. Texts
    with equal shingle sets, and texts without words, are copies of each other.
    """
    rows = cut_lineage(docs.select(*columns).withColumn("_row", F.monotonically_increasing_id()))
    prints = cut_lineage(map_rows(rows.select("_row", "text"), _prints, "_row long, h long, keys array<long>, fp long"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    nodes = prints.select("_row", "h").join(rows.select("_row", "doc_id"), "_row").groupBy("h").agg(F.min(place).alias("place"))
    roots = components(cut_lineage(similar_sets(rows, prints, threshold))).withColumnRenamed("node", "h")
    kept = nodes.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("place").alias("place"))
    return rows.join(cut_lineage(kept.select("place._row")), "_row", "left_semi").select(*columns)
