"""Substring dedup by paragraph MinHash: bands tuned for recall, exact Jaccard, removals by component."""
from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_tables, written_tables
from .common import LOWER, cut_lineage, map_rows
from .components import Forest, components
from .runs import (RUN, SHINGLE, anchors, asked_rows, block_of, byte_spans, copies_and_anchors, keyed_rows, look_again,
                   shared_hashes, stretches, whole_hash, word_hashes)

THRESHOLD = 0.8
RECALL = 0.98
LEAST_WORDS = 6
LONG_WORDS = 64  # a longer unit is cut on at words picked by their hash
BLOCK = 1024
_CUT = re.compile(rb"\n|[.!?][\x20\x09\x0B-\x0D]+")
_KINDS = np.array([1 if c == 10 else 2 if c in b"\x20\x09\x0B\x0C\x0D" else 3 if c in b".!?" else 0 for c in range(256)], np.uint8)
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 2) -> int:
    """Fewest bands of ``rows`` min-hashes that meet ``recall`` at a similarity of exactly ``threshold``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def units(data: bytes):
    """(start, end, words) of each unit of a UTF-8 text: a line, cut on at sentence ends.

    A unit above ``LONG_WORDS`` words is cut after words whose crc32 ends in
    four zero bits, so equal passages are cut alike wherever they stand. Words
    are A-Z lower-cased and stripped of signs; the ends cover the whole text.
    """
    plain, start = data.translate(_WORDS), 0
    for end in [*(m.end() for m in _CUT.finditer(data)), len(data)]:
        if end > start:
            words = plain[start:end].split()
            if len(words) <= LONG_WORDS:
                yield start, end, words
            else:
                yield from _pieces(data, start, end)
            start = end


def _pieces(data: bytes, start: int, end: int):
    """The units of the words of ``data`` from ``start`` to ``end``."""
    held: list[bytes] = []
    begin, at = start, start
    for found in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", data[start:end]):
        piece = found[0].translate(_WORDS).split()
        held.extend(piece)
        at = start + found.end()
        if piece and not crc32(piece[-1]) & 15 and len(held) >= LEAST_WORDS:
            yield begin, at, held
            begin, held = at, []
    if at > begin or end > begin:
        yield begin, end, held


def unit_sizes(data: bytes, plain: bytes) -> np.ndarray:
    """How many words each of the ``units`` of ``data`` has; ``plain`` is ``data`` without signs."""
    if not data:
        return np.zeros(0, np.int64)
    kind = _KINDS[np.frombuffer(data, np.uint8)]
    blank = kind == 2
    # A sentence ends with the blanks behind its stop, a line with its line feed.
    closed = np.append(blank[:-1] & ~blank[1:], blank[-1])
    opened = np.nonzero(blank[1:] & (kind[:-1] == 3))[0]
    runs = np.nonzero(closed)[0]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = kind == 1
    stops[runs[np.searchsorted(runs, opened + 1)] + 1] = True
    stops[-1] = True
    ends = np.nonzero(stops)[0]
    word = np.frombuffer(plain, np.uint8) != 32
    begins = np.nonzero(np.append(word[0], word[1:] & ~word[:-1]))[0]
    sizes = np.diff(np.searchsorted(begins, ends), prepend=0)
    if sizes.max() > LONG_WORDS:
        own = sizes.tolist()
        for k in np.nonzero(sizes > LONG_WORDS)[0].tolist():
            own[k] = [len(words) for _, _, words in _pieces(data, int(ends[k - 1]) if k else 0, int(ends[k]))]
        sizes = np.array([n for x in own for n in (x if isinstance(x, list) else [x])], np.int64)
    return sizes


def grams(h: np.ndarray) -> np.ndarray:
    """One hash for every ``SHINGLE`` neighbours of word hashes."""
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out + h[i:i + n]) * _ODD
        out ^= out >> np.uint64(32)
    return out


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles; fewer words have the hash 0."""
    return np.unique(grams(word_hashes(words))) if len(words) >= SHINGLE else np.zeros(1, np.uint64)


def band_keys(lists: list[list[bytes]], bands: int, rows: int = 2) -> np.ndarray:
    """Signed keys, one row per word list of at least five words and one column per band; all lists at once."""
    return keys_of(word_hashes([w for words in lists for w in words]), np.array([len(words) for words in lists]), bands, rows)


def keys_of(h: np.ndarray, sizes: np.ndarray, bands: int, rows: int = 2) -> np.ndarray:
    """``band_keys`` of lists of ``sizes`` words, given the hashes of all their words."""
    shingles = grams(h)
    begin = np.cumsum(sizes) - sizes
    # Windows that run over the end of a list sit between the lists; each list is reduced up to its last own window.
    edges = np.stack([begin, begin + sizes - SHINGLE + 1], axis=1).ravel()
    keys = np.tile(np.full(bands, 17, np.uint64) + np.arange(bands, dtype=np.uint64), (len(sizes), 1))
    for k in range(bands * rows):
        seed = np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64) | 1)
        mixed = (shingles ^ (seed >> np.uint64(7))) * seed
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(np.append(mixed, np.uint64(0xFFFFFFFFFFFFFFFF)), edges)[::2]
        column = keys[:, k // rows]
        column = (column ^ low) * _ODD
        keys[:, k // rows] = column ^ (column >> np.uint64(31))
    return keys.view(np.int64)


TOLD = ("_row long, whole long, n_words int, anchors binary, units array<int>, hashes array<long>, sizes array<int>, "
        "names binary, keys binary, n_keys long")


class _Sketch:
    """(_row, text) in, ``TOLD`` out: of each text its units, whole hash and anchors; between them band keys of units new to the task.

    Below 1 / (1 - threshold) - 1 shingles a different set cannot be similar enough, so such units have no keys.
    """

    def __init__(self, least: int, bands: int, threshold: float, runs: bool):
        self.least, self.bands, self.runs, self.seen = least, bands, runs, set()
        self.fewest = int(np.ceil(threshold / (1 - threshold) - 1e-9)) + SHINGLE - 1
        self.clear()

    def clear(self):
        self.names, self.parts, self.sizes, self.words = [], [], [], 0

    def __call__(self, rows):
        import xxhash
        digest = xxhash.xxh64_intdigest
        for row, text in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            plain = data.translate(_WORDS)
            told = plain.split()
            words, counts = word_hashes(told), unit_sizes(data, plain)
            ends = np.cumsum(counts)
            joined = memoryview(b" ".join(told))
            # Where each word begins in the joined text; the last place is one blank behind its end.
            places = np.cumsum([0, *map(len, told)]) + np.arange(len(told) + 1)
            own = np.nonzero(counts >= self.least)[0]
            at, sizes, hashes = own.tolist(), counts[own].tolist(), []
            ends = ends[own]
            begins = ends - counts[own]
            for n, begin, a, b in zip(sizes, begins.tolist(), places[begins].tolist(), places[ends].tolist()):
                h = digest(joined[a:b - 1], 7)
                h = h - (1 << 64) if h >= 1 << 63 else h
                hashes.append(h)
                if n >= self.fewest and h not in self.seen:
                    self.seen.add(h)
                    self.names.append(h), self.parts.append(words[begin:begin + n]), self.sizes.append(n)
                    self.words += n
            if self.runs and len(words) >= RUN:
                yield row, whole_hash(words), len(words), anchors(words)[1].tobytes(), at, hashes, sizes, None, None, 0
            elif at:
                yield row, None, None, None, at, hashes, sizes, None, None, 0
            if self.words >= 20_000:
                yield self.told()
            if len(self.seen) > 1_000_000:
                self.seen.clear()

    def told(self):
        keys = keys_of(np.concatenate(self.parts), np.array(self.sizes), self.bands)
        names = np.array(self.names, np.int64)
        self.clear()
        return None, None, None, None, None, None, None, names.tobytes(), keys.tobytes(), keys.size

    def finish(self):
        if self.names:
            yield self.told()


def similar_pairs(members: dict[int, list[int]], threshold: float):
    """Pairs of ``members`` (name -> shingles) with an exact Jaccard of at least ``threshold``.

    Members enter by size; only the rarest shingles of a set that any similar
    set must share are looked up.
    """
    order = Counter(s for shingles in members.values() for s in shingles)
    index: dict[int, list[int]] = {}
    for name in sorted(members, key=lambda m: (len(members[m]), m)):
        own = sorted(members[name], key=lambda s: (order[s], s))
        prefix = own[:len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]
        mine = set(own)
        for other in {o for s in prefix for o in index.get(s, ())}:
            theirs = members[other]
            if len(theirs) >= threshold * len(own) - 1e-9:
                both = sum(s in mine for s in theirs)
                if both >= threshold * (len(own) + len(theirs) - both) - 1e-9:
                    yield other, name
        for s in prefix:
            index.setdefault(s, []).append(name)


class _Verifier:
    def __init__(self, threshold: float):
        self.threshold, self.forest, self.bucket, self.run = threshold, Forest(), None, {}

    def __call__(self, rows):
        for bucket, h, shingles in rows:
            if bucket != self.bucket:
                yield from self.finish()
                self.bucket = bucket
            self.run[h] = shingles

    def finish(self):
        if len(self.run) > 1:
            if len(self.forest.up) > 500_000:
                self.forest = Forest()
            for a, b in similar_pairs(self.run, self.threshold):
                if self.forest.joins(a, b):
                    yield a, b
        self.run = {}


def similar_units(met: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between hashes of different units that share a band key in ``met`` and are similar enough by their ``sets``."""
    sizes = met.groupBy("key").agg(F.count("*").alias("n"))
    blocked = met.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocked = (blocked.withColumn("_own", F.pmod(F.xxhash64("h"), F.col("_blocks")).cast("int"))
               .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    bucket = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    full = blocked.select(bucket.alias("bucket"), "h").join(sets, "h").select("bucket", "h", "shingles")
    full = full.repartition("bucket").sortWithinPartitions("bucket")

    def make():
        return _Verifier(threshold)

    make.per_task = True
    return map_rows(full, make, "a long, b long")


def _found(rows: DataFrame, runs: bool = True, doc_id: DataFrame | None = None, threshold: float = THRESHOLD,
           recall: float = RECALL, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame | None]:
    """``repeated_units`` of ``rows`` by _row, or by the id that ``doc_id`` has for it, and their stretches.

    Texts are read twice: once for names, band keys and anchors, once for the
    shingles of a unit that shares a key and the windows around shared anchors.
    """
    bands = tuned_bands(threshold, recall)

    def make():
        return _Sketch(least, bands, threshold, runs)

    make.per_task = True
    spark = rows.sparkSession
    told = cut_lineage(map_rows(rows.select("_row", "text"), make, TOLD))
    done = written_tables()[-1:]
    many = told.agg(F.sum("n_keys")).first()[0] or 0
    met = shared_hashes(told.where("_row is null").select("names", "keys"), many)
    met = cut_lineage(met.select(F.col("hash").alias("key"), F.col("name").alias("h")))

    units_ = told.where("_row is not null").select("_row", F.inline(F.arrays_zip("units", "hashes", "sizes")))
    units_ = units_.toDF("_row", "unit", "h", "n_words")
    near = met.select("h").distinct().withColumn("near", F.lit(True))
    names = units_.groupBy("h").agg(F.count("*").alias("n")).join(near, "h", "left").where("n > 1 or near").select("h", "near")
    table = units_.join(names, "h")
    table = cut_lineage(table.join(doc_id, "_row") if doc_id is not None else table.withColumn("doc_id", F.col("_row")))

    # Equal units have equal words, so any row of a name can tell its shingles.
    one = table.where("near").groupBy(F.col("h").alias("value")).agg(F.first("_row").alias("_row"), F.first("unit").alias("unit"))
    wanted = one.select(block_of("_row"), "_row", "unit", "value")
    copies = None
    if runs:
        copies, spots = copies_and_anchors(told)
        wanted = wanted.unionByName(asked_rows(copies, spots))
    wanted = cut_lineage(wanted)
    # What the first reading told is in smaller tables now; it goes before texts are shuffled again.
    drop_tables(spark, done)
    seen = cut_lineage(look_again(rows, wanted, _WORDS, unit_sizes, grams))
    done = written_tables()[-1:]
    if runs:
        found = copies.unionByName(cut_lineage(stretches(seen.where("_row is not null").drop("shingles"))))
    links = cut_lineage(similar_units(met, seen.where("shingles is not null").select("h", "shingles"), threshold))
    drop_tables(spark, done)

    place = F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("unit")
    table = table.withColumn("place", place.cast("decimal(38,0)"))
    equal = table.groupBy("h").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    roots = components(links)
    nodes = equal.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("component_id", F.coalesce("root", "h"))
    nodes = cut_lineage(nodes.where("n > 1 or root is not null").select("h", "place", "n", "component_id"))
    groups = nodes.groupBy("component_id").agg(F.min("place").alias("keeper"), F.sum("n").alias("component_size"))
    flagged = nodes.select("h", "component_id").join(groups, "component_id")
    keeper = F.floor(F.col("keeper") / F.lit(1 << 31).cast("decimal(10,0)")).cast("long")
    repeated = table.join(flagged, "h").select("doc_id", "unit", "n_words", "component_id", "component_size", keeper.alias("keeper_doc_id"),
                                               (F.col("place") > F.col("keeper")).alias("removed"))
    return repeated, found if runs else None


def repeated_units(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WORDS, recall: float = RECALL,
                   most_hashes: int | None = None) -> DataFrame:
    """(doc_id, unit, n_words, component_id, component_size, keeper_doc_id, removed): every unit that has an equal or similar one.

    Units are sentences and lines of at least ``least`` words (five-word
    shingles, Jaccard of at least ``threshold``). In each component the unit of
    the smallest (doc_id, unit) stays and the others are removed. Needs doc_id
    and text; other columns are not read. Null, empty and blank texts have no
    units; a null id comes last in the order; repeated rows of one id count as
    one row; an empty table gives an empty result. Documents without such a
    unit do not appear. ``most_hashes`` has no effect any more: units are never sent to the tasks as a filter.
    """
    rows = keyed_rows(docs, ["doc_id", "text"])
    return _found(rows, False, rows.select("_row", "doc_id"), threshold, recall, least)[0]


def repeats(docs: DataFrame, **options) -> DataFrame:
    """``repeated_units`` of every row of ``docs``, and the runs of at least ``runs.RUN`` words that an earlier place has.

    A run's row has no unit but ``from_word``, its first word in the text; it is
    found wherever it stands, also across or inside sentences and lines. Rows
    with a null id and repeated rows are rows of their own here.
    """
    rows = keyed_rows(docs, ["doc_id", "text"])
    ids = rows.select("_row", "doc_id")
    keepers = ids.select(F.col("_row").alias("keeper_row"), F.col("doc_id").alias("keeper_doc_id"))
    units_, found = _found(rows, **options)
    units_ = units_.withColumnsRenamed({"doc_id": "_row", "keeper_doc_id": "keeper_row"}).withColumn("from_word", F.lit(None).cast("int"))
    both = units_.unionByName(found.withColumn("removed", F.lit(True)), allowMissingColumns=True)
    return both.join(ids, "_row").join(keepers, "keeper_row").select(
        "doc_id", "unit", "n_words", "component_id", "component_size", "keeper_doc_id", "removed", "from_word")


def without_repeats(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """``docs`` without removed units and repeated runs; every row stays, and n_chars (if there) is counted anew."""
    rows = keyed_rows(docs, columns)
    gone, found = _found(rows, **options)
    gone = gone.where("removed").groupBy(F.col("doc_id").alias("_row")).agg(F.array_sort(F.collect_set("unit")).alias("_gone"))
    lost = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.array("from_word", "n_words"))).alias("_lost"))
    both = rows.join(cut_lineage(gone.join(lost, "_row", "full")), "_row", "left")

    @F.pandas_udf("string")
    def cut(text, gone, lost):
        import pandas as pd
        out = []
        for t, g, r in zip(text, gone, lost):
            if t is None or (g is None and r is None):
                out.append(t)
                continue
            data, dropped = t.encode("utf-8", "surrogatepass"), set() if g is None else set(g)
            spans = [(a, b) for i, (a, b, _) in enumerate(units(data)) if i in dropped] if dropped else []
            spans += byte_spans(data, r, _WORDS) if r is not None else []
            kept, at = [], 0
            for a, b in sorted(spans):
                kept.append(data[at:a])
                at = max(at, b)
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    same = F.col("_gone").isNull() & F.col("_lost").isNull()
    both = both.withColumn("text", F.when(same, F.col("text")).otherwise(cut("text", "_gone", "_lost")))
    if "n_chars" in columns:
        both = both.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return both.select(*columns)
