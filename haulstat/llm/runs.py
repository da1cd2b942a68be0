"""Repeated runs of words, exact and wherever they stand: sentence ends and lines play no part.

Of every ``RUN`` words the smallest hash of ``GRAM`` words is an anchor, so
equal runs have equal anchors and only shared anchors can lie in a repeated
run. All ``RUN``-word windows around shared anchors are named by 64-bit hashes;
a window that stands at an earlier place goes, and neighbouring windows join to
the whole repeated passage, word by word.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_tables
from .common import cut_lineage, map_rows
from .decontaminate import prefix_sums, window_hashes
from .suffixes import _batches, _from_planes, _planes, _slide

RUN = 50
GRAM = 16
SHINGLE = 5
BLOCK_BITS = 10  # neighbours by row whose texts are looked at again together
DEALT = 1_000_000  # hashes that a task holds before it deals them out
BUCKET = 500_000  # hashes of a range that meet in arrays
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TAIL = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]*")


def keyed_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``_row``, a key of each row in the order of ids (null last), written once."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    spread = docs.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(spread.withColumn("_row", F.monotonically_increasing_id()))
    drop_tables(docs.sparkSession, [])  # the shuffle of the texts
    return rows


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def anchors(words: np.ndarray, run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are the smallest of some ``run`` words."""
    h, width = window_hashes(prefix_sums(words), gram), run - gram + 1
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    edge = np.zeros(width - 1, np.uint64)
    at = np.nonzero(_slide(np.concatenate([edge, _slide(h, width, np.minimum), edge]), width, np.maximum) == h)[0]
    return at, h[at]


def whole_hash(words: np.ndarray) -> int:
    """Signed hash of a whole text from those of its words."""
    import xxhash
    return int(np.uint64(xxhash.xxh64_intdigest(words.tobytes(), 5)).view(np.int64))


class _Deal:
    """(name, hashes) in, one row a bucket and block of hashes out: (bucket, hashes, names).

    A name is a number, or the bytes of several that have equally many of the
    hashes each. A pair that comes again is told once; with ``counted`` the
    lowest bit of its name says so.
    """

    def __init__(self, buckets: int, counted: bool):
        self.buckets, self.counted, self.parts, self.held = buckets, counted, [], 0

    def __call__(self, rows):
        for name, hashes in rows:
            h = np.frombuffer(hashes, np.uint64)
            if len(h):
                own = np.frombuffer(name, np.int64) if isinstance(name, bytes) else np.array([name], np.int64)
                self.parts.append((np.repeat(own, len(h) // len(own)), h))
                self.held += len(h)
                if self.held >= DEALT:
                    yield self.flush()

    def flush(self):
        names, h = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.held = [], 0
        names, h, n = _pairs(names, h)
        if self.counted:
            names = names * 2 + (n > 1)
        return _ranges(self.buckets, h, names)

    def finish(self):
        if self.parts:
            yield self.flush()


def _ranges(buckets: int, h: np.ndarray, *others: np.ndarray):
    """Columns (bucket, h, others) of the sorted hashes, one row a range of them."""
    cuts = np.searchsorted(h, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64))
    ends = [0, *cuts.tolist(), len(h)]
    out = [(i, *(_planes(c[a:b]) for c in (h, *others))) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    return tuple(map(list, zip(*out)))


def _pairs(names, h):
    """Distinct (name, hash) by hash, then name, and how often each came."""
    order = np.lexsort((names, h))
    names, h = names[order], h[order]
    first = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (names[1:] != names[:-1])]))[0]
    return names[first], h[first], np.diff(np.append(first, len(h)))


class _Met:
    """Rows of one bucket after the other in, columns (hash, name) of the hashes that more than one name, or one more than once, has out."""

    def __init__(self, counted: bool):
        self.counted, self.bucket, self.parts = counted, None, []

    def __call__(self, rows):
        for bucket, h, names in rows:
            if bucket != self.bucket:
                yield from self.finish()
                self.bucket = bucket
            self.parts.append((_from_planes(names, np.int64), _from_planes(h, np.uint64)))

    def finish(self):
        if self.parts:
            names, h, n = _pairs(*(np.concatenate(c) for c in zip(*self.parts)))
            self.parts = []
            first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            many = np.diff(np.append(first, len(h)))
            shared = many > 1
            if self.counted:
                # A block that two tasks read in parts sends its name twice.
                shared |= np.maximum.reduceat((names & 1) | (n > 1), first) > 0
                names = names >> 1
            shared = np.repeat(shared, many)
            if shared.any():
                yield h[shared].view(np.int64), names[shared]


def shared_hashes(told: DataFrame, many: int, counted: bool = False) -> DataFrame:
    """(hash, name) of the hashes that several names share, or with ``counted`` that come at least twice.

    ``told`` has a name (or the bytes of some) and the bytes of its hashes, ``many`` in all. Ranges of hashes are brought together in arrays.
    """
    buckets = max(64, many // BUCKET)
    dealt = _batches(told, lambda: _Deal(buckets, counted), "bucket int, h binary, names binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return _batches(dealt, lambda: _Met(counted), "hash long, name long")


def block_of(row: str):
    return F.shiftright(row, BLOCK_BITS).alias("block")


def copies_and_anchors(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole copies as stretches, and (block, value): the anchors that come at least twice in rows that are no copies, by block of rows."""
    told = told.where("whole is not null")
    first = cut_lineage(told.groupBy("whole").agg(F.min("_row").alias("keeper_row")))
    copies = told.select("_row", "whole", "n_words").join(first, "whole").where(F.col("_row") > F.col("keeper_row"))
    copies = cut_lineage(copies.select("_row", F.lit(0).alias("from_word"), "n_words", "keeper_row"))
    alone = told.select("_row", "anchors").join(first.select(F.col("keeper_row").alias("_row")), "_row", "left_semi")
    many = (told.agg(F.sum("n_words")).first()[0] or 0) // (RUN - GRAM) * 2
    met = shared_hashes(alone.select(block_of("_row").alias("name"), "anchors"), many, counted=True)
    return copies, met.select(F.col("name").alias("block"), F.col("hash").alias("value")).distinct()


def windows_of(words: np.ndarray, shared: np.ndarray, run: int = RUN, gram: int = GRAM):
    """(hashes, positions, first position of an equal window) of the windows around anchors in ``shared``, which is sorted."""
    at, own = anchors(words, run, gram)
    near = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
    at = at[shared[near] == own]
    n = len(words) - run + 1
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.maximum(at - (run - gram), 0), 1)
    np.add.at(marks, np.minimum(at + 1, n), -1)
    starts = np.nonzero(np.cumsum(marks)[:n] > 0)[0]
    h = window_hashes(prefix_sums(words), run)[starts].view(np.int64)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return h, starts, starts[first[back]]


SEEN = "h long, _row long, at int, first int, shingles array<long>"


def look_again(rows: DataFrame, wanted: DataFrame, signs: bytes, sizes=None, shingles=None, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """``SEEN`` rows of the texts, block by block: the windows around shared anchors, and the shingles of wanted units.

    ``wanted`` has (block, _row, unit, value): without a row a shared anchor
    of the block, with a unit a unit whose shingles are asked under the name
    ``value``, without one a row that has no windows to tell. ``sizes`` gives
    the words of each unit of a text, ``shingles`` the hashes of its five-word shingles.
    """
    def work(texts, asked):
        import pyarrow as pa
        row, unit, value = (asked[c] for c in ("_row", "unit", "value"))
        shared = np.unique(value.filter(row.is_null()).to_numpy().view(np.uint64))
        still, own = set(), {}
        for r, u, v in zip(*(c.filter(row.is_valid()).to_pylist() for c in (row, unit, value))):
            if u is None:
                still.add(r)
            else:
                own.setdefault(r, []).append((u, v))
        found, names, sets = [], [], []
        for r, text in zip(texts["_row"].to_pylist(), texts["text"].to_pylist()):
            mine, windowed = own.get(r), len(shared) and r not in still
            if text is None or not (mine or windowed):
                continue
            data = text.encode("utf-8", "surrogatepass")
            plain = data.translate(signs)
            words = word_hashes(plain.split())
            if mine:
                ends, grams = np.append(0, np.cumsum(sizes(data, plain))), shingles(words)
                for u, v in mine:
                    names.append(v)
                    sets.append(np.unique(grams[ends[u]:ends[u + 1] - SHINGLE + 1]))
            if windowed and len(words) >= run:
                h, at, first = windows_of(words, shared, run, gram)
                if len(h):
                    found.append((h, np.full(len(h), r, np.int64), at, first))
        h, r, at, first = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        many = len(h) + len(names)
        ends = np.cumsum([0] + [len(s) for s in sets])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
        blank = len(names)
        return pa.table({
            "h": pa.array(np.concatenate([h, np.array(names, np.int64)])),
            "_row": pa.concat_arrays([pa.array(r), pa.nulls(blank, pa.int64())]),
            "at": pa.concat_arrays([pa.array(at.astype(np.int32)), pa.nulls(blank, pa.int32())]),
            "first": pa.concat_arrays([pa.array(first.astype(np.int32)), pa.nulls(blank, pa.int32())]),
            "shingles": pa.concat_arrays([pa.nulls(many - blank, lists.type), lists])})

    texts = rows.select(block_of("_row"), "_row", "text")
    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(work, SEEN)


class _DealWindows:
    """Columns (h, _row, at, first) of windows in, one row a bucket and block of windows out: (bucket, h, rows, places).

    The lowest bit of a place says that an equal window ends before it in the row.
    """

    def __init__(self, buckets: int, run: int):
        self.buckets, self.run, self.parts, self.held = buckets, run, [], 0

    def __call__(self, h, row, at, first):
        self.parts.append((h.view(np.uint64), row, at * 2 + (first + self.run <= at)))
        self.held += len(h)
        if self.held >= DEALT:
            yield from self.finish()

    def finish(self):
        if self.held:
            h, row, place = (np.concatenate(c) for c in zip(*self.parts))
            order = np.argsort(h)
            yield _ranges(self.buckets, h[order], row[order], place[order])
        self.parts, self.held = [], 0


class _Earlier:
    """Rows of one bucket after the other in, columns (_row, at, keeper_row) of the windows that stand at an earlier place out."""

    def __init__(self):
        self.bucket, self.parts = None, []

    def __call__(self, rows):
        for bucket, h, row, place in rows:
            if bucket != self.bucket:
                yield from self.finish()
                self.bucket = bucket
            self.parts.append((_from_planes(h, np.uint64), _from_planes(row, np.int64), _from_planes(place, np.int32)))

    def finish(self):
        if self.parts:
            h, row, place = (np.concatenate(c) for c in zip(*self.parts))
            self.parts = []
            order = np.argsort(h)
            h, row, place = h[order], row[order], place[order]
            first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            keeper = np.repeat(np.minimum.reduceat(row, first), np.diff(np.append(first, len(h))))
            gone = (keeper < row) | (place & 1 > 0)
            if gone.any():
                row, at, keeper = row[gone], place[gone] >> 1, keeper[gone]
                order = np.lexsort((at, row))
                yield row[order], at[order], keeper[order]


class _JoinUp:
    """Columns (_row, at, keeper_row) by row and place in, columns (_row, from_word, n_words, keeper_row) of neighbours joined out."""

    def __init__(self, run: int):
        self.run, self.last = run, None

    def __call__(self, row, at, keeper):
        begin = at
        if self.last is not None:
            row, at, keeper, begin = (np.append(np.array([x], c.dtype), c) for x, c in zip(self.last, (row, at, keeper, begin)))
        start = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + self.run)]))[0]
        end = np.append(start[1:], len(at)) - 1
        row, at, keeper, begin = row[start], at[end], keeper[start], begin[start]
        self.last = row[-1], at[-1], keeper[-1], begin[-1]
        if len(row) > 1:
            yield row[:-1], begin[:-1], (at + self.run - begin)[:-1], keeper[:-1]

    def finish(self):
        if self.last is not None:
            row, at, keeper, begin = self.last
            yield [row], [begin], [at + self.run - begin], [keeper]


def _by_columns(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` whose worker takes and yields whole columns; no column holds nulls."""
    shape = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(shape)
        work = make()

        def told(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            if batch.num_rows:
                for columns in work(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                    yield told(columns)
        for columns in work.finish():
            yield told(columns)

    return df.mapInArrow(run, shape)


def stretches(found: DataFrame, run: int = RUN) -> DataFrame:
    """(_row, from_word, n_words, keeper_row) of the windows that stand at an earlier place, neighbours joined."""
    buckets = max(64, found.count() // BUCKET)
    dealt = _by_columns(found.select("h", "_row", "at", "first"), lambda: _DealWindows(buckets, run),
                        "bucket int, h binary, rows binary, places binary")
    gone = _batches(dealt.repartition("bucket").sortWithinPartitions("bucket"), _Earlier, "_row long, at int, keeper_row long")
    gone = gone.repartition("_row").sortWithinPartitions("_row", "at")
    return _by_columns(gone, lambda: _JoinUp(run), "_row long, from_word int, n_words int, keeper_row long")


def asked_rows(copies: DataFrame, anchors_: DataFrame) -> DataFrame:
    """What ``look_again`` wants for the runs."""
    none = F.lit(None)
    return (anchors_.select("block", none.cast("long").alias("_row"), none.cast("int").alias("unit"), "value")
            .unionByName(copies.select(block_of("_row"), "_row", none.cast("int").alias("unit"), none.cast("long").alias("value"))))


def repeated_runs(rows: DataFrame, signs: bytes, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(_row, from_word, n_words, keeper_row): the stretches of ``rows`` that an earlier row, or an earlier place of the row, has.

    Every ``run`` words that stand at an earlier place count, without overlap
    inside a row. Needs ``_row`` in the order of the rows, and text. ``signs``
    is the table that turns a text into its words. A copy of a whole row of at
    least ``run`` words is one stretch.
    """
    def sketch(batch):
        for row, text in batch:
            words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(signs).split())
            if len(words) >= run:
                yield row, whole_hash(words), len(words), anchors(words, run, gram)[1].tobytes()

    told = cut_lineage(map_rows(rows.select("_row", "text"), sketch, "_row long, whole long, n_words int, anchors binary"))
    copies, spots = copies_and_anchors(told)
    found = cut_lineage(look_again(rows, asked_rows(copies, spots), signs, run=run, gram=gram)).drop("shingles")
    return copies.unionByName(stretches(found, run))


def byte_spans(data: bytes, stretches, signs: bytes) -> list[tuple[int, int]]:
    """Byte ranges of (from_word, n_words) stretches, each with the signs and blanks behind its last word."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(signs))]
    out = []
    for at, n in stretches:
        end = _TAIL.match(data, words[at + n - 1][1]).end()
        out.append((words[at][0], min(end, words[at + n][0]) if at + n < len(words) else end))
    return out
