"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A document is tokenised where it is read and packed there: a task gathers a
window of documents, opens as many sequences as their tokens fill exactly, and
deals the documents, the costliest first, to the cheapest sequence that still
holds them. Only when no sequence does is a document cut. Nothing is shuffled,
a window's size does not depend on the input, and a lost task packs the same
window again.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ROW_BITS, map_rows

CAPACITY = 4096
END = 2
WINDOW = 512  # sequences that are packed together
LINEAR, QUADRATIC = 1.0, 1.0 / 24_576  # attention over projections: length / (6 x a width of 4,096)
KNOWN = 800_000  # words a task remembers
# A letter of one case-folded form that no neighbour but a combining mark changes.
HEAD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)")


class Words(dict):
    """Ids of texts from a tokenizer that drops white space and marks the ends of words.

    Such a tokenizer gives a text the ids of its words one after the other, so every
    distinct word is tokenised once and remembered. Of a word that begins with plain
    letters these are normalised letter by letter with the tokenizer's own steps and
    given to its model alone; the rest, and any other word, goes through the whole
    tokenizer. A text that may hold a special token is tokenised whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.heads: dict[str, bytes] = {}  # by their letters as the model takes them
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = [chr(c) for c in range(256) if HEAD.fullmatch(chr(c))]
        self.letters = {ord(c): steps[1].pre_tokenize_str(steps[0].normalize_str(c))[0][0] for c in letters}

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if b"<|" in text:
            return self.whole(text.decode())
        if len(self) > KNOWN:
            self.clear(), self.heads.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        plain = word.decode()
        found = HEAD.match(plain)
        if found:
            letters = plain[:found.end()].translate(self.letters)
            ids = self.heads.get(letters)
            if ids is None:
                tokens = [t.id for t in self.model.tokenize(letters)]
                ids = self.heads[letters] = pack(f"<{len(tokens)}I", *tokens)
            if found.end() < len(plain):
                ids += self[plain[found.end():].encode()]
        else:
            ids = self.whole(plain)
        self[word] = ids
        return ids


def rooms(tokens: int, capacity: int) -> list[int]:
    """Sequence lengths that ``tokens`` fill without padding: full ones, then falling powers of two."""
    left = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def assign(lengths: list[int], sizes: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, its start, length, sequence, offset there) for documents dealt to sequences of ``sizes``, which hold them all.

    Costs are ``linear * n + quadratic * n ** 2`` for each piece. The longest document comes next
    (of equal ones the first); it goes to the cheapest sequence with room for all of it, or, where
    there is none, fills the cheapest one with any room and goes on with the rest. Of equally
    cheap sequences the first takes it.
    """
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    cheapest = [(0.0, k) for k in range(len(sizes))]
    queue = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(queue)
    out = []
    while queue:
        length, k, start = heapq.heappop(queue)
        length = -length
        while cheapest[0][0] != cost[cheapest[0][1]] or not room[cheapest[0][1]]:
            heapq.heappop(cheapest)  # an older price, or a full sequence
        at, part = cheapest[0][1], length
        if room[at] < length:
            fits = np.where(room >= length, cost, np.inf)
            best = int(fits.argmin())
            if fits[best] < np.inf:
                at = best
            else:
                part = int(room[at])
        out.append((k, start, part, at, sizes[at] - int(room[at])))
        room[at] -= part
        cost[at] += linear * part + quadratic * part * part
        heapq.heappush(cheapest, (float(cost[at]), at))
        if part < length:
            heapq.heappush(queue, (part - length, k, start + part))
    return out


class _Packer:
    """Rows (doc_id, text) in, pieces out, a window at a time; sequences are numbered from the task's number."""

    def __init__(self, spec: str, capacity: int, end: int, window: int, linear: float, quadratic: float):
        self.words, self.capacity, self.most = tokeniser(spec), capacity, capacity * window
        self.end, self.costs = np.array([end], "<u4").tobytes(), (linear, quadratic)
        self.sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << ROW_BITS
        self.held: list[tuple] = []
        self.tokens = 0

    def __call__(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            ids = self.words.ids(text or b"") + self.end
            total = len(ids) // 4
            start = total - total % self.capacity
            for at in range(0, start, self.capacity):  # fills a sequence alone
                yield doc_id, at, self.capacity, ids[4 * at:4 * (at + self.capacity)], total, self.sequence, 0
                self.sequence += 1
            if start < total:
                self.held.append((doc_id, start, ids[4 * start:], total))
                self.tokens += total - start
            if self.tokens >= self.most:
                yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        sizes = rooms(self.tokens, self.capacity)
        for k, start, length, at, offset in assign([len(h[2]) // 4 for h in self.held], sizes, *self.costs):
            doc_id, base, ids, total = self.held[k]
            yield doc_id, base + start, length, ids[4 * start:4 * (start + length)], total, self.sequence + at, offset
        self.sequence += len(sizes)
        self.held, self.tokens = [], 0


_TOKENISERS: dict[int, Words] = {}


def tokeniser(spec: str) -> Words:
    """One for each Python worker, with the words it knows already."""
    key = hash(spec)
    if key not in _TOKENISERS:
        _TOKENISERS.clear()
        _TOKENISERS[key] = Words(spec)
    return _TOKENISERS[key]


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, window: int = WINDOW,
                   linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of each row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file that drops white space and marks ends of
    words; the driver reads it and sends it along (about two MB). A document is its ids and
    then ``end``; ``ids`` are those of the piece as little-endian unsigned 32-bit numbers. No
    sequence is longer than ``capacity``, and every one is full or a power of two long, so
    nothing is padded where a power of two needs no padding. ``capacity`` should be one itself.

    A document of ``capacity`` tokens or more first fills sequences of its own; what is left is
    packed in windows of about ``window`` sequences, the size that bounds a task's memory. A null
    or empty text is its end alone; rows with a null id and repeated rows are documents like any
    other; of ties the first read comes first. Only doc_id and text are read. An empty table gives
    no rows. Sequence ids are unique within one run over one reading of the rows, not dense.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        return _Packer(spec.value, capacity, end, window, linear, quadratic)

    make.per_task = True
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", docs["text"].cast(T.BinaryType()).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
