"""Document likelihood over all subword segmentations, backed by corpus counts.

The pieces of an existing vocabulary and their scores weight every way to cut
a word; a log-space forward recursion adds them up to the word's probability.
Counts of the training part are smoothed towards it.
"""
from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_row
from .common import LOWER, crc_bucket, cut_lineage, map_rows

POSTINGS = 2_000_000  # (word, document) pairs that a task holds before it hands them on
END = ""  # no word is empty, so the end of a text can stand for itself
BYTE_SHARE = 1e-3  # probability of leaving the vocabulary for one raw byte


class Lattice:
    """Natural-log piece probabilities of a sentencepiece vocabulary file.

    The file's scores of merged pieces are minus their rank, so a piece weighs
    1 / (1 - score) before all weights are scaled to add up to one. A word is a
    piece that starts with the word mark and then pieces without it, so word
    probabilities also add up to one.
    """

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            usual = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            if usual and "▁" not in piece[1:]:
                weights[piece] = 1.0 / (1.0 - min(0.0, model.get_score(i)))
        total = sum(weights.values())
        self.log = {p: math.log((1 - BYTE_SHARE) * w / total) for p, w in weights.items()}
        self.byte = math.log(BYTE_SHARE / 256)
        self.longest = max(map(len, weights), default=1)

    def word(self, word: str) -> float:
        """log10 of the probability of ``word``, all segmentations together."""
        text = "▁" + word
        get, exp, log = self.log.get, math.exp, math.log
        forward = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                p = get(text[i:j])
                if p is not None and forward[i] != -math.inf:
                    terms.append(forward[i] + p)
            if get(text[j - 1]) is None:  # a sign outside the vocabulary goes byte by byte
                terms.append(forward[j - 1] + self.byte * len(text[j - 1].encode("utf-8", "surrogatepass")))
            if len(terms) == 1:
                forward[j] = terms[0]
            elif terms:
                top = max(terms)
                forward[j] = top + log(sum([exp(t - top) for t in terms])) if top != -math.inf else top
        return forward[-1] / math.log(10)


class _Postings:
    """Inverts the documents of one task, a bounded block at a time."""

    def __init__(self):
        from pyspark import TaskContext
        self.block = TaskContext.get().partitionId() << 24
        self.clear()

    def clear(self):
        self.places: dict[tuple, list] = {}
        self.trained: Counter = Counter()
        self.ids: list = []
        self.held = 0
        self.block += 1

    def __call__(self, rows):
        for doc_id, train, text in rows:
            words = Counter((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
            at = len(self.ids)
            self.ids.append(doc_id)
            for w, n in words.items():
                self.places.setdefault((w, n), []).append(at)
            if train:
                self.trained.update(words)
                self.trained[b""] += 1
            self.held += len(words) + 1
            if self.held >= POSTINGS:
                yield from self.flush()

    def flush(self):
        if self.ids:
            yield self.block, END, 1, self.trained.pop(b"", 0), list(range(len(self.ids))), self.ids
        for (w, n), at in self.places.items():
            yield self.block, w.decode("utf-8", "replace"), n, self.trained.pop(w, 0), at, None
        self.clear()

    def finish(self):
        yield from self.flush()


def score_documents(docs: DataFrame, vocabulary: str, held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Needs doc_id and text; other columns are not read. Null, empty and blank
    texts have the end token only; repeated rows are each scored; a null id is
    hashed as empty text; an empty table gives an empty result, and without
    training documents all counts are 0. ``base_score`` is the add-0.1 count
    model; ``score`` gives a token (c + V * p) / (N + V + 1) with p its lattice
    probability (1 / V for the end). Words are pre-counted per block of
    documents before any shuffle, so the commonest word has one row per block
    and use count, and no row grows past a block. ``vocabulary`` is read on
    every executor.
    """
    def make():
        lattice = Lattice(vocabulary)

        def work(rows):
            for word, c in rows:
                yield word, c, 0.0 if word == END else lattice.word(word)

        return work

    make.per_task = True
    invert = lambda: _Postings()
    invert.per_task = True
    train = crc_bucket(F.col("doc_id"), held_out) != 0
    postings = cut_lineage(map_rows(docs.select("doc_id", train.alias("train"), "text"), invert,
                                    "block long, word string, tf int, train_c long, ords array<int>, ids array<long>"))
    totals = postings.groupBy("word").agg(F.sum("train_c").alias("c"))
    totals = cut_lineage(map_rows(totals, make, "word string, c long, logp double", rows=16384))
    sums = cut_lineage(totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("types")))
    known = postings.join(totals, "word").select("block", "word", "tf", "c", "logp", "ords", "ids")
    known = with_row(known, sums, "tokens", "types")
    spread = F.greatest("types", F.lit(1)).cast("double")
    model = (F.when(F.col("word") == END, F.log10(F.col("c") + 1.0))
             .when(F.col("c") == 0, F.log10(spread) + F.col("logp"))
             .otherwise(F.log10(F.col("c") + spread * F.pow(F.lit(10.0), "logp"))))
    valued = known.select("block", "tf", (F.col("c") > 0).alias("seen"), F.log10(F.col("c") + 0.1).alias("base"), model.alias("model"), "ords", "ids")
    by_block = valued.repartition("block")
    each = by_block.select("block", "tf", "seen", "base", "model", "ids", F.posexplode("ords").alias("i", "ord"))
    per_doc = each.groupBy("block", "ord").agg(
        F.max(F.get("ids", F.col("i"))).alias("doc_id"), F.sum("tf").alias("n_tokens"), F.sum(F.when(F.col("seen"), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("tf") * F.col("base")).alias("base"), F.sum(F.col("tf") * F.col("model")).alias("model"))
    out = with_row(per_doc, sums, "tokens", "types")
    floor = F.log10(F.col("tokens") + 0.1 * (F.col("types") + 1))
    smooth = F.log10(F.col("tokens") + F.greatest("types", F.lit(1)) + 1.0)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), held_out) == 0).alias("held_out"), "n_tokens", "n_known",
                      F.col("tokens").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"),
                      (F.col("model") - F.col("n_tokens") * smooth).alias("score"))
