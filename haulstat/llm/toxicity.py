"""Toxicity: a word classifier whose score may not move when identity terms are swapped."""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_bucket, cut_lineage, map_rows
from .linear import SparseRows, fit_logistic, sigmoid

MOST_LABELLED = 12_000
PAIR_WEIGHT = 4.0
L2 = 1e-4
STEMS = (6, 7)  # bytes
LEAST_Z = 4.0  # how far, in standard errors, a word's share of toxic texts must be from the average to get a weight

# Groups of identity terms; within a group any term may stand for any other.
IDENTITY_GROUPS = [
    "women men girls boys", "woman man girl boy", "gay straight lesbian bisexual transgender", "black white asian latino arab",
    "christian muslim jewish hindu buddhist atheist", "christians muslims jews hindus buddhists atheists",
    "immigrants refugees foreigners natives", "frauen männer mädchen jungen", "christen muslime juden",
    "femmes hommes filles garçons", "chrétiens musulmans juifs", "mujeres hombres niñas niños", "cristianos musulmanes judíos",
]
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
_SENTENCE = re.compile(rb"[^.!?\n]+")


def swaps() -> dict[bytes, list[bytes]]:
    """Each identity term with the other terms of its group."""
    out: dict[bytes, list[bytes]] = {}
    for group in IDENTITY_GROUPS:
        terms = [t.encode() for t in group.split()]
        for t in terms:
            out[t] = [o for o in terms if o != t]
    return out


def tokens(data: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, cut at every ASCII sign that is no letter or digit."""
    return data.translate(_KEEP).split()


def features(words: list[bytes]) -> list[bytes]:
    """The words and, for inflected languages, the stems that longer words begin with (marked by a leading ``^``)."""
    return words + [b"^" + w[:n] for n in STEMS for w in words if len(w) > n]


def counterfactuals(data: bytes, table: dict[bytes, list[bytes]]) -> list[tuple[list[bytes], list[bytes]]]:
    """(sentence, sentence with identity terms swapped) for each sentence that names a group."""
    out = []
    for found in _SENTENCE.finditer(data):
        words = tokens(found[0])
        if any(w in table for w in words):
            for turn in range(2):
                out.append((words, [table[w][turn % len(table[w])] if w in table else w for w in words]))
    return out


class ToxicModel:
    """Word places, their weights and the intercept. A word counts log(1 + uses), so one stray use stays below two."""

    def __init__(self, place: dict[bytes, int], weights: np.ndarray, bias: float):
        self.place, self.weights, self.bias = place, weights, bias

    def score(self, text: str | None) -> float:
        get = self.place.get
        hits = Counter(i for w in features(tokens((text or "").encode("utf-8", "surrogatepass"))) if (i := get(w)) is not None)
        if not hits:
            return float(sigmoid(np.array(self.bias)))
        index = np.fromiter(hits.keys(), np.int64, len(hits))
        return float(sigmoid(np.log1p(np.fromiter(hits.values(), float, len(hits))) @ self.weights[index] + self.bias))


def _hits(words: list[bytes], place: dict[bytes, int]) -> tuple[list[int], list[int]]:
    uses = Counter(place[w] for w in features(words) if w in place)
    return list(uses.keys()), list(uses.values())


def telling_words(sample: DataFrame, least_z: float) -> list[bytes]:
    """Features that tell the labels of the sampled texts apart by ``least_z`` standard errors, counted in Spark."""
    def words(rows):
        for text, label in rows:
            for w in set(features(tokens(text.encode("utf-8", "surrogatepass")))):
                yield w, label

    n, share = sample.agg(F.count("*"), F.avg("toxic")).first()
    if not n or not 0.0 < share < 1.0:
        return []
    counted = map_rows(sample, words, "word binary, toxic double").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    far = F.abs(F.col("toxic") - F.col("n") * share) >= least_z * F.sqrt(F.col("n") * share * (1 - share))
    return sorted(bytes(r.word) for r in counted.where(far).select("word").collect())


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, held_out: int = 5, least_z: float = LEAST_Z,
                   pair_weight: float = PAIR_WEIGHT) -> ToxicModel:
    """Fit on at most ``most`` labelled ids, in hash order, whose crc32 modulo ``held_out`` is not 0.

    Texts are made distinct, so a group of copies is one vote with the mean
    label. Words are counted in Spark; only the telling words, each text's uses
    of them and the swapped sentences' uses reach the driver.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_bucket(F.col("doc_id"), held_out) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    sample = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
              .groupBy("text").agg(F.avg("toxic").alias("toxic")))
    sample = cut_lineage(sample)
    table = swaps()
    place = {w: i for i, w in enumerate(sorted({*telling_words(sample, least_z), *table}))}

    def uses(rows):
        for text, label in rows:
            data = text.encode("utf-8", "surrogatepass")
            yield (label, *_hits(tokens(data), place), None, None)
            for one, other in counterfactuals(data, table):
                yield (None, *_hits(one, place), *_hits(other, place))

    rows = map_rows(sample, uses, "label double, index array<int>, uses array<int>, other array<int>, other_uses array<int>").collect()
    rows = sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0], r[1:3], r[3] or [], r[4] or []))
    made = lambda pairs: SparseRows([(np.array(i, np.int64), np.log1p(np.array(u, float))) for i, u in pairs], len(place))
    fitted = [r for r in rows if r[0] is not None]
    swapped = [r for r in rows if r[0] is None]
    weights, bias = fit_logistic(made([r[1:3] for r in fitted]), np.array([r[0] for r in fitted], float), L2, steps=500,
                                 pairs=(made([r[1:3] for r in swapped]), made([r[3:5] for r in swapped])), pair_weight=pair_weight)
    return ToxicModel(place, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Needs doc_id and text; other columns are not read. Null and empty texts
    have the score of the intercept; repeated rows are each scored; with no
    labels every score is that of an untrained intercept (below 0.5); an empty
    table gives an empty result. One narrow pass over whole texts.
    """
    model = train_toxicity(docs, labels, **options)

    def work(rows):
        for doc_id, held_out, text in rows:
            score = model.score(text)
            yield doc_id, held_out, score, int(score >= 0.5)

    return map_rows(docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), work,
                    "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns as they are. The score is a column expression beside the row."""
    model = train_toxicity(docs, labels, **options)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd
        return pd.Series([model.score(t) for t in text], dtype=float)

    return docs.where(score(F.col("text")) < 0.5)
