"""Language identification with a string kernel.

The kernel of two texts is the cosine of their sets of character n-grams of
one to three letters (a blended presence spectrum). Landmark texts give a
Nyström map, kernel ridge regression gives one score per language, and both
fold into one matrix: presence vectors (texts x n-grams) times (n-grams x
languages), divided by the size of each text's set.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, cut_lineage, map_rows

BUCKETS = 1 << 13
SIZES = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-3
PIECE = 1 << 18  # characters looked at together


def present(text: str) -> tuple[np.ndarray, bool]:
    """Which hashed n-grams the whole text holds, and whether it has a letter.

    Letters are lower-cased, everything else counts as one blank.
    """
    found = np.zeros(BUCKETS, bool)
    letters = False
    lowered = text.lower()
    for start in range(0, len(lowered), PIECE):
        part = lowered[max(0, start - max(SIZES) + 1):start + PIECE]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        high = code > 127
        letter = ((code >= 97) & (code <= 122)) | high
        if high.any():
            signs = {c: c.isalpha() for c in set(part) if ord(c) > 127}
            none = np.array([ord(c) for c, alpha in signs.items() if not alpha], np.uint64)
            if len(none):
                letter &= ~np.isin(code, none)
        letters = letters or bool(letter.any())
        code = np.where(letter, code, np.uint64(32))
        for n in SIZES:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + code[i:len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found[h & np.uint64(BUCKETS - 1)] = True
    return found, letters


class KernelModel:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, sets: np.ndarray) -> np.ndarray:
        """One column per language for a batch of presence vectors."""
        size = np.sqrt(np.maximum(sets.sum(axis=1, dtype=np.float32), 1.0))
        return (sets.astype(np.float32) @ self.weights) / size[:, None]


def fit_kernel(sets: np.ndarray, langs: list[str], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression on Nyström features of the first ``per_language`` presence vectors of each language."""
    languages = sorted(set(langs))
    if not languages:
        return KernelModel(["und"], np.zeros((BUCKETS, 1), np.float32))
    sets = sets.astype(np.float32)
    unit = sets / np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1.0))
    seen: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(langs):
        if seen.setdefault(lang, 0) < per_language:
            marks.append(i)
            seen[lang] += 1
    landmarks = unit[marks].astype(float)
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = (unit.astype(float) @ landmarks.T) @ whiten
    target = np.array([[1.0 if lang == known else -1.0 for known in languages] for lang in langs])
    share = np.array([1.0 / langs.count(lang) for lang in langs])[:, None]  # each language weighs the same
    coef = np.linalg.solve((z * share).T @ z + ridge * np.eye(z.shape[1]), (z * share).T @ target)
    return KernelModel(languages, (landmarks.T @ (whiten @ coef)).astype(np.float32))


def train_language(docs: DataFrame, held_out: int = 5, per_language: int = SAMPLE_PER_LANGUAGE) -> KernelModel:
    """Fit on at most ``per_language`` ids of each language, in hash order, outside the held-out ids.

    The ids are chosen first from the narrow columns and sent to the rows. Each chosen (id, language) has
    one text, of several the least; its n-grams are looked up where it lies and come to the driver as
    ``BUCKETS`` bits, so what is collected does not grow with texts or with repeated ids.
    """
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (docs.select("doc_id", "lang")
              .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), held_out) != 0)).distinct()
              .withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_language).select("doc_id", "lang"))
    texts = (docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).join(F.broadcast(cut_lineage(chosen)), ["doc_id", "lang"])
             .groupBy("lang", "doc_id").agg(F.min("text").alias("text")))

    def look_up(rows):
        for lang, doc_id, text in rows:
            yield lang, doc_id, np.packbits(present(text)[0]).tobytes()

    rows = sorted(tuple(r) for r in map_rows(texts, look_up, f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits binary").collect())
    sets = np.array([np.unpackbits(np.frombuffer(bits, np.uint8)) for _, _, bits in rows]).reshape(len(rows), BUCKETS)
    return fit_kernel(sets, [lang for lang, _, _ in rows])


def identify_language(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Needs doc_id, text and, for learning, lang. A null text or one without
    letters is ``und`` with score 0; repeated rows are each judged; of equal scores the
    language first in order is taken; without a labelled row everything is ``und``; an empty table gives an empty result.
    One narrow pass over whole texts; the model is n-grams x languages.
    """
    model = train_language(docs, **options)

    def work(rows):
        rows = list(rows)
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            sets = np.zeros((len(part), BUCKETS), bool)
            has_letters = []
            for i, (_, _, text) in enumerate(part):
                sets[i], letters = present(text or "")
                has_letters.append(letters)
            scores = model.scores(sets)
            best = scores.argmax(axis=1)
            for i, (doc_id, held_out, _) in enumerate(part):
                if has_letters[i]:
                    yield doc_id, held_out, model.languages[best[i]], float(np.clip((scores[i, best[i]] + 1.0) / 2.0, 0.0, 1.0))
                else:
                    yield doc_id, held_out, "und", 0.0

    return map_rows(docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), work,
                    "doc_id long, held_out boolean, lang_pred string, score double")
