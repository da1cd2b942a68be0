"""Quality rules: counted base rules, then monotonic gradient-boosted trees over document statistics."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .trees import FlatTrees, fit_trees

MOST_LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "mark_share", "digit_share", "upper_share", "top_word_share"]
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0, 0, 0]  # more symbols, repeated lines or repeated windows never help
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> tuple[int, int, int]:
    """(words in 3-word windows found twice or more, distinct words, uses of the commonest word)."""
    n = len(words)
    if not n:
        return 0, 0, 0
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    most = int(np.bincount(ids).max())
    if n < 3:
        return 0, len(place), most
    pair = ids[:-2] * len(place) + ids[1:-1]
    if len(place) > 1 << 20:  # three ids would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * len(place) + ids[2:]
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[back] >= 2
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum()), len(place), most


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly space and 0x09-0x0D
    chars = len(text or "") - sum(data.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = sum(data.count(c) for c in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat, distinct, most = repeated_words(words)
    n, size = max(1, len(words)), max(1, chars)
    marks = sum(data.count(c) for c in b".,;:!?")
    digits = sum(data.count(c) for c in b"0123456789")
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    features = [float(np.log1p(len(words))), chars / n, symbols / n, dup_lines / max(1, len(lines)), repeat / n, distinct / n,
                marks / n, digits / size, upper / size, most / n]
    return [len(words), chars, symbols, dup_lines, repeat], features


def labelled_features(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(quality, features) of at most ``most`` labelled ids, taken in hash order; an id of several texts has the least features."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def work(rows):
        for doc_id, quality, text in rows:
            yield doc_id, float(quality), statistics(text)[1]

    told = map_rows(rows, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, features array<double>")
    return told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")).select("quality", "features")


def train_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> FlatTrees:
    """Trees from a bounded sample (``most`` labelled ids); only their features reach the driver."""
    rows = labelled_features(docs, labels, most).collect()
    rows.sort(key=lambda r: (r.quality, r.features))
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r.quality for r in rows], float), MONOTONE)


def judge_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, cut: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    Needs doc_id and text; other columns are not read. A null text counts as
    empty and fails the base rules; repeated rows are each judged; without
    labels every document that passes the base rules is kept (score 0.5); an
    empty table gives an empty result. Documents labelled twice take their
    lower quality. One narrow pass, no shuffle of text.
    """
    model = train_quality(docs, labels, most)

    def work(rows):
        ids, counts, features = [], [], []
        for doc_id, text in rows:
            c, f = statistics(text)
            ids.append(doc_id), counts.append(c), features.append(f)
        if ids:
            scores = model.probability(np.array(features, float))
            for doc_id, c, score in zip(ids, counts, scores):
                failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
                yield (doc_id, *c, failed, float(score), bool(not failed and score >= cut))

    return map_rows(docs.select("doc_id", "text"), work,
                    f"doc_id long, {STATISTICS}, base_failed boolean, score double, kept boolean")
