"""Mixing sources to target weights with columns only.

Every document gets a hash-random key. Documents are range-sorted by key
within their source, a distributed prefix sum counts the words before each,
and the source is cut at its exact budget, after as many whole epochs as fit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_row
from .common import WORD, cut_lineage, running_totals

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, its rank, source_size, target) for sized documents.

    Sources in code-point order, null last, take ``weights`` in turn and share
    all words. A target stops at ``most`` times its source's size; the excess
    goes to the others by weight until none is above. Sorted by size per
    weight, the capped sources come first, so the last share of a weight is
    found from running sums instead of rounds. Integers until the last division.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = running_totals(sources.withColumn("_one", F.lit(1)), [], [F.col("_null"), F.col("source")], {"_rank": "_one"})
    turns = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(turns, (F.col("_rank") % len(weights)).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    sorted_ = running_totals(ranked.select("source", "source_size", "_rank", "_w", "_cap"), [],
                             [F.col("source_size") / F.col("_w"), F.col("_rank")], {"_caps": "_cap", "_ws": "_w"})
    sorted_ = cut_lineage(sorted_)
    both = with_row(sorted_, sorted_.agg(F.sum("source_size").alias("_total"), F.sum("_w").alias("_weights")), "_total", "_weights")
    wide = lambda c: c.cast("decimal(19,0)")
    both = both.withColumn("_num", F.col("_total") - F.col("_caps")).withColumn("_den", F.col("_weights") - F.col("_ws"))
    both = both.withColumn("_capped", wide(F.col("_cap")) * wide(F.col("_den")) <= wide(F.col("_num")) * wide(F.col("_w")))
    first = both.where(~F.col("_capped")).agg(F.max(F.struct("_den", "_num")).alias("first"))
    first = first.select(F.col("first._num").alias("_fn"), F.col("first._den").alias("_fd"))
    both = with_row(both, first, "_fn", "_fd")
    share = F.col("_fn").cast("double") * F.col("_w") / F.col("_fd").cast("double")
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share)
    return both.select("source", "_rank", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are not read. A null
    or empty text has size 0 and takes 0; a null source is a source of its own;
    a null id is hashed as empty text. Repeated rows each count. Equal keys are
    ordered by id and size, so reruns agree whatever the partitions. ``taken``
    counts words, repeats included: the budget of a source is its target
    rounded, whole epochs come first, and the document on the cut is taken in
    part. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key")))
    targets = cut_lineage(source_targets(sized, weights, most))
    placed = sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select(
        "doc_id", "d.source", "size", "_key", "_rank", "source_size", "target")
    placed = running_totals(placed, ["_rank"], [F.col("_key"), F.col("doc_id"), F.col("size")], {"_before": "size"})
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def take_mix(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with size, target and taken.

    Joined by id, source and size; a null id meets null ids. Rows that repeat
    an id, source and size share what the mix takes of them evenly enough for
    the budget: their takes are added up and each row carries the mean.
    """
    taken = (mix_sources(docs, **options).groupBy("doc_id", "source", "size")
             .agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.avg("taken").cast("long").alias("taken"))
             .where("taken > 0"))
    sized = docs.select(*columns).withColumn("size", word_count(F.col("text")))
    both = sized.alias("d").join(taken.alias("t"), F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source and d.size = t.size"))
    return both.select(*[f"d.{c}" for c in columns], "d.size", "t.source_size", "t.target", "t.taken")
