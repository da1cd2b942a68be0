"""How far the sources of a language lie apart, from exact term counts.

Count vectors: each language's vocabulary is every term in at least
``MIN_DOCS`` of its documents, without an upper size; a document's sparse
vector is its term counts. The vectors are summed by (language, source) where
they are made and again in Spark, so vocabulary and vectors stay distributed
tables and no vocabulary meets the driver. Pairs of sources are evaluated
sparsely: a term that a source lacks has one value for the whole source, so
only terms that both sources have are looked at pair by pair.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
HELD = 400_000  # terms of groups that a task adds up before it hands them on
SENT = 10 << 20  # bytes of groups that are sent to the tasks; more of them meet their counts by (lang, source)
# Bytes outside a term become blanks, A-Z become a-z; bytes of other code points stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def count_terms(batches):
    """Batches (lang, source, text) in, batches (lang, source, term, n, docs) out; a null term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on():
        for (lang, source), (totals, docs) in groups.items():
            terms = list(totals)
            counts = list(totals.values()), [docs[t] for t in terms]
            for at in range(0, len(terms), 10_000):
                part = slice(at, at + 10_000)
                yield rows_of(lang, source, terms[part], counts[0][part], counts[1][part])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (lang, source) not in groups:
                groups[lang, source] = Counter(), Counter()
                yield rows_of(lang, source, [None], [0], [0])
            if not text:
                continue
            totals, docs = groups[lang, source]
            words = text.translate(TERM_BYTES).split()
            before = len(docs)
            totals.update(words)
            docs.update(set(words))
            held += len(docs) - before
            if held > HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def rows_of(lang, source, terms, n, docs) -> pa.RecordBatch:
    size = len(terms)
    return pa.RecordBatch.from_arrays([pa.repeat(lang, size), pa.repeat(source, size), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                      ["lang", "source", "term", "n", "docs"])


def group_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(vectors, groups): (lang, term, all_n, counts) with counts an array of (source, n), and (lang, source) of every group.

    A row is a document. Null text, lang and source read as empty. A term is a run of letters
    A-Z or code points beyond ASCII, A-Z lower-cased; it is kept in a language if at least
    ``min_docs`` of its documents have it. Counts meet by (lang, term) once; a row holds at most
    an entry for each source.
    """
    plain = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast(T.BinaryType()).alias("text"))
    parts = plain.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    rows = cut_lineage(rows.where(F.col("term").isNull() | (F.col("docs") >= min_docs)))
    vectors = rows.where("term is not null").select("lang", F.col("term").cast("string").alias("term"), "all_n", "counts")
    return vectors, rows.where("term is null").select("lang", F.explode("counts.source").alias("source"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), in decimals that cannot overflow."""
    wide = T.DecimalType(38, 0)
    part = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(27,0)"), (total + kept).cast(wide))
    return F.when(total + kept > 0, F.lit(1) + part)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def with_groups(counts: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` joined with the groups' columns; never are the counts sent to the tasks.

    Spark sizes rows made from arrays as the arrays' files, which may be less than the groups' table and
    far less than the rows, so the choice goes by the groups' own bytes, counted.
    """
    size = groups.agg(F.sum(F.lit(64) + sum(F.octet_length(k) for k in keys))).first()[0] or 0
    return counts.join(F.broadcast(groups), keys) if size <= SENT else counts.hint("merge").join(groups, keys)


def weighted_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, values, groups): the terms' counts, each count as (lang, source, term, p, q), and the groups with their totals.

    ``q`` is the language's share. A group has total (its kept terms), kept (the language's vocabulary),
    terms (its part of it) and p0, its share of any kept term that it lacks.
    """
    vectors, groups = group_vectors(docs, min_docs)
    counts = vectors.select("lang", "term", "all_n", F.inline("counts"))
    langs = vectors.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "all_total", "kept"])
    groups = cut_lineage(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"))))
    placed = with_groups(counts, groups.select("lang", "source", "total", "all_total", "kept"), ["lang", "source"])
    values = placed.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    return vectors, values, groups


def pair_values(vectors: DataFrame, values: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of sources of a language the sum of gaps over its whole vocabulary.

    With S and T the terms of source and item, the sum is that over S with the item's p0, plus that
    over T with the source's p0, plus the gap of both p0 for each other term; for terms in both
    this is put right pair by pair, added up before it is shuffled. Equal values of p
    are counted first, so the sums over S and T take a row for each value, not for each term.
    """
    names = groups.where("kept > 0").select("lang", "source", "kept", "terms", "p0")
    other = names.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "terms", "p0")])
    pairs = names.join(other, "lang").where(F.col("source") != F.col("o_source"))
    times = cut_lineage(values.groupBy("lang", "source", "p").agg(F.count("*").alias("times")))
    mine = times.join(other, "lang").where(F.col("source") != F.col("o_source"))
    mine = mine.groupBy("lang", "source", "o_source").agg(F.sum(F.col("times") * gap(F.col("p"), F.col("o_p0"))).alias("mine"))
    theirs = times.withColumnRenamed("source", "o_source").join(names.select("lang", "source", "p0"), "lang").where(F.col("source") != F.col("o_source"))
    theirs = theirs.groupBy("lang", "source", "o_source").agg(F.sum(F.col("times") * gap(F.col("p0"), F.col("p"))).alias("theirs"))
    # A term's sources side by side: pairs are made and added up in one pass, without a join of terms.
    shares = groups.where("kept > 0").select("lang", "source", "total", "kept", "p0")
    both = vectors.select("lang", "counts", F.inline("counts")).select("lang", "source", "n", F.inline("counts").alias("o_source", "o_n"))
    both = both.where("source <> o_source").groupBy("lang", "source", "n", "o_source", "o_n").agg(F.count("*").alias("times"))
    both = with_groups(both, shares, ["lang", "source"])
    both = with_groups(both, shares.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "total", "p0")]), ["lang", "o_source"])
    both = both.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "o_p": share(F.col("o_n"), F.col("o_total"), F.col("kept"))})
    exact, first, second, none = gap(F.col("p"), F.col("o_p")), gap(F.col("p"), F.col("o_p0")), gap(F.col("p0"), F.col("o_p")), gap(F.col("p0"), F.col("o_p0"))
    both = both.groupBy("lang", "source", "o_source").agg(F.sum(F.col("times") * (exact - first - second + none)).alias("both"))
    keys = ["lang", "source", "o_source"]
    out = pairs.join(mine, keys, "left").join(theirs, keys, "left").join(both, keys, "left").na.fill(0, ["mine", "theirs", "both"])
    rest = (F.col("kept") - F.col("terms") - F.col("o_terms")) * gap(F.col("p0"), F.col("o_p0"))
    out = out.select("lang", "source", F.col("o_source").alias("item"), (F.col("mine") + F.col("theirs") + F.col("both") + rest).alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return out.unionByName(bare)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` terms that the
    source has more of than its language, by value falling and item rising in UTF-8 bytes. Values
    are exact whole numbers (10^9 times shares with one added to each count).

    Rows are documents: repeated rows and null or repeated ids count each; ids and other columns are not
    read. Null lang, source and text read as empty; a group without terms is still paired, and a
    language without a kept term gives pairs of value 0. An empty table, and a language of one
    source without terms, give no rows.
    """
    vectors, values, groups = weighted_vectors(docs, min_docs)
    pairs = pair_values(vectors, values, groups)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = values.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
