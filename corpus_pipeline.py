"""The training-data pipeline: five stages over the documents, each read from what the one before wrote.

toxicity -> near-duplicates -> substring dedup -> benchmark
decontamination -> mixing. Columns beyond those of documents are dropped at
the first stage; the last one adds what the mix takes of each document.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulstat.llm import decontaminate, mixing, near, passages, toxicity
from haulstat.llm.common import cut_lineage, table
from haulstat.session import drop_tables, written_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The verdict stands beside the row, so nothing is joined."""
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (five-word Jaccard of 0.8 or more)."""
    return near.first_of_near_copies(docs, COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences and lines that an earlier document has already."""
    return passages.without_repeats(docs, COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, each judged by its own text whatever its id; equal texts are judged alike."""
    rows = docs.select(*COLUMNS).withColumn("_row", F.coalesce(F.md5("text"), F.lit("")))
    leaks = decontaminate.leaking_rows(rows, table(spark, sf_dir, "benchmark"))
    return rows.join(cut_lineage(leaks.select("_row").distinct()), "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the words it takes of each (repeats counted)."""
    return mixing.take_mix(docs, COLUMNS)


_LEFT: list[str] = []  # tables that the last stage wrote on its way


def staged(stage):
    """``stage``, dropping first what the stage before it wrote on its way, unless ``docs`` is still read from there.

    The rows a stage returns are written before the next one is called, so
    its own tables have no reader by then, and the shared folder holds one stage's at a time.
    One pipeline at a time may run in a process.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LEFT else []
        if not any(path.rsplit("/", 1)[-1] in file for path in _LEFT for file in read):
            drop_tables(spark, _LEFT)
        before = set(written_tables())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [path for path in written_tables() if path not in before]
        return out

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("toxicity", staged(drop_toxic)),
    ("simhash_near_dedup", staged(one_of_each)),
    ("substring_dedup", staged(cut_repeats)),
    ("benchmark_decontamination", staged(drop_leaks)),
    ("source_mixing", staged(mix)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again; a stage's rows go once the next one's are written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        before = set(written_tables())
        docs = cut_lineage(out)
        drop_tables(spark, last)
        last = [path for path in written_tables() if path not in before]
    return docs
