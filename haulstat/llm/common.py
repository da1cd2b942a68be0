"""What several operators of this folder share."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, small_table  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_bucket(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str,
             rows: int = 2048) -> DataFrame:
    """``mapInArrow`` over row tuples. ``fn`` gets the tuples of one batch and yields output tuples.

    Output leaves in batches of at most ``rows`` rows, so a batch of long texts
    never doubles in memory. With the attribute ``per_task`` set, ``fn`` is called
    once in each task to make the function; its method ``finish`` may yield last rows.
    """
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(parsed)
        work = fn() if getattr(fn, "per_task", False) else fn
        held: list[tuple] = []
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                piece = batch.slice(part, 1024)
                columns = [c.to_pylist() for c in piece.columns]
                for row in work(zip(*columns)):
                    held.append(row)
                    if len(held) >= rows:
                        yield arrow_rows(held, shape)
                        held = []
        if hasattr(work, "finish"):
            held.extend(work.finish())
        for at in range(0, len(held), rows):
            yield arrow_rows(held[at:at + rows], shape)

    parsed = T._parse_datatype_string(schema)
    return df.mapInArrow(run, parsed)


def arrow_rows(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, shape)], schema=shape)


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """For each row the sums over the rows before it in ``order`` within its ``by`` group.

    ``sums`` maps an output name to the column to sum. A range shuffle on
    (by, order) sorts the rows across tasks, so a group of any size is spread;
    the sorted slices are written once, slice sums are added up over the few
    slices, and each slice adds its own running sum. Columns only, no UDF.
    """
    spread = [F.col(c) for c in by] + list(order)
    sliced = (df.repartitionByRange(*spread).sortWithinPartitions(*spread)
              .withColumn("_at", F.monotonically_increasing_id()))
    sliced = cut_lineage(sliced).withColumn("_slice", F.shiftright("_at", ROW_BITS))
    keys = by or ["_all"]
    if not by:
        sliced = sliced.withColumn("_all", F.lit(0))
    parts = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_slice", *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = sliced.join(parts, [*keys, "_slice"])
    out = out.withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return out.drop("_at", "_slice", "_all", *[f"_b_{n}" for n in sums])
