"""Structured Streaming jobs over run events, photo reads and new listings."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import prices as P
from ..session import shared_folder


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for the state and the sink of one job."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(stream: DataFrame) -> DataFrame:
    """Run an append stream over what is there and read its exactly-once Parquet sink."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    out = f"{folder}/data"
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, key: list[str]) -> DataFrame:
    """Run an update stream: every batch appends its changes, the newest change per key is the table."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    out, schema = f"{folder}/data", stream.schema

    def land(batch: DataFrame, number: int) -> None:
        # Writing into the batch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("batch", T.LongType())])).parquet(out)
    values = [c for c in schema.names if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")


def run_telemetry(events: DataFrame) -> DataFrame:
    """Per run and day: start, last event, stages, errors, whether it finished."""
    return (events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("day"), "run_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("events"),
        F.count_if(F.col("stage") == "error").alias("errors"), F.max((F.col("stage") == "purchase").cast("int")).alias("finished")))


def stage_rates(events: DataFrame) -> DataFrame:
    """Tumbling minute per stage: count, mean duration, error share."""
    return (events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute").alias("minute"), "stage").agg(
        F.count("*").alias("n"), F.avg("duration").alias("mean_duration")))


def idle_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions that have been idle for the gap."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", gap).alias("s"), "run_id").agg(F.count("*").alias("n"))


PART = 256  # read ids of a unit that are kept together, about


class PlanTracker(StatefulProcessor):
    """Rows (unit, read_id, planned, ts) of one unit in; one row when its planned reads have all arrived, one each time it has been overdue.

    The read ids seen are a map of parts of about PART ids, so a batch touches only the parts of those it brings,
    and a unit whose reads come at once touches none; they are dropped when the
    unit completes, and what stays is that it did. A timer says that nothing came for ``patience`` of event time;
    it forgets nothing, so a read that comes later still counts.
    """

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("part", T.IntegerType())]), T.StructType([T.StructField("read_ids", T.ArrayType(T.LongType()))]))
        self.told = handle.getValueState("told", T.StructType([T.StructField("reads", T.LongType()), T.StructField("planned", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("timer", T.LongType()),
                                                               T.StructField("parts", T.IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        reads, planned, done, timer, parts = self.told.get() or (0, 0, False, 0, 0)
        latest, brought = 0, set()
        for row in rows:
            planned = row["planned"]
            latest = max(latest, int(row["ts"].timestamp() * 1000))
            if not done and row["read_id"] is not None:
                brought.add(row["read_id"])
        parts = parts or max(1, -(-planned // PART))
        by_part: dict[int, set] = {}
        for read_id in brought:
            by_part.setdefault(read_id % parts, set()).add(read_id)
        stored = {part: set((self.seen.getValue((part,)) or ([],))[0]) for part in by_part} if reads else {}
        before = reads
        reads += sum(len(ids - stored.get(part, set())) for part, ids in by_part.items())
        complete = not done and 0 < planned <= reads
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if complete:
            if before:
                self.seen.clear()
        elif not done:
            for part, ids in by_part.items():
                if not ids <= stored.get(part, set()):
                    self.seen.updateValue((part,), (sorted(ids | stored.get(part, set())),))
            if planned > 0:
                timer = latest + self.patience
                self.handle.registerTimer(timer)
        self.told.update((reads, planned, done or complete, timer, parts))
        if complete:
            yield Row(unit=key[0], reads=reads, planned=planned, complete=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reads, planned, done, _, parts = self.told.get()
        self.told.update((reads, planned, done, 0, parts))
        if not done:
            yield Row(unit=key[0], reads=reads, planned=planned, complete=False)

    def close(self) -> None:
        pass


def tracked_plans(reads: DataFrame, plan: DataFrame, patience: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """(unit, reads, planned, complete): a row when a unit's planned reads have all arrived, in whatever order, and one each time it is overdue.

    ``reads`` has unit, read_id and ts, ``plan`` unit and planned. Repeated reads count once. A unit is overdue
    when the watermark passes its latest read by ``patience``; it may complete after that. A unit that
    planned nothing is neither. Needs the RocksDB state store.
    """
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = T.StructType([T.StructField("unit", T.StringType()), T.StructField("reads", T.LongType()), T.StructField("planned", T.LongType()), T.StructField("complete", T.BooleanType())])
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    joined = reads.join(plan, "unit").withWatermark("ts", lateness)
    return joined.groupBy("unit").transformWithState(PlanTracker(wait), out, "append", "EventTime")


def completed_plans(reads: DataFrame, plan: DataFrame) -> DataFrame:
    """Units whose planned reads have all arrived."""
    return tracked_plans(reads, plan).where("complete").select("unit", "reads")


def first_photos(photos: DataFrame, window: str = "1 day") -> DataFrame:
    """Within the watermark: only the first photo of a hash goes on."""
    return photos.withWatermark("ts", window).dropDuplicatesWithinWatermark(["phash"])


PREFIX_DIGITS = 2  # of a hash: the store has 16 to this power parts


def stored_hashes(spark: SparkSession, out: str, number: int, prefixes: list[str]) -> DataFrame:
    """Hashes that batches before ``number`` stored under these prefixes; no other part of the store is opened."""
    shape = T.StructType([T.StructField("phash", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("prefix", T.StringType())])
    return spark.read.schema(shape).parquet(out).where((F.col("batch") < number) & F.col("prefix").isin(prefixes)).select("phash")


def land_first_of_hash(photos: DataFrame, order: str, digits: int = PREFIX_DIGITS) -> DataFrame:
    """For all time: a batch keeps the hashes the stored table does not have yet, of equal ones the first by ``order``.

    The store is laid out by hash prefix, so a batch reads the parts its own hashes fall in. A repeated batch
    overwrites its own folder. A null hash is a hash of its own, stored under an empty prefix.
    """
    spark, folder = photos.sparkSession, work_folder(photos.sparkSession)
    out, schema = f"{folder}/data", photos.schema
    row = F.struct(*schema.names)
    prefix = F.concat(F.lit("p"), F.substring(F.coalesce("phash", F.lit("")), 1, digits))

    def land(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("phash").agg(F.min_by(row, order).alias("r")).select("r.*", prefix.alias("prefix"))
        if number > 0:
            prefixes = [r["prefix"] for r in batch.select(prefix.alias("prefix")).distinct().collect()]  # 16 ** digits at most
            old = stored_hashes(spark, out, number, prefixes)
            first = first.alias("n").join(old.alias("o"), F.expr("n.phash <=> o.phash"), "left_anti")
        first.write.mode("overwrite").partitionBy("prefix").parquet(f"{out}/batch={number}")

    query = photos.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = T.StructType(schema.fields + [T.StructField("batch", T.LongType()), T.StructField("prefix", T.StringType())])
    return spark.read.schema(stored).parquet(out).drop("batch", "prefix")


def score_listings(listings: DataFrame, model: P.PriceModel) -> DataFrame:
    """New listings priced on arrival and flagged against the band; no state."""
    est = P.batch_estimate(listings, model)
    return est.select("row_key", "point", *[c.alias(n) for n, c in P.asking_verdict(F.col("asking")).items()])
