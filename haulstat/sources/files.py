"""Reading and writing tables: fixed schemas in, fixed column lists out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType([
    T.StructField("listing_id", T.StringType()), T.StructField("market", T.StringType()),
    T.StructField("make", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("km", T.DoubleType()),
    T.StructField("price", T.DoubleType()), T.StructField("currency", T.StringType()),
    T.StructField("euro_norm", T.StringType()), T.StructField("dealer_name", T.StringType()),
    T.StructField("n_images", T.IntegerType()), T.StructField("spec", T.MapType(T.StringType(), T.StringType()))])
PHOTO_SCHEMA = T.StructType([
    T.StructField("listing_id", T.StringType()), T.StructField("image_index", T.IntegerType()),
    T.StructField("path", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("phash", T.StringType()),
    T.StructField("view", T.StringType()), T.StructField("capture_quality", T.DoubleType())])
CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines keep their text in ``_corrupt_record``."""
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_sources(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Union of the sources that exist, each row tagged with its source key."""
    frames = {k: read_json_lines(spark, p, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
              if exists(spark, p) else None for k, p in paths.items()}
    if not any(f is not None for f in frames.values()):
        return spark.createDataFrame([], schema).withColumn("source_key", F.lit(None).cast("string"))
    return union_sources(frames, "source_key")


def union_sources(frames: dict[str, DataFrame | None], tag: str) -> DataFrame:
    """Tagged union; an absent source is skipped, a missing column is NULL."""
    out = None
    for key, frame in frames.items():
        if frame is None:
            continue
        tagged = frame.withColumn(tag, F.lit(key))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, multi-line quoted text and a fixed schema (ids stay strings)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("enforceSchema", False).csv(path))


def read_reference(spark: SparkSession, path: str, row: T.StructType, field: str = "rows") -> DataFrame:
    """Rows of a nested JSON reference file; an absent file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], row)
    wrapped = T.StructType([T.StructField(field, T.ArrayType(row))])
    return spark.read.schema(wrapped).option("multiLine", True).json(path).select(F.inline(field))


def write_package(rows: DataFrame, columns: list[str], path: str, by: str = "source_key") -> None:
    """Fixed column list, partitioned, as many files as there are tasks."""
    rows.select(*columns).write.mode("overwrite").partitionBy(by).parquet(path)


def export_lines(rows: DataFrame, columns: list[str], path: str, kind: str = "json") -> None:
    flat = rows.select(*[F.array_join(c, "|").alias(c) if isinstance(rows.schema[c].dataType, T.ArrayType) and kind == "csv"
                         else F.col(c) for c in columns])
    writer = flat.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, key: str, prepare=lambda df: df,
               bucket: str = "bucket") -> None:
    """Append only rows whose key is not stored yet; ``prepare`` runs on those rows alone."""
    fresh = incoming
    if exists(spark, path):  # any other failure to read the store is an error, not an empty store
        stored = spark.read.schema(T.StructType([T.StructField(key, incoming.schema[key].dataType)])).parquet(path)
        fresh = incoming.join(stored, key, "left_anti")
    prefixed = prepare(fresh).withColumn(bucket, F.substring(F.md5(F.col(key).cast("string")), 1, 2))
    prefixed.write.mode("append").partitionBy(bucket).parquet(path)
