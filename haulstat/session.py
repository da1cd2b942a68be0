"""Session settings and the one place that decides where lineage is cut."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "haulstat", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    submitter decides both and adaptive execution sizes the partitions.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if "local" not in _LOCAL_FOLDER:
            _LOCAL_FOLDER["local"] = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        folder = _LOCAL_FOLDER["local"]
    return folder


_LOCAL_FOLDER: dict[str, str] = {}


_WRITTEN: list[str] = []  # tables that this process cut, oldest first


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from the table.

    The rows are computed once, survive the loss of executors, and later plans
    know the table's size and read only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_tables() -> list[str]:
    """Paths of the tables cut so far, oldest first; those that were dropped are not among them."""
    return list(_WRITTEN)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete cut tables that no later plan reads, wherever the shared folder is."""
    for path in paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffles nobody refers to any more


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Driver-made rows (coefficients, fixed tables) as a local relation.

    Its size is known when the plan is made, so joins with it are broadcast by
    Spark's own size check instead of shuffling the big side.
    """
    import pyarrow as pa
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(list(c)) for n, c in zip(names, columns)}))


def spread_out(df: DataFrame) -> DataFrame:
    """Before a row is multiplied (replicas, folds, cells), use every core.

    Small inputs arrive in one or two partitions; large ones already have more
    partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
