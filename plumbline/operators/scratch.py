"""Places for intermediate tables, numbering in many tasks, and broadcasts within a bound."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a small table, such as a catalog, up to which it is broadcast.
BROADCAST_ROWS = 100_000
_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all tasks run in the driver's process
    (tests) a new local one. On a cluster the setting is asked for, as a folder of one machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if `df` has at most `rows` rows; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` written in ranges of (group, order), with __pid, the range of each row: a large group lies in several."""
    ranged = df.repartitionByRange(group, *order)
    return written(ranged.withColumn("__pid", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the number from 1 of each row in its group, in the order of `order`.

    Rows are numbered inside ranges of the order and the counts of the ranges before are added, so no task holds a group.
    """
    rows = placed(df, group, order)
    counts = rows.groupBy(F.col(group).alias("__group"), F.col("__pid").alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__group", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__pid").orderBy(*order))
    joined = rows.withColumn("__inside", inside).join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__pid") == F.col("__range")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))
