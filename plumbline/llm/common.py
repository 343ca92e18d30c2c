"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of every contract here, as the inside of a Java or Python character class.
SPACE = " \\t-\\r"
#: Rows of a slim id table up to which it may be broadcast: at most some 40 MB.
BROADCAST_ROWS = 1_000_000
#: Buckets of a group whose totals one task sums up.
BUCKET_RUN = 10_000

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all tasks run in the driver's process
    (tests) a new local one. On a cluster a folder of one machine would lose rows, so there the setting is asked for."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    return _folders[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, no recomputation. The table goes when the application ends.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """materialize(), and a function that deletes the table before its time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), lambda: files.delete(at, True)


def own_names(docs: DataFrame) -> DataFrame:
    """`docs`; raises where a column's name begins with two underscores, which operators keep for themselves."""
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"reserved column names: {taken}")
    return docs


def bounded_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted `rows` are within `bound`; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def running_offsets(df: DataFrame, group: str, size: Column, order: list[str], rows_per_bucket: int = 2_000, n_rows: int | None = None) -> DataFrame:
    """Add `offset`: the sum of `size` over the rows before this one in its group.

    Levels, so that no task holds a whole group: rows are dealt to (group, bucket) by a hash of `order`, bucket totals are
    summed up in front of each bucket, and a window runs only inside a bucket. The totals of a group's buckets are summed
    up in runs of BUCKET_RUN in the same way. `df` is read twice and should be a written table. Rows equal in all of
    `order` get neighbouring offsets in any order.
    """
    n = df.count() if n_rows is None else n_rows
    buckets = max(1, -(-n // rows_per_bucket))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("__size", size.cast("long"))
    totals = df.groupBy(F.col(group).alias("__group"), F.col("__bucket").alias("__b")).agg(F.sum("__size").alias("__total"))
    before = lambda of, by, *within: F.coalesce(F.sum(of).over(Window.partitionBy("__group", *within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("__run", F.floor(F.col("__b") / BUCKET_RUN).cast("int"))
    base = before("__total", "__b", "__run")
    if buckets > BUCKET_RUN:
        totals = materialize(totals, "bucket-totals")
        runs = totals.groupBy(F.col("__group").alias("__g"), F.col("__run").alias("__r")).agg(F.sum("__total").alias("__whole")).withColumnRenamed("__g", "__group")
        runs = runs.select(F.col("__group").alias("__g"), "__r", before("__whole", "__r").alias("__ahead"))
        totals = totals.join(runs, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__run") == F.col("__r")))
        base = base + F.col("__ahead")
    totals = totals.select("__group", "__b", base.alias("__base"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    joined = df.join(totals, df[group].eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("offset", F.col("__base") + F.col("__inside")).drop("__bucket", "__size", "__group", "__b", "__base", "__inside")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph with edges (a, b); component is the smallest node it reaches.

    Alternates large-star and small-star until every edge points at its component's smallest node. Every round is a few
    shuffles of slim rows, written to the shared folder in place of the one before; nothing is collected but a count and a
    checksum. Loops and repeated edges are allowed, nodes without edges are absent.
    """
    edges, drop = _written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "cc-edges")
    seen = None
    for _ in range(max_rounds):
        before = drop
        edges, drop = _written(_small_star(_large_star(edges)), "cc-round")
        before()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


__all__ = ["BROADCAST_ROWS", "SPACE", "bounded_broadcast", "connected_components", "let", "materialize", "own_names", "running_offsets", "shared_dir", "words"]
