"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import folder

MAX_ROUNDS = 60


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` read back from the reliable checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def components(edges: DataFrame, key: str) -> DataFrame:
    """key, node, label: the least node of `key` that links (key, a, b) reach from each node that has a link.

    Each round takes the least label of the neighbours and then the label of that label, so rounds grow with the logarithm of
    a chain's length in practice; a round shuffles one slim row a link and is checkpointed. More than MAX_ROUNDS raise.
    """
    both = checkpointed(edges.select(key, "a", "b").unionAll(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    for _ in range(MAX_ROUNDS):
        labels = checkpointed(labels)
        least = both.join(labels.select(key, F.col("node").alias("b"), "label"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(least, [key, "node"]).withColumn("near", F.least("label", "near"))
        jump = labels.select(key, F.col("node").alias("near"), F.col("label").alias("far"))
        moved = checkpointed(near.join(jump, [key, "near"]).select(key, "node", F.col("far").alias("next"), "label"))
        if moved.where("next <> label").isEmpty():
            return labels
        labels = moved.select(key, "node", F.col("next").alias("label"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
