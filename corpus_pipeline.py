"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from plumbline.llm.common import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host passes."""
    return quality_rules.quality_rules(docs).where("__rules.kept").drop("__rules")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their frequent lines; one that had text and has none left goes."""
    rows = line_dedup.dedup_lines(docs)
    text = F.col("__lines.kept_text")
    kept = rows.where((F.col("__lines.n_dropped") == 0) | text.rlike("[^ \\t-\\r]"))
    new = {"text": F.when(F.col("__lines.n_dropped") == 0, F.col("text")).otherwise(text).alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return kept.select(*[new.get(c, F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each time it is taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express the draws of the mix nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
