"""Upkeep of stored tables, chat history, usage and timing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of a conversation, numbered in time order; rows of one turn are in the order of their other columns."""
    order = ["turn", *sorted(set(turns.columns) - {"conv_id", "turn"})]
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in order]))
    kept = turns.withColumn("r", last).where(F.col("r") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).drop("r")


def flattened_chat(log: DataFrame) -> DataFrame:
    """log_id, role, text: the user's message of each log row and, if it was answered, the assistant's."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("text"))
    return log.select("log_id", F.inline(F.filter(F.array(message("user", "query"), message("assistant", "response")), lambda m: (m["role"] == "user") | m["text"].isNotNull())))


def bulk_flags(projects: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """projects (project_id, starred, archived, ...) after star, unstar, archive or unarchive of `ids`; archiving unstars."""
    if action not in ("star", "unstar", "archive", "unarchive"):
        raise ValueError(action)
    hit = projects.join(ids.select("project_id").distinct().withColumn("__hit", F.lit(True)), "project_id", "left")
    h = F.coalesce("__hit", F.lit(False))
    if action in ("star", "unstar"):
        return hit.withColumn("starred", F.when(h, action == "star").otherwise(F.col("starred"))).drop("__hit")
    hit = hit.withColumn("starred", F.when(h & (action == "archive"), False).otherwise(F.col("starred")))
    return hit.withColumn("archived", F.when(h, action == "archive").otherwise(F.col("archived"))).drop("__hit")


def visible_to(projects: DataFrame, user_id: int) -> DataFrame:
    """A user's own projects and those without an owner."""
    return projects.where(F.col("owner").isNull() | (F.col("owner") == user_id))


def recovered(runs: DataFrame) -> DataFrame:
    """Rows stuck in `processing` become `failed`; project types are trimmed and lowered, commercial by default."""
    kind = F.nullif(F.lower(F.trim("project_type")), F.lit(""))
    return runs.withColumn("status", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status"))).withColumn("project_type", F.coalesce(kind, F.lit("commercial")))


def token_usage(log: DataFrame, limit: int) -> DataFrame:
    """Per user: tokens used and what is left of the limit."""
    return log.groupBy("user_id").agg(F.sum("tokens").alias("used")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def timing_report(lines: DataFrame) -> DataFrame:
    """run_id, n_entries, n_summary, total_s from log lines `[TIMING] tag | label | 1.25s` (run_id, line_no, line): the total is the
    last pipeline entry's time."""
    tag = F.regexp_extract("line", r"^\[TIMING\] (\w+) \| ([^|]*) \| ([0-9.]+)s$", 1)
    label, took = (F.regexp_extract("line", r"^\[TIMING\] (\w+) \| ([^|]*) \| ([0-9.]+)s$", i) for i in (2, 3))
    rows = lines.select("run_id", "line_no", tag.alias("tag"), label.alias("label"), took.alias("took")).where("tag <> ''").withColumn("took", F.col("took").cast("double"))
    pipeline = F.col("tag") == "pipeline"
    return rows.groupBy("run_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("label") == "summary").alias("n_summary"), F.max_by(F.when(pipeline, F.col("took")), F.when(pipeline, F.col("line_no"))).alias("total_s"))


def bench_stats(runs: DataFrame) -> DataFrame:
    """Least, median and greatest seconds per name."""
    return runs.groupBy("name").agg(F.min("s").alias("least"), F.median("s").alias("median"), F.max("s").alias("greatest"))
