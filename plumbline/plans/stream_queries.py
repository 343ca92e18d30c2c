"""Queries over what passes find and change, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import new_path
from ..streaming import changes, intake
from .document_queries import table
from .drawing_queries import _events
from .selection_queries import _PASSES, _completed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What each pass finds: the events of the documents it reads, up to the moment it runs. Four parameters a project.
_CHANGES = f"""{_PASSES}, fv AS (SELECT project, parameter, pass_no, v, c, p, row_number() OVER (PARTITION BY project, parameter ORDER BY pass_no, seconds, event_id) n
  FROM (SELECT al.project, 'p' || e2.event_id % 4 parameter, pass_no, seconds, e2.event_id, events.value v, e2.event_id % 101 / 100 c, e2.priority + e2.event_id % 3 p FROM al JOIN e2 USING (project, document_id) JOIN events ON events.event_id = e2.event_id WHERE seconds <= fired)),
rs AS (SELECT project, parameter, pass_no, n, v, c, p FROM fv WHERE n = 1 UNION ALL
  SELECT fv.project, fv.parameter, fv.pass_no, fv.n, CASE WHEN w THEN fv.v ELSE m.v END, CASE WHEN w THEN fv.c ELSE m.c END, CASE WHEN w THEN fv.p ELSE m.p END
  FROM (SELECT rs.*, fv.n n2, fv.c >= rs.c + 0.05::DOUBLE OR abs(fv.c - rs.c) < 0.05::DOUBLE AND fv.p > rs.p w FROM rs JOIN fv ON rs.project = fv.project AND rs.parameter = fv.parameter AND fv.n = rs.n + 1) m
  JOIN fv ON m.project = fv.project AND m.parameter = fv.parameter AND fv.n = m.n2),
le AS (SELECT project, parameter, pass_no, arg_max(v, n) v, arg_max(c, n) c, arg_max(p, n) p FROM rs GROUP BY ALL),
ol AS (SELECT *, lag(v) OVER (PARTITION BY project, parameter ORDER BY pass_no) o FROM le),
ch AS (SELECT *, CASE WHEN o IS NULL THEN 'new' WHEN v <> o THEN 'updated' ELSE 'unchanged' END kind FROM ol)"""


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, d)
    read = intake.coordinated_passes(events, _completed(events))
    rows = events.join(read.select("project", "document_id", "pass_no", "fired_at"), ["project", "document_id"]).where("seconds <= fired_at")
    found = rows.selectExpr("project", "concat('p', event_id % 4) parameter", "pass_no", "seconds", "event_id", "value", "event_id % 101 / 100 confidence", "cast(priority + event_id % 3 as bigint) priority")
    return changes.value_changes(found), read


@query(f"{_CHANGES} SELECT project, parameter, pass_no, kind, o old_value, v AS value, c confidence, p AS priority, sum((kind = 'updated')::INT) OVER (PARTITION BY project, parameter ORDER BY pass_no)::BIGINT change_no FROM ch")
def value_changes(spark, d):
    return _changes(spark, d)[0]


@query(f"{_CHANGES} SELECT project, parameter, pass_no, kind, o old_value, v AS value FROM ch WHERE kind <> 'unchanged'")
def update_events(spark, d):
    return changes.update_events(_changes(spark, d)[0]).select("project", "parameter", "pass_no", "kind", "old_value", "value")


@query(f"""{_CHANGES}, ps AS (SELECT project, pass_no, is_final, n_indexed::BIGINT n_indexed, fired fired_at, count(*) n_documents FROM al GROUP BY ALL),
ks AS (SELECT project, pass_no, count(*) FILTER (kind = 'updated') n_updated, count(*) FILTER (kind = 'new') n_new, count(*) FILTER (kind = 'unchanged') n_unchanged FROM ch GROUP BY ALL)
SELECT ps.*, coalesce(n_updated, 0) n_updated, coalesce(n_new, 0) n_new, coalesce(n_unchanged, 0) n_unchanged, sum(coalesce(n_new, 0)) OVER (PARTITION BY project ORDER BY pass_no)::BIGINT n_found FROM ps LEFT JOIN ks USING (project, pass_no)""")
def pass_value_counts(spark, d):
    return changes.value_counts(*_changes(spark, d))


@query("SELECT count(*) n_rows, count(DISTINCT o_orderkey) n_processed, count(DISTINCT o_orderkey) n_chunks FROM orders")
def intake_of_repeats(spark, d):
    """The orders as a stream of files of which each comes twice: nothing is read again."""
    out = new_path(spark, "repeats")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    for _ in range(2):
        rows.repartition(2).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    intake.intake(stream, lambda docs: docs.select("doc_id", F.length("text").alias("n")), f"{out}/out").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    status = spark.read.schema("doc_id long, state string, reason string").parquet(f"{out}/out/epoch=*/status")
    chunks = spark.read.schema("doc_id long, n int").parquet(f"{out}/out/epoch=*/chunks/part=*")
    n_rows = rows.agg(F.count("*").alias("n_rows"))
    return n_rows.crossJoin(status.where("state = 'processed'").agg(F.count("*").alias("n_processed"))).crossJoin(chunks.agg(F.count("*").alias("n_chunks")))
