"""Queries over what a job takes and in which order, over sources and sinks, hooks and the stream of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, maintenance, measurements, results, retrieval, selection, sheets
from ..operators.scratch import new_path
from ..sources import catalog, grid
from ..streaming import intake
from .document_queries import _RESULTS, _SECTIONS, _chunk_sql, _filled, _hits, _results, _TOPK, _VECTORS, table
from .drawing_queries import _EVENTS, _LINES, _NAMES, _events, _names, _texts, routing
from .sheet_queries import _measured

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH p AS (SELECT p_partkey, p_name AS name, ['both', 'commercial', 'residential', NULL][p_partkey % 4 + 1] scope FROM part), c AS (SELECT n_nationkey project, ['commercial', 'residential', NULL][n_nationkey % 3 + 1] kind FROM nation)
SELECT project, p_partkey FROM c JOIN p ON coalesce(scope, 'both') IN ('both', coalesce(kind, 'commercial')) WHERE name IN (SELECT p_name FROM part WHERE p_size = 7)""")
def parameter_scope(spark, d):
    part = table(spark, d, "part")
    parameters = part.selectExpr("p_partkey", "p_name name", "element_at(array('both', 'commercial', 'residential', null), cast(p_partkey % 4 + 1 as int)) scope")
    # the nations are the projects: as many at any scale, so rows stay in proportion to the parameters
    projects = table(spark, d, "nation").selectExpr("n_nationkey project", "element_at(array('commercial', 'residential', null), cast(n_nationkey % 3 + 1 as int)) project_type")
    return selection.scoped_parameters(parameters, projects, part.where("p_size = 7").selectExpr("p_name name")).select("project", "p_partkey")


_KINDS = f"WITH {_NAMES}, dk AS (SELECT doc_id, filename, kind, doc_id % 3 <> 0 processed, doc_id % 5 = 0 archived, doc_id % 50 project FROM ft)"


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = _names(spark, d).withColumn("kind", routing.file_type(F.col("filename")))
    return rows.selectExpr("doc_id", "filename", "kind", "doc_id % 3 <> 0 processed", "doc_id % 5 = 0 archived", "doc_id % 50 project")


@query(f"""{_KINDS} SELECT doc_id, 'process' AS use FROM dk WHERE NOT processed AND kind IS NOT NULL UNION ALL SELECT doc_id, 'count' FROM dk WHERE processed AND NOT archived UNION ALL SELECT doc_id, 'extract' FROM dk WHERE processed AND kind IN ('pdf_spec', 'docx_spec', 'pdf_drawing', 'pdf_mixed')""")
def document_eligibility(spark, d):
    parts = [selection.eligible_documents(_kinds(spark, d), use).select("doc_id", F.lit(use).alias("use")) for use in ("process", "count", "extract")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""SELECT page_id, CASE WHEN length(trim(m, ' ')) >= 200 THEN 'kept' ELSE 'fallback' END route, CASE WHEN length(trim(m, ' ')) >= 1 THEN 'kept' ELSE 'blank' END alone
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN url ELSE html END m FROM pages)""")
def ocr_routing(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", "case page_id % 4 when 0 then null when 1 then '  ' when 2 then url else html end markdown")
    return selection.routed_ocr(selection.routed_ocr(pages).withColumnRenamed("route", "first"), single_engine=True).select("page_id", F.col("first").alias("route"), F.col("route").alias("alone"))


@query(f"WITH {_LINES} SELECT sheet, (text_no % 40 + 1) * 2.0::DOUBLE value_mm, x, y FROM tx WHERE sheet % 3 <> 0")
def confident_measurements(spark, d):
    m = _measured(spark, d)
    return selection.confident(measurements.circle_pass(m["circles"], m["scales"]), 0.5).select("sheet", "value_mm", "x", "y")


@query(f"{_KINDS} SELECT doc_id, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN kind = 'pdf_drawing' THEN 1 WHEN kind IS NOT NULL THEN 0 END NULLS FIRST, filename) place FROM dk")
def processing_order(spark, d):
    return selection.processing_order(_kinds(spark, d)).select("doc_id", "place")


@query("""SELECT 'projects' AS list, o_orderkey id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) place FROM orders
UNION ALL SELECT 'documents', p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) FROM part""")
def listings(spark, d):
    newest = selection.listing(table(spark, d, "orders"), "o_custkey", "o_orderdate", newest_first=True, tie="o_orderkey").selectExpr("'projects' list", "o_orderkey id", "place")
    return newest.unionAll(selection.listing(table(spark, d, "part"), "p_brand", "p_name", tie="p_partkey").selectExpr("'documents' list", "p_partkey id", "place"))


@query(f"{_KINDS} SELECT project, count(*) n_documents, count(*) FILTER (NOT processed) n_unprocessed, count(*) FILTER (processed) n_processed, count(*) FILTER (processed) > 0 extract_again FROM dk GROUP BY project")
def work_counts(spark, d):
    return selection.work_counts(_kinds(spark, d))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey doc, CASE l_partkey % 5 WHEN 0 THEN '[{"document_id":"1","document":"held","pages":[' || l_linenumber || '],"sections":[]}]' WHEN 1 THEN 'broken' WHEN 2 THEN '[]' END held, CASE l_partkey % 3 WHEN 0 THEN '[' || l_linenumber || ',9]' WHEN 1 THEN 'x' END pages, CASE WHEN l_orderkey % 4 <> 0 THEN l_linenumber END page, CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END section FROM lineitem),
m AS (SELECT r.*, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE l_partkey % 3 WHEN 0 THEN l_linenumber::VARCHAR || ',9' ELSE page::VARCHAR END pg FROM r LEFT JOIN supplier ON s_suppkey = doc AND s_suppkey % 4 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'held:' || l_linenumber || ':' WHEN name IS NOT NULL AND pg IS NOT NULL THEN name || ':' || pg || ':' || coalesce(section, '') END sources FROM m""")
def legacy_sources(spark, d):
    e = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey source_doc", """case l_partkey % 5 when 0 then concat('[{"document_id":"1","document":"held","pages":[', l_linenumber, '],"sections":[]}]') when 1 then 'broken' when 2 then '[]' end all_sources""",
         "case l_partkey % 3 when 0 then concat('[', l_linenumber, ',9]') when 1 then 'x' end source_pages", "if(l_orderkey % 4 <> 0, l_linenumber, null) source_page", "if(l_orderkey % 2 = 0, l_returnflag, null) source_section"]
    documents = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").selectExpr("s_suppkey doc_id", "s_name filename")
    rows = selection.legacy_sources(table(spark, d, "lineitem").selectExpr(*e), documents)
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["document"], F.lit(":"), F.array_join(s["pages"].cast("array<string>"), ","), F.lit(":"), F.array_join(s["sections"], ","))), ";")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.nullif(shown, F.lit("")).alias("sources"))


@query(f"WITH {_chunk_sql(300, 50)} SELECT doc_id, chunk_index FROM chunks WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def live_chunks(spark, d):
    chunks = blocks.parent_child_chunks(blocks.section_groups(_filled(spark, d)), 300, 50)
    documents = table(spark, d, "documents").where("doc_id % 7 <> 0").selectExpr("doc_id", "doc_id % 5 = 0 archived")
    return retrieval.live_chunks(chunks, documents).select("doc_id", "chunk_index")


@query(f"WITH {_VECTORS}, h AS ({_TOPK.format('p', 30)}) SELECT query_id, vec_id, rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id) n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM h) WHERE r <= least(20, greatest(15, n))")
def source_cap(spark, d):
    return retrieval.capped_sources(_hits(spark, d, 30).drop("rank"), most=20).select("query_id", "vec_id", F.col("rank").alias("rank"))


@query("""SELECT o_orderkey, CASE WHEN trim(f, ' ') <> '' AND length(trim(f, ' ')) < length(o_orderpriority) * 5 THEN trim(f, ' ') ELSE o_orderpriority END query FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN repeat(o_orderpriority, 5) ELSE ' ' || lower(o_orderpriority) || '?' END f FROM orders)""")
def query_guard(spark, d):
    fixed = F.expr("case o_custkey % 4 when 0 then null when 1 then '  ' when 2 then repeat(o_orderpriority, 5) else concat(' ', lower(o_orderpriority), '?') end")
    return table(spark, d, "orders").select("o_orderkey", retrieval.guarded_query(F.col("o_orderpriority"), fixed).alias("query"))


@query("""SELECT row_number() OVER (ORDER BY name) entry_id, name, name || ' size' aliases, 'mm' unit, CASE WHEN length(name) % 2 = 0 THEN 'VERTICAL' ELSE 'ANY' END direction, CASE WHEN length(name) % 3 = 0 THEN 0.5 ELSE 0.4 END threshold FROM (SELECT DISTINCT p_name AS name FROM part)""")
def catalog_load(spark, d):
    # The catalog's file is made of the names of parts, some hundred at any scale, and read again as users' files are.
    names = table(spark, d, "part").agg(F.array_sort(F.collect_set("p_name")).alias("all")).select(F.posexplode("all").alias("i", "name"))
    entry = F.struct(
        (F.col("i") + 1).alias("id"), "name", F.array(F.concat("name", F.lit(" size"))).alias("aliases"),
        F.when(F.length("name") % 2 == 0, "VERTICAL").alias("dimension_direction"), F.when(F.length("name") % 3 == 0, 0.5).alias("confidence_threshold"),
    )
    path = new_path(spark, "catalog")
    names.agg(F.to_json(F.struct(F.collect_list(entry).alias("parameters"))).alias("value")).write.text(path)
    return catalog.catalog(spark, path).select("entry_id", "name", F.array_join("aliases", ",").alias("aliases"), "unit", "direction", "threshold")


@query("""SELECT ['a', 'b', 'c', 'd'][l_suppkey % 4 + 1] kind, l_orderkey::VARCHAR || '~' || CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN 'é, "' || l_partkey || '"' || chr(10) || '; 2|' ELSE '5" x' || l_partkey END || '~' || l_linenumber cells FROM lineitem
UNION ALL SELECT DISTINCT ['a', 'b', 'c', 'd'][l_suppkey % 4 + 1], 'order~name~line' FROM lineitem""")
def delimited_grid(spark, d):
    # Line items with quoted cells, line breaks and marks of inches as files of four delimiters, and read again; the header is a file's first line.
    name = "if(l_partkey % 3 = 0, '', if(l_partkey % 3 = 1, concat('\"é, \"\"', l_partkey, '\"\"\n; 2|\"'), concat('5\" x', l_partkey)))"
    rows = table(spark, d, "lineitem").selectExpr("element_at(array('a', 'b', 'c', 'd'), cast(l_suppkey % 4 + 1 as int)) kind", "l_orderkey", f"{name} name", "l_linenumber")
    mark = F.element_at(F.create_map(*[F.lit(x) for pair in zip("abcd", (",", ";", "\t", "|"), strict=True) for x in pair]), F.col("kind"))
    body = rows.select("kind", F.lit(1).alias("o"), F.concat_ws("", F.col("l_orderkey").cast("string"), mark, "name", mark, F.col("l_linenumber").cast("string")).alias("value"))
    head = rows.select("kind").distinct().select("kind", F.lit(0).alias("o"), F.concat_ws("", F.lit("order"), mark, F.lit("name"), mark, F.lit("line")).alias("value"))
    path = new_path(spark, "grids")
    head.unionAll(body).repartition("kind").sortWithinPartitions("kind", "o").select("kind", "value").write.partitionBy("kind").text(path)
    return grid.delimited_grid(spark, path).select(F.regexp_extract("file", "kind=(.)", 1).alias("kind"), F.array_join("cells", "~").alias("cells"))


@query()
def file_manifest(spark, d):
    # The files of the tables themselves; SQL can't list them.
    return grid.manifest(spark, d, (".parquet",)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "extension")


@query("SELECT doc_id, text_no FROM (SELECT l_orderkey doc_id, l_linenumber::BIGINT text_no FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0)")
def replaced_documents(spark, d):
    old = table(spark, d, "lineitem").selectExpr("l_orderkey doc_id", "cast(l_linenumber as bigint) text_no")
    new = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").selectExpr("l_orderkey doc_id", "l_partkey text_no")
    return results.replace_documents(results.replace_documents(old, new), new)


@query("SELECT l_orderkey::VARCHAR file, string_agg(l_partkey || '=' || l_quantity::BIGINT, ',' ORDER BY l_partkey, l_quantity) results FROM lineitem GROUP BY l_orderkey")
def result_json(spark, d):
    path = new_path(spark, "json")
    results.result_json(table(spark, d, "lineitem").selectExpr("cast(l_orderkey as string) file", "l_partkey parameter", "cast(l_quantity as bigint) value"), path)
    back = spark.read.schema("file string, results array<struct<parameter long, value long>>").json(path)
    return back.select("file", F.array_join(F.transform("results", lambda r: F.concat_ws("=", r["parameter"].cast("string"), r["value"].cast("string"))), ",").alias("results"))


@query("SELECT c_custkey project FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey = 7")
def owner_filter(spark, d):
    projects = table(spark, d, "customer").selectExpr("c_custkey project", "if(c_nationkey % 5 = 0, null, c_nationkey) owner")
    return maintenance.visible_to(projects, 7).select("project")


@query(f"""WITH {_LINES}, z AS (SELECT * FROM tx WHERE x >= 400 * 0.75 AND y <= 350 * 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY text_no) n FROM tx WHERE sheet NOT IN (SELECT sheet FROM z))
SELECT sheet, text_no FROM z UNION ALL SELECT sheet, text_no FROM r WHERE n <= 40""")
def title_zone(spark, d):
    texts = _texts(spark, d)
    pages = texts.select("sheet").distinct().withColumn("width", F.lit(400.0)).withColumn("height", F.lit(350.0))
    return sheets.title_zone(texts, pages).select("sheet", "text_no")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE o_orderstatus END status, CASE WHEN o_custkey % 3 = 1 THEN 'residential' ELSE 'commercial' END project_type FROM orders")
def stale_recovery(spark, d):
    runs = table(spark, d, "orders").selectExpr("o_orderkey", "if(o_orderstatus = 'P', 'processing', o_orderstatus) status", "element_at(array(' ', ' Residential ', null), cast(o_custkey % 3 + 1 as int)) project_type")
    return maintenance.recovered(runs)


@query(f"WITH {_chunk_sql(300, 50)}, s AS (SELECT doc_id, page, arg_max({{'a': section, 'b': subsection}}, block_no) s FROM fil GROUP BY ALL), t AS (SELECT doc_id, unnest(range(1, 6))::INT page FROM documents) SELECT doc_id, page, s.a section, s.b subsection FROM t LEFT JOIN s USING (doc_id, page)")
def table_sections(spark, d):
    tables = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"))
    return blocks.tables_in_sections(tables, _filled(spark, d))


@query(f"WITH {_RESULTS} SELECT project, parameter, ordinal, found, CASE WHEN found THEN value END AS value, CASE WHEN found THEN confidence ELSE 0 END confidence FROM r")
def stored_form(spark, d):
    return results.stored_form(_results(spark, d)).select("project", "parameter", "ordinal", "found", "value", "confidence")


@query()
def text_embedding(spark, d):
    # The default embedder over whole texts; a batch in which a text fails is halved: tests hold it against plain Python.
    rows = retrieval.embedded(table(spark, d, "documents").select("doc_id", retrieval.sanitised(F.col("text")).alias("text")))
    return rows.select("doc_id", "embedding")


_ASKED = """a AS (SELECT o_orderkey answer_id, o_orderkey % 3 = 0 lost, o_orderkey % 4 n FROM orders), p AS (SELECT answer_id, lost, k, k <= n missing FROM (SELECT *, unnest([1, 2, 3, 4, 5]) k FROM a))"""


@query(f"WITH {_ASKED}, s AS (SELECT answer_id FROM p GROUP BY answer_id HAVING avg(lost::INT) > 0.5 AND avg(missing::INT) <= 0.6) SELECT answer_id, 'p' || k AS parameter FROM p WHERE missing AND answer_id IN (SELECT answer_id FROM s)")
def asked_again(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    rows = rows.selectExpr("answer_id", "concat('p', k) parameter", "answer_id % 3 = 0 unparsed", "if(k <= answer_id % 4, 'Missing in response', null) reason")
    return results.asked_again(rows)


@query("SELECT o_orderkey project, CASE WHEN contains(lower(o_orderpriority), 'low') THEN '{\"low\": {\"found\": true, \"value\": \"low\"}}' ELSE '{}' END response_text FROM orders")
def answer_hook(spark, d):
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderpriority").alias("context"), F.array(F.lit("low")).alias("names"))
    return results.answered(prompts, results.keyword_answer).select("project", "response_text")


_PASSES = f"""WITH RECURSIVE {_EVENTS}, en AS (SELECT project, max(seconds) - 400 AS stop FROM ev GROUP BY project), cn AS (SELECT project, stop FROM en WHERE project::BIGINT % 2 = 0),
e2 AS (SELECT ev.* FROM ev LEFT JOIN cn USING (project) WHERE stop IS NULL OR seconds < stop), o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seconds, event_id) n FROM e2),
r AS (SELECT project, n, seconds AS first, seconds AS last, 0 AS burst FROM o WHERE n = 1 UNION ALL
SELECT o.project, o.n, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN o.seconds ELSE r.first END, o.seconds, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN r.burst + 1 ELSE r.burst END FROM r JOIN o ON o.project = r.project AND o.n = r.n + 1),
fi AS (SELECT project, burst, least(max(last) + 3, min(first) + 20) fired FROM r GROUP BY ALL), dc AS (SELECT project, document_id, min(burst) burst, max(priority) pr FROM o JOIN r USING (project, n) GROUP BY ALL),
ob AS (SELECT project, burst, sum(n) OVER w n_indexed, max(top) OVER w top FROM (SELECT project, burst, count(*) n, max(pr) top FROM dc GROUP BY ALL) WINDOW w AS (PARTITION BY project ORDER BY burst)),
rn AS (SELECT * FROM (SELECT ob.project, ob.burst, n_indexed, fired, row_number() OVER (PARTITION BY ob.project ORDER BY ob.burst) pass_no FROM ob JOIN fi USING (project, burst) LEFT JOIN cn ON ob.project = cn.project WHERE (n_indexed >= 2 OR top >= 80) AND (stop IS NULL OR fired <= stop)) WHERE pass_no <= 3),
gt AS (SELECT project, min(burst) gate, max(pass_no) runs FROM rn GROUP BY project),
al AS (SELECT dc.project, pass_no, false is_final, document_id, pr, n_indexed, fired FROM dc JOIN gt USING (project) JOIN rn ON rn.project = dc.project AND rn.burst = greatest(dc.burst, gate)
UNION ALL SELECT dc.project, coalesce(runs, 0) + 1, true, document_id, pr, count(*) OVER (PARTITION BY dc.project), stop FROM dc JOIN cn USING (project) LEFT JOIN gt USING (project))"""


def _completed(events: DataFrame) -> DataFrame:
    """Every second project ends 400 seconds before its last event."""
    return events.groupBy("project").agg((F.max("seconds") - 400).alias("seconds")).where("cast(project as bigint) % 2 = 0")


@query(f"{_PASSES} SELECT project, pass_no, is_final, document_id, row_number() OVER (PARTITION BY project, pass_no ORDER BY pr DESC, document_id) place, n_indexed::BIGINT n_indexed, fired fired_at FROM al")
def coordinated_passes(spark, d):
    events = _events(spark, d)
    return intake.coordinated_passes(events, _completed(events))


@query(f"{_PASSES} SELECT project, pass_no, is_final, n_indexed::BIGINT n_indexed, fired fired_at, count(*) n_documents FROM al GROUP BY ALL")
def pass_metrics(spark, d):
    events = _events(spark, d)
    return intake.pass_metrics(intake.coordinated_passes(events, _completed(events)))


@query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seconds, event_id) n FROM ev),
r AS (SELECT project, n, seconds AS first, seconds AS last, 0 AS burst FROM o WHERE n = 1 UNION ALL
SELECT o.project, o.n, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN o.seconds ELSE r.first END, o.seconds, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN r.burst + 1 ELSE r.burst END FROM r JOIN o ON o.project = r.project AND o.n = r.n + 1)
SELECT project, burst::BIGINT burst_no, burst::BIGINT + 1 pass_no, burst < 3 runs FROM (SELECT DISTINCT project, burst FROM r)""")
def incremental_passes(spark, d):
    return intake.passes(intake.bursts(_events(spark, d))).select("project", "burst_no", "pass_no", "runs")


@query(f"WITH {_chunk_sql(3000, 200)}, n AS (SELECT doc_id, count(*) n FROM chunks GROUP BY doc_id) SELECT doc_id, 'processed' AS state, coalesce(n, 0) n_chunks FROM documents LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL")
def document_intake(spark, d):
    """The documents as a stream of files, chunked once each; a null text would be rejected."""
    out = new_path(spark, "intake")
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")

    def chunk(docs: DataFrame) -> DataFrame:
        sections = blocks.section_groups(blocks.heading_fill(blocks.lines_as_blocks(docs)))
        return blocks.parent_child_chunks(sections).select("doc_id", "chunk_index", "chunk_level")

    intake.intake(stream, chunk, out).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    status = spark.read.schema("doc_id long, state string, reason string").parquet(f"{out}/epoch=*/status")
    chunks = spark.read.schema("doc_id long, chunk_index int, chunk_level int").parquet(f"{out}/epoch=*/chunks/part=*")
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return status.join(counted, "doc_id", "left").select("doc_id", "state", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query(f"""WITH {_SECTIONS}, fb AS (SELECT *, block_no % 3 <> 0 is_table, CASE WHEN block_no % 4 = 1 THEN 'pdf_spec' WHEN block_no % 11 = 0 THEN 'pdf_drawing' END source_type FROM g2 WHERE heading = 0),
fg AS (SELECT doc_id, run, bool_and(is_table) is_table, CASE WHEN coalesce(bool_or(source_type = 'pdf_drawing'), false) THEN 'pdf_drawing' ELSE first(source_type ORDER BY block_no) END source_type FROM fb GROUP BY ALL)
SELECT sec.doc_id, section_no, is_table, source_type FROM sec JOIN fg USING (doc_id, run)""")
def section_flags(spark, d):
    marked = _filled(spark, d).selectExpr("*", "block_no % 3 <> 0 is_table", "case when block_no % 4 = 1 then 'pdf_spec' when block_no % 11 = 0 then 'pdf_drawing' end source_type")
    return blocks.section_flags(marked).select("doc_id", "section_no", "is_table", "source_type")


@query("SELECT 'orders' AS name, o_orderkey id FROM orders WHERE o_custkey % 4 <> 1 UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_custkey % 4 <> 1")
def project_delete(spark, d):
    tables = {"orders": table(spark, d, "orders").selectExpr("o_custkey project", "o_orderkey id"), "customers": table(spark, d, "customer").selectExpr("c_custkey project", "c_custkey id")}
    left = results.projects_deleted(tables, tables["customers"].where("project % 4 = 1"))
    return left["orders"].selectExpr("'orders' name", "id").unionAll(left["customers"].selectExpr("'customers' name", "id"))


@query("""WITH c AS (SELECT c_custkey project_id, c_custkey % 2 = 0 s, c_custkey % 7 = 0 a, c_custkey % 5 = 0 h FROM customer)
SELECT 'star' AS action, project_id, s OR h starred, a archived FROM c UNION ALL SELECT 'unstar', project_id, s AND NOT h, a FROM c UNION ALL SELECT 'unarchive', project_id, s, a AND NOT h FROM c""")
def bulk_actions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.expr("c_custkey % 2 = 0").alias("starred"), F.expr("c_custkey % 7 = 0").alias("archived"))
    done = [maintenance.bulk_flags(c, c.where("project_id % 5 = 0"), action).select(F.lit(action).alias("action"), "project_id", "starred", "archived") for action in ("star", "unstar", "unarchive")]
    return done[0].unionAll(done[1]).unionAll(done[2])


@query("""WITH p AS (SELECT page_id, page_id % 2 doc_id, length(html) % 200 chars FROM pages), v AS (SELECT *, chars < 100 v, row_number() OVER (PARTITION BY doc_id, chars < 100 ORDER BY page_id) n FROM p)
SELECT page_id, CASE WHEN NOT v THEN 'text' WHEN n <= 150 THEN 'vision' ELSE 'skipped' END route FROM v""")
def page_bound(spark, d):
    # Two documents share all pages, so that from sf0.1 on pages lie beyond the bound.
    pages = table(spark, d, "pages").selectExpr("page_id", "page_id % 2 doc_id", "page_id page_no", "length(html) % 200 chars", "0 draws")
    return routing.routed_pages(pages).select("page_id", "route")


_SIGNAL = f"[{', '.join(repr(x) for x in results.INFERENCE_SIGNALS)}, 'stated'][o_orderkey % 9 + 1]"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 = 0 THEN 0 WHEN o_custkey % 9 / 8 > 0.75 AND o_orderkey % 9 <> 8 THEN 0.75 ELSE o_custkey % 9 / 8 END confidence, {_SIGNAL} word FROM orders""")
def confidence_cap(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in (*results.INFERENCE_SIGNALS, "stated")]), F.expr("cast(o_orderkey % 9 + 1 as int)"))
    said = F.concat(F.lit("It was "), F.upper(word), F.lit(" so."))
    c = results.capped_confidence(F.expr("o_orderkey % 7 <> 0"), F.expr("if(o_orderkey % 4 = 0, '', 'v')"), F.expr("o_custkey % 9") / 8, said)
    return table(spark, d, "orders").select("o_orderkey", c.alias("confidence"), word.alias("word"))


@query("""WITH a AS (SELECT o_orderkey answer_id, o_orderkey % 3 n FROM orders), k AS (SELECT answer_id, n, unnest(['p1', 'p2', 'p3']) parameter, unnest([1, 2, 3]) i FROM a)
SELECT answer_id, parameter, i <= n AS found, CASE WHEN i <= n THEN 'v' || i END AS value, CASE WHEN n = 0 THEN 'JSON parse failed' WHEN i > n THEN 'Missing in response' END reason FROM k""")
def answer_recovery(spark, d):
    # Answers of three parameters, cut off after none, one or two of them.
    whole = [f'"p{i}": {{"found": true, "value": "v{i}"}}' for i in (1, 2, 3)]
    text = F.expr("case o_orderkey % 3 " + " ".join(f"when {n} then '{{{', '.join([*whole[:n], whole[n][:20]])}'" for n in range(3)) + " end")
    answers = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), text.alias("response_text"))
    expected = answers.select("answer_id", F.explode(F.array(*[F.lit(f"p{i}") for i in (1, 2, 3)])).alias("parameter"))
    return results.parsed_answers(answers, expected).select("answer_id", "parameter", "found", "value", "reason")


@query(f"WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}) SELECT query_id, CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE 1000000000 + vec_id // 5 END section_id, max(score) score, count(*) n_hits FROM h GROUP BY ALL")
def parent_pass_through(spark, d):
    # Every third chunk has no parent and stands for itself.
    chunks = table(spark, d, "embeddings").selectExpr("vec_id", "if(vec_id % 3 = 0, null, 1000000000 + vec_id div 5) parent_id")
    return retrieval.parent_expand(_hits(spark, d), chunks)


@query("""WITH k AS (SELECT o_orderkey answer_id, unnest(range(1, 6)) i, (o_custkey % 6)::INT j, o_custkey % 5 = 0 fails FROM orders),
c AS (SELECT *, i <= 5 - j first, j BETWEEN 1 AND 3 AND i > 5 - j again FROM k)
SELECT answer_id, 'p' || i AS parameter, first OR again AND NOT fails AS found, CASE WHEN first THEN 'p' || i || '-5' WHEN again AND NOT fails THEN 'p' || i || '-' || j END AS value,
CASE WHEN first OR again AND NOT fails THEN NULL WHEN j = 5 THEN 'JSON parse failed' ELSE 'Missing in response' END reason, again FROM c""")
def answered_with_retry(spark, d):
    """Answers about five parameters, of which some are cut off before the last j; asked alone, these are found unless the hook fails."""

    def ask(context: str, names: list[str]) -> str:
        j = int(context) % 6
        if len(names) < 5 and int(context) % 5 == 0:
            raise ValueError(context)
        known = [f'"{n}": {{"found": true, "value": "{n}-{len(names)}", "confidence": 0.8}}' for n in names]
        if len(names) < 5 or not j:
            return "{" + ", ".join(known) + "}"
        return "{" + ", ".join([*known[: 5 - j], known[5 - j][:12]])

    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.col("o_custkey").cast("string").alias("context"), F.array(*[F.lit(f"p{i}") for i in range(1, 6)]).alias("names"))
    return results.answered_with_retry(prompts, ask).select("answer_id", "parameter", "found", "value", "reason", "again")
