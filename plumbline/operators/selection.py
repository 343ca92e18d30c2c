"""Which documents, parameters, pages and measurements a job takes, in which order, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of documents that are read for specifications, and characters that a page's OCR must yield.
SPEC_KINDS = ("pdf_spec", "docx_spec", "dxf_drawing", "dwg_drawing", "pdf_drawing", "pdf_mixed")
LOW_YIELD = 200
MIN_CONFIDENCE = 0.40
DEFAULT_TYPE = "commercial"


def scoped_parameters(parameters: DataFrame, projects: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """project and each parameter (name, scope, ...) that applies to its type: those of scope `both` (the default) or of the type
    itself (commercial by default); with `names` (name) only these."""
    if names is not None:
        parameters = parameters.join(names.select("name").distinct(), "name", "left_semi")
    kinds = F.array(F.lit("both"), F.coalesce("project_type", F.lit(DEFAULT_TYPE)))
    wanted = projects.select("project", F.explode(kinds).alias("__scope"))
    scoped = parameters.withColumn("__scope", F.coalesce("scope", F.lit("both")))
    return wanted.join(scoped, "__scope").drop("__scope")


def eligible_documents(documents: DataFrame, use: str) -> DataFrame:
    """Documents (kind, processed, archived, ...) to `process` (not processed yet, of a known kind), to `count` (processed and not
    archived) or to `extract` from (processed specifications)."""
    c = F.col
    tests = {"process": ~c("processed") & c("kind").isin(*SPEC_KINDS, "excel_boq"), "count": c("processed") & ~c("archived"), "extract": c("processed") & c("kind").isin("pdf_spec", "docx_spec", "pdf_drawing", "pdf_mixed")}
    if use not in tests:
        raise ValueError(use)
    return documents.where(tests[use])


def routed_ocr(pages: DataFrame, single_engine: bool = False) -> DataFrame:
    """Pages (markdown, ...) with route: `kept` where OCR gave 200 characters or more, else `fallback` to another engine; with a
    single engine any text is kept and a page without is `blank`."""
    enough = F.length(F.trim(F.coalesce("markdown", F.lit("")))) >= (1 if single_engine else LOW_YIELD)
    return pages.withColumn("route", F.when(enough, "kept").otherwise("blank" if single_engine else "fallback"))


def confident(measurements: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Measurements of at least this confidence."""
    return measurements.where(F.col("confidence") >= least)


def processing_order(documents: DataFrame) -> DataFrame:
    """Adds place: the documents (project, kind, filename) of a project, drawings in PDF last, by name within each part."""
    late = (F.col("kind") == "pdf_drawing").cast("int")
    return documents.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(late, "filename")))


def listing(rows: DataFrame, group: str, order: str, newest_first: bool = False, tie: str | None = None) -> DataFrame:
    """Adds place: rows of a group as a list shows them, by name or time."""
    by = F.col(order).desc() if newest_first else F.col(order)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(by, *([tie] if tie else []))))


def work_counts(documents: DataFrame) -> DataFrame:
    """Per project: documents, those not processed yet, those processed, and whether anything is left to extract from."""
    done = F.col("processed")
    counted = documents.groupBy("project").agg(F.count("*").alias("n_documents"), F.count_if(~done).alias("n_unprocessed"), F.count_if(done).alias("n_processed"))
    return counted.withColumn("extract_again", F.col("n_processed") > 0)


SOURCES = "array<struct<document_id string, document string, pages array<int>, sections array<string>>>"


def legacy_sources(results: DataFrame, documents: DataFrame) -> DataFrame:
    """results with `sources` read from the JSON text all_sources; where that is empty or broken, and a document's name and pages
    are known, one source made of source_doc, source_pages (a JSON list, else source_page) and source_section.

    A name without pages makes no source: an arbitrary first document would show as evidence.
    """
    pages = F.from_json("source_pages", "array<int>")
    pages = F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, pages).when(F.col("source_page").isNotNull(), F.array(F.col("source_page").cast("int")))
    held = F.from_json("all_sources", SOURCES)
    named = results.join(documents.select(F.col("doc_id").alias("source_doc"), F.col("filename").alias("__name")), "source_doc", "left")
    sections = F.when(F.col("source_section").isNull(), F.array().cast("array<string>")).otherwise(F.array("source_section"))
    made = F.when(F.col("__name").isNotNull() & pages.isNotNull(), F.array(F.struct(F.col("source_doc").cast("string").alias("document_id"), F.col("__name").alias("document"), pages.alias("pages"), sections.alias("sections"))))
    sources = F.when(F.coalesce(F.size(held), F.lit(0)) > 0, held).otherwise(F.coalesce(made, F.array().cast(SOURCES)))
    return named.select(*results.columns, sources.alias("sources"))
