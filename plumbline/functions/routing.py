"""Classification of files, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parts of file names that tell a document's kind.
DRAWING_KEYWORDS = (
    "drawing", "drawings", "tender drg", "drg", "elevation", "elevations", "facade detail", "curtain wall detail", "cw detail", "layout", "plan",
    "floor plan", "site plan", "detail sheet", "detail drg", "section detail", "architectural drawing", "shop drawing", "ga drawing",
    "general arrangement", "facade drawing", "glazing layout", "panel layout", "wall section", "exhibit", "dwg", "cad",
)
BOQ_KEYWORDS = (
    "boq", "bill of quantities", "bill of quantity", "tender boq", "price schedule", "pricing", "cost estimate", "rate analysis", "schedule of rates",
    "sor", "schedule of quantities", "soq", "commercial bid", "price list", "quotation", "bid price",
)
SPEC_KEYWORDS = ("specification", "specifications", "spec", "technical spec", "technical specification", "performance spec", "material spec", "product spec", "system spec")
GCC_KEYWORDS = (
    "gcc", "general conditions", "general condition", "conditions of contract", "contract conditions", "terms and conditions", "terms & conditions",
    "special conditions", "scc", "particular conditions", "scope of work", "scope of supply", "contractual",
)
MATRIX_KEYWORDS = ("matrix", "technical matrix", "compliance matrix", "requirement matrix", "comparison", "checklist", "evaluation", "assessment", "data sheet", "datasheet", "schedule")
# The kind that an extension gives, and the priority of kinds.
EXTENSIONS = {".pdf": "pdf_spec", ".docx": "docx_spec", ".doc": "docx_spec", ".xlsx": "excel_boq", ".xls": "excel_boq", ".csv": "excel_boq", ".ods": "excel_boq", ".dxf": "dxf_drawing", ".dwg": "dwg_drawing"}
PRIORITY = {"excel_boq": 100, "pdf_spec": 80, "docx_spec": 80, "pdf_drawing": 60, "dwg_drawing": 60, "dxf_drawing": 60}
OTHER_PRIORITY = 10
#: Page routing by characters and drawing commands.
FEW_CHARS, MANY_CHARS, MANY_DRAWS, MAX_VISION_PAGES = 100, 3000, 1000, 150


def _any(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def _stem_and_extension(filename: Column) -> tuple[Column, Column]:
    name = F.lower(filename)
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.left(name, F.length(name) - F.length(extension)), extension


def file_type(filename: Column) -> Column:
    """The kind of a file by extension, for PDF also by drawing keywords; null for an unsupported one."""
    stem, extension = _stem_and_extension(filename)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when((extension == ".pdf") & _any(stem, DRAWING_KEYWORDS), "pdf_drawing").otherwise(F.try_element_at(known, extension))


def document_role(filename: Column, kind: Column) -> Column:
    """What a document is for: by its kind where that tells, else by its name; specification by default."""
    stem, extension = _stem_and_extension(F.coalesce(filename, F.lit("")))
    by_kind = F.when(kind.isin("pdf_drawing", "dxf_drawing", "dwg_drawing"), "drawing").when(kind == "pdf_mixed", "mixed (specs + drawings)").when(kind == "excel_boq", "boq")
    by_name = F.when(extension.isin(".xlsx", ".xls", ".csv", ".ods"), "boq").when(extension.isin(".dxf", ".dwg"), "drawing")
    for role, bank in (("drawing", DRAWING_KEYWORDS), ("boq", BOQ_KEYWORDS), ("gcc", GCC_KEYWORDS), ("matrix", MATRIX_KEYWORDS), ("specification", SPEC_KEYWORDS)):
        by_name = by_name.when(_any(stem, bank), role)
    return F.coalesce(by_kind, by_name, F.lit("specification"))


def priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.coalesce(kind, F.lit(""))), F.lit(OTHER_PRIORITY))


def routed_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, chars, draws) with route: vision, text, or skipped beyond 150 vision pages of a document."""
    vision = (F.col("chars") < FEW_CHARS) | (F.col("chars") < MANY_CHARS) & (F.col("draws") > MANY_DRAWS)
    marked = pages.withColumn("vision", vision)
    nth = F.row_number().over(Window.partitionBy("doc_id", "vision").orderBy("page_no"))
    return marked.withColumn("n", nth).withColumn("route", F.when(~F.col("vision"), "text").when(F.col("n") <= MAX_VISION_PAGES, "vision").otherwise("skipped")).drop("vision", "n")


def sampled_kind(pages: DataFrame, n_pages: int = 5, few_chars: float = 100, many_draws: float = 500) -> DataFrame:
    """doc_id and is_drawing by the means of the first pages."""
    first = pages.where(F.col("page_no") <= n_pages).groupBy("doc_id").agg(F.avg("chars").alias("c"), F.avg("draws").alias("d"))
    return first.select("doc_id", ((F.col("c") < few_chars) | (F.col("d") > many_draws)).alias("is_drawing"))


def mixed_kind(pages: DataFrame) -> DataFrame:
    """doc_id, shares and kind by the mix of page types (drawing, scanned, text) and routes."""
    of = lambda c: F.count_if(c) / F.count("*")
    mix = pages.groupBy("doc_id").agg(of(F.col("page_type") == "drawing").alias("drawing"), of(F.col("route") == "vision").alias("vision"), F.count_if(F.col("page_type") == "scanned").alias("n_scanned"), F.count_if(F.col("page_type") == "drawing").alias("n_drawing"))
    d, v = F.col("drawing"), F.col("vision")
    kind = F.when(d > 0.5, "pdf_drawing").when((v > 0.5) & (F.col("n_scanned") > F.col("n_drawing")), "pdf_spec").when((d > 0.15) | (v > 0.15) & (F.col("n_drawing") > 0), "pdf_mixed").otherwise("pdf_spec")
    return mix.select("doc_id", F.round("drawing", 6).alias("drawing_share"), F.round("vision", 6).alias("vision_share"), kind.alias("kind"))


def markdown_page_type(markdown: Column) -> Column:
    """table where three lines have two bars each, else text."""
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    return F.when(F.size(F.filter(F.split(markdown, "\n"), lambda x: bars(x) >= 2)) >= 3, "table").otherwise("text")
