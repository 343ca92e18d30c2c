"""Spreadsheet grids: header detection, column mapping, items and text chunks. Also the manifest of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .delimited import delimited_grid as delimited_grid

# Keywords of each field, fields in the order in which they choose a column.
FIELD_KEYWORDS = {
    "item_number": ["item no", "item number", "sl no", "sr no", "s.no", "sno", "#", "item"],
    "description": ["description", "item description", "particulars", "work description", "scope", "details"],
    "quantity": ["quantity", "qty", "qnty", "nos"],
    "unit": ["unit", "uom", "unit of measurement"],
    "rate": ["rate", "unit rate", "unit price", "price"],
    "amount": ["amount", "total", "value", "total amount"],
    "category": ["category", "trade", "section", "group"],
    "sub_category": ["sub category", "subcategory", "sub-category", "sub section"],
}
# A cell that contains one of these may be a header cell.
HEADER_SIGNALS = ("description", "item", "s.no", "quantity", "qty", "unit", "rate", "amount", "total", "uom", "sl no", "sr no", "particulars", "scope")
HEADER_ROWS, LEAST_SIGNALS, ROWS_PER_CHUNK = 20, 2, 25
NUMERIC = ("quantity", "rate", "amount")


def manifest(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, length and extension of the supported files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(F.col("extension").isin(*extensions)).orderBy("path")


def header_rows(grid: DataFrame) -> DataFrame:
    """sheet, header_row, n_signals: the row among the first 20 with most cells that contain a signal, the earliest on ties, if it has two."""
    signal = lambda c: F.exists(F.array(*[F.lit(s) for s in HEADER_SIGNALS]), lambda s: F.contains(F.lower(F.trim(c)), s))
    scored = grid.where(F.col("row_no") < HEADER_ROWS).withColumn("n", F.size(F.filter("cells", lambda c: c.isNotNull() & signal(c))))
    best = scored.groupBy("sheet").agg(F.max_by("row_no", F.struct("n", -F.col("row_no"))).alias("header_row"), F.max("n").alias("n_signals"))
    return best.where(F.col("n_signals") >= LEAST_SIGNALS)


def _take(rows: DataFrame, field: str, keywords: list[str]) -> DataFrame:
    """Adds the column of `h` that a field takes, and blanks it in `h`, so that later fields don't see it."""
    bank, taken = F.array(*[F.lit(x) for x in keywords]), F.col(field)
    hits = F.transform("h", lambda c, i: F.when(F.exists(bank, lambda s: F.contains(c, s)), i))
    rows = rows.withColumn(field, F.get(F.filter(hits, lambda i: i.isNotNull()), F.lit(0)))
    return rows.withColumn("h", F.transform("h", lambda c, i: F.when(i == taken, F.lit("\x00")).otherwise(c)))


def column_map(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet and for each field the 0-based column it takes: the first unused one that contains one of its keywords, else null."""
    heads = headers.select(F.col("sheet").alias("hs"), "header_row")
    rows = grid.join(heads, (F.col("sheet") == F.col("hs")) & (F.col("row_no") == F.col("header_row"))).select("sheet", F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))).alias("h"))
    for field, keywords in FIELD_KEYWORDS.items():
        rows = _take(rows, field, keywords)
    return rows.drop("h")


def grid_items(grid: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """A row for each grid row after the header with a description; numbers without commas, else null."""
    heads = headers.select(F.col("sheet").alias("hs"), "header_row")
    rows = grid.join(heads, F.col("sheet") == F.col("hs")).where(F.col("row_no") > F.col("header_row")).drop("hs").join(mapping, "sheet")
    cell = lambda f: F.nullif(F.trim(F.get("cells", F.col(f))), F.lit(""))
    number = lambda f: F.regexp_replace(cell(f), ",", "").try_cast("double")
    return rows.select("sheet", "row_no", *[(number(f) if f in NUMERIC else cell(f)).alias(f"item_{f}") for f in FIELD_KEYWORDS]).where("item_description is not null")


def item_text(items: DataFrame) -> DataFrame:
    """sheet, row_no and the fields that are not null as `name: value`, joined by ` | `."""
    show = lambda f: F.concat(F.lit(f"{f}: "), F.format_string("%.2f", f"item_{f}") if f in NUMERIC else F.col(f"item_{f}"))
    return items.select("sheet", "row_no", F.concat_ws(" | ", *[F.when(F.col(f"item_{f}").isNotNull(), show(f)) for f in FIELD_KEYWORDS]).alias("text"))


def grid_text_chunks(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, chunk_no, n_rows, text: 25 rows that are not empty a chunk, each as `Row n: header: value | ...`.

    Blank cells are left out before values meet headers, so values after a blank shift to the left.
    """
    heads = headers.select(F.col("sheet").alias("hs"), "header_row")
    head = grid.join(heads, (F.col("sheet") == F.col("hs")) & (F.col("row_no") == F.col("header_row"))).select("hs", F.col("row_no").alias("hr"), F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "").alias("names"))
    filled = grid.withColumn("values", F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""))
    rows = filled.join(head, F.col("sheet") == F.col("hs")).where((F.col("row_no") > F.col("hr")) & (F.size("values") > 0))
    pairs = F.zip_with(F.slice("names", 1, F.size("values")), F.col("values"), lambda n, v: F.when(v.isNull(), F.lit(None)).when(n.isNull(), v).otherwise(F.concat(n, F.lit(": "), v)))
    line = F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.array_join(pairs, " | "))
    numbered = rows.select("sheet", "row_no", line.alias("line"), F.floor((F.row_number().over(Window.partitionBy("sheet").orderBy("row_no", line)) - 1) / ROWS_PER_CHUNK).cast("long").alias("chunk_no"))
    return numbered.groupBy("sheet", "chunk_no").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


__all__ = ["column_map", "delimited_grid", "grid_items", "grid_text_chunks", "header_rows", "item_text", "manifest"]
