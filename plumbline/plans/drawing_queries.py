"""Queries over grids, file names, callouts, drawing entities, catalogs and events, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures, routing
from ..operators import geometry, matching
from ..sources import grid
from ..streaming import intake
from .document_queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each supplier: a title, a header (of one of two forms) and its line items, some without description or amount."""
    sheet = F.col("l_suppkey").alias("sheet")
    rows = table(spark, d, "lineitem").select(sheet, (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10).alias("row_no"), F.array(
        F.col("l_linenumber").cast("string"), F.expr("if(l_orderkey % 6 = 0, '', concat('part ', l_partkey))"), F.expr("cast(cast(l_quantity as bigint) as string)"), F.lit("nos"),
        F.expr("concat(cast(l_partkey div 1000 as string), ',', lpad(cast(l_partkey % 1000 as string), 3, '0'))"), F.expr("if(l_orderkey % 4 = 0, 'n/a', cast(l_orderkey as string))"),
    ).alias("cells"))
    s = table(spark, d, "lineitem").select(sheet).distinct()
    title = s.select("sheet", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Tender")).alias("cells"))
    a, b = (F.array(*[F.lit(x) for x in h]) for h in (("Sl No", "Description", "Qty", "Unit", "Unit Rate", "Amount"), ("Item", "Particulars", "Quantity", "UOM", "Price", "Total")))
    header = s.select("sheet", F.lit(1).cast("long").alias("row_no"), F.when(F.col("sheet") % 2 == 0, a).otherwise(b).alias("cells"))
    return title.union(header).union(rows)


_GRID = """gr AS (SELECT l_suppkey sheet, l_orderkey * 10 + l_linenumber + 10 row_no, l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT q FROM lineitem),
its AS (SELECT sheet, row_no, l_linenumber::VARCHAR item_item_number, 'part ' || l_partkey item_description, q::DOUBLE item_quantity, 'nos' item_unit, l_partkey::DOUBLE item_rate, CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey::DOUBLE END item_amount FROM gr WHERE l_orderkey % 6 <> 0)"""


@query("SELECT DISTINCT l_suppkey sheet, 1::BIGINT header_row, 6 n_signals FROM lineitem WHERE l_suppkey % 2 = 0 UNION SELECT DISTINCT l_suppkey, 1, 5 FROM lineitem WHERE l_suppkey % 2 = 1")
def header_row(spark, d):
    return grid.header_rows(_grid(spark, d))


@query("SELECT DISTINCT l_suppkey sheet, 0 item_number, 1 description, 2 quantity, 3 unit, 4 rate, 5 amount, NULL::INT category, NULL::INT sub_category FROM lineitem")
def column_map(spark, d):
    g = _grid(spark, d)
    return grid.column_map(g, grid.header_rows(g))


def _items(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    heads = grid.header_rows(g)
    return grid.grid_items(g, heads, grid.column_map(g, heads))


@query(f"WITH {_GRID} SELECT sheet, row_no, item_item_number, item_description, item_quantity, item_unit, item_rate, item_amount FROM its")
def grid_items(spark, d):
    return _items(spark, d).drop("item_category", "item_sub_category")


@query(f"""WITH {_GRID} SELECT sheet, row_no, concat_ws(' | ', 'item_number: ' || item_item_number, 'description: ' || item_description, 'quantity: ' || printf('%.2f', item_quantity), 'unit: nos', 'rate: ' || printf('%.2f', item_rate), 'amount: ' || printf('%.2f', item_amount)) AS text FROM its""")
def item_text(spark, d):
    return grid.item_text(_items(spark, d))


@query(f"""WITH {_GRID}, v AS (SELECT sheet, row_no, CASE WHEN sheet % 2 = 0 THEN ['Sl No', 'Description', 'Qty', 'Unit', 'Unit Rate', 'Amount'] ELSE ['Item', 'Particulars', 'Quantity', 'UOM', 'Price', 'Total'] END h,
list_filter([l_linenumber::VARCHAR, CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'part ' || l_partkey END, q::VARCHAR, 'nos', (l_partkey // 1000) || ',' || lpad((l_partkey % 1000)::VARCHAR, 3, '0'), CASE WHEN l_orderkey % 4 = 0 THEN 'n/a' ELSE l_orderkey::VARCHAR END], lambda x: x <> '') c FROM gr),
t AS (SELECT sheet, row_no, 'Row ' || row_no || ': ' || array_to_string(list_transform(range(1, len(c) + 1), lambda i: h[i] || ': ' || c[i]), ' | ') line FROM v),
n AS (SELECT *, (row_number() OVER (PARTITION BY sheet ORDER BY row_no, line) - 1) // 25 chunk_no FROM t) SELECT sheet, chunk_no, count(*) n_rows, string_agg(line, chr(10) ORDER BY row_no, line) AS text FROM n GROUP BY ALL""")
def grid_text_chunks(spark, d):
    g = _grid(spark, d)
    return grid.grid_text_chunks(g, grid.header_rows(g))


@query(SQL["grid_text_chunks"])
def grid_text_chunks_whole(spark, d):
    # The same rows as grid_text_chunks, kept under their earlier name.
    g = _grid(spark, d)
    return grid.grid_text_chunks(g, grid.header_rows(g))


_NAMES = """fn AS (SELECT doc_id, ['Tender Drg ', 'spec_', 'General Conditions ', 'BOQ-', 'Compliance Matrix ', 'notes_'][doc_id % 6 + 1] || doc_id || ['.pdf', '.docx', '.XLSX', '.dxf', '.png'][(doc_id // 6) % 5 + 1] filename FROM documents),
ft AS (SELECT *, CASE WHEN filename LIKE '%.pdf' THEN CASE WHEN doc_id % 6 = 0 THEN 'pdf_drawing' ELSE 'pdf_spec' END WHEN filename LIKE '%.docx' THEN 'docx_spec' WHEN filename LIKE '%.XLSX' THEN 'excel_boq' WHEN filename LIKE '%.dxf' THEN 'dxf_drawing' END kind FROM fn)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = "concat(element_at(array('Tender Drg ', 'spec_', 'General Conditions ', 'BOQ-', 'Compliance Matrix ', 'notes_'), cast(doc_id % 6 + 1 as int)), doc_id, element_at(array('.pdf', '.docx', '.XLSX', '.dxf', '.png'), cast((doc_id div 6) % 5 + 1 as int)))"
    return table(spark, d, "documents").select("doc_id", F.expr(name).alias("filename"))


@query(f"WITH {_NAMES} SELECT doc_id, kind, CASE kind WHEN 'excel_boq' THEN 100 WHEN 'pdf_spec' THEN 80 WHEN 'docx_spec' THEN 80 WHEN 'pdf_drawing' THEN 60 WHEN 'dxf_drawing' THEN 60 ELSE 10 END priority FROM ft")
def file_type(spark, d):
    rows = _names(spark, d).withColumn("kind", routing.file_type(F.col("filename")))
    return rows.select("doc_id", "kind", routing.priority(F.col("kind")).alias("priority"))


@query(f"""WITH {_NAMES} SELECT doc_id, CASE WHEN kind IN ('pdf_drawing', 'dxf_drawing') THEN 'drawing' WHEN kind = 'excel_boq' THEN 'boq' ELSE ['drawing', 'specification', 'gcc', 'boq', 'matrix', 'specification'][doc_id % 6 + 1] END AS role FROM ft""")
def document_role(spark, d):
    rows = _names(spark, d)
    return rows.select("doc_id", routing.document_role(F.col("filename"), routing.file_type(F.col("filename"))).alias("role"))


_PAGES = "pg AS (SELECT page_id // 10 doc_id, page_id % 10 + 1 page_no, length(html) % 4000 chars, length(url) * 97 % 2000 draws, CASE page_id % 4 WHEN 0 THEN 'drawing' WHEN 1 THEN 'scanned' ELSE 'text' END page_type FROM pages)"
_ROUTE = "CASE WHEN chars < 100 OR (chars < 3000 AND draws > 1000) THEN 'vision' ELSE 'text' END"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    e = ["page_id div 10 doc_id", "page_id % 10 + 1 page_no", "length(html) % 4000 chars", "length(url) * 97 % 2000 draws", "case page_id % 4 when 0 then 'drawing' when 1 then 'scanned' else 'text' end page_type"]
    return table(spark, d, "pages").selectExpr(*e)


@query(f"WITH {_PAGES} SELECT doc_id, page_no, {_ROUTE} route FROM pg")
def page_routing(spark, d):
    return routing.routed_pages(_pages(spark, d)).select("doc_id", "page_no", "route")


@query(f"WITH {_PAGES} SELECT doc_id, avg(chars) < 100 OR avg(draws) > 500 is_drawing FROM pg WHERE page_no <= 5 GROUP BY doc_id")
def content_sampling(spark, d):
    return routing.sampled_kind(_pages(spark, d))


@query(f"""WITH {_PAGES}, m AS (SELECT doc_id, (count(*) FILTER (page_type = 'drawing')) / count(*) a, (count(*) FILTER ({_ROUTE} = 'vision')) / count(*) v, count(*) FILTER (page_type = 'scanned') s, count(*) FILTER (page_type = 'drawing') g FROM pg GROUP BY doc_id)
SELECT doc_id, round(a, 6) drawing_share, round(v, 6) vision_share, CASE WHEN a > 0.5 THEN 'pdf_drawing' WHEN v > 0.5 AND s > g THEN 'pdf_spec' WHEN a > 0.15 OR v > 0.15 AND g > 0 THEN 'pdf_mixed' ELSE 'pdf_spec' END kind FROM m""")
def doc_reclass(spark, d):
    return routing.mixed_kind(routing.routed_pages(_pages(spark, d)))


@query("SELECT doc_id, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 3 THEN 'table' ELSE 'text' END kind FROM documents")
def markdown_page_type(spark, d):
    return table(spark, d, "documents").select("doc_id", routing.markdown_page_type(F.col("text")).alias("kind"))


@query("SELECT p_partkey, p_size * ([1, 10, 1000, 25.4, 304.8, NULL]::DOUBLE[])[p_partkey % 6 + 1] mm FROM part")
def unit_to_mm(spark, d):
    unit = F.expr("element_at(array('mm.', ' CM', 'metre', 'inches', 'ft', 'cubit'), cast(p_partkey % 6 + 1 as int))")
    return table(spark, d, "part").select("p_partkey", measures.to_mm(F.col("p_size").cast("double"), unit).alias("mm"))


@query("SELECT p_partkey, p_size::DOUBLE first, (p_size + 5)::DOUBLE AS second, (p_size * 2)::DOUBLE width, (p_size * 3)::DOUBLE height FROM part")
def dim_matches(spark, d):
    text = F.expr("concat(p_name, ' ', p_size, ' mm glass, ', p_size + 5, 'mm thk; panel ', p_size * 2, ' x ', p_size * 3, ' mm each ', p_size, ' mmol')")
    v, p = measures.dimension_values_mm(text), measures.dimension_pairs_mm(text)
    return table(spark, d, "part").select("p_partkey", v[0].alias("first"), v[1].alias("second"), p[0][0].alias("width"), p[0][1].alias("height"))


@query("""WITH t AS (SELECT p_partkey, p_size || 'OlI' || p_brand || 'S' || p_size || 'B' AS t FROM part), c AS (SELECT p_partkey, string_split(t, '') c FROM t)
SELECT p_partkey, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN (i > 1 AND regexp_full_match(c[i - 1], '[0-9]')) OR regexp_full_match(coalesce(c[i + 1], ''), '[0-9]') THEN CASE c[i] WHEN 'O' THEN '0' WHEN 'o' THEN '0' WHEN 'I' THEN '1' WHEN 'l' THEN '1' WHEN 'S' THEN '5' WHEN 'B' THEN '8' WHEN 'Z' THEN '2' WHEN 'G' THEN '6' ELSE c[i] END ELSE c[i] END), '') fixed FROM c""")
def ocr_fix(spark, d):
    return table(spark, d, "part").select("p_partkey", measures.ocr_corrected(F.expr("concat(p_size, 'OlI', p_brand, 'S', p_size, 'B')")).alias("fixed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size END denominator, p_partkey % 4 = 3 nts FROM part")
def scale_parse(spark, d):
    text = F.expr("case p_partkey % 4 when 0 then concat('SCALE 1:', p_size) when 1 then concat('scale 1 / ', p_size) when 2 then concat('1=', p_size) else concat('NTS 1:', p_size) end")
    return table(spark, d, "part").select("p_partkey", measures.scale_denominator(text).alias("denominator"), measures.not_to_scale(text).alias("nts"))


#: Drawing entities from line items: one sheet for each 40 orders.
_LINES = """ln AS (SELECT l_orderkey // 40 sheet, l_orderkey * 10 + l_linenumber line_no, (l_partkey % 300)::DOUBLE x0, (l_suppkey % 50 * 7 + l_linenumber)::DOUBLE y0,
  CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 300 + l_quantity ELSE l_partkey % 300 END x1, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 50 * 7 + l_linenumber ELSE l_suppkey % 50 * 7 + l_linenumber + l_quantity END y1, CASE WHEN l_orderkey % 2 = 0 THEN 'HORIZONTAL' ELSE 'VERTICAL' END orientation FROM lineitem),
tx AS (SELECT o_orderkey // 40 sheet, o_orderkey text_no, o_orderpriority AS text, (o_custkey % 400)::DOUBLE x, (o_orderkey % 350)::DOUBLE y FROM orders),
dm AS (SELECT sheet, text_no dim_no, x, y FROM tx WHERE text_no % 5 = 0)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = ["l_orderkey div 40 sheet", "l_orderkey * 10 + l_linenumber line_no", "cast(l_partkey % 300 as double) x0", "cast(l_suppkey % 50 * 7 + l_linenumber as double) y0",
         "if(l_orderkey % 2 = 0, l_partkey % 300 + l_quantity, l_partkey % 300) x1", "if(l_orderkey % 2 = 0, l_suppkey % 50 * 7 + l_linenumber, l_suppkey % 50 * 7 + l_linenumber + l_quantity) y1"]
    lines = table(spark, d, "lineitem").selectExpr(*e)
    return lines.withColumn("orientation", measures.line_orientation(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey div 40 sheet", "o_orderkey text_no", "o_orderpriority text", "cast(o_custkey % 400 as double) x", "cast(o_orderkey % 350 as double) y")


def _dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where("text_no % 5 = 0").selectExpr("sheet", "text_no dim_no", "x", "y")


@query(f"""WITH {_LINES}, n AS (SELECT *, CASE WHEN orientation = 'HORIZONTAL' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END p, CASE WHEN orientation = 'HORIZONTAL' THEN least(x0, x1) ELSE least(y0, y1) END lo, CASE WHEN orientation = 'HORIZONTAL' THEN greatest(x0, x1) ELSE greatest(y0, y1) END hi FROM ln),
q AS (SELECT a.sheet, a.orientation, round_even(abs(a.p - b.p), 1) v, abs(a.p - b.p) s, a.line_no a_no, b.line_no b_no FROM n a JOIN n b ON a.sheet = b.sheet AND a.orientation = b.orientation AND a.line_no < b.line_no WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 5)
SELECT sheet, orientation, v AS value, min((a_no, b_no))[1] a_no, min((a_no, b_no))[2] b_no FROM q WHERE s BETWEEN 0.5 AND 5000 GROUP BY ALL""")
def line_pairs(spark, d):
    return geometry.line_pairs(_lines(spark, d)).select("sheet", "orientation", "value", "a_no", "b_no")


def _nearby_sql(radius: float) -> str:
    return f"""WITH {_LINES}, w AS (SELECT dm.sheet, dim_no, text_no, unnest(string_split(lower(text), ' ')) t, unnest(range(0, len(string_split(text, ' ')))) i FROM dm JOIN tx ON dm.sheet = tx.sheet AND sqrt((dm.x - tx.x) ** 2 + (dm.y - tx.y) ** 2) <= {radius}),
f AS (SELECT sheet, dim_no, t, min((text_no, i)) o FROM w WHERE t <> '' GROUP BY ALL)
SELECT sheet, dim_no, array_to_string((list(t ORDER BY o))[1:30], ' ') words FROM f GROUP BY ALL"""


@query(_nearby_sql(100))
def nearby_words(spark, d):
    return geometry.nearby_words(_dimensions(spark, d), _texts(spark, d), 100.0).select("sheet", "dim_no", F.array_join("words", " ").alias("words"))


@query(_nearby_sql(geometry.NEARBY))
def nearby_words_whole(spark, d):
    # The radius of the reference; that of nearby_words is smaller.
    return geometry.nearby_words(_dimensions(spark, d), _texts(spark, d)).select("sheet", "dim_no", F.array_join("words", " ").alias("words"))


def _nearest_sql(radius: float) -> str:
    return f"""WITH {_LINES}, q AS (SELECT dm.sheet, dim_no point_no, line_no, orientation, sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2) s FROM dm JOIN ln ON dm.sheet = ln.sheet)
SELECT sheet, point_no, arg_min(line_no, (s, line_no)) line_no, arg_min(orientation, (s, line_no)) orientation FROM q WHERE s <= {radius} GROUP BY ALL"""


@query(_nearest_sql(50))
def nearest_line(spark, d):
    return geometry.nearest_line(_dimensions(spark, d).withColumnRenamed("dim_no", "point_no"), _lines(spark, d), 50.0)


@query(_nearest_sql(geometry.NEARBY))
def nearest_line_whole(spark, d):
    # The radius of the reference; that of nearest_line is smaller.
    return geometry.nearest_line(_dimensions(spark, d).withColumnRenamed("dim_no", "point_no"), _lines(spark, d))


def _spacing_sql(axis: str) -> str:
    return f"""SELECT sheet, bin, n, round_even(bin * w + 5, 1) spacing, '{axis}' axis FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n DESC, bin) r FROM (
SELECT sheet, floor(gap / w)::BIGINT bin, any_value(w) w, count(*) n FROM (SELECT *, (m + 10) / (floor(m / 10) + 1) w FROM (SELECT *, max(gap) OVER (PARTITION BY sheet) m FROM (
SELECT a.sheet, b.p - a.p gap FROM m{axis} a JOIN m{axis} b ON a.sheet = b.sheet WHERE b.p - a.p BETWEEN 50 AND 10000))) GROUP BY ALL) WHERE n >= 2) WHERE r <= 3"""


_SPACINGS = f"WITH {_LINES}, " + ", ".join(f"m{a} AS (SELECT DISTINCT sheet, round_even(({a}0 + {a}1) / 2, 1) p FROM ln)" for a in "xy") + " " + " UNION ALL ".join(map(_spacing_sql, "xy"))


@query(_SPACINGS)
def spacing_hist(spark, d):
    along = [geometry.spacing_histogram(_lines(spark, d).selectExpr("sheet", f"({a}0 + {a}1) / 2 p")).withColumn("axis", F.lit(a)) for a in "xy"]
    return along[0].unionByName(along[1])


@query(_SPACINGS)
def spacing_hist_whole(spark, d):
    # The same rows as spacing_hist, kept under their earlier name.
    return spacing_hist(spark, d)


@query(f"""WITH {_LINES}, c AS (SELECT sheet, (round_even(y / 5, 0) * 5)::DOUBLE row_y, list(text ORDER BY x, text_no) c FROM tx GROUP BY ALL) SELECT sheet, row_y, c[1] AS label, array_to_string(c[2:], '|') AS vals FROM c""")
def schedule_rows(spark, d):
    return geometry.schedule_rows(_texts(spark, d)).select("sheet", "row_y", "label", F.array_join("values", "|").alias("vals"))


@query(f"WITH {_LINES} SELECT sheet, text_no FROM tx WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.sheet = tx.sheet AND dm.x = tx.x AND dm.y = tx.y)")
def uncovered_texts(spark, d):
    return geometry.uncovered(_texts(spark, d), _dimensions(spark, d)).select("sheet", "text_no")


#: A catalog of the kinds of names of parts, with two aliases each; some hundred entries at any scale.
_CATALOG = """ca AS (SELECT *, [name, name || ' mm', split_part(name, ' ', 2) || ' economy'] ns, ['HORIZONTAL', 'VERTICAL', 'ANY'][entry_id % 3 + 1] way, CASE WHEN entry_id % 2 = 0 THEN ['PLAN', 'DETAIL'] ELSE [] END types
  FROM (SELECT name, row_number() OVER (ORDER BY name) entry_id FROM (SELECT DISTINCT p_name AS name FROM part))),
me AS (SELECT p_partkey measure_id, lower(p_name || ' ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' wide' ELSE '' END || ' ' || p_size || ' mm') q, ['HORIZONTAL', 'ANY', 'VERTICAL'][p_partkey % 3 + 1] way, ['PLAN', 'SECTION', 'UNKNOWN', 'DETAIL'][p_partkey % 4 + 1] st FROM part),
nm AS (SELECT entry_id, list_sort(list_distinct(string_split(lower(unnest(ns)), ' '))) nw FROM ca), qt AS (SELECT DISTINCT q, list_sort(list_distinct(string_split(q, ' '))) qw FROM me),
pq AS (SELECT q, entry_id, array_to_string(list_filter(qw, lambda x: list_contains(nw, x)), ' ') both_w, array_to_string(list_filter(qw, lambda x: NOT list_contains(nw, x)), ' ') own, array_to_string(list_filter(nw, lambda x: NOT list_contains(qw, x)), ' ') other,
  len(list_filter(nw, lambda x: NOT contains(q, x))) = 0 hit FROM qt, nm),
dd AS (SELECT own, other, len(own) + len(other) - 2 * (len(other) - bit_count(list_reduce(string_split(own, ''), lambda s, c: (s + (s & m[c])) | (s - (s & m[c])), (1::BIGINT << len(other)) - 1) & ((1::BIGINT << len(other)) - 1))) d
  FROM (SELECT *, map_from_entries(list_transform(list_distinct(string_split(own, '')), lambda c: {'k': c, 'v': list_sum(list_transform(range(1, len(other) + 1), lambda i: CASE WHEN other[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT})) m
    FROM (SELECT DISTINCT own, other FROM pq WHERE own <> '' AND other <> ''))),
pr AS (SELECT q, entry_id, max(CASE WHEN own = '' OR other = '' THEN CASE WHEN both_w = '' THEN 0 ELSE 1 END
    ELSE greatest((wo + wx - d) / (wo + wx), CASE WHEN b > 0 THEN 2 * b / (b + wo) ELSE 0 END, CASE WHEN b > 0 THEN 2 * b / (b + wx) ELSE 0 END) END) overlap, bool_or(hit) hit
  FROM (SELECT pq.*, d, len(both_w) b, len(both_w) + (both_w <> '')::INT + len(own) wo, len(both_w) + (both_w <> '')::INT + len(other) wx FROM pq LEFT JOIN dd USING (own, other)) GROUP BY ALL),
sc AS (SELECT measure_id, entry_id, overlap, hit keyword_hit, ca.way = 'ANY' OR me.way = 'ANY' OR ca.way = me.way direction_ok, len(types) = 0 OR st = 'UNKNOWN' OR list_contains(types, st) sheet_ok FROM pr JOIN ca USING (entry_id) JOIN me USING (q) WHERE overlap >= 0.4),
sr AS (SELECT *, round_even(CASE WHEN keyword_hit THEN least(1.0, overlap * 1.2::DOUBLE) ELSE overlap END * CASE WHEN direction_ok THEN 1 ELSE 0.5 END * CASE WHEN sheet_ok THEN 1 ELSE 0.7::DOUBLE END, 4) score FROM sc),
fm AS (SELECT * EXCLUDE (n, overlap), round_even(overlap, 4) overlap FROM (SELECT *, row_number() OVER (PARTITION BY measure_id ORDER BY score DESC, entry_id) n FROM sr WHERE score >= 0.3) WHERE n = 1)"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    rows = names.withColumn("entry_id", F.row_number().over(Window.orderBy("name")).cast("long"))
    pick = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return rows.select(
        "entry_id", "name", F.array(F.concat("name", F.lit(" mm")), F.concat(F.split_part("name", F.lit(" "), F.lit(2)), F.lit(" economy"))).alias("aliases"),
        F.element_at(pick("HORIZONTAL", "VERTICAL", "ANY"), F.expr("cast(entry_id % 3 + 1 as int)")).alias("direction"), F.when(F.expr("entry_id % 2 = 0"), pick("PLAN", "DETAIL")).otherwise(F.array().cast("array<string>")).alias("sheet_types"),
    )


def _matched(spark: SparkSession, d: str) -> DataFrame:
    e = ["p_partkey measure_id", "array(p_name, p_type, if(p_partkey % 2 = 0, 'wide', null)) words", "concat(p_size, ' mm') source_text",
         "element_at(array('HORIZONTAL', 'ANY', 'VERTICAL'), cast(p_partkey % 3 + 1 as int)) direction", "element_at(array('PLAN', 'SECTION', 'UNKNOWN', 'DETAIL'), cast(p_partkey % 4 + 1 as int)) sheet_type"]
    asked = table(spark, d, "part").selectExpr(*e)
    return matching.fuzzy_match(asked.withColumn("context_words", F.filter("words", lambda w: w.isNotNull())), _catalog(spark, d))


@query(f"WITH {_CATALOG} SELECT measure_id, entry_id, score, overlap, keyword_hit, direction_ok, sheet_ok FROM fm")
def fuzzy_match(spark, d):
    return _matched(spark, d)


@query(f"""WITH {_CATALOG}, c AS (SELECT entry_id, measure_id, score, p_size::DOUBLE AS value, (p_partkey % 10) / 10 confidence FROM fm JOIN part ON measure_id = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY confidence * score DESC, measure_id) r FROM c),
l AS (SELECT entry_id, measure_id, value, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.entry_id = r.entry_id AND o.r > 1 AND abs(o.value - r.value) <= 0.05::DOUBLE * greatest(r.value, 1)) THEN least(1, confidence * 1.1) ELSE confidence END confidence FROM r WHERE r = 1)
SELECT entry_id, measure_id, value, round(confidence, 6) confidence FROM l WHERE confidence >= 0.5""")
def agreement_bonus(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("measure_id"), F.col("p_size").cast("double").alias("value"), (F.expr("p_partkey % 10") / 10).alias("confidence"))
    m = _matched(spark, d).select("measure_id", "entry_id", "score")
    return matching.best_candidates(m.join(p, "measure_id"), m.select("entry_id").distinct().withColumn("threshold", F.lit(0.5)))


_SPEC = """sp AS (SELECT * FROM (VALUES ('Brand#11', 20.0, 1.0, 'MIN'), ('Brand#12', 30.0, 2.0, 'MAX'), ('Brand#13', 25.0, 3.0, 'EXACT')) t(name, spec_value, tolerance, direction)),
va AS (SELECT p_partkey, p_brand AS name, p_size::DOUBLE AS value FROM part),
ck AS (SELECT p_partkey, name, value, value - spec_value delta, CASE WHEN spec_value IS NULL THEN 'NO_SPEC' WHEN CASE direction WHEN 'MIN' THEN value - spec_value >= -tolerance WHEN 'MAX' THEN value - spec_value <= tolerance ELSE abs(value - spec_value) <= tolerance END THEN 'MATCH' ELSE 'CONFLICT' END status FROM va LEFT JOIN sp USING (name))"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([("Brand#11", 20.0, 1.0, "MIN"), ("Brand#12", 30.0, 2.0, "MAX"), ("Brand#13", 25.0, 3.0, "EXACT")], "name string, spec_value double, tolerance double, direction string")
    return matching.spec_check(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_size").cast("double").alias("value")), F.broadcast(specs))


@query(f"WITH {_SPEC} SELECT p_partkey, name, value, delta, status FROM ck")
def spec_check(spark, d):
    return _checked(spark, d)


@query(f"""WITH {_SPEC} SELECT name sheet, count(*) n_entries, count(*) FILTER (p_partkey % 4 <> 0) n_extracted, count(*) FILTER (p_partkey % 4 = 0) n_not_found, count(*) FILTER (status = 'CONFLICT') n_conflicts, round(avg(CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 10) / 10 END), 6) mean_confidence FROM ck GROUP BY name""")
def extraction_summary(spark, d):
    rows = _checked(spark, d).withColumn("found", F.expr("p_partkey % 4 <> 0")).withColumn("confidence", F.expr("p_partkey % 10") / 10)
    return matching.extraction_summary(rows.withColumnRenamed("name", "sheet"))


@query(f"""WITH {_SPEC} SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'NOT_FOUND' WHEN status = 'CONFLICT' THEN 'CONFLICT' WHEN (p_partkey % 10) / 10 < 0.75 THEN 'LOW_CONFIDENCE' WHEN status = 'MATCH' THEN 'MATCH' ELSE 'NO_SPEC' END status FROM ck""")
def output_status(spark, d):
    c = F.col("status")
    return _checked(spark, d).select("p_partkey", measures.output_status(F.expr("p_partkey % 4 <> 0"), c == "CONFLICT", F.expr("p_partkey % 10") / 10, c == "MATCH").alias("status"))


_EVENTS = "ev AS (SELECT user_id::VARCHAR project, event_id, epoch_us(ts)::DOUBLE / 3.6e9 AS seconds, event_type document_id, CASE WHEN event_type = 'purchase' THEN 100 ELSE 60 END priority FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as document arrivals, an hour of the table to a second."""
    e = table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 3.6e9
    return e.select(F.col("user_id").cast("string").alias("project"), "event_id", seconds.alias("seconds"), F.col("event_type").alias("document_id"), F.expr("if(event_type = 'purchase', 100, 60)").alias("priority"), "value")


@query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seconds, event_id) n FROM ev),
r AS (SELECT project, n, event_id, seconds AS first, seconds AS last, 0 AS burst FROM o WHERE n = 1 UNION ALL
SELECT o.project, o.n, o.event_id, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN o.seconds ELSE r.first END, o.seconds, CASE WHEN o.seconds >= least(r.last + 3, r.first + 20) THEN r.burst + 1 ELSE r.burst END FROM r JOIN o ON o.project = r.project AND o.n = r.n + 1)
SELECT project, burst::BIGINT burst_no, count(*) n_events, least(max(last) + 3, min(first) + 20) fired_at, string_agg(event_id, ',' ORDER BY n) event_ids FROM r GROUP BY ALL""")
def debounce_bursts(spark, d):
    return intake.bursts(_events(spark, d)).withColumn("event_ids", F.array_join(F.col("event_ids").cast("array<string>"), ","))


@query(f"""WITH {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seconds, event_id) n FROM ev), s AS (SELECT project, n, (SELECT count(DISTINCT document_id) FROM o p WHERE p.project = o.project AND p.n <= o.n) k, max(priority) OVER (PARTITION BY project ORDER BY n) t FROM o)
SELECT project, min(n) event_no FROM s WHERE k >= 2 OR t >= 80 GROUP BY project""")
def first_pass_gate(spark, d):
    return intake.first_pass(_events(spark, d))


@query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT project, ev.document_id AS parameter, events.value, ev.event_id % 101 / 100 confidence, ev.event_id % 3 * 20 + 60 AS priority, row_number() OVER (PARTITION BY project, document_id ORDER BY seconds, ev.event_id) n FROM ev JOIN events USING (event_id)),
r AS (SELECT project, parameter, n, value, confidence, priority, 0::BIGINT changes, []::DOUBLE[] history FROM o WHERE n = 1 UNION ALL
SELECT project, parameter, n, CASE WHEN w THEN v ELSE value END, CASE WHEN w THEN c ELSE confidence END, CASE WHEN w THEN p ELSE priority END, changes + (w AND v <> value)::BIGINT, CASE WHEN w AND v <> value THEN history || [value] ELSE history END
FROM (SELECT r.* EXCLUDE (n), o.n, o.value v, o.confidence c, o.priority p, o.confidence >= r.confidence + 0.05::DOUBLE OR abs(o.confidence - r.confidence) < 0.05::DOUBLE AND o.priority > r.priority w FROM r JOIN o ON o.project = r.project AND o.parameter = r.parameter AND o.n = r.n + 1))
SELECT project, parameter, arg_max(value, n) AS value, arg_max(confidence, n) confidence, arg_max(priority, n) priority, max(changes) change_count, array_to_string(list_transform(arg_max(history, n), lambda x: printf('%.2f', x)), ',') history FROM r GROUP BY ALL""")
def incremental_merge(spark, d):
    e = _events(spark, d).withColumn("parameter", F.col("document_id")).withColumn("confidence", F.expr("event_id % 101") / 100).withColumn("priority", F.expr("event_id % 3 * 20 + 60"))
    return intake.merged_values(e).withColumn("history", F.array_join(F.transform("history", lambda x: F.format_string("%.2f", x)), ","))


@query(f"WITH {_EVENTS}, i AS (SELECT DISTINCT project, document_id FROM ev) SELECT * FROM i WHERE (project, document_id) NOT IN (SELECT (project, document_id) FROM ev WHERE event_id % 3 = 0)")
def new_documents(spark, d):
    e = _events(spark, d)
    return intake.new_documents(e.select("project", "document_id").distinct(), e.where("event_id % 3 = 0").select("project", "document_id").distinct())
