"""Queries over sheets, callouts, measurements, prompts and stored sources, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, geometry, measurements, results, sheets
from ..operators.scratch import written
from .document_queries import _BLOCKS, _filled, table
from .drawing_queries import SQL as SQL_OF
from .drawing_queries import _LINES, _dimensions, _lines, _spacing_sql, _texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LABELS = ("Floor plan", "wall section A", "NORTH ELEVATION", "typ detail", "door schedule", "set out", "key plan", "list of parts")
_HITS = {k: " + ".join(f"len(regexp_extract_all(t, '\\b{w}\\b'))" for w in words) for k, words in sheets.SHEET_KEYWORDS.items()}
#: Labels, and words at the end of one text and the beginning of another that make a phrase where the texts meet.
_TEXT = "CASE WHEN p_partkey % 5 = 1 THEN 'plan ' WHEN p_partkey % 7 = 3 THEN 'elevation ' ELSE '' END || {label} || ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' Floor' WHEN 1 THEN ' front' ELSE '' END"
_SHEET_TEXTS = f"""st AS (SELECT p_size sheet, string_agg(lower({_TEXT.format(label="[" + ', '.join(f"'{x}'" for x in _LABELS) + "][p_partkey % 8 + 1]")}), ' ' ORDER BY p_partkey) || repeat(CASE WHEN p_size % 3 = 0 THEN ' typical detail' ELSE ' sheet' END, 3) t FROM part GROUP BY p_size),
hs AS (SELECT sheet, {', '.join(f'({sql})::BIGINT AS {k.lower()}' for k, sql in _HITS.items())} FROM st),
hl AS (SELECT sheet, unnest([{', '.join(f"{{'s': {k.lower()}, 'r': {-i}, 'k': '{k}'}}" for i, k in enumerate(sheets.SHEET_PRIORITY))}]) h, {' + '.join(k.lower() for k in sheets.SHEET_KEYWORDS)} n FROM hs)"""


@query(f"""WITH {_SHEET_TEXTS} SELECT sheet, CASE WHEN max(h.s) > 0 THEN arg_max(h.k, (h.s, h.r)) ELSE 'UNKNOWN' END sheet_type, max(h.s) score, CASE WHEN max(h.s) > 0 THEN round_even(least(1.0, max(h.s) / any_value(n) * 6), 3) ELSE 0 END confidence FROM hl GROUP BY sheet""")
def sheet_type(spark, d):
    p = table(spark, d, "part")
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.expr("cast(p_partkey % 8 + 1 as int)"))
    titles = p.select(F.col("p_size").alias("sheet")).distinct().select("sheet", F.expr("if(sheet % 3 = 0, 'typical detail', 'sheet')").alias("title"))
    texts = p.withColumn("label", label).select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("text_no"), F.expr(_TEXT.format(label="label")).alias("text"))
    return sheets.sheet_types(texts, titles)


_BLOCK_TEXT = "'Project: ' || c_name || chr(10) || 'Client: ' || c_mktsegment || chr(10) || 'DRG NO: FA-' || lpad(c_custkey::VARCHAR, 4, '0') || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Rev: ' || (c_custkey % 10)::VARCHAR END || chr(10) || 'Date: 0' || (c_custkey % 9 + 1)::VARCHAR || '/11/2024'"
_FIELD_SQL = ", ".join("coalesce(" + ", ".join("nullif(trim(regexp_extract(t, '(?im)" + p.replace("'", "''") + "', 1)), '')" for p in patterns) + f") AS {f}" for f, patterns in sheets.FIELD_PATTERNS.items())


@query(f"WITH x AS (SELECT c_custkey, {_BLOCK_TEXT} t FROM customer) SELECT c_custkey, {_FIELD_SQL} FROM x")
def titleblock_fields(spark, d):
    text = F.expr("concat('Project: ', c_name, '\\n', 'Client: ', c_mktsegment, '\\n', 'DRG NO: FA-', lpad(c_custkey, 4, '0'), '\\n', if(c_custkey % 3 = 0, '', concat('Rev: ', c_custkey % 10)), '\\n', 'Date: 0', c_custkey % 9 + 1, '/11/2024')")
    return table(spark, d, "customer").select("c_custkey", sheets.titleblock_fields(text).alias("f")).select("c_custkey", "f.*")


_TAGS = "tg AS (SELECT l_orderkey sheet, l_linenumber attribute_no, ['DRG_NO', 'Title', 'REV', 'Drawn By', 'Other', 'Scale', 'Rev No'][l_partkey % 7 + 1] tag, CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE ' v' || l_partkey END AS text FROM lineitem)"
_TAG_SQL = ", ".join(f"arg_min(v, (attribute_no, v)) FILTER (f = '{f}') AS {f}" for f in dict.fromkeys(sheets.TAG_FIELDS.values()))


@query(f"""WITH {_TAGS}, k AS (SELECT sheet, attribute_no, trim(text) v, ['sheet_number', 'sheet_title', 'revision', 'drawn_by', NULL, 'scale_raw', 'revision'][list_position(['DRG_NO', 'Title', 'REV', 'Drawn By', 'Other', 'Scale', 'Rev No'], tag)] f FROM tg)
SELECT sheet, {_TAG_SQL} FROM k WHERE f IS NOT NULL AND v <> '' GROUP BY sheet""")
def titleblock_tags(spark, d):
    e = ["l_orderkey sheet", "l_linenumber attribute_no", "element_at(array('DRG_NO', 'Title', 'REV', 'Drawn By', 'Other', 'Scale', 'Rev No'), cast(l_partkey % 7 + 1 as int)) tag", "if(l_suppkey % 5 = 0, ' ', concat(' v', l_partkey)) text"]
    return sheets.titleblock_from_tags(table(spark, d, "lineitem").selectExpr(*e))


@query("""WITH l AS (SELECT DISTINCT p_type || ' ' || p_brand layer FROM part), s AS (SELECT layer, unnest([{'g': 'metal', 'n': (lower(layer) LIKE '%steel%')::INT + (lower(layer) LIKE '%brass%')::INT}, {'g': 'finish', 'n': (lower(layer) LIKE '%polish%')::INT + (lower(layer) LIKE '%anod%')::INT}, {'g': 'kind', 'n': (lower(layer) LIKE '%promo%')::INT + (lower(layer) LIKE '%#1%')::INT}]) g FROM l)
SELECT layer, g.g AS "group", g.n score FROM s WHERE g.n >= 1""")
def layer_groups(spark, d):
    layers = table(spark, d, "part").select(F.concat("p_type", F.lit(" "), "p_brand").alias("layer"))
    return sheets.layer_groups(layers, {"metal": ["steel", "brass"], "finish": ["polish", "anod"], "kind": ["promo", "#1"]})


@query("SELECT o_orderkey sheet, l_linenumber::BIGINT insert_no, p_brand block_name, p_partkey entity_no FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_brand = 'Brand#' || (l_partkey % 50)")
def block_inserts(spark, d):
    inserts = table(spark, d, "lineitem").selectExpr("l_orderkey sheet", "cast(l_linenumber as bigint) insert_no", "concat('Brand#', l_partkey % 50) block_name")
    return sheets.block_inserts(inserts, table(spark, d, "part").selectExpr("p_brand block_name", "p_partkey entity_no"))


_CAD = "cd AS (SELECT l_orderkey sheet, l_linenumber entity_no, ['TEXT', 'MTEXT', 'DIMENSION', 'MLEADER', 'HATCH'][l_partkey % 5 + 1] kind, ['Walls', 'TITLE', '0', 'Defpoints', 'Glass'][l_suppkey % 5 + 1] layer, CASE WHEN l_linenumber = 3 THEN ' ' ELSE 'n' || l_partkey END AS text, (l_partkey % 8)::DOUBLE height, CASE WHEN l_linenumber < 5 THEN l_quantity END measurement FROM lineitem)"


@query(f"""WITH {_CAD}, s AS (SELECT *, nullif(trim(text), '') t, printf('%.2f', measurement) m FROM cd WHERE lower(layer) NOT IN ('0', 'defpoints'))
SELECT * FROM (SELECT sheet, entity_no, CASE kind WHEN 'TEXT' THEN CASE WHEN height >= 0.5 THEN t END WHEN 'MTEXT' THEN t WHEN 'DIMENSION' THEN CASE WHEN measurement IS NOT NULL THEN 'Dimension: ' || coalesce(t, m) || ' (measured: ' || m || ')' ELSE 'Dimension: ' || t END WHEN 'MLEADER' THEN 'Callout: ' || t END AS text,
CASE layer WHEN 'TITLE' THEN 'Title Block' ELSE 'Layer: ' || layer END section, CASE kind WHEN 'DIMENSION' THEN 'Dimensions' WHEN 'MLEADER' THEN 'Callouts' END subsection, CASE WHEN kind IN ('TEXT', 'MTEXT') THEN height ELSE 0 END font_size, kind = 'TEXT' AND (layer = 'TITLE' OR height > 5) is_heading FROM s) WHERE text IS NOT NULL""")
def cad_blocks(spark, d):
    e = ["l_orderkey sheet", "l_linenumber entity_no", "element_at(array('TEXT', 'MTEXT', 'DIMENSION', 'MLEADER', 'HATCH'), cast(l_partkey % 5 + 1 as int)) kind", "element_at(array('Walls', 'TITLE', '0', 'Defpoints', 'Glass'), cast(l_suppkey % 5 + 1 as int)) layer",
         "if(l_linenumber = 3, ' ', concat('n', l_partkey)) text", "cast(l_partkey % 8 as double) height", "if(l_linenumber < 5, l_quantity, null) measurement"]
    return sheets.cad_blocks(table(spark, d, "lineitem").selectExpr(*e))


@query("""WITH p AS (SELECT l_orderkey // 40 sheet, l_orderkey polyline_no, l_orderkey % 2 = 0 AND count(*) OVER w > 2 closed, l_linenumber, row_number() OVER w - 1 n, count(*) OVER w k, (l_partkey % 300)::DOUBLE x, (l_suppkey % 7)::DOUBLE y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 300, l_suppkey % 7 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT sheet, polyline_no, n, x, y, CASE WHEN n + 1 < k THEN lead(x) OVER v WHEN closed THEN first_value(x) OVER v END x1, CASE WHEN n + 1 < k THEN lead(y) OVER v WHEN closed THEN first_value(y) OVER v END y1 FROM p WINDOW v AS (PARTITION BY polyline_no ORDER BY n))
SELECT sheet, polyline_no, n::INT segment_no, x x0, y y0, x1, y1 FROM q WHERE sqrt((x1 - x) ** 2 + (y1 - y) ** 2) >= 1""")
def polyline_segments(spark, d):
    points = F.transform(F.array_sort(F.collect_list(F.expr("struct(l_linenumber n, cast(l_partkey % 300 as double) x, cast(l_suppkey % 7 as double) y)"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("polyline_no")).agg(points.alias("points"))
    return sheets.polyline_segments(lines.select(F.expr("polyline_no div 40 sheet"), "polyline_no", "points", F.expr("polyline_no % 2 = 0").alias("closed")))


_ANSWERED = "pa AS (SELECT o_orderkey // 10 doc_id, o_orderkey % 10 + 1 page_no, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'page type: b' || chr(10) || ' ' || o_orderpriority || ' ' WHEN 2 THEN 'PAGE TYPE: A - drawing' || chr(10) || o_orderstatus WHEN 3 THEN 'No technical content' WHEN 4 THEN o_orderpriority || chr(10) || 'x' ELSE 'PAGE TYPE: D' END raw, o_custkey % 6 k, o_orderpriority, o_orderstatus FROM orders), pt AS (SELECT doc_id, page_no, ['F', 'B', 'A', 'E', 'A', 'D'][k + 1] page_type, CASE k WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus WHEN 4 THEN raw ELSE '' END AS content FROM pa)"


def _answered_pages(spark: SparkSession, d: str) -> DataFrame:
    raw = "case o_custkey % 6 when 0 then null when 1 then concat('page type: b\\n ', o_orderpriority, ' ') when 2 then concat('PAGE TYPE: A - drawing\\n', o_orderstatus) when 3 then 'No technical content' when 4 then concat(o_orderpriority, '\\nx') else 'PAGE TYPE: D' end"
    rows = table(spark, d, "orders").select(F.expr("o_orderkey div 10").alias("doc_id"), F.expr("o_orderkey % 10 + 1").alias("page_no"), sheets.page_answer(F.expr(raw)).alias("a"))
    return rows.select("doc_id", "page_no", "a.*")


@query(f"WITH {_ANSWERED} SELECT * FROM pt")
def page_answers(spark, d):
    return _answered_pages(spark, d)


@query(f"WITH {_ANSWERED} SELECT doc_id, page_no, CASE page_type WHEN 'A' THEN 'Drawing Sheet ' WHEN 'B' THEN 'Scanned Text Page ' ELSE 'Table/Schedule Page ' END || page_no section, CASE page_type WHEN 'A' THEN 'pdf_drawing' ELSE 'pdf_spec' END source_type, content AS text FROM pt WHERE page_type NOT IN ('E', 'F') AND content <> ''")
def page_blocks(spark, d):
    return sheets.page_blocks(_answered_pages(spark, d))


def _confirmed_sql(radius: float) -> str:
    return f"""WITH {_LINES}, tv AS (SELECT *, (text_no % 90 + 10)::DOUBLE AS value FROM tx), nl AS (SELECT DISTINCT tv.sheet, text_no, value, orientation, CASE WHEN orientation = 'HORIZONTAL' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END p FROM tv JOIN ln ON tv.sheet = ln.sheet WHERE sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2) <= {radius})
SELECT DISTINCT a.sheet, a.text_no FROM nl a JOIN nl b ON a.text_no = b.text_no AND a.orientation = b.orientation AND a.p < b.p WHERE abs(abs(a.p - b.p) - a.value) / greatest(a.value, 1) < 0.05"""


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("value", F.expr("cast(text_no % 90 + 10 as double)"))


@query(_confirmed_sql(60))
def geometry_confirmation(spark, d):
    return geometry.geometry_confirmed(_valued(spark, d), _lines(spark, d), 60.0)


@query(_confirmed_sql(geometry.CONFIRM_RADIUS))
def geometry_confirmation_whole(spark, d):
    # The radius of the reference; that of geometry_confirmation is smaller.
    return geometry.geometry_confirmed(_valued(spark, d), _lines(spark, d))


def _keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """The least row of each key: the tables repeat some line numbers."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[f"__r.{c}" for c in rest])


_UNIQUE = f"""{_LINES}, lu AS (SELECT sheet, line_no, min((x0, y0, x1, y1)) r FROM ln GROUP BY ALL), l4 AS (SELECT sheet, line_no, r[1] x0, r[2] y0, r[3] x1, r[4] y1 FROM lu)"""


def _regions_sql(radius: float) -> str:
    return f"""WITH {_UNIQUE}, lg AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) len FROM l4), ti AS (SELECT DISTINCT sheet, unnest([x0, x1]) x, unnest([y0, y1]) y FROM lg WHERE len <= 30)
SELECT sheet, line_no, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy FROM lg WHERE len > 30 AND EXISTS (SELECT 1 FROM ti WHERE ti.sheet = lg.sheet AND sqrt((ti.x - lg.x0) ** 2 + (ti.y - lg.y0) ** 2) <= {radius}) AND EXISTS (SELECT 1 FROM ti WHERE ti.sheet = lg.sheet AND sqrt((ti.x - lg.x1) ** 2 + (ti.y - lg.y1) ** 2) <= {radius})"""


@query(_regions_sql(20))
def dimension_regions(spark, d):
    return geometry.dimension_regions(_keyed(_lines(spark, d), "sheet", "line_no"), radius=20.0)


@query(_regions_sql(geometry.TICK_RADIUS))
def dimension_regions_whole(spark, d):
    # The radius of the reference; that of dimension_regions is smaller.
    return geometry.dimension_regions(_keyed(_lines(spark, d), "sheet", "line_no"))


#: Chains of links as the smallest line that each line reaches.
_MERGED = f"""WITH RECURSIVE {_UNIQUE}, m AS (SELECT *, (x0 + x1) / 2 mx, (y0 + y1) / 2 my, CASE WHEN y1 = y0 THEN 0 ELSE degrees(atan2(y1 - y0, x1 - x0)) % 180 END * 5 ma FROM l4),
k AS (SELECT a.sheet, a.line_no a, b.line_no b FROM m a JOIN m b ON a.sheet = b.sheet AND a.line_no <> b.line_no AND sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) <= 20 AND (a.mx - b.mx) ** 2 + (a.my - b.my) ** 2 + (a.ma - b.ma) ** 2 <= 400),
c AS (SELECT sheet, line_no a, line_no f FROM m UNION SELECT c.sheet, k.b, c.f FROM c JOIN k ON k.sheet = c.sheet AND k.a = c.a WHERE k.b > c.f), g AS (SELECT sheet, a line_no, min(f) first_no FROM c GROUP BY ALL)
SELECT sheet, first_no, count(*) n_lines, CASE WHEN count(*) = 1 THEN min(x0) ELSE min(least(x0, x1)) END x0, CASE WHEN count(*) = 1 THEN min(y0) ELSE min(least(y0, y1)) END y0, CASE WHEN count(*) = 1 THEN min(x1) ELSE max(greatest(x0, x1)) END x1, CASE WHEN count(*) = 1 THEN min(y1) ELSE max(greatest(y0, y1)) END y1 FROM g JOIN m USING (sheet, line_no) GROUP BY sheet, first_no"""


@query(_MERGED)
def merged_segments(spark, d):
    return geometry.merged_segments(_keyed(_lines(spark, d), "sheet", "line_no"))


def _callout(number: str = "l_quantity") -> str:
    return f"concat(element_at(array('', 'thk ', '@ ', 'dia ', 'min ', 'width = ', 'typ. '), cast(l_partkey % 7 + 1 as int)), cast({number} as bigint), element_at(array(' mm', 'x', '\"', ' nos', ' c/c NTS'), cast(l_suppkey % 5 + 1 as int)), if(l_linenumber = 2, '75mm alloy 6063-T6', ''))"


@query()
def text_matches(spark, d):
    # DuckDB's regular expressions look neither ahead nor give places: tests hold these against Python's.
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_callout()} text")
    return sheets.matched_texts(rows).select("l_orderkey", "l_linenumber", "match_no", "m.*")


def _measured(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Entities of sheets: callout texts and dimensions from line items, and a scale for each sheet but every third."""
    texts = table(spark, d, "lineitem").selectExpr("l_orderkey div 40 sheet", "l_orderkey * 10 + l_linenumber text_no", f"{_callout()} text", "if(l_linenumber = 4, 'MTEXT', 'NOTES') layer", "cast(l_partkey % 400 as double) x", "cast(l_orderkey % 350 as double) y")
    texts = _keyed(texts, "sheet", "text_no")
    dims = _dimensions(spark, d).selectExpr("*", "if(dim_no % 4 = 0, 'ANGULAR', 'LINEAR') kind", "cast(dim_no % 50 as double) value", "x + 10 def_x", "y + dim_no % 20 def_y", "10D length", "if(dim_no % 3 = 0, '<> TYP', '') override_text")
    scales = _texts(spark, d).select("sheet").distinct().selectExpr("sheet", "1D mm_per_unit", "sheet % 3 <> 0 known")
    return {"texts": texts, "dimensions": dims, "scales": scales, "lines": _lines(spark, d), "circles": _texts(spark, d).selectExpr("sheet", "x cx", "y cy", "cast(text_no % 40 + 1 as double) radius")}


_DIMS = f"""{_LINES}, cw AS (SELECT dm.sheet, dim_no, text_no, unnest(string_split(lower(text), ' ')) t, unnest(range(0, len(string_split(text, ' ')))) i FROM dm JOIN tx ON dm.sheet = tx.sheet AND sqrt((dm.x - tx.x) ** 2 + (dm.y - tx.y) ** 2) <= 200),
cf AS (SELECT sheet, dim_no, t, min((text_no, i)) o FROM cw WHERE t <> '' GROUP BY ALL), cx AS (SELECT sheet, dim_no, array_to_string((list(t ORDER BY o))[1:30], ' ') words FROM cf GROUP BY ALL), di AS (SELECT sheet, dim_no, x, y, CASE WHEN dim_no % 4 = 0 THEN 'ANGULAR' ELSE 'LINEAR' END kind, (dim_no % 50)::DOUBLE v, dim_no % 20 dy FROM dm)"""


@query(f"""WITH {_DIMS} SELECT sheet, v value_mm, round(0.95 * CASE WHEN sheet % 3 <> 0 THEN 1 ELSE 0.7 END, 6) confidence, x, y,
CASE WHEN kind = 'ANGULAR' THEN kind WHEN x + 10 = 0 OR y + dy = 0 THEN 'ANY' WHEN degrees(atan2(dy, 10)) < 10 THEN 'HORIZONTAL' WHEN abs(degrees(atan2(dy, 10)) - 90) < 10 THEN 'VERTICAL' ELSE 'ANY' END direction, CASE WHEN dim_no % 3 = 0 THEN 'TYP' END qualifier, '' source_text, coalesce(words, '') context_words FROM di LEFT JOIN cx USING (sheet, dim_no) WHERE v > 0""")
def dimension_pass(spark, d):
    m = _measured(spark, d)
    return measurements.dimension_pass(m["dimensions"], _texts(spark, d), m["scales"]).select("sheet", "value_mm", F.round("confidence", 6).alias("confidence"), "x", "y", "direction", "qualifier", "source_text", F.array_join("context_words", " ").alias("context_words"))


@query(f"WITH {_LINES} SELECT sheet, (text_no % 40 + 1) * 2.0::DOUBLE value_mm, round(0.6 * CASE WHEN sheet % 3 <> 0 THEN 1 ELSE 0.7 END, 6) confidence, x, y FROM tx")
def circle_pass(spark, d):
    m = _measured(spark, d)
    return measurements.circle_pass(m["circles"], m["scales"]).select("sheet", "value_mm", F.round("confidence", 6).alias("confidence"), "x", "y")


_FACTOR = "CASE WHEN sheet % 3 <> 0 THEN 1 ELSE 0.7 END"


#: Layers of lines: half have none, and names are in two parts.
_LAYER = "CASE line_no % 4 WHEN 0 THEN 'A-WALL' WHEN 1 THEN 'Glass_1' WHEN 2 THEN '' END"


@query(f"""WITH {_LINES}, m AS (SELECT *, {_LAYER} layer, CASE WHEN sheet % 2 = 0 THEN 25.4 ELSE 1 END::DOUBLE mm, CASE WHEN orientation = 'HORIZONTAL' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END p,
  CASE WHEN orientation = 'HORIZONTAL' THEN least(x0, x1) ELSE least(y0, y1) END lo, CASE WHEN orientation = 'HORIZONTAL' THEN greatest(x0, x1) ELSE greatest(y0, y1) END hi FROM ln),
q AS (SELECT a.sheet, a.orientation, abs(a.p - b.p) * a.mm v, coalesce(nullif(a.layer, ''), nullif(b.layer, '')) layer, (a.x0 + a.x1 + b.x0 + b.x1) / 4 x, (a.y0 + a.y1 + b.y0 + b.y1) / 4 y,
  list_filter(regexp_split_to_array(lower(coalesce(a.layer, '')), '[^a-z0-9]+') || regexp_split_to_array(lower(coalesce(b.layer, '')), '[^a-z0-9]+'), lambda w: w <> '') w,
  row_number() OVER (PARTITION BY a.sheet, a.orientation, round_even(abs(a.p - b.p) * a.mm, 1) ORDER BY a.line_no, b.line_no, a.x0, a.y0, a.x1, a.y1, b.x0, b.y0, b.x1, b.y1) n
  FROM m a JOIN m b ON a.sheet = b.sheet AND a.orientation = b.orientation AND a.line_no < b.line_no WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 5 AND abs(a.p - b.p) BETWEEN 0.5 AND 5000)
SELECT sheet, round(v, 6) value_mm, orientation direction, round(CASE WHEN layer IS NULL THEN 0.48 ELSE 0.62 END * {_FACTOR}, 6)::DOUBLE confidence, x, y, array_to_string(w, ' ') words FROM q WHERE n = 1""")
def pair_pass(spark, d):
    m = _measured(spark, d)
    lines = m["lines"].withColumn("layer", F.expr(_LAYER))
    scales = m["scales"].withColumn("mm_per_unit", F.expr("if(sheet % 2 = 0, 25.4D, 1D)"))
    return measurements.pair_pass(lines, scales).select("sheet", F.round("value_mm", 6).alias("value_mm"), "direction", F.round("confidence", 6).alias("confidence"), "x", "y", F.array_join("context_words", " ").alias("words"))


def _pattern_sql(axis: str, way: str) -> str:
    return f"""SELECT sheet, spacing value_mm, '{way}' direction, round(least(0.65, (0.45 + 0.2 * least(1.0, n / 10)) * {_FACTOR}), 6) confidence FROM ({_spacing_sql(axis)})"""


@query(f"WITH {_LINES}, " + ", ".join(f"m{a} AS (SELECT DISTINCT sheet, round_even(p, 1) p FROM (SELECT sheet, ({a}0 + {a}1) / 2 p FROM ln UNION ALL SELECT sheet, {a} FROM tx))" for a in "xy") + f" {_pattern_sql('x', 'HORIZONTAL')} UNION ALL {_pattern_sql('y', 'VERTICAL')}")
def spacing_pass(spark, d):
    m = _measured(spark, d)
    return measurements.spacing_pass(m["lines"], m["circles"], m["scales"]).select("sheet", "value_mm", "direction", F.round("confidence", 6).alias("confidence"))


@query()
def all_measurements(spark, d):
    m = _measured(spark, d)
    # Each pass reads these, and they take a shuffle to make.
    texts, scales = written(m["texts"], "texts"), written(m["scales"], "scales")
    return measurements.all_measurements(m["dimensions"], texts, m["lines"], m["circles"], scales, texts.where("sheet % 2 = 0"))


#: The pieces of a chunk are what it carried over and a run of blocks, so its state is that run's begin, the words before it, and what was carried.
_OVERLAPS = f"""WITH RECURSIVE {_BLOCKS}, b AS (SELECT *, sum(w) OVER x p FROM (SELECT doc_id, block_no, page, section, subsection, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) w FROM fil WHERE heading = 0) WINDOW x AS (PARTITION BY doc_id ORDER BY block_no)),
k AS (SELECT *, row_number() OVER y i, lag(block_no, 100) OVER y far, lag(p, 101, 0) OVER y farp FROM b WINDOW y AS (PARTITION BY doc_id ORDER BY block_no)),
r AS (SELECT doc_id, i, 0::BIGINT c, 1::BIGINT s, 0::HUGEINT ps, block_no fb, 0::HUGEINT cw, p FROM k WHERE i = 1 UNION ALL
SELECT doc_id, i, c + f::BIGINT, CASE WHEN f THEN i ELSE s END, CASE WHEN f THEN bp ELSE ps END, CASE WHEN f AND pieces > 100 THEN far ELSE fb END, CASE WHEN f AND pieces > 100 THEN bp - farp WHEN f THEN used ELSE cw END, p
FROM (SELECT k.doc_id, k.i, k.p, k.far, k.farp, r.c, r.s, r.ps, r.fb, r.cw, r.p bp, r.cw + r.p - r.ps used, (r.c > 0)::BIGINT + k.i - r.s pieces, r.cw + r.p - r.ps + k.w > 800 f FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1)),
h AS (SELECT doc_id, c, any_value(s) s, max(i) e, any_value(fb) fb, any_value(cw - ps) base FROM r GROUP BY ALL)
SELECT h.doc_id, c chunk_no, fb first_block, max(block_no) FILTER (i = e) last_block, (any_value(base) + max(p) FILTER (i = e))::BIGINT n_words, min(page) start_page, max(page) end_page, arg_max(section, i) FILTER (section IS NOT NULL) section, arg_max(subsection, i) FILTER (subsection IS NOT NULL) subsection
FROM h JOIN k ON k.doc_id = h.doc_id AND k.i BETWEEN s AND e + 1 GROUP BY ALL"""


@query(_OVERLAPS)
def overlap_chunks(spark, d):
    return blocks.overlap_chunks(_filled(spark, d))


@query("SELECT l_orderkey table_id, string_agg(l_returnflag || ' | ' || l_linestatus || ' | ' || CASE WHEN l_linenumber = 2 THEN '' ELSE l_partkey::VARCHAR END, chr(10) ORDER BY l_linenumber, l_returnflag || ' | ' || l_linestatus || ' | ' || CASE WHEN l_linenumber = 2 THEN '' ELSE l_partkey::VARCHAR END) AS text FROM lineitem GROUP BY l_orderkey")
def table_text(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_no"), F.array("l_returnflag", "l_linestatus", F.expr("if(l_linenumber = 2, null, cast(l_partkey as string))")).alias("cells"))
    return blocks.table_texts(rows)


def _parents_sql(most: int) -> str:
    return f"""WITH c AS (SELECT o_orderstatus document, 'S' || (o_custkey % 40) sheet, o_orderkey chunk_no, 'Row ' || o_orderkey || ': ' || o_orderpriority AS text FROM orders), w AS (SELECT *, coalesce(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) OVER (PARTITION BY document, sheet ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM c),
j AS (SELECT document, sheet, '=== BOQ: ' || sheet || ' (' || document || ') ===' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY chunk_no) f FROM w WHERE b <= {most} GROUP BY document, sheet), k AS (SELECT *, list_filter(regexp_split_to_array(f, '\\s+'), lambda x: x <> '') ws FROM j)
SELECT document, sheet, least(len(ws), {most})::BIGINT n_words, CASE WHEN len(ws) > {most} THEN array_to_string(ws[1:{most}], ' ') ELSE f END AS text FROM k"""


@query(_parents_sql(40))
def sheet_parents(spark, d):
    return blocks.sheet_parents(_sheet_chunks(spark, d), 40)


@query(_parents_sql(blocks.PARENT_WORDS))
def sheet_parents_whole(spark, d):
    # The reference's cap; that of sheet_parents is smaller, so that it cuts at every scale.
    return blocks.sheet_parents(_sheet_chunks(spark, d))


def _sheet_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderstatus document", "concat('S', o_custkey % 40) sheet", "o_orderkey chunk_no", "concat('Row ', o_orderkey, ': ', o_orderpriority) text")


@query("""WITH p AS (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 25 batch_no FROM (SELECT DISTINCT p_type AS name FROM part)), b AS (SELECT batch_no, string_agg(name, ',' ORDER BY name) names FROM p GROUP BY batch_no)
SELECT c_custkey project, c_nationkey window_no, c_mktsegment context, batch_no, names FROM customer, b""")
def prompt_table(spark, d):
    windows = table(spark, d, "customer").selectExpr("c_custkey project", "c_nationkey window_no", "c_mktsegment context")
    names = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_type").alias("place")).distinct()
    return results.prompts(windows, names).withColumn("names", F.array_join("names", ","))


@query("""WITH u AS (SELECT o_custkey project, 'f' || (o_orderkey % 7) filename, o_orderkey FROM orders) SELECT project, filename, o_orderkey FROM u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = project AND o.o_orderstatus = 'F' AND 'f' || (o.o_orderkey % 11) = filename)""")
def duplicate_uploads(spark, d):
    o = table(spark, d, "orders")
    held = o.where("o_orderstatus = 'F'").selectExpr("o_custkey project", "concat('f', o_orderkey % 11) filename")
    return results.duplicate_uploads(o.selectExpr("o_custkey project", "concat('f', o_orderkey % 7) filename", "o_orderkey"), held)


@query("""WITH dc AS (SELECT p_size project, p_brand filename, min(p_partkey) id FROM part GROUP BY ALL), s AS (SELECT l_orderkey log_id, l_orderkey % 50 + 1 project, l_linenumber n, 'Brand#' || (l_partkey % 60) filename, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey END doc_id FROM lineitem)
SELECT log_id, string_agg(s.filename || ':' || coalesce(doc_id, id, -1), ',' ORDER BY n, s.filename, doc_id NULLS FIRST) sources FROM s LEFT JOIN dc ON dc.project = s.project AND dc.filename = s.filename GROUP BY log_id""")
def chat_backfill(spark, d):
    source = F.expr("struct(l_linenumber n, concat('Brand#', l_partkey % 60) filename, if(l_suppkey % 2 = 0, l_partkey, null) doc_id)")
    log = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("log_id")).agg(F.transform(F.array_sort(F.collect_list(source)), lambda s: F.struct(s["filename"].alias("filename"), s["doc_id"].alias("doc_id"))).alias("sources"))
    documents = table(spark, d, "part").selectExpr("p_size project", "p_brand filename", "p_partkey doc_id")
    filled = results.backfilled_sources(log.withColumn("project", F.expr("log_id % 50 + 1")), documents)
    shown = F.transform("sources", lambda s: F.concat(s["filename"], F.lit(":"), F.coalesce(s["doc_id"], F.lit(-1)).cast("string")))
    return filled.select("log_id", F.array_join(shown, ",").alias("sources"))


@query("SELECT l_orderkey doc_id, l_orderkey * 10 + l_linenumber chunk_id, l_partkey AS parameter FROM lineitem WHERE l_orderkey % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey % 4 = 0 AND c.l_orderkey * 10 + c.l_linenumber = lineitem.l_orderkey * 10 + lineitem.l_linenumber)")
def cascade_delete(spark, d):
    chunks = table(spark, d, "lineitem").selectExpr("l_orderkey doc_id", "l_orderkey * 10 + l_linenumber chunk_id", "l_partkey parameter")
    left = results.cascade_deleted({"chunks": chunks.drop("parameter"), "results": chunks}, chunks.where("doc_id % 4 = 0"))
    return left["results"].select("doc_id", "chunk_id", "parameter")


@query("SELECT l_orderkey project, l_partkey chunk_id, l_suppkey doc_id, l_linenumber AS parameter, s_name document_name, p_name chunk_text FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 <> 0 LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 <> 0")
def parameter_report(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_orderkey project", "l_partkey chunk_id", "l_suppkey doc_id", "l_linenumber parameter")
    documents = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").selectExpr("s_suppkey doc_id", "s_name document_name")
    return results.parameter_report(r, documents, table(spark, d, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey chunk_id", "p_name chunk_text"))
