"""Queries over scales, resolved dimensions, OCR words, reports and links of grid texts, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures
from ..operators import blocks, matching, sheets
from .document_queries import table
from .drawing_queries import SQL as DRAWING_SQL
from .drawing_queries import extraction_summary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FACTOR = "[1.0, 1000.0, 25.4, 304.8]::DOUBLE[]"
_EMPIRICAL = ", ".join(f"({n})" for n in measures.DENOMINATORS)


@query(f"""WITH s AS (SELECT p_partkey, p_size, ({_FACTOR})[p_partkey % 4 + 1] f, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END mm, p_size * 0.5::DOUBLE len, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'nts' END said FROM part),
e AS (SELECT p_partkey, arg_min(d, (abs(d - mm / (len * f)), d)) d, min(abs(d - mm / (len * f))) off FROM s, (VALUES {_EMPIRICAL}) v(d) WHERE mm > 0 AND len > 0 GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN said = 'text' THEN p_size WHEN said = 'nts' THEN 1 ELSE coalesce(d, 1) END denominator, CASE WHEN said IS NOT NULL THEN 'TITLEBLOCK' WHEN d IS NOT NULL THEN 'EMPIRICAL' ELSE 'HEADER' END AS source,
CASE WHEN said = 'text' THEN 0.9 WHEN said = 'nts' THEN 0.85 WHEN d IS NULL THEN 0.7 WHEN off / d < 0.05 THEN 0.8 ELSE 0.6 END::DOUBLE confidence, round(CASE WHEN said = 'text' THEN 1 / p_size WHEN said = 'nts' THEN 1 ELSE f / coalesce(d, 1) END, 9) mm_per_unit, coalesce(said = 'nts', false) nts FROM s LEFT JOIN e USING (p_partkey)""")
def detected_scale(spark, d):
    texts = F.expr("array(p_name, null, case p_partkey % 5 when 0 then concat('SCALE 1:', p_size) when 1 then 'not to scale 1:5' else 'note' end)")
    none, code, mm = F.lit(None).cast("double"), F.expr("element_at(array(4, 6, 1, 2), cast(p_partkey % 4 + 1 as int))"), F.expr("if(p_partkey % 3 > 0, p_retailprice, null)")
    s = measures.detected_scale(texts, code, F.col("p_size") * F.lit(0.5), mm, none, none)
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.denominator", "s.source", "s.confidence", F.round("s.mm_per_unit", 9).alias("mm_per_unit"), "s.nts")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END::DOUBLE len, (p_partkey % 3 + 1) / 50 k, ([1.0, 1000.0, 25.4, 1.0]::DOUBLE[])[p_partkey % 4 + 1] f, p_retailprice mm FROM part), o AS (SELECT *, CASE WHEN len > 0 THEN abs(len * k * f - mm) / mm END off FROM s)
SELECT p_partkey, coalesce(off <= 0.05, false) consistent, round(coalesce(off, 1), 6) deviation FROM o""")
def scale_check(spark, d):
    unit, k = F.expr("element_at(array('mm', 'm', 'in', 'unit'), cast(p_partkey % 4 + 1 as int))"), F.expr("(p_partkey % 3 + 1) / 50")
    c = measures.scale_check(k, unit, F.expr("cast(if(p_partkey % 7 = 0, 0, p_size) as double)"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", c["consistent"].alias("consistent"), F.round(c["deviation"], 6).alias("deviation"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round(25.4 / 300 / greatest(p_size - 1, 1), 9) WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN round(0.3528 / greatest(p_size - 1, 1), 9) ELSE p_partkey % 2 + 1 END::DOUBLE mm_per_unit FROM part")
def page_scale(spark, d):
    unit = F.expr("element_at(array('px', 'pt', 'mm'), cast(p_partkey % 3 + 1 as int))")
    return table(spark, d, "part").select("p_partkey", F.round(measures.page_scale(F.col("p_size") - 1, F.expr("cast(p_partkey % 2 + 1 as double)"), unit), 9).alias("mm_per_unit"))


@query("""SELECT p_partkey, ([p_size * 10, p_size * 25.4, p_size * 1000 + 500, -p_size * 25.4, NULL]::DOUBLE[])[p_partkey % 5 + 1] mm, CASE WHEN p_partkey % 5 < 4 THEN (['cm', 'in', 'm', 'in'])[p_partkey % 5 + 1] END unit FROM part""")
def value_with_unit(spark, d):
    text = F.expr("element_at(array(concat(' ', p_size, ' CM thick'), concat('about ', p_size, ' inches'), concat(p_size, ',5m'), concat('-', p_size, 'inch'), 'no number'), cast(p_partkey % 5 + 1 as int))")
    v = measures.value_with_unit(text)
    return table(spark, d, "part").select("p_partkey", v["mm"].alias("mm"), v["unit"].alias("unit"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 k, l_quantity q, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_quantity END len, l_suppkey % 2 = 0 inch FROM lineitem), v AS (SELECT *, CASE WHEN k IN (0, 1, 2) THEN CASE WHEN len = 0 THEN q * CASE WHEN inch THEN 25.4 ELSE 1 END ELSE q END WHEN len > 0 THEN len * CASE WHEN inch THEN 25.4 ELSE 1 END END mm FROM s)
SELECT l_orderkey, l_linenumber, round(mm, 6) value_mm, CASE l_linenumber % 4 WHEN 0 THEN 'LINEAR' WHEN 1 THEN 'DIAMETER' WHEN 2 THEN 'ARC_LENGTH' ELSE 'LINEAR' END kind FROM v WHERE mm IS NOT NULL""")
def resolved_dimension(spark, d):
    q = "cast(l_quantity as bigint)"
    override = F.expr(f"case l_linenumber % 6 when 0 then concat(' ', {q}) when 1 then concat('<> ', {q}, ' typ 7') when 2 then concat('R', {q}, '.0') when 3 then '<>' when 4 then 'var' end")
    length, factor = F.expr("if(l_orderkey % 3 = 0, 0D, l_quantity)"), F.expr("if(l_suppkey % 2 = 0, 25.4D, 1D)")
    v = measures.resolved_dimension(override, length, factor, F.expr("element_at(array(32, 292, 160, 99), l_linenumber % 4 + 1)"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).where("v is not null").select("l_orderkey", "l_linenumber", F.round("v.value_mm", 6).alias("value_mm"), "v.kind")


@query("""SELECT o_orderkey // 40 sheet, o_orderkey word_no, '1' || o_orderkey || '0 mm' AS text, o_totalprice x FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 4 <> 1 OR o_orderkey % 30 >= 20)""")
def ocr_words(spark, d):
    conf = F.expr("case o_orderkey % 4 when 0 then '96' when 1 then cast(o_orderkey % 30 as string) when 2 then '7.5' else null end")
    words = table(spark, d, "orders").select(F.expr("o_orderkey div 40").alias("sheet"), F.col("o_orderkey").alias("word_no"), F.expr("if(o_orderkey % 5 = 0, ' ', concat(' l', o_orderkey, 'O mm '))").alias("text"), conf.alias("conf"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(9.0).alias("height"))
    return sheets.ocr_words(words).select("sheet", "word_no", "text", "x")


@query("""WITH p AS (SELECT p_size sheet, p_partkey text_no, unnest([p_size, p_size + 5])::DOUBLE AS value, unnest([0, 1]) match_no FROM part WHERE p_partkey % 4 <> 0) SELECT * FROM p""")
def promoted_dimensions(spark, d):
    text = F.expr("if(p_partkey % 4 = 0, 'NTS 4 nos', concat('glass ', p_size, ' mm thk ', p_size + 5, 'mm'))")
    rows = table(spark, d, "part").select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("text_no"), text.alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return sheets.promoted_dimensions(rows).select("sheet", "dim_no.text_no", "value", "dim_no.match_no")


@query(f"SELECT count(*) n_sheets, sum(n_extracted)::BIGINT n_extracted, sum(n_conflicts)::BIGINT n_conflicts, round(avg(coalesce(mean_confidence, 0)), 6) mean_confidence FROM ({DRAWING_SQL['extraction_summary']})")
def batch_totals(spark, d):
    return matching.batch_totals(extraction_summary(spark, d))


@query("""SELECT p_partkey measure_id, round_even(p_retailprice / 8, 3) AS value, 'mm' AS unit, p_name source_text, round_even(p_size / 8, 2) x, p_size::DOUBLE y, p_brand layer, round_even(p_size / 64, 3) confidence FROM part WHERE p_partkey % 5 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def unmatched_report(spark, d):
    m = table(spark, d, "part").selectExpr("p_partkey measure_id", "if(p_partkey % 5 = 0, 0D, p_retailprice / 8) value_mm", "'mm' unit", "p_name source_text", "p_size / 8D x", "cast(p_size as double) y", "p_brand layer", "p_size / 64D confidence")
    return matching.unmatched_report(m, table(spark, d, "lineitem").where("l_quantity > 48").selectExpr("l_partkey measure_id"))


@query("""WITH p AS (SELECT unnest(['BOQ Items', 'BOQ', 'BOQ - Brand#11', 'BOQ - Brand#12', 'S1', 'S2']) sheet, unnest([1, 2, 3, 4, 5, 6]) parent_id),
c AS (SELECT p_size document, p_partkey child_no, p_partkey % 2 = 0 is_item, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END WHEN p_partkey % 3 = 0 THEN '' ELSE 'S' || (p_partkey % 4) END section FROM part)
SELECT document, child_no, section, CASE WHEN document % 7 <> 0 THEN coalesce(p.parent_id, CASE WHEN is_item THEN 1 ELSE 2 END) END parent_id FROM c LEFT JOIN p ON sheet = CASE WHEN is_item AND section = '' THEN 'BOQ Items' WHEN is_item THEN 'BOQ - ' || section ELSE section END""")
def grid_child_links(spark, d):
    part = table(spark, d, "part")
    children = part.selectExpr("p_size document", "p_partkey child_no", "p_partkey % 2 = 0 is_item", "if(p_partkey % 3 = 0, null, p_brand) category", "if(p_partkey % 3 = 0, 'Row 1', concat('Sheet: S', p_partkey % 4, '\\nRow 1')) text")
    parents = part.where("p_size % 7 <> 0").select(F.col("p_size").alias("document")).distinct().select("document", F.posexplode(F.array(*[F.lit(x) for x in ("BOQ Items", "BOQ", "BOQ - Brand#11", "BOQ - Brand#12", "S1", "S2")])).alias("n", "sheet"))
    return blocks.sheet_child_links(children, parents.selectExpr("document", "sheet", "n + 1 parent_id")).select("document", "child_no", "section", "parent_id")
