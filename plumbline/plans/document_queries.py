"""Queries over documents and their chunks, vectors and answers, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, maintenance, results, retrieval, vector_index

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BLOCKS = """
l AS (SELECT doc_id, source project, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no FROM documents),
blk AS (SELECT doc_id, project, line_no::BIGINT block_no, (line_no // 10 + 1)::INT page, trim(line, ' ') AS text,
  CASE WHEN length(trim(line, ' ')) <= 20 THEN 1 WHEN length(trim(line, ' ')) <= 40 THEN 2 ELSE 0 END heading FROM l WHERE trim(line, ' ') <> ''),
f1 AS (SELECT *, last_value(CASE WHEN heading = 1 THEN text END IGNORE NULLS) OVER w AS section, sum((heading = 1)::INT) OVER w AS section_run
  FROM blk WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)),
fil AS (SELECT *, last_value(CASE WHEN heading = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, section_run ORDER BY block_no ROWS UNBOUNDED PRECEDING) subsection FROM f1)"""

_SECTIONS = _BLOCKS + """,
g1 AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND section IS NOT DISTINCT FROM lag(section) OVER w AND subsection IS NOT DISTINCT FROM lag(subsection) OVER w THEN 0 ELSE 1 END chg FROM fil WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
g2 AS (SELECT *, sum(chg) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) run FROM g1),
g3 AS (SELECT doc_id, any_value(project) project, run, any_value(section) section, any_value(subsection) subsection, arg_min(page, block_no) page_start, arg_max(page, block_no) page_end, count(*) n_blocks,
  list_filter(string_split(string_agg(text, ' ' ORDER BY block_no), ' '), lambda x: x <> '') words FROM g2 WHERE heading = 0 GROUP BY doc_id, run),
sec AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INT section_no FROM g3)"""


def _chunk_sql(parent: int, child: int) -> str:
    return _SECTIONS + f""",
par AS (SELECT * EXCLUDE (words), words[p + 1 : p + {parent}] words FROM (SELECT *, unnest(range(0, len(words), {parent})) p FROM sec)),
chd AS (SELECT * EXCLUDE (words), words[c + 1 : c + {child}] words, 1 chunk_level FROM (SELECT *, unnest(range(0, len(words), {child})) c FROM par)),
al AS (SELECT doc_id, project, section_no, p, -1 c, 0 chunk_level, section, subsection, page_start, words FROM par UNION ALL SELECT doc_id, project, section_no, p, c, 1, section, subsection, page_start, words FROM chd),
ix AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section_no, p, chunk_level, c) - 1)::INT chunk_index FROM al),
chunks AS (SELECT doc_id, project, chunk_index, chunk_level, CASE WHEN chunk_level = 1 THEN min(chunk_index) OVER (PARTITION BY doc_id, section_no, p) END parent_index,
  CASE WHEN chunk_level = 1 THEN lag(chunk_index) OVER s END prev_index, CASE WHEN chunk_level = 1 THEN lead(chunk_index) OVER s END next_index,
  section, subsection, page_start, len(words)::BIGINT n_words, floor(len(words) * 1.35::DOUBLE)::BIGINT n_tokens FROM ix WINDOW s AS (PARTITION BY doc_id, section_no, p, chunk_level ORDER BY chunk_index))"""


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return blocks.heading_fill(blocks.lines_as_blocks(table(spark, d, "documents")))


def _chunks(spark: SparkSession, d: str, parent: int = 300, child: int = 50) -> DataFrame:
    return blocks.parent_child_chunks(blocks.section_groups(_filled(spark, d)), parent, child)


@query(f"WITH {_BLOCKS} SELECT doc_id, block_no, page, heading, section, subsection FROM fil")
def heading_fill(spark, d):
    return _filled(spark, d).select("doc_id", "block_no", "page", "heading", "section", "subsection")


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, section, subsection, page_start, page_end, n_blocks, len(words) n_words, array_to_string(words, ' ') AS text FROM sec")
def section_groups(spark, d):
    return blocks.section_groups(_filled(spark, d)).select("doc_id", "section_no", "section", "subsection", "page_start", "page_end", "n_blocks", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"))


@query(f"WITH {_chunk_sql(3000, 200)} SELECT * FROM chunks")
def parent_child_chunks(spark, d):
    return _chunks(spark, d, blocks.PARENT_WORDS, blocks.CHILD_WORDS).drop("words")


@query(f"WITH {_chunk_sql(300, 50)} SELECT * FROM chunks")
def parent_child_chunks_small(spark, d):
    return _chunks(spark, d).drop("words")


_TURNS = _chunk_sql(300, 50) + """,
tn AS (SELECT *, row_number() OVER (PARTITION BY project, doc_id ORDER BY chunk_index) turn FROM chunks WHERE chunk_level = 0),
orl AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY turn, doc_id) ordinal FROM tn)"""


@query(f"WITH {_TURNS} SELECT project, doc_id, chunk_index, turn, ordinal, n_tokens FROM orl")
def interleave_docs(spark, d):
    return blocks.interleaved(_chunks(spark, d).where("chunk_level = 0")).select("project", "doc_id", "chunk_index", "turn", "ordinal", "n_tokens")


#: A window is a run of ordinals, so its state is where it begins and the tokens before that.
_WINDOWS = f"""WITH RECURSIVE {_TURNS}, c AS (SELECT project, ordinal o, n_tokens t, p, lag(p, 4, 0) OVER (PARTITION BY project ORDER BY ordinal) q FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY project ORDER BY ordinal) p FROM orl)),
r AS (SELECT project, o, 1::BIGINT s, 0::HUGEINT ps, 0::BIGINT w, p FROM c WHERE o = 1 UNION ALL SELECT project, o, CASE WHEN f AND s < o - 3 THEN o - 3 ELSE s END, CASE WHEN f AND s < o - 3 THEN q ELSE ps END, w + f::BIGINT, p
  FROM (SELECT c.project, c.o, c.q, c.p, r.s, r.ps, r.w, r.p - r.ps + c.t > 2000 f FROM r JOIN c ON c.project = r.project AND c.o = r.o + 1))
SELECT project, w window_no, unnest(range(s, e + 1)) ordinal FROM (SELECT project, w, any_value(s) s, max(o) e FROM r GROUP BY ALL)"""


@query(_WINDOWS)
def context_windows(spark, d):
    return blocks.context_windows(blocks.interleaved(_chunks(spark, d).where("chunk_level = 0")), 2000)


@query(f"WITH {_TURNS} SELECT project, ordinal, (ordinal - 1) // 25 batch_no FROM orl")
def fixed_batches(spark, d):
    # Batches need no words, and these would be sorted and written along with each chunk.
    chunks = blocks.parent_places(blocks.lines_as_blocks(table(spark, d, "documents")), 300, 50)
    rows = blocks.interleaved(chunks.select("doc_id", "project", "chunk_index"))
    return blocks.batches(rows, "project", "ordinal", 25).select("project", "ordinal", "batch_no")


@query(f"WITH {_chunk_sql(300, 50)} SELECT project, doc_id, count(*) n_chunks, count(DISTINCT section) n_sections, sum(n_tokens)::BIGINT n_tokens FROM chunks GROUP BY ALL")
def document_inventory(spark, d):
    return blocks.document_inventory(_chunks(spark, d))


@query(f"""WITH {_chunk_sql(300, 50)}, x AS (SELECT * FROM chunks WHERE chunk_level = 1 OR length(project) = 4)
SELECT doc_id, chunk_index, chunk_level FROM x WHERE chunk_level = 0 UNION ALL SELECT doc_id, chunk_index, chunk_level FROM x WHERE chunk_level = 1 AND project NOT IN (SELECT project FROM x WHERE chunk_level = 0)""")
def level_fallback(spark, d):
    some = _chunks(spark, d).where("chunk_level = 1 or length(project) = 4")
    return blocks.level_fallback(some).select("doc_id", "chunk_index", "chunk_level")


@query(f"""WITH {_chunk_sql(300, 50)} SELECT doc_id::VARCHAR || '_' || chunk_index record_id, coalesce(section, '') section, coalesce(subsection, '') subsection, coalesce(page_start, 0) page, left(array_to_string(words, ' '), 200) preview FROM ix""")
def vector_records(spark, d):
    return retrieval.vector_records(_chunks(spark, d).withColumn("text", F.array_join("words", " ")))


@query(SQL["vector_records"])
def vector_records_whole(spark, d):
    # The same rows as vector_records, kept under their earlier name.
    return retrieval.vector_records(_chunks(spark, d).withColumn("text", F.array_join("words", " ")))


@query("""WITH c AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' '), ''), '[empty]') clean FROM documents),
o AS (SELECT doc_id, unnest(string_split(left(clean, 9500), '')) c, unnest(range(1, 9501)) i FROM c WHERE strlen(clean) > 9500),
k AS (SELECT doc_id, max(i) n FROM (SELECT doc_id, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) b FROM o WHERE c IS NOT NULL) WHERE b <= 9500 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN clean ELSE left(clean, n) END clean FROM c LEFT JOIN k USING (doc_id)""")
def sanitised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.sanitised(F.col("text")).alias("clean"))


#: One vector in fifty asks, in its project (vec_id modulo 4); all vectors are searched.
_VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] e, vec_id % 4 project, label FROM embeddings),
p AS (SELECT a.vec_id query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 4) score, a.label ql, b.label bl FROM v a JOIN v b ON a.project = b.project WHERE a.vec_id % 50 = 0)"""
_TOPK = "SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM {0} WHERE score >= 0.05) WHERE rank <= {1}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.expr("vec_id % 4").alias("project"), "label")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "project", "label"), v


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, d), k)


@query(f"WITH {_VECTORS} {_TOPK.format('p', 10)}")
def vector_topk(spark, d):
    return _hits(spark, d)


@query(f"WITH {_VECTORS} {_TOPK.format('p', 10)}")
def vector_topk_indexed(spark, d):
    queries, v = _vectors(spark, d)
    return vector_index.index_topk(queries, vector_index.fitted_index(v), 10, probes=4, exact=True)


@query(f"""WITH {_VECTORS}, s AS ({_TOPK.format("(SELECT * FROM p WHERE ql % 2 = 1 AND ql = bl)", 5)}), r AS (SELECT * FROM p WHERE query_id NOT IN (SELECT query_id FROM s)) SELECT * FROM s UNION ALL {_TOPK.format("r", 5)}""")
def vector_topk_fallback(spark, d):
    queries, v = _vectors(spark, d)
    # even labels have no vectors of their kind and fall back
    kind = F.when(F.col("label") % 2 == 1, F.col("label")).otherwise(-1)
    return retrieval.vector_topk_fallback(queries.withColumn("kind", kind).drop("label"), v.withColumn("kind", F.col("label")).drop("label"), 5, ("project", "kind"))


@query(f"WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}) SELECT query_id, vec_id // 5 section_id, max(score) score, count(*) n_hits FROM h GROUP BY ALL")
def parent_expand(spark, d):
    chunks = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 5").alias("parent_id"))
    return retrieval.parent_expand(_hits(spark, d), chunks)


@query(f"WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}) SELECT vec_id, arg_max(query_id, (score, -query_id)) query_id, max(score) score FROM h GROUP BY vec_id")
def best_per_chunk(spark, d):
    return retrieval.best_per_chunk(_hits(spark, d))


@query(f"""WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}), u AS (SELECT *, 0 origin FROM h WHERE rank <= 5 UNION ALL SELECT query_id, vec_id, score, rank - 3, 1 FROM h WHERE rank BETWEEN 4 AND 6)
SELECT query_id, vec_id, score, rank, origin FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY origin) n FROM u) WHERE n = 1""")
def primary_wins_union(spark, d):
    h = _hits(spark, d)
    return retrieval.primary_wins(h, h.where("rank >= 4").withColumn("rank", F.col("rank") - 3))


@query(f"""WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}), n AS (SELECT project, count(DISTINCT label) n FROM v GROUP BY project)
SELECT h.query_id, h.vec_id, h.score, h.rank, (h.query_id % 4) project, least(8, greatest(2, 3 * (n.n - 8)))::INT k FROM h JOIN n ON h.query_id % 4 = n.project WHERE h.rank <= least(8, greatest(2, 3 * (n.n - 8)))""")
def sized_topk(spark, d):
    documents = _vectors(spark, d)[1].groupBy("project").agg((F.countDistinct("label") - 8).alias("n_documents"))
    return retrieval.sized_topk(_hits(spark, d).withColumn("project", F.expr("query_id % 4")), documents, 3, 2, 8)


@query(f"""WITH {_VECTORS}, h AS ({_TOPK.format('p', 10)}) SELECT query_id, string_agg('[' || rank || '] ' || 'label ' || label, chr(10) ORDER BY rank) context FROM h JOIN embeddings USING (vec_id) WHERE rank <= 7 GROUP BY query_id""")
def context_assembly(spark, d):
    texts = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return retrieval.assembled_context(_hits(spark, d), texts, 7)


_RESULTS = """r AS (SELECT user_id project, event_type parameter, event_id ordinal, value, (event_id % 7) / 8 confidence, event_id % 3 <> 0 AS found, user_id * 10 + event_id % 4 doc_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END pass FROM events),
b AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY project, parameter, pass ORDER BY found DESC, CASE WHEN found THEN confidence ELSE 0 END DESC, ordinal) n FROM r) WHERE n = 1)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("project"), F.col("event_type").alias("parameter"), F.col("event_id").alias("ordinal"), "value",
        (F.expr("event_id % 7") / 8).alias("confidence"), F.expr("event_id % 3 <> 0").alias("found"), F.expr("user_id * 10 + event_id % 4").alias("doc_id"), F.expr("if(event_id % 2 = 0, 1, 2)").alias("pass"),
    )


def _passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _results(spark, d)
    return tuple(results.best_per_key(r.where(F.col("pass") == k)) for k in (1, 2))


@query(f"WITH {_RESULTS} SELECT project, parameter, ordinal, value, confidence, found FROM b WHERE pass = 1")
def best_per_key(spark, d):
    return _passes(spark, d)[0].select("project", "parameter", "ordinal", "value", "confidence", "found")


@query(f"WITH {_RESULTS}, f AS (SELECT * FROM b WHERE pass = 1 AND found) SELECT project, parameter, ordinal, found, pass FROM f UNION ALL SELECT b.project, b.parameter, b.ordinal, b.found, 2 FROM b ANTI JOIN f USING (project, parameter) WHERE b.pass = 2")
def pass_overlay(spark, d):
    return results.pass_overlay(*_passes(spark, d)).select("project", "parameter", "ordinal", "found", "pass")


@query(f"""WITH {_RESULTS}, n AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY project, parameter ORDER BY ordinal DESC) n FROM r WHERE pass = 2) WHERE n = 1)
SELECT project, parameter, ordinal, value FROM n UNION ALL SELECT b.project, b.parameter, b.ordinal, b.value FROM b ANTI JOIN n USING (project, parameter) WHERE b.pass = 1""")
def upsert(spark, d):
    return results.upsert(_passes(spark, d)[0].drop("pass"), _results(spark, d).where("pass = 2").drop("pass")).select("project", "parameter", "ordinal", "value")


@query(f"WITH {_RESULTS} SELECT project, parameter, ordinal, doc_id FROM r WHERE doc_id % 9 <> 0")
def orphan_removal(spark, d):
    r = _results(spark, d)
    return results.without_orphans(r, r.where("doc_id % 9 = 0").select("doc_id")).select("project", "parameter", "ordinal", "doc_id")


@query(f"""WITH {_RESULTS} SELECT project, count(*) n_total, count(*) FILTER (found) n_found, count(*) FILTER (NOT found) n_not_found, count(*) FILTER (pass = 1) n_pass1, count(*) FILTER (pass = 2) n_pass2, avg(CASE WHEN found THEN confidence END) mean_confidence FROM b GROUP BY project""")
def run_metrics(spark, d):
    first, second = _passes(spark, d)
    return results.run_metrics(first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2))))


@query(f"""WITH {_RESULTS}, k AS (SELECT DISTINCT project FROM r), t AS (SELECT DISTINCT parameter FROM r), e AS (SELECT * FROM k, t), o AS (SELECT * FROM b WHERE pass = 1)
SELECT project, parameter, ordinal, found, confidence FROM o UNION ALL SELECT project, parameter, NULL, false, 0 FROM e ANTI JOIN o USING (project, parameter)""")
def not_found_fill(spark, d):
    r = _results(spark, d)
    parameters = F.array_sort(F.collect_set("parameter"))
    expected = r.select("project").distinct().withColumn("all", r.agg(parameters).scalar()).select("project", F.explode("all").alias("parameter"))
    return results.not_found_fill(expected, _passes(spark, d)[0]).select("project", "parameter", "ordinal", "found", "confidence")


@query(f"""WITH {_RESULTS}, c AS (SELECT project, parameter, doc_id, min(ordinal) f, list(ordinal % 5 ORDER BY ordinal) pg, list('s' || ordinal % 3 ORDER BY ordinal) sg FROM r GROUP BY ALL)
SELECT project, parameter, doc_id, array_to_string(list_transform(list_filter(list_zip(pg, range(1, len(pg) + 1)), lambda x: list_position(pg, x[1]) = x[2]), lambda x: x[1]), ',') pages, array_to_string(list_transform(list_filter(list_zip(sg, range(1, len(sg) + 1)), lambda x: list_position(sg, x[1]) = x[2]), lambda x: x[1]), ',') sections, f = min(f) OVER w is_primary, count(*) OVER w > 1 multi_source FROM c WINDOW w AS (PARTITION BY project, parameter)""")
def source_rollup(spark, d):
    cited = _results(spark, d).select("project", "parameter", "ordinal", "doc_id", F.expr("ordinal % 5").alias("page"), F.expr("concat('s', ordinal % 3)").alias("section"))
    return results.source_rollup(cited).select("project", "parameter", "doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("sections", ",").alias("sections"), "is_primary", "multi_source")


@query(f"""WITH {_RESULTS}, s AS (SELECT project, parameter, doc_id, min(ordinal) f FROM r GROUP BY ALL), w AS (SELECT project, parameter, arg_min(doc_id, f) was FROM s GROUP BY ALL), l AS (SELECT project, parameter, arg_min(doc_id, f) doc_id, count(*) n_left FROM s WHERE doc_id % 3 <> 0 GROUP BY ALL)
SELECT project, parameter, l.doc_id, coalesce(n_left, 0) n_left, CASE WHEN l.doc_id IS NULL THEN 'extract_again' WHEN l.doc_id = was THEN 'kept' ELSE 'moved' END AS action FROM w LEFT JOIN l USING (project, parameter)""")
def source_repointing(spark, d):
    first = _results(spark, d).groupBy("project", "parameter", "doc_id").agg(F.min("ordinal").alias("f"))
    held = first.groupBy("project", "parameter").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "doc_id"))), lambda x: x["doc_id"]).alias("sources"))
    return results.repointed(held, first.where("doc_id % 3 = 0").select("doc_id"))


_ANSWERS = """a AS (SELECT o_orderkey answer_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 2 = 1 END found, o_orderstatus value, 'mm' unit, (o_orderkey % 9) / 8 confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'value was inferred' ELSE 'stated' END explanation, o_orderkey % 13 = 0 broken FROM orders)"""


@query(f"""WITH {_ANSWERS}, e AS (SELECT answer_id, unnest(['height', 'width']) parameter FROM a), j AS (SELECT e.*, a.* EXCLUDE (answer_id), NOT broken AND e.parameter = 'height' present FROM e JOIN a USING (answer_id))
SELECT answer_id, parameter, present AND coalesce(found, false) AS found, CASE WHEN present THEN value END AS value, CASE WHEN present THEN unit END unit,
CASE WHEN NOT present THEN 0 WHEN confidence > 0.75 AND explanation LIKE '%inferred%' THEN 0.75 ELSE confidence END confidence, CASE WHEN broken THEN 'JSON parse failed' WHEN NOT present THEN 'Missing in response' END reason FROM j""")
def answer_json_parse(spark, d):
    o = table(spark, d, "orders")
    body = F.to_json(F.create_map(F.lit("height"), F.struct(
        F.expr("if(o_orderkey % 11 = 0, null, o_orderkey % 2 = 1)").alias("found"), F.col("o_orderstatus").alias("value"), F.lit("mm").alias("unit"),
        (F.expr("o_orderkey % 9") / 8).alias("confidence"), F.expr("if(o_orderkey % 5 = 0, 'value was inferred', 'stated')").alias("explanation"),
    )))
    text = F.when(F.expr("o_orderkey % 13 = 0"), F.substring(body, 1, 20)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    answers = o.select(F.col("o_orderkey").alias("answer_id"), text.alias("response_text"))
    return results.parsed_answers(answers, answers.select("answer_id", F.explode(F.array(F.lit("height"), F.lit("width"))).alias("parameter")))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r <= 6")
def recent_turns(spark, d):
    return maintenance.recent_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "place")


@query("SELECT o_orderkey log_id, 'user' AS role, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, 'assistant', o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def chat_flattening(spark, d):
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_orderpriority").alias("query"), F.expr("if(o_orderkey % 3 <> 0, o_orderstatus, null)").alias("response"))
    return maintenance.flattened_chat(log)


@query("SELECT c_custkey project_id, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 starred, c_custkey % 5 = 0 OR c_custkey % 7 = 0 archived FROM customer")
def bulk_flags(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.expr("c_custkey % 2 = 0").alias("starred"), F.expr("c_custkey % 7 = 0").alias("archived"))
    return maintenance.bulk_flags(c, c.where("project_id % 5 = 0"), "archive")


@query("SELECT user_id, sum(event_id % 1000)::BIGINT used, greatest(0, 200000 - sum(event_id % 1000))::BIGINT remaining FROM events GROUP BY user_id")
def token_usage(spark, d):
    return maintenance.token_usage(table(spark, d, "events").select("user_id", F.expr("event_id % 1000").alias("tokens")), 200_000)


@query("""WITH t AS (SELECT user_id run_id, event_id line_no, CASE WHEN event_id % 4 = 0 THEN 'pipeline' ELSE 'chunk' END tag, CASE WHEN event_id % 5 = 0 THEN 'summary' ELSE event_type END AS label, (event_id % 100) / 4 took FROM events WHERE event_id % 9 <> 0)
SELECT run_id, count(*) n_entries, count(*) FILTER (label = 'summary') n_summary, arg_max(took, line_no) FILTER (tag = 'pipeline') total_s FROM t GROUP BY run_id""")
def timing_report(spark, d):
    line = "concat('[TIMING] ', if(event_id % 4 = 0, 'pipeline', 'chunk'), ' | ', if(event_id % 5 = 0, 'summary', event_type), ' | ', format_string('%.2f', (event_id % 100) / 4D), if(event_id % 9 = 0, 'x', 's'))"
    return maintenance.timing_report(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), F.expr(line).alias("line")))


@query("SELECT event_type AS name, min(value) least, median(value) median, max(value) greatest FROM events GROUP BY event_type")
def bench_stats(spark, d):
    return maintenance.bench_stats(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("s")))
