"""The registered queries of this subpackage, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, html_extract, jaccard_join, line_dedup, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, sharding, turn_repair, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    # Only slim columns are written: the texts end in the metrics.
    rules = quality_rules.annotate(docs).select("doc_id", "source", "__rules")
    rules = quality_rules.with_verdicts(rules)
    return rules.select("doc_id", *[F.col(f"__rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("__lines.n_lines").alias("n_lines"), F.col("__lines.n_dropped").alias("n_dropped"), F.sha2(F.encode(F.col("__lines.kept_text"), "UTF-8"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))["documents"]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = prefix_trie.conversation_keys(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(keys))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repair(turn_repair.damaged(rows), ids=rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_host_quality_rules, op2_pii_anchors, op3_line_dedup, op4_quality_classifier, op5_packing, op6_mixing, op7_sharding, op8_embedding_dedup, op9_jaccard_join, op10_html_extraction, op11_prefix_trie, op12_warc, op13_turn_repair)
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t, {_WORDS} w, row_number() OVER () r FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 3)) i FROM d WHERE len(w) >= 5),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') g FROM i),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) c FROM g),
p AS (SELECT r, count(DISTINCT x) n FROM (SELECT r, unnest(range(i, i + 5)) x FROM n WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, source, d.r, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, coalesce(p.n, 0)::BIGINT n_repeat_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM d LEFT JOIN p ON d.r = p.r),
b AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m),
h AS (SELECT source, count(*) n, count(*) FILTER (base_failed) f FROM b GROUP BY source),
q AS (SELECT avg(f / n) m, var_pop(f / n) v, avg(1 / n) k FROM h),
s AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * k, 1e-9) - 1, {quality_rules.PRIOR_STRENGTH[0]}), {quality_rules.PRIOR_STRENGTH[1]}) s FROM q),
v AS (SELECT source, (f + m * s) / (n + s) > {quality_rules.MAX_HOST_RATE} host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l, row_number() OVER () r FROM documents),
x AS (SELECT doc_id, r, unnest(range(1, len(l) + 1)) i, unnest(l) line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM x),
hot AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCUMENTS}),
y AS (SELECT k.*, hot.k IS NOT NULL gone FROM k LEFT JOIN hot ON k.k = hot.k)
SELECT any_value(doc_id) doc_id, count(*)::BIGINT n_lines, (count(*) FILTER (gone))::BIGINT n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM y GROUP BY r
"""

_OP8 = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id a, b.vec_id b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {embed_dedup.THRESHOLD}),
c AS (SELECT vec_id a, vec_id b FROM e UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) m FROM c GROUP BY a),
n AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT n_links, coalesce(m.m, vec_id) component_id, vec_id = coalesce(m.m, vec_id) kept
FROM embeddings LEFT JOIN m ON vec_id = m.a LEFT JOIN n ON vec_id = n.a
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {jaccard_join.PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) m FROM r GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, m.m component_id
FROM documents JOIN m ON documents.doc_id = m.a LEFT JOIN n ON documents.doc_id = n.doc_id
"""


#: crc32 of an ASCII text `%s`, bit by bit with the reversed polynomial.
_CRC = "xor(list_reduce(list_transform(string_split(%s, ''), lambda ch: ascii(ch)::BIGINT), lambda acc, b: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(acc, b)), 4294967295::BIGINT), 4294967295)"

_OP11 = rf"""
WITH o AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i, md5(concat(strlen(coalesce(role, '')), ':', role, ':', text)) k, len({_WORDS})::BIGINT w
    FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, ({_CRC % 'c::VARCHAR'} % 4)::BIGINT h, list({{'k': k, 'w': w}} ORDER BY i) l FROM o GROUP BY c),
b AS (SELECT n.c, coalesce(z.l[1:n.h], []) || n.l[n.h + 1:] l FROM n LEFT JOIN n z ON z.c = n.c - n.c % 20),
p AS (SELECT c, array_to_string(list_transform(l, lambda x: x.k), '') s, list_transform(l, lambda x: x.w) w, unnest(range(0, len(l) + 1)) d FROM b),
v AS (SELECT substr(s, 1, 32 * d) k, d::BIGINT depth, min(c) conv_id, count(*) n_convs, any_value(CASE WHEN d > 0 THEN w[d] ELSE 0 END) w FROM p GROUP BY ALL),
e AS (SELECT s k, string_agg(c::VARCHAR, ',' ORDER BY c) x FROM p WHERE d = 0 GROUP BY s),
m AS (SELECT substr(k, 1, 32 * (depth - 1)) k, count(*) n FROM v WHERE depth > 0 GROUP BY 1),
y AS (SELECT v.k, depth, unnest(range(0, depth + 1)) up, (m.n IS NULL)::BIGINT leaf, (n_convs - 1) * w saved FROM v LEFT JOIN m ON v.k = m.k),
t AS (SELECT substr(k, 1, 32 * up) k, sum(leaf)::BIGINT n_leaves, sum(saved)::BIGINT saved_tokens FROM y GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id parent_conv_id, v.n_convs, coalesce(m.n, 0)::BIGINT n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.x, '')) ends_sha256
FROM v JOIN t ON v.k = t.k LEFT JOIN m ON v.k = m.k LEFT JOIN e ON v.k = e.k LEFT JOIN v u ON v.depth > 0 AND u.k = substr(v.k, 1, 32 * (v.depth - 1))
"""

_OP12 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') t, row_number() OVER () r FROM pages),
q AS (SELECT page_id, strlen(t) payload_bytes, sha256(t) payload_digest, row_number() OVER w n, first_value(page_id) OVER w f FROM p WINDOW w AS (PARTITION BY sha256(t) ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND n > 1 THEN 'revisit' ELSE 'response' END record_type,
    CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND n > 1 THEN f END refers_to FROM q
"""

_OP13 = rf"""
WITH RECURSIVE d AS (SELECT conv_id c, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, {_CRC % "concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))"} % 20 h FROM conversations),
x AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE r END r, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END t, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) k FROM d WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, t) i, r[1] a FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY c, r, t ORDER BY i) > 1 dup, NOT regexp_matches(t, '[^ 	-
]') blank, NOT regexp_matches(t, '[.!?][ 	-
]*$') cut, lag(a) OVER (PARTITION BY c ORDER BY i) || a pair FROM o),
g AS (SELECT *, CASE WHEN blank OR dup THEN 'x' WHEN a NOT IN ('s', 'u', 'a') THEN CASE WHEN cut THEN 'O' ELSE 'o' END WHEN cut THEN upper(a) ELSE a END y FROM f),
s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT gaps, count(*) FILTER (blank) blank, count(*) FILTER (dup AND NOT blank) duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT dup) truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal, list(y ORDER BY i DESC) z FROM g GROUP BY c),
b AS (SELECT *, list_reduce(z, lambda w, y: list_reduce(range(3), lambda m, q: list_transform([1, 2, 3, 4], lambda j: list_min([m[j], {{'c': 5 + m[[3, 3, 4, 3][j]].c, 'e': 'I' || m[[3, 3, 4, 3][j]].e}}])),
    list_transform([1, 2, 3, 4], lambda j: list_min([{{'c': 2 + w[j].c, 'e': 'D' || w[j].e}}]
        || CASE WHEN y = 'x' THEN [] ELSE [{{'c': 1 + 5 * (y = upper(y))::BIGINT + w[[3, 3, 4, 3][j]].c, 'e': 'R' || w[[3, 3, 4, 3][j]].e}}] END
        || CASE WHEN lower(y) = 's' AND j = 1 THEN [{{'c': 5 * (y = 'S')::BIGINT + w[2].c, 'e': 'K' || w[2].e}}]
                WHEN lower(y) = 'u' AND j <> 3 THEN [{{'c': 5 * (y = 'U')::BIGINT + w[3].c, 'e': 'K' || w[3].e}}]
                WHEN lower(y) = 'a' AND j = 3 THEN [{{'c': 5 * (y = 'A')::BIGINT + w[4].c, 'e': 'K' || w[4].e}}] ELSE [] END))),
    [{{'c': 0::BIGINT, 'e': ''}}, {{'c': 10::BIGINT, 'e': 'II'}}, {{'c': 5::BIGINT, 'e': 'I'}}, {{'c': 0::BIGINT, 'e': ''}}])[1] best FROM s),
e AS (SELECT c, unnest(string_split(best.e, '')) e, unnest(range(len(best.e))) j FROM b WHERE best.e <> ''),
n AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY c ORDER BY j) i, count(*) FILTER (e <> 'D') OVER (PARTITION BY c ORDER BY j) p FROM e),
k AS (SELECT n.c, n.j, n.e, n.p, g.r, g.t, max(CASE WHEN n.e = 'K' AND n.p = 1 AND g.a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.c) sys
    FROM n LEFT JOIN g ON n.c IS NOT DISTINCT FROM g.c AND n.i = g.i WHERE n.e <> 'D'),
u AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN r WHEN (p - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t END, chr(10) ORDER BY j) x FROM k GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated,
    coalesce(illegal, 0)::BIGINT illegal, coalesce(best.c, 0)::BIGINT cost, coalesce(best.e, '') audit, sha256(coalesce(x, '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN b ON ids.conv_id IS NOT DISTINCT FROM b.c LEFT JOIN u ON ids.conv_id IS NOT DISTINCT FROM u.c
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can't express an operator (2, 4, 5, 6, 7, 10) tests/llm holds its query against a brute-force version."""
    return {"op1_host_quality_rules": _OP1, "op3_line_dedup": _OP3, "op8_embedding_dedup": _OP8, "op9_jaccard_join": _OP9, "op11_prefix_trie": _OP11, "op12_warc": _OP12, "op13_turn_repair": _OP13}
