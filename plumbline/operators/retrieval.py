"""Vector retrieval with parent expansion and source lists."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import broadcast_within

MIN_SCORE = 0.05
MAX_BYTES = 9500
EMPTY_TEXT = "[empty]"
#: Queries and vectors of a key that meet in one task at most, on average, and products it holds at a time.
QUERY_ROWS, VECTOR_ROWS, BLOCK_CELLS = 4_096, 8_192, 2_000_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; null for a zero vector."""
    return F.transform(F.array(F.nullif(F.sqrt(_dot(v, v)), F.lit(0.0))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def _dealt(queries: DataFrame, vectors: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with __qp and __vp: the queries and vectors of each key are cut into parts by a hash of their ids, and each part of the
    one meets each part of the other once. Only the number of parts by key is broadcast."""
    parts = lambda df, rows, name: df.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = broadcast_within(parts(queries, QUERY_ROWS, "__qs").join(parts(vectors, VECTOR_ROWS, "__vs"), on))
    every, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = queries.join(sizes, on).select(*on, "query_id", "__q", own("query_id", "__qs").alias("__qp"), every("__vs").alias("__vp"))
    return asked, vectors.join(sizes, on).select(*[F.col(c).alias(c) for c in on], "vec_id", "__v", every("__qs").alias("__qp"), own("vec_id", "__vs").alias("__vp"))


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each length and their vectors as a matrix."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    lengths = np.diff(at)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, values[at[rows][:, None] + np.arange(n)]
    return out


def _best(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, rows of v and their products, for at least the k best of each row of q by product to 4 places and `order` of v.

    A matrix product tells which can be among them; their own products are summed up in the order of the components, so they
    don't depend on the blocks.
    """
    step = max(1, BLOCK_CELLS // max(1, len(v)))
    for start in range(0, len(q), step):
        block = q[start : start + step]
        about = block @ v.T
        about[np.isnan(about)] = np.inf
        if len(v) > k:
            i, j = np.nonzero(about >= np.partition(about, len(v) - k, axis=1)[:, len(v) - k, None] - 2e-4)
        else:
            i, j = (x.ravel() for x in np.indices(about.shape))
        score = np.zeros(len(i))
        for c in range(v.shape[1]):
            score += block[i, c] * v[j, c]
        tenths = score * 1e4 + 0.5
        # Spark rounds decimal digits; what lies at a border goes on to it in any case.
        border = np.abs(tenths - np.rint(tenths)) < 1e-6
        by = np.lexsort((order[j], np.where(np.isnan(score), -np.inf, -np.floor(tenths)), i))
        of = i[by]
        place = np.arange(len(by)) - np.searchsorted(of, of)
        kept = by[(place < k) | border[by]]
        yield i[kept] + start, j[kept], score[kept]


def _ranked(queries: DataFrame, vectors: DataFrame, on: list[str], k: int, min_score: float) -> DataFrame:
    """Lengths are divided out before. Parts of queries meet parts of vectors in tasks that multiply them as matrices and give the k
    best rows a query, so pairs are no rows and the final ranking gets k rows a query and part, even for a hot project. Vectors that
    are null, of length zero or without a component match nothing."""
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    asked = queries.select(*on, "query_id", unit(F.col("query_vector")).alias("__q")).where(whole("__q"))
    held = vectors.select(*on, "vec_id", unit(F.col("embedding")).alias("__v")).where(whole("__v"))
    asked, held = _dealt(asked, held, on)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, order = right.column("vec_id"), pc.rank(right.column("vec_id"), tiebreaker="dense").to_numpy()
        of_q, of_v, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        ours, theirs = _matrices(left.column("__q")), _matrices(right.column("__v"))
        for n in ours.keys() & theirs.keys():
            (a, q), (b, v) = ours[n], theirs[n]
            for i, j, s in _best(q, v, order[b], k):
                of_q, of_v, scores = [*of_q, a[i]], [*of_v, b[j]], [*scores, s]
        return pa.table({"query_id": left.column("query_id").take(pa.array(np.concatenate(of_q))), "vec_id": ids.take(pa.array(np.concatenate(of_v))), "score": np.concatenate(scores)})

    keys = [*on, "__qp", "__vp"]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, schema).withColumn("score", F.round("score", 4)).where(F.col("score") >= min_score)
    best = [F.col("score").desc(), F.col("vec_id")]
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, on: tuple[str, ...] = ("project",), min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, vec_id, score (cosine, 4 places), rank: the k best vectors that share `on` with the query; ties by vec_id."""
    return _ranked(queries, vectors, list(on), k, min_score)


def vector_topk_fallback(queries: DataFrame, vectors: DataFrame, k: int, strict: tuple[str, ...], loose: tuple[str, ...] = ("project",), min_score: float = MIN_SCORE) -> DataFrame:
    """As vector_topk on `strict`; queries without any hit are searched again on `loose` alone."""
    first = vector_topk(queries, vectors, k, strict, min_score)
    rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti").drop(*(set(strict) - set(loose)))
    return first.unionByName(vector_topk(rest, vectors, k, loose, min_score))


def parent_expand(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a query and parent chunk (or chunk without parent): its best score and number of hits."""
    joined = hits.join(chunks.select("vec_id", "parent_id"), "vec_id")
    return joined.groupBy("query_id", F.coalesce("parent_id", "vec_id").alias("section_id")).agg(F.max("score").alias("score"), F.count("*").alias("n_hits"))


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """Over all queries, each chunk's best score and the query that gave it, the smallest on ties."""
    return hits.groupBy("vec_id").agg(F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("query_id"), F.max("score").alias("score"))


def primary_wins(primary: DataFrame, secondary: DataFrame, n_primary: int = 5, n_secondary: int = 3) -> DataFrame:
    """The first rows of two searches of a query; where both have a chunk the primary's row stays."""
    both = primary.where(F.col("rank") <= n_primary).withColumn("origin", F.lit(0)).unionByName(secondary.where(F.col("rank") <= n_secondary).withColumn("origin", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("origin"))
    return both.withColumn("n", first).where("n = 1").drop("n")


def sized_topk(hits: DataFrame, documents: DataFrame, factor: int, least: int, most: int) -> DataFrame:
    """Hits up to a rank of min(most, max(least, factor * documents)) of their project (project, n_documents)."""
    limit = F.least(F.lit(most), F.greatest(F.lit(least), F.col("n_documents") * factor))
    return hits.join(documents, "project").withColumn("k", limit.cast("int")).where(F.col("rank") <= F.col("k")).drop("n_documents")


def assembled_context(hits: DataFrame, texts: DataFrame, cap: int) -> DataFrame:
    """query_id and one text with the first `cap` hits as numbered sources."""
    rows = hits.where(F.col("rank") <= cap).join(texts, "vec_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def sanitised(text: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Text for an embedder: control, NUL and replacement characters go, ends are trimmed, empty gets a placeholder, and at
    most `max_bytes` of UTF-8 stay, cut between characters."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFD]", ""))
    clean = F.when(clean == "", F.lit(EMPTY_TEXT)).otherwise(clean)
    # A cut inside a character leaves one to three continuation bytes short; step back over them.
    raw = F.encode(clean, "UTF-8")
    cut = F.when(F.octet_length(raw) <= max_bytes, clean).otherwise(F.try_validate_utf8(F.lit(None).cast("string")))
    for back in range(4):
        cut = F.coalesce(cut, F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string")))
    return cut


def vector_records(chunks: DataFrame) -> DataFrame:
    """Id and null-safe metadata of each chunk, with a preview of 200 characters."""
    text = F.coalesce("text", F.lit(""))
    return chunks.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("record_id"),
        F.coalesce("section", F.lit("")).alias("section"), F.coalesce("subsection", F.lit("")).alias("subsection"), F.coalesce("page_start", F.lit(0)).alias("page"), F.substring(text, 1, 200).alias("preview"),
    )


def hashed_words(texts: list[str], dim: int = 64) -> list[list[float]]:
    """An embedder that needs no model: each word counts, with a sign, at a place that its hash names."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        out.append(v)
    return out


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashed_words, batch: int = 100, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds `embedding` by a user's function over batches of texts. A batch that fails is tried again, `wait` seconds later and
    then twice that and so on, and after `tries` halved until one bad text is alone, which gets a null vector."""

    def vectors(part: list[str]) -> list:
        for n in range(tries):
            try:
                return list(embed(part))
            except Exception:  # the caller's function, of any kind
                time.sleep(wait * 2**n if n < tries - 1 else 0)
        return [None] if len(part) == 1 else vectors(part[: len(part) // 2]) + vectors(part[len(part) // 2 :])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(embedding=[v for i in range(0, len(f), batch) for v in vectors(f["text"].iloc[i : i + batch].tolist())])

    return texts.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", embedding array<double>")


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (doc_id, ...) of documents (doc_id, archived) that are not archived; one without a document goes."""
    return chunks.join(documents.where(~F.col("archived")).select("doc_id").distinct(), "doc_id", "left_semi")


def capped_sources(hits: DataFrame, least: int = 15, most: int = 80) -> DataFrame:
    """Of each query's hits (query_id, vec_id, score) the best min(most, max(least, their number)); ties by vec_id."""
    of_query = Window.partitionBy("query_id")
    ranked = hits.withColumn("n_hits", F.count("*").over(of_query)).withColumn("rank", F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= F.least(F.lit(most), F.greatest(F.lit(least), F.col("n_hits"))))


def guarded_query(raw: Column, corrected: Column) -> Column:
    """The corrected query if it is neither empty nor five times as long as the raw one or longer; else the raw one."""
    fixed = F.trim(corrected)
    return F.when((fixed != "") & (F.length(fixed) < F.length(raw) * 5), fixed).otherwise(raw)
