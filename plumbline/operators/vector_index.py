"""Vector search through an inverted file: coarse lists around centroids, exact scores inside them, exact answers on request."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import MIN_SCORE, _ranked
from .scratch import written

#: Vectors that centroids are fitted on at most, and lists at most: both fit the driver. Every vector is put into a list.
SAMPLE_ROWS, MAX_LISTS = 20_000, 1_024
ROUNDS, SEED = 10, 7
#: Scores are rounded to 4 places; a list whose bound is within that of the k-th score is searched too.
SLACK = 1e-3


@dataclass
class VectorIndex:
    """`rows`: vec_id, the columns of `on`, embedding and list of every vector with a length. `centroids` have length one, `widest`
    is the greatest angle of each list's vectors to its centroid."""

    rows: DataFrame
    on: tuple[str, ...]
    centroids: np.ndarray
    widest: np.ndarray


def _units(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and whether each vector has a length (and `dim` components, none of them null or infinite)."""
    vectors = [np.asarray(v, float) if v is not None and None not in v else np.empty(0) for v in column.to_pylist()]
    dim = max((len(v) for v in vectors), default=0) if dim is None else dim
    good = np.array([len(v) == dim > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in vectors], bool)
    out = np.zeros((len(vectors), dim))
    for i in np.flatnonzero(good):
        out[i] = vectors[i] / np.linalg.norm(vectors[i])
    return out, good


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from rows drawn with a fixed seed; a centroid that no row is nearest to stays."""
    centroids = sample[np.random.default_rng(SEED).permutation(len(sample))[:n]].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), centroids)
    return centroids


def fitted_index(vectors: DataFrame, on: tuple[str, ...] = ("project",), n_lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """The inverted file of `vectors` (vec_id, embedding, and the columns of `on`).

    Centroids are fitted on at most `sample_rows` vectors, those of the least hashes of vec_id among a share of them; there are as many lists as the
    square root of the number of vectors, at most MAX_LISTS. Vectors without a length are in no list, as they match nothing.
    """
    n = vectors.count()
    share = min(1.0, 2 * sample_rows / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id")).select("embedding").limit(sample_rows)
    units, good = _units(drawn.toArrow().column(0).combine_chunks())
    sample = units[good]
    lists = min(MAX_LISTS, len(sample), n_lists or max(1, round(n**0.5)))
    centroids = _centroids(sample, lists) if lists else np.zeros((0, units.shape[1]))
    dim = centroids.shape[1]
    columns = ["vec_id", *on, "embedding"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fine = _units(batch.column(len(columns) - 1), dim)
            near = rows @ centroids.T if lists else np.zeros((len(rows), 1))
            best = np.argmax(near, axis=1) if len(rows) else np.zeros(0, int)
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(near[np.arange(len(rows)), best])], [*columns, "list", "nearness"])
            yield made.filter(pa.array(fine & (lists > 0)))

    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", list int, nearness double"
    rows = written(vectors.select(*columns).mapInArrow(put, schema), "vector-index")
    least = {r.list: r.least for r in rows.groupBy("list").agg(F.min("nearness").alias("least")).collect()}
    widest = np.array([np.arccos(np.clip(least.get(i, 1.0), -1, 1)) for i in range(lists)])
    return VectorIndex(rows.drop("nearness"), tuple(on), centroids, widest)


def _probes(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """query_id, the index's columns, query_vector, list, place (its rank by nearness of the centroid) and bound: what a vector of the list can score at most."""
    columns, centroids, widest = ["query_id", *index.on, "query_vector"], index.centroids, index.widest

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                part = batch.slice(start, 32)
                rows, fine = _units(part.column(len(columns) - 1), centroids.shape[1])
                near = rows @ centroids.T
                order = np.argsort(-near, axis=1, kind="stable")
                bounds = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - widest))
                keep = np.flatnonzero(fine)
                taken = part.take(pa.array(np.repeat(keep, len(centroids))))
                lists = order[keep].ravel().astype(np.int32)
                places = np.tile(np.arange(len(centroids), dtype=np.int32), len(keep))
                limit = np.take_along_axis(bounds[keep], order[keep], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists), pa.array(places), pa.array(limit)], [*columns, "list", "place", "bound"])

    kinds = dict(queries.dtypes)
    return queries.select(*columns).mapInArrow(rank, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", list int, place int, bound double")


def index_topk(queries: DataFrame, index: VectorIndex, k: int, probes: int = 16, exact: bool = False, min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, vec_id, score, rank as vector_topk() gives them, from the `probes` nearest lists of each query.

    With `exact` the k-th score found so far decides which other lists can hold a better vector, by the angle between query and
    centroid and the widest angle of the list; those are searched as well, so the answer is that of vector_topk().
    """
    on = [*index.on, "list"]
    asked = _probes(queries, index)
    if not exact:
        return _ranked(asked.where(F.col("place") < probes), index.rows, on, k, min_score)
    asked = written(asked, "probes")
    first = written(_ranked(asked.where(F.col("place") < probes), index.rows, on, k, min_score), "first-probes")
    reached = first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = asked.where(F.col("place") >= probes).join(reached, "query_id", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(min_score)) - SLACK).drop("kth")
    both = first.select("query_id", "vec_id", "score").unionByName(_ranked(rest, index.rows, on, k, min_score).select("query_id", "vec_id", "score"))
    # At most twice k rows a query.
    order = F.struct(-F.col("score"), F.col("vec_id"))
    best = both.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "vec_id", "score"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("place", "x")).select("query_id", "x.vec_id", "x.score", (F.col("place") + 1).cast("int").alias("rank"))


__all__ = ["VectorIndex", "fitted_index", "index_topk"]
