"""The inverted file against all pairs: recall of a few lists, and exact answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def tables(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", F.expr("vec_id % 4").alias("project")).cache()
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "project"), v


def test_recall_and_exact_answers(spark, tables):
    queries, v = tables
    want = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in retrieval.vector_topk(queries, v, 10).collect()}
    index = vector_index.fitted_index(v)
    assert index.rows.count() == v.count() and len(index.centroids) == round(v.count() ** 0.5)
    near = {(r.query_id, r.vec_id): r.score for r in vector_index.index_topk(queries, index, 10, probes=24).collect()}
    assert len(set(near) & set(want)) >= 0.9 * len(want)
    assert all(near[x] == want[x][0] for x in set(near) & set(want))
    for probes in (1, 8):
        assert {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in vector_index.index_topk(queries, index, 10, probes, exact=True).collect()} == want


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "p", [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(100, "p", [0.0] * 4), (101, "p", None), (102, "p", [1.0, None, 0.0, 0.0]), (103, "p", [float("nan"), 1.0, 0.0, 0.0]), (104, "q", [1.0, 0.0, 0.0, 0.0])]
    rows += [(200 + i, "p", [1.0, 1.0, 0.0, 0.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, project string, embedding array<double>")
    good = v.where("vec_id not in (100, 101, 102, 103)")
    queries = spark.createDataFrame([(1, "p", [1.0, 1.0, 0.0, 0.0]), (2, "q", [1.0, 0.1, 0.0, 0.0]), (3, "p", [0.0] * 4), (4, "none", [1.0] * 4)], "query_id long, project string, query_vector array<double>")
    for index in (vector_index.fitted_index(v), vector_index.fitted_index(v, n_lists=40, sample_rows=15)):
        got = sorted(map(tuple, vector_index.index_topk(queries, index, 5, probes=1, exact=True).collect()))
        assert got == sorted(map(tuple, retrieval.vector_topk(queries, good, 5).collect()))
        assert index.rows.count() == good.count()
    assert vector_index.index_topk(queries, vector_index.fitted_index(v.where("false")), 5, exact=True).count() == 0
