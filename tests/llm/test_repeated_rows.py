"""Rows that share doc_id, with and without the same text, through keep_one, the mix and the pipeline's stages."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from plumbline.llm import jaccard_join, mixing

A, B, C = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).repartition(parts)


def test_rows_that_share_an_id_with_a_near_copy_stay(spark):
    rows = [(1, A, "s"), (5, A + " x", "s"), (5, B, "s"), (7, C, "s")]
    assert sorted((r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, rows)).collect()) == [(1, A), (5, B), (7, C)]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A, "s")] * 3 + [(None, A, "t"), (None, B, "s"), (None, B, "s"), (None, C + " y", "s"), (3, C, "s"), (3, C.upper(), "s"), (4, "", "s"), (4, "", "s"), (None, None, "s"), (None, None, "s")]
    out = jaccard_join.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out) == sorted([(1, A), (0, B), (3, C), (4, ""), (4, ""), (0, ""), (0, "")])


@pytest.mark.parametrize("ids", [(1, 2), (1, 1), (None, None)])
def test_repeated_rows_take_what_their_places_take(spark, ids):
    text = " ".join(f"w{i}" for i in range(1_000))
    rows = frame(spark, [(ids[0], text, "s"), (ids[1], text, "s")])
    mixed = mixing.mix(rows)["documents"].collect()
    taken = [len(r.text.split(" ")) if not r.text.endswith(" ") else len(r.text.split()) for r in mixing.mixed_documents(rows).collect()]
    assert sum(taken) == sum(r.taken for r in mixed) and abs(sum(taken) - 3_000) <= mixing.BLOCK_WORDS
    assert all(r.taken <= 2_000 for r in mixed) and len(taken) <= 4


def test_repeated_ids_of_other_texts_and_sources(spark):
    rows = [(1, A, "a"), (1, A, "b"), (1, B, "a"), (1, B, "a"), (None, C, None), (None, C, None), (None, C, "a"), (2, None, "a"), (2, "", "a")]
    docs = frame(spark, rows)
    taken = {}
    for r in mixing.mix(docs)["documents"].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and any(r.text.split()[0] in t.split() and r.source == s for _, t, s in rows if t)
    assert words == {k: n for k, n in taken.items() if n}


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    good = lambda seed: ". ".join(" ".join(f"{seed}x{i}y{j}" for j in range(12)) for i in range(12)) + "."
    texts = [good(k) for k in "abcdefgh"]
    rows = [(1, texts[0], "s"), (1, texts[1], "s"), (1, texts[1] + " end", "s"), (None, texts[2], "t"), (None, texts[3], None), (None, texts[3], None), (2, texts[0] + " more", "s"), (3, texts[4], "t"), (3, texts[4], "t")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), left in zip(corpus_pipeline.STAGES[:3], (9, 9, 5), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == left and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {re.sub("(?: end| more)$", "", r.text) for r in docs.collect()} == set(texts[:5])
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    total, size = sum(len(r.text.split()) for r in mixed.collect()), sum(len(r.text.split()) for r in docs.collect())
    assert 1.2 * size < total <= 2 * size
