"""Ids of the packer against an unmodified tokenizer."""

from __future__ import annotations

import os

import duckdb
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from plumbline.llm import packing

SPECIAL = ["<|endoftext|>", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x  <|endoftext|>\n\n<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [True, False])
@pytest.mark.parametrize("stretch", [packing.STRETCH, 64])
def test_ids_equal_the_tokenizer(plain, monkeypatch, ranks, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    if not ranks:
        exists = os.path.exists
        monkeypatch.setattr(os.path, "exists", lambda x: exists(x) and not str(x).endswith(".tiktoken"))
    packing.load_encoder.cache_clear()
    encode = packing.load_encoder("byte_bpe_50k.json")
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    if not ranks or stretch < 1000:
        texts = texts[::9]
    texts += SPECIAL + [" ".join(SPECIAL * 20), "word " * 200 + "<|endoftext|>" + " word" * 200, "x" * 500, " " * 500, "", "\u00e9\u00df \U0001f600" * 60]
    for t in texts:
        assert packing.encode_whole(encode, t).tolist() == [*plain(t), packing.END_OF_DOCUMENT]
    packing.load_encoder.cache_clear()


def test_special_strings_are_their_id(plain):
    assert packing.load_encoder("byte_bpe_50k.json")("<|endoftext|> x") == plain("<|endoftext|> x") == [50256, 2124]


def test_long_text(plain):
    text = " ".join(f"word{i % 977}, {i}" for i in range(180_000))
    assert len(text) > 2 * packing.STRETCH
    assert packing.encode_whole(packing.load_encoder("byte_bpe_50k.json"), text).tolist() == [*plain(text), packing.END_OF_DOCUMENT]
