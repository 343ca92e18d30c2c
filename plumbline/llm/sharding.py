"""Operator 7: rendezvous hashing of record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_offsets

N_SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16


def _scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """weight / -ln(u), u a hash of key and shard in (0, 1): the shard with the greatest score owns the key."""
    out = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
        out.append(F.struct((F.lit(float(weight)) / -F.log(unit)).alias("score"), F.lit(shard).alias("shard")))
    return out


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that owns `key`. Shards get keys in proportion to `weights`.

    Adding a shard, or raising one's weight, moves keys only into it; removing one moves only its own keys. Null is a
    key like any other; equal keys share a shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one a shard")
    scores = _scores(key, weights)
    return (scores[0] if len(scores) == 1 else F.greatest(*scores))["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * N_SHARDS, grown_weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row of `docs`.

    size: UTF-8 bytes of the text plus 16. slot: gapless from 0 in each shard, in an order fixed by doc_id; it is counted
    in two levels, so no task holds a shard. grown_shard: the owner under `grown_weights`, by default one more shard of
    weight 1. Null texts are empty and have the crc32 of no bytes, null ids share a shard, repeated ids share a shard and
    take slots of their own, an empty table gives an empty one, other columns are not read.
    """
    grown = tuple(weights) + (1.0,) if grown_weights is None else grown_weights
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), grown).alias("grown_shard"),
    )
    slim = materialize(slim, "shards")
    placed = running_offsets(slim, "shard", F.lit(1), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("offset").alias("slot"), "grown_shard")
