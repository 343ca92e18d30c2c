"""The draw of the mix: counts by shard and source, and the slots that follow from them."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plumbline.llm import mixing


def test_shards_are_filled_from_the_counts(spark):
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.expr("element_at(array('a', 'b', 'c'), cast(id % 3 + 1 as int))").alias("source"), F.expr("repeat(concat('w', id, ' '), cast(id % 40 + 5 as int))").alias("text"))
    out = {k: v.collect() for k, v in mixing.mix(docs, block_words=7, n_shards=5).items()}
    totals = {r.source_no: r.slots for r in out["plan"]}
    counts, by_source, by_shard = {(r.shard, r.source_no): r.n for r in out["counts"]}, Counter(), Counter()
    for (shard, source), n in counts.items():
        by_source[source] += n
        by_shard[shard] += n
    assert by_source == totals and max(by_shard.values()) == -(-sum(totals.values()) // 5)
    assert Counter((r.shard, r.source_no) for r in out["slots"]) == counts
    places, blocks = defaultdict(list), defaultdict(Counter)
    for r in out["slots"]:
        places[r.shard].append(r.slot)
        blocks[r.source_no][r.block] += 1
    assert {k: sorted(v) for k, v in places.items()} == {k: list(range(n)) for k, n in by_shard.items()}
    for r in out["plan"]:  # no block is taken again before all were
        taken = [blocks[r.source_no][b] for b in range(r.n_blocks)]
        assert sum(taken) == r.slots and max(taken) - min(taken) <= 1
    times = {(r.source_no, r.block): r.times for r in out["drawn"]}
    assert times == {(s, b): n for s, c in blocks.items() for b, n in c.items()}
