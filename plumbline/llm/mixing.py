"""Operator 6: mixing sources to target weights by fixed-length blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, bounded_broadcast, let, materialize, own_names, running_offsets

#: Words in a block; a source's last block may be shorter.
BLOCK_WORDS = 128
#: Blocks that a source is cut into at least, in shorter ones where it is small, so that whole blocks come near its target.
LEAST_BLOCKS = 64
#: Output shards that the slots are cut into.
N_OUTPUT_SHARDS = 64
WEIGHTS = (3, 1, 2)
#: Of all words, how many the mix takes in percent, and how often it may take one.
SHARE_PERCENT = 150
MAX_EPOCHS = 2
#: Rounds of the index permutation.
ROUNDS = 12


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of index `i` in a pseudorandom permutation of 0..n-1 chosen by `key`.

    Swap or not: each round pairs i with K - i mod n and swaps the two when a hash bit of the pair says so. It is a
    bijection for every n, needs no sort and no table.
    """
    salt = F.xxhash64(*key)

    def step(at: Column, r: Column) -> Column:
        return let(
            F.pmod(F.pmod(F.xxhash64(salt, r), n) - at, n),
            lambda other: F.when(F.xxhash64(salt, r, F.greatest(at, other)).bitwiseAND(1) == 1, other).otherwise(at),
        )

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, step)).otherwise(i)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target (words) of each source of `sizes` (source, source_size).

    Sources in code point order, null last, weigh `weights`, repeating. Targets share `share_percent` of all words by
    weight; none exceeds max_epochs times its source, and what is over is shared again. That equals one water level: in
    order of size by weight the first sources are full, the rest take a common amount by weight. One row a source; this
    window over all sources is the only step in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("__w", F.get(w, rank % len(weights))).withColumn("__cap", F.col("source_size").cast("double") * max_epochs)
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__total", F.sum("source_size").over(everything).cast("double") * share_percent / 100)
    t = t.withColumn("__cap_before", F.coalesce(F.sum("__cap").over(full), F.lit(0.0))).withColumn("__w_before", F.coalesce(F.sum("__w").over(full), F.lit(0.0)))
    level = (F.col("__total") - F.col("__cap_before")) / (F.sum("__w").over(everything) - F.col("__w_before"))
    t = t.withColumn("__here", level).withColumn("__fits", F.col("__here") * F.col("__w") <= F.col("__cap"))
    # The level at the first source that is not full holds for all the rest; if all are full every target is its cap.
    t = t.withColumn("__level", F.min(F.when(F.col("__fits"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__here").alias("x")))).over(everything)["x"])
    return t.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def _plan(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds to each source the words of its blocks, its blocks, its slots and the slots of the sources before it, all as exact counts."""
    fine = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    t = targets.withColumn("block_words", fine.cast("long"))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    mean = F.col("source_size") / F.col("n_blocks")
    slots = F.when(F.col("n_blocks") > 0, F.least(F.round(F.col("target") / mean).cast("long"), F.col("n_blocks") * MAX_EPOCHS)).otherwise(F.lit(0))
    t = t.withColumn("slots", slots.cast("long"))
    ahead = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("first_slot", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).cast("long")).withColumn("all_slots", F.coalesce(F.sum("slots").over(Window.partitionBy()), F.lit(0)).cast("long"))


def _chunked(rows: DataFrame, n: Column, total: int, *key: str) -> DataFrame:
    """Rows with `j` from 0 to n - 1, made in chunks that are dealt over the tasks, so the hot source is spread."""
    chunk = 16_384
    cut = rows.where(n > 0).withColumn("__c", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))))
    cut = cut.repartition(max(8, -(-total // (4 * chunk))), *key, "__c")
    first = F.col("__c").cast("long") * chunk
    return cut.withColumn("j", F.explode(F.sequence(first, F.least(first + chunk, n) - 1))).drop("__c")


def shard_counts(plan: DataFrame, seed: int = 0, n_shards: int = N_OUTPUT_SHARDS) -> DataFrame:
    """shard, source_no, n: how many slots of each output shard a source gets, written.

    The counts of a shard are multinomial, conditioned on every source's total, without which small sources would stray from
    their targets and full ones pass their caps: a permutation of all slots deals exactly `slots` of them to each source, and
    a shard is a range of slots.
    """
    total = plan.agg(F.max("all_slots")).first()[0] or 0
    draws = _chunked(plan.select("source_no", "slots", "first_slot", "all_slots"), F.col("slots"), total, "source_no")
    slot = permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), F.lit("slots"), F.lit(seed))
    shard = F.floor(slot / F.ceil(F.col("all_slots") / n_shards)).cast("int")
    return materialize(draws.groupBy(shard.alias("shard"), "source_no").agg(F.count("*").alias("n")), "mix-shards")


def draw_slots(plan: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """shard, slot, source_no, block, one row a slot of the mix; slots are numbered within their shard.

    The counts (shard, source_no, n) cut each source's draws into a range for each shard, in the order of the shards. The
    j-th draw of a source takes its epoch's permutation of the source's blocks at j. Inside a shard a permutation deals
    the slots to its draws.
    """
    total = plan.agg(F.max("all_slots")).first()[0] or 0
    ahead = lambda key, order: F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select("shard", "source_no", "n", ahead("source_no", "shard").alias("first_draw"), ahead("shard", "source_no").alias("first_place"), F.sum("n").over(Window.partitionBy("shard")).alias("size"))
    draws = _chunked(ranges.join(F.broadcast(plan.select("source_no", "n_blocks")), "source_no"), F.col("n"), total, "source_no", "shard")
    draw = F.col("first_draw") + F.col("j")
    epoch = F.floor(draw / F.col("n_blocks")).cast("long")
    block = permuted(draw - epoch * F.col("n_blocks"), F.col("n_blocks"), F.lit("blocks"), F.lit(seed), F.col("source_no"), epoch)
    slot = permuted(F.col("first_place") + F.col("j"), F.col("size"), F.lit("places"), F.lit(seed), F.col("shard"))
    return draws.select("shard", slot.alias("slot"), "source_no", block.alias("block"))


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text: slim, written, the only pass over the texts."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")
    return materialize(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, n_shards: int = N_OUTPUT_SHARDS) -> dict[str, DataFrame]:
    """The mix of all `docs` as frames: `plan` (sources), `counts` (of slots by shard and source), `slots` (shard, slot,
    source_no, block, one row a slot), `sized` (doc_id, source, size, text_hash), `pieces` (doc_id, text_hash, source,
    source_no, offset, block, from_word, n_words: where each block's words lie), `drawn` (pieces with `places`, the shards and slots their block takes, and `times`, their number) and
    `documents` (doc_id, size, source_size, target, taken, and first_shard and first_slot, the first place of any of its
    words, null if none is taken).

    Texts' words of a source, in an order fixed by hashes of doc_id, form one stream that blocks of `block_words` cut, in a
    source of fewer than LEAST_BLOCKS times as many words blocks of a LEAST_BLOCKS-th of it, a word at least; slots are joined
    to pieces by (source, block). Null and empty texts have no words and are never taken; a null source is a source; rows
    that repeat an id take their own place; an empty table gives empty frames; other columns are not read. The same rows
    and seed give the same mix.
    """
    sized = _sized(docs)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _plan(source_targets(sources), block_words)
    plan = materialize(plan.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1), "mix-plan")
    counts = shard_counts(plan, seed, n_shards)
    slots = draw_slots(plan, counts, seed)
    placed = running_offsets(sized, "source", F.col("size"), ["doc_id", "text_hash", "size"])
    narrow = plan.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "block_words")
    placed = placed.join(narrow, placed.source.eqNullSafe(narrow["__source"])).drop("__source")
    placed = materialize(placed, "mix-places")
    end = F.col("offset") + F.col("size")
    wide = F.col("block_words")
    pieces = placed.where("size > 0").select("doc_id", "text_hash", "size", "offset", "source", "source_no", "block_words", F.explode(F.sequence(F.floor(F.col("offset") / wide), F.floor((end - 1) / wide))).alias("block"))
    start = F.greatest(F.col("offset"), F.col("block") * wide)
    stop = F.least(end, (F.col("block") + 1) * wide)
    pieces = pieces.select("doc_id", "text_hash", "size", "offset", "source", "source_no", "block", (start - F.col("offset")).alias("from_word"), (stop - start).alias("n_words"))
    # A block is taken at most MAX_EPOCHS times. Written, so that its true size decides how it is joined: Spark can't tell
    # how many rows the sequences above make.
    times = materialize(slots.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places")), "mix-times")
    drawn = pieces.join(times, ["source_no", "block"]).withColumn("times", F.size("places"))
    # Rows are told apart by their place in the source's stream.
    by_row = ["source_no", "offset", "doc_id", "size"]
    taken = drawn.groupBy(*by_row).agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"), F.min(F.col("places")[0]).alias("place"))
    t = taken.select(F.col("source_no").alias("__s"), F.col("offset").alias("__o"), F.col("doc_id").alias("__d"), F.col("size").alias("__n"), "taken", "place")
    same = (placed.source_no == t["__s"]) & (placed["offset"] == t["__o"]) & placed.doc_id.eqNullSafe(t["__d"]) & (placed["size"] == t["__n"])
    documents = placed.join(t, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("place.shard").alias("first_shard"), F.col("place.slot").alias("first_slot"))
    return {"plan": plan, "counts": counts, "slots": slots, "sized": sized, "pieces": pieces, "drawn": drawn, "documents": documents}


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` as the mix takes them, with the same columns: one row for each time a row's words are taken.

    The first row of a document holds the words that the mix takes at least once, the second those that it takes twice,
    in their order and with the white space that follows each word (leading white space stays with the first word);
    n_chars, where present, is counted anew. Documents of which nothing is taken are absent. Each row takes what its own
    place in its source's stream takes, also where rows repeat doc_id, source and text; the other columns of such rows are
    those of any one of them. The totals of sources are fixed; the seed draws where slots lie, which this result doesn't carry.
    """
    mixed = mix(own_names(docs), seed)
    copies = mixed["drawn"].select("source_no", "offset", "doc_id", "source", "text_hash", "from_word", "n_words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    cuts = copies.groupBy("source_no", "offset", "doc_id", "source", "text_hash", "copy").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "__cuts")
    units = F.regexp_extract_all(F.col("text"), F.lit(f"(?:^[{SPACE}]+)?[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    text = let(units, lambda u: F.array_join(F.transform(F.col("__cuts"), lambda c: F.array_join(F.slice(u, c["from_word"].cast("int") + 1, c["n_words"].cast("int")), "")), ""))
    same = lambda of, at: of.doc_id.eqNullSafe(at["__id"]) & of.source.eqNullSafe(at["__source"]) & F.xxhash64(of.text).eqNullSafe(at["__hash"])
    repeated = mixed["sized"].where("size > 0").groupBy("doc_id", "source", "text_hash").count().where("count > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash")), "mix-repeated")
    if n := repeated.count():
        # One row stands for those that repeat id, source and text, and meets the cuts of each.
        few = bounded_broadcast(repeated, n)
        docs = docs.join(few, same(docs, repeated), "left_anti").unionByName(docs.join(few, same(docs, repeated), "left_semi").dropDuplicates(["doc_id", "source", "text"]))
    joined = docs.join(cuts, same(docs, cuts))
    new = {"text": text.alias("text")} | ({"n_chars": F.length(text).cast("long").alias("n_chars")} if "n_chars" in docs.columns else {})
    return joined.select(*[new.get(c, docs[c]) for c in docs.columns])
