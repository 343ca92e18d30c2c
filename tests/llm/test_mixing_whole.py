"""The whole mix recomputed in plain Python: hashes, permutations, targets, counts by shard, blocks and takings."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import xxhash

from plumbline.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def hashed(*values):
    """Spark's xxhash64: longs as int, ints as (int,), text as str; null leaves the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h & MASK)
    return h - (1 << 64) if h >> 63 else h


def permuted(i, n, *key):
    if n <= 1:
        return i
    salt = hashed(*key)
    for r in range(1, mixing.ROUNDS + 1):
        other = (hashed(salt, (r,)) % n - i) % n
        if hashed(salt, (r,), max(i, other)) & 1:
            i = other
    return i


def water_filled(sizes, weights, share, most):
    """Targets by the words of the rule: share by weight, cap, share the excess again until none is above."""
    total, target, full = sum(sizes) * share / 100, [0.0] * len(sizes), set()
    while True:
        left = total - sum(sizes[k] * most for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        for k in range(len(sizes)):
            target[k] = sizes[k] * most if k in full else left * weights[k % len(weights)] / sum(weights[j % len(weights)] for j in open_)
        over = {k for k in open_ if target[k] > sizes[k] * most}
        if not over:
            return target
        full |= over


def mixed(rows, block, n_shards, rows_per_bucket=2000, with_times=False):
    """documents by (doc_id, text): size, source_size, target, taken, first_shard, first_slot; and the counts by shard and source;
    on demand also how often each word of each row is taken."""
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    docs = [(i, len(WORD.findall(t or "")), hashed(t), names.index(s), k) for k, (i, t, s) in enumerate(rows)]
    sizes = [sum(n for _, n, _, s, _ in docs if s == k) for k in range(len(names))]
    target = water_filled(sizes, mixing.WEIGHTS, mixing.SHARE_PERCENT, mixing.MAX_EPOCHS)
    wide = [max(1, min(block, n // mixing.LEAST_BLOCKS)) for n in sizes]
    blocks = [-(-n // w) for n, w in zip(sizes, wide, strict=True)]
    slots = [min(math.floor(target[k] / (sizes[k] / blocks[k]) + 0.5), blocks[k] * mixing.MAX_EPOCHS) if blocks[k] else 0 for k in range(len(names))]
    total, first = sum(slots), [sum(slots[:k]) for k in range(len(names))]
    counts = Counter((permuted(first[k] + j, total, "slots", (0,)) // -(-total // n_shards), k) for k in range(len(names)) for j in range(slots[k]))
    places = defaultdict(list)
    for k in range(len(names)):
        draw = 0
        for shard in sorted(x for x, s in counts if s == k):
            ahead, size = sum(counts[shard, s] for s in range(k)), sum(n for (x, _), n in counts.items() if x == shard)
            for j in range(counts[shard, k]):
                epoch, at = divmod(draw, blocks[k])
                slot = permuted(ahead + j, size, "places", (0,), (shard,))
                places[k, permuted(at, blocks[k], "blocks", (0,), (k,), epoch)].append((shard, slot))
                draw += 1
    buckets = max(1, -(-len(rows) // rows_per_bucket))
    out, times, offset = {}, {}, [0] * len(names)
    for i, n, text_hash, s, k in sorted(docs, key=lambda d: (hashed(d[0], d[2], d[1]) % buckets, d[0] is not None, d[0] or 0, d[2], d[1])):
        words = Counter(w // wide[s] for w in range(offset[s], offset[s] + n))
        times[k] = [len(places[s, w // wide[s]]) for w in range(offset[s], offset[s] + n)]
        offset[s] += n
        took = [p for b in words for p in places[s, b]]
        out[k] = (i, n, sizes[s], float(target[s]), sum(c * len(places[s, b]) for b, c in words.items()), *(min(took) if took else (None, None)))
    return (sorted(map(str, out.values())), dict(counts)) + ((times,) if with_times else ())


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((0, 1, 5, 30, 200)))), rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, " \t\n", None), (n + 2, "one two", "tiny")]


def test_mix_equals_plain_python(spark):
    for n, block, n_shards in ((60, 7, 5), (25, 128, 64)):
        rows = rows_of(n, n)
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block_words=block, n_shards=n_shards)
        want, counts = mixed(rows, block, n_shards)
        assert {(r.shard, r.source_no): r.n for r in out["counts"].collect()} == counts
        got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_shard, r.first_slot) for r in out["documents"].collect()]
        near = lambda x: re.sub(r"\d+\.\d+", lambda m: f"{float(m[0]):.6f}", x)
        assert sorted(map(near, map(str, got))) == sorted(map(near, want))


def test_small_sources_come_within_a_word_of_their_targets(spark):
    """Sources of 1 to 64 words are taken word by word; larger ones come within a 64-th of their words."""
    sizes = {"a": 20_000, "b": 3, "c": 1, "d": 64, "e": 129, "f": 700}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for seed in (0, 1):
        for r in mixing.mix(docs, seed)["documents"].collect():
            assert abs(r.taken - r.target) <= max(1, r.source_size / mixing.LEAST_BLOCKS) and r.taken <= 2 * r["size"]


def test_offsets_in_runs_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_RUN", 7)
    rows = [(i, None if i % 3 == 0 else f"g{i % 2}", i % 5) for i in range(400)]
    df = common.materialize(spark.createDataFrame(rows, "id long, g string, n long"), "offsets")
    out = common.running_offsets(df, "g", df.n, ["id"], rows_per_bucket=10).collect()
    assert len(out) == 400
    for g in {r.g for r in out}:
        at = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: (r.offset, r.n)):
            assert r.offset == at
            at += r.n


def test_shared_folder_is_asked_for_on_a_cluster():
    import pytest

    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "none"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
