"""Host verdicts, the classifier, rendezvous owners and the pipeline, recomputed in plain Python."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from test_llm import SF, WORD, components, deduped, metrics, shingles
from test_mixing_whole import hashed, mixed
from tokenizers import Tokenizer

from plumbline.llm import common, mixing, quality_classifier, quality_rules, sharding


def rules(rows):
    """(base_failed, host_rate, host_failed, kept) of each of `rows` (doc_id, text, host)."""
    failed = [(m := metrics(t))[0] < 10 or 100 * m[4] > 20 * m[0] for _, t, _ in rows]
    hosts = {}
    for (_, _, h), f in zip(rows, failed, strict=True):
        n, k = hosts.get(h, (0, 0))
        hosts[h] = n + 1, k + f
    rates = [k / n for n, k in hosts.values()]
    mean = sum(rates) / len(rates)
    beyond = max(sum((r - mean) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / n for n, _ in hosts.values()) / len(hosts), 1e-9)
    strength = min(max(mean * (1 - mean) / beyond - 1, quality_rules.PRIOR_STRENGTH[0]), quality_rules.PRIOR_STRENGTH[1])
    rate = {h: (k + mean * strength) / (n + strength) for h, (n, k) in hosts.items()}
    return [(f, rate[h], rate[h] > quality_rules.MAX_HOST_RATE, not f and rate[h] <= quality_rules.MAX_HOST_RATE) for (_, _, h), f in zip(rows, failed, strict=True)]


GOOD, BAD = " ".join(f"w{i}" for i in range(30)), "too short"
#: Hosts, their documents and the share that fails: where hosts differ much a host's own rate counts, where they are alike the prior does.
TWO_KINDS = {"bad": (200, 0.9), "worse": (50, 0.7), None: (40, 0.8), "one": (1, 1.0), **{f"good{i}": (60, 0.05) for i in range(12)}}
ONE_KIND = {"one": (1, 1.0), "two": (2, 1.0), "many": (400, 0.8), **{f"h{i}": (100, 0.3 + i % 3 / 50) for i in range(40)}}


@pytest.mark.parametrize("shares, fallen", [(TWO_KINDS, {"bad", "worse", None, "one"}), (ONE_KIND, {"many"})])
def test_bad_hosts_take_their_good_documents_along(spark, shares, fallen):
    rows = [(BAD if i < share * size else GOOD, host) for host, (size, share) in shares.items() for i in range(size)]
    random.Random(3).shuffle(rows)
    rows = [(i, *r) for i, r in enumerate(rows)]
    want = dict(zip((r[0] for r in rows), rules(rows), strict=True))
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(out) == len(rows)
    for r in out:
        x, (failed, rate, host_failed, kept) = r["__rules"], want[r.doc_id]
        assert (x.base_failed, x.host_failed, x.kept) == (failed, host_failed, kept) and abs(x.host_rate - rate) < 1e-9
    assert {r.source for r in out if r["__rules"].host_failed} == fallen
    # a good document of a bad host goes
    assert any(r.source in fallen and not r["__rules"].base_failed and not r["__rules"].kept for r in out)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d, p = quality_classifier.N_FEATURES, 20_000
    model = quality_classifier.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, p)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, p), np.zeros(p), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(40, d))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_isotonic_equals_the_greatest_of_least_means():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = rng.integers(0, 6, 25).astype(float)
        pos = np.minimum(n, rng.integers(0, 6, 25)).astype(float)
        some = np.flatnonzero(n)
        levels = [max(min(pos[some[a : b + 1]].sum() / n[some[a : b + 1]].sum() for b in range(i, len(some))) for a in range(i + 1)) for i in range(len(some))]
        knots, got = quality_classifier.isotonic(np.arange(25.0), pos, n)
        pools = sorted(set(np.round(levels, 12)))
        sums = [(pos[some[np.isclose(levels, v)]].sum(), n[some[np.isclose(levels, v)]].sum()) for v in pools]
        assert np.allclose(got, [(p + 0.01) / (m + 0.02) for p, m in sums])
        assert np.allclose(knots, [np.average(some[np.isclose(levels, v)], weights=n[some[np.isclose(levels, v)]]) for v in pools])


def test_classifier_equals_plain_numpy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    quality = {r.doc_id: float(r.quality) for r in labels.collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    ids = np.array([i for i, _ in rows])
    x = np.stack([quality_classifier.statistics(t) for _, t in rows])
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in ids])
    train = np.array([i in quality for i in ids.tolist()]) & (fold != 2)
    y = np.array([quality.get(i, 0.0) for i in ids.tolist()])[train]
    mean, scale = x[train].mean(0), x[train].std(0)
    scale[scale < 1e-5] = 1
    d, c = quality_classifier.N_FEATURES, quality_classifier.N_COMPONENTS
    rng = np.random.default_rng(0)
    directions, phases = rng.normal(size=(d, c)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, c)
    z = np.concatenate([np.sqrt(2 / c) * np.cos(np.clip((x - mean) / scale, -6, 6) @ directions + phases), np.ones((len(x), 1))], axis=1)

    def ridge(rows_, target):
        # the penalty as rows of its own, by least squares rather than by normal equations
        weight = np.sqrt(quality_classifier.RIDGE * max(1.0, len(rows_)) / c * np.r_[np.ones(c), 1e-6])
        return np.linalg.lstsq(np.concatenate([rows_, np.diag(weight)]), np.r_[target, np.zeros(c + 1)], rcond=None)[0]

    own = z[train]
    raw = np.zeros(len(own))
    for k in (0, 1, 3):
        raw[fold[train] == k] = own[fold[train] == k] @ ridge(own[fold[train] != k], y[fold[train] != k])
    at = np.clip(((raw + 0.5) / 2 * quality_classifier.BINS).astype(int), 0, quality_classifier.BINS - 1)
    size = quality_classifier.BINS
    n = np.bincount(at, minlength=size)
    knots, levels = quality_classifier.isotonic(np.bincount(at, raw, size) / np.maximum(1, n), np.bincount(at, y, size), n)
    want = np.interp(z @ ridge(own, y), knots, levels)
    assert np.abs(np.array([got[i].score for i in ids.tolist()]) - want).max() < 1e-3
    assert all(got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == (k == 2) for i, k in zip(ids.tolist(), fold.tolist(), strict=True))
    # more components come nearer to the ridge of the exact kernel
    s = np.clip((x - mean) / scale, -6, 6)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(-1) / (2 * d)) + 1.0
    exact = kernel[:, train] @ np.linalg.solve(kernel[np.ix_(train, train)] + quality_classifier.RIDGE * train.sum() / c * np.eye(train.sum()), y)
    assert np.corrcoef(exact, z @ ridge(own, y))[0, 1] > 0.97


def test_rendezvous_owners(spark):
    weights = [1.0, 2.0, 0.5, 1.0, 3.0]
    rows = [(i, f"t{i}") for i in range(500)] + [(2**62 + 7, None), (-5, ""), (3, "again")]

    def owner(key, own):
        unit = [((hashed(key, (k,)) & (2**64 - 1)) >> 11) + 0.5 for k in range(len(own))]
        return max((w / -math.log(u / 2**53), k) for k, (w, u) in enumerate(zip(own, unit, strict=True)))[1]

    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.shard, r.grown_shard) == (owner(r.doc_id, weights), owner(r.doc_id, [*weights, 1.0]))
    default = {r.doc_id: r.shard for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(s == owner(i, [1.0] * 40) for i, s in default.items())


def word_rows(rows, block=mixing.BLOCK_WORDS):
    """What the mixing stage makes of `rows`: (doc_id, words) for each time a row's words are taken."""
    taken = []
    _, _, times = mixed(rows, block, mixing.N_OUTPUT_SHARDS, with_times=True)
    for k, (i, t, _) in enumerate(rows):
        words = WORD.findall(t or "")
        for copy in range(1, mixing.MAX_EPOCHS + 1):
            own = [w for w, n in zip(words, times[k], strict=True) if n >= copy]
            if own:
                taken.append((i, own))
    return sorted(taken)


def test_pipeline_stages_equal_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    as_rows = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())

    step = common.materialize(stages["quality_rules"](spark, docs, SF), "t1")
    want = [r for r, (_, _, _, kept) in zip(rows, rules(rows), strict=True) if kept]
    assert as_rows(step) == want and step.columns == columns

    texts = {i: (n, kept) for i, _, n, kept in deduped(want)}
    want = [(i, t if not texts[i][0] else texts[i][1], s) for i, t, s in want if not texts[i][0] or WORD.search(texts[i][1])]
    step = common.materialize(stages["line_dedup"](spark, step, SF), "t2")
    assert as_rows(step) == want and step.columns == columns
    assert step.where(F.col("n_chars") != F.length("text")).count() == 0

    sets = [shingles(t) for _, t, _ in want]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = [r for k, (r, p) in enumerate(zip(want, components(len(sets), links), strict=True)) if p == k]
    step = common.materialize(stages["jaccard_join"](spark, step, SF), "t3")
    assert as_rows(step) == want and step.columns == columns

    step = common.materialize(stages["mixing"](spark, step, SF), "t4")
    got = step.collect()
    assert sorted((r.doc_id, WORD.findall(r.text)) for r in got) == word_rows(want) and step.columns == columns
    first = {i: t for i, t, _ in want}
    whole = [r for r in got if len(WORD.findall(r.text)) == len(WORD.findall(first[r.doc_id]))]
    assert whole and all(r.text == first[r.doc_id] for r in whole) and all(r.n_chars == len(r.text) for r in got)

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = []
    for r in got:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        pieces += [(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    out = stages["packing"](spark, step, SF).toPandas()
    assert sorted(map(tuple, out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].to_numpy().tolist())) == sorted(pieces)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_reserved_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1)], "doc_id long, text string, source string, __x int")
    from plumbline.llm import jaccard_join, line_dedup

    for operator in (quality_rules.quality_rules, line_dedup.dedup_lines, jaccard_join.keep_one, mixing.mixed_documents):
        with pytest.raises(ValueError, match="reserved"):
            operator(docs)
