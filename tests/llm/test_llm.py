"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, embed_dedup, html_extract, jaccard_join, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, queries, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, shard int, offset long, label int"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one two", "One TWO", "a b c d e f a b c d e f a b c d e", BASE, BASE, BASE + " x", BASE.upper(), BASE.replace("w30 ", "v30 "),
    BASE.replace("w10 ", "v ").replace("w20 ", "v ").replace("w40 ", "v "), "line\nsame\nline\n same \nSAME", "É é ß 😀 a@b.co, +1 (22) 333-4444 10.0.0.256 10.0.0.255",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 x@y z@w.org.", "word " * 3000, "\n" * 50, "common\nunique 7\ncommon", "<|endoftext|> token = \"abcdef123456\" IBAN DE89370400440532013000",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None, None, i, i % 2, 7, 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"common\nsame {i}\nshared LINE", "en", "s0", 0, True, 1, 1, 1, 1) for i in range(11)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None), rows[6], rows[6]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def metrics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(hit)


def test_quality_rules(docs, rows, empty):
    out = quality_rules.quality_rules(docs)
    assert out.columns == [*docs.columns, "__rules"]
    got = sorted([(r.doc_id if r.doc_id is not None else -1, *[r.__getitem__("__rules")[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in out.collect()])
    want = sorted([(i if i is not None else -1, *(m := metrics(t)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t, _ in rows])
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_pii_equals_regex(docs, rows, empty):
    email, card = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    ip, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def base(t):
        spans = [("email", m.span()) for m in email.finditer(t)]
        spans += [("ip", m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        spans += [("card", m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return spans + [("phone", m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]

    found = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()
    for (t,) in [*found, *[(t,) for _, t, _ in rows], ("a@b.c@d.e a..b@-.- +1 2 3 4 5 6 7 8 9 1.2.3.4.5 00000255.1.1.1",)]:
        assert pii.render(pii.find_spans(t), pii.BASE_KINDS) == ",".join(f"{k}:{a}:{b}" for k, (a, b) in base(t or ""))
    assert pii.find_pii(docs, with_text=True).count() == len(rows) and pii.find_pii(empty).count() == 0
    spans = pii.find_spans(TEXTS[-1])
    assert len(spans["secret"]) == len(spans["account"]) == 1
    assert pii.redact(TEXTS[-1], spans) == "<|endoftext|> token = \"[secret]\" IBAN [account]"


def deduped(all_rows, least=10):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    lines = [(i, (t or "").split("\n")) for i, t, _ in all_rows]
    refs = {}
    for _, x in lines:
        for k in {key(y) for y in x} - {""}:
            refs[k] = refs.get(k, 0) + 1
    return sorted((i if i is not None else -1, len(x), sum(refs.get(key(y), 0) >= least for y in x), "\n".join(y for y in x if refs.get(key(y), 0) < least)) for i, x in lines)


@pytest.mark.parametrize("bound", [line_dedup.FILTER_BROADCAST_BYTES, 0])
def test_line_dedup(docs, rows, empty, bound):
    out = line_dedup.dedup_lines(docs, filter_broadcast_bytes=bound)
    assert out.columns == [*docs.columns, "__lines"]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["__lines"].n_lines, r["__lines"].n_dropped, r["__lines"].kept_text) for r in out.collect()) == deduped(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(docs):
    first, second = docs.where("doc_id < 105"), docs.where("doc_id >= 105")
    state = lambda x: sorted((bytes(r.digest), r.refs) for r in x.refs.collect())
    whole = line_dedup.LineIndex.build(docs.where("doc_id is not null"), 3, n_shards=2)
    start = line_dedup.LineIndex.build(first, 3, n_shards=2)
    grown = start.insert(second)
    assert state(grown) == state(whole)
    back = grown.delete(second)
    assert state(back) == state(start)
    drops = lambda x: sorted((r.doc_id, sorted(r.lines)) for r in x.dropped_lines(first).collect())
    assert drops(back) == drops(start)
    for unknown in (second, first.where("doc_id = 100").withColumn("text", F.lit("common"))):
        with pytest.raises(ValueError, match="not in the index"):
            start.delete(unknown)


def test_filters_screen_lines_in_their_shards(docs, rows):
    index = line_dedup.LineIndex.build(docs, 3, n_shards=4)
    maybe = index.maybe_lines(docs).collect()
    keys = sum(len({*line_dedup.line_digests(t)} - {None}) for _, t, _ in rows)
    hot = {bytes(r.digest) for r in index.hot().collect()}
    assert hot <= {bytes(r.digest) for r in maybe} and len({bytes(r.digest) for r in maybe} - hot) <= 2 and len(maybe) < keys
    assert all(bytes(r.digest) in hot for r in maybe if r.sure)


def test_lines_that_only_pass_the_filters_stay(spark, docs, rows):
    index = line_dedup.LineIndex.build(docs)
    (cells,) = [bytes(r.cells) for r in index.filters.collect()]
    tried = [f"z{i}" for i in range(400_000)]
    passed = line_dedup.CuckooFilter.from_bytes(cells).contains(*line_dedup._halves([line_dedup.line_digests(x)[0] for x in tried]))
    false = [x for x, p in zip(tried, passed, strict=True) if p]
    assert 0 < len(false) < 100
    more = [(1000 + i, f"first\n{x}\ncommon", "s") for i, x in enumerate(false)]
    grown = docs.select("doc_id", "text", "source").unionAll(spark.createDataFrame(more, "doc_id long, text string, source string"))
    for bound in (line_dedup.FILTER_BROADCAST_BYTES, 0):
        out = line_dedup.dedup_lines(grown, filter_broadcast_bytes=bound)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r["__lines"].n_lines, r["__lines"].n_dropped, r["__lines"].kept_text) for r in out.collect()) == deduped([*rows, *more])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 2**63, (2, 4000), dtype="u8")
    f = line_dedup.CuckooFilter(4000)
    assert f.insert(high, low) and f.contains(high, low).all()
    assert f.contains(*rng.integers(0, 2**63, (2, 20_000), dtype="u8")).mean() < 1e-3
    f.delete(high[:2000], low[:2000])
    assert f.contains(high[2000:], low[2000:]).all() and f.contains(high[:2000], low[:2000]).mean() < 1e-2
    assert not line_dedup.CuckooFilter.from_bytes(f.to_bytes()).contains(high[:5], low[:5]).all()


def test_classifier(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_classifier.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    p = scored.join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(p.doc_id, p.held_out, strict=True))
    held = p[p.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and p.score.between(0, 1).all()
    own = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality_classifier.classify(docs, own).count() == docs.count()
    assert quality_classifier.classify(docs, own.where("doc_id < -1")).where("score = 0.5").count() == docs.count()
    assert quality_classifier.classify(empty, own).count() == 0


def test_packing(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    out = packing.pack_documents(docs).toPandas()
    want = sorted((-1 if i is None else i, s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)) for i, t, _ in rows for x in [ids(t)] for s in range(0, len(x), 2048))
    assert sorted((-1 if d != d else int(d), *r) for d, *r in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)) == want
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.pack_documents(empty).count() == 0
    whole = packing.sequences(docs.where("doc_id < 12")).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(ids(t)) for i, t, _ in rows if i is not None and i < 12)


def test_first_fit_decreasing_equals_scan():
    lengths = np.random.default_rng(3).integers(1, 100, 400)
    used, offset = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert all((used[i], offset[i]) == want[i] for i in range(400))


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, block_words=7)["documents"].toPandas()
    again = mixing.mix(docs.repartition(5), block_words=7)["documents"].toPandas()
    key = list(out.columns)
    assert out.fillna(-1).sort_values(key).values.tolist() == again.fillna(-1).sort_values(key).values.tolist()
    assert sorted(out["size"]) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows) and (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.target - by.taken).abs() <= 14).all() and abs(by.target.sum() - 1.5 * out["size"].sum()) < 1e-6
    assert mixing.mix(empty)["documents"].count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    once = docs.dropDuplicates(["doc_id", "text"])  # repeated rows share their takings
    words = [len(WORD.findall(r.text)) for r in mixing.mixed_documents(once).collect()]
    default = mixing.mix(once)["documents"].agg(F.sum("taken")).first()[0]
    assert min(words) > 0 and sum(words) == default


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).toPandas()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)
    assert ((out.grown_shard == out.shard) | (out.grown_shard == 40)).all()
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(out["size"], out.text_crc32, strict=True)) == want
    assert sharding.shard_documents(empty).count() == 0
    share = docs.sparkSession.range(4000).select(sharding.rendezvous_shard(F.col("id"), [1, 3]).alias("s")).agg(F.avg("s")).first()[0]
    assert 0.7 < share < 0.8


def components(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [embed_dedup.CHUNK_ROWS, 40])
def test_embeddings(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(embed_dedup, "CHUNK_ROWS", chunk_rows)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(25, 32))
    v = np.concatenate([centres.repeat(12, 0) + rng.normal(size=(300, 32)) * 0.22, centres[:5].repeat(30, 0)]).astype("f4")
    unit = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    odd = [None, [0.0] * 32, [float("nan")] * 32, [1.0, None] + [0.0] * 30, [1.0] * 3, []]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, x) for i, x in enumerate(odd)] + [(None, v[0].tolist())]
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    copies = int((v == v[0]).all(1).sum())
    found = sum(out[i].n_links for i in range(len(v)))
    true = int(link.sum()) + sum(1 for i in range(len(v)) if link[i, 0] or i == 0)  # the row without an id is one more copy of the first
    assert copies == 1 and 0.995 * true <= found <= true
    parts = components(len(v), np.argwhere(link).tolist())
    assert np.mean([out[i].component_id == parts[i] for i in range(len(v))]) > 0.99
    assert all(out[1000 + i].n_links == 0 and out[1000 + i].component_id == 1000 + i for i in range(len(odd)))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (2, 8, 64, 300):
        x = rng.normal(size=(400, dim))
        x = np.concatenate([x, x + rng.normal(size=x.shape) * rng.choice([0.05, 0.2, 0.33, 0.6], (400, 1))])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        words, factor = embed_dedup.codes(x, embed_dedup.rotation(dim, 256, 0))
        assert words.shape == (800, 4)
        guess, bound = embed_dedup.estimates(words, factor, words, factor)
        exact, off = x @ x.T, ~np.eye(800, dtype=bool)
        assert (exact[off] <= bound[off] + 1e-9).mean() > 0.9999
        assert abs((guess - exact)[off].mean()) < 0.01 and abs((guess - exact)[off]).mean() < 0.1
        near = off & (exact >= 0.95)
        arc = np.pi / 2 * (1 - 2 * embed_dedup.differing_bits(words, words) / 256) * factor[:, None] * factor
        assert (arc[near] >= embed_dedup.least_arc(0.95, 256)).all()


def test_plan_of_tables_keeps_its_chance():
    for n in (1000, 50_000, 10**6, 10**9):
        bits, tables, code_bits = embed_dedup.plan_tables(n)
        flip = np.arccos(0.95) / np.pi
        assert embed_dedup._miss(bits, tables, code_bits, flip) <= embed_dedup.MISS < embed_dedup._miss(bits, tables - 1, code_bits, flip)
        assert n / 2**bits <= embed_dedup.BUCKET_ROWS
    rng = np.random.default_rng(0)
    places, masks = embed_dedup.table_masks(9, 30, 256, 0)
    words = rng.integers(0, 2**63, (50, 4), dtype="u8")
    words[25:] = words[:25] ^ (rng.integers(0, 2**63, (25, 4), dtype="u8") & rng.integers(0, 2**63, (25, 4), dtype="u8") & rng.integers(0, 2**63, (25, 4), dtype="u8"))
    bits = np.unpackbits(words.view("u1"), axis=1, bitorder="little")
    for t in range(30):
        same = (bits[:25, places[t]] == bits[25:, places[t]]).all(1)
        assert (same == ~((words[:25] ^ words[25:]) & masks[t]).any(1)).all()


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("limits", [(jaccard_join.SHARD_TOKENS, jaccard_join.CHUNK_TOKENS), (200, 150), (50, 60)])
def test_jaccard(docs, rows, empty, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "SHARD_TOKENS", limits[0])
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", limits[1])
    own = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    own.sort(key=lambda x: x[0])
    links = [(a, b) for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(own), 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    parts = components(len(own), links)
    want = sorted((i, len(s), own[p][0]) for (i, s), p in zip(own, parts, strict=True))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id is not None)
    assert got == want
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, c in want if i == c} | {None}


def test_links_reach_through_rows_without_an_id(spark):
    w = [f"w{i}" for i in range(64)]
    a, b, c = (" ".join(x) for x in (w, [*w[:58], *(f"y{i}" for i in range(6))], [f"z{i}" for i in range(6)] + w[6:58] + [f"y{i}" for i in range(6)]))
    near = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    assert near(a, b) >= 0.75 > near(a, c) and near(b, c) >= 0.75
    for ids, want in (((1, 2, 3), (1, 1, 1)), ((1, None, 3), (1, 1, 1)), ((None, None, 3), (3, 3, 3)), ((None,) * 3, (None,) * 3)):
        rows = [*zip(ids, (a, b, c), strict=True), (ids[1], b), (ids[1], b.upper()), (9, "nothing like it at all, not one bit")]
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.component_id for r in got if r.n_shingles > 10} == set(want) and len(got) == len(rows)


@pytest.mark.parametrize("n_shards", [10, 1000])
def test_dealt_bytes_follow_the_shingles(docs, n_shards):
    many = docs.sparkSession.range(3000, numPartitions=2).select(F.expr("array_join(transform(sequence(1, 40), i -> concat('v', hash(id, i) % 5000)), ' ')").alias("text"))
    dealt = jaccard_join._deal_tokens(many, n_shards)
    total = dealt.agg(F.sum(F.octet_length("tokens")) / 4, F.sum(F.octet_length("owners"))).first()
    assert total[0] == sum(len(shingles(r.text)) for r in many.collect()) and total[1] <= 2 * total[0]
    owner = np.sort(np.random.default_rng(n_shards).integers(0, 70_000, 500))
    for x in (owner, owner[:0], np.repeat(owner[:3], 700)):
        for n_docs in (int(x.max(initial=0)) + 1, 200_000):
            assert (jaccard_join._owners(jaccard_join._packed_owners(x, n_docs)) == x).all()


def test_dealt_rows_follow_the_corpus():
    """Rows are parts by shards: in proportion to the shingles from GROWS_FROM on, for as long as the sizes may grow."""
    assert jaccard_join.deal_sizes(0) == jaccard_join.deal_sizes(10**8) == (jaccard_join.SHARD_TOKENS, jaccard_join.PART_TOKENS)
    held = [n / ((n / shard) * (n / part)) for n in (4 * 10**9, 10**10, 3 * 10**10, 6 * 10**10) for shard, part in (jaccard_join.deal_sizes(n),)]
    assert max(held) - min(held) < 1 and min(held) > 1_000
    assert jaccard_join.deal_sizes(10**14) == (4 * jaccard_join.SHARD_TOKENS, 4 * jaccard_join.PART_TOKENS)


@pytest.mark.parametrize("sent", [1, 100, 250_000])
def test_batches_of_the_deal_hold_all_its_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard_join, "SENT_TOKENS", sent)
    texts = spark.range(40, numPartitions=1).select(F.expr("array_join(transform(sequence(1, 30), i -> concat('v', hash(id, i) % 900)), ' ')").alias("text"))
    # parts are cut where batches of texts end
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = jaccard_join._deal_tokens(texts, 7, 300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(h for r in texts.collect() for h in jaccard_join.shingle_sets([r.text])[0].tolist())
    assert len({r.part for r in rows}) > 2 and len({(r.part, r.shard) for r in rows}) == len(rows)
    assert sorted(int(x) for r in rows for x in np.frombuffer(r.tokens, "<u4")) == sorted(h & 0xFFFFFFFF for h in want)
    assert all(len(jaccard_join._owners(r.asDict())) * 4 == len(r.tokens) for r in rows)


def test_bands_keep_all_that_may_link():
    n = np.arange(1, 3000)
    most = n * 100 // jaccard_join.PERCENT
    assert (jaccard_join.size_band(most) - jaccard_join.size_band(n) <= 1).all()


def test_signature_tree_equals_all_pairs():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(5, 200), dtype="u8")
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) < rng.choice([0.85, 0.95, 1.0])]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, rng.integers(1, 12), dtype="u8")]))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert components(len(sets), jaccard_join.SignatureTree(sets).forest()) == components(len(sets), links)


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    text = " ".join(f"x{i % 50}" for i in range(3000))
    want = jaccard_join.shingle_sets([text, "a b", None])
    monkeypatch.setattr(jaccard_join, "SEGMENT", 64)
    got = jaccard_join.shingle_sets(["z", text, "A B", ""])
    assert (got[1] == want[0]).all() and (got[2] == want[1]).all() and len(got[3]) == len(want[2]) == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div id="cookie-notice">We use cookies, agree please, thank you very much indeed.</div><main><article><h1>Head</h1><p>First, a &amp; b,
    with enough  words to count as a paragraph.<p>Second &#233; <b>bold<br>more</b> text, also long enough to be counted.</article>
    <aside class=sidebar><p>Related, links, and more things that are long enough.</aside><section class="comments"><p>Nice article, thanks, I liked it very much.</section></main>
    <form><p>Subscribe, now, to our long newsletter about nothing.</form><script>var x="<p>no</p>";</script><footer>&copy; me</footer></body>"""
    assert html_extract.extract(page) == "Head First, a & b, with enough words to count as a paragraph. Second é bold more text, also long enough to be counted."
    assert html_extract.extract(None) == html_extract.extract("") == "" and html_extract.extract("<") == "<" and html_extract.extract("plain") == "plain"
    deep = "<div>" * 5000 + "<p>deep paragraph, with enough words to be counted</p>"
    assert html_extract.extract(deep) == "deep paragraph, with enough words to be counted"
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    for (h,) in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.S)[1]
        assert html_extract.extract(h) == re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*(>|$)", " ", body))).strip()


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()) == [("", 0), ("x", 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 50)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 50, 50: 50}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    canon = lambda columns, rows: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours.columns, ours.collect()) == canon(theirs.columns, theirs.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and 0 < after.count()
        assert name == "mixing" or after.count() <= docs.count()
        docs = after
    pieces = packing.pack_documents(docs)
    assert pieces.count() >= docs.count()
    sha = hashlib.sha256("".join(sorted(r.text for r in docs.collect())).encode()).hexdigest()
    assert len(sha) == 64
