"""Operator 8: near-duplicate vectors by randomised-rotation binary codes with error bounds and exact rechecks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

THRESHOLD = 0.95
#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 2e-4
#: Vectors that a bucket of unrelated rows holds on average.
BUCKET_ROWS = 256
#: Lengths of the codes that a plan chooses from, in bits.
CODE_BITS = (256, 512, 1024)
#: Bytes of a dealt row besides its code.
ROW_BYTES = 32
#: Standard deviations of the estimate that its upper confidence bound adds.
CONFIDENCE = 5.0
#: Vectors a task compares at once; larger buckets are cut into chunks that meet in pairs.
CHUNK_ROWS = 4096


def _ways(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _miss(bits: int, tables: int, code_bits: int, flip: float) -> float:
    """Chance that two codes whose bits differ with chance `flip` each agree in no table of `bits` sampled places."""
    out = 0.0
    for h in range(code_bits + 1):
        weight = math.exp(_ways(code_bits, h) + h * math.log(flip) + (code_bits - h) * math.log1p(-flip))
        agree = math.exp(_ways(code_bits - h, bits) - _ways(code_bits, bits)) if code_bits - h >= bits else 0.0
        out += weight * (1 - agree) ** tables
    return out


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(bits of a bucket key, tables, bits of a code): key bits grow with log n so that buckets stay small, tables so that
    the chance to miss stays; the code is as long as makes the dealt bytes fewest."""
    bits = max(4, min(40, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    flip = math.acos(threshold) / math.pi
    best = None
    for code_bits in CODE_BITS:
        low, high = 1, 1 << 16
        while low < high:
            half = (low + high) // 2
            low, high = (low, half) if _miss(bits, half, code_bits, flip) <= miss else (half + 1, high)
        cost = low * (code_bits // 8 + ROW_BYTES)
        best = min(best or (cost, low, code_bits), (cost, low, code_bits))
    return bits, best[1], best[2]


def rotation(dim: int, code_bits: int, seed: int) -> np.ndarray:
    """dim x code_bits: as many random orthogonal matrices side by side as the code needs."""
    rng = np.random.default_rng([seed, dim])
    parts = []
    while sum(x.shape[1] for x in parts) < code_bits:
        q, r = np.linalg.qr(rng.normal(size=(dim, min(dim, code_bits))))
        parts.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.concatenate(parts, axis=1)[:, :code_bits]


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, factor) of unit vectors: the signs of the rotated coordinates, packed into 64-bit words, and the correction.

    The factor is the mean of all absolute coordinates of random unit vectors over the vector's own: a vector whose
    coordinates lie near zero changes signs more easily, and its estimates are raised for that.
    """
    dim, code_bits = turn.shape
    turned = unit @ turn
    words = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
    mean = math.exp(math.lgamma(dim / 2) - math.lgamma((dim + 1) / 2)) / math.sqrt(math.pi)
    return words, (mean / np.maximum(np.abs(turned).mean(1), 1e-9)).astype("f4")


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of differing bits of all rows of words `a` with all of `b`."""
    out = np.zeros((len(a), len(b)), "u2")
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def estimates(a: np.ndarray, factor_a: np.ndarray, b: np.ndarray, factor_b: np.ndarray, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, upper bound) of the inner products of the vectors with codes `a` with those with codes `b`.

    Signs of a rotated pair differ with chance angle / pi, so pi / 2 times the share of agreeing over differing signs,
    times both factors, estimates arcsin of the inner product; its sine, raised by exp(variance / 2), is unbiased to first
    order. The bound adds `confidence` standard deviations.
    """
    n = 64 * a.shape[1]
    differ = differing_bits(a, b) / n
    arc = np.pi / 2 * (1 - 2 * differ) * factor_a[:, None] * factor_b[None, :]
    p = np.clip(differ, 0.05, 0.5)
    sigma = np.pi * np.sqrt(p * (1 - p) / n)
    return np.sin(np.clip(arc, -np.pi / 2, np.pi / 2)) * np.exp(sigma**2 / 2), np.sin(np.clip(arc + confidence * sigma, -np.pi / 2, np.pi / 2))


def least_arc(threshold: float, code_bits: int, confidence: float = CONFIDENCE) -> float:
    """The least estimated arcsine at which an inner product may be `threshold` or more: that of the threshold less
    `confidence` standard deviations, which are no greater for any pair above the threshold."""
    p = math.acos(threshold) / math.pi
    return math.asin(threshold) - confidence * math.pi * math.sqrt(p * (1 - p) / code_bits)


def table_masks(bits: int, tables: int, code_bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, masks): the code's bits that each table's key is made of, as numbers and as words."""
    rng = np.random.default_rng([seed, code_bits, bits])
    places = np.array([rng.choice(code_bits, bits, replace=False) for _ in range(tables)])
    masks = np.zeros((tables, code_bits // 64), "u8")
    for t, own in enumerate(places):
        np.bitwise_or.at(masks[t], own // 64, np.left_shift(np.uint64(1), (own % 64).astype("u8")))
    return places, masks


def _candidates(words: np.ndarray, factor: np.ndarray, chunk: np.ndarray | None, earlier: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of a bucket whose bound reaches the threshold and that share no earlier table; with `chunk`, only
    pairs of different chunks. In blocks of 512 rows."""
    share = least / (np.pi / 2) * 64 * words.shape[1]
    for first in range(0, len(words), 512):
        part = slice(first, first + 512)
        agree = 64 * words.shape[1] - 2 * differing_bits(words[part], words[first:]).astype("i4")
        a, b = np.nonzero(agree * factor[part, None] * factor[None, first:] >= share)
        a, b = a + first, b + first
        keep = a < b
        if chunk is not None:
            keep &= chunk[a] != chunk[b]
        a, b = a[keep], b[keep]
        for mask in earlier:  # most pairs that share an early table go at once
            if not len(a):
                break
            fresh = ((words[a] ^ words[b]) & mask).any(1)
            a, b = a[fresh], b[fresh]
        yield a, b


def _spanning(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Joins the pairs in the forest `parent`; those that joined two trees."""
    edges = []
    for first in range(0, len(a), 4096):
        x, y = a[first : first + 4096], b[first : first + 4096]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[x] != parent[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            ri, rj = i, j
            while parent[ri] != ri:
                ri = parent[ri]
            while parent[rj] != rj:
                rj = parent[rj]
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                edges.append((i, j))
    return parent, edges


def _buckets(table: pa.Table) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
    """(rows, table number, chunks or None) of each bucket, or pair of chunks of one, in a group of rows."""
    chunk = table.column("c").to_numpy()
    place = np.rec.fromarrays([table.column(c).to_numpy() for c in ("t", "key", "lo", "hi")])
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.flatnonzero(place[order][1:] != place[order][:-1]) + 1):
        if len(at) > 1:
            t, _, low, high = place[at[0]]
            # pairs inside a chunk count where it meets itself
            yield at, int(t), None if low == high else chunk[at]


def _read_codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, :-4]).view("<u8"), np.ascontiguousarray(raw[:, -4:]).view("<f4")[:, 0]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in column:
        v = x.as_py()
        v = None if v is None or None in v or not v else np.asarray(v, "f8")
        out.append(v if v is not None and np.isfinite(v).all() and v.any() else None)
    return out


def _digested(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, digest (null if the vector links with nothing), dim and vector (its numbers' bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [None if x is None else (x + 0.0).astype(kind).tobytes() for x in _vectors(batch.column(1))]
            digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in v]
            width = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([0 if x is None else len(x) // width for x in v], pa.int32()), pa.array(v, pa.binary())], ["vec_id", "digest", "dim", "vector"])

    return vectors.mapInArrow(run, "vec_id long, digest binary, dim int, vector binary")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of `embeddings` (vec_id, embedding).

    Equal vectors form one class, and only classes are compared. Each class's sign code of a random rotation and its
    correction factor are stored once; bucket keys are sampled bits of the code, so a dealt row is a key, a class and its
    code. In a bucket the codes give estimates and confidence bounds of all cosines. Classes with a pair whose bound
    reaches the threshold, and only they, fetch their vectors, and those pairs are recomputed in double precision. A pair
    counts in the first table that it shares, which its codes tell. Buckets above CHUNK_ROWS are cut into chunks that meet
    pairwise in tasks of their own. A task returns sums of links and a spanning forest, never its pairs. The chance to
    miss a pair at the very threshold is MISS, and less above it.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component;
    vectors of another length never link; null ids are kept and their component is the smallest id that is not null;
    repeated rows link with one another; an empty table gives an empty one; other columns are not read.
    """
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    rows = materialize(_digested(slim, kind), "vectors")
    classes = rows.where("digest is not null").groupBy("digest", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes.select("*", F.xxhash64("digest").alias("class_id")), "vector-classes")
    n = classes.count()
    bits, tables, code_bits = plan_tables(n, threshold)
    places, masks = table_masks(bits, tables, code_bits, seed)
    least = least_arc(threshold, code_bits)

    def units(vectors: list[bytes], dim: int) -> np.ndarray:
        unit = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype("f8")
        unit = unit / np.abs(unit).max(1, keepdims=True)
        return unit / np.sqrt((unit * unit).sum(1, keepdims=True))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = rotation(dim, code_bits, seed)
                words, factor = codes(units(part.column("vector").to_pylist(), dim), turns[dim])
                raw = np.concatenate([words.view("u1"), factor.astype("<f4")[:, None].view("u1")], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("dim"), pa.array([x.tobytes() for x in raw], pa.binary())], ["class_id", "dim", "code"])

    coded = materialize(classes.where(F.lit(n > 1)).select("class_id", "dim", "vector").mapInArrow(encode, "class_id long, dim int, code binary"), "vector-codes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a class and table: its bucket and its code."""
        powers = np.left_shift(np.uint64(1), np.arange(bits, dtype="u8"))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, _ = _read_codes(pa.chunked_array([batch.column("code")]))
            signs = np.unpackbits(words.view("u1"), axis=1, bitorder="little")
            # other lengths meet nowhere: a key is at most 40 bits
            dims = batch.column("dim").to_numpy().astype("u8") << np.uint64(40)
            for t in range(tables):
                key = (signs[:, places[t]] * powers).sum(1, dtype="u8") | dims
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), t, "i4")), pa.array(key.view("i8")), batch.column("class_id"), batch.column("code")], ["t", "key", "class_id", "code"])

    dealt = coded.mapInArrow(deal, "t int, key long, class_id long, code binary")
    large = materialize(dealt.groupBy("t", "key").count().where(F.col("count") > CHUNK_ROWS), "large-buckets")
    large = large.select("t", "key", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("n_chunks"))
    shared = dealt.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("n_chunks", F.lit(1))).withColumn("c", F.pmod("class_id", F.col("chunks")).cast("int"))
    shared = shared.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o"))
    # Small buckets share a task's group; a pair of chunks is a group of its own.
    alone = F.xxhash64("t", "key", "lo", "hi")
    bins = max(1, -(-n * tables // 32_768))
    shared = shared.withColumn("g", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("t", "key"), F.lit(bins))).otherwise(alone))
    spot = "t int, key long, class_id long, c int, lo int, hi int"

    def screen(table: pa.Table) -> pa.Table:
        words, factor = _read_codes(table.column("code"))
        some = []
        for at, t, chunk in _buckets(table):
            for a, b in _candidates(words[at], factor[at], chunk, masks[:t], least):
                some += [at[a], at[b]]
        rows_ = np.unique(np.concatenate(some)) if some else np.zeros(0, "i8")
        return table.select(["t", "key", "class_id", "c", "lo", "hi"]).take(pa.array(rows_))

    maybe = materialize(shared.select("g", "t", "key", "class_id", "code", "c", "lo", "hi").groupBy("g").applyInArrow(screen, spot), "vector-maybe")
    fetched = maybe.join(classes.select("class_id", "weight", "dim", "vector"), "class_id").join(coded.select("class_id", "code"), "class_id")
    # A group holds about 4,096 whole vectors, or one bucket; the parts of a hot bucket are groups of their own.
    bins = max(1, -(-maybe.count() // 4_096))
    fetched = fetched.withColumn("g", F.when(F.col("lo") + F.col("hi") == 0, F.pmod(F.xxhash64("t", "key"), F.lit(bins))).otherwise(alone))

    def compare(table: pa.Table) -> pa.Table:
        names, weight, dims = (table.column(c).to_numpy() for c in ("class_id", "weight", "dim"))
        words, factor = _read_codes(table.column("code"))
        vectors = table.column("vector").to_pylist()
        ids, sums, ends = [], [], []
        for at, t, chunk in _buckets(table):
            unit = units([vectors[i] for i in at], int(dims[at[0]]))
            links, parent = np.zeros(len(at)), np.arange(len(at))
            for a, b in _candidates(words[at], factor[at], chunk, masks[:t], least):
                for first in range(0, len(a), 65_536):
                    x, y = a[first : first + 65_536], b[first : first + 65_536]
                    sure = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[sure], y[sure]
                    links += np.bincount(x, weight[at[y]], len(at)) + np.bincount(y, weight[at[x]], len(at))
                    parent, edges = _spanning(parent, x, y)
                    ends += [(names[at[i]], names[at[j]]) for i, j in edges]
            some = np.flatnonzero(links)
            ids.append(names[at[some]])
            sums.append(links[some].astype("i8"))
        ids, sums = (np.concatenate([*x, np.zeros(0, "i8")]) for x in (ids, sums))
        a, b = (np.array([e[k] for e in ends], "i8") for k in (0, 1))
        other = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b)])
        return pa.table({"class_id": pa.array(np.r_[ids, a]), "links": pa.array(np.r_[sums, np.zeros(len(a), "i8")]), "other": other})

    found = fetched.groupBy("g").applyInArrow(compare, "class_id long, links long, other long")
    found = materialize(found, "vector-links")
    sums = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b")))
    full = classes.drop("vector").join(sums, "class_id", "left").join(parts, classes.class_id == parts.node, "left")
    full = full.select("digest", "first", F.coalesce("component", "class_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    full = materialize(full, "vector-full")
    least_ids = full.groupBy("component").agg(F.min("first").alias("least"))
    by_digest = full.join(least_ids, "component").select(F.col("digest").alias("__digest"), "links", "least")
    out = rows.join(by_digest, rows.digest == by_digest["__digest"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
