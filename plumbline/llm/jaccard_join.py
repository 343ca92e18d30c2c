"""Operator 9: n-gram Jaccard join by signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, materialize, own_names

WORDS = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that a task counts at once.
SHARD_TOKENS = 3_000_000
#: Shingles that a task deals at once.
PART_TOKENS = 2_000_000
#: Shingles of a corpus from which on parts and shards grow with its square root, and how often they double in size at most.
GROWS_FROM = 4_000_000_000
MOST_DOUBLINGS = 2
#: Shingles that are sent to the JVM at once.
SENT_TOKENS = 250_000
#: Shingles of the documents that a task's signature trees hold; larger families are cut into chunks that meet in pairs.
CHUNK_TOKENS = 4_000_000
#: Classes whose sets are read again up to which their ids, 40 bytes each, are broadcast.
WANTED_ROWS = 500_000
FAN_OUT = 16
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 20

_rng = np.random.default_rng(20_240_101)
_BYTE = _rng.integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_PLACE = _rng.integers(1, 2**63, WORDS, dtype="u8") * np.uint64(2) + np.uint64(1)
_LENGTH = _rng.integers(1, 2**63, WORDS, dtype="u8")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for n places."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, SEGMENT + 1)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, "u8")], dtype="u8") for b in (_BASE % 2**64, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of `raw`. Equal words have equal hashes wherever they stand."""
    all_starts, all_hashes, at, n = [], [], 0, len(raw)
    data = np.frombuffer(raw, "u1")
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and not _SPACE[data[end]]:  # a word is never cut
            end += 1
        part = data[at:end]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view("i1")))
        starts, ends = edge[::2], edge[1::2]
        up, down = _power_tables(len(part))
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)], dtype="u8")]
        all_hashes.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8")))
        all_starts.append(starts + at)
        at = end
    return (np.concatenate(all_starts), np.concatenate(all_hashes)) if all_starts else (np.zeros(0, "i8"), np.zeros(0, "u8"))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes of its shingles of five words, A-Z lower-cased.

    A text of one to four words has one shingle, all its words; one without words, or null, has none.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
    starts, hashes = _word_hashes(b" ".join(raws))
    first = np.searchsorted(starts, offsets)
    out = []
    with np.errstate(over="ignore"):
        terms = [hashes * c for c in _PLACE]
        n = len(hashes)
        five = sum((terms[k][k : n - WORDS + 1 + k] for k in range(1, WORDS)), terms[0][: n - WORDS + 1]) if n >= WORDS else np.zeros(0, "u8")
        five = _mix(five)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(five[a : b - WORDS + 1]))
            elif b > a:
                own = sum((terms[k][a + k] for k in range(1, b - a)), terms[0][a])
                out.append(_mix(np.array([own + _LENGTH[b - a]], "u8")))
            else:
                out.append(np.zeros(0, "u8"))
    return out


def _stretches(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of `texts` of up to `most` code points, with the place of the first; a longer text alone. Only one is open at a time."""
    own: list[str | None] = []
    first = size = 0
    for i, x in enumerate(texts):
        text = x.as_py()
        if own and size + len(text or "") > most:
            yield first, own
            own, first, size = [], i, 0
        own.append(text)
        size += len(text or "")
    if own:
        yield first, own


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), n (size of the shingle set), digest of the set and ck, the digest's first 64 bits; one
    pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for _, texts in _stretches(batch.column(1)):
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    digests.append(_digest(s))
            ck = np.frombuffer(b"".join(digests), "<i8")[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(ck)], ["doc_id", "th", "n", "digest", "ck"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) th").mapInArrow(run, "doc_id long, th long, n long, digest binary, ck long")


def _packed_owners(owner: np.ndarray, n_docs: int) -> dict:
    """Which document each shingle is of (ascending numbers below n_docs): a count for each document, or the steps from owner
    to owner where that takes fewer bytes, so that a row's bytes follow its shingles, however many shards there are."""
    forms = []
    for x in (np.bincount(owner, minlength=n_docs), np.diff(owner, prepend=0)):
        most = x.max(initial=0)
        forms.append(x.astype("<u1" if most < 256 else "<u2" if most < 65_536 else "<u4"))
    steps = forms[1].nbytes < forms[0].nbytes
    own = forms[steps]
    return {"steps": bool(steps), "width": own.itemsize, "owners": own.tobytes()}


def _owners(row: dict) -> np.ndarray:
    x = np.frombuffer(row["owners"], f"<u{row['width']}").astype("i8")
    return np.cumsum(x) if row["steps"] else np.repeat(np.arange(len(x)), x)


def deal_sizes(total: int) -> tuple[int, int]:
    """Shingles of a shard and of a part of a corpus of `total` shingles.

    Each part sends a row to each shard, so with fixed sizes rows would grow with the square of the corpus. Where both grow
    with its root, rows grow with it and hold some 1,500 shingles each, up to 2^MOST_DOUBLINGS times SHARD_TOKENS and
    PART_TOKENS, which is what a task's memory bounds.
    """
    grown = min(2.0**MOST_DOUBLINGS, max(1.0, (total / GROWS_FROM) ** 0.5))
    return int(SHARD_TOKENS * grown), int(PART_TOKENS * grown)


def _deal_tokens(docs: DataFrame, n_shards: int, part_tokens: int = PART_TOKENS) -> DataFrame:
    """All shingles, packed: one row a shard and stretch of documents with 32 bits of each shingle and the documents they are of.

    Documents with equal sets inside a stretch of rows are dealt once. The row of shard 0 also names the documents.
    """

    def packed(sets: list[np.ndarray], cks: list[int], number: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in sets], "<u4")
        flat, docs_ = np.concatenate(sets), np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
        ck = np.array(cks, "<i8")
        # the same when a lost task runs again
        key = TaskContext.get().partitionId() << 32 | number
        shard = ((flat >> np.uint64(32)) % np.uint64(n_shards)).astype("u2" if n_shards < 65_536 else "u4")
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
        small, docs_ = flat.astype("<u4")[order], docs_[order]
        rows, first = [], 0
        # Only shards that get something, and the first, which names the documents, have rows.
        for k in np.flatnonzero((np.diff(cuts) > 0) | (np.arange(n_shards) == 0)).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            row = {"shard": k, "part": key, "cks": ck.tobytes() if not k else b"", "sizes": sizes.tobytes() if not k else b"", "n_docs": len(sizes), "tokens": small[a:b].tobytes()}
            rows.append(row | _packed_owners(docs_[a:b], len(sizes)))
            if b - first >= SENT_TOKENS:
                yield pa.RecordBatch.from_pylist(rows, schema=_DEALT)
                rows, first = [], b
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        cks: list[int] = []
        seen: set[bytes] = set()
        number = held = 0
        for batch in batches:
            for _, texts in _stretches(batch.column(0)):
                for s in shingle_sets(texts):
                    if len(s) and (d := _digest(s)) not in seen:
                        seen.add(d)
                        sets.append(s)
                        cks.append(int.from_bytes(d[:8], "little", signed=True))
                        held += len(s)
                if held >= part_tokens:
                    yield from packed(sets, cks, number)
                    sets, cks, seen, number, held = [], [], set(), number + 1, 0
        if sets:
            yield from packed(sets, cks, number)

    return docs.select("text").mapInArrow(run, _DEALT_TYPES)


_DEALT_TYPES = "shard int, part long, cks binary, sizes binary, n_docs long, steps boolean, width int, owners binary, tokens binary"
_DEALT = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("cks", pa.binary()), ("sizes", pa.binary()), ("n_docs", pa.int64()), ("steps", pa.bool_()), ("width", pa.int32()), ("owners", pa.binary()), ("tokens", pa.binary())])
_SHARED = pa.schema([*_DEALT, ("ranks", pa.binary())])


def _keep_shared(table: pa.Table) -> pa.Table:
    """Of one shard: the shingles that two or more dealt documents have, each with a rank that grows with their number."""
    rows = table.to_pylist()
    tokens = [np.frombuffer(r["tokens"], "<u4") for r in rows]
    _, inverse, df = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.minimum(255, np.log2(df) * 8).astype("u1")[inverse]
    shared = (df > 1)[inverse]
    out, at = [], 0
    for r, t in zip(rows, tokens, strict=True):
        own = shared[at : at + len(t)]
        out.append(r | _packed_owners(_owners(r)[own], r["n_docs"]) | {"tokens": t[own].tobytes(), "ranks": rank[at : at + len(t)][own].tobytes()})
        at += len(t)
    return pa.Table.from_pylist(out, schema=_SHARED)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Two sets that link have one of this many first shingles, in any common order, in common."""
    return n - (PERCENT * n + 99) // 100 + 1


def size_band(n: np.ndarray) -> np.ndarray:
    """Sets that link are of the same or of neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT) + 1e-9).astype("i8")


def _prefixes(table: pa.Table) -> pa.Table:
    """Of one stretch of documents: (ck, token, band) of the shared shingles in each document's prefix, the rarest first.

    Shingles that no other document has come first of all; a document with too many of them links with nothing. A row of
    band b is for partners of bands b and b + 1, so a document of band b has one of band b - 1. It has another of band b
    where its place in the prefix leaves room for a partner of band b + 1: two sets whose first common shingle is at place
    i of one of n shingles have at most n - i in common, so the other has at most (100 + P) / P * (n - i) - n.
    """
    rows = table.sort_by("shard").to_pylist()
    head = next((r for r in rows if r["shard"] == 0), None)
    ck, n = np.frombuffer(head["cks"], "<i8"), np.frombuffer(head["sizes"], "<u4").astype("i8")
    owner = np.concatenate([_owners(r) for r in rows])
    token = np.concatenate([np.frombuffer(r["tokens"], "<u4").astype("i8") + (r["shard"] << 32) for r in rows])
    rank = np.concatenate([np.frombuffer(r["ranks"], "u1") for r in rows])
    shared = np.bincount(owner, minlength=len(ck))
    take = np.maximum(0, prefix_length(n) - (n - shared))
    order = np.lexsort((token, rank, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(shared) - shared, shared)
    kept = place < np.repeat(take, shared)
    order, place = order[kept], place[kept]
    at = owner[order]
    band = size_band(n)[at]
    most = (100 + PERCENT) * (n[at] - (n - shared)[at] - place) // PERCENT - n[at]
    up = size_band(most) > band
    return pa.table({"ck": np.r_[ck[at], ck[at[up]]], "token": np.r_[token[order], token[order[up]]], "band": np.r_[band - 1, band[up]].astype("i4")})


class SignatureTree:
    """A tree over shingle sets: every node has the OR of its sets' bitmaps, their range of sizes and the greatest number
    of shingles that a set has beyond its bits (several may share a bit)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.array([len(s) for s in sets])
        bits = 1 << max(8, int(np.ceil(np.log2(2 * np.median(sizes)))))
        maps = np.zeros((len(sets), bits // 64), "u8")
        for i, s in enumerate(sets):
            where = (s % np.uint64(bits)).astype("i8")
            np.bitwise_or.at(maps[i], where // 64, np.left_shift(np.uint64(1), (where % 64).astype("u8")))
        excess = sizes - np.bitwise_count(maps).sum(1).astype("i8")
        #: by level, the leaves' members first: (bitmaps, least size, greatest size, excess)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, more = self.levels[-1]
            cuts = np.arange(0, len(low), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(m, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(more, cuts)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of nodes may hold a pair that links: their sizes allow it, and so does the greatest overlap that
        the bitmaps leave possible, popcount(A & B) and the lesser excess."""
        maps, low, high, more = self.levels[level]
        fits = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        a, b = a[fits], b[fits]
        most = np.bitwise_count(maps[a] & maps[b]).sum(1).astype("i8") + np.minimum(more[a], more[b])
        least = -(-PERCENT * (low[a] + low[b]) // (100 + PERCENT))
        fits[fits] = most >= least
        return fits

    def forest(self, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges (i, j) of links that span every component of the linked sets; with `groups`, of links across groups only.

        A traversal of the tree with itself keeps pairs of nodes that may link, nodes with themselves first. Pairs that
        are known to lie in one component are not compared again.
        """
        parent = list(range(len(self.sets)))
        edges = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        stack = [(len(self.levels) - 1, np.zeros(1, "i8"), np.zeros(1, "i8"))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                roots = np.array([find(x) for x in range(len(parent))]) if len(a) > 64 else None
                if roots is not None:
                    apart = roots[a] != roots[b]
                    a, b = a[apart], b[apart]
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    ri, rj = find(i), find(j)
                    if ri != rj:
                        x, y = self.sets[i], self.sets[j]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= PERCENT * (len(x) + len(y) - both):
                            parent[max(ri, rj)] = min(ri, rj)
                            edges.append((i, j))
                continue
            n = len(self.levels[level - 1][1])
            for first in range(0, len(a), 256):  # bounded memory: at most 256 pairs of nodes are opened at a time
                x, y = a[first : first + 256], b[first : first + 256]
                i = (x[:, None] * FAN_OUT + np.arange(FAN_OUT)).repeat(FAN_OUT, axis=1)
                j = np.tile(y[:, None] * FAN_OUT + np.arange(FAN_OUT), (1, FAN_OUT))
                keep = (i < n) & (j < n) & ((i <= j) if level > 1 else (i < j) if groups is None else (i < j) & (groups[np.minimum(i, n - 1)] != groups[np.minimum(j, n - 1)]))
                i, j = i[keep], j[keep]
                if level > 1:
                    same = i == j
                    may = same.copy()
                    may[~same] = self.may_link(level - 1, i[~same], j[~same])
                    i, j, same = i[may], j[may], same[may]
                    if (~same).any():
                        stack.append((level - 1, i[~same], j[~same]))
                    if same.any():
                        stack.append((level - 1, i[same], j[same]))
                else:
                    may = self.may_link(0, i, j)
                    if may.any():
                        stack.append((0, i[may], j[may]))
        return edges


def _join_families(table: pa.Table) -> pa.Table:
    """Of one bin of families (or pairs of chunks of one): edges of a spanning forest of its links."""
    label = table.column("label").to_numpy()
    ids, chunk = table.column("ck").to_numpy(), table.column("c").to_numpy()
    whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
    blobs = table.column("tokens").to_pylist()
    order = np.lexsort((ids, label))
    a, b = [], []
    for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        at = at[np.r_[True, np.diff(ids[at]) != 0]]  # copies without an id may come more than once
        if len(at) < 2:
            continue
        sets = [np.frombuffer(blobs[i], "<u8") for i in at]
        near = np.lexsort((ids[at], [s[0] for s in sets], np.log2([len(s) for s in sets]).astype(int)))
        at, sets = at[near], [sets[i] for i in near]
        for i, j in SignatureTree(sets).forest(None if whole[at[0]] else chunk[at]):
            a.append(ids[at[i]])
            b.append(ids[at[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """ck, label, n and tokens: the shingle sets of the classes `wanted` (rep, rep_th, label, ck), read again from the text of
    one of their documents."""
    wanted = bounded_broadcast(wanted.select("rep", "rep_th", "label", F.col("ck").alias("wanted")), n_wanted, WANTED_ROWS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    slim = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, wanted_cks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in _stretches(batch.column(1)):
                own: dict[int, tuple] = {}
                for i, s in enumerate(shingle_sets(texts), first):
                    if (ck := int.from_bytes(_digest(s)[:8], "little", signed=True)) == wanted_cks[i]:
                        own[ck] = (ck, labels[i], len(s), s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["ck", "label", "n", "tokens"])

    return slim.select("label", "text", "wanted").mapInArrow(run, "ck long, label long, n long, tokens binary")


def _dealt_families(found: DataFrame, members: DataFrame) -> DataFrame:
    """`found` sets with the group g in which they are compared, and c, lo and hi, their chunk and the two that meet there.

    Families within CHUNK_TOKENS share groups. A larger one is cut by size bands and these into chunks; a chunk meets itself,
    the others of its band and those of the bands next to it, each pair in a group of its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    masses = members.groupBy("label", band.alias("band")).agg(F.sum("n").alias("mass"))
    whole = masses.groupBy("label").agg(F.sum("mass").alias("whole")).where(F.col("whole") > CHUNK_TOKENS).select("label")
    cuts = materialize(masses.join(whole, "label").select(F.col("label").alias("large"), "band", F.ceil(F.col("mass") / CHUNK_TOKENS * 2).cast("int").alias("subs")), "family-bands")
    at = lambda step, name: cuts.select(F.col("large").alias(f"large_{name}"), (F.col("band") + step).alias(f"band_{name}"), F.col("subs").alias(name))
    found = found.withColumn("band", band).join(cuts.withColumnRenamed("band", "own_band"), (F.col("label") == F.col("large")) & (F.col("band") == F.col("own_band")), "left")
    for step, name in ((1, "below"), (-1, "above")):
        found = found.join(at(step, name), (F.col("large") == F.col(f"large_{name}")) & (F.col("band") == F.col(f"band_{name}")), "left")
    code = lambda b, s: b.cast("long") * (1 << 20) + s
    found = found.withColumn("c", F.when(F.col("large").isNull(), F.lit(0).cast("long")).otherwise(code(F.col("band"), F.pmod(F.xxhash64("ck"), F.col("subs")))))
    numbers = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    chunks = lambda n, b: F.transform(numbers(n), lambda o: code(b, o))
    near = F.concat(chunks(F.col("subs"), F.col("band")), chunks(F.col("below"), F.col("band") - 1), chunks(F.col("above"), F.col("band") + 1))
    met = F.when(F.col("large").isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)
    found = found.select("label", "ck", "n", "tokens", "large", "c", F.explode(met).alias("o"))
    found = found.select("label", "ck", "tokens", "large", "c", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(12, -(-total // (CHUNK_TOKENS // 4)))
    return found.select("label", "ck", "tokens", "c", "lo", "hi", F.when(F.col("large").isNull(), F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label", "lo", "hi")).alias("g"))


def _linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """document_sets() of `docs`, written, their classes of equal sets, and the classes that link with others with their `part`."""
    sets = materialize(document_sets(docs), "sets")
    some = sets.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th"))
    classes = some.groupBy("digest", "ck", "n").agg(first.alias("f")).select("digest", "ck", "n", F.col("f.doc_id").alias("rep"), F.col("f.th").alias("rep_th"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    shard_tokens, part_tokens = deal_sizes(total)
    dealt = _deal_tokens(docs, max(1, -(-total // shard_tokens)), part_tokens)
    shared = dealt.groupBy("shard").applyInArrow(_keep_shared, f"{_DEALT_TYPES}, ranks binary")
    prefixes = materialize(shared.groupBy("part").applyInArrow(_prefixes, "ck long, token long, band int"), "prefixes")
    ends = prefixes.groupBy("token", "band").agg(F.min("ck").alias("least"), F.max("ck").alias("most")).where("least <> most").select("token", "band", "least")
    near = prefixes.join(ends, ["token", "band"]).where("ck <> least").select(F.col("ck").alias("a"), F.col("least").alias("b"))
    families = connected_components(near)
    members = materialize(classes.join(families, classes.ck == families.node).select("digest", "ck", "n", "rep", "rep_th", F.col("component").alias("label")), "members")
    found = _dealt_families(_sets_of(docs, members, members.count()), members)
    edges = found.groupBy("g").applyInArrow(_join_families, "a long, b long")
    parts = connected_components(edges)
    return sets, classes, materialize(members.join(parts, members.ck == parts.node).select("digest", "rep", F.col("component").alias("part")), "linked")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of `docs`.

    1. Equal sets form a class; only classes are compared, so copies cost nothing more.
    2. All shingles are counted, packed by shard. Prefix filtering, the rarest first: of a document only the shared ones
       among its first n - ceil(0.75 n) + 1 shingles count, and two that link have one of these in common, are of
       neighbouring size bands, and have it early enough. Classes that are connected by them form families; documents
       without any have no links.
    3. Each family is a signature tree that is traversed with itself; families beyond CHUNK_TOKENS are cut by size and into
       chunks that meet in tasks of their own. Tasks return spanning forests, so components are exact while no task lists
       its pairs. Shingles are told by 64-bit hashes.

    Null and empty texts and those without words have n_shingles 0 and link with nothing; repeated rows and equal texts
    link; a null doc_id is kept, links like any other, names no component, and has a null component_id if nothing else is
    in it; an empty table gives an empty one; other columns are not read.
    """
    sets, classes, linked = _linked_classes(docs)
    least = linked.groupBy("part").agg(F.min("rep").alias("component"))
    linked = linked.join(least, "part").select(F.col("digest").alias("__digest"), "component")
    reps = classes.select(F.col("digest").alias("__d"), "rep")
    out = sets.join(reps, (sets.digest == reps["__d"]) & (sets.n > 0), "left").join(linked, sets.digest == linked["__digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each component: that of the smallest doc_id, null last, then of the smallest hash of the text.

    Rows are told by doc_id and text, so one that shares its id with a near copy stays, and of rows that repeat both one
    stays. Rows without words link with nothing and stay. An empty table gives an empty one; other columns stay as they are,
    of repeated rows those of any one.
    """
    sets, _, linked = _linked_classes(own_names(docs))
    lead = linked.groupBy("part").agg(F.min("digest").alias("lead"))
    lead = linked.join(lead, "part").select(F.col("digest").alias("__digest"), "lead")
    rows = sets.where("n > 0").groupBy("doc_id", "th", "digest").agg(F.count("*").alias("same"))
    rows = rows.join(lead, rows.digest == lead["__digest"], "left").select("doc_id", "th", "same", F.coalesce("lead", "digest").alias("group"))
    rows = materialize(rows, "near-copies")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th", "same")).alias("f"))
    stay = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("th").eqNullSafe(F.col("f.th"))
    told = materialize(rows.join(first, "group").select("doc_id", "th", "same", stay.alias("stays")).where("not stays or same > 1"), "near-copy-rows")
    named = lambda of: of.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    gone, again = named(told.where("not stays")), named(told.where("stays"))
    here = lambda of: docs.doc_id.eqNullSafe(of["__id"]) & F.xxhash64(docs.text).eqNullSafe(of["__th"])
    n_again = again.count()
    kept = docs.join(bounded_broadcast(gone, gone.count()), here(gone), "left_anti")
    if not n_again:
        return kept
    # Only rows that repeat both are gathered by them.
    few = bounded_broadcast(again, n_again)
    once = docs.join(few, here(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(few, kept.doc_id.eqNullSafe(again["__id"]) & F.xxhash64(kept.text).eqNullSafe(again["__th"]), "left_anti").unionByName(once)
