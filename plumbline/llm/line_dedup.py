"""Operator 3: line deduplication by sharded cuckoo filters over an exact reference-count table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_names

#: Lines found in at least so many documents are dropped.
MIN_DOCUMENTS = 10
#: Keys of at least so many code points are counted.
MIN_CODE_POINTS = 1
#: Bytes of filters up to which they are broadcast and screen lines where they are read; beyond it lines go to their shards.
FILTER_BROADCAST_BYTES = 64 << 20
#: Digests, of 16 bytes, that are broadcast at most.
BROADCAST_DIGESTS = 1 << 20
#: Lines that meet a shard's filter at once; a shard with more is read in parts.
SHARD_LINES = 1 << 22
#: Keys that a shard of the filter holds.
SHARD_KEYS = 1 << 18
_STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_digests(text: str | None) -> list[bytes | None]:
    """A 16-byte digest of each line's key, None for a key that is too short. Null and empty texts have one empty line.

    Key: the line without white space at its ends, A-Z lower-cased. bytes.lower() changes these letters only.
    """
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    keys = [x.strip(_STRIP) for x in lines]
    return [hashlib.blake2b(k, digest_size=16).digest() if (len(k) >= MIN_CODE_POINTS if MIN_CODE_POINTS <= 1 else len(k.decode()) >= MIN_CODE_POINTS) else None for k in keys]


class CuckooFilter:
    """Fingerprints of 16 bits, 4 in a bucket, 2 buckets a key, in a numpy table. Keys come as pairs of 64-bit halves.

    Insertion places what it can at once for the whole batch and evicts for the rest; deletion takes one fingerprint of
    an inserted key out again. Lookups never miss an inserted key; a fresh key passes with a chance of about 1 in 8000.
    """

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            table = np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, capacity) / 4 / 0.8)))), 4), "<u2")
        self.table = table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, 4).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = (high % np.uint64(65_535) + np.uint64(1)).astype("<u2")
        first = low & mask
        return prints, first.astype("i8"), self._other(first.astype("i8"), prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        spread = prints.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return at ^ (spread & np.uint64(len(self.table) - 1)).astype("i8")

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(high, low)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False if the table is too full; make a larger one then."""
        prints, first, other = (x.tolist() for x in self._places(high, low))
        table = self.table
        for f, a, b in zip(prints, first, other, strict=True):
            for at in (a, b):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = f
                    break
            else:
                at = b
                for kick in range(500):
                    slot = (f + kick) % 4
                    f, table[at, slot] = int(table[at, slot]), f
                    at = int(self._other(np.array([at]), np.array([f], "<u2"))[0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for f, a, b in zip(*(x.tolist() for x in self._places(high, low)), strict=True):
            for at in (a, b):
                own = np.flatnonzero(self.table[at] == f)
                if len(own):
                    self.table[at, own[0]] = 0
                    break
            else:
                raise KeyError("a key that was not inserted")


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype("u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame) -> DataFrame:
    """(digest, refs): in how many documents (rows) each line key is found. Tasks add up their own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs: dict[bytes, int] = {}
            for text in batch.column(0):
                for d in {*line_digests(text.as_py())} - {None}:
                    refs[d] = refs.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(refs.keys(), pa.binary()), pa.array(refs.values(), pa.int64())], ["digest", "refs"])

    return docs.select("text").mapInArrow(count, "digest binary, refs long").groupBy("digest").agg(F.sum("refs").alias("refs"))


def _sharded(refs: DataFrame, n_shards: int) -> DataFrame:
    """The shard is the first 32 bits of the digest, modulo."""
    return refs.withColumn("shard", (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % n_shards).cast("int"))


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, n_keys, cells): one cuckoo filter a shard over the digests of `keys`."""

    def build(table: pa.Table) -> pa.Table:
        digests = sorted(table.column("digest").to_pylist())
        size = len(digests)
        while not (cuckoo := CuckooFilter(size)).insert(*_halves(digests)):
            size *= 2
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n_keys": [len(digests)], "cells": [cuckoo.to_bytes()]})

    return _sharded(keys, n_shards).select("shard", "digest").groupBy("shard").applyInArrow(build, "shard int, n_keys long, cells binary")


def _document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("n"))


def _lines(batch: pa.RecordBatch) -> pa.Table:
    """doc_id, text_hash, line, digest of each line with a key in a batch of (doc_id, text, text_hash)."""
    rows, numbers, digests = [], [], []
    for row, text in enumerate(batch.column(1)):
        for number, digest in enumerate(line_digests(text.as_py())):
            if digest is not None:
                rows.append(row)
                numbers.append(number)
                digests.append(digest)
    at = pa.array(rows, pa.int64())
    return pa.table({"doc_id": batch.column(0).take(at), "text_hash": batch.column(2).take(at), "line": pa.array(numbers, pa.int32()), "digest": pa.array(digests, pa.binary())})


def _shards(high: np.ndarray, n_shards: int) -> np.ndarray:
    return (high >> np.uint64(32)) % np.uint64(n_shards)


def _screened(digests: list[bytes], filters: dict[int, CuckooFilter], n_shards: int) -> np.ndarray:
    """Which of `digests` pass the filters of their shards."""
    found = np.zeros(len(digests), bool)
    if digests:
        high, low = _halves(digests)
        shard = _shards(high, n_shards)
        for k in np.unique(shard).tolist():
            if k in filters:
                own = shard == k
                found[own] = filters[k].contains(high[own], low[own])
    return found


_LINE = "doc_id long, text_hash long, line int, digest binary"


class LineIndex:
    """Exact counts `refs` (digest, refs) of all line keys, and cuckoo filters of those in `min_documents` rows or more.

    insert() and delete() return a new index in which the counts of a batch are added or taken off again: deleting what
    was inserted restores the index. `documents` (doc_id, text_hash, n) tells what is in it: deleting a row that is not
    raises ValueError. Filters of shards in which no key crosses the threshold stay as they are; in the others single keys
    are inserted into or deleted from the stored cells.
    """

    def __init__(self, refs: DataFrame, filters: DataFrame, n_shards: int, min_documents: int, documents: DataFrame):
        self.refs, self.filters, self.n_shards, self.min_documents, self.documents = refs, filters, n_shards, min_documents, documents

    @classmethod
    def build(cls, docs: DataFrame, min_documents: int = MIN_DOCUMENTS, n_shards: int | None = None) -> LineIndex:
        refs = materialize(line_counts(docs), "line-refs")
        hot = refs.where(F.col("refs") >= min_documents)
        if n_shards is None:
            n_shards = max(1, -(-hot.count() // SHARD_KEYS))
        return cls(refs, materialize(build_filters(hot, n_shards), "line-filters"), n_shards, min_documents, _document_counts(docs))

    def hot(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_documents).select("digest")

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        moved = _document_counts(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), (F.col("n") * sign).alias("__n"))
        held = self.documents.join(moved, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))
        held = materialize(held.select(F.when(F.col("text_hash").isNull(), F.col("__id")).otherwise(F.col("doc_id")).alias("doc_id"), F.coalesce("text_hash", "__hash").alias("text_hash"), n.alias("n")), "line-documents")
        if sign < 0 and (unknown := held.where("n < 0").first()):
            raise ValueError(f"document {unknown.doc_id} with this text is not in the index")
        delta = line_counts(docs).select("digest", (F.col("refs") * sign).alias("delta"))
        after = self.refs.join(delta, "digest", "full").select("digest", F.coalesce("refs", F.lit(0)).alias("before"), (F.coalesce("refs", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("refs"))
        after = materialize(after, "line-refs")
        at = self.min_documents
        crossed = after.where((F.col("before") >= at) != (F.col("refs") >= at)).select("digest", (F.col("refs") >= at).alias("enters"))

        def update(key, old: pa.Table, new: pa.Table) -> pa.Table:
            rows = sorted(zip(new.column("digest").to_pylist(), new.column("enters").to_pylist(), strict=True))
            enter, leave = [d for d, e in rows if e], [d for d, e in rows if not e]
            n = old.column("n_keys")[0].as_py() if old.num_rows else 0
            cuckoo = CuckooFilter.from_bytes(old.column("cells")[0].as_py()) if old.num_rows else CuckooFilter(len(enter))
            if leave:
                cuckoo.delete(*_halves(leave))
            fits = not enter or cuckoo.insert(*_halves(enter))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": [n + len(enter) - len(leave)], "cells": pa.array([cuckoo.to_bytes() if fits else None], pa.binary())})

        new = _sharded(crossed, self.n_shards)
        filters = materialize(self.filters.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(update, "shard int, n_keys long, cells binary"), "line-filters")
        # A shard that had no room for its new keys is made anew, larger.
        hot = _sharded(after.where(F.col("refs") >= at), self.n_shards).join(filters.where("cells is null").select("shard"), "shard", "left_semi")
        filters = filters.where("cells is not null").union(build_filters(hot, self.n_shards))
        return LineIndex(after.where("refs > 0").select("digest", "refs"), materialize(filters, "line-filters"), self.n_shards, at, held.where("n > 0"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def filter_bytes(self) -> int:
        return self.filters.agg(F.sum(F.octet_length("cells"))).first()[0] or 0

    def _cells(self):
        """All filters as a broadcast; only where filter_bytes() is within a bound."""
        return self.filters.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cells) for r in self.filters.toLocalIterator()})

    def false_hits(self, digests: DataFrame, cells) -> DataFrame:
        """Those of `digests` that pass the broadcast filters without being frequent: about 1 in 8000."""
        n_shards = self.n_shards

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.from_bytes(v) for k, v in cells.value.items()}
            for batch in batches:
                yield batch.filter(pa.array(_screened(batch.column(0).to_pylist(), filters, n_shards)))

        return digests.select("digest").mapInArrow(screen, "digest binary").distinct().join(self.hot(), "digest", "left_anti")

    def maybe_lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_hash, line, digest, sure: the lines that pass the filter of their shard, where the filters are too
        large to be sent to every task.

        Digests of the lines travel to their shard and meet its filter there. The most frequent keys, of which no corpus
        can have more than BROADCAST_DIGESTS, are told where they are read (`sure`), so no shard is hot; a shard with many
        lines is read in parts.
        """
        total = self.refs.agg(F.sum("refs")).first()[0] or 0
        top = self.refs.where((F.col("refs") >= self.min_documents) & (F.col("refs") > total / BROADCAST_DIGESTS)).select("digest")
        frequent = docs.sparkSession.sparkContext.broadcast({bytes(r.digest) for r in top.toLocalIterator()})
        n_shards, parts = self.n_shards, max(1, -(-total // (self.n_shards * SHARD_LINES)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = _lines(batch)
                digests = lines.column("digest").to_pylist()
                sure = np.fromiter((d in frequent.value for d in digests), bool, len(digests))
                high, low = _halves(digests) if digests else (np.zeros(0, "u8"),) * 2
                shard = np.where(sure, -1, _shards(high, n_shards).astype("i4")).astype("i4")
                yield from lines.append_column("shard", pa.array(shard)).append_column("part", pa.array((np.arange(len(digests)) % parts).astype("i4"))).to_batches()

        slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
        lines = slim.mapInArrow(read, f"{_LINE}, shard int, part int")
        filters = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def screen(key, own: pa.Table, cuckoo: pa.Table) -> pa.Table:
            own = own.select(["doc_id", "text_hash", "line", "digest"])
            if not own.num_rows or not cuckoo.num_rows:
                return own.slice(0, 0)
            passed = CuckooFilter.from_bytes(cuckoo.column("cells")[0].as_py()).contains(*_halves(own.column("digest").to_pylist()))
            return own.filter(pa.array(passed))

        met = lines.where("shard >= 0").groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(screen, _LINE)
        return lines.where("shard < 0").select("doc_id", "text_hash", "line", "digest", F.lit(True).alias("sure")).unionAll(met.withColumn("sure", F.lit(False)))

    def dropped_lines(self, docs: DataFrame, filter_broadcast_bytes: int = FILTER_BROADCAST_BYTES) -> DataFrame:
        """(doc_id, text_hash, lines): the line numbers that each document loses, of documents that lose any.

        The filters screen all lines, where these are read if the filters are within the bound, else in their shards. Only
        lines that pass meet the exact counts, which decide.
        """
        if self.filter_bytes() <= filter_broadcast_bytes:
            cells, n_shards = self._cells(), self.n_shards

            def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {k: CuckooFilter.from_bytes(v) for k, v in cells.value.items()}
                for batch in batches:
                    lines = _lines(batch)
                    yield from lines.filter(pa.array(_screened(lines.column("digest").to_pylist(), filters, n_shards))).to_batches()

            slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
            sure = slim.mapInArrow(screen, _LINE).join(self.hot(), "digest", "left_semi")
        else:
            maybe = materialize(self.maybe_lines(docs), "maybe-lines")
            sure = maybe.where("sure").drop("sure").unionByName(maybe.where("not sure").drop("sure").join(self.hot(), "digest", "left_semi"))
        return sure.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


#: Texts whose lines a task holds at once.
SLICE = 256


def _drops_where_read(index: LineIndex, cells, wrong: set[bytes]) -> Column:
    """The numbers of the lines that a text loses, by broadcast filters; `wrong` are the digests that pass them without being
    frequent. Only numbers come back, and few texts are open at a time."""
    n_shards = index.n_shards

    @F.arrow_udf("array<int>")
    def drops(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in cells.value.items()}
        for texts in batches:
            out: list[list[int] | None] = []
            for first in range(0, len(texts), SLICE):
                own = [line_digests(text.as_py()) for text in texts.slice(first, SLICE)]
                passed = iter(_screened([d for x in own for d in x if d is not None], filters, n_shards).tolist())
                out += [[i for i, d in enumerate(x) if d is not None and next(passed) and d not in wrong] or None for x in own]
            yield pa.array(out, pa.list_(pa.int32()))

    return drops("text")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_documents: int = MIN_DOCUMENTS, filter_broadcast_bytes: int = FILTER_BROADCAST_BYTES) -> DataFrame:
    """`docs` with a struct `__lines`: n_lines, n_dropped, kept_text.

    Lines whose key `index` (by default that of `docs` itself) counts in min_documents rows or more lose every
    occurrence; the others stay, joined by newlines. While the filters are within the bound, they decide where texts are
    read, and the few keys that pass them without being frequent, told by the exact counts before, go along: no text is
    shuffled. Beyond it lines meet their shard's filter and then the exact counts, and drop lists are joined to the texts.

    A null or empty text is one empty line and stays; a key is told by 128 bits of its digest; repeated rows count as
    documents each; an empty table gives an empty one; other columns pass (the name `__lines` is reserved). A text all of
    whose lines go is empty.
    """
    own = index is None
    docs = own_names(docs)
    index = index or LineIndex.build(docs, min_documents)
    if index.filter_bytes() <= filter_broadcast_bytes:
        cells = index._cells()
        wrong = materialize(index.false_hits(index.refs if own else line_counts(docs), cells), "line-false-hits")
        if wrong.count() <= BROADCAST_DIGESTS:
            return _without(docs.withColumn("__drop", _drops_where_read(index, cells, {bytes(r.digest) for r in wrong.toLocalIterator()})), docs.columns)
    drops = materialize(index.dropped_lines(docs, filter_broadcast_bytes), "line-drops")
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lines").alias("__drop"))
    joined = docs.join(drops, docs.doc_id.eqNullSafe(drops["__id"]) & (F.xxhash64(docs.text) == drops["__hash"]), "left")
    return _without(joined, docs.columns)


def _without(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` and the struct of what each text is without the lines numbered in `__drop`; texts that lose none are not split."""
    text = F.coalesce("text", F.lit(""))
    # array_except compares sets of numbers, so the work is in proportion to the lines.
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__drop")), lambda i: F.get(x, i)), "\n"))[0]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = F.struct(n_lines.alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("__drop").isNull(), text).otherwise(left).alias("kept_text"))
    return rows.select(*columns, out.alias("__lines"))
