"""Operator 5: packing token sequences by first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEQUENCE_TOKENS = 2048
END_OF_DOCUMENT = 1
#: Pieces that a group holds on average; a group is what one call packs.
GROUP_PIECES = 8192

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def load_encoder(vocabulary: str):
    """A function text -> ids for a byte-level BPE vocabulary named in public_tokenizers.

    Ids are those of the `.json` file in the tokenizers library as it comes: special tokens written out in a text are
    their own ids. Where the same vocabulary lies beside it as ranks, the faster tiktoken reads that, with the special
    tokens of the `.json` file; tests hold the two against each other.
    """
    import base64
    import json
    import os

    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    ranks = f"{os.path.splitext(path)[0]}.tiktoken"
    if os.path.exists(ranks):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(path, encoding="utf-8") as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return lambda text: encoding.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


#: Code points that are tokenized at a time; see encode_whole.
STRETCH = 1 << 20


def encode_whole(encode, text: str) -> np.ndarray:
    """The ids of a whole text, then the end id. Long texts go through in stretches cut before a space and a letter, where no token reaches across."""
    parts, at = [], 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut > at and not (text[cut] == " " and text[cut + 1 : cut + 2].isalpha() and not text[cut - 1].isspace()):
            cut -= 1
        if cut == at:
            break
        parts.append(np.asarray(encode(text[at:cut]), dtype="<u4"))
        at = cut
    parts += [np.asarray(encode(text[at:] if at else text), dtype="<u4"), np.array([END_OF_DOCUMENT], dtype="<u4")]
    return np.concatenate(parts)


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: full ones of `capacity` ids and the rest. with_ids adds the ids themselves.

    A null text is empty: one piece with the end id alone.
    """
    schema = pa.schema([*PIECES, ("ids", pa.list_(pa.int32()))]) if with_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in schema.names}
            seen: dict[str, np.ndarray] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if (ids := seen.get(text)) is None:
                    ids = encode_whole(encode, text)
                    if len(seen) < 512 and len(text) < 65_536:
                        seen[text] = ids
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for name, value in zip(schema.names, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=False):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(piece.astype("<i4"))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, kind)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. A tournament tree over the bins' free space finds the first that fits in log n steps."""
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)
    used, offset = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        used[i], offset[i] = node - width, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return used, offset


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, seed: int = 0, group_pieces: int = GROUP_PIECES, n_pieces: int | None = None) -> DataFrame:
    """`pieces` (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset.

    Groups are dealt by a hash of (seed, doc_id, start), so copies and one document's pieces spread evenly; each group is
    packed alone and its sequences are numbered from group * 2^32.
    """
    groups = max(1, -(-(pieces.count() if n_pieces is None else n_pieces) // group_pieces))
    keyed = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        used, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("g")[0].as_py()
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(used + (group << 32))).append_column("offset", pa.array(offset))

    return keyed.groupBy("g").applyInArrow(pack, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = SEQUENCE_TOKENS, seed: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are tokenized once and only slim rows travel. Each document ends with id 1; a null or empty text is that id
    alone; repeated rows are packed each; null ids are kept; an empty table gives an empty one; other columns are not
    read. Every sequence is gapless from offset 0 and holds at most `capacity` ids.
    """
    return pack_pieces(materialize(cut_pieces(docs, vocabulary, capacity), "pieces"), capacity, seed)


def sequences(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = SEQUENCE_TOKENS, seed: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<int>), in the order of offset."""
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, with_ids=True), "pieces-ids")
    key = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    places = pack_pieces(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"), capacity, seed)
    ids = pieces.dropDuplicates(key).select(*[F.col(c).alias(f"_{c}") for c in key], "ids")
    same = places.doc_id.eqNullSafe(ids._doc_id) & (places.start == ids._start) & (places.ids_crc32 == ids._ids_crc32) & (places.doc_tokens == ids._doc_tokens)
    whole = places.join(ids, same).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
