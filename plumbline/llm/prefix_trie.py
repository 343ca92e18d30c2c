"""Operator 11: the prefix trie of conversations, built as adaptive radix trees over ranges of sorted keys.

A turn's id has a fixed width: 16 bytes of a digest of role and text, then the words of the text as a big-endian number. A
conversation's key is its turns' ids, so byte depths that are whole ids are the trie's nodes, and other branchings are not.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, own_names, words

#: Bytes of a turn's id, and those of them that count words.
WIDTH, WORD_BYTES = 20, 4
#: Conversations and bytes of keys that one tree takes.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 64 << 20
_OUT_ROWS = 10_000
NOTHING = hashlib.sha256(b"").hexdigest()


class Leaf:
    """The rest of a key below its parent, and its entry."""

    __slots__ = ("path", "entry")

    def __init__(self, path: bytes, entry: int):
        self.path, self.entry = path, entry


class Inner:
    """A branching: its compressed path, the entry of a key that ends here, and its children in one of four layouts.

    4 and 16: sorted bytes beside a list. 48: 256 places that name one of up to 48 slots. 256: a slot a byte.
    """

    __slots__ = ("path", "entry", "layout", "keys", "slots")

    def __init__(self, path: bytes, entry: int | None = None):
        self.path, self.entry, self.layout, self.keys, self.slots = path, entry, 4, bytearray(), []

    def find(self, byte: int):
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            return self.slots[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.layout == 48:
            return self.slots[self.keys[byte] - 1] if self.keys[byte] else None
        return self.slots[byte]

    def put(self, byte: int, child) -> None:
        """Adds `child` or puts it in the place of the one before; a full node takes the next larger layout."""
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.slots[at] = child
                return
            if len(self.keys) < self.layout:
                self.keys.insert(at, byte)
                self.slots.insert(at, child)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                places = bytearray(256)
                for slot, key in enumerate(self.keys):
                    places[key] = slot + 1
                self.layout, self.keys = 48, places
            self.put(byte, child)
        elif self.layout == 48:
            if self.keys[byte]:
                self.slots[self.keys[byte] - 1] = child
            elif len(self.slots) < 48:
                self.slots.append(child)
                self.keys[byte] = len(self.slots)
            else:
                self.layout, self.slots = 256, [self.slots[p - 1] if p else None for p in self.keys]
                self.keys = bytearray()
                self.slots[byte] = child
        else:
            self.slots[byte] = child

    def children(self) -> list:
        """Children in the order of their bytes."""
        if self.layout <= 16:
            return self.slots
        if self.layout == 48:
            return [self.slots[p - 1] for p in self.keys if p]
        return [c for c in self.slots if c is not None]


def common_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        half = (low + high) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half)
    return low


class Tree:
    """An adaptive radix tree. The root has no path, so that a conversation without turns ends there."""

    def __init__(self):
        self.root = Inner(b"")

    def insert(self, key: bytes, entry: int) -> None:
        """Adds a key that is not in the tree."""
        node, at = self.root, 0
        while at < len(key):
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Leaf(key[at:], entry))
                return
            same = common_bytes(child.path, key[at:])
            if same < len(child.path) or (isinstance(child, Leaf) and at + same < len(key)):
                # The path splits, or the key goes on below what was a leaf.
                split = Inner(child.path[:same])
                if same == len(child.path):
                    split.entry = child.entry
                else:
                    child.path = child.path[same:]
                    split.put(child.path[0], child)
                node.put(key[at], split)
                child = split
            node, at = child, at + same
        node.entry = entry


class Block:
    """Conversations of one range of sorted keys, and the trie nodes that their tree gives.

    `ahead` and `after` are the keys next to the range, or None. A node is open where one of them begins with it: then the
    blocks beside have rows of it too, and its sums are parts. A node counts as begun in the first of its blocks only.
    """

    def __init__(self, ahead: bytes | None):
        self.ahead, self.keys, self.first, self.ids, self.bytes = ahead, [], [], [], 0

    def add(self, key: bytes, conv_id: int) -> None:
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.first.append(len(self.ids))
            self.bytes += len(key)
        self.ids.append(conv_id)

    def full(self, rows: int) -> bool:
        return len(self.ids) >= rows or self.bytes >= BLOCK_BYTES

    def nodes(self, after: bytes | None) -> Iterator[tuple]:
        """(digest, parent digest, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_sha256, ends, end_at, is_open)."""
        keys, ends_at = self.keys, [*self.first[1:], len(self.ids)]
        left = -1 if self.ahead is None else common_bytes(self.ahead, keys[0]) // WIDTH
        right = -1 if after is None else common_bytes(keys[-1], after) // WIDTH
        tree = Tree()
        for entry, key in enumerate(keys):
            tree.insert(key, entry)
        least = [min(self.ids[a:b]) for a, b in zip(self.first, ends_at, strict=True)]
        made: list[list] = []  # depth, first entry, last entry, conv_id, n_convs, n_children, n_leaves, saved, entry, parent
        # Bottom-up over the tree without recursion: what is below a node is summed up before the node.
        done: dict[int, tuple] = {}
        stack = [(tree.root, 0, False)]
        while stack:
            node, start, seen = stack.pop()
            inner = isinstance(node, Inner)
            end = start + len(node.path)
            if inner and not seen:
                stack.append((node, start, True))
                stack.extend((c, end, False) for c in node.children())
                continue
            heads, low, high, conv, n, leaves, saved = [], len(keys), -1, None, 0, 0, 0
            if inner:
                for c in node.children():
                    h, lo, hi, cv, m, lv, sv = done.pop(id(c))
                    heads += h
                    low, high, n, leaves, saved = min(low, lo), max(high, hi), n + m, leaves + lv, saved + sv
                    conv = cv if conv is None else min(conv, cv)
            if node.entry is not None:
                e = node.entry
                low, high, n, conv = min(low, e), max(high, e), n + ends_at[e] - self.first[e], least[e] if conv is None else min(conv, least[e])
            # Whole turns within the path, deepest first; the root is the one node that begins at byte 0.
            top = 0 if node is tree.root else start // WIDTH + 1
            for depth in range(end // WIDTH, top - 1, -1):
                opened = (low == 0 and depth <= left) or (high == len(keys) - 1 and depth <= right)
                begins = not (low == 0 and depth <= left)
                goes_on = high == len(keys) - 1 and depth <= right
                here = node.entry if depth * WIDTH == end else None
                if here is not None and not heads and not goes_on:
                    leaves += 1
                if depth:
                    count = int.from_bytes(keys[low][depth * WIDTH - WORD_BYTES : depth * WIDTH], "big")
                    saved += count * (n - begins)
                children = sum(made[h][10] for h in heads)
                made.append([depth, low, high, conv, n, children, leaves, saved, here, None, begins, opened])
                for h in heads:
                    made[h][9] = len(made) - 1
                heads = [len(made) - 1]
            done[id(node)] = heads, low, high, conv, n, leaves, saved
        names = self._names(max(left, right), left, right)
        for depth, low, high, conv, n, children, leaves, saved, here, parent, _, opened in made:
            ids = [] if here is None else self.ids[self.first[here] : ends_at[here]]
            text = ",".join(map(str, ids))
            above = None if parent is None else made[parent]
            name = names[(0 if low == 0 and depth <= left else 1), depth] if opened else None
            up = names[(0 if above[1] == 0 and above[0] <= left else 1), above[0]] if above is not None and above[11] else None
            known = None if above is None or above[11] else above[3]
            yield name, up, depth, conv, known, n, children, leaves, saved, None if opened else hashlib.sha256(text.encode()).hexdigest() if ids else NOTHING, text if opened and ids else None, ids[0] if opened and ids else None, opened

    def _names(self, deepest: int, left: int, right: int) -> dict[tuple[int, int], bytes]:
        """Digests of the open prefixes of the first (0) and of the last (1) key."""
        names = {}
        for side, key, most in ((0, self.keys[0], left), (1, self.keys[-1], right)):
            digest = hashlib.sha256()
            for depth in range(most + 1):
                if depth:
                    digest.update(key[(depth - 1) * WIDTH : depth * WIDTH])
                names[side, depth] = digest.digest()
        return names


_NODE = "block long, name binary, up binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, end_at long, is_open boolean"
_ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES = [(c.split()[0], _ARROW[c.split()[1]]) for c in _NODE.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Trees over runs of a range's rows (range, part, key, conv_id); part 0 and 2 are the keys next to the range."""
    out, block, at, ahead, number = [], None, None, None, 0

    def ended(after):
        nonlocal out, number
        for row in block.nodes(after):
            out.append(((at << 32) + number, *row))
            if len(out) == _OUT_ROWS:
                yield _batch(out)
                out = []
        number += 1

    for batch in batches:
        for pid, part, key, conv_id in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if pid != at:
                if block is not None:
                    yield from ended(None)
                block, at, ahead, number = None, pid, None, 0
            if part == 0:
                ahead = key
            elif part == 2:
                yield from ended(key)
                block = None
            else:
                if block is None:
                    block = Block(ahead)
                elif block.full(block_rows):
                    yield from ended(key)
                    block = Block(block.keys[-1])
                block.add(key, conv_id)
    if block is not None:
        yield from ended(None)
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[n for n, _ in _TYPES])


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell role and text, and 4 that count the text's words."""
    told = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, WIDTH - WORD_BYTES)
    return F.concat(told, F.unhex(F.lpad(F.hex(F.size(words(text)).cast("long")), 2 * WORD_BYTES, "0")))


def conversation_keys(turns: DataFrame) -> DataFrame:
    """conv_id and the ids of its turns in order, an array; rows of one turn are ordered by their ids."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = own_names(turns).where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"))
    # Nulls come first in the order of structs.
    return slim.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda t: t["id"]).alias("ids"))


def rebuilt(keys: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Puts the first turns of conversation c - c % `group` in the place of as many of each conversation c: crc32(c) % `most`."""
    keys = materialize(keys, "turn-ids")
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    heads = keys.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("ids", 1, most - 1).alias("__head"))
    both = keys.withColumn("__of", F.col("conv_id") - F.col("conv_id") % group).withColumn("__n", taken.cast("int")).join(heads, F.col("__of") == F.col("__base"), "left")
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__n")), F.array().cast("array<binary>"))
    return both.select("conv_id", F.concat(head, F.slice("ids", F.col("__n") + 1, F.size("ids"))).alias("ids"))


def prefix_trie(keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a node of the trie over (conv_id, ids), as conversation_keys() gives them.

    conv_id: the smallest member. parent_conv_id: that of the node above, null for the root. n_convs, n_children; n_leaves:
    childless nodes below, itself included. saved_tokens: over the nodes below and itself, the words of the node's last turn
    times its members but one. ends_sha256: of the comma-joined ids, ascending, of the conversations that end here.

    Conversations are sorted by key and id in ranges, so equal ones may lie in many; a range is cut into blocks of `block_rows`.
    Each block is one tree. Nodes that no neighbouring key begins with are whole; the others, some a block, are summed up.
    A conversation without turns ends in the root. No conversations give no rows. Repeated ids are members as often.
    A conversation is one key of 20 bytes a turn.
    """
    rows = keys.select("conv_id", F.unhex(F.array_join(F.transform("ids", F.hex), "")).alias("key"))
    ranges = rows.repartitionByRange("key", "conv_id").withColumn("pid", F.spark_partition_id())
    ranges = materialize(ranges, "trie-ranges")
    by_range = Window.orderBy("pid")
    edges = ranges.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.select("pid", F.lag("high").over(by_range).alias("ahead"), F.lead("low").over(by_range).alias("after"))
    beside = edges.select("pid", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("ahead").alias("key")), F.struct(F.lit(2).alias("part"), F.col("after").alias("key")))).alias("e"))
    beside = beside.select("pid", "e.part", "e.key").where("key is not null").withColumn("conv_id", F.lit(None).cast("long"))
    dealt = ranges.select("pid", F.lit(1).alias("part"), "key", "conv_id").unionByName(beside)
    in_order = dealt.repartition("pid").sortWithinPartitions("pid", "part", "key", "conv_id").select("pid", "part", "key", "conv_id")
    nodes = materialize(in_order.mapInArrow(lambda b: _blocks(b, block_rows), _NODE), "trie-nodes")
    return _merged(nodes)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces (name, end_at, ends) of each name, in order; only the state of the hash is held."""
    at, digest, out = None, None, []
    for batch in batches:
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != at:
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["name", "ends_sha256"])
            out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["name", "ends_sha256"])


def _merged(nodes: DataFrame) -> DataFrame:
    """The whole nodes of blocks, and the sums of open ones."""
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    parts = nodes.where("is_open")
    pieces = parts.where("ends is not null").select("name", "end_at", "ends").repartition("name").sortWithinPartitions("name", "end_at").select("name", "ends")
    hashes = pieces.mapInArrow(_hashed, "name binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = parts.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), *sums).join(hashes, "name", "left")
    opened = materialize(opened, "trie-open")
    above = opened.select(F.col("name").alias("up"), F.col("conv_id").alias("__above"))
    whole_open = opened.join(above, "up", "left").withColumn("parent_conv_id", F.col("__above")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    whole = nodes.where("not is_open")
    # Nodes below an open one get its smallest member by their block: a block has few open nodes, and no more rows than its keys have turns.
    by_block = parts.select("block", "name").join(above.withColumnRenamed("up", "name"), "name").withColumnRenamed("name", "up")
    below = whole.where("up is not null").drop("parent_conv_id").join(by_block, ["block", "up"]).withColumnRenamed("__above", "parent_conv_id")
    return whole.where("up is null").select(*columns).unionByName(below.select(*columns)).unionByName(whole_open.select(*columns))


__all__ = ["Tree", "conversation_keys", "prefix_trie", "rebuilt"]
