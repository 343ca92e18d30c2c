"""Operator 13: conversation structure repair over an automaton of role and fault signatures that share their suffixes.

A signature has one letter a turn: s, u, a or o for the initial of its role (o: any other), upper case where the text is cut
off, x where the turn must go. What a repair costs from some turn on depends on the rest of the signature alone, so each
distinct suffix of all conversations is a node of the automaton, and its costs and first edits are found once a grammar state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, own_names

#: Grammar states of the roles put out so far: 0 none, 1 a system turn, 2 ends with user, 3 ends with assistant.
FINAL = (0, 3)
#: The state after the role that is due in each state, and that role. A system turn is never due, only kept.
NEXT = (2, 2, 3, 2)
DUE = ("user", "user", "assistant", "user")
#: The state after a kept turn of an initial; None where the grammar has no place for it.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Signatures of more than 1 / HOT_SHARE of all conversations are sent to all tasks: there are fewer than HOT_SHARE.
HOT_SHARE = 1_000
_OUT_ROWS = 10_000
_STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"

Node = tuple[tuple, tuple]


def solved_node(symbol: str, rest: Node) -> Node:
    """Costs and first edits, one a state, of a turn `symbol` followed by what `rest` stands for.

    Of equal costs the ASCII-least edit leads to the ASCII-least repair, as no two choices begin with the same edit.
    """
    costs, edits = [], []
    for state in range(4):
        choices = [(DELETE + rest[0][state], "D")]
        if symbol != "x":
            extra = CUT_OFF if symbol.isupper() else 0
            choices.append((REROLE + extra + rest[0][NEXT[state]], "R"))
            if (kept := KEPT[symbol.lower()][state]) is not None:
                choices.append((KEEP + extra + rest[0][kept], "K"))
        cost, edit = min(choices)
        costs.append(cost)
        edits.append(edit)
    return _with_inserts(costs, edits)


def _with_inserts(costs: list, edits: list) -> Node:
    # An insertion leaves the turns as they are; no repair makes more than two in a row.
    for _ in range(3):
        for state in range(4):
            costs[state], edits[state] = min((costs[state], edits[state]), (INSERT + costs[NEXT[state]], "I"))
    return tuple(costs), tuple(edits)


#: What is left after the last turn: nothing in a final state, insertions elsewhere.
END: Node = _with_inserts([0 if s in FINAL else float("inf") for s in range(4)], ["" if s in FINAL else "~" for s in range(4)])


def solve(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each signature.

    Signatures that come in the order of their reversed forms share the nodes of all suffixes they have in common: the path
    of the last one is kept, and nodes off the path of the next are never met again.
    """
    path, before = [END], ""
    for signature in signatures:
        backwards = signature[::-1]
        common = next((i for i, (x, y) in enumerate(zip(before, backwards, strict=False)) if x != y), min(len(before), len(backwards)))
        del path[common + 1 :]
        for symbol in backwards[common:]:
            path.append(solved_node(symbol, path[-1]))
        before, audit, state, left = backwards, [], 0, len(backwards)
        while edit := path[left][1][state]:
            audit.append(edit)
            if edit == "K":
                state = KEPT[signature[len(signature) - left].lower()][state]
            elif edit != "D":
                state = NEXT[state]
            left -= edit != "I"
        yield path[-1][0][0], "".join(audit)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    counts = []

    def signatures():
        for s, n in rows:
            counts.append((s, n))
            yield s

    out = []
    for answer in solve(signatures()):
        out.append((*counts.pop(), *answer))
        if len(out) == _OUT_ROWS:
            yield _batch(out, ("signature", "n", "cost", "audit"))
            out = []
    if out:
        yield _batch(out, ("signature", "n", "cost", "audit"))


def _batch(rows: list[tuple], names: tuple[str, ...], types: dict | None = None) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    known = {"signature": pa.string(), "audit": pa.string(), "role": pa.string(), "text": pa.string(), "edit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, (types or known).get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=list(names))


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and __digest of `turns`, null roles and texts as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = own_names(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("__digest", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))))


def _in_order(rows: DataFrame) -> DataFrame:
    """A conversation in one task, in order. Rows of one turn are ordered by role and by a digest of role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "__part", F.col("turn").asc_nulls_first(), "role", "__digest")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: its faults and its signature. Held of the conversation at hand: a letter and a digest a turn."""
    names = (*[c.split()[0] for c in _STATS.split(", ")], "signature")
    out, at, started = [], None, False

    def closed():
        gaps = last - first + 1 - distinct if distinct else 0
        return at, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, "".join(letters)

    for batch in batches:
        for conv, part, turn, initial, kind, digest in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if not started or conv != at:
                if started:
                    out.append(closed())
                    if len(out) == _OUT_ROWS:
                        yield _batch(out, names)
                        out = []
                started, at, letters, seen, counts = True, conv, [], set(), {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
                first = last = before = None
                distinct = illegal = 0
            if part == 0:
                continue
            if turn is not None:
                distinct += turn != last
                first, last = turn if first is None else first, turn
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            if kind != "blank" and digest in seen:
                kind = "duplicate"
            seen.add(digest)
            counts[kind] += 1
            letter = initial if initial in ("s", "u", "a") else "o"
            letters.append("x" if kind in ("blank", "duplicate") else letter.upper() if kind else letter)
    if started:
        out.append(closed())
        yield _batch(out, names)


def signatures(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation of `turns` and of `ids`: gaps, its faults by the first that each turn has, and its signature."""
    kind = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), "truncated").otherwise("")
    slim = turn_rows(turns).select("conv_id", F.lit(1).alias("__part"), "turn", F.substring("role", 1, 1).alias("__initial"), kind.alias("__kind"), "__digest", "role")
    if ids is not None:
        named = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        slim = slim.unionByName(named.withColumn("__part", F.lit(0)), allowMissingColumns=True)
    return _in_order(slim).drop("role").mapInArrow(_signatures, f"{_STATS}, signature string")


def with_audits(signed: DataFrame) -> DataFrame:
    """`signed`, the written rows of signatures(), with cost and audit. Each distinct signature is solved once.

    Distinct signatures are dealt in ranges of their reversed forms, so those that share a long suffix meet in a task. The
    answers of hot signatures are sent to all tasks, the others are joined.
    """
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n"))
    ranges = distinct.repartitionByRange(F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    solved = materialize(ranges.mapInArrow(_solved, "signature string, n long, cost long, audit string"), "repairs")
    is_hot = F.col("n") * HOT_SHARE > signed.count()
    hot, cold = F.broadcast(solved.where(is_hot).drop("n")), solved.where(~is_hot).drop("n")
    return signed.join(hot, "signature").unionByName(signed.join(hot, "signature", "left_anti").join(cold, "signature"))


def _repaired(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    """Follows each conversation's audit over its turns. Gives its repaired turns or, with `digests`, one row with their digest."""
    names = (*[c.split()[0] for c in _STATS.split(", ")], "cost", "audit", "repaired_sha256") if digests else ("conv_id", "place", "turn", "role", "text", "edit")
    out, stats = [], None

    def put(role, text, edit, turn=None):
        nonlocal place
        if digests:
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        else:
            out.append((stats[0], place, turn, role, text, edit))
        place += 1

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put(DUE[state], "", "I")
            at, state = at + 1, NEXT[state]

    def closed():
        inserted()
        if digests:
            out.append((*stats, audit, sha.hexdigest()))

    for batch in batches:
        for conv, part, turn, role, text, *head in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
            if part == 0:
                if stats is not None:
                    closed()
                stats, audit, at, state, place, sha = (conv, *head[:-1]), head[-1], 0, 0, 0, hashlib.sha256()
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(role, text, edit, turn)
                state = KEPT[role[0]][state]
            elif edit == "R":
                put(DUE[state], text, edit, turn)
                state = NEXT[state]
        if len(out) >= _OUT_ROWS or (out and not digests):
            yield _batch(out, names)
            out = []
    if stats is not None:
        closed()
    if out:
        yield _batch(out, names)


def _heads_and_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    head = [c.split()[0] for c in _STATS.split(", ")][1:] + ["cost", "audit"]
    heads = audits.select("conv_id", F.lit(0).alias("__part"), *head)
    both = turn_rows(turns).withColumn("__part", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return _in_order(both).select("conv_id", "__part", "turn", "role", "text", *head)


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of `turns` and of `ids`."""
    return with_audits(materialize(signatures(turns, ids), "signatures")).drop("signature")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text and edit of the turns that the audits in `found` leave, put in or give another role."""
    return _heads_and_turns(turns, found).mapInArrow(lambda b: _repaired(b, False), "conv_id long, place long, turn long, role string, text string, edit string")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation of `turns` and of `ids`: its faults, the cheapest repair and the digest of the repaired turns.

    Repairs give role initials `(s?(ua)+)?`. A turn is kept (0), given the role due, user or assistant (1), or deleted (2);
    blank turns and those whose role and text came before must be deleted; an empty turn of the role due is inserted for 5;
    a cut-off turn that stays adds 5. Of equal costs the ASCII-least audit counts.

    Null roles and texts are one space. Null turns come first and make no gaps; rows of one turn are ordered by role, then by a
    digest of the text. Rows with a null conv_id are one conversation. A conversation of `ids` without turns has zeros, an
    empty audit and the digest of nothing. An empty table gives an empty one, other columns are not read, columns that begin
    with two underscores raise. Turns of a conversation are read in order by one task that holds a letter and a digest of each,
    not their texts.
    """
    columns = f"{_STATS}, cost long, audit string, repaired_sha256 string"
    return _heads_and_turns(turns, audits(turns, ids)).mapInArrow(lambda b: _repaired(b, True), columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that the query repairs: by crc32 of `conv_id:turn` modulo 20, rows are dropped (0), emptied (1), lose `[.!?]` (2), are repeated (3), or become a user's (4)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit: Column = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


__all__ = ["audits", "damaged", "repair", "repaired_turns", "signatures", "solve", "with_audits"]
