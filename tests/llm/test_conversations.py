"""The prefix trie and the repair of turns against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from plumbline.llm import prefix_trie, turn_repair
from plumbline.llm.queries import op11_prefix_trie, op13_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, kept boolean, ids long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def talk(seed: int, n: int) -> list[tuple]:
    """Turns of `n` conversations with shared beginnings, copies, nulls, white space and one long conversation."""
    rng = random.Random(seed)
    openings = [("system", "Be brief."), ("user", "hello there"), ("user", None), (None, "x")]
    rows = []
    for c in range(n):
        turns = [openings[0 if rng.random() < 0.5 else rng.randrange(4)]]
        turns += [(rng.choice(["user", "assistant", "tool", ""]), rng.choice(["a b c.", "why?", "no", " ", "", "ende .  \n", "\x00 ß", None])) for _ in range(rng.randrange(6))]
        rows += [(c if c % 7 else -c, None if rng.random() < 0.05 else i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(1_000, i, "user" if i % 2 else "assistant", f"t {i % 9}.") for i in range(700)]
    rows += [(2_000 + i, j, "user", "hot one.") for i in range(60) for j in range(3)]
    rows += [(rows[5][0], rows[5][1], rows[5][2], rows[5][3])] * 2
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, True, 1) for r in rows], SCHEMA).repartition(parts)


def trie(sequences: dict) -> list[tuple]:
    """Nodes of {conv_id: turns}, each turn (role, text), by listing every prefix."""
    members: dict[tuple, list] = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [0, 0] for k in members}
    children = dict.fromkeys(members, 0)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        saved = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            below[k[:d]][0] += not children[k]
            below[k[:d]][1] += saved
    ends = {k: ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k)))) for k, m in members.items()}
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], *below[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()]


def in_order(rows, digest=None):
    out: dict = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x, key=lambda v: (v[:2], digest(*v[2:]) if digest else b""))] for c, x in out.items()}


def turn_bytes(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("block_rows", [3, 20, 20_000])
def test_trie_equals_all_prefixes(spark, block_rows):
    rows = talk(block_rows, 160)
    want = sorted(trie(rebuilt(in_order(rows, turn_bytes))), key=key)
    keys = prefix_trie.rebuilt(prefix_trie.conversation_keys(frame(spark, [*rows, (None, 1, "user", "no id")])))
    got = sorted(map(tuple, prefix_trie.prefix_trie(keys, block_rows).collect()), key=key)
    assert got == want


def test_trie_of_no_rows_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(prefix_trie.conversation_keys(frame(spark, [], 1))).count() == 0
    turnless = spark.createDataFrame([(5, []), (3, [])], "conv_id long, ids array<binary>")
    assert list(map(tuple, prefix_trie.prefix_trie(turnless).collect())) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]
    # Conversation 20 exists, takes h turns of itself and so stays whole; 21 has none left after its first h.
    ids = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:1]
    rows = [(ids[0], 0, "user", "gone")]
    out = op_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversation_keys(frame(spark, rows)))))
    assert out == [(ids[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(ids[0]).encode()).hexdigest())]


def op_rows(df):
    return sorted(map(tuple, df.collect()), key=key)


def test_radix_tree_grows_through_all_layouts():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(range(256), k=rng.choice([0, 2, 3, 3, 3, 4]))) for _ in range(3_000)} | {bytes([i]) for i in range(0, 256, 3)})
    tree = prefix_trie.Tree()
    for i in rng.sample(range(len(keys)), len(keys)):
        tree.insert(keys[i], i)
    assert tree.root.layout == 256
    found, layouts, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.path
        if node.entry is not None:
            found.append((path, node.entry))
        if isinstance(node, prefix_trie.Inner):
            layouts.add(node.layout)
            heads = [c.path[0] for c in node.children()]
            assert heads == sorted(heads) and all(node.find(c.path[0]) is c for c in node.children())
            stack += [(c, path) for c in node.children()]
    assert sorted(found) == [(k, i) for i, k in enumerate(keys)] and layouts == {4, 16, 48, 256}


def test_trie_query(spark, tmp_path):
    rows = talk(9, 90)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op_rows(op11_prefix_trie(spark, str(tmp_path))) == sorted(trie(rebuilt(in_order(rows, turn_bytes))), key=key)


NEXT, DUE, FINAL = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}, ("", "a")


def cheapest(symbols: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of turns (initial, fault) by a search over all edits in order of cost and audit."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if at == len(symbols) and last in FINAL:
            return cost, audit
        if (at, last) in done:
            continue
        done.add((at, last))
        due = NEXT[last]
        heapq.heappush(heap, (cost + 5, audit + "I", at, due))
        if at < len(symbols):
            initial, fault = symbols[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, due))
                if initial == due or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initial))
    raise AssertionError


def repaired(turns: list[tuple]) -> tuple:
    """What the query returns of one conversation's turns (turn, role, text), in order."""
    seen, symbols, counts, numbers = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), {t for t, _, _ in turns if t is not None}
    for _, role, text in turns:
        words = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] = counts.get(fault, 0) + 1
        symbols.append((role[:1], fault))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    cost, audit = cheapest(symbols)
    out, at, last = [], 0, ""
    for edit in audit:
        if edit in "IR":
            last = NEXT[last]
            out.append(f"{DUE[last]}:{'' if edit == 'I' else turns[at][2]}")
        elif edit == "K":
            last = symbols[at][0]
            out.append(f"{turns[at][1]}:{turns[at][2]}")
        at += edit != "I"
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_solved_suffixes_equal_a_search():
    rng = random.Random(4)
    faults = ["", "", "truncated", "blank"]
    for _ in range(400):
        symbols = [(rng.choice("suaoo"), rng.choice(faults)) for _ in range(rng.randrange(9))]
        signature = "".join("x" if f == "blank" else i.upper() if f else i for i, f in symbols)
        assert list(turn_repair.solve(iter([signature]))) == [cheapest(symbols)]
    texts = sorted({"".join(rng.choices("suaSxo", k=rng.randrange(12))) for _ in range(500)}, key=lambda s: s[::-1])
    assert list(turn_repair.solve(iter(texts))) == [next(turn_repair.solve(iter([t]))) for t in texts]


def by_conversation(rows):
    out: dict = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, []).append((turn, role, text))
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}:{t}".encode()).digest()
    return {c: sorted(x, key=lambda v: (v[0] is not None, v[0] or 0, v[1], digest(v[1], v[2]))) for c, x in out.items()}


def test_repair_equals_plain_python(spark):
    rows = [*talk(2, 150), (None, 1, "user", "a."), (None, 3, "assistant", "b."), (7_000, 2, "system", "Only system."), (7_001, 1, "assistant", "first."), (7_001, 9, "user", "cut")]
    want = {c: repaired(t) for c, t in by_conversation(rows).items()} | {8_000: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    df = frame(spark, rows)
    out = turn_repair.repair(df, ids=spark.createDataFrame([(8_000,), (8_000,), (1,)], "conv_id long")).collect()
    assert len(out) == len(want) and {r.conv_id: tuple(r)[1:] for r in out} == want
    turns = turn_repair.repaired_turns(df, turn_repair.audits(df)).orderBy("conv_id", "place").collect()
    texts: dict = {}
    for r in turns:
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: w[-1] for c, w in want.items() if c in texts}
    assert turn_repair.repair(frame(spark, [], 1)).count() == 0


def test_repair_query(spark, tmp_path):
    rows = talk(5, 120)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for c, turn, role, text in rows:
        hit = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        left += [(c, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: nothing for c, *_ in rows} | {c: repaired(t) for c, t in by_conversation(left).items()}
    assert {r.conv_id: tuple(r)[1:] for r in op13_turn_repair(spark, str(tmp_path)).collect()} == want
