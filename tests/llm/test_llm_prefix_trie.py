"""The trie by ROLLUP against a trie built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from postmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, block int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def reference(rows):
    members = defaultdict(set)
    ends = defaultdict(set)
    kids, parent, last = defaultdict(set), {}, {0: None}
    names = {}  # (parent node, turn) -> node
    for c, turns in rebuilt(rows).items():
        node = 0
        members[0].add(c)
        for turn in turns:
            child = names.setdefault((node, turn), len(names) + 1)
            parent[child], last[child] = node, turn
            kids[node].add(child)
            members[child].add(c)
            node = child
        ends[node].add(c)
    if not members:
        return set()
    depth, saved, leaves = {0: 0}, defaultdict(int), defaultdict(int)
    for node in sorted(members):  # parents are numbered before their children
        if node:
            depth[node] = depth[parent[node]] + 1
    for node in sorted(members, reverse=True):
        if node:
            saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", last[node][1]))
        leaves[node] += not kids[node]
        if node:
            saved[parent[node]] += saved[node]
            leaves[parent[node]] += leaves[node]
    return sorted(
        (
            min(members[n]), depth[n], min(members[parent[n]]) if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    )


def told(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def conversations():
    draw = random.Random(8)
    rows = []
    for c in [*range(130), *range(4090, 4130), 10_000, 10_001, -7, -20]:
        if c in (40, 60):  # their families have no base
            continue
        first = draw.choice(["hello there you", "what  is\tthis", "", None])
        for turn in range(draw.choice([0, 1, 1, 2, 3, 7, 8, 9, 20])):
            text = first if turn == 0 else draw.choice(["yes", "no", "tell me\nmore", f"own {draw.randrange(3)}"])
            rows.append((c, turn, draw.choice(["user", "assistant", None]) if turn > 1 else "user", text, "x", 1))
    rows += [(3, None, "system", "first of all", "x", 1), (3, None, None, None, "x", 1), (5, 0, "user", "tie", "x", 1), (5, 0, "user", "another tie", "x", 1)]
    rows += [rows[4]] * 3 + [(None, 0, "user", "no conversation", "x", 1)]
    rows += [(100, 2, "", "a b c", "x", 1)] * 30
    return rows


@pytest.mark.parametrize("columns, stretch", [(8, 512), (3, 2)])
def test_nodes_equal_a_trie_built_by_turns(spark, columns, stretch):
    rows = conversations()
    assert told(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), columns, stretch)) == reference(rows)


def test_one_conversation_of_very_many_turns(spark):
    rows = [(20, i, "user", f"turn {i % 97}", "x", 1) for i in range(9000)]
    rows += [(20 + j, i, "user", f"turn {i % 97}", "x", 1) for j in (1, 2, 7) for i in range(4200 + j)]
    assert told(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == reference(rows)


def test_small_tables(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "one turn of a conversation that takes all from an absent base", "x", 1)]
    got = told(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == reference(rows)


def test_ends_of_a_node_are_hashed_in_numerical_order(spark):
    ids = random.Random(2).sample(range(-50_000, 50_000), 30_000)
    df = spark.createDataFrame([(1, 5, 6, i) for i in ids] + [(2, 5, 6, 9)], "depth long, x long, y long, conv_id long")
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.ends_digests(df.repartition(16)).collect()}
    want = ",".join(map(str, sorted(ids)))
    assert got == {1: hashlib.sha256(want.encode()).hexdigest(), 2: hashlib.sha256(b"9").hexdigest()}
