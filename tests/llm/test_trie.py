"""The conversation trie against a tree built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from duelwise.llm import trie

ROWS = "conv_id long, turn long, role string, text string, depth string, c string, k string, size string, n_convs string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    r = random.Random(seed)
    rows, word = [], ["hi", "ho", "é日", ""]
    for c in [*range(0, 40), *range(95, 130), -5, -100, -130, 10**12 + 3]:
        for t in range(r.choice([1, 2, 3, 8, 14])):
            rows.append((c, t if r.random() > 0.05 else None, r.choice(["user", "user", "assistant", None]), r.choice([*word, None])))
    for c in range(200, 260):  # copies of one conversation
        rows += [(c, t, "user", f"turn {t}") for t in range(9)]
    for c in range(300, 340):  # a comb: each goes one turn further along its forerunner
        rows += [(c, t, "user", "x" if t < c - 300 else f"own {c}") for t in range(c - 300 + 2)]
    rows += [(400, t, "user", "long" * (t % 3)) for t in range(500)]
    rows += [(401, t, "user", "long" * (t % 3)) for t in range(499)]
    rows += [(402, 7, "user", "w" * 100_000), (402, 7, "user", "w" * 100_000), (402, 7, None, None), (None, 1, "user", "lost"), *rows[:9]]
    return rows


@pytest.mark.parametrize(("seed", "block", "joined"), [(1, trie.BLOCK, trie.JOINED), (2, 4, 20), (3, 1, 1)])
def test_trie(spark, seed, block, joined):
    rows = conversations(seed)
    df = spark.createDataFrame([(*x, "d", "c", "k", "s", "n") for x in rows], ROWS).repartition(3)
    got = [tuple(x[c] for c in COLUMNS) for x in trie.prefix_trie(df, block, joined).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


@pytest.mark.parametrize("rows", [[(5, 0, "user", "a")], [(7, 0, None, None), (8, 0, None, "")], [(None, 0, "user", "a")]])
def test_small_tries(spark, rows):
    df = spark.createDataFrame([(*x, "d", "c", "k", "s", "n") for x in rows], ROWS)
    assert {tuple(x[c] for c in COLUMNS) for x in trie.prefix_trie(df).collect()} == brute(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
