"""op13 against brute force, with shards of few conversations so that spines merge."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from leafmill.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + t[h:]
    node, ends = defaultdict(set), defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            node[tuple(t[:d])].add(c)
        ends[tuple(t)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in node:
        if p:
            kids[p[:-1]] += 1
    for p, members in node.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    for p, members in node.items():
        text = ",".join(map(str, sorted(ends[p])))
        yield (min(members), len(p), min(node[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(text.encode()).hexdigest())


def some(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        first = c - c % 20 if rng.random() < 0.5 else c
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"word {rng.randrange(2)} of {first if t > 3 else ''}" + " more" * rng.randrange(2)))
    copies = [(1000 + c, t, "user", "the same words") for c in range(60) for t in range(3 + c % 2)]
    return rows + copies


def same(spark, rows, block):
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS), block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_equals_brute_force(spark, block):
    same(spark, some(block, 90), block)


@pytest.mark.parametrize("block", [2, 100])
def test_cases(spark, block):
    long = " ".join(f"w{k}" for k in range(50000))
    rows = [(0, None, None, None), (0, None, "user", "b"), (0, 1, "user", long), (0, 1, "user", long), (5, 3, "user", long), (None, 0, "user", "x"), (None, None, None, None)]
    rows += [(19, 0, "", ""), (20, 7, "a", " \t\n"), (21, 7, "a", " \t\n"), (21, 8, "a", "Zoë 🙂 𝔘"), (40, 0, "system", "1:x"), (41, 0, "system", "1:x"), (-3, 0, "u", "x")]
    rows += [(50, t, "user", f"turn {t}") for t in range(500)]
    same(spark, [r for r in rows if r[0] != -3], block)
    assert trie.conversation_trie(spark.createDataFrame([], TURNS), block).collect() == []
    extra = spark.createDataFrame(some(3, 30), TURNS).selectExpr("*", "1 key", "'x' path", "2 block", "3 words", "4 i", "5 depth")
    assert sorted(map(tuple, trie.conversation_trie(extra, block).collect()), key=str) == sorted(brute(some(3, 30)), key=str)


def test_find_close():
    rng = random.Random(0)
    for n in (1, 5, 200, 3000):
        bits, depth, left = [], 0, n
        while left or depth:
            go = left and (depth == 0 or rng.random() < 0.5 + 0.4 * (n == 3000))
            bits.append(bool(go))
            left, depth = left - bool(go), depth + (1 if go else -1)
        stack, want = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        bits = np.array(bits)
        opens = np.flatnonzero(bits)
        for block in (1, 4, 64):
            assert trie.find_close(bits, opens, block).tolist() == [want[k] for k in opens]
