"""Operator 11 against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from riskweave.llm import prefix_trie
from riskweave.llm.prefix_trie import RangeMinimum

SCHEMA = "conv_id long, turn long, role string, text string, seq int, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            t = (role or "", text or "")
            dig = hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), dig, t))
    own = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        own_saved = (len(members) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def corpus():
    rng, rows = random.Random(3), []
    say = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    openings = [("user", say(5)), ("system", say(9))]
    hot = [("user", "same"), ("assistant", "same \t again"), ("user", "")]
    for c in range(400):
        turns = hot if c % 3 == 0 else [openings[c % 2], *((rng.choice(["user", "assistant"]), f"w{rng.randrange(3)}") for _ in range(rng.randrange(1, 8)))]
        rows += [(c, i, *t, 1, "x") for i, t in enumerate(turns)]
    rows += [(1001, i, "user", f"deep {i}", 1, "x") for i in range(60)] + [(1002, i, "user", f"deep {i}", 1, "x") for i in range(45)] + [(1003, i, "user", f"deep {i if i != 50 else 0}", 1, "x") for i in range(60)]
    rows += [(501, None, None, None, 1, "x"), (501, 1, "user", "b", 1, "x"), (501, 1, "user", "b", 1, "x"), (501, 1, "user", "a", 1, "x"), (None, 0, "user", "nobody", 1, "x"), (503, 0, "user", "x " * 100_000, 1, "x"), (505, 0, "", None, 1, "x"), (507, 3, None, "", 1, "x")]
    return rows + [(c, 0, "user", "only", 1, "x") for c in range(700, 740) if c % 20]  # short ones without their family's first


def test_trie_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie.prefix_trie(df)) == want


def test_many_ranges_share_open_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE", 40)
    monkeypatch.setattr(prefix_trie, "BLOCK", 9)
    monkeypatch.setattr(prefix_trie, "even_prefix", lambda distinct, ranges, n, first=8: 64)
    rows = corpus()
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_range_keys_grow_with_what_is_shared(spark):
    seq = lambda n, last: bytes(16 * n) + bytes([last]) * 16
    df = spark.createDataFrame([(seq(20, i % 250 + 1) + bytes([i // 250 + 1]) * 16,) for i in range(3000)], "seq binary")
    assert prefix_trie.even_prefix(df, 4, 300) == 32
    assert prefix_trie.even_prefix(df, 4, 30_000) == 8


def test_no_rows(spark):
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(None, 1, "user", "x", 1, "x")]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == []
    rows = [(8, 0, "user", "x", 1, "x")]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_reach_and_least():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 13, 64):
        values = rng.integers(0, 5, n)
        values[0] = -1
        table = RangeMinimum(values)
        at, need = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        for i, d, left, right in zip(at, need, table.reach(at, need, -1), table.reach(at, need, 1)):
            low = high = i
            while low > 0 and values[low] >= d:
                low -= 1
            while high + 1 < n and values[high + 1] >= d:
                high += 1
            assert (left, right) == (low, high)
        low = rng.integers(0, n, 50)
        high = np.minimum(n - 1, low + rng.integers(0, n, 50))
        assert table.least(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
